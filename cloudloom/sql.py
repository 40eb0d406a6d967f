"""SQL surface: st_* functions as SQL expressions and the cell-cover table function."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="gx: bigint, gy: bigint, gz: bigint")
class ExplodeCells:
    """Grid cells of side ``size`` that touch a box."""

    def eval(self, lx: float, ly: float, lz: float, hx: float, hy: float, hz: float, size: float):
        spans = [range(math.floor(a / size), math.floor(b / size) + 1) for a, b in ((lx, hx), (ly, hy), (lz, hz))]
        for x in spans[0]:
            for y in spans[1]:
                for z in spans[2]:
                    yield x, y, z


# One rotation row of Euler XYZ per local axis, written against the function's arguments.
_LOCAL = [
    "dx*cos(ry)*cos(rz) + dy*(cos(rx)*sin(rz)+sin(rx)*sin(ry)*cos(rz)) + dz*(sin(rx)*sin(rz)-cos(rx)*sin(ry)*cos(rz))",
    "-dx*cos(ry)*sin(rz) + dy*(cos(rx)*cos(rz)-sin(rx)*sin(ry)*sin(rz)) + dz*(sin(rx)*cos(rz)+cos(rx)*sin(ry)*sin(rz))",
    "dx*sin(ry) - dy*sin(rx)*cos(ry) + dz*cos(rx)*cos(ry)",
]


def register(spark: SparkSession) -> None:
    """Create st_loa_band, st_in_obb, st_in_prism, st_in_tube and explode_cells."""
    spark.udtf.register("explode_cells", ExplodeCells)
    inside = " AND ".join(f"abs({e}) <= s{a}/2" for e, a in zip(_LOCAL, "xyz"))
    for d, a in (("dx", "x"), ("dy", "y"), ("dz", "z")):
        inside = inside.replace(d, f"({a}-c{a})")
    args = "x DOUBLE, y DOUBLE, z DOUBLE, "
    make = "CREATE OR REPLACE TEMPORARY FUNCTION "
    box = ", ".join(f"{p}{a} DOUBLE" for p in "csr" for a in "xyz")
    spark.sql(f"{make} st_in_obb({args}{box}) RETURNS BOOLEAN RETURN {inside}")
    spark.sql(
        f"{make} st_loa_band(d DOUBLE) RETURNS STRING RETURN CASE WHEN d <= 0.001 THEN 'LOA50' WHEN d <= 0.005 THEN 'LOA40' "
        "WHEN d <= 0.015 THEN 'LOA30' WHEN d <= 0.05 THEN 'LOA20' ELSE 'LOA10' END"
    )
    edge = (
        "aggregate(sequence(1, size(polygon)), false, (acc, i) -> acc != ("
        "(element_at(polygon, i)[1] > z) != (element_at(polygon, i % size(polygon) + 1)[1] > z) AND "
        "x < element_at(polygon, i)[0] + (z - element_at(polygon, i)[1]) * (element_at(polygon, i % size(polygon) + 1)[0] - element_at(polygon, i)[0]) / "
        "nullif(element_at(polygon, i % size(polygon) + 1)[1] - element_at(polygon, i)[1], 0D)))"
    )
    spark.sql(
        f"{make} st_in_prism({args}polygon ARRAY<ARRAY<DOUBLE>>, y0 DOUBLE, height DOUBLE) RETURNS BOOLEAN "
        f"RETURN CASE WHEN size(polygon) < 3 OR height <= 0 OR y < y0 OR y > y0 + height THEN false ELSE coalesce({edge}, false) END"
    )
    seg = (
        "exists(sequence(1, greatest(size(points) - 1, 1)), i -> aggregate(array(0,1,2), 0D, (s, k) -> s + pow("
        "array(x,y,z)[k] - element_at(points, i)[k] - greatest(0D, least(1D, coalesce("
        "((x-element_at(points,i)[0])*(element_at(points,i+1)[0]-element_at(points,i)[0]) + (y-element_at(points,i)[1])*(element_at(points,i+1)[1]-element_at(points,i)[1]) + (z-element_at(points,i)[2])*(element_at(points,i+1)[2]-element_at(points,i)[2]))"
        " / nullif(pow(element_at(points,i+1)[0]-element_at(points,i)[0],2)+pow(element_at(points,i+1)[1]-element_at(points,i)[1],2)+pow(element_at(points,i+1)[2]-element_at(points,i)[2],2), 0D), 0D)))"
        " * (element_at(points, i+1)[k] - element_at(points, i)[k]), 2)) <= radius*radius)"
    )
    spark.sql(f"{make} st_in_tube({args}points ARRAY<ARRAY<DOUBLE>>, radius DOUBLE) RETURNS BOOLEAN RETURN {seg}")
