"""Paths, beams, footprints and measure classes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import LOA_BANDS, LOA_REST
from .frames import col, cross, dot, euler_from_basis


def sample_path(path: dict) -> list[list[float]]:
    """Driver-side chords of one literal path (see ``chords`` for tables)."""
    pts = [[float(v) for v in p] for p in path["points"]]
    if not path.get("smooth") or len(pts) < 3:
        return pts
    step = max(float(path["radius"]) / 2.0, 1e-4)
    ctrl = [pts[0], *pts, pts[-1]]
    out = [pts[0]]
    for w in range(len(pts) - 1):
        quad = ctrl[w : w + 4]
        n = max(math.ceil(math.dist(quad[1], quad[2]) / step), 1)
        out += [[_spline(*axis, i / n) for axis in zip(*quad)] for i in range(1, n + 1)]
    return out


def _spline(p0, p1, p2, p3, t):
    """Uniform Catmull-Rom cubic; works for numbers and columns."""
    return 0.5 * (
        2.0 * p1 + (p2 - p0) * t + (2.0 * p0 - 5.0 * p1 + 4.0 * p2 - p3) * t * t
        + (3.0 * p1 - p0 - 3.0 * p2 + p3) * t * t * t
    )


def chords(paths: DataFrame) -> DataFrame:
    """(path_id, instance_id, radius, seg, ax..bz): straight pieces of every path.

    Smooth paths of three or more control points get Catmull-Rom samples every
    radius / 2; others pass through.
    """
    n = F.size("points")
    curved = F.col("smooth") & (n >= 3)
    at = lambda i: F.element_at("points", F.greatest(F.lit(1), F.least(i, n)).cast("int"))
    quad = lambda w: F.struct(w.alias("w"), *[at(w + j - 1).alias(f"p{j}") for j in range(4)])
    spans = paths.filter(n >= 2).select(
        "path_id", "instance_id", "radius", curved.alias("curved"),
        F.explode(F.transform(F.sequence(F.lit(1), n - 1), quad)).alias("q"),
    ).select("path_id", "instance_id", "radius", "curved", "q.*")
    gap = F.zip_with("p1", "p2", lambda a, b: (b - a) * (b - a))
    length = F.sqrt(F.aggregate(gap, F.lit(0.0), lambda t, v: t + v))
    step = F.greatest(F.col("radius") / 2.0, F.lit(1e-4))
    parts = F.when(F.col("curved"), F.greatest(F.ceil(length / step), F.lit(1))).otherwise(F.lit(1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(1), parts), lambda i: F.struct(i.alias("i"), parts.alias("parts")))
    spans = spans.withColumn("e", F.explode(pieces)).select("*", "e.i", "e.parts")

    def point(i: Column, axis: int) -> Column:
        t = i / F.col("parts")
        curve = _spline(*[F.col(f"p{j}")[axis] for j in range(4)], t)
        line = F.when(i == 0, F.col("p1")[axis]).otherwise(F.col("p2")[axis])
        return F.when(F.col("curved"), curve).otherwise(line)

    start, stop = F.col("i") - 1, F.col("i")
    return spans.select(
        "path_id", "instance_id", "radius", (F.shiftleft(F.col("w").cast("bigint"), 32) + F.col("i")).alias("seg"),
        *[point(start, k).alias(f"a{c}") for k, c in enumerate("xyz")],
        *[point(stop, k).alias(f"b{c}") for k, c in enumerate("xyz")],
    )


def catmull_rom(paths: DataFrame) -> DataFrame:
    """(path_id, seq, x, y, z): sampled polyline vertices of every path."""
    from pyspark.sql import Window

    pieces = chords(paths)
    first = pieces.groupBy("path_id").agg(F.min_by(F.struct("ax", "ay", "az"), "seg").alias("p"))
    head = first.select("path_id", F.lit(0).cast("long").alias("seg"), "p.ax", "p.ay", "p.az").toDF(
        "path_id", "seg", "x", "y", "z"
    )
    rest = pieces.select("path_id", F.col("seg").cast("long"), "bx", "by", "bz").toDF("path_id", "seg", "x", "y", "z")
    seq = F.row_number().over(Window.partitionBy("path_id").orderBy("seg")) - 1
    return head.unionByName(rest).select("path_id", seq.alias("seq"), "x", "y", "z")


def beam_to_obb(a, b, width) -> dict[str, Column]:
    """Center, size and Euler rotation of a beam between two end points."""
    a, b = [col(v) for v in a], [col(v) for v in b]
    d = [q - p for p, q in zip(a, b)]
    length = F.sqrt(dot(d, d))
    length = F.when(length < 1e-9, F.raise_error(F.lit("degenerate beam")).cast("double")).otherwise(length)
    u = [c / length for c in d]
    mag = [F.abs(c) for c in u]
    use_x = (mag[0] <= mag[1]) & (mag[0] <= mag[2])
    use_y = ~use_x & (mag[1] <= mag[2])
    ref = [F.when(use_x, 1.0).otherwise(0.0), F.when(use_y, 1.0).otherwise(0.0), F.when(use_x | use_y, 0.0).otherwise(1.0)]
    v = cross(ref, u)
    vn = F.sqrt(dot(v, v))
    v = [c / vn for c in v]
    w = cross(u, v)
    rx, ry, rz = euler_from_basis(u, v, w)
    return {
        "cx": (a[0] + b[0]) / 2.0, "cy": (a[1] + b[1]) / 2.0, "cz": (a[2] + b[2]) / 2.0,
        "sx": length, "sy": col(width), "sz": col(width), "rx": rx, "ry": ry, "rz": rz,
    }


def prism_from_corners(corners, top_y, min_height: float = 0.05) -> Column:
    """Prism struct from snapped corners [[x, y, z]] and an aimed top height."""
    corners, top = col(corners), col(top_y)
    base = F.array_min(F.transform(corners, lambda c: c[1]))
    low, high = F.least(base, top), F.greatest(base, top)
    ok = (F.size(corners) >= 3) & top.isNotNull() & ~F.isnan(top) & (high - low >= min_height)
    ring = F.transform(corners, lambda c: F.array(c[0], c[2]))
    return F.when(ok, F.struct(ring.alias("polygon"), low.alias("y0"), (high - low).alias("height")))


def loa_band(spacing) -> Column:
    out = F.lit(LOA_REST)
    for bound, name in reversed(LOA_BANDS):
        out = F.when(col(spacing) <= bound, F.lit(name)).otherwise(out)
    return out


def classify_cylinder(radius, length) -> Column:
    """Fixed rule on radius (m) and length / diameter."""
    r = col(radius)
    aspect = F.when(r > 0, col(length) / (2.0 * F.when(r > 0, r).otherwise(F.lit(1.0)))).otherwise(F.lit(0.0))
    return (
        F.when(r > 0.4, "tank")
        .when((r > 0.15) & (aspect < 3), "tank")
        .when(r > 0.15, "large_pipe")
        .when((r > 0.03) & (aspect > 5), "pipe")
        .when((r > 0.03) & (aspect > 1.5), "short_pipe")
        .when(r > 0.03, "fitting")
        .otherwise("small_pipe")
    )


def surface_class(k1, k2, flat: float = 0.9, ratio: float = 4.0) -> Column:
    """0 flat, 1 cylinder, 2 sphere, 3 saddle, 4 edge."""
    a, b = F.abs(col(k1)), F.abs(col(k2))
    hi, lo = F.greatest(a, b), F.least(a, b)
    slope = hi / (lo + 1e-6)
    return (
        F.when(hi > 50, 4)
        .when(hi < flat, 0)
        .when((slope > ratio) & (hi < 50), 1)
        .when((slope < 2.0) & (hi < 50), 2)
        .otherwise(3)
    )
