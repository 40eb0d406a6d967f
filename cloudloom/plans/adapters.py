"""Test tables as clouds, labels, shapes, frames and sessions.

Each adapter is one SELECT that Spark and the checking engine both understand.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

LI = """SELECT 'li' AS scan_id,
 (((l_orderkey*8+l_linenumber)*32768+l_partkey)*1024+l_suppkey)*64+CAST(l_quantity AS BIGINT) AS point_id,
 l_quantity*0.2 AS x, l_discount*10+l_tax*5 AS y, l_extendedprice/10000 AS z,
 CAST(l_partkey%256 AS INT) AS r, CAST(l_suppkey%256 AS INT) AS g, CAST(l_orderkey%256 AS INT) AS b,
 CAST(CASE WHEN l_linestatus='O' THEN -1 ELSE l_suppkey%6 END AS INT) AS ca,
 CAST(CASE WHEN l_linestatus='O' THEN -1 ELSE l_suppkey END AS INT) AS ia,
 CAST(CASE WHEN l_linestatus='O' THEN l_linenumber%4 ELSE 0 END AS INT) AS ka,
 CAST(CASE WHEN l_returnflag='A' THEN -1 WHEN l_linenumber=7 THEN (l_suppkey+1)%6 ELSE l_suppkey%6 END AS INT) AS cb,
 CAST(CASE WHEN l_returnflag='A' THEN -1 ELSE l_suppkey END AS INT) AS ib,
 CAST(CASE WHEN l_linenumber<=2 THEN -1 ELSE l_partkey%6 END AS INT) AS cc,
 CAST(CASE WHEN l_linenumber<=2 THEN -1 ELSE l_partkey END AS INT) AS ic,
 CAST(l_partkey%200 AS INT) AS preseg_id, CAST(l_linenumber-1 AS INT) AS cand_id,
 CAST(l_partkey*13%65536 AS INT) AS r16, l_tax*1000 AS intensity
 FROM lineitem"""

EMB = """SELECT 'emb' AS scan_id, vec_id AS point_id, CAST(embedding[{0}] AS DOUBLE)*10 AS x,
 CAST(embedding[{1}] AS DOUBLE)*10 AS y, CAST(embedding[{2}] AS DOUBLE)*10 AS z,
 CAST(label AS INT) AS class_id, embedding AS feature FROM embeddings"""

BOXES = """SELECT CAST(p_partkey AS BIGINT) AS shape_id, p_size*CAST(0.2 AS DOUBLE) AS cx, CAST(0.6 AS DOUBLE) AS cy, p_retailprice/200 AS cz,
 CAST(0.5 AS DOUBLE) AS sx, CAST(1.0 AS DOUBLE) AS sy, CAST(0.3 AS DOUBLE) AS sz, CAST(0 AS DOUBLE) AS rx,
 p_partkey*CAST(0.13 AS DOUBLE) AS ry, CAST(0 AS DOUBLE) AS rz, CAST(p_partkey%6 AS INT) AS class_id FROM part"""

REGIONS = """SELECT CAST(n_nationkey AS BIGINT) AS shape_id, (n_nationkey%5)*CAST(2 AS DOUBLE) AS x0,
 floor(n_nationkey/CAST(5.0 AS DOUBLE))*CAST(2 AS DOUBLE) AS z0, CAST(0 AS DOUBLE) AS y0, CAST(0.8 AS DOUBLE) AS height FROM nation"""

INSTANCES = """SELECT CAST(s_suppkey AS INT) AS "segId", CAST(s_suppkey%6 AS INT) AS class_id,
 s_acctbal > 0 AS confirmed, CAST(s_suppkey AS INT) AS seq FROM supplier"""

#: Bodies to be found again: per 1,500 customers (numbered from 0) one scan with a floor and a pipe in two pieces, 0.2 m apart.
BODIES = """SELECT CAST(floor(c_custkey / 1500) AS BIGINT) AS scan_no, CAST(c_custkey % 1500 AS BIGINT) AS point_id, c_custkey AS k,
 CASE WHEN c_custkey % 1500 < 750 THEN 'floor' ELSE 'pipe' END AS body,
 CAST(CASE WHEN c_custkey % 1500 < 1125 THEN 1 ELSE 2 END AS BIGINT) AS piece,
 CASE WHEN c_custkey % 1500 < 750 THEN (c_custkey % 1500 % 27) * CAST(0.055 AS DOUBLE)
  ELSE floor((c_custkey % 1500 - 750) / CAST(25 AS DOUBLE)) * CAST(0.05 AS DOUBLE) + CASE WHEN c_custkey % 1500 >= 1125 THEN CAST(0.15 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END END AS x,
 CASE WHEN c_custkey % 1500 < 750 THEN floor(c_custkey % 1500 / CAST(27 AS DOUBLE)) * CAST(0.055 AS DOUBLE)
  ELSE CAST(1 AS DOUBLE) + CAST(0.2 AS DOUBLE) * cos((c_custkey % 25) * pi() * CAST(0.08 AS DOUBLE)) END AS y,
 CASE WHEN c_custkey % 1500 < 750 THEN CAST(0 AS DOUBLE)
  ELSE CAST(1.5 AS DOUBLE) + CAST(0.2 AS DOUBLE) * sin((c_custkey % 25) * pi() * CAST(0.08 AS DOUBLE)) END AS z FROM customer"""

SESSIONS = """SELECT CAST(o_custkey AS VARCHAR(20)) AS scan_id, CAST(o_orderkey AS VARCHAR(20)) AS session_id,
 o_orderstatus AS st, o_orderdate, o_totalprice, o_orderkey FROM orders"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as a stream of its files, whether it is one file or a folder of them."""
    # A glob with a class matches by name only, so one path serves both: a file by itself, a folder with all of its parts.
    return spark.readStream.schema(table(spark, folder, name).schema).parquet(os.path.join(folder, f"{name}.parque[t]"))


def run(spark: SparkSession, folder: str, select: str) -> DataFrame:
    """Run an adapter SELECT over the folder's tables."""
    names = set(re.findall(r"FROM (\w+)", select))
    out = select.replace('"', "`")
    frames = {}
    for n in names:
        frames[n] = table(spark, folder, n)
        out = re.sub(rf"FROM {n}\b", "FROM {" + n + "}", out)
    return spark.sql(out, **frames)


def li(spark: SparkSession, folder: str) -> DataFrame:
    return run(spark, folder, LI)


def points(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    return li(spark, folder).select("scan_id", "point_id", "x", "y", "z", *extra)


def labels(spark: SparkSession, folder: str, which: str = "a") -> DataFrame:
    """Labels A (with category, preseg and candidate layers), B or C."""
    base = li(spark, folder)
    if which == "a":
        return base.selectExpr("scan_id", "point_id", "ca AS class_id", "ia AS instance_id", "ka AS category", "preseg_id", "cand_id")
    return base.selectExpr("scan_id", "point_id", f"c{which} AS class_id", f"i{which} AS instance_id", "0 AS category")


def emb(spark: SparkSession, folder: str) -> DataFrame:
    return run(spark, folder, EMB.format(0, 1, 2))


def boxes(spark: SparkSession, folder: str) -> DataFrame:
    return run(spark, folder, BOXES)


def regions(spark: SparkSession, folder: str) -> DataFrame:
    return run(spark, folder, REGIONS).selectExpr(
        "shape_id", "array(array(x0, z0), array(x0+1.8D, z0+0.2D), array(x0+1.6D, z0+1.9D), array(x0+0.1D, z0+1.7D)) AS polygon", "y0", "height"
    )


def bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Planted floors and pipes, one scan per 1,500 customers."""
    return run(spark, folder, BODIES).selectExpr("concat('s', scan_no) AS scan_id", "point_id", "body", "piece", "x", "y", "z")


def instances(spark: SparkSession, folder: str) -> DataFrame:
    return run(spark, folder, INSTANCES)


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """One camera per supplier, above its own patch of the cloud."""
    at = table(spark, folder, "supplier").selectExpr("s_suppkey", "s_suppkey%10 + 0.537D AS tx", "(s_suppkey DIV 10)%10 + 0.537D AS tz")
    return at.selectExpr(
        "CAST(s_suppkey AS INT) AS frame_id",
        "array(tx + 1.5D*cos(s_suppkey*0.785398D), 3D, tz + 1.5D*sin(s_suppkey*0.785398D)) AS position",
        "array(tx, 0.5D, tz) AS target", "12D AS fov", "160 AS width", "120 AS height",
        "CAST(s_suppkey AS INT) AS rank", "CAST(s_suppkey%2 AS STRING) AS run_id", "CAST(s_suppkey AS INT) AS ord",
    )


def masks(spark: SparkSession, folder: str) -> DataFrame:
    """Two striped masks per frame from a pixel rule over the frame table."""
    from pyspark.sql import functions as F

    # Frames of one file are one task, whose pixels are many.
    dealt = frames(spark, folder).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    px = dealt.select("frame_id", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("v"))
    px = px.select("frame_id", "v", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("u"))
    px = px.withColumn("m", F.explode(F.array(F.lit(0), F.lit(1)))).filter("(u DIV 20 + v DIV 15 + m * (1 + frame_id)) % 2 = 0")
    return px.selectExpr(
        "frame_id", "u", "v", "frame_id * 2 + m AS mask_id", "1 + (frame_id + m) % 3 AS class_id",
        "0.5D + 0.0625D * (frame_id % 8) + 0.03125D * m AS score",
    )


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    return run(spark, folder, SESSIONS)
