"""Registered queries of the file sources: each writes its files from the tables and reads them back."""

from __future__ import annotations

import io
import json
import struct
import uuid

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.export import label_manifest
from ..session import shared_folder
from ..sources import documents as doc
from ..sources import fixedwidth, sinks
from . import adapters as ad
from .basics import R
from .registry import query


def _folder(s) -> str:
    """A new folder as a plain path: the record writer needs one that all tasks mount."""
    return f"{shared_folder(s).removeprefix('file://').removeprefix('file:')}/files-{uuid.uuid4().hex}"


def _uri(s) -> str:
    """A new folder in the shared folder, whatever file system that is on."""
    return f"{shared_folder(s)}/files-{uuid.uuid4().hex}"


def _made(path: str) -> str:
    import os

    os.makedirs(path, exist_ok=True)
    return path


def _grid(s, d):
    """Points as whole millimetres, so that files give back what they got."""
    return ad.points(s, d, "r", "g", "b", "intensity").select(
        "scan_id", "point_id", *[F.floor(F.col(a) * 1000).cast("int").alias(a.upper()) for a in "xyz"], "r", "g", "b", F.col("intensity").cast("int").alias("intensity")
    )


_MM = "CAST(floor({0}*1000) AS INT)/CAST(1000 AS DOUBLE)"


@query("src3_las", f"SELECT row_number() OVER (ORDER BY point_id)-1 AS point_id, round({_MM.format('x')}+1,4) AS x, round({_MM.format('y')}+2,4) AS y, round({_MM.format('z')}+3,4) AS z, CAST(r AS INT) AS r, CAST(CAST(intensity AS INT) AS DOUBLE) AS intensity FROM li", "li")
def _(s, d):
    fixedwidth.register(s)
    path = _made(_folder(s)) + "/a.las"
    dtype = np.dtype({"names": ["X", "Y", "Z", "intensity", "r", "g", "b"], "formats": ["<i4"] * 3 + ["<u2"] * 4, "offsets": [0, 4, 8, 12, 28, 30, 32], "itemsize": 34})

    def head(n: int) -> bytes:
        h = bytearray(227)
        h[:4], h[24], h[25], h[104] = b"LASF", 1, 2, 3
        struct.pack_into("<H", h, 94, 227)
        struct.pack_into("<I", h, 96, 227)
        struct.pack_into("<H", h, 105, 34)
        struct.pack_into("<I", h, 107, n)
        struct.pack_into("<6d", h, 131, 0.001, 0.001, 0.001, 1, 2, 3)
        return bytes(h)

    sinks.write_records(_grid(s, d), path, dtype, head)
    rows = s.read.format("las").load(path)
    return rows.select(F.col("point_id").cast("bigint").alias("point_id"), *[R(a, 4).alias(a) for a in "xyz"], F.col("r").cast("int").alias("r"), F.col("intensity").cast("double").alias("intensity"))


@query("src4_labels_npy", "SELECT row_number() OVER (ORDER BY point_id)-1 AS point_id, CAST(ia AS BIGINT) AS value FROM li", "li")
def _(s, d):
    fixedwidth.register(s)
    path = _made(_folder(s)) + "/labels.npy"

    def head(n: int) -> bytes:
        out = io.BytesIO()
        np.lib.format.write_array_header_1_0(out, {"descr": "<i4", "fortran_order": False, "shape": (n,)})
        return out.getvalue()

    n = sinks.write_records(ad.labels(s, d).withColumn("value", F.col("instance_id")), path, np.dtype([("value", "<i4")]), head)
    return fixedwidth.read_labels_npy(s, path, n, "li").select(F.col("point_id").cast("bigint").alias("point_id"), F.col("value").cast("bigint").alias("value"))


@query("src5_potree", f"SELECT row_number() OVER (ORDER BY point_id)-1 AS point_id, round({_MM.format('x')}+1,4) AS x, round({_MM.format('y')}+2,4) AS y, round({_MM.format('z')}+3,4) AS z FROM li", "li")
def _(s, d):
    fixedwidth.register(s)
    folder = _made(_folder(s))
    with open(f"{folder}/metadata.json", "w", encoding="utf-8") as f:
        json.dump({"scale": [0.001] * 3, "offset": [1, 2, 3], "attributes": [{"name": "rgb", "size": 6}, {"name": "position", "size": 12}], "encoding": "DEFAULT"}, f)
    dtype = np.dtype([("r", "<u2"), ("g", "<u2"), ("b", "<u2"), ("X", "<i4"), ("Y", "<i4"), ("Z", "<i4")])
    sinks.write_records(_grid(s, d), f"{folder}/octree.bin", dtype, lambda n: b"")
    rows = s.read.format("potree").load(folder)
    return rows.select(F.col("point_id").cast("bigint").alias("point_id"), *[R(a, 4).alias(a) for a in "xyz"])


def _documents(s, rows, column: str, folder: str) -> str:
    """One JSON document per value of ``folder``: {column: [the row's structs in order]}; returns the glob of its files."""
    root = f"{shared_folder(s)}/docs-{uuid.uuid4().hex}"
    packed = rows.groupBy(folder).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "body"))), lambda e: e["body"]).alias(column))).alias("value"))
    packed.write.partitionBy(folder).text(root)
    return f"{root}/*/*.txt"


@query("src6_instances", "SELECT CAST(s_nationkey AS VARCHAR) AS session, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)-1 AS INT) AS ord, CAST(s_suppkey AS INT) AS \"segId\", CASE WHEN s_suppkey%5=0 THEN NULL ELSE 'pipe' END AS cls, s_acctbal>0 AND s_suppkey%5<>0 AS confirmed FROM supplier WHERE s_suppkey%4<>0")
def _(s, d):
    body = "named_struct('id', CAST(s_suppkey AS STRING), 'kind', IF(s_suppkey % 4 = 0, 'cuboid', 'pointset'), 'segId', s_suppkey, 'cls', IF(s_suppkey % 5 = 0, NULL, 'pipe'), 'confirmed', s_acctbal > 0)"
    rows = ad.table(s, d, "supplier").selectExpr("CAST(s_nationkey AS STRING) AS session", "s_suppkey AS ord", f"{body} AS body")
    got = doc.instances_for_invariants(doc.read_instances(s, _documents(s, rows, "instances", "session")))
    got = got.withColumn("session", F.regexp_extract("session_id", "=(.*)$", 1))
    place = F.row_number().over(Window.partitionBy("session").orderBy("ord")) - 1
    return got.select("session", place.alias("ord"), F.col("segId").cast("int").alias("segId"), "cls", "confirmed")


@query("src8_centerlines", "SELECT CAST(s_suppkey AS INT) AS instance_id, round(s_acctbal,2) AS radius, round(s_suppkey*CAST(0.5 AS DOUBLE),4) AS x1, s_suppkey%2=0 AS smooth FROM supplier")
def _(s, d):
    body = "named_struct('instance_id', CAST(s_suppkey AS INT), 'points', array(array(0D, 0D, 0D), array(s_suppkey * 0.5D, 1D, 1D)), 'radius', s_acctbal, 'smooth', IF(s_suppkey % 2 = 0, true, NULL))"
    rows = ad.table(s, d, "supplier").selectExpr("CAST(s_nationkey AS STRING) AS session", "s_suppkey AS ord", f"{body} AS body")
    got = doc.read_centerlines(s, _documents(s, rows, "paths", "session"))
    return got.select(F.col("instance_id").cast("int").alias("instance_id"), R("radius", 2).alias("radius"), R(F.col("points")[1][0], 4).alias("x1"), "smooth")


@query("src10_render_runs", "SELECT CAST(s_nationkey AS VARCHAR) AS run_id, CAST(count(*) AS INT) AS n_frames, bool_or(s_suppkey%7=0) AS has_target FROM supplier GROUP BY 1")
def _(s, d):
    """A render manifest per nation, a frame per supplier; some frames name what they look at."""
    body = "named_struct('file', concat(s_suppkey, '.png'), 'position', array(s_acctbal, 0D, 1D), 'target', IF(s_suppkey % 7 = 0, array(0D, 0D, 0D), NULL))"
    rows = ad.table(s, d, "supplier").selectExpr("CAST(s_nationkey AS STRING) AS run", "s_suppkey AS ord", f"{body} AS body")
    got = doc.discover_render_runs(s, _documents(s, rows, "frames", "run"))
    return got.select(F.regexp_extract("run_id", "=(.*)$", 1).alias("run_id"), F.col("n_frames").cast("int").alias("n_frames"), "has_target")


_HEX = "CASE k%3 WHEN 0 THEN '00' WHEN 1 THEN '80' ELSE 'ff' END"


@query("src11_class_registry", f"""WITH c AS (SELECT s_suppkey AS k, s_nationkey AS f, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS p FROM supplier)
SELECT CAST(f AS VARCHAR) AS registry, CAST(k AS INT) AS id, 'part-'||k AS name, CASE WHEN k%2=0 THEN 'Part: '||k ELSE 'Part-'||k END AS label,
 CASE k%4 WHEN 0 THEN '#'||{_HEX}||'00ff' WHEN 1 THEN '#5b8def' ELSE '#12ab'||CASE k%4 WHEN 2 THEN 'cd' ELSE 'ef' END END AS color,
 CAST(CASE WHEN k%5=0 THEN k%10 ELSE p END AS VARCHAR) AS hotkey, CASE WHEN k%3=0 THEN 'pipes' ELSE '' END AS "group", k%6=0 AS frozen FROM c""")
def _(s, d):
    """A YAML class registry per nation with an entry per supplier: quoted and missing labels, colours in three forms."""
    root = f"{shared_folder(s)}/registry-{uuid.uuid4().hex}"
    color = "CASE k % 4 WHEN 0 THEN concat(', color: [', k % 3 / 2, ', 0, 1.0]') WHEN 1 THEN '' WHEN 2 THEN ', color: \"#12abcd\"' ELSE ', color: \"#12abef\"' END"
    line = f"concat('  part-', k, ': {{ id: ', k, IF(k % 2 = 0, concat(', label: \"Part: ', k, '\"'), ''), {color}, IF(k % 5 = 0, concat(', key: \"', k % 10, '\"'), ''), IF(k % 3 = 0, ', group: pipes', ''), IF(k % 6 = 0, ', frozen: true', ''), ' }}')"
    rows = ad.table(s, d, "supplier").selectExpr("s_nationkey AS nation", "s_suppkey AS k").selectExpr("nation", "k", f"{line} AS line")
    packed = rows.groupBy("nation").agg(F.concat(F.lit("# classes\nclasses:\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda e: e["line"]), "\n")).alias("value"))
    packed.write.partitionBy("nation").text(root)
    got = doc.read_class_registry(s, f"{root}/*/*.txt")
    return got.withColumn("registry", F.regexp_extract("file", "nation=([^/]+)/", 1)).drop("file")


@query("src13_catalog", "SELECT 'annotated' AS tier, 'name='||n_name AS name, CAST(n_nationkey*10 AS BIGINT) AS n_points FROM nation WHERE n_nationkey%3<>0")
def _(s, d):
    root = f"{shared_folder(s)}/catalog-{uuid.uuid4().hex}"
    meta = "to_json(named_struct('scan_name', n_name, 'n_points', n_nationkey * 10, 'schema_version', IF(n_nationkey % 3 = 0, '1.0', '2.1')))"
    ad.table(s, d, "nation").selectExpr("n_name AS name", f"{meta} AS value").repartition("name").write.partitionBy("name").text(root)
    return doc.scan_catalog(s, f"{root}/*/*.txt").select("tier", F.regexp_replace("name", "%20", " ").alias("name"), "n_points")


@query("src14_raw_source", "SELECT o_orderkey AS id, CASE WHEN o_orderkey%2=0 THEN 'raw/'||o_custkey||'.las' WHEN o_orderkey%3=0 THEN 'root/'||o_custkey%7 END AS raw_path FROM orders")
def _(s, d):
    orders = ad.table(s, d, "orders")
    scans = orders.selectExpr("o_orderkey AS id", "IF(o_orderkey % 2 = 0, concat('old/place/', o_custkey, '.las'), concat('gone/', o_orderkey)) AS source_path", "IF(o_orderkey % 3 = 0, CAST(o_custkey % 7 AS STRING), NULL) AS root_source_id")
    raw = orders.selectExpr("concat('raw/', o_custkey, '.las') AS path").distinct()
    registry = s.range(7).selectExpr("CAST(id AS STRING) AS source_id", "concat('root/', id) AS path")
    return doc.resolve_raw_source(scans, raw, registry).select("id", "raw_path")


@query("src15_variants", "WITH v AS (SELECT o_custkey AS k, -1 AS ord, 'v0' AS id FROM orders UNION ALL SELECT o_custkey, o_orderkey, 'v'||o_orderkey%4 FROM orders), f AS (SELECT k, id, min(ord) AS ord FROM v GROUP BY 1,2) SELECT CAST(k AS VARCHAR) AS scan_id, string_agg(id, ',' ORDER BY ord) AS variants FROM f GROUP BY k")
def _(s, d):
    orders = ad.table(s, d, "orders")
    scans = orders.selectExpr("CAST(o_custkey AS STRING) AS scan_id", "'v0' AS variant_id").distinct()
    runs = orders.selectExpr("CAST(o_custkey AS STRING) AS scan_id", "concat('v', o_orderkey % 4) AS source_variant", "CAST(o_orderkey AS INT) AS ord")
    return doc.variants_index(scans, runs).select("scan_id", F.array_join(F.transform("variants", lambda v: v["variant_id"]), ",").alias("variants"))


_CONF = "(intensity/CAST(80 AS DOUBLE))"
_FADE = lambda c: f"CAST(floor(coalesce(p{c},60)*{_CONF}+60*(1-{_CONF})) AS INT) AS {c}"


@query("snk3_colored_ply", f"WITH pal AS (SELECT n_nationkey AS k, n_nationkey*10 AS pr, 255-n_nationkey*5 AS pg, n_regionkey*50 AS pb FROM nation) SELECT row_number() OVER (ORDER BY point_id)-1 AS point_id, ia<0 AS grey, {_FADE('r')}, {_FADE('g')}, {_FADE('b')} FROM li LEFT JOIN pal ON k=ca", "li")
def _(s, d):
    """Instance colours and faded class colours, each written and read back; no hashed colour is grey."""
    base = _uri(s)
    points, labels = ad.points(s, d, "intensity"), ad.labels(s, d)
    sinks.write_colored_ply(points, labels, f"{base}/instances")
    palette = ad.table(s, d, "nation").selectExpr("n_nationkey AS class_id", "n_nationkey*10 AS r", "255-n_nationkey*5 AS g", "n_regionkey*50 AS b")
    sure = points.withColumn("confidence", F.col("intensity") / 80).join(labels.select("scan_id", "point_id", "class_id"), ["scan_id", "point_id"])
    sinks.write_parts(sinks.class_colors(sure, palette).select("scan_id", "point_id", *"xyz", *"rgb"), f"{base}/classes")
    seen = s.read.format("ply").load(f"{base}/instances").select("scan_id", "point_id", ((F.col("r") == 60) & (F.col("g") == 60) & (F.col("b") == 60)).alias("grey"))
    return s.read.format("ply").load(f"{base}/classes").join(seen, ["scan_id", "point_id"]).select("point_id", "grey", *"rgb")


@query("snk5_export_bundle", "SELECT row_number() OVER (ORDER BY point_id)-1 AS point_id, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x, b, ca AS class_id, ia AS instance_id, CAST(count(*) OVER (PARTITION BY ca) AS DOUBLE) AS class_total FROM li", "li")
def _(s, d):
    """Points read back from the bundle with the number of points that its manifest gives for their class."""
    base = _uri(s)
    labels = ad.labels(s, d).select("scan_id", "point_id", "class_id", "instance_id", "category")
    none = labels.select("scan_id", "point_id", F.lit("").alias("shape_id")).limit(0)
    sinks.export_bundle(ad.points(s, d, *"rgb"), labels, label_manifest(labels, none, {}), base)
    said = s.read.schema("section string, key string, value double").json(f"{base}/manifest").filter("section = 'class'")
    said = said.select(F.col("key").cast("int").alias("class_id"), F.col("value").alias("class_total"))
    return s.read.format("ply").load(f"{base}/points").join(said, "class_id", "left").select("point_id", "x", "b", "class_id", "instance_id", "class_total")
