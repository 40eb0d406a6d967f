"""JSON documents as tables: instances, paths, beams, regions, frames, classes, scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S

MIN_FRAME_BYTES = 50_000


def _docs(spark: SparkSession, paths, body: T.StructType) -> DataFrame:
    return spark.read.schema(body).option("multiLine", True).json(paths).select("*", F.col("_metadata.file_path").alias("file"))


def _need(column: str, doc: str):
    return F.coalesce(F.col(column), F.raise_error(F.lit(f"{doc} document lacks {column}")))


def read_instances(spark: SparkSession, paths) -> DataFrame:
    """One row per instance with its session (parent folder) and list place."""
    body = T.StructType([T.StructField("instances", T.ArrayType(S.INSTANCE))])
    docs = _docs(spark, paths, body)
    rows = docs.select(F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("session_id"), F.posexplode("instances").alias("ord", "i"))
    return rows.select("session_id", "ord", "i.*")


def instances_for_invariants(instances: DataFrame) -> DataFrame:
    """Pointset rows with a segment id; unclassed ones never count as confirmed."""
    rows = instances.filter((F.coalesce("kind", F.lit("")) == "pointset") & F.col("segId").isNotNull())
    return rows.withColumn("confirmed", F.coalesce("confirmed", F.lit(False)) & F.col("cls").isNotNull())


def read_centerlines(spark: SparkSession, paths) -> DataFrame:
    docs = _docs(spark, paths, T.StructType([T.StructField("paths", T.ArrayType(S.PATH))]))
    rows = docs.select("file", F.posexplode("paths").alias("path_id", "p")).select("file", "path_id", "p.*")
    return rows.withColumns(
        {
            "points": _need("points", "centerline"), "radius": _need("radius", "centerline"),
            "instance_id": _need("instance_id", "centerline"), "smooth": F.coalesce("smooth", F.lit(False)),
        }
    )


def read_structure(spark: SparkSession, paths):
    """(nodes, edges, committed) of beam documents; missing lists are empty."""
    body = T.StructType(
        [T.StructField("nodes", T.ArrayType(S.NODE)), T.StructField("edges", T.ArrayType(S.EDGE)), T.StructField("committed", T.ArrayType(S.EDGE))]
    )
    docs = _docs(spark, paths, body)
    part = lambda name: docs.select("file", F.explode(name).alias("v")).select("file", "v.*")
    return part("nodes"), part("edges"), part("committed")


def read_regions(spark: SparkSession, paths) -> DataFrame:
    docs = _docs(spark, paths, T.StructType([T.StructField("regions", T.ArrayType(S.REGION))]))
    rows = docs.select("file", F.explode("regions").alias("r")).select("file", "r.*")
    return rows.withColumns({"id": _need("id", "region"), "prism": _need("prism", "region"), "status": F.coalesce("status", F.lit("draft"))})


_FRAME = T.StructType(
    [
        T.StructField("file", T.StringType()), T.StructField("position", S.VEC3), T.StructField("target", S.VEC3),
        T.StructField("yaw", T.DoubleType()),
    ]
)


def _manifests(spark: SparkSession, paths) -> DataFrame:
    docs = _docs(spark, paths, T.StructType([T.StructField("frames", T.ArrayType(_FRAME))]))
    return docs.withColumnRenamed("file", "manifest").withColumn("run_id", F.regexp_extract("manifest", r"([^/]+)/[^/]+$", 1))


def read_frames(spark: SparkSession, manifests, images: str, stride: int = 1, max_frames: int = 0, only: str = "") -> DataFrame:
    """Usable frames: sampled per run, then those with an image above 50 kB kept.

    Only file sizes of the images are read, never their bytes.
    """
    rows = _manifests(spark, manifests).select("run_id", F.posexplode("frames").alias("ord", "f")).select("run_id", "ord", "f.*")
    if only:
        rows = rows.filter(F.col("file").contains(only))
    else:
        pos = F.row_number().over(Window.partitionBy("run_id").orderBy("ord")) - 1
        rows = rows.withColumn("_p", pos).filter(F.col("_p") % stride == 0)
        rows = rows.filter(F.col("_p") < stride * max_frames) if max_frames > 0 else rows
        rows = rows.drop("_p")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(images).select("path", "length")
    big = files.filter(F.col("length") > MIN_FRAME_BYTES).select(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("run_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file")
    )
    from ..functions.frames import yaw_target

    return rows.join(big, ["run_id", "file"], "left_semi").withColumn("target", yaw_target("position", "target", F.coalesce("yaw", F.lit(0.0))))


def discover_render_runs(spark: SparkSession, manifests) -> DataFrame:
    """(run_id, n_frames, has_target, modified), newest first."""
    docs = spark.read.schema(T.StructType([T.StructField("frames", T.ArrayType(_FRAME))])).option("multiLine", True).json(manifests)
    return docs.select(
        F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("run_id"),
        F.coalesce(F.size("frames"), F.lit(0)).alias("n_frames"),
        F.coalesce(F.exists("frames", lambda f: f["target"].isNotNull()), F.lit(False)).alias("has_target"),
        F.col("_metadata.file_modification_time").alias("modified"),
    ).orderBy(F.desc("modified"), "run_id")


def class_table(rows: DataFrame) -> DataFrame:
    """Class dimension from (pos, id, name, color, rgb, group, frozen): explicit id else position.

    Duplicate ids are an error; an rgb float list becomes a hex colour.
    """
    hex2 = lambda i: F.lpad(F.hex(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("rgb")[i])) * 255 + 0.5).cast("bigint")), 2, "0")
    out = rows.select(
        F.coalesce("id", "pos").cast("int").alias("id"), "name",
        F.coalesce("color", F.lower(F.concat(F.lit("#"), hex2(0), hex2(1), hex2(2)))).alias("color"),
        "group", F.coalesce("frozen", F.lit(False)).alias("frozen"),
    )
    twice = out.groupBy("id").count().filter("count > 1")
    if not twice.isEmpty():
        raise ValueError("duplicate class ids")
    return out


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    item = "struct<id:int,name:string,color:string,rgb:array<double>,`group`:string,frozen:boolean>"
    docs = spark.read.schema(f"classes array<{item}>").option("multiLine", True).json(path)
    return class_table(docs.select(F.posexplode("classes").alias("pos", "c")).select("pos", "c.*"))


_REGISTRY = "file string, pos int, id int, name string, label string, color string, rgb array<double>, hotkey string, `group` string, frozen boolean"
# Fixed value: the colour of a class that names none.
CLASS_COLOR = "#5b8def"


def _registry_rows(batches):
    """One row per entry of the mapping ``classes`` of each YAML text (needs PyYAML on the workers)."""
    import pandas as pd
    import yaml

    text = lambda v: None if v is None else str(v)
    for batch in batches:
        out = []
        for file, value in zip(batch["file"], batch["value"]):
            for pos, (name, body) in enumerate(((yaml.safe_load(value) or {}).get("classes") or {}).items()):
                body = body if isinstance(body, dict) else {}
                color = body.get("color")
                rgb = [float(c) for c in color[:3]] if isinstance(color, list) else None
                number = body.get("id")
                out.append((file, pos, None if number is None else int(number), str(name), text(body.get("label")), None if rgb else text(color), rgb, text(body.get("key", body.get("hotkey"))), text(body.get("group")), bool(body.get("frozen", False))))
        frame = pd.DataFrame(out, columns=["file", "pos", "id", "name", "label", "color", "rgb", "hotkey", "group", "frozen"])
        yield frame.astype({"id": "Int32"})


def read_class_registry(spark: SparkSession, paths) -> DataFrame:
    """(file, id, name, label, color, hotkey, group, frozen) of YAML registries: a mapping ``classes`` from name to body.

    The explicit id counts, else the place in the mapping; an id given twice in one file is an error.  Without a label the
    name is capitalised, without a key the place from 1 is taken; a colour is text or three parts of 1.  Empty files and
    files without ``classes`` have no rows.
    """
    texts = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = texts.mapInPandas(_registry_rows, _REGISTRY)
    hex2 = lambda i: F.lpad(F.hex(F.bround(F.col("rgb")[i] * 255).cast("bigint")), 2, "0")
    number = F.coalesce("id", "pos")
    twice = F.count("*").over(Window.partitionBy("file", number)) > 1
    checked = F.when(twice, F.raise_error(F.concat(F.lit("duplicate class id in "), F.col("file"))).cast("int")).otherwise(number)
    return rows.select(
        "file", checked.alias("id"), "name", F.coalesce("label", F.initcap("name")).alias("label"),
        F.coalesce("color", F.lower(F.concat(F.lit("#"), hex2(0), hex2(1), hex2(2))), F.lit(CLASS_COLOR)).alias("color"),
        F.coalesce("hotkey", (F.col("pos") + 1).cast("string")).alias("hotkey"), F.coalesce("group", F.lit("")).alias("group"), "frozen",
    )


_SCAN_META = "scan_name string, n_points bigint, schema_version string, source_mesh string, source_laz string, class_map_version int"


def scan_catalog(spark: SparkSession, meta_files: str, legacy_files: str | None = None) -> DataFrame:
    """Annotated scans with valid metadata plus legacy meshes (glb before ply), by tier and name."""
    docs = spark.read.schema(_SCAN_META).option("multiLine", True).json(meta_files)
    name = F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1)
    ann = docs.select(name.alias("name"), F.regexp_extract("_metadata.file_path", r"^(.*)/[^/]+$", 1).alias("path"), F.lit("ply").alias("format"), "n_points", "schema_version")
    ann = ann.filter(F.col("n_points").isNotNull() & F.split("schema_version", r"\.")[0].isin("2", "3")).drop("schema_version")
    out = ann.select(F.lit("annotated").alias("tier"), F.lit(1).alias("tier_rank"), "*")
    if legacy_files:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(legacy_files).select("path")
        files = files.select("path", F.regexp_extract("path", r"([^/]+)\.(glb|ply)$", 1).alias("name"), F.regexp_extract("path", r"\.(glb|ply)$", 1).alias("format")).filter("format <> ''")
        best = files.groupBy("name").agg(F.min_by(F.struct("path", "format"), "format").alias("b"))
        out = out.unionByName(best.select(F.lit("legacy").alias("tier"), F.lit(0).alias("tier_rank"), "name", "b.path", "b.format", F.lit(None).cast("bigint").alias("n_points")))
    return out.orderBy("tier_rank", F.lower("name"))


def resolve_scan(catalog: DataFrame, scan: str) -> DataFrame:
    """The one row of ``tier/name`` or of a bare name, the legacy tier first."""
    tier, _, name = scan.rpartition("/")
    hit = F.col("name") == name
    if tier:
        hit = hit & (F.col("tier") == tier)
    return catalog.filter(hit).orderBy("tier_rank").limit(1)


def resolve_raw_source(scans: DataFrame, raw_files: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds raw_path: a file of that basename under raw/, the archive-relative path, else the lineage root."""
    base = raw_files.groupBy(F.regexp_extract("path", r"([^/]+)$", 1).alias("_base")).agg(F.min("path").alias("_by_name"))
    rel = raw_files.select(F.col("path").alias("_rel"), F.col("path").alias("_by_path"))
    reg = registry.select(F.col("source_id").alias("root_source_id"), F.col("path").alias("_by_root"))
    out = scans.withColumn("_base", F.regexp_extract("source_path", r"([^/]+)$", 1))
    out = out.join(base, "_base", "left").join(rel, out["source_path"] == rel["_rel"], "left").join(reg, "root_source_id", "left")
    return out.withColumn("raw_path", F.coalesce("_by_name", "_by_path", "_by_root")).drop("_base", "_by_name", "_rel", "_by_path", "_by_root")


def variants_index(scans: DataFrame, runs: DataFrame) -> DataFrame:
    """(scan_id, variants): the labelling variant, then distinct render variants, first seen wins."""
    own = scans.select("scan_id", "variant_id", F.lit("labeling").alias("role"), F.lit(-1).alias("ord"))
    other = runs.select("scan_id", F.col("source_variant").alias("variant_id"), F.lit("render_source").alias("role"), "ord").filter("variant_id IS NOT NULL")
    first = own.unionByName(other).groupBy("scan_id", "variant_id").agg(F.min_by(F.struct("ord", "role"), "ord").alias("f"))
    packed = first.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("f.ord", "variant_id", "f.role"))).alias("v"))
    return packed.select("scan_id", F.transform("v", lambda s: F.struct(s["variant_id"].alias("variant_id"), s["role"].alias("role"))).alias("variants"))
