"""PLY output, versioned label saves, preseg and run tables, scaffolded scans."""

from __future__ import annotations

import os
import re
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import instance_color, table_fingerprint
from ..session import cut, small

KEEP = 10


def write_records(df: DataFrame, path: str, dtype: np.dtype, head) -> int:
    """One binary file of ``head(count)`` and a record per row in point_id order; returns the count.

    ``dtype`` names columns of ``df``; a null integer is 0.  Records have a fixed width, so each task writes its own rows
    at their final byte offset on the shared file system.  A retried task writes the same bytes again; nothing passes
    through the driver but the header.
    """
    order, names = ["scan_id", "point_id"], list(dtype.names)
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut(rows.select(*names, F.monotonically_increasing_id().alias("_m")))
    rows = rows.withColumns({"_part": F.shiftright("_m", 33), "_off": F.col("_m").bitwiseAND(F.lit(2**33 - 1))})
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("_part", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    total = base.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    head = head(total)
    with open(path, "wb") as f:
        f.write(head)
        f.truncate(len(head) + total * dtype.itemsize)

    def emit(batches):
        fd = os.open(path, os.O_WRONLY)
        try:
            for b in batches:
                at = b.column("_g").to_numpy()
                rec = np.zeros(len(at), dtype=dtype)
                for n in names:
                    rec[n] = b.column(n).to_numpy(zero_copy_only=False)
                by = np.argsort(at, kind="stable")
                at, rec = at[by], rec[by]
                for run in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) != 1) + 1):
                    if len(run):
                        os.pwrite(fd, rec[run].tobytes(), len(head) + int(at[run[0]]) * dtype.itemsize)
        finally:
            os.close(fd)
        return iter(())

    seated = rows.join(small(base.drop("_n")), "_part").withColumn("_g", F.col("_base") + F.col("_off"))
    exact = {n: F.col(n).cast("float") if dtype[n].kind == "f" else F.coalesce(F.col(n), F.lit(0)).cast("int") for n in names}
    seated.select("_g", *[c.alias(n) for n, c in exact.items()]).mapInArrow(emit, "_g bigint").write.format("noop").mode("overwrite").save()
    return total


def write_ply(df: DataFrame, path: str, extra: tuple[tuple[str, str], ...] = ()) -> int:
    """One binary PLY in point_id order; returns the vertex count."""
    has_rgb = {"r", "g", "b"} <= set(df.columns)
    fields = [("x", "<f4"), ("y", "<f4"), ("z", "<f4")]
    fields += [("r", "u1"), ("g", "u1"), ("b", "u1")] if has_rgb else []
    fields += [(n, {"int": "<i4", "float": "<f4", "uchar": "u1"}[t]) for n, t in extra]
    names = {"r": "red", "g": "green", "b": "blue"}
    kinds = {"<f4": "float", "u1": "uchar", "<i4": "int"}

    def head(total: int) -> bytes:
        lines = ["ply", "format binary_little_endian 1.0", f"element vertex {total}"]
        lines += [f"property {kinds[t]} {names.get(n, n)}" for n, t in fields] + ["end_header", ""]
        return "\n".join(lines).encode("ascii")

    return write_records(df, path, np.dtype(fields), head)


def write_parts(df: DataFrame, path: str, append: bool = False) -> int:
    """A folder of whole PLY files with an index, on any file system, in (scan_id, point_id) order; returns the count.

    ``plyparts`` says what becomes of the columns.  Many scans may be written at once; each file holds one.
    """
    from . import fixedwidth
    from .plyparts import listed

    fixedwidth.register(df.sparkSession)
    order = ["scan_id", "point_id"]
    had = sum(e["rows"] for e in listed(path) or []) if append else 0
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.format("ply").mode("append" if append else "overwrite").save(path)
    return sum(e["rows"] for e in listed(path)) - had


def labeled_rows(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Points with xyz, rgb (zeros when absent), class_id and instance_id."""
    rgb = {c: F.coalesce(F.col(c), F.lit(0)) if c in points.columns else F.lit(0) for c in "rgb"}
    rows = points.withColumns(rgb).join(labels.select("scan_id", "point_id", "class_id", "instance_id"), ["scan_id", "point_id"])
    return rows.select("scan_id", "point_id", "x", "y", "z", *"rgb", "class_id", "instance_id")


def write_labeled_ply(points: DataFrame, labels: DataFrame, path: str) -> int:
    """xyz, rgb (zeros when absent), class_id and instance_id in one file."""
    return write_ply(labeled_rows(points, labels), path, (("class_id", "int"), ("instance_id", "int")))


def colored_rows(points: DataFrame, ids: DataFrame) -> DataFrame:
    """Points coloured by a hash of their instance; unassigned ones grey."""
    rows = points.select("scan_id", "point_id", "x", "y", "z").join(ids.select("scan_id", "point_id", "instance_id"), ["scan_id", "point_id"])
    colour = {c: v.cast("int") for c, v in instance_color("instance_id").items()}
    return rows.withColumns(colour).select("scan_id", "point_id", "x", "y", "z", *"rgb")


def write_colored_ply(points: DataFrame, ids: DataFrame, path: str) -> int:
    """``colored_rows`` as a folder of PLY files."""
    return write_parts(colored_rows(points, ids), path)


def class_colors(points: DataFrame, palette: DataFrame) -> DataFrame:
    """Palette colour faded to grey by (1 - confidence)."""
    fade = lambda c: F.floor(F.coalesce(F.col(f"p{c}"), F.lit(60)) * F.col("confidence") + 60 * (1 - F.col("confidence"))).cast("int")
    pal = palette.select("class_id", *[F.col(c).alias(f"p{c}") for c in "rgb"])
    return points.join(small(pal), "class_id", "left").withColumns({c: fade(c) for c in "rgb"}).drop("pr", "pg", "pb")


def _stamp() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def current_version(spark: SparkSession, root: str) -> str | None:
    fs, p = _fs(spark, f"{root}/pointer")
    if not fs.exists(p):
        return None
    rows = spark.read.schema("version string, commit bigint").json(f"{root}/pointer")
    return rows.agg(F.max_by("version", F.struct("commit", "version"))).first()[0]


def _commits(spark: SparkSession, root: str) -> dict[str, int]:
    """Latest commit number of each version; a few rows, one per save."""
    fs, p = _fs(spark, f"{root}/pointer")
    if not fs.exists(p):
        return {}
    rows = spark.read.schema("version string, commit bigint").json(f"{root}/pointer").groupBy("version").agg(F.max(F.coalesce("commit", F.lit(0))).alias("commit"))
    return {r["version"]: r["commit"] for r in rows.collect()}


def save_labels(labels: DataFrame, root: str, manifest: DataFrame | None = None, checks: list[DataFrame] = (), version: str | None = None, keep: int = KEEP, again: bool = False) -> str:
    """Checked write of a new version; the pointer row is appended last, then old versions go.

    Pointer rows are numbered by commit, so the latest save is current whatever its version is called; ``again`` lets a
    repeated epoch overwrite its own version.

    A reader sees the former version until the pointer names the new one.
    """
    from ..operators.quality import enforce

    if checks:
        enforce(*checks)
    spark = labels.sparkSession
    version = version or _stamp()
    mode = "overwrite" if again else "errorifexists"
    labels.write.mode(mode).parquet(f"{root}/versions/{version}/labels")
    if manifest is not None:
        manifest.write.mode(mode).parquet(f"{root}/versions/{version}/manifest")
    commits = _commits(spark, root)
    commit = max(commits.values(), default=0) + 1
    spark.createDataFrame([(version, commit)], "version string, commit bigint").coalesce(1).write.mode("append").json(f"{root}/pointer")
    commits[version] = commit
    fs, p = _fs(spark, f"{root}/versions")
    names = sorted((s.getPath().getName() for s in fs.listStatus(p)), key=lambda n: (commits.get(n, 0), n), reverse=True)
    for old in [n for n in names if re.fullmatch(r"\d{8}_\d{6}|auto_\d+", n)][keep + 1:]:
        fs.delete(_fs(spark, f"{root}/versions/{old}")[1], True)
    return version


def load_labels(spark: SparkSession, root: str) -> DataFrame:
    version = current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"no saved labels under {root}")
    return spark.read.parquet(f"{root}/versions/{version}/labels")


def save_pipeline(
    points: DataFrame, labels: DataFrame, classes: DataFrame, root: str, link_radius: float = 0.05, prior: DataFrame | None = None, version: str | None = None,
    instances: DataFrame | None = None, blobs: DataFrame | None = None, meta: DataFrame | None = None, regions: DataFrame | None = None,
    region_points: DataFrame | None = None, thresholds: dict | None = None, stored: DataFrame | None = None,
):
    """Strip, derive fragments, check, write; returns (version, one-row strip count).

    The label rules always run.  Row counts need ``meta``, instance rows need ``instances`` (and ``blobs``), the grade of
    regions ``regions``, category and review rules ``region_points`` (scan_id, point_id, shape_id: what lies in which
    region), lost ids ``prior``, and drift the manifest ``stored`` before; rules without their table are left out.  The
    manifest counts every region of ``region_points``.
    """
    from ..operators import quality as q
    from ..operators.cluster import components
    from ..operators.export import label_manifest
    from ..operators.labels import strip_unclassified

    key = ["scan_id", "point_id"]
    out, stripped = strip_unclassified(labels)
    comp = components(points, out, link_radius).select(*key, "component_id")
    out = cut(out.join(comp, key))
    checks = [
        q.class_iff_instance(out), q.one_class_per_instance(out), q.classes_registered(out, classes, meta if meta is not None and "class_map_version" in meta.columns else None),
        q.no_frozen_class(out, classes), q.component_iff_instance(out),
    ]
    if meta is not None:
        checks.append(q.counts_match(points, out, meta))
    if region_points is not None:
        inside = out.join(region_points.select(*key).distinct(), key, "left_semi")
        checks += [q.category_exhaustive(inside), q.review_budget(inside)]
    if instances is not None:
        checks.append(q.confirmed_clean(out, instances))
        if blobs is not None:
            checks.append(q.instance_docs(out, instances, blobs))
    if regions is not None:
        checks.append(q.regions_fine_enough(regions))
    if prior is not None:
        checks.append(q.ids_kept(prior.filter("instance_id >= 0"), out))
    held = region_points if region_points is not None else out.select(*key, F.lit("").alias("shape_id")).limit(0)
    manifest = cut(label_manifest(out.select(*key, "class_id", "category"), held, thresholds or {}))
    if stored is not None:
        rows = F.array_sort(F.collect_list(F.struct("section", "key", "value")))
        checks.append(q.manifest_drift(*(m.agg(F.to_json(rows).alias("manifest")).select(F.lit("").alias("scan_id"), "manifest") for m in (stored, manifest))))
    return save_labels(out, root, manifest, checks, version), stripped


def register_preseg(segments: DataFrame, root: str, preseg_id: str, generator: str, params: dict | None = None) -> DataFrame:
    """Writes one preseg result and its metadata row; returns the row."""
    if not re.fullmatch(r"[a-z0-9_-]+", preseg_id):
        raise ValueError(f"bad preseg id: {preseg_id!r}")
    body = segments.select("scan_id", "point_id", "instance_id")
    spark = segments.sparkSession
    body.write.mode("overwrite").parquet(f"{root}/presegs/preseg_id={preseg_id}")
    stored = spark.read.parquet(f"{root}/presegs/preseg_id={preseg_id}")
    n = stored.groupBy("scan_id").agg(F.count_distinct(F.when(F.col("instance_id") >= 0, F.col("instance_id"))).alias("n_segments"))
    pairs = [F.lit(str(v)) for kv in (params or {}).items() for v in kv]
    meta = table_fingerprint(stored, ["instance_id"]).join(n, "scan_id").select(
        "scan_id", F.lit(preseg_id).alias("preseg_id"), F.lit(generator).alias("generator"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("params"),
        "fingerprint", "n_segments", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
    )
    meta = cut(meta)
    meta.write.mode("append").parquet(f"{root}/preseg_meta")
    return meta


def list_presegs(spark: SparkSession, root: str) -> DataFrame:
    """Latest metadata row per preseg; a row without its required keys is an error."""
    meta = spark.read.parquet(f"{root}/preseg_meta")
    need = lambda c: F.coalesce(F.col(c).cast("string"), F.raise_error(F.lit(f"preseg metadata lacks {c}")).cast("string"))
    checked = meta.withColumns({c: need(c) for c in ("preseg_id", "generator", "fingerprint")})
    latest = checked.groupBy("scan_id", "preseg_id").agg(F.max_by(F.struct(*checked.columns), "created_at").alias("m"))
    return latest.select("m.*").orderBy("scan_id", "preseg_id")


def write_run(run: DataFrame, root: str, run_id: str) -> None:
    """Per-point (class_id, segment_id) of one run, in its own partition."""
    run.select("scan_id", "point_id", "class_id", "segment_id").write.mode("overwrite").parquet(f"{root}/runs/run_id={run_id}")


def read_run(spark: SparkSession, root: str, run_id: str | None = None) -> DataFrame:
    runs = spark.read.option("basePath", f"{root}/runs").parquet(f"{root}/runs")
    return runs if run_id is None else runs.filter(F.col("run_id") == run_id)


def runs_index(spark: SparkSession, root: str, default_run: str | None = None) -> DataFrame:
    """(run_id, n_points, is_default); the first run is the default when none is named."""
    runs = read_run(spark, root).groupBy("run_id").agg(F.count("*").alias("n_points"))
    first = runs.agg(F.min("run_id").alias("_d"))
    return runs.join(F.broadcast(first), how="cross").select(
        "run_id", "n_points", (F.col("run_id") == F.coalesce(F.lit(default_run), F.col("_d"))).alias("is_default")
    ).orderBy("run_id")


def scaffold_scan(raw: DataFrame, target: int) -> tuple[DataFrame, DataFrame]:
    """(points near the target count, metadata row) from a raw cloud.

    Offsets are whole metres and used only where the largest |mean| exceeds
    1000; 16-bit colours keep their high byte.
    """
    from ..functions.values import rgb16_to_8
    from ..operators.sampling import voxel_downsample_to_target

    thin = cut(voxel_downsample_to_target(raw, target, exact=True))
    mean = thin.groupBy("scan_id").agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"], F.count("*").alias("n_points"))
    far = F.greatest(*[F.abs(f"m{a}") for a in "xyz"]) > 1000
    meta = cut(mean.select("scan_id", "n_points", *[F.when(far, F.round(f"m{a}")).otherwise(0.0).alias(f"o{a}") for a in "xyz"]))
    moved = thin.join(small(meta), "scan_id").withColumns({a: F.col(a) - F.col(f"o{a}") for a in "xyz"})
    moved = moved.drop("ox", "oy", "oz", "n_points", "vx", "vy", "vz")
    return (rgb16_to_8(moved) if {"r", "g", "b"} <= set(moved.columns) else moved), meta


def export_bundle(points: DataFrame, labels: DataFrame, manifest: DataFrame, path: str, hulls: DataFrame | None = None) -> int:
    """Labelled points as a folder of PLY files, a manifest and, where given, hull meshes; returns the number of points.

    The manifest is written last: a bundle without one is not complete.  Any file system will do.
    """
    n = write_parts(labeled_rows(points, labels), f"{path}/points")
    if hulls is not None:
        hulls.write.mode("overwrite").parquet(f"{path}/hulls")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return n
