"""Checks yielding (rule, scan_id, key, n_bad, message) rows, and the region gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CATEGORIES, GATE_MAX_P90, GATE_MAX_REVIEW, GATE_MIN_P50, GATE_MIN_POINTS, REVIEW, UNSET, seg_key
from ..session import small

KEY = ["scan_id", "point_id"]


def _rows(df: DataFrame, rule: str, key: Column, n_bad: Column, message: str) -> DataFrame:
    return df.select(
        F.lit(rule).alias("rule"), "scan_id", key.cast("string").alias("key"), n_bad.cast("bigint").alias("n_bad"), F.lit(message).alias("message")
    )


def _count(bad: DataFrame, rule: str, message: str, key: str | None = None) -> DataFrame:
    keys = ["scan_id"] + ([key] if key else [])
    return _rows(bad.groupBy(*keys).agg(F.count("*").alias("_n")), rule, F.col(key) if key else F.lit(""), F.col("_n"), message)


def enforce(*checks: DataFrame) -> None:
    """Raise with the first messages when any check has rows."""
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    rules = out.groupBy("rule", "message").agg(F.count("*").alias("n"), F.sum("n_bad").alias("n_bad"), F.min("key").alias("key")).orderBy("rule").collect()
    if rules:
        raise ValueError("; ".join(f"{r.rule}[{r.key}, {r.n} in all]: {r.message} ({r.n_bad})" for r in rules))


def class_iff_instance(labels: DataFrame) -> DataFrame:
    return _count(labels.filter((F.col("class_id") == UNSET) != (F.col("instance_id") == UNSET)), "VAL1", "class and instance disagree on unlabeled")


def one_class_per_instance(labels: DataFrame) -> DataFrame:
    mixed = labels.filter("instance_id >= 0").groupBy("scan_id", "instance_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b"), F.count("*").alias("n"))
    return _rows(mixed.filter("a <> b"), "VAL2", F.col("instance_id"), F.col("n"), "instance has several classes")


def classes_registered(labels: DataFrame, classes: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    used = labels.filter("class_id >= 0").groupBy("scan_id", "class_id").agg(F.count("*").alias("n"))
    miss = used.join(small(classes.select(F.col("id").alias("class_id"))), "class_id", "left_anti")
    out = _rows(miss, "VAL3", F.col("class_id"), F.col("n"), "class is not registered")
    if meta is not None:
        stale = meta.filter(F.col("class_map_version").isNotNull() & F.col("registry_version").isNotNull() & (F.col("class_map_version") != F.col("registry_version")))
        out = out.unionByName(_rows(stale, "VAL3", F.col("class_map_version"), F.lit(1), "registry version differs"))
    return out


def counts_match(points: DataFrame, labels: DataFrame, meta: DataFrame) -> DataFrame:
    n = points.groupBy("scan_id").agg(F.count("*").alias("n"))
    off = meta.select("scan_id", "n_points").join(n, "scan_id", "left").filter(~F.col("n_points").eqNullSafe(F.col("n")))
    gap = points.select(*KEY, F.lit(1).alias("a")).join(labels.select(*KEY, F.lit(1).alias("b")), KEY, "full").filter("a IS NULL OR b IS NULL")
    return _rows(off, "VAL4", F.col("n_points"), F.coalesce("n", F.lit(0)), "row count differs from metadata").unionByName(
        _count(gap, "VAL4", "labels do not cover the points")
    )


def category_exhaustive(in_region: DataFrame) -> DataFrame:
    ok = F.coalesce(F.col("category").isin(list(CATEGORIES.values())), F.lit(False))
    return _count(in_region.filter(~ok), "VAL5", "invalid category in a region")


def review_budget(in_region: DataFrame, budget: float = 0.03) -> DataFrame:
    share = in_region.groupBy("scan_id").agg(F.count("*").alias("n"), F.count_if(F.col("category") == REVIEW).alias("r"))
    return _rows(share.filter(F.col("r") > budget * F.col("n")), "VAL6", F.lit(""), F.col("r"), "review share over budget")


def instance_docs(labels: DataFrame, instances: DataFrame, blobs: DataFrame) -> DataFrame:
    ids = labels.filter("instance_id >= 0 AND class_id >= 0").groupBy("scan_id", "instance_id").agg(F.count("*").alias("n"))
    doc = instances.filter("class_id IS NOT NULL").withColumn("instance_id", F.col("segId")).select(*seg_key(instances)).distinct()
    out = _rows(ids.join(small(doc), seg_key(doc), "left_anti"), "VAL7", F.col("instance_id"), F.col("n"), "labelled instance has no classed row")
    have = labels.groupBy("scan_id").agg(F.count_if((F.col("category") == REVIEW) & (F.col("instance_id") >= 0)).alias("n"))
    want = blobs.groupBy("scan_id").agg(F.sum("n_points").alias("m"))
    off = have.join(want, "scan_id", "left").filter(F.col("n") != F.coalesce("m", F.lit(0)))
    out = out.unionByName(_rows(off, "VAL7", F.col("n"), F.abs(F.col("n") - F.coalesce("m", F.lit(0))), "review points differ from blob total"))
    classed = blobs.join(small(doc), seg_key(doc), "left_semi")
    return out.unionByName(_rows(classed, "VAL7", F.col("instance_id"), F.col("n_points"), "review blob row has a class"))


def no_frozen_class(labels: DataFrame, classes: DataFrame) -> DataFrame:
    frozen = small(classes.filter("frozen").select(F.col("id").alias("class_id")))
    return _count(labels.join(frozen, "class_id", "left_semi"), "VAL8", "frozen class in use", "class_id")


def frozen_assignment(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rejected assignment rows of frozen classes (must be empty)."""
    frozen = small(classes.filter("frozen").select(F.col("id").alias("class_id")))
    return rows.join(frozen, "class_id", "left_semi")


def component_iff_instance(labels: DataFrame) -> DataFrame:
    return _count(labels.filter((F.col("instance_id") >= 0) != (F.col("component_id") >= 0)), "VAL9", "instance and component disagree")


def manifest_drift(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    both = stored.select("scan_id", F.col("manifest").alias("a")).join(rebuilt.select("scan_id", F.col("manifest").alias("b")), "scan_id", "full")
    return _rows(both.filter(~F.col("a").eqNullSafe(F.col("b"))), "VAL10", F.lit(""), F.lit(1), "manifest differs from labels")


def ids_kept(prior: DataFrame, current: DataFrame) -> DataFrame:
    gone = prior.select("scan_id", "instance_id").distinct().join(current.select("scan_id", "instance_id").distinct(), ["scan_id", "instance_id"], "left_anti")
    return _rows(gone, "VAL11", F.col("instance_id"), F.lit(1), "instance id lost")


def regions_fine_enough(regions: DataFrame, limit: float = GATE_MAX_P90) -> DataFrame:
    bad = regions.filter((F.col("status") == "eval_grade") & (F.coalesce("p90", F.lit(float("inf"))) > limit))
    return _rows(bad, "VAL12", F.col("id"), F.lit(1), "eval-grade region is too coarse")


def confirmed_clean(labels: DataFrame, instances: DataFrame) -> DataFrame:
    sure = instances.filter("confirmed").withColumn("instance_id", F.col("segId")).select(*seg_key(instances), F.col("class_id").alias("doc_class"))
    rows = labels.join(small(sure), seg_key(sure))
    bad = rows.filter(F.col("doc_class").isNull() | (F.col("category") != 0))
    return _count(bad, "VAL13", "confirmed instance is class-less or marked", "instance_id")


def region_gate(measured: DataFrame) -> DataFrame:
    """Adds status and the first failing reason.

    ``measured`` = (id, status, raw_available, n_points, p50, p90, n_review,
    n_session).  The point floor comes first, since an empty region measures 0.
    """
    frac = F.col("n_review") / F.greatest("n_session", F.lit(1))
    reason = (
        F.when(F.col("status") == "eval_grade", F.lit(None))
        .when(~F.col("raw_available"), "no raw source")
        .when(F.col("n_points") < GATE_MIN_POINTS, "too few raw points")
        .when(F.col("p50") <= GATE_MIN_P50, "coincident points")
        .when(F.col("p90") > GATE_MAX_P90, "spacing too coarse")
        .when(frac > GATE_MAX_REVIEW, "review share over budget")
    )
    return measured.withColumn("reason", reason).withColumn("new_status", F.when(F.col("reason").isNull(), "eval_grade").otherwise(F.col("status")))


def valid_prisms(regions: DataFrame) -> DataFrame:
    bad = (F.size("polygon") < 3) | ~(F.col("height") > 0)
    return _rows(regions.filter(bad), "VAL15", F.col("id"), F.lit(1), "prism needs three vertices and a positive height")


def edit_regions(regions: DataFrame, edits: DataFrame) -> DataFrame:
    """Create, rename, set_geometry, delete and draft edits applied by id.

    Locked (eval_grade) regions refuse geometry, rename and delete; an unknown
    id, an empty name or a broken prism is an error.
    """
    op = F.col("op")
    cur = regions.select("id", "name", "status", "polygon", "y0", "height").withColumn("_have", F.lit(True))
    new = edits.select("id", "op", *[F.col(c).alias(f"n_{c}") for c in ("name", "polygon", "y0", "height")])
    both = cur.join(small(new), "id", "full")
    stop = lambda m: F.raise_error(F.concat(F.lit(m + ": "), F.col("id"))).cast("boolean")
    bad_prism = op.isin("create", "set_geometry") & (F.coalesce(F.size("n_polygon") < 3, F.lit(True)) | ~F.coalesce(F.col("n_height") > 0, F.lit(False)))
    guard = (
        F.when(op.isNull(), True)
        .when((op != "create") & F.col("_have").isNull(), stop("unknown region"))
        .when(op.isin("rename", "set_geometry", "delete") & (F.col("status") == "eval_grade"), stop("region is locked"))
        .when((op == "rename") & (F.coalesce(F.trim("n_name"), F.lit("")) == ""), stop("empty name"))
        .when(bad_prism, stop("broken prism")).otherwise(True)
    )
    geo = op.isin("create", "set_geometry")
    out = both.filter(guard).filter(op.isNull() | (op != "delete"))
    return out.select(
        "id", F.when(op.isin("create", "rename"), F.col("n_name")).otherwise(F.col("name")).alias("name"),
        F.when(op.isin("create", "draft"), "draft").otherwise(F.col("status")).alias("status"),
        *[F.when(geo, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in ("polygon", "y0", "height")],
    )


def lint_scans(scans: DataFrame) -> DataFrame:
    """Metadata findings with level: version, required fields, frame and derivation."""
    major = F.split("schema_version", r"\.")[0].try_cast("int")
    found = F.array_compact(
        F.array(
            F.when(major.isNull() | ~major.isin(2, 3), F.struct(F.lit("error").alias("level"), F.lit("unsupported schema version").alias("message"))),
            F.when(F.col("scan_name").isNull(), F.struct(F.lit("error").alias("level"), F.lit("scan_name is missing").alias("message"))),
            F.when(F.col("n_points").isNull(), F.struct(F.lit("error").alias("level"), F.lit("n_points is missing").alias("message"))),
            F.when(F.col("frame").isNull(), F.struct(F.when(major >= 3, "error").otherwise("warn").alias("level"), F.lit("frame is missing").alias("message"))),
            F.when(F.col("derivation").isNull(), F.struct(F.when(major >= 3, "error").otherwise("warn").alias("level"), F.lit("derivation is missing").alias("message"))),
        )
    )
    return scans.select("scan_id", F.explode(found).alias("f")).select("scan_id", "f.level", "f.message")


def selection_eligibility(rows: DataFrame) -> DataFrame:
    """Adds cut, fit and outlier verdicts: null when allowed, else the reason.

    ``rows`` = (list, selection_size, is_selected, confirmed, class_frozen, review_blob).
    """
    pool, inst = F.col("list").isin("preseg", "sam"), F.col("list") == "instance"
    bad = F.raise_error(F.concat(F.lit("unknown list: "), F.coalesce("list", F.lit("null"))))
    empty, off = F.col("selection_size") <= 0, ~F.col("is_selected")
    cut = F.when(pool & empty, "empty").when(pool, F.lit(None)).when(inst & off, "not-selected").when(
        inst & F.col("confirmed"), "confirmed"
    ).when(inst & F.col("class_frozen"), "frozen-class").when(inst & F.col("review_blob"), "review-blob").when(inst, F.lit(None)).otherwise(bad)
    fit = F.when(pool & empty, "empty").when(pool, F.lit(None)).when(inst & off, "not-selected").when(inst, F.lit(None)).otherwise(bad)
    sam = F.col("list") == "sam"
    out = F.when(sam & empty, "empty").when(sam & (F.col("selection_size") > 1), "multi").when(sam, F.lit(None)).when(
        inst & off, "not-selected"
    ).when(inst & F.col("confirmed"), "confirmed").when(inst, F.lit(None)).when(F.col("list") == "preseg", "unsupported").otherwise(bad)
    return rows.withColumns({"cut_reason": cut, "fit_reason": fit, "outlier_reason": out})


def verify_pins(sessions: DataFrame, presegs: DataFrame, source: DataFrame) -> DataFrame:
    """(session_id, mismatch): 'source', 'preseg' or null."""
    cur = presegs.select("scan_id", "preseg_id", F.col("fingerprint").alias("_fp"))
    rows = sessions.join(small(source.select("scan_id", F.col("fingerprint").alias("_src"))), "scan_id", "left").join(cur, ["scan_id", "preseg_id"], "left")
    pinned = F.coalesce("source_fingerprint", F.lit("")) != ""
    kind = F.when(pinned & ~F.col("source_fingerprint").eqNullSafe(F.col("_src")), "source").when(
        F.col("preseg_id").isNotNull() & (F.col("_fp").isNull() | ~F.col("preseg_fingerprint").eqNullSafe(F.col("_fp"))), "preseg"
    )
    return rows.select("scan_id", "session_id", kind.alias("mismatch"))
