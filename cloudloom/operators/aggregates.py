"""Summaries, comparisons, run merging and boxes over label tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BOX_FLOOR, CATEGORIES, FIT_PAD, MIN_SEGMENT_POINTS, REVIEW, UNSET, seg_key
from ..session import small

KEY = ["scan_id", "point_id"]
SEG = ["scan_id", "instance_id"]


def label_join(points: DataFrame, labels: DataFrame, check: bool = True) -> DataFrame:
    """Points with their labels; tables that do not cover each other are an error."""
    if not check:
        return points.join(labels, KEY)
    both = points.withColumn("_a", F.lit(1)).join(labels.withColumn("_b", F.lit(1)), KEY, "full")
    gap = F.raise_error(F.lit("points and labels do not cover the same ids"))
    return both.withColumn("_a", F.when(F.col("_a").isNull() | F.col("_b").isNull(), gap.cast("int")).otherwise(1)).filter("_a = 1").drop("_a", "_b")


def segment_class_join(instances: DataFrame, summary: DataFrame) -> DataFrame:
    """Adds class_id from segment rows {id, class_id}; unknown ids give -1; beyond int8 is an error."""
    cls = F.col("class_id")
    checked = F.when(cls.between(-128, 127), cls).otherwise(F.raise_error(F.lit("class id outside int8")).cast("int"))
    table = summary.withColumn("instance_id", F.col("id")).select(*seg_key(summary), checked.cast("int").alias("class_id"))
    return instances.join(small(table), seg_key(table), "left").withColumn(
        "class_id", F.coalesce("class_id", F.lit(UNSET))
    )


def segment_summary(labels: DataFrame) -> DataFrame:
    return labels.filter(F.col("instance_id") >= 0).groupBy(*SEG).agg(
        F.min_by("class_id", "point_id").alias("class_id"), F.count("*").alias("n_points")
    )


def segment_metadata(points: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """Per segment: class, label where registered, size and bounds."""
    ends = [f(a).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in "xyz"]
    rows = points.select(*KEY, "x", "y", "z").join(labels.filter(F.col("instance_id") >= 0), KEY)
    segs = rows.groupBy(*SEG).agg(F.min_by("class_id", "point_id").alias("class_id"), F.count("*").alias("n_points"), *ends)
    names = small(classes.select(F.col("id").alias("class_id"), F.col("name").alias("label")))
    return segs.join(names, "class_id", "left").select(
        "scan_id", F.col("instance_id").alias("gt_id"), "class_id", "n_points", "label",
        *[f"{n}_{a}" for n in ("min", "max") for a in "xyz"],
    )


def label_totals(labels: DataFrame, version: int = 1) -> DataFrame:
    return labels.groupBy("scan_id").agg(
        F.count("*").alias("n_points"),
        F.count_distinct(F.when(F.col("instance_id") >= 0, F.col("instance_id"))).alias("n_segments"),
        F.count_if(F.col("class_id") >= 0).alias("n_labeled"),
        F.lit(version).alias("registry_version"),
    )


def segment_boxes(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Centre and size per instance, sides at least 0.01."""
    rows = points.select(*KEY, "x", "y", "z").join(labels.filter(F.col("instance_id") >= 0).select(*KEY, "instance_id"), KEY)
    out = [((F.min(a) + F.max(a)) / 2.0).alias(f"c{a}") for a in "xyz"]
    out += [F.greatest(F.max(a) - F.min(a), F.lit(BOX_FLOOR)).alias(f"s{a}") for a in "xyz"]
    return rows.groupBy(*SEG).agg(*out)


def category_histogram(labels: DataFrame) -> DataFrame:
    """Counts of all four categories, zeros included."""
    spark = labels.sparkSession
    dims = spark.createDataFrame([(n, c) for n, c in CATEGORIES.items()], "name string, category int")
    counts = labels.groupBy("scan_id", "category").agg(F.count("*").alias("n"))
    frame = labels.select("scan_id").distinct().join(F.broadcast(dims), how="cross")
    return frame.join(counts, ["scan_id", "category"], "left").select(
        "scan_id", "name", "category", F.coalesce("n", F.lit(0)).alias("n_points")
    )


def class_histogram(labels: DataFrame) -> DataFrame:
    return labels.groupBy("scan_id", "class_id").agg(F.count("*").alias("n_points"))


def review_blobs(labels: DataFrame) -> DataFrame:
    hit = (F.col("category") == REVIEW) & (F.col("instance_id") >= 0)
    return labels.filter(hit).groupBy(*SEG).agg(F.count("*").alias("n_points"))


def drop_tiny_segments(labels: DataFrame, min_points: int = MIN_SEGMENT_POINTS) -> DataFrame:
    """Instances under the threshold go back to (-1, -1)."""
    if min_points <= 1:
        return labels
    tiny = (
        labels.filter(F.col("instance_id") >= 0).groupBy(*SEG).count()
        .filter(F.col("count") < min_points).select(*SEG, F.lit(True).alias("_tiny"))
    )
    out = labels.join(small(tiny), SEG, "left")
    cols = {c: F.when(F.col("_tiny"), UNSET).otherwise(F.col(c)) for c in ("class_id", "instance_id")}
    return out.withColumns(cols).select(*labels.columns)


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    """(scan_id, a, b, n): one count per class pair; everything else derives from it."""
    return (
        a.select(*KEY, F.col("class_id").alias("a")).join(b.select(*KEY, F.col("class_id").alias("b")), KEY)
        .groupBy("scan_id", "a", "b").agg(F.count("*").alias("n"))
    )


def _rate(top, bottom):
    return F.when(bottom > 0, top / bottom)


def compare_labelings(pairs: DataFrame) -> DataFrame:
    """Overall counts and agreement from a contingency table."""
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    la, lb = F.col("a") >= 0, F.col("b") >= 0
    same = F.col("a") == F.col("b")
    return pairs.groupBy("scan_id").agg(
        F.sum("n").alias("n"), total(la).alias("labeled_a"), total(lb).alias("labeled_b"),
        total(la & ~lb).alias("missed_b"), total(~la & lb).alias("missed_a"),
        _rate(total(same & (la | lb)), total(la | lb)).alias("agreement"),
        _rate(total(same), F.sum("n")).alias("agreement_all"),
    )


def compare_per_class(pairs: DataFrame) -> DataFrame:
    """IoU, precision and recall per class present on either side; null on empty denominators."""
    sides = F.array(
        F.struct(F.col("a").alias("class_id"), F.lit("a").alias("side")),
        F.struct(F.col("b").alias("class_id"), F.lit("b").alias("side")),
    )
    rows = pairs.select("scan_id", "a", "b", "n", F.explode(sides).alias("s")).filter("s.class_id >= 0")
    pick = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    in_a, in_b = F.col("s.side") == "a", F.col("s.side") == "b"
    out = rows.groupBy("scan_id", F.col("s.class_id").alias("class_id")).agg(
        pick(in_a & (F.col("a") == F.col("b"))).alias("tp"), pick(in_a).alias("n_a"), pick(in_b).alias("n_b"),
        pick(in_a & (F.col("b") < 0)).alias("missed_b"), pick(in_b & (F.col("a") < 0)).alias("missed_a"),
    )
    tp, na, nb = F.col("tp"), F.col("n_a"), F.col("n_b")
    return out.select(
        "scan_id", "class_id", _rate(tp, na + nb - tp).alias("iou"), _rate(tp, nb).alias("precision"),
        _rate(tp, na).alias("recall"), "n_a", "n_b", "missed_a", "missed_b",
    )


def confusion_top(pairs: DataFrame, n: int = 20) -> DataFrame:
    wrong = pairs.filter((F.col("a") >= 0) & (F.col("b") >= 0) & (F.col("a") != F.col("b")))
    return wrong.orderBy(F.desc("n"), "a", "b").limit(n).select("a", "b", F.col("n").alias("count"))


def label_diff_mask(a: DataFrame, b: DataFrame) -> DataFrame:
    """(keys, changed): class or instance differs."""
    right = b.select(*KEY, F.col("class_id").alias("_c"), F.col("instance_id").alias("_i"))
    same = F.col("class_id").eqNullSafe(F.col("_c")) & F.col("instance_id").eqNullSafe(F.col("_i"))
    return a.join(right, KEY).select(*KEY, (~same).alias("changed"))


def region_stats(regions: DataFrame, points: DataFrame, labels: DataFrame):
    """(per region counts, per region and instance overlap); empty regions stay with zeros."""
    from .containment import points_in_prisms

    # Labels join once for each point, not once for each pair of a point and a region.
    marks = ["class_id", "category", "instance_id"]
    hits = points_in_prisms(points.select(*KEY, "x", "y", "z").join(labels.select(*KEY, *marks), KEY), regions, marks)
    counts = hits.groupBy("scan_id", "shape_id").agg(
        F.count("*").alias("n_points"),
        F.count_if(F.col("class_id") < 0).alias("n_unlabeled"),
        F.count_if(F.col("category") == REVIEW).alias("n_review"),
    )
    base = regions.select(*[c for c in ("scan_id", "shape_id") if c in regions.columns])
    keys = base.columns
    stats = base.join(counts, keys, "left").select(
        *keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_points", "n_unlabeled", "n_review")]
    )
    inside = hits.filter(F.col("instance_id") >= 0).groupBy("scan_id", "shape_id", "instance_id").agg(F.count("*").alias("inside"))
    totals = labels.filter(F.col("instance_id") >= 0).groupBy(*SEG).agg(F.count("*").alias("total"))
    return stats, inside.join(totals, SEG)


def region_majority_instances(overlap: DataFrame, instances: DataFrame) -> DataFrame:
    """Confirmed instances with more than half of their points inside."""
    ok = instances.filter("confirmed").withColumn("instance_id", F.col("segId")).select(*seg_key(instances))
    frac = F.col("inside") / F.col("total")
    return (
        overlap.join(small(ok), seg_key(ok), "left_semi").withColumn("fraction", frac).filter(frac > 0.5)
        .orderBy("shape_id", F.desc("fraction"), "instance_id")
    )


def region_percentages(stats: DataFrame) -> DataFrame:
    pct = lambda c: F.when(F.col("n_points") > 0, 100.0 * F.col(c) / F.col("n_points")).otherwise(0.0)
    return stats.withColumns({"unlabeled_pct": pct("n_unlabeled"), "review_pct": pct("n_review")})


def points_after_filters(histogram: DataFrame, include, target: int, scan_count: int) -> DataFrame:
    rows = histogram if include is None else histogram.filter(F.col("class_id").isin(list(include)))
    scale = target / scan_count if scan_count else 0.0
    return rows.agg(F.floor(F.coalesce(F.sum("n_points"), F.lit(0)) * scale + 0.5).cast("bigint").alias("estimate"))


def cluster_size_stats(segments: DataFrame) -> DataFrame:
    sizes = segments.groupBy(*SEG).count()
    return sizes.agg(
        F.min("count").alias("min"), F.percentile("count", F.lit(0.5)).alias("median"),
        F.percentile("count", F.lit(0.95)).alias("p95"), F.max("count").alias("max"),
    )


def hit_histogram(hits: DataFrame) -> DataFrame:
    """Per query: points with at least 1, 2, 3, 5, 10 hits, and the maximum."""
    return hits.groupBy("query").agg(
        *[F.count_if(F.col("hits") >= t).alias(f"ge_{t}") for t in (1, 2, 3, 5, 10)], F.max("hits").alias("max_hits")
    )


def multi_query_points(hits: DataFrame) -> DataFrame:
    per = hits.filter(F.col("hits") > 0).groupBy(*KEY).agg(F.count_distinct("query").alias("q"))
    return per.agg(F.count_if(F.col("q") >= 2).alias("n_multi"))


def fit_aabb(points: DataFrame, low, high, min_points: int = 50) -> DataFrame:
    """One row: bounds snapped to the inside points (+0.005), or the request when too few."""
    from ..functions.shapes import in_aabb

    got = points.filter(in_aabb(low, high)).agg(
        F.count("*").alias("n"), *[f(a).alias(f"{p}{a}") for p, f in (("l", F.min), ("h", F.max)) for a in "xyz"]
    )
    ok = F.col("n") >= min_points
    out = []
    for a, lo, hi in zip("xyz", low, high):
        lo, hi = float(lo), float(hi)
        out.append(F.when(ok, (F.col(f"l{a}") + F.col(f"h{a}")) / 2.0).otherwise((lo + hi) / 2.0).alias(f"c{a}"))
        out.append(F.when(ok, F.col(f"h{a}") - F.col(f"l{a}") + FIT_PAD).otherwise(hi - lo).alias(f"s{a}"))
    return got.select("n", ok.alias("snapped"), *out)


def instance_pca_obb(points: DataFrame, labels: DataFrame, min_points: int = 30, max_extent: float = 25.0, min_dim: float = 0.05) -> DataFrame:
    """Yaw box per instance from the XZ covariance; two plain aggregations."""
    rows = points.select(*KEY, "x", "y", "z").join(labels.filter(F.col("instance_id") >= 0).select(*KEY, "instance_id", "class_id"), KEY)
    x, z = F.col("x"), F.col("z")
    m = rows.groupBy(*SEG).agg(
        F.count("*").alias("n"), F.min_by("class_id", "point_id").alias("class_id"),
        F.avg(x).alias("mx"), F.avg(z).alias("mz"), F.var_pop(x).alias("cxx"), F.var_pop(z).alias("czz"),
        F.covar_pop(x, z).alias("cxz"), F.min("y").alias("y0"), F.max("y").alias("y1"),
        F.greatest(*[F.max(a) - F.min(a) for a in "xyz"]).alias("ext"),
    )
    m = m.filter((F.col("n") >= min_points) & (F.col("ext") <= max_extent) & (F.col("class_id") >= 0))
    m = m.withColumn("alpha", 0.5 * F.atan2(2.0 * F.col("cxz"), F.col("cxx") - F.col("czz")))
    m = m.select(*SEG, "class_id", "n", "mx", "mz", "alpha", "y0", "y1")
    turned = rows.drop("class_id").join(small(m), SEG)
    ca, sa = F.cos("alpha"), F.sin("alpha")
    dx, dz = x - F.col("mx"), z - F.col("mz")
    u, v = dx * ca + dz * sa, dz * ca - dx * sa
    keys = [*SEG, "class_id", "n", "mx", "mz", "alpha", "y0", "y1"]
    box = turned.groupBy(*keys).agg(F.min(u).alias("u0"), F.max(u).alias("u1"), F.min(v).alias("v0"), F.max(v).alias("v1"))
    uc, vc = (F.col("u0") + F.col("u1")) / 2.0, (F.col("v0") + F.col("v1")) / 2.0
    floor = lambda c: F.greatest(c, F.lit(min_dim))
    return box.select(
        *SEG, "class_id", "n", (F.col("mx") + uc * ca - vc * sa).alias("cx"),
        ((F.col("y0") + F.col("y1")) / 2.0).alias("cy"), (F.col("mz") + uc * sa + vc * ca).alias("cz"),
        floor(F.col("u1") - F.col("u0")).alias("sx"), floor(F.col("y1") - F.col("y0")).alias("sy"),
        floor(F.col("v1") - F.col("v0")).alias("sz"), (-F.col("alpha")).alias("ry"),
    )


def component_numbering(components: DataFrame) -> DataFrame:
    """Per instance, components renumbered from 0 by their lowest point id."""
    first = components.groupBy(*SEG, "component").agg(F.min("point_id").alias("_first"))
    rank = F.row_number().over(Window.partitionBy(*SEG).orderBy("_first")) - 1
    number = first.withColumn("component_id", rank)
    big = F.raise_error(F.lit("more than 32768 components in one instance")).cast("int")
    number = number.withColumn("component_id", F.when(F.col("component_id") > 32767, big).otherwise(F.col("component_id")))
    return components.join(number.drop("_first"), [*SEG, "component"]).drop("component")


def merge_runs_priority(runs: DataFrame, order: list[str]) -> DataFrame:
    """First labelled run in priority order wins: (keys, class_id, segment_id, run)."""
    pos = F.array_position(F.array(*[F.lit(o) for o in order]), F.col("run_id"))
    labelled = F.when((F.col("class_id") >= 0) & (pos > 0), pos)
    win = runs.groupBy(*KEY).agg(F.min_by(F.struct("class_id", "segment_id", "run_id"), labelled).alias("w"), F.min(labelled).alias("p"))
    got = F.col("p").isNotNull()
    pick = lambda f: F.when(got, F.col(f"w.{f}"))
    return win.select(
        *KEY, F.coalesce(pick("class_id"), F.lit(UNSET)).alias("class_id"),
        F.coalesce(pick("segment_id"), F.lit(UNSET)).alias("segment_id"),
        F.coalesce(F.col("p") - 1, F.lit(UNSET)).cast("int").alias("run"),
    )


def merge_runs_vote(runs: DataFrame, order: list[str]) -> DataFrame:
    """Majority class; a tie between classes gives -1; segment from the first run holding it."""
    pos = F.array_position(F.array(*[F.lit(o) for o in order]), F.col("run_id"))
    votes = runs.filter(F.col("class_id") >= 0).groupBy(*KEY, "class_id").agg(
        F.count("*").alias("v"), F.min_by("segment_id", pos).alias("segment_id"), (F.min(pos) - 1).alias("run")
    )
    best = votes.groupBy(*KEY).agg(
        F.max("v").alias("top"), F.max_by(F.struct("class_id", "segment_id", "run"), "v").alias("w"),
        F.sort_array(F.collect_list("v"), asc=False).alias("vs"),
    )
    tie = (F.size("vs") > 1) & (F.col("vs")[0] == F.try_element_at("vs", F.lit(2)))
    pick = lambda f: F.when(~tie, F.col(f"w.{f}")).otherwise(F.lit(UNSET))
    won = best.select(*KEY, *[pick(f).cast("int").alias(f) for f in ("class_id", "segment_id", "run")])
    every = runs.select(*KEY).distinct()
    return every.join(won, KEY, "left").select(
        *KEY, *[F.coalesce(f, F.lit(UNSET)).alias(f) for f in ("class_id", "segment_id", "run")]
    )


def run_conflicts(runs: DataFrame) -> DataFrame:
    lab = F.when(F.col("class_id") >= 0, F.col("class_id"))
    return runs.groupBy(*KEY).agg(((F.count(lab) >= 2) & (F.min(lab) != F.max(lab))).alias("conflict")).withColumn(
        "conflict", F.coalesce("conflict", F.lit(False))
    )


def stamp_seq(instances: DataFrame, doc: str = "session_id", order: str = "pos") -> DataFrame:
    """Missing apply orders continue after the document's maximum, in list order."""
    top = F.coalesce(F.max("seq").over(Window.partitionBy(doc)), F.lit(-1))
    missing = F.col("seq").isNull()
    nth = F.row_number().over(Window.partitionBy(doc, missing).orderBy(order))
    return instances.withColumn("seq", F.when(missing, top + nth).otherwise(F.col("seq")).cast("int"))


def last_worked(sessions: DataFrame) -> DataFrame:
    stamp = F.coalesce("saved_at", "created_at", F.lit(""))
    return sessions.filter(~F.col("corrupt")).groupBy("scan_id").agg(
        F.max_by("session_id", F.struct(stamp, "session_id")).alias("session_id"), F.max(stamp).alias("stamp")
    )


def list_sessions(folders: DataFrame, parsed: DataFrame) -> DataFrame:
    """Every session folder; ones without a readable document are corrupt."""
    out = folders.join(parsed.withColumn("_ok", F.lit(True)), ["scan_id", "session_id"], "left")
    return out.withColumn("corrupt", F.col("_ok").isNull()).drop("_ok").orderBy("scan_id", "session_id")


def retention(history: DataFrame, keep: int = 10) -> DataFrame:
    """(name, kept): the newest versions stay; other names are never touched."""
    version = F.col("name").rlike(r"^\d{8}_\d{6}$")
    rank = F.row_number().over(Window.partitionBy("scan_id", version).orderBy(F.desc("mtime"), F.desc("name")))
    return history.withColumn("kept", ~version | (rank <= keep))


def review_queue(summary: DataFrame, promoted: DataFrame) -> DataFrame:
    left = summary.join(small(promoted.select(*SEG).distinct()), SEG, "left_anti")
    return left.orderBy(F.desc("n_points"), "scan_id", "instance_id")


def top_instances(summary: DataFrame, n: int = 15) -> DataFrame:
    return summary.orderBy(F.desc("n_points"), "scan_id", "instance_id").limit(n)


def union_points(*sets: DataFrame) -> DataFrame:
    out = sets[0].select(*KEY)
    for s in sets[1:]:
        out = out.unionByName(s.select(*KEY))
    return out.distinct()


def classes_present(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("class_id").union(b.select("class_id"))
    return both.filter(F.col("class_id") >= 0).distinct()


def lost_ids(prior: DataFrame, current: DataFrame) -> DataFrame:
    return prior.select(*SEG).distinct().join(current.select(*SEG).distinct(), SEG, "left_anti")


def subtract_points(points: DataFrame, taken: DataFrame) -> DataFrame:
    return points.join(taken.select(*KEY).distinct(), KEY, "left_anti")


def cut_partition(labels: DataFrame, selection: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_kind, source_id, keys): selected points per source; sources stay separate.

    ``sources`` has (kind, id, ord): preseg and instance match instance_id, sam
    matches cand_id.
    """
    here = labels.join(selection.select(*KEY).distinct(), KEY, "left_semi")
    by_inst = small(sources.filter(F.col("kind") != "sam").select("kind", "ord", F.col("id").alias("instance_id")))
    by_cand = small(sources.filter(F.col("kind") == "sam").select("kind", "ord", F.col("id").alias("cand_id")))
    a = here.join(by_inst, "instance_id").select("kind", F.col("instance_id").alias("id"), "ord", *KEY)
    b = here.join(by_cand, "cand_id").select("kind", F.col("cand_id").alias("id"), "ord", *KEY)
    return a.unionByName(b)


def cut_preview(parts: DataFrame) -> DataFrame:
    """One source per point: the first in source order."""
    return parts.groupBy(*KEY).agg(F.min_by(F.struct("kind", "id"), "ord").alias("s")).select(*KEY, "s.kind", "s.id")


def multi_source_union(labels: DataFrame, sources: DataFrame) -> DataFrame:
    return cut_partition(labels, labels, sources).select(*KEY).distinct()


def preseg_current_instances(labels: DataFrame, preseg_id: int) -> DataFrame:
    hit = labels.filter((F.col("preseg_id") == preseg_id) & (F.col("instance_id") >= 0))
    return hit.select(*SEG).distinct()


def orphan_instances(labels: DataFrame, instances: DataFrame) -> DataFrame:
    ids = labels.filter(F.col("instance_id") >= 0).select(*SEG).distinct()
    doc = instances.withColumn("instance_id", F.col("segId")).select(*seg_key(instances)).distinct()
    return ids.join(small(doc), seg_key(doc), "left_anti").select(*SEG)


def strip_orphans(labels: DataFrame, instances: DataFrame | None) -> DataFrame:
    """Orphan instances' points become unlabeled; no document at all means skip."""
    if instances is None:
        return labels
    mark = small(orphan_instances(labels, instances).withColumn("_o", F.lit(True)))
    out = labels.join(mark, SEG, "left")
    cols = {c: F.when(F.col("_o"), UNSET).otherwise(F.col(c)) for c in ("class_id", "instance_id")}
    return out.withColumns(cols).select(*labels.columns)


def review_overlay(points: DataFrame, labels: DataFrame, palette: DataFrame) -> DataFrame:
    """Coloured marks for points with a category; hidden instances are skipped by the caller."""
    return points.join(labels.select(*KEY, "category"), KEY).join(small(palette), "category")


def attribute_instances(instances: DataFrame, labels: DataFrame, preseg_max: DataFrame, last_session: str) -> DataFrame:
    """(instance row id, session_id): the session whose labels hold the id.

    With several, those where the id lies above the preseg maximum come first;
    what stays open goes to the session with most decided rows, else the last
    worked one.
    """
    held = labels.filter(F.col("instance_id") >= 0).select("session_id", F.col("instance_id").alias("segId")).distinct()
    held = held.join(small(preseg_max), "session_id", "left").withColumn(
        "fresh", F.col("segId") > F.coalesce("preseg_max", F.lit(UNSET))
    )
    cand = instances.select("id", "segId").join(held, "segId")
    per = cand.groupBy("id").agg(
        F.count("*").alias("n"), F.count_if("fresh").alias("nf"), F.min("session_id").alias("any"),
        F.min(F.when(F.col("fresh"), F.col("session_id"))).alias("own"),
    )
    sure = per.select(
        "id", F.when(F.col("n") == 1, F.col("any")).when(F.col("nf") == 1, F.col("own")).alias("session_id")
    ).filter(F.col("session_id").isNotNull())
    tops = sure.groupBy("session_id").count().agg(F.max_by("session_id", F.struct("count", "session_id")).alias("_top"))
    return (
        instances.select("id").join(sure, "id", "left").join(F.broadcast(tops), how="cross")
        .select("id", F.coalesce("session_id", "_top", F.lit(last_session)).alias("session_id"))
    )
