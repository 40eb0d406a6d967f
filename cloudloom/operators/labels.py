"""Label edits as DataFrame -> (labels, delta); the delta rows feed the edit log.

``labels`` is keyed (scan_id, point_id) with class_id, instance_id, category and
optionally preseg_id and cand_id.  A selection is any table of those keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shapes import in_shape
from ..schema import ARTIFACT, CATEGORIES, HISTORY_CAP, REVIEW, UNSET
from ..session import is_empty, small

KEY = ["scan_id", "point_id"]
STATE = ["class_id", "instance_id", "category"]


@dataclass
class Edit:
    labels: DataFrame
    delta: DataFrame | None
    counts: DataFrame | None = None
    new_instance_id: int | None = None
    erased: DataFrame | None = None

    @property
    def deltas(self) -> list[DataFrame]:
        """All deltas in the order in which they apply; undo takes them back in reverse."""
        return [d for d in (self.erased, self.delta) if d is not None]


def _ids(spark, values) -> DataFrame:
    return spark.createDataFrame([(int(v),) for v in values], "instance_id int")


def protect(labels: DataFrame, selection: DataFrame, protected, target: int | None = None):
    """(kept keys, one-row counts): selected points of locked instances dropped.

    -1 and the edit's own target never count as locked.
    """
    locked = [int(v) for v in (protected or []) if int(v) != UNSET and int(v) != target]
    here = labels.join(selection.select(*KEY), KEY, "left_semi").select(*KEY, "instance_id")
    if not locked:
        counts = here.agg(F.count("*").alias("n_affected"), F.lit(0).cast("bigint").alias("n_protected"))
        return here.select(*KEY), counts
    table = small(_ids(labels.sparkSession, locked))
    kept = here.join(table, "instance_id", "left_anti").select(*KEY)
    flag = here.join(table.withColumn("lock", F.lit(1)), "instance_id", "left")
    counts = flag.agg(
        F.count_if(F.col("lock").isNull()).alias("n_affected"), F.count_if(F.col("lock") == 1).alias("n_protected")
    )
    return kept, counts


def _apply(labels: DataFrame, selection: DataFrame, op: str, after: dict[str, Column]) -> Edit:
    picked = selection.select(*KEY).distinct().withColumn("_sel", F.lit(True))
    after = {"category": F.lit(0), **after}
    new = {c: after.get(c, F.col(c)).cast("int") for c in STATE}
    joined = labels.join(picked, KEY, "left")
    delta = joined.filter("_sel").select(
        *KEY, F.lit(op).alias("op"),
        *[F.col(c).alias(f"before_{c}") for c in STATE], *[v.alias(f"after_{c}") for c, v in new.items()],
    )
    edited = joined.withColumns({c: F.when(F.col("_sel"), v).otherwise(F.col(c)) for c, v in new.items()})
    if "cand_id" in labels.columns:
        edited = edited.withColumn("cand_id", F.when(F.col("_sel"), UNSET).otherwise(F.col("cand_id")))
    return Edit(edited.select(*labels.columns), delta)


def fresh_id(labels: DataFrame, log: DataFrame | None = None) -> int:
    """Next instance id: above every id ever used, also undone ones."""
    top = labels.agg(F.max("instance_id")).first()[0]
    tops = [top if top is not None else UNSET]
    if log is not None:
        past = log.agg(F.max(F.greatest("before_instance_id", "after_instance_id"))).first()[0]
        tops.append(past if past is not None else UNSET)
    return max(*tops, UNSET) + 1


def set_class(labels: DataFrame, selection: DataFrame, class_id: int) -> Edit:
    return _apply(labels, selection, "set_class", {"class_id": F.lit(class_id)})


def merge_instances(labels: DataFrame, source: int, target: int) -> Edit:
    """Source points join the target and take the class of its first point."""
    if source == target:
        return Edit(labels, None)
    sel = labels.filter(F.col("instance_id") == source)
    first = lambda i: F.min_by(F.when(F.col("instance_id") == i, F.col("class_id")), F.when(F.col("instance_id") == i, F.col("point_id")))
    lead = labels.filter(F.col("instance_id").isin(source, target)).groupBy("scan_id").agg(first(source).alias("_s"), first(target).alias("_t"))
    lead = lead.filter("_s IS NOT NULL").select("scan_id", F.coalesce("_t", "_s").alias("_cls"))
    if is_empty(lead):
        return Edit(labels, None)
    edit = _apply(labels.join(small(lead), "scan_id", "left"), sel, "merge", {"instance_id": F.lit(target), "class_id": F.col("_cls")})
    edit.labels = edit.labels.select(*labels.columns)
    return edit


def reassign(
    labels: DataFrame, selection: DataFrame, instance: int | None = None, class_id: int | None = None,
    protected=None, log: DataFrame | None = None,
) -> Edit:
    """Write an instance and class; both null erases; a null/negative instance is allocated."""
    kept, counts = protect(labels, selection, protected, instance)
    erase = instance is None and class_id is None
    if not erase and class_id is None:
        raise ValueError("reassign needs a class unless it erases")
    if protected and is_empty(kept) and not is_empty(selection):
        return Edit(labels, None, counts)
    if erase:
        edit = _apply(labels, kept, "reassign", {"instance_id": F.lit(UNSET), "class_id": F.lit(UNSET)})
        edit.counts = counts
        return edit
    new = fresh_id(labels, log) if instance is None or instance < 0 else None
    target = instance if new is None else new
    edit = _apply(labels, kept, "reassign", {"instance_id": F.lit(target), "class_id": F.lit(class_id)})
    edit.counts, edit.new_instance_id = counts, new
    return edit


def set_category(
    labels: DataFrame, selection: DataFrame, category, protected=None, allocate: bool | None = None,
    log: DataFrame | None = None,
) -> Edit:
    """Mark points on the status axis: the class is erased; a review mark is one blob instance."""
    code = CATEGORIES.get(category) if isinstance(category, str) else int(category)
    if isinstance(category, bool) or code not in CATEGORIES.values():
        raise ValueError(f"unknown category: {category!r}")
    kept, counts = protect(labels, selection, protected)
    if is_empty(kept):
        return Edit(labels, None, counts)
    blob = (code == REVIEW) if allocate is None else allocate
    new = fresh_id(labels, log) if blob else None
    edit = _apply(
        labels, kept, "set_category",
        {"category": F.lit(code), "class_id": F.lit(UNSET), "instance_id": F.lit(UNSET if new is None else new)},
    )
    edit.counts, edit.new_instance_id = counts, new
    return edit


def apply_shape(
    points: DataFrame, labels: DataFrame, shape: dict, class_id: int | None = None, category=None,
    instance: int | None = None, protected=None, log: DataFrame | None = None,
) -> Edit:
    """Select by shape, then exactly one of class or category."""
    if (class_id is None) == (category is None):
        raise ValueError("give exactly one of class_id and category")
    sel = points.filter(in_shape(shape)).select(*KEY)
    if category is not None:
        return set_category(labels, sel, category, protected, log=log)
    return reassign(labels, sel, instance, class_id, protected, log)


def upsert_paths(paths: DataFrame, new_paths: DataFrame, instance: int, merged_from=()) -> DataFrame:
    """Centerline store: paths of the instance and of merged ids replaced by new ones."""
    gone = small(_ids(paths.sparkSession, [instance, *merged_from]))
    kept = paths.join(gone, "instance_id", "left_anti").select(*paths.columns)
    return kept.unionByName(new_paths.withColumn("instance_id", F.lit(instance)).select(*paths.columns))


def apply_centerline(points, labels, paths: DataFrame, new_paths: list[dict], path_rows: DataFrame, class_id: int, instance: int | None = None, merged_from=(), protected=None, log=None):
    """Tube edit plus the path upsert; merged instances give up their points first."""
    erased = None
    if merged_from:
        gone = labels.join(small(_ids(labels.sparkSession, merged_from)), "instance_id", "left_semi")
        first = _apply(labels, gone, "reassign", {"instance_id": F.lit(UNSET), "class_id": F.lit(UNSET)})
        labels, erased = first.labels, first.delta
    shape = {"type": "tube", "paths": new_paths}
    edit = apply_shape(points, labels, shape, class_id=class_id, instance=instance, protected=protected, log=log)
    edit.erased = erased
    owner = edit.new_instance_id if edit.new_instance_id is not None else instance
    return edit, paths if owner is None else upsert_paths(paths, path_rows, owner, merged_from)


def snap_to_preseg(labels: DataFrame, instances) -> Edit:
    """Points of the given instances return to their preseg cluster; class unchanged."""
    table = small(_ids(labels.sparkSession, instances))
    sel = labels.join(table, "instance_id", "left_semi").filter(F.col("preseg_id") >= 0)
    return _apply(labels, sel, "snap_to_preseg", {"instance_id": F.col("preseg_id")})


def materialize_candidate(labels: DataFrame, selection: DataFrame, next_id: int, protected=None):
    """(labels, counts): the points carry candidate ``next_id``; the last write wins."""
    kept, counts = protect(labels, selection, protected)
    return _set_candidate(labels, kept, next_id), counts


def remove_candidates(labels: DataFrame, selection: DataFrame) -> DataFrame:
    return _set_candidate(labels, selection, UNSET)


def _set_candidate(labels: DataFrame, keys: DataFrame, value: int) -> DataFrame:
    picked = keys.select(*KEY).distinct().withColumn("_sel", F.lit(True))
    out = labels.join(picked, KEY, "left")
    out = out.withColumn("cand_id", F.when(F.col("_sel"), F.lit(value)).otherwise(F.col("cand_id")).cast("int"))
    return out.select(*labels.columns)


def candidate_summary(labels: DataFrame) -> DataFrame:
    """Live candidate segments; emptied ones are gone."""
    return labels.filter(F.col("cand_id") >= 0).groupBy("scan_id", "cand_id").agg(F.count("*").alias("n_points"))


def append_log(log: DataFrame | None, delta: DataFrame, edit_seq: int) -> DataFrame:
    rows = delta.withColumns({"edit_seq": F.lit(edit_seq).cast("bigint"), "active": F.lit(True)})
    return rows if log is None else log.unionByName(rows)


def fold_log(base: DataFrame, log: DataFrame) -> DataFrame:
    """Current labels: the latest active delta per point over the seeded base."""
    last = log.filter("active").groupBy(*KEY).agg(
        F.max_by(F.struct(*[F.col(f"after_{c}").alias(c) for c in STATE]), "edit_seq").alias("_now")
    )
    out = base.join(last, KEY, "left")
    return out.withColumns({c: F.coalesce(F.col(f"_now.{c}"), F.col(c)) for c in STATE}).select(*base.columns)


def _edits(log: DataFrame) -> DataFrame:
    """One row per edit (not per point); an edit is active or undone as a whole."""
    return log.groupBy("edit_seq").agg(F.first("active").alias("active"))


def undo(log: DataFrame, cap: int = HISTORY_CAP) -> DataFrame:
    """The newest active edit of the last ``cap`` becomes inactive."""
    recent = _edits(log).orderBy(F.desc("edit_seq")).limit(cap)
    top = recent.filter("active").agg(F.max("edit_seq").alias("_e"))
    return log.join(F.broadcast(top), how="cross").withColumn(
        "active", F.col("active") & ~F.coalesce(F.col("edit_seq") == F.col("_e"), F.lit(False))
    ).drop("_e")


def redo(log: DataFrame) -> DataFrame:
    """The oldest undone edit above every active one becomes active again."""
    edits = _edits(log)
    floor = edits.agg(F.coalesce(F.max(F.when(F.col("active"), F.col("edit_seq"))), F.lit(-1)).alias("_f"))
    top = edits.join(F.broadcast(floor), how="cross").filter(~F.col("active") & (F.col("edit_seq") > F.col("_f"))).agg(
        F.min("edit_seq").alias("_e")
    )
    return log.join(F.broadcast(top), how="cross").withColumn(
        "active", F.col("active") | F.coalesce(F.col("edit_seq") == F.col("_e"), F.lit(False))
    ).drop("_e")


def strip_unclassified(labels: DataFrame):
    """(labels for export, one-row count): instances without a class become -1."""
    odd = (F.col("instance_id") >= 0) & (F.col("class_id") == UNSET)
    stripped = labels.withColumn("instance_id", F.when(odd, UNSET).otherwise(F.col("instance_id")))
    return stripped, labels.agg(F.count_if(odd).alias("n_stripped"))


def seed_session(points: DataFrame, preseg: DataFrame | None, summary: DataFrame | None, min_points: int) -> DataFrame:
    """Initial labels: preseg ids and classes with tiny segments dropped, or all -1."""
    from .aggregates import drop_tiny_segments, segment_class_join

    keys = points.select(*KEY)
    if preseg is None:
        return keys.select(*KEY, *[F.lit(UNSET).alias(c) for c in ("class_id", "instance_id")], F.lit(0).alias("category"), F.lit(UNSET).alias("preseg_id"))
    raw = segment_class_join(preseg, summary)
    base = keys.join(raw, KEY, "left").select(
        *KEY, F.coalesce("class_id", F.lit(UNSET)).alias("class_id"),
        F.coalesce("instance_id", F.lit(UNSET)).alias("instance_id"), F.lit(0).alias("category"),
        F.coalesce("instance_id", F.lit(UNSET)).alias("preseg_id"),
    )
    return drop_tiny_segments(base, min_points)


def retire_class_to_review(labels: DataFrame, instances: DataFrame, class_id: int = 6):
    """(labels, blob counts, instances): a retired class becomes class-less review blobs.

    Running it again changes nothing, since no point carries the class any more.
    """
    hit = F.col("class_id") == class_id
    blobs = labels.filter(hit & (F.col("instance_id") >= 0)).groupBy("scan_id", "instance_id").agg(F.count("*").alias("n_points"))
    edited = labels.withColumns(
        {
            "category": F.when(hit, REVIEW).otherwise(F.col("category")),
            "instance_id": F.when(hit, UNSET).otherwise(F.col("instance_id")),
            "class_id": F.when(hit, UNSET).otherwise(F.col("class_id")),
        }
    )
    mark = small(blobs.select("scan_id", F.col("instance_id").alias("segId"), F.lit(True).alias("_b")))
    doc = instances.join(mark, ["scan_id", "segId"], "left")
    cls = F.when(F.col("_b"), F.lit(None)).otherwise(F.col("class_id"))
    doc = doc.withColumns({"class_id": cls, "confirmed": F.col("confirmed") & F.col("_b").isNull()})
    return edited, blobs, doc.select(*instances.columns)


def commit_beams(edges: DataFrame, nodes: DataFrame, applied: DataFrame):
    """(committed, edges, nodes): applied clean edges leave the graph with end positions."""
    baked = edges.join(applied.select("id"), "id", "left_semi").filter(~F.col("dirty"))
    pos = nodes.select(F.col("id").alias("nid"), "pos")
    done = (
        baked.join(pos.withColumnsRenamed({"nid": "a", "pos": "a_pos"}), "a")
        .join(pos.withColumnsRenamed({"nid": "b", "pos": "b_pos"}), "b")
        .select("id", "a_pos", "b_pos", "width", "class_id", "instance_id")
    )
    left = edges.join(baked.select("id"), "id", "left_anti").select(*edges.columns)
    used = left.select(F.col("a").alias("id")).union(left.select(F.col("b").alias("id"))).distinct()
    return done, left, nodes.join(used, "id", "left_semi").select(*nodes.columns)


def denoise(points: DataFrame, labels: DataFrame, replace_instance: int | None = None, protected=None, k: int = 16, std_ratio: float = 2.0, log=None) -> Edit:
    """Global outliers become one artifact blob; the previous blob is erased unless locked."""
    from .cluster import sor_outliers

    erased = None
    if replace_instance is not None and replace_instance not in (protected or []):
        old = labels.filter(F.col("instance_id") == replace_instance)
        first = _apply(labels, old, "reassign", {"instance_id": F.lit(UNSET), "class_id": F.lit(UNSET)})
        labels, erased = first.labels, first.delta
    outliers = sor_outliers(points, k, std_ratio)
    edit = set_category(labels, outliers, ARTIFACT, protected, allocate=True, log=log)
    edit.erased = erased
    return edit


def denoise_selection(points: DataFrame, labels: DataFrame, source: str, seg_id: int, k: int = 16, std_ratio: float = 2.0):
    """(labels, kept/removed counts): strays of one candidate or instance removed."""
    from .cluster import sor_outliers

    column = "cand_id" if source == "candidate" else "instance_id"
    member = labels.filter(F.col(column) == seg_id).select(*KEY)
    if is_empty(member):
        raise ValueError("empty selection")
    out = sor_outliers(points.join(member, KEY, "left_semi"), k, std_ratio)
    if source == "candidate":
        edited = remove_candidates(labels, out)
    else:
        edited = _apply(labels, out, "reassign", {"instance_id": F.lit(UNSET), "class_id": F.lit(UNSET)}).labels
    counts = member.join(out.withColumn("_o", F.lit(1)), KEY, "left").agg(
        F.count_if(F.col("_o").isNull()).alias("kept"), F.count("_o").alias("removed")
    )
    return edited, counts
