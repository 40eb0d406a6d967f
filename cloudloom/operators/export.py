"""Export filters, taxonomy, replay onto denser clouds and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import chords, loa_band
from ..functions.shapes import in_obb, in_prism, segment_d2
from ..schema import LOA_REST, UNSET, seg_key, REVIEW
from ..session import cut, small
from .containment import points_in_boxes, points_in_prisms, points_in_tubes
from .quantiles import exact_quantiles
from .sampling import chunk_reservoir, random_sample
from .spatial import knn, nearest_neighbor

KEY = ["scan_id", "point_id"]


def validate_export(rules: DataFrame, palette: DataFrame, include: list[int] | None, resolution: dict, n_scan: int, raw_available: bool) -> DataFrame:
    """(rule, message) rows, all problems at once; ``rules`` = (rule, from_ids, to_id, label, color)."""
    spark = rules.sparkSession
    src = rules.select("rule", F.explode("from_ids").alias("from_id"))
    ids = palette.select(F.col("class_id").alias("from_id"))
    say = lambda *p: F.concat(*[c if not isinstance(c, str) else F.lit(c) for c in p])
    text = lambda c: F.col(c).cast("string")
    missing = src.join(ids, "from_id", "left_anti").select(
        "rule", say("'from' id ", text("from_id"), " is not a source class").alias("message")
    )
    claim = Window.partitionBy("from_id").orderBy("rule")
    overlap = src.withColumn("_n", F.row_number().over(claim)).filter("_n > 1").select(
        "rule", say("source class ", text("from_id"), " is claimed twice").alias("message")
    )
    bounds = rules.filter(~F.col("to_id").between(0, 65535)).select(
        "rule", say("target id ", text("to_id"), " out of range [0, 65535]").alias("message")
    )
    first = Window.partitionBy("to_id").orderBy("rule")
    clash = rules.withColumns(
        {"_l": F.first("label").over(first), "_c": F.first("color").over(first)}
    ).filter((F.col("_l") != F.col("label")) | (F.col("_c") != F.col("color"))).select(
        "rule", say("target id ", text("to_id"), " has different label or color").alias("message")
    )
    kept = palette.select(F.col("class_id").alias("to_id")) if include is None else spark.createDataFrame([(int(i),) for i in include], "to_id int")
    kept = kept.join(src.select(F.col("from_id").alias("to_id")), "to_id", "left_anti")
    collide = rules.groupBy("to_id").agg(F.min("rule").alias("rule")).join(kept, "to_id", "left_semi").select(
        "rule", say("target id ", text("to_id"), " collides with a kept class").alias("message")
    )
    other = []
    kind, n = resolution.get("kind"), resolution.get("n")
    if kind not in ("scan", "subsample", "raw"):
        other.append(f"unknown resolution kind: {kind!r}")
    if kind == "subsample":
        if n is None or n < 1:
            other.append(f"subsample size must be >= 1, got {n}")
        elif n > n_scan:
            other.append(f"subsample size {n} exceeds {n_scan}")
    if kind == "raw" and not raw_available:
        other.append("raw export asked but no raw source is available")
    rest = spark.createDataFrame([(UNSET, m) for m in other], "rule int, message string")
    out = rest
    for part in (missing, overlap, bounds, clash, collide):
        out = out.unionByName(part)
    return out


def build_taxonomy(palette: DataFrame, rules: DataFrame, include: list[int] | None):
    """(taxonomy, source->target map): kept palette classes plus remap targets."""
    src = rules.select(F.explode("from_ids").alias("class_id"), "to_id", "rule")
    last = src.groupBy("class_id").agg(F.max_by("to_id", "rule").alias("to_id"))
    mapping = palette.select("class_id").join(last, "class_id", "full").select(
        F.col("class_id").alias("source"), F.coalesce("to_id", "class_id").alias("target")
    )
    kept = palette.join(last, "class_id", "left_anti")
    if include is not None:
        kept = kept.filter(F.col("class_id").isin(list(include)))
    aims = rules.groupBy("to_id").agg(F.max_by(F.struct("label", "color"), "rule").alias("t")).select(
        F.col("to_id").alias("class_id"), "t.label", "t.color"
    )
    kept = kept.select("class_id", "label", "color")
    return aims.join(kept, "class_id", "left_anti").unionByName(kept), mapping


def apply_filters_remap(labels: DataFrame, confirmed: DataFrame | None, include: list[int] | None, mapping: DataFrame | None) -> DataFrame:
    """Confirmed-only, then include, then remap; ids absent from the document count as confirmed."""
    cls, out = F.col("class_id"), labels
    if confirmed is not None:
        bad = confirmed.filter(~F.col("confirmed")).select(*seg_key(confirmed), F.lit(True).alias("_bad")).distinct()
        out = out.join(small(bad), seg_key(confirmed), "left")
        cls = F.when(F.col("_bad"), UNSET).otherwise(cls)
    if include is not None:
        cls = F.when(cls.isin(list(include)), cls).otherwise(UNSET)
    out = out.withColumn("class_id", cls)
    if mapping is not None:
        table = mapping.select(F.col("source").alias("class_id"), F.col("target").alias("_t"))
        out = out.join(small(table), "class_id", "left")
        out = out.withColumn("class_id", F.when(F.col("class_id") >= 0, F.coalesce("_t", "class_id")).otherwise(F.col("class_id")))
    return out.select(*labels.columns)


def surviving_instances(filtered: DataFrame) -> DataFrame:
    return filtered.filter("class_id >= 0 AND instance_id >= 0").select("scan_id", "instance_id").distinct()


def absent_instances(labels: DataFrame, confirmed: DataFrame) -> DataFrame:
    key = seg_key(confirmed)
    ids = labels.filter(F.col("instance_id") != UNSET).select(*key)
    gone = ids.join(small(confirmed.select(*key).distinct()), key, "left_anti")
    return gone.agg(F.count_distinct(*key).alias("n_absent"))


def instance_class_map(instances: DataFrame, labels: DataFrame) -> DataFrame:
    """(instance_id, class_id): the document's class, else the first point's; per scan if the document names scans."""
    key = seg_key(instances)
    first = labels.filter(F.col("instance_id") >= 0).groupBy(*key).agg(F.min_by("class_id", F.struct(*KEY)).alias("_f"))
    doc = instances.filter(F.col("segId").isNotNull()).withColumn("instance_id", F.col("segId")).groupBy(*key).agg(F.max("class_id").alias("_d"))
    return first.join(doc, key, "full").select(*key, F.coalesce("_d", "_f").alias("class_id"))


def collect_volumes(instances: DataFrame, paths: DataFrame):
    """(boxes, prisms, tube chords) of the volumetric instances, each with seq and list order."""
    inst = instances.filter(F.col("segId").isNotNull())
    base = ["shape_id", "instance_id", "seq", "ord"]
    head = [F.col("ord").alias("shape_id"), F.col("segId").alias("instance_id"), "seq", "ord"]
    rot = F.coalesce("rotation", F.array(*[F.lit(0.0)] * 3))
    boxes = inst.filter(F.col("source").isin("box", "beam") & F.col("center").isNotNull() & F.col("size").isNotNull()).select(
        *head, *[F.col("center")[i].alias(f"c{a}") for i, a in enumerate("xyz")],
        *[F.col("size")[i].alias(f"s{a}") for i, a in enumerate("xyz")], *[rot[i].alias(f"r{a}") for i, a in enumerate("xyz")],
    )
    prisms = inst.filter((F.col("source") == "prism") & F.col("prism").isNotNull()).select(
        *head, "prism.polygon", "prism.y0", "prism.height"
    )
    drawn = inst.filter(F.col("source") == "draw").select(*head)
    owned = chords(paths).join(small(drawn), "instance_id")
    return boxes, prisms, owned.select(*base, "radius", *[f"{e}{a}" for e in "ab" for a in "xyz"])


#: Volumes of the first round of a search for the best cover; each further round takes ``MORE_VOLUMES`` times as many.
FIRST_VOLUMES = 1000
MORE_VOLUMES = 4


def best_cover(targets: DataFrame, volumes: DataFrame, ranks: DataFrame, join) -> DataFrame:
    """(keys, w): per point the greatest (rank, instance_id) of the volumes that cover it.

    Volumes are met in rounds from the highest seq down, each round with several times as many; a point that is covered
    leaves, as all later volumes rank below.  So pairs follow the points, not points times volumes, where volumes overlap.
    ``ranks`` has (shape_id, instance_id, rank) with rank = (seq, place); volumes of one seq stay in one round.
    """
    n, shares = ranks.count(), []
    while FIRST_VOLUMES * MORE_VOLUMES ** len(shares) < n:
        shares.append(1.0 - FIRST_VOLUMES * MORE_VOLUMES ** len(shares) / n)
    at = ranks.agg(F.percentile_approx("rank.seq", shares, 10_000)).first()[0] if shares else []
    todo, found, above = targets.select(*KEY, "x", "y", "z"), None, F.lit(True)
    for least in [*sorted(set(at), reverse=True), None]:
        seq = F.col("rank.seq")
        some = ranks.filter(above & (F.lit(True) if least is None else seq > least))
        used = volumes.join(small(some.select("shape_id").distinct()), "shape_id", "left_semi")
        # Only the best covering volume of a point matters, so pairs fold as they appear.
        got = join(todo, used).join(small(some), "shape_id").groupBy(*KEY).agg(F.max(F.struct("rank", "instance_id")).alias("w"))
        if least is not None:
            got = cut(got)
            todo, above = cut(todo.join(got.select(*KEY), KEY, "left_anti")), seq <= least
        found = got if found is None else found.unionByName(got)
    return found


def replay_labels(targets: DataFrame, scan: DataFrame, labels: DataFrame, boxes: DataFrame, prisms: DataFrame | None, tubes: DataFrame | None, seq: DataFrame, class_map: DataFrame) -> DataFrame:
    """(keys, class_id, instance_id) for every target point.

    Candidates are the volumes that cover the point plus one baseline: the
    nearest scan point's instance, or, when that is a volume not covering the
    point, the nearest scan point outside all volumes.  The highest seq wins, a
    missing seq loses, earlier volumes and then the baseline lose ties last.
    """
    ords, parts = None, []
    for table, join in ((boxes, points_in_boxes), (prisms, points_in_prisms), (tubes, points_in_tubes)):
        if table is None:
            continue
        own = table.select("shape_id", "instance_id", "ord").distinct()
        ords = own if ords is None else ords.unionByName(own)
        parts.append((table, join))
    # Two volumes of one instance: the later one replaces the earlier, at its list place.
    ords = cut(ords)
    live = ords.groupBy("instance_id").agg(F.max("ord").alias("use"), F.min("ord").alias("place"))
    live = cut(ords.join(small(live), "instance_id").filter("ord = use").select("shape_id", "instance_id", "place"))
    rank = F.struct(F.coalesce(F.col("seq").cast("double"), F.lit(float("-inf"))).alias("seq"), (-F.col("place")).alias("place"))
    ranks = cut(live.join(small(seq), "instance_id", "left").select("shape_id", "instance_id", rank.alias("rank")))
    hits, covers = None, None
    in_box = in_obb(("cx", "cy", "cz"), ("sx", "sy", "sz"), ("rx", "ry", "rz"))
    in_ring_band = in_prism("polygon", "y0", "height")
    in_chord = segment_d2(("ax", "ay", "az"), ("bx", "by", "bz")) <= F.col("radius") * F.col("radius")
    for table, join in parts:
        used = table.join(small(live.select("shape_id", "instance_id")), ["shape_id", "instance_id"], "left_semi")
        got = best_cover(targets, used, ranks.join(small(table.select("shape_id").distinct()), "shape_id", "left_semi"), join)
        hits = got if hits is None else hits.unionByName(got)
    owner = labels.select("scan_id", F.col("point_id").alias("nn_id"), "instance_id")
    near = nearest_neighbor(targets, scan).join(owner, ["scan_id", "nn_id"]).select(*KEY, "instance_id")
    near = cut(near.join(targets.select(*KEY, "x", "y", "z"), KEY))
    vol = small(live.select("instance_id").distinct().withColumn("_vol", F.lit(True)))
    owned = near.join(vol, "instance_id", "left_semi")
    for table, exact in ((boxes, in_box), (prisms, in_ring_band), (tubes, in_chord)):
        if table is not None:
            used = table.join(small(live.select("shape_id", "instance_id")), ["shape_id", "instance_id"], "left_semi")
            got = owned.join(small(used.drop("seq", "ord")), "instance_id").filter(exact).select(*KEY)
            covers = got if covers is None else covers.unionByName(got)
    covers = covers.distinct().withColumn("_in", F.lit(True))
    near = near.join(vol, "instance_id", "left").join(covers, KEY, "left")
    near = cut(near.select(*KEY, "instance_id", (F.coalesce("_vol", F.lit(False)) & F.col("_in").isNull()).alias("leak")))
    free = labels.join(vol, "instance_id", "left_anti").select(*KEY)
    lost = targets.join(near.filter("leak").select(*KEY), KEY, "left_semi")
    # Most points need no second search; an empty ``lost`` skips it.
    if lost.isEmpty():
        back = near.limit(0).select(*KEY, "instance_id")
    else:
        back = nearest_neighbor(cut(lost), scan.join(free, KEY, "left_semi")).join(owner, ["scan_id", "nn_id"]).select(*KEY, "instance_id")
    base = near.filter("NOT leak").select(*KEY, "instance_id").unionByName(back).filter(F.col("instance_id") != UNSET)
    base = base.withColumn("place", F.lit(2**31 - 1)).join(small(seq), "instance_id", "left")
    cand = hits.unionByName(base.select(*KEY, F.struct(rank.alias("rank"), F.col("instance_id")).alias("w")))
    won = cand.groupBy(*KEY).agg(F.max("w").alias("w")).select(*KEY, "w.instance_id")
    won = won.join(small(class_map), "instance_id", "left")
    none = F.raise_error(F.concat(F.lit("no class for instance "), F.col("instance_id").cast("string"))).cast("int")
    won = won.withColumn("class_id", F.coalesce("class_id", none))
    return targets.select(*KEY).join(won, KEY, "left").select(
        *KEY, F.coalesce("class_id", F.lit(UNSET)).alias("class_id"), F.coalesce("instance_id", F.lit(UNSET)).alias("instance_id")
    )


def sample_spacing(points: DataFrame, sample: int | None = None, seed: int = 0) -> DataFrame:
    """One row (p50, p90) of nearest other-point distances of all points, or of a sample of them, against all points."""
    points = cut(points.select("scan_id", "point_id", "x", "y", "z"))
    query = points if sample is None else cut(random_sample(points, sample, seed))
    near = knn(query, points, 1)
    got = exact_quantiles(near, [], "distance", [0.5, 0.9])
    return got.agg(*[F.coalesce(F.max(F.when(F.col("p") == p, F.col("quantile"))), F.lit(0.0)).alias(n) for p, n in ((0.5, "p50"), (0.9, "p90"))])


def accuracy_report(points: DataFrame, is_raw: bool = False, **reservoir) -> DataFrame:
    """(p50, p90, loa, is_raw); raw clouds are measured on whole reservoir chunks."""
    cloud = chunk_reservoir(points, **reservoir) if is_raw else points
    return sample_spacing(cloud).select("p50", "p90", loa_band("p90").alias("loa"), F.lit(is_raw).alias("is_raw"))


def raw_region_points(points: DataFrame, prism: dict) -> DataFrame:
    from ..functions.shapes import literal_prism

    return points.filter(literal_prism(prism))


def raw_region_spacing(points: DataFrame, prism: dict) -> DataFrame:
    """(n_points, p50, p90) of the raw points inside a prism; an empty region gives zeros."""
    inside = cut(raw_region_points(points, prism))
    return sample_spacing(inside).withColumn("n_points", F.lit(inside.count()))


def measure_regions(regions: DataFrame, raw: DataFrame | None, scan: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, status, raw_available, n_points, p50, p90, n_review, n_session) of every region, as ``region_gate`` takes it.

    Raw points count and are measured per region, against the other raw points of that region; review points are counted
    among the labelled scan points inside.  Empty regions measure zeros; a point in two regions belongs to both.
    """
    from .containment import points_in_prisms

    own = regions.select(F.col("shape_id").alias("id"), "status")
    if raw is None:
        spacing = own.select("id").limit(0).select("id", F.lit(0).cast("bigint").alias("n_points"), F.lit(0.0).alias("p50"), F.lit(0.0).alias("p90"))
    else:
        held = points_in_prisms(raw, regions).join(raw.select(*KEY, "x", "y", "z"), KEY)
        held = cut(held.select(F.concat_ws("/", "scan_id", "shape_id").alias("scan_id"), "point_id", "x", "y", "z", F.col("shape_id").alias("id")))
        near = cut(knn(held.drop("id"), held.drop("id"), 1).select(*KEY, "distance").join(held.select(*KEY, "id"), KEY))
        spread = exact_quantiles(near, ["id"], "distance", [0.5, 0.9]).groupBy("id").agg(
            *[F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(n) for p, n in ((0.5, "p50"), (0.9, "p90"))]
        )
        spacing = held.groupBy("id").agg(F.count("*").alias("n_points")).join(small(spread), "id", "left")
        spacing = spacing.select("id", "n_points", F.coalesce("p50", F.lit(0.0)).alias("p50"), F.coalesce("p90", F.lit(0.0)).alias("p90"))
    inside = points_in_prisms(scan, regions).join(labels.select(*KEY, "category"), KEY)
    marks = inside.groupBy(F.col("shape_id").alias("id")).agg(F.count_if(F.col("category") == REVIEW).alias("n_review"), F.count("*").alias("n_session"))
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return own.join(small(spacing), "id", "left").join(small(marks), "id", "left").select(
        "id", "status", F.lit(raw is not None).alias("raw_available"), zero("n_points", 0), zero("p50", 0.0), zero("p90", 0.0), zero("n_review", 0), zero("n_session", 0)
    )


def materialize(resolution: dict, scan: DataFrame, labels: DataFrame, raw: DataFrame | None = None, replay: dict | None = None) -> DataFrame:
    """Points with labels at scan density, a seeded subsample, or replayed raw density."""
    kind = resolution["kind"]
    if kind == "raw":
        if raw is None:
            raise ValueError("no raw source")
        return raw.join(replay_labels(raw, scan, labels, **(replay or {})), KEY)
    points = scan if kind == "scan" else random_sample(scan, int(resolution["n"]))
    return points.join(labels.select(*KEY, "class_id", "instance_id"), KEY)


def export_labels(cloud: DataFrame, confirmed: DataFrame | None, include, mapping: DataFrame | None, drop: bool = True) -> DataFrame:
    """Filtered and remapped labelled points, unlabeled rows dropped on request."""
    out = apply_filters_remap(cloud, confirmed, include, mapping)
    return out.filter(F.col("class_id") >= 0) if drop else out


def export_manifest(taxonomy: DataFrame, accuracy: DataFrame, absent: DataFrame, resolution: dict, filters: dict, source: str) -> DataFrame:
    """One JSON row describing the export."""
    classes = taxonomy.agg(F.sort_array(F.collect_list(F.struct("class_id", "label", "color"))).alias("classes"))
    acc = accuracy.select(F.struct(F.round("p50", 4).alias("p50"), F.round("p90", 4).alias("p90"), "loa", "is_raw").alias("accuracy"))
    one = classes.join(acc, how="cross").join(absent, how="cross")
    lit_map = lambda d: F.to_json(F.create_map(*[F.lit(str(v)) for kv in d.items() for v in kv])) if d else F.lit("{}")
    return one.select(
        F.to_json(
            F.struct(
                "classes", "accuracy", F.lit(source).alias("source"), lit_map(resolution).alias("resolution"),
                lit_map(filters).alias("filters"), "n_absent",
            )
        ).alias("manifest")
    )


def label_manifest(labels: DataFrame, region_hits: DataFrame, thresholds: dict) -> DataFrame:
    """(section, key, value) rows: class, category and per-region histograms and coverage.

    A point inside two regions counts in both, so the fraction can exceed 1.
    """
    cls = labels.groupBy(F.col("class_id").cast("string").alias("key")).agg(F.count("*").cast("double").alias("value")).select(F.lit("class").alias("section"), "key", "value")
    cat = labels.groupBy(F.col("category").cast("string").alias("key")).agg(F.count("*").cast("double").alias("value")).select(F.lit("category").alias("section"), "key", "value")
    rows = region_hits.join(labels, KEY)
    reg = rows.groupBy(F.concat_ws("/", "shape_id", "category").alias("key")).agg(F.count("*").cast("double").alias("value")).select(F.lit("region").alias("section"), "key", "value")
    lab = labels.agg(F.count_if(F.col("class_id") >= 0).alias("n"))
    inside = rows.agg(F.count_if(F.col("class_id") >= 0).alias("m"))
    frac = lab.join(inside, how="cross").select(F.lit("coverage").alias("section"), F.lit("in_region_fraction").alias("key"), F.when(F.col("n") > 0, F.col("m") / F.col("n")).otherwise(0.0).alias("value"))
    limits = labels.sparkSession.createDataFrame([("threshold", k, float(v)) for k, v in thresholds.items()], "section string, key string, value double")
    return cls.unionByName(cat).unionByName(reg).unionByName(frac).unionByName(limits)
