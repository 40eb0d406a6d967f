"""Sub-setting a cloud: strides, seeded draws, voxels, chunks and regions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shapes import in_aabb
from ..session import cut, small


def stride_sample(points: DataFrame, max_points: int, n: int | None = None) -> DataFrame:
    """Every ``ceil(n / max)``-th point by point id; n counts the points of each scan unless given."""
    if n is not None:
        return points.filter(F.pmod("point_id", F.lit(max(1, math.ceil(n / max_points)))) == 0)
    strides = points.groupBy("scan_id").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / max_points)).cast("bigint").alias("_stride"))
    return points.join(small(strides), "scan_id").filter(F.pmod("point_id", "_stride") == 0).select(*points.columns)


def _draw(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("scan_id"), F.col("point_id"))


def random_sample(points: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows of each scan without replacement (all of a smaller one), the same rows on every run.

    The n-th smallest hash of a scan is located from counts of hash slots, so the draw is a filter; only the rows of
    the slot where n is reached, about a millionth of the scan, are ranked.
    """
    if n <= 0:
        return points.limit(0)
    keyed = points.withColumn("_h", _draw(seed)).withColumn("_slot", F.shiftright("_h", 44))
    counts = keyed.groupBy("scan_id", "_slot").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy("scan_id").orderBy("_slot"))
    edges = counts.withColumn("_to", upto).filter(F.col("_to") > n).groupBy("scan_id").agg(
        F.min("_slot").alias("_edge"), F.min_by(F.col("_to") - F.col("_c"), "_slot").alias("_before")
    )
    rows = keyed.join(small(cut(edges)), "scan_id", "left")
    sure = rows.filter(F.col("_edge").isNull() | (F.col("_slot") < F.col("_edge")))
    rank = F.row_number().over(Window.partitionBy("scan_id").orderBy("_h", "point_id"))
    last = rows.filter("_slot = _edge").withColumn("_r", rank).filter(F.col("_r") <= n - F.col("_before"))
    return sure.select(*points.columns).unionByName(last.select(*points.columns))


def region_sample(points: DataFrame, low, high, max_points: int | None = None, seed: int = 42):
    """(region points, total in region); ``max <= min`` on any axis is an error."""
    if any(float(b) <= float(a) for a, b in zip(low, high)):
        raise ValueError("region max must exceed min on every axis")
    region = points.filter(in_aabb(low, high))
    total = region.count()
    if max_points is not None:  # of each scan
        region = random_sample(region, max_points, seed)
    return region, total


def _origin(points: DataFrame) -> DataFrame:
    return points.groupBy("scan_id").agg(*[F.min(a).alias(f"o{a}") for a in "xyz"])


def voxel_keys(points: DataFrame, size: float, pad: float = 0.0) -> DataFrame:
    """Adds vx, vy, vz relative to the scan's minimum corner minus ``pad``."""
    keyed = points.join(small(_origin(points)), "scan_id")
    cells = {f"v{a}": F.floor((F.col(a) - F.col(f"o{a}") + pad) / size).cast("bigint") for a in "xyz"}
    return keyed.withColumns(cells).drop("ox", "oy", "oz")


def voxel_downsample(points: DataFrame, size: float) -> DataFrame:
    """One row per voxel: mean position and mean colour."""
    keyed = voxel_keys(points, size)
    means = [F.avg(a).alias(a) for a in "xyz"]
    means += [F.avg(c).alias(c) for c in "rgb" if c in points.columns]
    return keyed.groupBy("scan_id", "vx", "vy", "vz").agg(*means, F.count("*").alias("n_points"))


def voxel_counts(points: DataFrame, sizes: list[float]) -> dict[float, int]:
    """Occupied voxels for several sizes in one pass."""
    keyed = points.join(small(_origin(points)), "scan_id")
    keyed = keyed.withColumn("size", F.explode(F.array(*[F.lit(float(s)) for s in sizes])))
    cells = [F.floor((F.col(a) - F.col(f"o{a}")) / F.col("size")).alias(f"v{a}") for a in "xyz"]
    rows = keyed.select("scan_id", "size", *cells).distinct().groupBy("size").count().collect()
    return {r["size"]: r["count"] for r in rows}


def voxel_size_for_target(points: DataFrame, target: int, tol: float = 0.03, max_iters: int = 20, probes: int = 7) -> float:
    """Size whose voxel count is within ``tol`` of ``target``, sought in [diag/5000, diag/20].

    Each pass probes several sizes at once, so few passes are needed.
    """
    box = points.agg(*[F.max(a) - F.min(a) for a in "xyz"]).first()
    diag = math.sqrt(sum(v * v for v in box)) or 1.0
    low, high, best, done = diag / 5000, diag / 20, diag / 20, 0
    while done < max_iters:
        step = (high / low) ** (1 / (probes + 1))
        sizes = [low * step**i for i in range(1, probes + 1)]
        counts = voxel_counts(points, sizes)
        done += 3
        best = min(sizes, key=lambda s: abs(counts[s] - target))
        if abs(counts[best] - target) <= tol * target or high / low < 1.0001:
            return best
        over = [s for s in sizes if counts[s] > target]
        under = [s for s in sizes if counts[s] <= target]
        low, high = max(over, default=low), min(under, default=high)
    return best


def voxel_downsample_to_target(points: DataFrame, target: int, exact: bool = False, **kw) -> DataFrame:
    """Voxel means near ``target`` rows; ``exact`` takes a finer size and thins."""
    size = voxel_size_for_target(points, 2 * target if exact else target, **kw)
    out = voxel_downsample(points, size)
    if not exact:
        return out
    ided = out.withColumn("point_id", F.xxhash64("scan_id", "vx", "vy", "vz"))
    return random_sample(ided, target)


def voxel_segments(points: DataFrame, size: float = 0.05) -> DataFrame:
    """(scan_id, point_id, segment_id): every point gets its voxel's id.

    Ids are dense and follow the voxel's lowest point id within its scan.
    """
    keyed = cut(voxel_keys(points, size, pad=size).select("scan_id", "point_id", "vx", "vy", "vz"))
    cells = keyed.groupBy("scan_id", "vx", "vy", "vz").agg(F.min("point_id").alias("first_id"))
    return keyed.join(dense_ids(cells, "first_id", "segment_id"), ["scan_id", "vx", "vy", "vz"]).select(
        "scan_id", "point_id", "segment_id"
    )


def dense_ids(rows: DataFrame, order: str, name: str) -> DataFrame:
    """Adds 0-based dense ids per scan in ``order``.

    Rows are range-partitioned; a row's id is its place in its own partition
    plus the sizes of the partitions before it, so nothing is sorted in one task.
    """
    ranged = rows.repartitionByRange("scan_id", order).sortWithinPartitions("scan_id", order)
    placed = cut(ranged.withColumn("_m", F.monotonically_increasing_id()))
    placed = placed.withColumns(
        {"_part": F.shiftright("_m", 33), "_off": F.col("_m").bitwiseAND(F.lit(2**33 - 1))}
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    seated = placed.join(small(base), "_part").withColumn("_g", F.col("_base") + F.col("_off"))
    first = seated.groupBy("scan_id").agg(F.min("_g").alias("_first"))
    return (
        seated.join(small(first), "scan_id")
        .withColumn(name, F.col("_g") - F.col("_first"))
        .select(*rows.columns, name)
    )


def segment_sizes(segments: DataFrame) -> DataFrame:
    """Summary rows {segment_id, class_id -1, label 'supervoxel', n_points}."""
    return segments.groupBy("scan_id", "segment_id").agg(F.count("*").alias("n_points")).select(
        "scan_id", "segment_id", F.lit(-1).alias("class_id"), F.lit("supervoxel").alias("label"), "n_points"
    )


def chunk_reservoir(points: DataFrame, n_chunks: int = 5, chunk: int = 1_000_000, seed: int = 0) -> DataFrame:
    """All points of ``n_chunks`` seeded whole runs of ``chunk`` consecutive ids of each scan."""
    keyed = points.withColumn("_c", F.floor(F.col("point_id") / chunk).cast("bigint"))
    order = Window.partitionBy("scan_id").orderBy(F.xxhash64(F.lit(seed), "scan_id", "_c"), "_c")
    picks = keyed.select("scan_id", "_c").distinct().withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n_chunks)
    return keyed.join(small(picks.select("scan_id", "_c")), ["scan_id", "_c"], "left_semi").select(*points.columns)


def subsample_and_propagate(points: DataFrame, n: int, segment, seed: int = 42) -> DataFrame:
    """Segment a seeded n-subset with ``segment`` and give every point its nearest sample's id."""
    from .spatial import nearest_neighbor

    sample = random_sample(points, n, seed)
    ids = segment(sample).select("scan_id", F.col("point_id").alias("nn_id"), "segment_id")
    near = nearest_neighbor(points, sample)
    return near.join(ids, ["scan_id", "nn_id"]).select("scan_id", "point_id", "segment_id")


def subset_bbox(points: DataFrame) -> DataFrame:
    """One row: centre and size of a slice; sides at least 0.01, unit box when empty."""
    ends = points.agg(*[f(a).alias(f"{n}{a}") for n, f in (("l", F.min), ("h", F.max)) for a in "xyz"])
    return ends.select(
        *[F.coalesce((F.col(f"l{a}") + F.col(f"h{a}")) / 2.0, F.lit(0.0)).alias(f"c{a}") for a in "xyz"],
        *[F.coalesce(F.greatest(F.col(f"h{a}") - F.col(f"l{a}"), F.lit(0.01)), F.lit(1.0)).alias(f"s{a}") for a in "xyz"],
    )
