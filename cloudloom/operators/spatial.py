"""Exact spatial joins: nearest, k-nearest, radius pairs and shapes x points.

Neighbour search uses an adaptive power-of-two grid over positions taken
relative to the scan's minimum corner.  Level ``e`` has cells of side ``2**-e``.
Cells are halved until they hold few distinct positions, so a dense spot becomes
many small leaves instead of one hot join key, and coincident points are folded
into one *site* first.  Which leaves can hold a neighbour is settled between
cells, by their smallest and largest distances; single points are compared only
with the leaves that remain.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, is_empty, many, small

AXES = ("x", "y", "z")
CELL = ("cx", "cy", "cz")
NODE = ("nx", "ny", "nz")
_FIRST_BATCH = 5
_BATCH = 3
_MAX_LEVEL = 30
#: Pairs of positions that one task of a neighbour search is dealt, on average.
_PAIRS_A_TASK = 2_000_000
#: Pairs from leaves without a distance for a bound above which their queries get one.
_PAIRS_UNBOUND = 2_000_000
_SLACK = 1.0 + 1e-6


def _side(level: Column) -> Column:
    return F.pow(F.lit(2.0), -level)


def _key(coord: str, level: Column | int) -> Column:
    factor = F.pow(F.lit(2.0), level) if isinstance(level, Column) else F.lit(2.0**level)
    return F.floor(F.col(coord) * factor).cast("bigint")


def _tasks(spark: SparkSession, pairs: int) -> int:
    """Partitions for a join that makes ``pairs`` rows: their number, not that of the small tables that meet, fills a task."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(math.ceil(pairs / _PAIRS_A_TASK), min(usual, math.ceil(20 * pairs / _PAIRS_A_TASK)), 1)


def _up(cell: str, steps: Column) -> Column:
    return F.floor(F.col(cell) * F.pow(F.lit(2.0), -steps)).cast("bigint")


def sites(points: DataFrame, keep_ids: int) -> DataFrame:
    """Distinct positions with their ``keep_ids`` lowest point ids."""
    pos = ["scan_id", *AXES]
    if keep_ids == 1:
        ids = points.groupBy(*pos).agg(F.array(F.min("point_id")).alias("ids"))
    else:
        order = Window.partitionBy(*pos).orderBy("point_id")
        ids = (
            points.select(*pos, "point_id")
            .withColumn("rn", F.row_number().over(order))
            .filter(F.col("rn") <= keep_ids)
            .groupBy(*pos)
            .agg(F.sort_array(F.collect_list("point_id")).alias("ids"))
        )
    return ids.withColumn("site_id", F.col("ids")[0])


def _grid_tree(members: DataFrame, take: int, cap: int, root: int):
    """Place ``members`` (scan_id, ux, uy, uz, is_p, is_q, ...) into grid leaves.

    Returns (members + leaf + reach, nodes).  ``reach`` is the deepest level, at
    or above the leaf, whose cell holds at least ``take`` positions.  Only
    members of over-full cells enter the next batch of levels.
    """
    rel = ("ux", "uy", "uz")
    done, nodes = None, None
    active = members.withColumn("reach", F.lit(root - 1))
    level, batch = root - 1, _FIRST_BATCH
    while True:
        top = level + batch
        keys = [_key(a, top).alias(c) for a, c in zip(rel, CELL)]
        cells = active.groupBy("scan_id", *keys).agg(
            F.sum("is_p").alias(f"p{batch}"),
            F.sum("is_q").alias(f"q{batch}"),
            F.max("reach").alias("reach"),
        )
        for j in range(batch - 1, 0, -1):
            names = [f"u{j}{c}" for c in CELL]
            cells = cells.select("*", *[F.shiftright(c, batch - j).alias(n) for c, n in zip(CELL, names)])
            roll = cells.groupBy("scan_id", *names).agg(
                F.sum(f"p{batch}").alias(f"p{j}"), F.sum(f"q{batch}").alias(f"q{j}")
            )
            cells = cells.join(roll, ["scan_id", *names])
        last = top >= _MAX_LEVEL
        leaf = F.lit(top if last else None).cast("int")
        reach = F.col("reach")
        for j in range(batch, 0, -1):
            full = (F.col(f"p{j}") > cap) | (F.col(f"q{j}") > 4 * cap)
            leaf = F.when(~full, F.lit(level + j)).otherwise(leaf)
        cells = cells.withColumn("leaf", leaf)
        for j in range(1, batch + 1):
            open_here = F.col("leaf").isNull() | (F.col("leaf") >= level + j)
            reach = F.when(open_here & (F.col(f"p{j}") >= take), F.lit(level + j)).otherwise(reach)
        cells = cut(cells.withColumn("reach", reach))
        for j in range(1, batch + 1):
            names = [f"u{j}{c}" for c in CELL] if j < batch else list(CELL)
            node = (
                cells.filter((F.col(f"p{j}") > 0) & (F.col("leaf").isNull() | (F.col("leaf") >= level + j)))
                .groupBy("scan_id", *[F.col(n).alias(c) for n, c in zip(names, NODE)])
                .agg(
                    F.first(f"p{j}").alias("p"),
                    F.max(F.coalesce("leaf", F.lit(top + 1)) > level + j).alias("inner"),
                )
                .withColumn("node_level", F.lit(level + j))
            )
            nodes = node if nodes is None else nodes.unionByName(node)
        placed = (
            active.drop("reach").select("*", *keys)
            .join(cells.select("scan_id", *CELL, "leaf", "reach"), ["scan_id", *CELL])
            .drop(*CELL)
        )
        placed = cut(placed)
        fin = placed.filter(F.col("leaf").isNotNull())
        done = fin if done is None else done.unionByName(fin)
        active = placed.filter(F.col("leaf").isNull()).drop("leaf")
        if last or is_empty(active):
            return done, cut(nodes)
        level, batch = top, min(_BATCH, _MAX_LEVEL - top)


def _cell_gaps(leaf_side: Column, node_side: Column) -> tuple[Column, Column]:
    """Squared smallest and largest distance between cell (cx..) and cell (nx..)."""
    near, far = F.lit(0.0), F.lit(0.0)
    for c, n in zip(CELL, NODE):
        a0, b0 = F.col(c) * leaf_side, F.col(n) * node_side
        a1, b1 = a0 + leaf_side, b0 + node_side
        gap = F.greatest(b0 - a1, a0 - b1, F.lit(0.0))
        span = F.greatest(b1 - a0, a1 - b0)
        near, far = near + gap * gap, far + span * span
    return near, far


def _reachable(leaves: DataFrame, nodes: DataFrame, take: int, root: int) -> DataFrame:
    """(query leaf, candidate leaf, p): leaves that may hold a neighbour within sqrt(r2), with their positions.

    ``leaves`` carries r2, a bound on the k-th squared distance of its queries.
    The ring of cells one ``start`` side wide around the leaf covers that ball;
    coarser cells are looked up too, since a neighbour may sit in a big leaf.
    """
    own = ["scan_id", "leaf", *CELL]
    fits = F.floor(-F.log2(F.greatest(F.sqrt("r2"), F.lit(2.0**-_MAX_LEVEL)))).cast("int")
    start = F.greatest(F.least(fits, F.col("leaf")), F.lit(root))
    ring = leaves.withColumn("start", F.when(F.col("r2") < float("inf"), start).otherwise(F.lit(root)))
    ring = ring.withColumn("node_level", F.explode(F.sequence(F.lit(root), F.col("start"))))
    rise = F.col("start") - F.col("node_level")
    for c, n in zip(CELL, NODE):
        low = F.floor((_up(c, F.col("leaf") - F.col("start")) - 1) * F.pow(F.lit(2.0), -rise))
        high = F.floor((_up(c, F.col("leaf") - F.col("start")) + 1) * F.pow(F.lit(2.0), -rise))
        ring = ring.withColumn(n, F.explode(F.sequence(low.cast("bigint"), high.cast("bigint"))))
    near, far = _cell_gaps(_side(F.col("leaf")), _side(F.col("node_level")))
    by_leaf = Window.partitionBy(*own)
    keep = [*own, "node_level", *NODE, "p", "inner", "r2"]

    def prune(frontier: DataFrame) -> DataFrame:
        frontier = frontier.withColumn("near", near).filter(F.col("near") <= F.col("r2"))
        tight = F.min(F.when(F.col("p") >= take, far * _SLACK)).over(by_leaf)
        return (
            frontier.withColumn("r2", F.least("r2", tight))
            .filter(F.col("near") <= F.col("r2"))
            .select(*keep)
        )

    ring = ring.filter(near <= F.col("r2")).join(nodes, ["scan_id", "node_level", *NODE])
    ring = ring.filter((F.col("node_level") == F.col("start")) | ~F.col("inner"))
    frontier = cut(prune(ring))
    settled = frontier.filter("NOT inner")
    child = nodes.select(
        "scan_id", "node_level", *NODE, "p", "inner",
        (F.col("node_level") - 1).alias("up_level"),
        *[F.shiftright(n, 1).alias(f"up_{n}") for n in NODE],
    )
    while not is_empty(frontier.filter("inner")):
        opened = frontier.filter("inner").select(
            *own, "r2", F.col("node_level").alias("up_level"), *[F.col(n).alias(f"up_{n}") for n in NODE]
        )
        opened = opened.join(child, ["scan_id", "up_level", *[f"up_{n}" for n in NODE]])
        frontier = cut(prune(opened))
        settled = settled.unionByName(frontier.filter("NOT inner"))
    return settled.drop("inner", "r2")


def _first_leaves(frontier: DataFrame, at_leaf: list[str], take: int) -> DataFrame:
    """The candidate leaves of each leaf, nearest by their far ends first, that hold ``take`` positions together."""
    far = _cell_gaps(_side(F.col("leaf")), _side(F.col("node_level")))[1]
    order = Window.partitionBy(*at_leaf).orderBy("far", "node_level", *NODE).rowsBetween(Window.unboundedPreceding, -1)
    ranked = frontier.withColumn("far", far).withColumn("before", F.coalesce(F.sum("p").over(order), F.lit(0)))
    return cut(ranked.filter(F.col("before") < take).drop("far", "before"))


def knn(queries: DataFrame, points: DataFrame, k: int, exclude_self: bool = True) -> DataFrame:
    """Exact k nearest neighbours: (scan_id, point_id, rank, nn_id, distance).

    Ties go to the lower neighbour id.  With ``exclude_self`` the neighbour with
    the query's own point id is left out.  Fewer than k rows come back only when
    the scan has fewer points.
    """
    take = k + 1 if exclude_self else k
    cap = max(3 * take, 16)
    rel = ("ux", "uy", "uz")
    p_sites = sites(points, take)
    one, zero = F.lit(1), F.lit(0)
    if queries is points:
        members = p_sites.select("*", one.alias("is_p"), one.alias("is_q"))
    else:
        q_sites = queries.groupBy("scan_id", *AXES).agg(F.min("point_id").alias("site_id"))
        members = p_sites.select("*", one.alias("is_p"), zero.alias("is_q")).unionByName(
            q_sites.select("*", F.lit(None).cast("array<bigint>").alias("ids"), zero.alias("is_p"), one.alias("is_q"))
        )
    members = cut(members)
    corner = cut(
        members.groupBy("scan_id").agg(
            *[F.min(a).alias(f"o{a}") for a in AXES],
            F.greatest(*[F.max(a) - F.min(a) for a in AXES]).alias("span"),
        )
    )
    span = corner.agg(F.max("span")).first()[0] or 1.0
    root = -(math.floor(math.log2(span)) + 1)
    members = members.join(small(corner.drop("span")), "scan_id").select(
        *members.columns, *[(F.col(a) - F.col(f"o{a}")).alias(u) for a, u in zip(AXES, rel)]
    )
    placed, nodes = _grid_tree(members, take, cap, root)

    leaf_keys = [_key(u, F.col("leaf")).alias(c) for u, c in zip(rel, CELL)]
    at_leaf = ["scan_id", "leaf", *CELL]
    own = ["scan_id", *AXES]
    asked = placed.filter("is_q = 1").select(*own, *rel, "leaf", "reach", *leaf_keys)
    stored = placed.filter("is_p = 1").select(
        "scan_id", "leaf", *leaf_keys, *[F.col(a).alias(f"p{a}") for a in AXES], "site_id", "ids"
    )
    d2 = sum(((F.col(a) - F.col(f"p{a}")) * (F.col(a) - F.col(f"p{a}")) for a in AXES), F.lit(0.0))

    # First bound: the k-th distance inside the query's own leaf (<= cap positions),
    # or else the diagonal of the deepest ancestor with enough positions.
    spark = members.sparkSession
    held = cut(placed.groupBy("scan_id", "leaf", *leaf_keys).agg(F.sum("is_q").alias("q"), F.sum("is_p").alias("n")))
    n = _tasks(spark, held.agg(F.coalesce(F.sum(F.col("q") * F.col("n")), F.lit(0))).first()[0])
    kth = F.min("d2") if take == 1 else F.try_element_at(F.array_sort(F.collect_list("d2")), F.lit(take))
    inside = (
        asked.select(*own, *at_leaf[1:]).repartition(n, *at_leaf)
        .join(many(stored.drop("ids").repartition(n, *at_leaf)), at_leaf)
        .select(*own, d2.alias("d2")).groupBy(*own).agg(kth.alias("kth"))
    )
    diagonal = F.when(F.col("reach") < root, F.lit(float("inf"))).otherwise(
        3.0 * _side(F.col("reach")) * _side(F.col("reach"))
    )
    asked = cut(
        asked.join(inside, own, "left")
        .withColumn("r2", F.coalesce(F.col("kth"), diagonal) * _SLACK + 1e-18)
        .drop("kth", "reach")
    )
    leaves = asked.groupBy(*at_leaf).agg(F.max("r2").alias("r2"))
    frontier = _reachable(leaves, nodes, take, root)
    stored = stored.withColumnsRenamed({"leaf": "node_level", **dict(zip(CELL, NODE))})
    at_node = ["scan_id", "node_level", *NODE]
    # A leaf with fewer than ``take`` positions has a diagonal for a bound; where that makes many pairs, its queries get a distance.
    short = frontier.join(held.filter(F.col("n") < take), at_leaf)
    if (short.agg(F.sum(F.col("q") * F.col("p"))).first()[0] or 0) > _PAIRS_UNBOUND:
        first = _first_leaves(short, at_leaf, take)
        n = _tasks(spark, first.agg(F.sum(F.col("q") * F.col("p"))).first()[0])
        found = (
            asked.join(first.select(*at_leaf, *at_node[1:]), at_leaf).select(*own, *at_node[1:]).repartition(n, *at_node)
            .join(many(stored.drop("ids").repartition(n, *at_node)), at_node)
            .select(*own, d2.alias("d2")).groupBy(*own).agg(kth.alias("kth"))
        )
        asked = cut(asked.join(found, own, "left").withColumn("r2", F.least("r2", F.col("kth") * _SLACK + 1e-18)).drop("kth"))
        least = asked.groupBy(*at_leaf).agg(F.max("r2").alias("r2"))
        frontier = cut(frontier.join(least, at_leaf).filter(_cell_gaps(_side(F.col("leaf")), _side(F.col("node_level")))[0] <= F.col("r2")).drop("r2"))

    node_side = _side(F.col("node_level"))
    gap2 = F.lit(0.0)
    for u, n in zip(rel, NODE):
        low = F.col(n) * node_side
        gap = F.greatest(low - F.col(u), F.col(u) - (low + node_side), F.lit(0.0))
        gap2 = gap2 + gap * gap
    n = _tasks(spark, frontier.join(held, at_leaf).agg(F.coalesce(F.sum(F.col("q") * F.col("p")), F.lit(0))).first()[0])
    pairs = (
        asked.join(frontier.drop("p"), at_leaf)
        .filter(gap2 <= F.col("r2"))
        .select(*own, "node_level", *NODE, "r2")
        .repartition(n, *at_node).join(many(stored.repartition(n, *at_node)), at_node)
        .select(*own, d2.alias("d2"), "site_id", "ids", "r2")
        .filter(F.col("d2") <= F.col("r2"))
    )
    if take == 1:
        best = pairs.groupBy(*own).agg(F.min(F.struct("d2", "site_id")).alias("b"))
        lists = best.select(
            *own, F.array(F.struct(F.col("b.d2").alias("d2"), F.col("b.site_id").alias("id"))).alias("near")
        )
    else:
        order = Window.partitionBy(*own).orderBy("d2", "site_id")
        best = pairs.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= take)
        lists = best.groupBy(*own).agg(F.collect_list(F.struct("d2", "ids")).alias("near"))
        flat = F.flatten(
            F.transform(
                "near",
                lambda s: F.transform(s["ids"], lambda i: F.struct(s["d2"].alias("d2"), i.alias("id"))),
            )
        )
        lists = lists.select(*own, F.slice(F.array_sort(flat), 1, take).alias("near"))
    near = F.col("near")
    if exclude_self:
        near = F.filter(near, lambda s: s["id"] != F.col("point_id"))
    return (
        queries.select("scan_id", "point_id", *AXES)
        .join(lists, own)
        .select("scan_id", "point_id", F.posexplode(F.slice(near, 1, k)).alias("pos", "nb"))
        .select(
            "scan_id", "point_id",
            (F.col("pos") + 1).alias("rank"),
            F.col("nb.id").alias("nn_id"),
            F.sqrt("nb.d2").alias("distance"),
        )
    )


def nearest_neighbor(queries: DataFrame, points: DataFrame) -> DataFrame:
    """(scan_id, point_id, nn_id, distance): the closest ``points`` row per query."""
    return knn(queries, points, 1, exclude_self=False).drop("rank")


def radius_pairs(a: DataFrame, b: DataFrame, radius: float, a_cols=(), b_cols=()) -> DataFrame:
    """All (a_id, b_id, d2) within ``radius``, with ``a_cols`` as a_... and ``b_cols`` as b_...; as large as the answer.

    The side is one cell per radius, so each a-row meets its 27 cells only.  Tasks are dealt cells by the pairs they
    make; the a-rows of a cell with too many for one task are dealt to several.
    """
    left = a.select("scan_id", F.col("point_id").alias("a_id"), *[F.col(c).alias(f"a_{c}") for c in a_cols], *[F.col(c).alias(f"a{c}") for c in AXES])
    for axis, c in zip(AXES, CELL):
        home = F.floor(F.col(f"a{axis}") / radius)
        left = left.withColumn(c, F.explode(F.sequence(home - 1, home + 1)))
    right = b.select(
        "scan_id", F.col("point_id").alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in b_cols], *[F.col(c).alias(f"b{c}") for c in AXES],
        *[F.floor(F.col(v) / radius).alias(c) for v, c in zip(AXES, CELL)],
    )
    d2 = sum(((F.col(f"a{c}") - F.col(f"b{c}")) * (F.col(f"a{c}") - F.col(f"b{c}")) for c in AXES), F.lit(0.0))
    at = ["scan_id", *CELL]
    met = left.groupBy(*at).agg(F.count("*").alias("l")).join(right.groupBy(*at).agg(F.count("*").alias("r")), at)
    met = cut(met.select(*at, (F.col("l") * F.col("r")).alias("pairs")))
    pairs, most = met.agg(F.coalesce(F.sum("pairs"), F.lit(0)), F.coalesce(F.max("pairs"), F.lit(0))).first()
    if most > _PAIRS_A_TASK:
        parts = met.filter(F.col("pairs") > _PAIRS_A_TASK).select(*at, F.ceil(F.col("pairs") / _PAIRS_A_TASK).cast("int").alias("parts"))
        parts = small(parts)
        left = left.join(parts, at, "left").withColumn("part", F.pmod(F.xxhash64("a_id"), F.coalesce("parts", F.lit(1))).cast("int"))
        right = right.join(parts, at, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        at = [*at, "part"]
    n = _tasks(a.sparkSession, pairs)
    return (
        left.repartition(n, *at).join(many(right.repartition(n, *at)), at)
        .select("scan_id", "a_id", "b_id", *[f"a_{c}" for c in a_cols], *[f"b_{c}" for c in b_cols], d2.alias("d2"))
        .filter(F.col("d2") <= radius * radius)
    )


def radius_join(points: DataFrame, radius: float) -> DataFrame:
    """Unordered pairs (a_id < b_id) within ``radius`` with their distance."""
    return (
        radius_pairs(points, points, radius)
        .filter(F.col("a_id") < F.col("b_id"))
        .select("scan_id", "a_id", "b_id", F.sqrt("d2").alias("distance"))
    )
