"""Near-duplicate vectors through an inverted multi-index.

The two halves of a unit vector have codebooks of their own; their product is a grid of cells.  Every vector is filed in
its nearest cell, its home, and also visits further cells: the multi-sequence traversal merges the two sorted lists of
centroid distances, nearest cell first, until the distance exceeds that of the home by a margin.  The margin is the one at
which, of held-out vectors turned to exactly the least wanted similarity, the target share meets (either visits the
other's home).  Vectors closer than that meet more often.

Vectors that met are compared inside their cell, as bytes with a known rounding error; pairs too close to the limit for
bytes are compared again in double precision, so a link is never wrong.  A pair is counted on the side that visits; a
member adds visitors whose home it does not visit itself, so every pair counts once for each of its two vectors.

Equal vectors are one node with a weight.  A cell of more than ``TILE`` entries is cut into bins by the angle to its mean:
bins whose angles add up to less than the limit link as a whole, so a large group of near copies is counted by bins and
chained to one node without a pair; bins too far apart are left out; what is between is compared tile by tile.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import cut, small
from .common import NARROW_ROWS
from .vectors import finite

#: Nodes that codebooks are fitted on, at most, and rows of it turned to set the margin.
SAMPLE, TURNED = 16_384, 2_000
#: Members of a cell, on average, and centroids of a half, at most.
MEMBERS, CENTROIDS = 64, 512
#: Share of the pairs at the least similarity that must meet.
TARGET = 0.95
#: Entries of a cell that are compared at once; larger cells are cut into bins.
TILE = 1024
#: Bins of angles up to the limit.
BINS = 16
ENTRY = "cell long, node long, home long, w long, scale float, eps float, bytes binary, visits array<long>"
FOUND = "kind int, a long, b long, n long"


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def means(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    """k-means centroids; an unused one stays."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = distances(x, c).argmin(axis=1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (c * c).sum(axis=1) - 2 * (x @ c.T)  # less |x|^2, which all centroids share


class Grid:
    """Codebooks of the halves and the margin of the traversal."""

    def __init__(self, sample: np.ndarray, k: int, least: float, target: float = TARGET, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.half = sample.shape[1] // 2
        self.books = [means(np.ascontiguousarray(h), k, rng) for h in (sample[:, :self.half], sample[:, self.half:])]
        self.margin = self._margin(sample[rng.choice(len(sample), min(TURNED, len(sample)), replace=False)], least, target, rng)

    def excess(self, x: np.ndarray) -> list[np.ndarray]:
        """Per half: how much farther each centroid is than the nearest."""
        out = []
        for h, c in zip((x[:, :self.half], x[:, self.half:]), self.books):
            d = distances(h, c)
            out.append(d - d.min(axis=1, keepdims=True))
        return out

    def _margin(self, x: np.ndarray, least: float, target: float, rng) -> float:
        if x.shape[1] < 2:
            return 4.0
        away = rng.normal(size=x.shape)
        away -= (away * x).sum(axis=1, keepdims=True) * x
        y = least * x + math.sqrt(max(0.0, 1 - least * least)) * unit(away)
        ex, ey, rows = self.excess(x), self.excess(y), np.arange(len(x))
        seen = lambda e, other: sum(h[rows, o.argmin(axis=1)] for h, o in zip(e, other))
        return float(np.quantile(np.minimum(seen(ex, ey), seen(ey, ex)), target)) + 1e-12

    def traverse(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of every visit within the margin, nearest first within a row; a row's first cell is its home.

        All rows advance together: each step takes the head of least distance from the merged lists of every row.
        """
        one, two = self.excess(x)
        by1, by2 = np.argsort(one, axis=1, kind="stable"), np.argsort(two, axis=1, kind="stable")
        s1, s2 = np.take_along_axis(one, by1, axis=1), np.take_along_axis(two, by2, axis=1)
        width = int((s1 <= self.margin).sum(axis=1).max(initial=1))
        s1, s2 = s1[:, :width], np.hstack([s2, np.full((len(x), 1), np.inf)])
        head, live = np.zeros((len(x), width), np.int64), np.arange(len(x))
        rows, cells = [], []
        while len(live):
            sums = s1[live] + np.take_along_axis(s2[live], head[live], axis=1)
            pick = sums.argmin(axis=1)
            ok = sums[np.arange(len(live)), pick] <= self.margin
            live, pick = live[ok], pick[ok]
            at = head[live, pick]
            rows.append(live)
            cells.append(by1[live, pick] * len(self.books[1]) + by2[live, at])
            head[live, pick] += 1
        row, cell = np.concatenate(rows), np.concatenate(cells)
        order = np.argsort(row, kind="stable")
        return row[order], cell[order]


def as_bytes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, scale, length of the rounding error) of unit rows."""
    scale = (np.abs(x).max(axis=1) / 127).astype(np.float32)
    q = np.rint(x / scale[:, None]).clip(-127, 127).astype(np.int8)
    off = x - q * scale[:, None].astype(np.float64)
    return q, scale, (np.sqrt((off * off).sum(axis=1)) * (1 + 1e-6) + 1e-9).astype(np.float32)


def _units(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit(flat.reshape(len(column), -1)) if len(column) else np.empty((0, 1))


def _sizes(grid: Grid):
    """Of a task: entries per cell, and the largest rounding error as that of cell -1, in billionths."""

    def run(batches):
        count: dict[int, int] = {}
        worst = 0.0
        for batch in batches:
            x = _units(batch.column(0))
            if not len(x):
                continue
            worst = max(worst, float(as_bytes(x)[2].max()))
            for cell, n in zip(*(v.tolist() for v in np.unique(grid.traverse(x)[1], return_counts=True))):
                count[cell] = count.get(cell, 0) + n
        cells = [*count, -1]
        yield pa.record_batch([pa.array(cells, pa.int64()), pa.array([*count.values(), math.ceil(worst * 1e9)], pa.int64())], names=["cell", "n"])

    return run


def _entries(grid: Grid):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                some = batch.slice(lo, 2048)
                x = _units(some.column(2))
                if not len(x):
                    continue
                row, cell = grid.traverse(x)
                q, scale, eps = as_bytes(x)
                first = np.flatnonzero(np.diff(row, prepend=-1))
                ends = np.append(first[1:], len(row))
                home = cell[first][row]
                member = np.zeros(len(row), bool)
                member[first] = True
                # Only the row filed at home carries the cells it visits.
                sizes = np.where(member, (ends - first)[row] - 1, 0)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                raw = [r.tobytes() for r in q]
                cols = [cell, some.column(0).to_numpy()[row], home, some.column(1).to_numpy()[row], scale[row], eps[row]]
                yield pa.record_batch([*map(pa.array, cols), pa.array([raw[r] for r in row.tolist()], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(cell[~member]))], names=ENTRY.replace(",", "").split()[::2])

    return run


def _roots(yes: np.ndarray, left: np.ndarray, right: np.ndarray):
    """(node, smallest node of its component) in the graph of the pairs of a tile."""
    rows, cols = np.flatnonzero(yes.any(axis=1)), np.flatnonzero(yes.any(axis=0))
    if not len(rows):
        return left[:0], left[:0]
    yes, left, right = yes[np.ix_(rows, cols)], left[rows], right[cols]
    low, of_right, most = left.copy(), right.copy(), np.iinfo(np.int64).max
    while True:
        new_right = np.minimum(of_right, np.where(yes, low[:, None], most).min(axis=0))
        new_left = np.minimum(low, np.where(yes, new_right[None, :], most).min(axis=1))
        if (new_right == of_right).all() and (new_left == low).all():
            break
        low, of_right = new_left, new_right
    node, root = np.concatenate([left, right]), np.concatenate([low, of_right])
    keep = node != root
    return node[keep], root[keep]


def _compare(least: float):
    """Compares the left rows of a tile with its right rows, which are members of the cell."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        col = {c: table.column(c).to_numpy() for c in ("node", "home", "w", "scale", "eps", "left", "right", "cell")}
        q = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.int8).reshape(table.num_rows, -1)
        x = q.astype(np.float32) * col["scale"][:, None]
        li, ri = np.flatnonzero(col["left"]), np.flatnonzero(col["right"])
        node, eps = col["node"], col["eps"].astype(np.float64)
        dot = (x[li] @ x[ri].T).astype(np.float64)
        slack = eps[li][:, None] * (1 + eps[ri]) + eps[ri] * (1 + eps[li][:, None]) + 1e-5
        other = node[li][:, None] != node[ri]
        yes = (dot - slack >= least) & other
        doubt = (dot + slack >= least) & other & ~yes
        out = [np.empty((4, 0), np.int64)]
        if yes.any() or doubt.any():
            visitor = col["home"][li] != col["cell"][li]
            visits, once = table.column("visits").to_pylist(), np.zeros_like(yes)
            homes, of = np.unique(col["home"][li], return_inverse=True)
            for j, r in enumerate(ri.tolist()):  # pairs that the member does not find by a visit of its own
                once[:, j] = visitor & ~np.isin(homes, visits[r] or [])[of]
            w = col["w"].astype(np.int64)
            n_left, n_right = yes.astype(np.int64) @ w[ri], w[li] @ (yes & once).astype(np.int64)
            for nodes, n in ((node[li], n_left), (node[ri], n_right)):
                hit = n > 0
                out.append(np.stack([np.zeros(hit.sum(), np.int64), nodes[hit], nodes[hit], n[hit]]))
            a, root = _roots(yes, node[li], node[ri])
            out.append(np.stack([np.ones(len(a), np.int64), a, root, a * 0]))
            dl, dr = np.nonzero(doubt)
            out.append(np.stack([np.full(len(dl), 2), node[li][dl], node[ri][dr], once[dl, dr].astype(np.int64)]))
        kind, a, b, n = np.concatenate(out, axis=1)
        return pa.table({"kind": pa.array(kind.astype(np.int32)), "a": pa.array(a), "b": pa.array(b), "n": pa.array(n)})

    return run


def _verify(least: float):
    """Of pairs with their vectors: those that reach the limit in double precision."""

    def run(batches):
        for batch in batches:
            ok = (_units(batch.column(4)) * _units(batch.column(5))).sum(axis=1) >= least if batch.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["a", "b", "n", "both"]).filter(pa.array(ok))

    return run


def _pivots(hot: DataFrame) -> DataFrame:
    """(cell, pivot): the mean of the members of each large cell, from one sum per cell and dimension of each task."""

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            q = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int8).reshape(batch.num_rows, -1) if batch.num_rows else []
            for cell, row, scale in zip(batch.column(0).to_pylist(), q, batch.column(2).to_pylist()):
                part = row.astype(np.float64) * scale
                total[cell] = total[cell] + part if cell in total else part
        d = len(next(iter(total.values()))) if total else 0
        yield pa.record_batch([pa.array(np.repeat(np.array([*total], np.int64), d)), pa.array(np.tile(np.arange(d), len(total)), pa.int64()), pa.array(np.concatenate([*total.values()]) if total else [], pa.float64())], names=["cell", "at", "s"])

    parts = hot.filter("home = cell").select("cell", "bytes", "scale").mapInArrow(sums, "cell long, at long, s double")
    parts = parts.groupBy("cell", "at").agg(F.sum("s").alias("s"))
    return parts.groupBy("cell").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "s"))), lambda z: z["s"]).alias("pivot"))


def _angles(batches):
    """Adds the angle of each entry to the pivot of its cell."""
    for batch in batches:
        pivots = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        q = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int8).reshape(pivots.shape).astype(np.float64)
        size = np.sqrt((q * q).sum(axis=1) * (pivots * pivots).sum(axis=1))
        cos = np.where(size > 0, (q * pivots).sum(axis=1) / np.maximum(size, 1e-300), 0.0)
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], batch.column(0), pa.array(np.arccos(cos.clip(-1, 1)))], names=[*batch.schema.names[2:], "bytes", "angle"])


def _large_cells(hot: DataFrame, least: float, worst: float) -> tuple[DataFrame, DataFrame]:
    """(tiles, found) of the entries of large cells: what must be compared, and what angles to the pivot settle."""
    limit = math.acos(least)
    slack = 4 * worst + 1e-6  # bytes turn a vector by less than twice the length of their error
    step = limit / BINS
    sure, reach = math.floor((limit - slack) / step) - 2, math.ceil((limit + slack) / step) + 1
    names = ["cell", "node", "home", "w", "scale", "eps", "visits"]
    turned = hot.join(small(cut(_pivots(hot)), NARROW_ROWS // 64), "cell").select("bytes", "pivot", *names)
    kinds = dict(hot.dtypes)
    turned = turned.mapInArrow(_angles, ", ".join(f"{c} {kinds[c]}" for c in names) + ", bytes binary, angle double")
    rows = cut(turned.withColumn("bin", F.floor(F.col("angle") / step).cast("int")).drop("angle"))
    narrow, member = rows.drop("bytes", "scale", "eps"), F.col("home") == F.col("cell")

    def within(sets: DataFrame, *key: str) -> DataFrame:
        """Weight of the rows of a set that link with everything in bin i, for each i."""
        held = sets.filter(F.col("bin") <= sure).groupBy(*key, "bin").agg(F.sum("w").alias("w"))
        spread = held.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(sure) - F.col("bin"))))
        return spread.groupBy(*key, "i").agg(F.sum("w").alias("total"))

    own = F.when(member & (2 * F.col("bin") <= sure), F.col("w")).otherwise(0)
    here = narrow.withColumnRenamed("bin", "i")
    to_members = here.join(small(cut(within(narrow.filter(member), "cell"))), ["cell", "i"]).withColumnRenamed("i", "bin").select("node", (F.col("total") - own).alias("n"))
    inside = here.filter(member)
    to_visitors = inside.join(small(cut(within(narrow.filter(~member), "cell"))), ["cell", "i"]).select("node", F.col("total").alias("n"))
    both_ways = inside.select("cell", "i", "node", F.explode("visits").alias("home")).join(within(narrow.filter(~member), "cell", "home"), ["cell", "home", "i"]).select("node", (-F.col("total")).alias("n"))
    counts = to_members.unionAll(to_visitors).unionAll(both_ways).select(F.lit(0).alias("kind"), F.col("node").alias("a"), F.col("node").alias("b"), "n")
    # Chains: everything to the innermost member, members also to the innermost visitor.
    first = lambda some: F.min(F.when(some, F.struct("bin", "node")))
    heads = small(cut(narrow.groupBy("cell").agg(first(member).alias("m"), first(~member).alias("v"))))
    chained = narrow.join(heads, "cell")
    edge = lambda to: chained.filter((F.col("bin") + F.col(f"{to}.bin") <= sure) & (F.col("node") != F.col(f"{to}.node"))).select(F.lit(1).alias("kind"), F.col("node").alias("a"), F.col(f"{to}.node").alias("b"), F.lit(0).cast("long").alias("n"))
    chained_v = edge("v").join(narrow.filter(member).select(F.col("node").alias("a")).distinct(), "a", "left_semi").select("kind", "a", "b", "n")
    # What neither links nor parts as a whole is compared, bin against bin, in blocks.
    blocks = lambda n: F.ceil(n / F.lit(TILE // 2)).cast("int")
    bins = cut(narrow.groupBy("cell", "bin").agg(blocks(F.count(F.lit(1))).alias("nl"), blocks(F.count(F.when(member, 1))).alias("nr")))
    lefts, rights = bins.select("cell", F.col("bin").alias("i"), "nl"), bins.filter("nr > 0").select("cell", F.col("bin").alias("j"), "nr")
    open_bins = lefts.join(rights, "cell").filter((F.col("i") + F.col("j") > sure) & (F.abs(F.col("i") - F.col("j")) <= reach))
    open_bins = small(cut(open_bins))
    to = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["i", "j", "lb", "rb"]
    left = rows.withColumnRenamed("bin", "i").join(open_bins, ["cell", "i"]).withColumns({"lb": to("nl"), "left": F.lit(True), "right": F.lit(False)}).withColumn("rb", each("nr"))
    right = rows.filter(member).withColumnRenamed("bin", "j").join(open_bins, ["cell", "j"]).withColumns({"rb": to("nr"), "left": F.lit(False), "right": F.lit(True)}).withColumn("lb", each("nl"))
    cols = [*key, "left", "right", *names, "bytes"]
    return left.select(cols).unionByName(right.select(cols)), counts.unionAll(edge("m")).unionAll(chained_v)


def near_nodes(nodes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(node, n) and (a, b): weight of the other nodes linked with each, and edges that chain what is linked.

    ``nodes`` is (node, k1, w, vec) with unique nodes and non-zero finite vectors of one width.
    """
    spark = nodes.sparkSession
    total = nodes.count()
    sample = [r["vec"] for r in nodes.orderBy(F.xxhash64("k1"), "node").limit(SAMPLE).select("vec").collect()]
    if total < 2:
        return spark.createDataFrame([], "node long, n long"), spark.createDataFrame([], "a long, b long")
    k = min(CENTROIDS, max(1, len(sample) // 16), math.ceil(math.sqrt(total / MEMBERS)))
    grid = Grid(unit(np.array(sample, np.float64)), k, least)
    sizes = cut(nodes.select("vec").mapInArrow(_sizes(grid), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"), F.max("n").alias("most")))
    worst = sizes.filter("cell = -1").first()["most"] / 1e9
    large = sizes.filter((F.col("cell") >= 0) & (F.col("n") > TILE)).select("cell")
    entries = nodes.select("node", "w", "vec").mapInArrow(_entries(grid), ENTRY)
    zero = F.lit(0)
    found = None
    if not large.isEmpty():
        large = small(large)
        hot = cut(entries.join(large, "cell", "left_semi"))
        entries = entries.join(large, "cell", "left_anti")
        tiles, found = _large_cells(hot, least, worst)
        found = cut(found)
    rows = entries.withColumns({"i": zero, "j": zero, "lb": zero, "rb": zero, "left": F.lit(True), "right": F.col("home") == F.col("cell")})
    if found is not None:
        rows = rows.unionByName(tiles)
    compared = cut(rows.groupBy("cell", "i", "j", "lb", "rb").applyInArrow(_compare(least), FOUND))
    found = compared.filter("kind < 2") if found is None else compared.filter("kind < 2").unionByName(found)
    doubts = cut(compared.filter("kind = 2").distinct())
    counts, edges = found.filter("kind = 0").select("a", "n"), found.filter("kind = 1").select("a", "b")
    if not doubts.isEmpty():
        ids = small(cut(doubts.select("a").union(doubts.select("b")).distinct()), NARROW_ROWS)
        exact = cut(nodes.join(ids, F.col("node") == F.col("a"), "left_semi").select("node", "w", "vec"))
        one = lambda to: exact.select(F.col("node").alias(to), F.col("w").alias(f"w{to}"), F.col("vec").alias(f"v{to}"))
        pairs = doubts.select("a", "b", F.col("n").alias("both")).join(one("a"), "a").join(one("b"), "b")
        linked = cut(pairs.select("a", "b", F.col("wb").alias("n"), F.when(F.col("both") > 0, F.col("wa")).otherwise(0).alias("both"), "va", "vb").mapInArrow(_verify(least), "a long, b long, n long, both long"))
        counts = counts.unionAll(linked.select("a", "n")).unionAll(linked.select(F.col("b").alias("a"), F.col("both").alias("n")))
        edges = edges.unionAll(linked.select("a", "b"))
    return counts.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n")), edges


def near_vectors(df: DataFrame, least: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of ``df``, linked at a cosine of ``least`` or more.

    Vectors that are null, zero, or hold a null or non-finite component link with nothing.  A null vec_id takes part; its
    component_id is null only where no row of the component has an id, and it is kept only alone.  Repeated rows are
    vectors of their own: they link with each other, and of rows that repeat the smallest id all are kept.  Other columns
    are not read; an empty table gives no rows.  Vectors of several widths are an error.  Equal vectors are recognised by
    128-bit digests.
    """
    vec = F.col("embedding")
    good = finite(vec) & F.exists(vec, lambda x: x != 0)
    rows = df.select(F.col("vec_id").cast("long").alias("id"), vec.alias("vec"), good.alias("good"))
    keyed = rows.filter("good").select("id", "vec", F.xxhash64("vec").alias("k1"), F.xxhash64(F.lit("second"), F.reverse("vec")).alias("k2"))
    low, high = keyed.agg(F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if low != high:
        raise ValueError(f"vectors of {low} and {high} components in one table")
    key = ["k1", "k2"]
    groups = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("low"))
    again = cut(groups.filter("c > 1"))
    some = small(again, NARROW_ROWS // 2)
    once = keyed.join(some.select(*key), key, "left_anti").select(*key, F.lit(1).cast("long").alias("w"), "vec", F.col("id").alias("low"))
    # Of equal vectors only one travels from each task.
    shared = keyed.join(some.select(*key), key, "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias("w"), F.first("vec").alias("vec"), F.min("id").alias("low"))
    nodes = cut(once.unionByName(shared.select(*once.columns)).withColumn("node", F.monotonically_increasing_id()))
    counts, edges = near_nodes(nodes, least)
    names = nodes.select("node", *key, "w", "low")
    got = names.join(counts, "node", "left").join(connected_components(edges), "node", "left").withColumn("root", F.coalesce("component", "node"))
    least_ids = got.filter("component IS NOT NULL").groupBy("root").agg(F.min("low").alias("least"))
    got = cut(got.join(small(cut(least_ids), NARROW_ROWS), "root", "left").select(*key, (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.when(F.col("component").isNull(), F.col("low")).otherwise(F.col("least")).alias("component_id")))
    # Most vectors are alone: only the others are looked up.
    linked = got.filter("n_links > 0")
    ids = keyed.select("id", *key).join(small(linked, NARROW_ROWS // 4), key, "left")
    alone = F.col("n_links").isNull()
    ids = ids.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    rest = rows.filter("NOT good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return ids.unionByName(rest).select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
