"""Hard negatives by Fagin's threshold algorithm over shards of integer vectors.

The index is cut into shards of about ``SHARD`` rows, mostly of one label each.  A shard keeps, per dimension, its rows
sorted by that component.  Anchors meet every shard in blocks.  For a block, the sorted lists are read in rounds of growing
depth from both ends; every row seen for the first time is scored by its whole integer inner product.  An anchor reads a
list from the top where its own component is positive and from the bottom where it is negative, so after each round no row
unseen can score above the sum of its components times the last values read: the threshold.  A list of wanted rows is
done once the threshold lies strictly below its kth score (or its window), and an anchor leaves when all its lists are done.

A first wave searches one shard in ``WAVE``; its merged kth scores are lower bounds for all other shards, which are then
left at once by most anchors where the data allow it, and which give back only rows that can still count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, small
from .vectors import clean_rows, matrix, width_of

#: Rows of a shard and anchors of a block, on average.
SHARD, BLOCK = 1024, 1024
#: Shards of one task; bounds what an Arrow batch holds.
SHARDS_A_TASK = 8
#: Blocks of anchors that go through the shards in one pass; bounds what is broadcast.
PASS = 32
#: One shard in so many is searched first.
WAVE = 16
NONE = np.iinfo(np.int64).min
SHARD_SCHEMA = "shard long, n int, ids binary, labels binary, vecs binary, places binary"


def _pack(width: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        n = table.num_rows
        ids, labels = (table.column(c).to_numpy() for c in ("id", "label"))
        vecs = matrix(table.column("ints").chunk(0), width).astype(np.int32) if n else np.empty((0, width), np.int32)
        places = np.argsort(vecs, axis=0, kind="stable").astype(np.int32)
        cells = [ids.astype(np.int64), labels.astype(np.int64), vecs, places]
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int64()), "n": pa.array([n], pa.int32())} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in zip(("ids", "labels", "vecs", "places"), cells)})

    return run


def build_shards(rows: DataFrame, width: int) -> DataFrame:
    """Packed shards of (id, label, ints): a frequent label is dealt by id, rare ones share a shard."""
    sizes = rows.groupBy(F.col("label").alias("of")).agg(F.count(F.lit(1)).alias("size"))
    sizes = cut(sizes)
    total = sizes.agg(F.sum("size")).first()[0] or 0
    often = F.col("size") >= SHARD
    deal = F.when(often, F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / SHARD))).otherwise(F.pmod(F.xxhash64("label"), F.lit(total // SHARD + 1)))
    dealt = rows.join(small(sizes), F.col("label") == F.col("of")).select("id", "label", "ints", F.xxhash64(F.when(often, F.col("label")), deal).alias("shard"))
    return cut(dealt.groupBy("shard").applyInArrow(_pack(width), SHARD_SCHEMA))


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers; through floating point only where that is exact."""
    most = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    if most >= 1 << 63:
        raise ValueError("inner products leave 64 bits")
    return (a.astype(kind) @ b.T.astype(kind)).astype(np.int64)


class Lists:
    """The best rows so far of every anchor of a block and each of its windows, by score and then smaller id."""

    def __init__(self, low: np.ndarray, high: np.ndarray, need: np.ndarray, k: int):
        self.low, self.high = low, high
        self.need = np.maximum(low, need)  # scores below this cannot count
        self.score = np.full((*low.shape, k), NONE, np.int64)
        self.id = np.full((*low.shape, k), np.iinfo(np.int64).max, np.int64)

    def open(self, anchors: np.ndarray, threshold: np.ndarray) -> np.ndarray:
        """The anchors with a window that a row scoring up to the threshold could still enter."""
        return anchors[((threshold[:, None] >= self.need[anchors]) & (self.low[anchors] <= self.high[anchors])).any(axis=1)]

    def add(self, anchors: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Offers rows; ``scores`` is (anchors, rows), with NONE where a row is not for an anchor."""
        k = self.score.shape[2]
        for w in range(self.low.shape[1]):
            fit = np.where((scores >= self.need[anchors, w, None]) & (scores <= self.high[anchors, w, None]), scores, NONE)
            if fit.shape[1] > k:
                fit = np.where(fit >= np.partition(fit, fit.shape[1] - k, axis=1)[:, fit.shape[1] - k, None], fit, NONE)
            a, r = np.nonzero(fit > NONE)
            if not len(a):
                continue
            hit = np.unique(a)
            who = anchors[hit]
            all_a = np.concatenate([np.searchsorted(hit, a), np.repeat(np.arange(len(hit)), k)])
            all_s = np.concatenate([fit[a, r], self.score[who, w].ravel()])
            all_i = np.concatenate([ids[r], self.id[who, w].ravel()])
            order = np.lexsort((all_i, -np.maximum(all_s, -(1 << 62)), all_a))
            at = np.arange(len(order)) - np.searchsorted(all_a[order], all_a[order], side="left")
            best = order[at < k]
            self.score[who, w], self.id[who, w] = all_s[best].reshape(-1, k), all_i[best].reshape(-1, k)
            last = self.score[who, w, k - 1]
            self.need[who, w] = np.maximum(self.need[who, w], last)


def depths(n: int) -> list[int]:
    """Reading depths of a shard's lists: all rows are seen at the last."""
    out = [max(1, n >> s) for s in (7, 5, 3)] + [n]
    return sorted(set(out))


def search_shard(ids, labels, vecs, places, a_ids, a_labels, a_vecs, lists: Lists, same: bool) -> int:
    """Puts the shard's rows that count into ``lists``; returns how many were scored."""
    n = len(ids)
    live = np.arange(len(a_ids))
    tops = np.take_along_axis(vecs, places, axis=0).astype(np.int64)  # sorted components
    up, down = np.maximum(a_vecs, 0), np.minimum(a_vecs, 0)
    seen, scored = np.zeros(n, bool), 0
    threshold = _exact(up, tops[n - 1:n])[:, 0] + _exact(down, tops[:1])[:, 0]  # of the first values in the lists
    live = lists.open(live, threshold[live])
    for depth in depths(n):
        if not len(live):
            break
        fresh = np.zeros(n, bool)
        fresh[places[n - depth:].ravel()] = True
        fresh[places[:depth].ravel()] = True
        fresh &= ~seen
        seen |= fresh
        rows = np.flatnonzero(fresh)
        scored += len(rows)
        if len(rows):
            scores = _exact(a_vecs[live], vecs[rows])
            right = (labels[rows] == a_labels[live, None]) if same else (labels[rows] != a_labels[live, None])
            scores[~right | (ids[rows] == a_ids[live, None])] = NONE
            lists.add(live, ids[rows], scores)
        if seen.all():
            break
        threshold = _exact(up[live], tops[n - depth:n - depth + 1])[:, 0] + _exact(down[live], tops[depth - 1:depth])[:, 0]
        live = lists.open(live, threshold)
    return scored


def _search(width: int, windows: int, k: int, same: bool):
    """Rows of (shard, block of anchors) to (anchor, window, id, score): the best of a task."""

    def run(batches):
        blocks: dict[int, tuple] = {}
        for batch in batches:
            raw = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            of = lambda name, i, kind=np.int64: np.frombuffer(raw[name][i].as_buffer(), kind)
            for i in range(batch.num_rows):
                block = raw["block"][i].as_py()
                if block not in blocks:
                    shape = lambda name: of(name, i).reshape(-1, windows).copy()
                    lists = Lists(shape("low"), shape("high"), shape("need"), k)
                    blocks[block] = (of("a_uid", i).copy(), of("a_ids", i).copy(), of("a_labels", i).copy(), of("a_vecs", i, np.int32).reshape(-1, width).astype(np.int64), lists)
                _, a_ids, a_labels, a_vecs, lists = blocks[block]
                labels = of("labels", i)
                if same and not np.isin(labels, a_labels).any():
                    continue
                square = lambda name: of(name, i, np.int32).reshape(-1, width)
                search_shard(of("ids", i), labels, square("vecs"), square("places"), a_ids, a_labels, a_vecs, lists, same)
        for uid, _, _, _, lists in blocks.values():
            a, w, j = np.nonzero(lists.score > NONE)
            yield pa.record_batch([pa.array(uid[a]), pa.array(w.astype(np.int32)), pa.array(lists.id[a, w, j]), pa.array(lists.score[a, w, j])], names=["uid", "list", "id", "score"])

    return run


def _block(width: int, windows: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        col = lambda name: table.column(name).to_numpy().astype(np.int64).tobytes()
        flat = lambda name: table.column(name).chunk(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).tobytes()
        vecs = matrix(table.column("ints").chunk(0), width).astype(np.int32).tobytes()
        cells = {"a_uid": col("uid"), "a_ids": col("id"), "a_labels": col("label"), "a_vecs": vecs, "low": flat("low"), "high": flat("high"), "need": flat("need")}
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int64())} | {k: pa.array([v], pa.binary()) for k, v in cells.items()})

    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The first k per anchor and list, with their rank; Spark limits each task's rows before the shuffle."""
    order = Window.partitionBy("uid", "list").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(shards: DataFrame, anchors: DataFrame, width: int, windows: int, k: int, same: bool) -> DataFrame:
    """(uid, list, id, score, rank): per anchor and window the k best rows of all shards.

    ``anchors`` is (uid, id, label, ints, low, high): arrays of ``windows`` bounds.  ``same`` asks for rows of the anchor's
    label, otherwise for rows of other labels; rows with the anchor's id never count.
    """
    n_shards, n = shards.count(), anchors.count()
    if not n_shards or not n:
        return shards.sparkSession.createDataFrame([], "uid long, list int, id long, score long, rank int")
    n_blocks = -(-n // BLOCK)
    wave = F.pmod(F.xxhash64(F.lit("wave"), "shard"), F.lit(WAVE)) == 0
    least = F.array_repeat(F.lit(int(NONE)), windows)
    found, need = None, None
    for first in (True, False):
        part = shards.filter(wave if first else ~wave)
        part = part.repartition(max(1, -(-n_shards // (SHARDS_A_TASK * (WAVE if first else 1)))), "shard")
        bound = anchors.withColumn("need", least) if need is None else anchors.join(need, "uid", "left").withColumn("need", F.coalesce("need", least))
        blocks = bound.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(n_blocks))).groupBy("block").applyInArrow(_block(width, windows), "block long, a_uid binary, a_ids binary, a_labels binary, a_vecs binary, low binary, high binary, need binary")
        blocks = cut(blocks)
        got = None
        for lo in range(0, n_blocks, PASS):  # each pass broadcasts at most PASS blocks of about BLOCK anchors
            some = blocks.filter(F.col("block").between(lo, lo + PASS - 1))
            tiles = part.withColumn("block", F.explode(F.sequence(F.lit(lo), F.lit(min(lo + PASS, n_blocks) - 1)).cast("array<long>"))).join(F.broadcast(some), "block")
            one = tiles.mapInArrow(_search(width, windows, k, same), "uid long, list int, id long, score long")
            got = one if got is None else got.unionByName(one)
        found = got if found is None else found.unionByName(got)
        found = cut(ranked(found, k).drop("rank"))
        if first:
            kth = found.groupBy("uid", "list").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("s")).filter(F.col("c") == k)
            need = kth.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("list", "s"))).alias("m"))
            need = need.select("uid", F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda w: F.coalesce(F.element_at("m", w), F.lit(int(NONE)))).alias("need"))
    return ranked(found, k)


def mine(rows: DataFrame, is_anchor: Column, n_positive: int = 5, n_negative: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` is (id, label, ints), whole-numbered vectors of one width.  An anchor's positives are its ``n_positive`` best
    rows of its label; the negatives of a positive are the first ``n_negative`` rows of other labels that score from ``low``
    to ``high`` per cent of it.  Higher scores come first, ties by smaller id.  Rows with a null id or label take no part;
    rows with the anchor's id are not its partners; repeated rows of other ids count as often as they come, and a repeated
    anchor is searched for once per row.  An empty table gives no rows.
    """
    rows = rows.filter("id IS NOT NULL AND label IS NOT NULL").select("id", F.col("label").cast("long").alias("label"), "ints")
    width, _ = width_of(rows)
    shards = build_shards(rows, width)
    anchors = cut(rows.filter(is_anchor).withColumn("uid", F.monotonically_increasing_id()))
    top, bottom = F.lit((1 << 62)), F.lit(-(1 << 62))
    wide = anchors.select("uid", "id", "label", "ints", F.array(bottom).alias("low"), F.array(top).alias("high"))
    positives = cut(search(shards, wide, width, 1, n_positive, True).select("uid", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    held = positives.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("place", "positive_score"))).alias("p"))
    # Whole-numbered window of each positive; a missing one gets an empty window.
    score = lambda w: F.element_at("p", w)
    spots = F.sequence(F.lit(1), F.lit(n_positive))
    lows = F.transform(spots, lambda w: F.coalesce(F.expr("0L") - F.floor(-score(w) * low / F.lit(100)), F.lit(1).cast("long")))
    highs = F.transform(spots, lambda w: F.coalesce(F.floor(score(w) * high / F.lit(100)), F.lit(0).cast("long")))
    windows = anchors.join(held, "uid").select("uid", "id", "label", "ints", lows.alias("low"), highs.alias("high"))
    negatives = search(shards, cut(windows), width, n_positive, n_negative, False)
    negatives = negatives.select("uid", (F.col("list") + 1).alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = anchors.select("uid", F.col("id").alias("anchor_id"))
    return negatives.join(positives, ["uid", "place"]).join(names, "uid").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine_embeddings(df: DataFrame, every: int = 50, noisy: int = 7, n_labels: int = 10) -> DataFrame:
    """``mine`` over (vec_id, embedding, label): components floor(256 x), labels of ids divisible by ``noisy`` moved on by one.

    Anchors are the ids divisible by ``every``.  Rows with a null id, label or vector, or with a null or non-finite
    component, take no part.  Other columns are not read.
    """
    moved = F.when(F.col("id") % noisy == 0, (F.col("label") + 1) % n_labels).otherwise(F.col("label"))
    rows = clean_rows(df, "vec_id", "embedding", "label").select("id", moved.alias("label"), "ints")
    return mine(rows, F.col("id") % every == 0)
