"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its word shingles.  Two sets of sizes a and b with Jaccard J >= num/den differ in at most
(a + b)(den - num)/(den + num) elements.  Sizes are cut into bands such that linked sets lie in one band or in
neighbouring ones; a set signs for its own band and the next.  In a band with at most k differences the domain is cut
into first-level parts of two second-level parts each, and of each first-level part the subsets that leave out one
second-level part are hashed with what the set has there.  With k + 1 + e second-level parts, at least e + 1 of these
signatures are shared.  So a set with at most e empty parts need not sign for them: not all shared ones can be empty.

Equal sets are one node.  A bucket of equal signatures is never expanded into all pairs: each node is compared with the
first one of its bucket, then with the one that has most links, and what is connected needs no further comparison.  Only
nodes of one bucket that are still in different components are compared: directly in buckets up to ``SMALL`` nodes; in
larger ones by an exact prefix and position filter (linked sets share one of their rarest elements, and neither has more
unmatched elements before it than the similarity allows).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import cut, release, small
from .common import NARROW_ROWS, WordHashes, mix

#: Spare second-level parts are one in so many, and one more.
SPARE = 8
#: Nodes of a bucket up to which its unconnected nodes are compared directly.
SMALL = 32
#: Set digests that a task remembers so that copies sign once.
SEEN = 200_000
#: Texts of a batch that are held as sets at once.
CHUNK = 512
#: Bins of a set's sketch.
BINS = 128


def shingles(text: str | None, size: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; A-Z is lower-cased."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not raw:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, raw), np.uint64, len(raw))
    width = min(size, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - width + 1 + i]
    return np.unique(mix(out))


def set_id(values: np.ndarray) -> int:
    """Digest of a whole set; equal sets are one node of the graph."""
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketch(values: np.ndarray) -> bytes:
    """Elements per bin, at most 255 each: two sets differ in at least as many elements as their sketches do."""
    return np.minimum(np.bincount((values >> np.uint64(12)).astype(np.int64) % BINS, minlength=BINS), 255).astype(np.uint8).tobytes()


class Bands:
    """Size bands; per band the number of second-level parts (0: the whole set signs) and how many of them are spare."""

    def __init__(self, num: int, den: int, top: int = 1 << 34):
        low, self.low, self.parts, self.spare = 1, [], [], []
        while low < top:
            high = low * den // num
            k = 2 * high * (den - num) // (den + num)
            parts = 2 * ((k + 2 + k // SPARE + 2) // 2) if k else 0
            self.low.append(low)
            self.parts.append(parts)
            self.spare.append(parts - k - 1)
            low = high + 1
        self.low = np.array(self.low)
        self.tags = mix(np.arange(len(self.low), dtype=np.uint64))

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.low, size, side="right")) - 1


def signatures(values: np.ndarray, bands: Bands) -> np.ndarray:
    """All signatures of one set, for its band and the next."""
    if not len(values):
        return np.empty(0, np.uint64)
    own, out = bands.of(len(values)), []
    weight, deal = mix(values ^ np.uint64(0x5851F42D4C957F2D)), (values >> np.uint64(32)).astype(np.int64)
    for band in (own, own + 1):
        parts = bands.parts[band]
        if not parts:
            out.append(mix(weight.sum(keepdims=True, dtype=np.uint64) + bands.tags[band:band + 1]))
            continue
        place = deal % parts
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, place, weight)
        # Second-level parts 2i and 2i + 1 make up the first-level part i; leaving out one leaves the other.
        sums = mix(mix(sums) + np.arange(parts, dtype=np.uint64) + bands.tags[band:band + 1])
        held = np.bincount(place, minlength=parts) > 0
        out.append(sums[held] if parts - held.sum() <= bands.spare[band] else sums)
    return np.concatenate(out)


def _nodes(size):
    def run(batches):
        words = WordHashes()
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                some = batch.slice(lo, CHUNK)
                sets = [shingles(t, size, words) for t in some.column(1).to_pylist()]
                yield pa.record_batch([some.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()), pa.array(map(sketch, sets), pa.binary())], names=["doc_id", "n", "node", "sketch"])

    return run


def _sets(size):
    def run(batches):
        words = WordHashes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                sets = [s for s in (shingles(t, size, words) for t in batch.column(1).slice(lo, 256).to_pylist()) if len(s)]
                if sets:
                    ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                    yield pa.record_batch([pa.array([set_id(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))], names=["node", "elements"])

    return run


def _signed(size, num, den):
    def run(batches):
        words, bands, seen = WordHashes(), Bands(num, den), set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                node, sig = [], []
                for text in batch.column(1).slice(lo, 512).to_pylist():
                    values = shingles(text, size, words)
                    own = set_id(values)
                    if not len(values) or own in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(own)
                    got = signatures(values, bands)
                    sig.append(got)
                    node.append(np.full(len(got), own, np.int64))
                if sig:
                    yield pa.record_batch([pa.array(np.concatenate(sig).view(np.int64)), pa.array(np.concatenate(node))], names=["sig", "node"])

    return run


def _stars(batches):
    """Of (key, node) sorted by both: (key, first node of the key, other node) for each distinct other node."""
    key, last, first = None, None, None
    for batch in batches:
        k, d = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(k):
            continue
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        new[0] = key is None or k[0] != key
        again = np.zeros(len(k), bool)
        again[1:] = (d[1:] == d[:-1]) & ~new[1:]
        again[0] = not new[0] and d[0] == last
        at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        lead = np.where(at < 0, first if first is not None else 0, d[np.maximum(at, 0)])
        key, last, first = k[-1], d[-1], lead[-1]
        hit = ~new & ~again
        yield pa.record_batch([pa.array(k[hit]), pa.array(lead[hit]), pa.array(d[hit])], names=["key", "a", "b"])


def _possible(num, den):
    """Of (a, b, na, nb, sa, sb): the pairs (a, b) that their sizes and sketches do not rule out."""

    def run(batches):
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16) for c in batch.columns[4:])
            apart = np.abs(x - y).sum(axis=1)
            ok = (apart * (num + den) <= (na + nb) * (den - num)) & (np.minimum(na, nb) * den >= np.maximum(na, nb) * num)
            yield batch.select([0, 1]).filter(pa.array(ok))

    return run


def _links(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity; whole sets travel only for pairs that may reach it."""
    one = lambda to: small(nodes.select(F.col("node").alias(to), F.col("n").alias("n" + to), F.col("sketch").alias("s" + to)))
    pairs = cut(pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_possible(num, den), "a long, b long"))
    # Pairs are narrow and few by now: they pick their sets before a set moves.
    left = sets.withColumnRenamed("node", "a").join(small(pairs, NARROW_ROWS), "a").select("a", "b", F.col("elements").alias("x"))
    ends = small(cut(pairs.select(F.col("b").alias("node")).distinct()), NARROW_ROWS)
    right = sets.join(ends, "node", "left_semi").select(F.col("node").alias("b"), F.col("elements").alias("y"))
    return (
        left.join(right, "b").withColumn("i", F.size(F.array_intersect("x", "y")))
        .filter(F.col("i") * den >= (F.size("x") + F.size("y") - F.col("i")) * num).select("a", "b").distinct()
    )


def _across(members: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, node, component, n) of the keys whose nodes are in several components; n: nodes of the key."""
    got = members.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = got.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo <> hi")
    return got.join(mixed.select("key", "n"), "key")


def _pairs(members: DataFrame) -> DataFrame:
    """Pairs of nodes of one key that are in different components; for keys of bounded size."""
    packed = members.groupBy("key").agg(F.collect_list(F.struct("node", "component")).alias("m"))
    one = packed.select("m", F.explode("m").alias("p"))
    two = one.select("p", F.explode(F.filter("m", lambda q: (q["node"] > F.col("p.node")) & (q["component"] != F.col("p.component")))).alias("q"))
    return two.select(F.col("p.node").alias("a"), F.col("q.node").alias("b"))


def _blocks(members: DataFrame, num: int, den: int) -> DataFrame:
    """The same for keys of any size: blocks of nodes meet blocks, so that no task holds a key.

    Members carry their size s and the position at of the key: of the pair's first common element, at most size minus
    the needed overlap elements can come before.
    """
    cuts = F.ceil(F.col("n") / (8 * SMALL)).cast("int")
    left = members.withColumn("i", F.pmod(F.xxhash64("node"), cuts).cast("int"))
    every = F.explode(F.sequence(F.lit(0), cuts - 1))
    a = left.select("key", "i", F.col("node").alias("a"), F.col("component").alias("ca"), F.col("s").alias("sa"), F.col("at").alias("ta"), every.alias("j"))
    b = left.select("key", F.col("i").alias("j"), F.col("node").alias("b"), F.col("component").alias("cb"), F.col("s").alias("sb"), F.col("at").alias("tb"), every.alias("i"))
    overlap = (F.col("sa") + F.col("sb")) * num
    fits = ((F.col("sa") - F.col("ta")) * (num + den) >= overlap) & ((F.col("sb") - F.col("tb")) * (num + den) >= overlap)
    return a.join(b, ["key", "i", "j"]).filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & fits).select("a", "b")


def _prefixes(nodes: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(key, node, s, at): the rarest elements of each set, of which linked sets share at least one, with their positions."""
    rows = sets.join(nodes, "node", "left_semi").select("node", F.size("elements").alias("s"), F.explode("elements").alias("key"))
    often = rows.groupBy("key").agg(F.count(F.lit(1)).alias("f"))
    packed = rows.join(often, "key").groupBy("node", "s").agg(F.sort_array(F.collect_list(F.struct("f", "key"))).alias("e"))
    keep = F.col("s") - F.ceil(F.col("s") * num / den).cast("int") + 1
    return packed.select("node", "s", F.posexplode(F.slice("e", 1, keep)).alias("at", "e")).filter("e.f > 1").select(F.col("e.key").alias("key"), "node", "s", "at")


def jaccard_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents linked at Jaccard >= num/den of ``size``-word shingles.

    A text with fewer words is one shingle; an empty or null text has no shingle and no link.  Equal sets link.
    component_id is the smallest doc_id reachable.  Links inside a component are not counted: most are never compared.
    Rows with a null doc_id take part: their component_id is null only if no row of the component has an id.  Repeated rows are returned as often as they come; other columns are not read; an empty table gives none.
    Sets are identified by 64-bit digests of 64-bit shingle hashes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    nodes = cut(docs.mapInArrow(_nodes(size), "doc_id long, n long, node long, sketch binary"))
    signed = docs.mapInArrow(_signed(size, num, den), "sig long, node long")
    stars = cut(signed.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(_stars, "key long, a long, b long"))
    release(docs.sparkSession)  # the signatures' shuffle, the largest one, is done with
    links = _all_links(docs, nodes, stars, size, num, den)
    release(docs.sparkSession)
    got = nodes.join(connected_components(links), "node", "left").withColumn("root", F.coalesce("component", "node"))
    least = got.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return got.join(least, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def _all_links(docs: DataFrame, nodes: DataFrame, stars: DataFrame, size: int, num: int, den: int) -> DataFrame:
    met = stars.select(F.col("a").alias("node")).unionAll(stars.select("b")).distinct()
    seen = nodes.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    met = cut(met.join(seen, "node"))
    chosen = met.select("id")
    chosen = small(cut(chosen.distinct()), NARROW_ROWS)
    is_chosen = F.col("doc_id").eqNullSafe(F.col("id"))
    sets = docs.join(chosen, is_chosen, "left_semi").mapInArrow(_sets(size), "node long, elements array<long>").join(small(met.select("node"), NARROW_ROWS), "node", "left_semi")
    repeated = docs.select("doc_id").join(chosen, is_chosen, "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    if not repeated.isEmpty():  # an id on several rows brings its sets several times
        sets = sets.dropDuplicates(["node"])
    sets = cut(sets)
    tried = cut(stars.select("a", "b").distinct())
    links = cut(_links(tried, met, sets, num, den))
    many = stars.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("a")).filter("n > 1")
    wide = many.select("key", F.col("a").alias("node")).unionAll(stars.join(many.select("key"), "key", "left_semi").select("key", F.col("b").alias("node")))
    rest = cut(_across(wide, connected_components(links)))
    if rest.isEmpty():
        return links
    # In large mixed buckets, the node with most links so far is compared with what it is not connected to.
    large = rest.filter(F.col("n") > SMALL)
    if not large.isEmpty():
        degree = links.select(F.col("a").alias("node")).unionAll(links.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("deg"))
        hubs = large.join(degree, "node", "left").groupBy("key").agg(F.max(F.struct(F.coalesce("deg", F.lit(0)), "node", "component")).alias("h"))
        spokes = large.join(hubs.select("key", F.col("h.node").alias("hub"), F.col("h.component").alias("of")), "key").filter("component <> of")
        more = spokes.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        tried, links = cut(tried.unionAll(more)), cut(links.unionAll(_links(more, met, sets, num, den)))
        rest = cut(_across(rest.select("key", "node"), connected_components(links)))
    fresh = _pairs(rest.filter(F.col("n") <= SMALL))
    hot = cut(rest.filter(F.col("n") > SMALL).select("node", "component").distinct())
    if not hot.isEmpty():
        keyed = cut(_across(_prefixes(hot.select("node"), sets, num, den), hot))
        fresh = fresh.unionAll(_blocks(keyed, num, den))
    fresh = fresh.distinct().join(tried, ["a", "b"], "left_anti")
    return cut(links.unionAll(_links(fresh, met, sets, num, den)))


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, with all columns; the others are what is joined.

    Rows with a null doc_id have nothing to be dropped by and stay; rows that repeat the smallest doc_id all stay.
    """
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.struct("*").alias("row"))
    return rows.join(small(cut(gone), NARROW_ROWS), F.col("row.doc_id") == F.col("id"), "left_anti").select("row.*")
