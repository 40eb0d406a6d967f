"""Substring dedup by content-defined chunks with a gear rolling hash.

The gear hash of a position depends on the 16 bytes up to it: h = (h << 2) + GEAR[byte].  A boundary stands where the
hash is the least of a window of ``WINDOW`` positions, so boundaries are at most a window apart and depend on nothing
outside two windows: an insertion shifts chunks but changes only those around it, and a passage of n bytes holds whole
chunks of n - 2 * WINDOW - 14 bytes together wherever it stands (up to three bytes less where a boundary would fall inside
a UTF-8 character).  So every passage of LEAST_RUN + 2 * WINDOW + 17 = 225 bytes is found.  Chunks are counted by their
128-bit digest; the first place of a digest (least doc_id, then position) owns it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import mix

WINDOW = 64
#: Bytes that runs of repeated chunks need, whoever owns them; shorter ones are chance.
LEAST_RUN = 80
GEAR = (mix(np.arange(256, dtype=np.uint64) + np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)).astype(np.uint32)
#: Bytes of a text hashed at once; the next part starts with the last boundary before.
PART = 1 << 22


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling hash of each position, built by doubling the bytes it covers."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        older = np.zeros_like(h)
        older[step:] = h[:-step] << np.uint32(2 * step) if step < len(h) else 0
        h = h + older
    return h


def _minima(data: np.ndarray, lead: int = 0) -> np.ndarray:
    """Positions that are the least (the last of equals) in some window of hashes; the first ``lead`` ones are in no window."""
    n = len(data)
    if n - lead < WINDOW:
        return np.empty(0, np.int64)
    least = (gear(data).astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    least = least[lead:]
    width = 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    at = (np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)
    return at[np.r_[True, at[1:] != at[:-1]]]


def boundaries(raw: bytes) -> np.ndarray:
    """Chunk ends of a text in order, its length last; never inside a UTF-8 character."""
    data = np.frombuffer(raw, np.uint8)
    # Parts overlap by a window and the hash's bytes, so that each window is seen whole; hashes that lack bytes are in none.
    lap = WINDOW + 16
    found = [_minima(data[max(0, lo - lap):lo + PART], 15 if lo else 0) + max(0, lo - lap) for lo in range(0, max(1, len(data)), PART)]
    if len(found) > 1:
        found = [f[f >= lo - WINDOW + 1] if lo else f for f, lo in zip(found, range(0, len(data), PART))]
    ends = np.unique(np.concatenate(found)) + 1
    for _ in range(3):
        inside = ends < len(data)
        inside[inside] = (data[ends[inside]] & 0xC0) == 0x80
        ends = ends + inside
    ends = np.unique(ends)
    return np.append(ends[(ends > 0) & (ends < len(data))], len(data)) if len(data) else np.empty(0, np.int64)


def _chunks(batches):
    for batch in batches:
        ids, keys, raws = batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()).to_pylist()
        for lo in range(0, batch.num_rows, 256):
            row, start, size, digest = [], [], [], []
            for i in range(lo, min(lo + 256, batch.num_rows)):
                raw = raws[i] or b""
                ends = boundaries(raw)
                if not len(ends):
                    continue
                at = np.concatenate([[0], ends[:-1]])
                row.append(np.full(len(ends), i))
                start.append(at)
                size.append(ends - at)
                digest += [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(at.tolist(), ends.tolist())]
            if not row:
                continue
            row = pa.array(np.concatenate(row))
            d = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            yield pa.record_batch([ids.take(row), keys.take(row), pa.array(np.concatenate(start)), pa.array(np.concatenate(size)), pa.array(np.ascontiguousarray(d[:, 0])), pa.array(np.ascontiguousarray(d[:, 1]))], names=["doc_id", "k", "start", "size", "d1", "d2"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k"), "text")


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, k, start, size, d1, d2): all chunks of all texts, with byte offsets; k stands for the text."""
    return _keyed(docs).mapInArrow(_chunks, "doc_id long, k long, start long, size long, d1 long, d2 long")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, k, start, end, owned, owners): parts of runs of neighbouring chunks that occur more than once, runs of LEAST_RUN bytes at least.

    ``owned``: the part holds the first places of its chunks.  Otherwise it may be removed, and ``owners`` lists the
    doc_ids of the first places.  Runs are measured whole and then cut where ownership changes.  In a later copy nothing
    is owned, so parts of other owners that are under LEAST_RUN are chance inside a first copy, and count as owned there:
    removing them would leave holes in the only copy that stays.  A digest is counted by plain grouping, with
    partial sums before the shuffle, and joined back to its places, so a chunk that many texts share can be split.
    """
    place = F.struct("doc_id", "k", "start")
    counted = chunks(docs).groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.max(place).alias("last"))
    owners = cut(counted.filter("n > 1 AND first <> last").select("d1", "d2", "first"))
    found = chunks(docs).join(owners, ["d1", "d2"]).select("doc_id", "k", "start", "size", "first", place.eqNullSafe(F.col("first")).alias("owned")).distinct()
    order = Window.partitionBy("doc_id", "k").orderBy("start")
    apart = F.lag(F.col("start") + F.col("size"), 1, -1).over(order) != F.col("start")
    new = apart | (F.lag("owned").over(order) != F.col("owned"))
    found = found.withColumn("whole", F.sum(apart.cast("int")).over(order)).withColumn("run", F.sum(new.cast("int")).over(order))
    # Parts first: one row each, so a run's length is summed over few rows.
    parts = found.groupBy("doc_id", "k", "whole", "run").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"), F.first("owned").alias("owned"), F.array_sort(F.collect_set("first.doc_id")).alias("owners"), F.count(F.lit(1)).alias("n_chunks"),
    )
    size = F.col("end") - F.col("start")
    parts = parts.withColumn("length", F.sum(size).over(Window.partitionBy("doc_id", "k", "whole"))).filter(F.col("length") >= LEAST_RUN)
    return parts.withColumn("owned", F.col("owned") | (size < LEAST_RUN)).drop("whole", "run", "length")


def substring_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_repeated_chunks, repeated_bytes, removed_bytes, owner_ids) per row of ``docs``.

    repeated_bytes lie in runs that also occur elsewhere, removed_bytes in those of them that another place owns, and
    owner_ids are the documents of these places.  A null or empty text has no chunk; a null doc_id takes part, comes
    first among the owners and is not listed; rows repeated with id and text are one document that is returned as often
    as it comes; other columns are not read; an empty table gives no rows.
    """
    spans = repeated_spans(docs)
    size = F.col("end") - F.col("start")
    mine = spans.groupBy("doc_id", "k").agg(
        F.sum("n_chunks").alias("n_repeated_chunks"), F.sum(size).alias("repeated_bytes"), F.sum(F.when(F.col("owned"), 0).otherwise(size)).alias("removed_bytes"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(~F.col("owned"), F.col("owners")))))).alias("owner_ids"),
    ).withColumnRenamed("doc_id", "_id").withColumnRenamed("k", "_k")
    rows = _keyed(docs).select("doc_id", "k", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.join(cut(mine), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("k") == F.col("_k")), "left").select(
        "doc_id", "n_bytes", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_repeated_chunks", "repeated_bytes", "removed_bytes")),
        F.coalesce("owner_ids", F.array().cast("array<bigint>")).alias("owner_ids"),
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with every repeated run cut out of its text except where it is owned; all columns stay."""
    gone = repeated_spans(docs).filter("NOT owned").groupBy("doc_id", "k").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    gone = cut(gone.select(F.col("doc_id").alias("id"), F.col("k").alias("of"), "cuts"))
    text = F.col("row.text")
    key = F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("of"))
    marked = docs.select(F.struct("*").alias("row")).join(gone, key, "left")
    # The kept stretches: from the end of each cut to the start of the next.
    raw = F.encode(text, "UTF-8")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.col("cuts.end"))
    stops = F.concat(F.col("cuts.start"), F.array(F.octet_length(text).cast("long")))
    parts = F.zip_with(starts, stops, lambda a, b: F.decode(F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")), "UTF-8"))
    rest = F.when(F.col("cuts").isNull(), text).otherwise(F.array_join(parts, ""))
    return marked.select(*(rest.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
