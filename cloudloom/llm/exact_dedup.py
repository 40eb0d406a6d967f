"""Exact dedup by composable polynomial fingerprints and streaming comparison.

Bytes b0..bn-1 have the fingerprint sum(b_i * B^(n-1-i)) modulo two 31-bit primes.  The fingerprint of two pieces in a
row is ``left * B^len(right) + right``, so pieces of a huge document are hashed by different tasks and then added up, each
shifted by the length of what follows it.  Rows with equal fingerprints and lengths are compared byte by byte, in pieces,
with the first row of their group; the groups are salted by their size, and only that one row is repeated for each salt.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, small
from .common import NARROW_ROWS, squashed

#: Fixed values of the fingerprint: two primes below 2^31 and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1566083941)
#: A longer text is hashed in pieces of this many bytes, by several tasks.
PIECE = 1 << 16
#: Rows compared with one copy of their group's first row.
SPREAD = 1000

_POWERS: dict[int, list[np.ndarray]] = {}


def _powers() -> list[np.ndarray]:
    """Per prime: B^(PIECE-1) .. B^0."""
    if PIECE not in _POWERS:
        table = []
        for p, b in zip(PRIMES, BASES):
            row, x = [], 1
            for _ in range(PIECE):
                row.append(x)
                x = x * b % p
            table.append(np.array(row[::-1], dtype=np.uint64))
        _POWERS[PIECE] = table
    return _POWERS[PIECE]


def fingerprint(piece: bytes) -> tuple[int, int, int]:
    """(h1, h2, length) of at most PIECE bytes."""
    data = np.frombuffer(piece, dtype=np.uint8).astype(np.uint64)
    n = len(data)
    h = [int(np.dot(data, row[PIECE - n:])) % p for row, p in zip(_powers(), PRIMES)]
    return h[0], h[1], n


def combine(left: tuple[int, int, int], right: tuple[int, int, int]) -> tuple[int, int, int]:
    """Fingerprint of two pieces in a row."""
    h = [(a * pow(b, right[2], p) + c) % p for a, c, b, p in zip(left, right, BASES, PRIMES)]
    return h[0], h[1], left[2] + right[2]


def squash(text: str | None) -> bytes:
    """UTF-8 of the text with every run of ASCII white space as one space."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return b" " if raw else b""
    return (b" " if raw[:1].isspace() else b"") + b" ".join(words) + (b" " if raw[-1:].isspace() else b"")


def _slices(batches, rows: int = 1024):
    """Batches of fewer rows, so that few texts are held at once."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


FP_SCHEMA = "doc_id long, sha string, n_bytes long, h1 long, h2 long"


def _fingerprints(batches):
    for batch in _slices(batches):
        out = {k: [] for k in ("doc_id", "sha", "n_bytes", "h1", "h2")}
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw = squash(text)
            h1, h2, _ = fingerprint(raw) if len(raw) <= PIECE else (None, None, 0)
            for k, v in zip(out, (doc, hashlib.sha256(raw).hexdigest(), len(raw), h1, h2)):
                out[k].append(v)
        yield pa.record_batch([pa.array(out["doc_id"], pa.int64()), pa.array(out["sha"], pa.string()), *(pa.array(out[k], pa.int64()) for k in ("n_bytes", "h1", "h2"))], names=list(out))


def _piece_hashes(batches):
    """Shifted hash of each piece: its part of the whole document's sum."""
    for batch in batches:
        doc, sha, n, at, raw = (c.to_pylist() for c in batch.columns)
        parts = []
        for total, start, piece in zip(n, at, raw):
            h = fingerprint(piece)
            after = total - start - h[2]
            parts.append([v * pow(b, after, p) % p for v, b, p in zip(h, BASES, PRIMES)])
        cols = [batch.column(0), batch.column(1), batch.column(2), batch.column(3), *(pa.array([x[i] for x in parts], pa.int64()) for i in (0, 1))]
        yield pa.record_batch(cols, names=["doc_id", "sha", "n_bytes", "at", "h1", "h2"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, sha, n_bytes, fp) for every row of ``docs``; written once."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cut(docs.mapInArrow(_fingerprints, FP_SCHEMA))
    huge = (
        docs.filter(F.octet_length("text") > PIECE).withColumn("raw", F.encode(squashed(F.col("text")), "UTF-8"))
        .withColumn("n_bytes", F.octet_length("raw").cast("long")).filter(F.col("n_bytes") > PIECE)
        .select("doc_id", F.sha2("raw", 256).alias("sha"), "n_bytes", "raw", F.explode(F.sequence(F.lit(0), F.col("n_bytes").cast("int") - 1, F.lit(PIECE))).alias("at"))
        .select("doc_id", "sha", "n_bytes", F.col("at").cast("long").alias("at"), F.substring("raw", F.col("at") + 1, F.lit(PIECE)).alias("raw"))
    )
    whole = (
        huge.repartition("sha", "at").mapInArrow(_piece_hashes, "doc_id long, sha string, n_bytes long, at long, h1 long, h2 long")
        .groupBy("sha", "at").agg(F.first("h1").alias("h1"), F.first("h2").alias("h2"))
        .groupBy("sha").agg(*((F.sum(h) % F.lit(p)).alias("w" + h) for h, p in zip(("h1", "h2"), PRIMES)))
    )
    joined = rows.filter("h1 IS NOT NULL").unionByName(rows.filter("h1 IS NULL").drop("h1", "h2").join(whole, "sha").select("doc_id", "sha", "n_bytes", F.col("wh1").alias("h1"), F.col("wh2").alias("h2")))
    return joined.select("doc_id", "sha", "n_bytes", (F.shiftleft("h1", 31) + F.col("h2")).alias("fp"))


def whole_fingerprint(raw: bytes) -> tuple[int, int, int]:
    """The fingerprint of a text of any length, piece after piece."""
    got = (0, 0, 0)
    for at in range(0, len(raw), PIECE):
        got = combine(got, fingerprint(raw[at:at + PIECE]))
    return got


def _normalised(batches):
    """(doc_id, sha, fp, n_bytes, raw): texts of shared groups with their key, so that no table has to tell it."""
    for batch in _slices(batches):
        raw = [squash(t) for t in batch.column(1).to_pylist()]
        marks = [whole_fingerprint(r) for r in raw]
        fp = pa.array([(h1 << 31) + h2 for h1, h2, _ in marks], pa.int64())
        yield pa.record_batch([batch.column(0), pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()), fp, pa.array([n for *_, n in marks], pa.int64()), pa.array(raw, pa.binary())], names=["doc_id", "sha", "fp", "n_bytes", "raw"])


def _differing(batches):
    """Of rows sorted by group with the first row ahead: those that differ from it."""
    group, first = None, b""
    for batch in batches:
        out = ([], [])
        fp, n, salt, doc, sha, raw = (batch.column(i) for i in range(6))
        for i in range(batch.num_rows):
            key = (fp[i].as_py(), n[i].as_py(), salt[i].as_py())
            text = memoryview(raw[i].as_buffer())
            if key != group:
                group, first = key, bytes(text)
                continue
            if not same_text(first, text):
                out[0].append(doc[i].as_py())
                out[1].append(sha[i].as_py())
        yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string())], names=["doc_id", "sha"])


def same_text(a, b, step: int = PIECE) -> bool:
    """Piecewise comparison that ends at the first difference."""
    a, b = memoryview(a), memoryview(b)
    return len(a) == len(b) and all(a[i:i + step] == b[i:i + step] for i in range(0, len(a), step))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, n_bytes): one row per row of ``docs``.

    Texts are equal when identical after every run of ASCII white space becomes one space.  A null text counts as empty,
    and empty texts are equal to one another.  A null doc_id comes last: its row stays only where no row of the group has
    an id, and keep_id is then null.  Of repeated rows with the smallest doc_id of their group exactly one is kept.
    Other columns of ``docs`` are not read; an empty table gives an empty result.
    """
    rows = cut(fingerprints(docs))
    key = ["fp", "n_bytes"]
    groups = cut(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).filter("n > 1"))
    few = small(groups, NARROW_ROWS // 2)
    ids = cut(rows.select(*key, "doc_id").join(few, key, "left_semi").select(F.col("doc_id").alias("id")).distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.join(small(ids, NARROW_ROWS), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").mapInArrow(_normalised, "doc_id long, sha string, fp long, n_bytes long, raw binary")
    # Shared texts meet once, in their salted groups; the first row of a group goes ahead into every salt.
    texts = texts.join(few, key)
    salts = F.ceil(F.col("n") / SPREAD).cast("int")
    own = F.array(F.struct(F.pmod(F.xxhash64("doc_id"), salts).cast("int").alias("salt"), F.lit(1).alias("ahead")))
    every = F.transform(F.sequence(F.lit(0), salts - 1), lambda i: F.struct(i.alias("salt"), F.lit(0).alias("ahead")))
    both = texts.withColumn("s", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("first")), F.concat(own, every)).otherwise(own))).select(*key, "s.salt", "s.ahead", "doc_id", "sha", "raw")
    odd = cut(
        both.repartition(*key, "salt").sortWithinPartitions(*key, "salt", "ahead", "sha")
        .select(*key, "salt", "doc_id", "sha", "raw").mapInArrow(_differing, "doc_id long, sha string").distinct()
    )
    if odd.isEmpty():
        rows = rows.withColumn("alt", F.lit(""))
    else:  # texts that share a fingerprint by accident: told apart by their digest
        mark = odd.select(F.col("doc_id").alias("odd_id"), F.col("sha").alias("alt"))
        rows = rows.join(mark, F.col("doc_id").eqNullSafe(F.col("odd_id")) & (F.col("sha") == F.col("alt")), "left").drop("odd_id").fillna("", ["alt"])
    key = [*key, "alt"]
    ids = rows.groupBy(*key, "sha", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    # Only the shared ones are looked up, as a written table: then the join may split a hot group.
    groups = cut(ids.groupBy(*key).agg(F.sum("c").alias("size"), F.min("doc_id").alias("least")).filter("size > 1"))
    alone = F.col("size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("least"))
    return (
        ids.join(groups, key, "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("c").cast("int"))))
        .select("doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).alias("group_size"), (F.col("doc_id").eqNullSafe(keep) & (F.col("copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256"), "n_bytes")
    )


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns.

    The dropped ids are the smaller side, so they are what is joined; rows repeated with id and text are thinned apart.
    """
    found = cut(found.select(F.concat_ws(":", "text_sha256", F.col("doc_id").cast("string")).alias("tag"), "kept"))
    tags = cut(found.groupBy("tag").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n")).filter("NOT stays OR n > 1"))
    own = F.concat_ws(":", F.sha2(squashed(F.col("row.text")), 256), F.col("row.doc_id").cast("string"))
    marked = docs.select(F.struct("*").alias("row")).select("row", own.alias("tag")).join(small(tags.select("tag", "stays"), NARROW_ROWS // 8), "tag", "left")
    once = marked.filter("stays IS NULL")
    if tags.filter("stays").isEmpty():
        return once.select("row.*")
    return once.select("row.*").unionByName(marked.filter("stays").dropDuplicates(["tag"]).select("row.*"))
