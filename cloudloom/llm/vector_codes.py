"""Product codes of integer vectors, with slice-and-intersect bitmasks for the nearest entry.

A vector is cut into equal parts; every part position has its own codebook.  The entries of a codebook are sorted in each
dimension, and the sorted coordinates carry prefix masks: mask j has the bits of the first j entries.  A radius around a
part selects one range of coordinates per dimension; two prefix masks give the bits of each range, and all ranges ANDed
give the entries inside the box.  The initial radius is the distance to the best of a few entries next to the part in some
dimension, so the box holds the nearest entry and all that tie with it; only its candidates are measured.

Codebooks are learned by rounds of assignment and averaging over all rows.  Tasks add up their own rows first, so a round
moves at most one small row per used component of the codebooks and task, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, small
from .vectors import clean_rows, matrix, width_of

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Rows measured at once.
CHUNK = 4096


class Slices:
    """One codebook with its sorted coordinates and prefix masks."""

    def __init__(self, entries: np.ndarray):
        if not 1 <= len(entries) <= 64:
            raise ValueError("a mask has 64 bits: a codebook holds 1 to 64 entries")
        self.entries = np.ascontiguousarray(entries, np.int64)
        order = np.argsort(self.entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.entries, order, axis=0)
        bits = np.uint64(1) << order.astype(np.uint64)
        self.prefix = np.zeros((len(entries) + 1, self.entries.shape[1]), np.uint64)
        self.prefix[1:] = np.bitwise_or.accumulate(bits, axis=0)
        self.order = order

    def _radius(self, x: np.ndarray) -> np.ndarray:
        """A whole number not below the distance to the nearest entry."""
        best = np.full(len(x), np.iinfo(np.int64).max)
        for d in range(x.shape[1]):
            at = np.searchsorted(self.sorted[:, d], x[:, d])
            for side in (at - 1, at):
                e = self.order[np.clip(side, 0, len(self.entries) - 1), d]
                gap = x - self.entries[e]
                best = np.minimum(best, (gap * gap).sum(axis=1))
        return np.sqrt(best.astype(np.float64)).astype(np.int64) + 1

    def masks(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Bits of the entries within ``radius`` of each row in every dimension."""
        out = np.full(len(x), self.prefix[-1, 0] if x.shape[1] else (1 << len(self.entries)) - 1, np.uint64)
        for d in range(x.shape[1]):
            low = np.searchsorted(self.sorted[:, d], x[:, d] - radius, side="left")
            high = np.searchsorted(self.sorted[:, d], x[:, d] + radius, side="right")
            out &= self.prefix[high, d] ^ self.prefix[low, d]
        return out

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) per row; ties go to the lower entry."""
        entry, dist = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        for lo in range(0, len(x), CHUNK):
            part = x[lo:lo + CHUNK]
            masks = self.masks(part, self._radius(part)) if x.shape[1] else np.ones(len(part), np.uint64)
            bits = np.unpackbits(masks.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, e = np.nonzero(bits)
            gap = part[row] - self.entries[e]
            key = (gap * gap).sum(axis=1) * 64 + e
            starts = np.concatenate([[0], np.cumsum(bits.sum(axis=1, dtype=np.int64))[:-1]])
            got = np.minimum.reduceat(key, starts)
            entry[lo:lo + CHUNK], dist[lo:lo + CHUNK] = got % 64, got // 64
        return entry, dist


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """(parts, entries, width of a part): the parts of the rows with the smallest ids; at most ``entries`` rows are fetched."""
    got = rows.select("id", "ints").orderBy(F.col("id").asc_nulls_last(), "ints").limit(entries).collect()
    return np.array([r["ints"] for r in got], np.int64).reshape(len(got), parts, -1).transpose(1, 0, 2)


def _sums(books: np.ndarray):
    """Of a task's rows: (cell, total, n) per used component of the codebooks, cell numbering part, entry and position."""
    parts, entries, w = books.shape

    def run(batches):
        slices = [Slices(b) for b in books]
        total, n = np.zeros((parts, entries, w), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = matrix(batch.column(0), parts * w)
            for p, s in enumerate(slices):
                part = np.ascontiguousarray(x[:, p * w:(p + 1) * w])
                e, _ = s.nearest(part)
                np.add.at(total[p], e, part)
                n[p] += np.bincount(e, minlength=entries)
        used = np.repeat(n.ravel() > 0, w)
        cells = np.flatnonzero(used)
        yield pa.record_batch([pa.array(cells), pa.array(total.ravel()[used]), pa.array(np.repeat(n.ravel(), w)[used])], names=["cell", "total", "n"])

    return run


def _codes(books: np.ndarray):
    parts, _, w = books.shape
    digits = np.array([f"{i:02x}" for i in range(64)])

    def run(batches):
        slices = [Slices(b) for b in books]
        for batch in batches:
            x = matrix(batch.column(2), parts * w)
            error, code = np.zeros(len(x), np.int64), np.full(len(x), "", dtype=f"<U{2 * parts}")
            for p, s in enumerate(slices):
                e, d = s.nearest(np.ascontiguousarray(x[:, p * w:(p + 1) * w]))
                error += d
                code = np.char.add(code, digits[e])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(code.astype(object), pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    return run


def learn(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks of (id, label, ints) rows after ``rounds`` of assignment and floored averages; unused entries stay."""
    books = first_codebooks(rows, parts, entries)
    for _ in range(rounds):
        sums = rows.select("ints").mapInArrow(_sums(books), "cell long, total long, n long")
        flat = books.reshape(-1).copy()
        for r in sums.groupBy("cell").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # as many rows as the codebooks have components
            flat[r["cell"]] = r["total"] // r["n"]
        books = flat.reshape(books.shape)
    return books


def book_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) per row with a finite vector.

    Rows whose vector is null or holds a null or non-finite component are dropped.  A null id is kept, comes last among
    the first entries and is returned as null; repeated rows count and are returned as often as they come; null labels are
    one label; other columns are not read; an empty table gives no rows.  Vectors of several widths, a width that the parts
    do not divide, and integer components beyond 2^28 are errors.
    """
    rows = clean_rows(df, id_col, vec_col, label_col)
    width, _ = width_of(rows)
    if width % parts:
        raise ValueError(f"{parts} parts do not divide {width} components")
    kind = dict(rows.dtypes)["label"]
    if not width and rows.isEmpty():
        return rows.select(F.col("id").alias("vec_id"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    books = learn(rows, parts, entries, rounds)
    coded = cut(rows.mapInArrow(_codes(books), f"id long, label {kind}, code string, error long"))
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(small(cut(sums)), F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(book_digest(books)).alias("codebooks_sha256")
    )
