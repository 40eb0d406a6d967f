"""SentencePiece encoding and decoding by batched numpy Viterbi.

A batch of texts is one array of code points.  It is cut where no piece of the vocabulary holds both neighbours, so no
piece can cross a cut; equal stretches are encoded once.  Stretches of equal length form a matrix whose rows advance
together: for each end, substring hashes (differences of prefix hashes) probe the sorted hashes of the pieces, and a
vectorised maximum stores score, last piece and backpointer.

In a unigram model the score is the sum of the pieces' scores.  A BPE model does not ask for the best sum: its encoding
is the only one in which merging never crosses the border of two neighbouring pieces.  There a piece scores 0 when it
may follow the last piece of the best path, and minus infinity otherwise.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix

#: The marker for a space, and what the model format calls its kinds.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Unknown characters score this much less than the worst piece.
UNKNOWN_PENALTY = 10.0

RADIX = np.uint64(0x9E3779B97F4A7C15)
RADIX_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
PAIR_BITS = 22
PAIR_MEMORY = 19
#: Code points taken at once.
BLOCK = 1 << 20
#: Different stretches that a worker remembers.
MEMORY = 200_000


def _pair_slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + b.astype(np.uint64) * np.uint64(0x165667B19E3779F9)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


class Vocabulary:
    """A model file as plain arrays; built once on the driver, of the size of the vocabulary."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models without text normalisation are supported")
        self.prefix = spec.add_dummy_prefix
        self.pairs_seen = self.pairs_ok = None
        self.kind = model.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.pieces = [p.piece for p in model.pieces]
        kinds = np.array([p.type for p in model.pieces])
        if (kinds == USER).any():
            raise ValueError("user-defined pieces are not supported")
        self.score = np.array([p.score for p in model.pieces], np.float32)
        self.unknown = int(np.flatnonzero(kinds == UNKNOWN)[0])
        bytes_ = np.flatnonzero(kinds == BYTE)
        self.bytes = bytes_[np.argsort([int(self.pieces[i][3:5], 16) for i in bytes_])] if len(bytes_) else None
        normal = np.flatnonzero(kinds == NORMAL)
        self.longest = max(len(self.pieces[i]) for i in normal)
        keys = np.array([int(self._keys(points(self.pieces[i])[None, :], len(self.pieces[i]))) for i in normal], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], normal[order].astype(np.int64)
        self.lowest = float(self.score[normal].min())
        joined = np.zeros(1 << PAIR_BITS, bool)
        for i in normal:
            p = points(self.pieces[i])
            joined[_pair_slot(p[:-1], p[1:])] = True
        self.joined = joined
        if self.kind == BPE:
            self._derive(normal)
        raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, kinds)]
        self.raw_at = np.cumsum([0] + [len(r) for r in raw])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    @staticmethod
    def _keys(matrix: np.ndarray, length: int) -> np.uint64:
        sums = prefix_sums(matrix)
        return substring_keys(sums, 0, length)[0]

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 where there is none."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ids[at], -1)

    # BPE only: which pairs merge, when, and how each piece came about.

    def _derive(self, normal: np.ndarray) -> None:
        by_text = {self.pieces[i]: int(i) for i in normal}
        ranks = np.unique(-self.score[normal])
        self.rank = np.full(len(self.pieces) + 1, len(ranks) + 1, np.int64)
        self.rank[normal] = np.searchsorted(ranks, -self.score[normal])
        self.left, self.right = np.full(len(self.pieces) + 1, -1), np.full(len(self.pieces) + 1, -1)
        pairs = {}
        for text, i in by_text.items():
            for cut_ in range(1, len(text)):
                a, b = by_text.get(text[:cut_]), by_text.get(text[cut_:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        for text, i in by_text.items():
            if len(text) > 1:
                parts = [by_text.get(c, -1) for c in text]
                while len(parts) > 1:
                    merged = [(self.rank[pairs[a << 32 | b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a >= 0 and b >= 0 and a << 32 | b in pairs]
                    if not merged:
                        break
                    k = min(merged)[1]
                    if len(parts) == 2 and pairs[parts[0] << 32 | parts[1]] == i:
                        self.left[i], self.right[i] = parts
                    parts[k:k + 2] = [pairs[parts[k] << 32 | parts[k + 1]]]
        #: A piece that merging never makes cannot be part of an encoding.
        self.made = np.zeros(len(self.pieces) + 1, bool)
        self.made[normal] = [len(self.pieces[i]) == 1 or self.left[i] >= 0 for i in normal]
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys, self.pair_ids = keys, np.array([pairs[k] for k in keys.tolist()], np.int64)

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece ``b`` may stand after piece ``a``; answers are remembered in a table of fixed size."""
        if self.pairs_seen is None:
            self.pairs_seen, self.pairs_ok = np.full(1 << PAIR_MEMORY, -1, np.int64), np.zeros(1 << PAIR_MEMORY, bool)
        key = (a + 1) << 32 | b
        slot = (key.astype(np.uint64) * RADIX >> np.uint64(64 - PAIR_MEMORY)).astype(np.int64)
        new = np.flatnonzero(self.pairs_seen[slot] != key)
        ok = self.pairs_ok[slot]
        if len(new):
            ok[new] = self._follows(a[new], b[new])
            self.pairs_seen[slot[new]], self.pairs_ok[slot[new]] = key[new], ok[new]
        return ok

    def _follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undoing both pieces, no pair at the border merges too early."""
        never = np.int64(1 << 40)
        ok = np.ones(len(a), bool)
        live = np.flatnonzero((a >= 0) & (b >= 0))
        x, y = a[live], b[live]
        p = np.full(len(live), never)  # when x and y are used up
        q = np.full(len(live), never)
        while len(live):
            key = x << 32 | y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            m = np.where(self.pair_keys[at] == key, self.rank[self.pair_ids[at]], never)
            crossed = (m < p) & (m <= q) & (m < never)
            ok[live[crossed]] = False
            # Step back in time: undo whichever of the two was made last.
            rx, ry = np.where(self.right[x] >= 0, self.rank[x], -1), np.where(self.left[y] >= 0, self.rank[y], -1)
            back = rx >= ry
            go = ~crossed & ((rx >= 0) | (ry >= 0))
            p, q = np.where(back, rx, p), np.where(back, q, ry)
            x, y = np.where(back, self.right[x], x), np.where(back, y, self.left[y])
            live, x, y, p, q = live[go], x[go], y[go], p[go], q[go]
        return ok

    def encode_rows(self, matrix: np.ndarray) -> list[np.ndarray]:
        """Ids of stretches of equal length, one a row of code points."""
        n, length = matrix.shape
        sums = prefix_sums(matrix)
        best = np.full((n, length + 1), -np.inf, np.float32)
        best[:, 0] = 0
        last = np.full((n, length + 1), -1, np.int64)
        back = np.zeros((n, length + 1), np.int64)
        for end in range(1, length + 1):
            todo = np.arange(n)
            for start in range(max(0, end - self.longest), end):
                lone = end - start == 1
                if self.kind == BPE:
                    # One piece at most can end a row's prefix, so rows that have found theirs are left out.
                    found = self.probe(substring_keys(sums[todo], start, end))
                    hit = (found >= 0) & self.made[found]
                    hit[hit] = self.follows(last[todo[hit], start], found[hit])
                    at = todo[hit]
                    best[at, end], last[at, end], back[at, end] = 0, found[hit], start
                    todo = todo[~hit]
                    if lone:
                        odd = todo[found[~hit] < 0]
                        best[odd, end], last[odd, end], back[odd, end] = 0, -1, start
                    if not len(todo):
                        break
                else:
                    found = self.probe(substring_keys(sums, start, end))
                    gain = np.where(found >= 0, self.score[found], np.float32(self.lowest - UNKNOWN_PENALTY) if lone else -np.inf).astype(np.float32)
                    total = best[:, start] + gain
                    at = np.flatnonzero(total > best[:, end])
                    best[at, end], last[at, end], back[at, end] = total[at], found[at], start
        if not np.isfinite(best[:, length]).all():
            raise RuntimeError("a stretch has no encoding")
        return [self._trace(matrix[r], last[r], back[r]) for r in range(n)]

    def _trace(self, row, last, back) -> np.ndarray:
        out, end = [], len(row)
        while end:
            if last[end] >= 0:
                out.append(int(last[end]))
            elif self.bytes is None:
                out.append(self.unknown)
            else:
                raw = row[end - 1:end].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
                out.extend(int(self.bytes[b]) for b in reversed(raw))
            end = back[end]
        return np.array(out[::-1], np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD."""
        size = self.raw_at[ids + 1] - self.raw_at[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.raw_at[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        text = self.raw[at].tobytes().decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


@functools.cache
def _point_hash() -> np.ndarray:
    return mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(0xA0761D6478BD642F))


@functools.cache
def _powers(radix: np.uint64, bits: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full((1 << bits) - 1, radix)]), dtype=np.uint64)


def powers(radix: np.uint64, n: int) -> np.ndarray:
    """radix^0 .. radix^(n-1) modulo 2^64."""
    return _powers(radix, max(0, n - 1).bit_length())[:n]


@functools.cache
def vocabulary_of(path: str) -> Vocabulary:
    return Vocabulary(path)


def prefix_sums(matrix: np.ndarray) -> np.ndarray:
    """Cumulated hash(c_i) * RADIX^i along the last axis, with a zero ahead; arithmetic modulo 2^64."""
    n = matrix.shape[-1]
    out = np.zeros((*matrix.shape[:-1], n + 1), np.uint64)
    np.cumsum(_point_hash()[matrix] * powers(RADIX, n), axis=-1, dtype=np.uint64, out=out[..., 1:])
    return out


def substring_keys(sums: np.ndarray, start: int, end: int) -> np.ndarray:
    """Hashes of the substrings [start, end) of each row, wherever they stand."""
    shift = np.uint64(pow(int(RADIX_INVERSE), start, 1 << 64))
    return mix((sums[:, end] - sums[:, start]) * shift + np.uint64(end - start))


class Encoder:
    """Encodes texts with a vocabulary; remembers the stretches it has seen, also from task to task of a worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.seen: dict[int, np.ndarray] = {}

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; blocks of about BLOCK code points are encoded at once, longer texts in several."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held, owner, total = [], [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            p = points(((" " if self.v.prefix else "") + text).replace(" ", MARK))
            for part in self._parts(p):
                held.append(part)
                owner.append(i)
                total += len(part)
                if total >= BLOCK:
                    self._flush(held, owner, out)
                    held, owner, total = [], [], 0
        self._flush(held, owner, out)
        return [np.concatenate(x) if x else np.empty(0, np.int32) for x in out]

    def _parts(self, p: np.ndarray):
        """A long text in parts that end at a cut."""
        while len(p) > BLOCK:
            safe = np.flatnonzero(~self.v.joined[_pair_slot(p[:BLOCK], p[1:BLOCK + 1])])
            if not len(safe):
                safe = np.flatnonzero(~self.v.joined[_pair_slot(p[:-1], p[1:])])[:1]
                if not len(safe):
                    break
            yield p[:safe[-1] + 1]
            p = p[safe[-1] + 1:]
        yield p

    def _flush(self, held, owner, out) -> None:
        if not held:
            return
        p = np.concatenate(held)
        new = np.ones(len(p) + 1, bool)
        new[1:-1] = ~self.v.joined[_pair_slot(p[:-1], p[1:])]
        new[np.cumsum([len(h) for h in held])] = True
        at = np.flatnonzero(new)
        size = np.diff(at)
        sums = prefix_sums(p)
        keys = mix((sums[at[1:]] - sums[at[:-1]]) * powers(RADIX_INVERSE, len(p))[at[:-1]] + size.astype(np.uint64))
        unique, first, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.seen) > MEMORY:
            self.seen.clear()
        names = unique.tolist()
        fresh = [k for k, name in enumerate(names) if name not in self.seen]
        self._learn(p, at, size, first[fresh], [names[k] for k in fresh])
        ids = [self.seen[name] for name in names]
        count = np.array([len(x) for x in ids])
        flat = np.concatenate(ids)
        begin = (np.cumsum(count) - count)[which]
        n = count[which]
        ends = np.cumsum(n)
        result = flat[np.repeat(begin - (ends - n), n) + np.arange(ends[-1])]
        marks = np.searchsorted(at, np.cumsum([len(h) for h in held]))  # stretches before each part's end
        stop = 0
        for i, m in zip(owner, marks.tolist()):
            out[i].append(result[stop:ends[m - 1]])
            stop = ends[m - 1]

    def _learn(self, p, at, size, stretches, names) -> None:
        lengths = size[stretches]
        order = np.argsort(lengths, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            step = max(1, BLOCK // max(1, int(lengths[group[0]]) if len(group) else 1))
            for lo in range(0, len(group), step):
                some = group[lo:lo + step]
                n = int(lengths[some[0]])
                matrix = p[at[stretches[some]][:, None] + np.arange(n)]
                for k, ids in zip(some.tolist(), self.v.encode_rows(matrix)):
                    self.seen[names[k]] = ids


@functools.lru_cache(maxsize=1)
def encoder_of(vocabulary: Vocabulary) -> Encoder:
    return Encoder(vocabulary)


def _arrow_ids(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*ids, np.empty(0, np.int32)]).astype(np.int32)))


def _sha(text: str | None) -> str:
    return hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).hexdigest()


def encode(docs: DataFrame, path: str, *keep: str) -> DataFrame:
    """(doc_id, ids array<int>, text_sha256, *keep) per row of ``docs``: the ids the model gives the whole text.

    No begin or end ids are added.  A null or empty text has no ids.  A null doc_id is returned as null; repeated rows
    are returned as often as they come; other columns are not read; an empty table gives no rows.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(vocabulary_of(path))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)

    def run(batches):
        encoder = encoder_of(vocabulary.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = part.column(1).to_pylist()
                yield pa.record_batch([part.column(0), _arrow_ids(encoder.encode(texts)), pa.array([_sha(t) for t in texts]), *part.columns[2:]], names=["doc_id", "ids", "text_sha256", *keep])

    return docs.mapInArrow(run, ", ".join(["doc_id long, ids array<int>, text_sha256 string", *_kinds(docs, keep)]))


def _kinds(df: DataFrame, columns) -> list[str]:
    return [f"{c} {df.schema[c].dataType.simpleString()}" for c in columns]


def decode(encoded: DataFrame, path: str, *keep: str) -> DataFrame:
    """(doc_id, text, *keep): the texts of the ids; no ids, or null, give the empty text."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(vocabulary_of(path))
    encoded = encoded.select("doc_id", "ids", *keep)

    def run(batches):
        for batch in batches:
            texts = [vocabulary.value.decode(np.asarray(x.values, dtype=np.int32)) if x.is_valid else "" for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string()), *batch.columns[2:]], names=["doc_id", "text", *keep])

    return encoded.mapInArrow(run, ", ".join(["doc_id long, text string", *_kinds(encoded, keep)]))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_pieces, ids_sha256, text_sha256, same): digests of the ids, and whether decoding gives the text back."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(vocabulary_of(path))

    def run(batches):
        for batch in batches:
            rows = [np.asarray(x.values, dtype="<i4") for x in batch.column(1)]
            sha = [_sha(vocabulary.value.decode(x)) for x in rows]
            yield pa.record_batch([
                batch.column(0), pa.array([len(x) for x in rows], pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in rows], pa.string()),
                batch.column(2), pa.array([a == b for a, b in zip(sha, batch.column(2).to_pylist())], pa.bool_()),
            ], names=["doc_id", "n_pieces", "ids_sha256", "text_sha256", "same"])

    return encode(docs, path).mapInArrow(run, "doc_id long, n_pieces long, ids_sha256 string, text_sha256 string, same boolean")
