"""Token counts by batch encoding inside Arrow functions; only lengths leave the tasks.

Texts are cut at ASCII white space, where this kind of tokenizer never joins tokens, and the different words of a batch
are encoded in calls of about equal bytes; longer runs without white space are cut before ASCII digits that follow an
ASCII letter or digit, since every digit is a token of its own.
"""

from __future__ import annotations

import functools
import json
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a call to the library, and of a word that is cut further.
CALL_BYTES = 1 << 18
LONG_WORD = 1 << 12
#: Bytes of texts taken at once.
BATCH_BYTES = 1 << 23
#: Words that a worker remembers, none of them longer than this.
MEMORY, MEMORY_WORD = 500_000, 64

DIGIT = re.compile(rb"(?<=[0-9A-Za-z])(?=[0-9])")


def check_cuts(definition: str) -> None:
    """Raise unless texts may be cut at ASCII white space and long words before ASCII digits, as ``Counter`` does.

    Asked of the file: its normalizer works character by character or on white space alone, its first splitter drops all
    that its pattern does not take, the pattern takes no ASCII white space and no digit together with a letter or digit
    before it, and no added token holds white space or a digit.  Two-character probes decide on the pattern.
    """
    import regex

    def fail(what: str):
        raise ValueError(f"tokens cannot be counted word by word: {what}")

    spec = json.loads(definition)
    steps = lambda part, name: [] if part is None else part[name] if part["type"] == "Sequence" else [part]
    for step in steps(spec.get("normalizer"), "normalizers"):
        squeezes = step["type"] == "Replace" and step["pattern"] == {"Regex": r"\s+"} and step["content"] == " "
        if step["type"] not in ("NFC", "Lowercase") and not squeezes:
            fail(f"normalizer {step['type']}")
    first = (steps(spec.get("pre_tokenizer"), "pretokenizers") or [{"type": "none"}])[0]
    if (first["type"], first.get("behavior"), first.get("invert")) != ("Split", "Removed", True) or "Regex" not in first["pattern"]:
        fail(f"splitter {first['type']} keeps white space")
    pattern = regex.compile(first["pattern"]["Regex"])
    spaces, digits = " \t\n\v\f\r", "0123456789"
    marks = [chr(c) for c in range(33, 127)] + ["é", "٣", "漢", "€"]
    for mark in marks:
        for space in spaces:
            if any(c in spaces for pair in (mark + space, space + mark) for found in pattern.finditer(pair) for c in found.group()):
                fail("the pattern takes white space")
        for digit in digits if mark.isalnum() and mark.isascii() else ():
            if any(found.group() == mark + digit for found in pattern.finditer(mark + digit)):
                fail("the pattern takes a digit with what is before it")
    if spec["model"].get("type") != "BPE" or any(c in spaces + digits for t in spec.get("added_tokens", ()) for c in t["content"]):
        fail("model or added tokens")


class Counter:
    """Counts tokens with a tokenizer given as the JSON text of its file."""

    def __init__(self, definition: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, int] = {}

    def _encode(self, words: list[bytes]) -> None:
        got = self.tokenizer.encode_batch([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        self.known.update(zip(words, map(len, got)))

    def learn(self, words: set[bytes]) -> None:
        """Encodes what is new, in calls balanced by bytes."""
        new = sorted(words - self.known.keys(), key=len)
        call, size = [], 0
        for word in new:
            call.append(word)
            size += len(word) + 16
            if size >= CALL_BYTES:
                self._encode(call)
                call, size = [], 0
        if call:
            self._encode(call)

    def count(self, texts: list[bytes]) -> list[int]:
        if len(self.known) > MEMORY:
            self.known.clear()
        split = []
        for text in texts:
            words = text.split()
            if len(text) > LONG_WORD and any(len(w) > LONG_WORD for w in words):
                words = [part for w in words for part in (DIGIT.split(w) if len(w) > LONG_WORD else (w,))]
            split.append(words)
        self.learn(set().union(*split))
        got = [sum(map(self.known.__getitem__, words)) for words in split]
        for word in [w for w in self.known if len(w) > MEMORY_WORD]:
            del self.known[word]
        return got


@functools.lru_cache(maxsize=1)
def counter_of(definition: str) -> Counter:
    return Counter(definition)


def slices(column: pa.Array, size: int):
    """Consecutive slices of a binary column of about ``size`` bytes, as lists."""
    held, total = [], 0
    for value in column:
        raw = value.as_py() or b""
        held.append(raw)
        total += len(raw)
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of ``docs``: tokens of the whole text.

    Special tokens are not added; their strings inside a text count as the library's default has it.  A null or empty
    text has no tokens.  A null doc_id is returned as null; repeated rows are returned as often as they come; other
    columns are not read; an empty table gives no rows.  A tokenizer that ``check_cuts`` refuses is an error.
    """
    with open(path, encoding="utf-8") as f:
        text = f.read()
    check_cuts(text)
    definition = docs.sparkSession.sparkContext.broadcast(text)

    def run(batches):
        counter = counter_of(definition.value)
        for batch in batches:
            raw = batch.column(1).cast(pa.binary())
            done = 0
            for texts in slices(raw, BATCH_BYTES):
                n = counter.count(texts)
                ids = batch.column(0).slice(done, len(texts))
                done += len(texts)
                yield pa.record_batch([ids, pa.array(list(map(len, texts)), pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
