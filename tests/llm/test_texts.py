import json
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cloudloom.llm import catalog, chunk_dedup, language_id, token_counts

from .helpers import documents

WORDS = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = list("abcxyzABCÉéßñΣσİı .,'\n\t12345漢字🙂  ́\x00\x85\xa0\u2003\x1c") + ["'s", "'LL", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "don't ", "the ", "running "]


def test_token_counts_match_library(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(100))) for _ in range(800)]
    texts += ["x1" * 5000, "é" * 9000 + "7" * 9000, "ab " * 20000, "", None, "a<|endoftext|>b c<|endo", "1 2 33 a1b2"]
    library = Tokenizer.from_file(WORDS)
    rows = [(i if i % 7 else None, t, "s") for i, t in enumerate(texts)]
    got = token_counts.token_counts(documents(spark, rows, extra=True), WORDS)
    want = [(i, len((t or "").encode()), n, n > 2048) for (i, t, _), n in zip(rows, [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)])]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert token_counts.token_counts(documents(spark, []), WORDS).count() == 0


def test_gear_matches_rolling():
    rnd = random.Random(1)
    raw = bytes(rnd.randrange(256) for _ in range(3000))
    h, want = 0, []
    for b in raw:
        h = ((h << 2) + int(chunk_dedup.GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert chunk_dedup.gear(np.frombuffer(raw, np.uint8)).tolist() == want


def test_boundaries_are_local(monkeypatch):
    rnd = random.Random(2)
    text = "".join(rnd.choice("abcdé ,漢") for _ in range(30000)).encode()
    w = chunk_dedup.WINDOW
    h = chunk_dedup.gear(np.frombuffer(text, np.uint8)).tolist()
    want = set()
    for i in range(len(text) - w + 1):
        least = min(h[i:i + w])
        want.add(max(j for j in range(i, i + w) if h[j] == least) + 1)
    want = {next(k for k in range(e, len(text) + 1) if k == len(text) or text[k] & 0xC0 != 0x80) for e in want} | {len(text)}
    whole = chunk_dedup.boundaries(text)
    assert whole.tolist() == sorted(want)
    assert max(np.diff(whole)) <= w + 3
    monkeypatch.setattr(chunk_dedup, "PART", 1000)
    assert chunk_dedup.boundaries(text).tolist() == whole.tolist()
    for cut in (1, 500, 7777):  # an insertion changes boundaries near it only
        other = chunk_dedup.boundaries(text[:cut] + b"inserted" + text[cut:])
        kept = set((other - 8).tolist()) & set(whole.tolist())
        assert all(e in kept for e in whole.tolist() if e > cut + 2 * w + 16)


def _prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9))) for _ in range(n))


def test_substring_dedup(spark):
    rnd = random.Random(4)
    passages = [_prose(rnd, 70) for _ in range(3)]
    rows = [(i, " ".join([_prose(rnd, 60), *([passages[i % 3]] if i % 2 else []), _prose(rnd, 80)]), "s") for i in range(60)]
    rows += [(100, None, "s"), (101, "", "s"), (102, "short", "s"), (None, "short", "s"), (103, passages[0], "s"), (103, passages[0], "s"), (None, _prose(rnd, 50) + passages[0], "s"), (104, (passages[1] + " ") * 3, "s")]
    docs = documents(spark, rows, extra=True)
    got = chunk_dedup.substring_dedup(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        holds = [i for i, t, _ in rows if i == r.doc_id and t and any(p in t for p in passages)]
        if r.doc_id is not None:
            assert (r.repeated_bytes > 0) == bool(holds), r
        assert r.removed_bytes <= r.repeated_bytes <= r.n_bytes
    clean = chunk_dedup.remove_repeats(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert all(texts[i] == t for i, t, _ in rows if i is not None and i < 60 and i % 2 == 0)
    again = {r.doc_id: r for r in chunk_dedup.substring_dedup(clean).collect()}
    assert sum(r.removed_bytes for r in again.values()) < 0.3 * sum(r.removed_bytes for r in got)
    assert chunk_dedup.substring_dedup(documents(spark, [])).count() == 0


def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, test = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    model = language_id.fit(train)
    records = test.select("doc_id", F.col("lang").alias("want"), "text", F.lit(None).cast("string").alias("declared"), F.col("source").alias("host"))
    got = language_id.language_id(records, model)
    assert got.count() == records.count()
    assert got.filter("lang = want").count() > 0.97 * got.count()


def test_language_id_fuses_evidence(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs)
    rows = [(i, t.text, t.lang, f"www.{t.lang}-site.example.{t.lang}") for i, t in enumerate(docs.select("text", "lang").limit(200).collect())]
    rows += [(900, None, "fr", "www.fr-site.example.fr"), (901, "", None, "de-site.example.de"), (902, "x", None, None), (None, None, "zz", "nowhere"), (902, "x", None, None)]
    df = spark.createDataFrame(rows, "id long, text string, declared string, host string").selectExpr("*", "1 AS ll", "2 AS p0", "3 AS n0", "4 AS c", "5 AS _h")
    got = language_id.language_id(df, model)
    assert got.count() == len(rows) and set(got.columns) == {"id", "declared", "host", "ll", "p0", "n0", "c", "_h", "lang", "p", "text_lang"}
    found = {r.id: r.lang for r in got.collect()}
    assert found[900] == "fr" and found[901] == "de" and found[902] in model.names
    assert sum(found[i] == r[2] for i, r in enumerate(rows[:200])) >= 198
    empty = df.limit(0)
    assert language_id.language_id(empty, model).count() == 0
    assert language_id.language_id(df, language_id.fit(docs.limit(0))).filter("lang IS NULL").count() == len(rows)


def test_language_of_pages(spark):
    got = catalog.QUERIES["op9_language_id"](spark, "/root/testdata/sf0.001")
    pages = got.filter("page_id IS NOT NULL")
    assert pages.filter("lang = declared").count() > 0.9 * pages.count()
    assert got.filter("doc_id IS NOT NULL").count() == 200


def test_page_records(spark):
    rows = [(1, "http://a.b.de:80/x", "<!DOCTYPE html><HTML class='x' lang='de'><script>var x='</p>'</script><!-- no --><p>Das <b>ist</b></p></html>"), (2, None, None), (3, "x", "")]
    got = [tuple(r) for r in language_id.page_records(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert [(a, " ".join(b.split()), c, d) for a, b, c, d in got] == [(1, "Das ist", "de", "a.b.de"), (2, "", None, None), (3, "", None, None)]


def test_token_counts_refuse_other_cuts():
    """Files whose tokens may span white space or digits are refused, not counted wrongly."""
    with open(WORDS, encoding="utf-8") as f:
        good = json.load(f)
    token_counts.check_cuts(json.dumps(good))
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, pytest.raises(ValueError, match="white space"):
        token_counts.check_cuts(f.read())
    for change, what in (
        (lambda d: d["pre_tokenizer"]["pretokenizers"][0]["pattern"].update(Regex=r" ?[a-z]+|[0-9]"), "white space"),
        (lambda d: d["pre_tokenizer"]["pretokenizers"][0]["pattern"].update(Regex=r"[a-z]+|[0-9]+"), "digit"),
        (lambda d: d["pre_tokenizer"]["pretokenizers"][0].update(behavior="Isolated"), "splitter"),
        (lambda d: d["normalizer"]["normalizers"].append({"type": "Strip"}), "normalizer"),
        (lambda d: d["added_tokens"].append({"content": "a 1"}), "added"),
        (lambda d: d.update(pre_tokenizer=None), "splitter"),
    ):
        other = json.loads(json.dumps(good))
        change(other)
        with pytest.raises(ValueError, match=what):
            token_counts.check_cuts(json.dumps(other))
