"""run() and its stages against a plain Python version."""

import random
import re

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline
from cloudloom.llm import mixing, quality_rules

from .helpers import DOCS, documents
from .test_dedup import _brute


def _rows():
    rnd = random.Random(9)
    vocab = [f"word{i}" for i in range(2000)]
    base = [[rnd.choice(vocab) for _ in range(rnd.choice([15, 60, 200]))] for _ in range(60)]
    rows = []
    for i in range(160):
        w = list(rnd.choice(base))
        if i % 3 == 0:
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((i, " ".join(w), rnd.choice(["a", "b", None])))
    return rows + [(300, None, "a"), (301, "few words", "a"), (302, "spam " * 50, "b"), rows[4], (None, " ".join(rnd.choice(vocab) for _ in range(40)), "b")]


def test_stages_match_brute_force(spark, tmp_path):
    rows = _rows()
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "lang": ["en"] * len(rows), "source": [r[2] for r in rows], "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64())})
    pq.write_table(table, f"{tmp_path}/documents.parquet")
    docs = documents(spark, rows)
    state, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        state = spark.createDataFrame(stage(spark, state, str(tmp_path)).collect() or [], DOCS if name != "sentencepiece" else "doc_id long, source string, ids array<int>, n_pieces long")
        seen.append(state)
    pick = lambda df: [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]
    good = {(r.doc_id) for r in quality_rules.quality_rules(docs).filter("kept").collect()}
    want = [r for r in rows if r[0] in good]
    assert sorted(map(repr, pick(seen[0]))) == sorted(map(repr, want)) and {300, 301, 302}.isdisjoint(good)
    first = {}
    for r in sorted(want, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), r)
    want = list(first.values())
    assert sorted(map(repr, pick(seen[1]))) == sorted(map(repr, want))
    least = {eval(x)[0]: eval(x)[2] for x in _brute(want, 5, 80, 100)}
    want = [r for r in want if r[0] is None or least[r[0]] == r[0]]
    assert sorted(map(repr, pick(seen[2]))) == sorted(map(repr, want))
    times = {r.doc_id: int(r.taken / r.size + 0.5) for r in mixing.mix_sources(seen[2]).collect() if r["size"]}
    want = [r for r in want for _ in range(times[r[0]])]
    assert sorted(map(repr, pick(seen[3]))) == sorted(map(repr, want))
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted(repr((i, s, library.encode(t), len(library.encode(t)))) for i, t, s in want)
    assert sorted(repr(tuple(r)) for r in seen[4].collect()) == want
    assert sorted(repr(tuple(r)) for r in entry.queries()["pipeline"](spark, str(tmp_path)).collect()) == want


def test_every_stage_takes_an_empty_table(spark):
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0
