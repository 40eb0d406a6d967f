"""Row-keeping functions on tables whose columns are called like any helper's."""

import pytest

from cloudloom.llm import chunk_dedup, exact_dedup, mixing, ngram_jaccard, quality_rules

from .helpers import documents

NAMES = ("_n", "_id", "kept", "_kept", "_at", "_k1", "_gone", "_cuts", "_tag", "row", "id", "n", "of", "stays", "tag", "lost", "rest", "k1", "k2", "at", "salt", "copy", "node", "cuts", "times", "col", "e")
PLAIN = ["doc_id", "text", "lang", "source", "n_chars"]
STAGES = {
    "repeat_documents": lambda d: mixing.repeat_documents(d, mixing.mix_sources(d)),
    "keep_first_exact": lambda d: exact_dedup.keep_first(d, exact_dedup.exact_dedup(d)),
    "keep_good": quality_rules.keep_good,
    "clean_good": quality_rules.clean_good,
    "keep_first_near": lambda d: ngram_jaccard.keep_first(d, ngram_jaccard.jaccard_components(d)),
    "remove_repeats": chunk_dedup.remove_repeats,
}


def _rows():
    rows = [(i, f"a common line of the site that all of its pages carry in the same place\n" + " ".join(f"word{i % 25}x{j}" for j in range(60)), "ab"[i % 2]) for i in range(60)]
    return rows + [(None, "short", None), (100, None, "a"), (101, "", None), (3, rows[3][1], "b"), (None, rows[5][1], "b")]


@pytest.mark.parametrize("name", STAGES)
def test_clashing_columns_change_nothing(spark, name):
    docs = documents(spark, _rows())
    wide = docs.selectExpr("*", *(f"concat('{n}', doc_id) AS {n}" for n in NAMES))
    got = STAGES[name](wide)
    assert got.columns == wide.columns
    rows = got.collect()
    assert all(r[n] == (None if r.doc_id is None else f"{n}{r.doc_id}") for r in rows for n in NAMES)
    assert sorted(repr(tuple(r[c] for c in PLAIN)) for r in rows) == sorted(map(repr, map(tuple, STAGES[name](docs).collect())))


def test_counts_are_per_id_and_source(spark):
    """Rows that share an id, or have none, get the count of their own source."""
    rows = [(i, "w " * 50, "big") for i in range(40)] + [(None, "x " * 30, "big"), (7, "y " * 20, "mid"), (None, None, "mid"), (8, "z " * 10, "small")]
    docs = documents(spark, rows)
    mixed = mixing.mix_sources(docs)
    want = {}
    for r in mixed.collect():
        n = int(r.taken / r["size"] + 0.5) if r["size"] else 0
        want[(r.doc_id, r.source)] = max(want.get((r.doc_id, r.source), 0), n)
    expect = sorted(repr((i, s)) for i, t, s in rows for _ in range(want[(i, s)]))
    assert sorted(repr((r.doc_id, r.source)) for r in mixing.repeat_documents(docs, mixed).collect()) == expect
