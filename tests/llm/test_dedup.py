import hashlib
import random
import re

import pytest

from cloudloom.llm import exact_dedup as ed
from cloudloom.llm import ngram_jaccard as nj

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOCS).repartition(3)


def test_fingerprints_compose():
    rnd = random.Random(1)
    raw = bytes(rnd.randrange(256) for _ in range(5000))
    for at in (0, 1, 17, 4999, 5000):
        assert ed.combine(ed.fingerprint(raw[:at]), ed.fingerprint(raw[at:])) == ed.fingerprint(raw)


def test_squash_matches_pattern():
    for t in ["", " ", " a", "a\t\n b \x0b", "\xa0a  b", None, "x" * 9, "\x1ca"]:
        assert ed.squash(t) == re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()


def test_exact_dedup(spark):
    rnd = random.Random(2)
    long = " ".join(str(rnd.random()) for _ in range(12000))  # several pieces
    rows = [(i, rnd.choice(["a b", "a  b", " a b", "", None, "\t", "é ü", long, long.replace(" ", "\n"), f"own {i}"]), "s") for i in range(120)]
    rows += [(7, "twice", "s"), (7, "twice", "s"), (None, "twice", "s"), (None, "lone", "s"), (500, long + "x", "s"), (501, long[:-1] + "x", "s")]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(norm(t), []).append(i)
    want = []
    for t, ids in groups.items():
        first = min((i for i in ids if i is not None), default=None)
        for k, i in enumerate(sorted(ids, key=lambda v: (v is None, v))):
            want.append((i, first, len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()))
    old = ed.SPREAD
    ed.SPREAD = 5
    try:
        found = ed.exact_dedup(_docs(spark, rows))
        got = [tuple(r)[:5] for r in found.collect()]
    finally:
        ed.SPREAD = old
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    kept = ed.keep_first(_docs(spark, rows), found)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(norm(r.text) for r in kept.collect()) == sorted(groups)


def test_comparison_tells_apart_equal_fingerprints(spark):
    rows = [(1, 9, 0, 5, "a", b"same text"), (1, 9, 0, 6, "b", b"same text"), (1, 9, 0, 7, "c", b"some text")]
    df = spark.createDataFrame(rows, "fp long, n long, salt int, doc_id long, sha string, raw binary").coalesce(1)
    assert [tuple(r) for r in df.mapInArrow(ed._differing, "doc_id long, sha string").collect()] == [(7, "c")]


def _brute(rows, size, num, den):
    sets = []
    for _, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) * den >= len(sets[i] | sets[j]) * num:
                up[root(i)] = root(j)
    best = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            best[root(i)] = min(best.get(root(i), r[0]), r[0])
    return sorted(repr((r[0], len(sets[i]), best.get(root(i)) if sets[i] else r[0])) for i, r in enumerate(rows))


@pytest.mark.parametrize("size,num,den,small", [(3, 90, 100, 32), (5, 80, 100, 32), (3, 90, 100, 3)])
def test_jaccard_components(spark, monkeypatch, size, num, den, small):
    rnd = random.Random(size * small)
    vocab = [f"w{i}" for i in range(300)]
    rows, bases = [], [[rnd.choice(vocab) for _ in range(n)] for n in (12, 30, 80, 200, 600)]
    common = [rnd.choice(vocab) for _ in range(50)]
    for i in range(260):
        w = list(rnd.choice(bases)) if i % 3 else common + [rnd.choice(vocab) for _ in range(rnd.randrange(1, 14))]
        for _ in range(rnd.choice([0, 0, 1, 2, 4, len(w) // 25])):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((i, rnd.choice([" ", "\n", "  "]).join(w).capitalize(), "s"))
    rows += [(900, None, "s"), (901, "", "s"), (902, " \t", "s"), (903, "one", "s"), (904, "ONE", "s"), (905, "one two", "s"), (906, "É é x", "s"), (None, rows[1][1], "s"), (None, "a b c d e f", "s"), (3, rows[3][1], "s")]
    monkeypatch.setattr(nj, "SMALL", small)
    got = nj.jaccard_components(_docs(spark, rows), size, num, den)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == _brute(rows, size, num, den)


def test_empty_tables(spark):
    docs = _docs(spark, [])
    assert ed.exact_dedup(docs).count() == 0
    assert nj.jaccard_components(docs).count() == 0
