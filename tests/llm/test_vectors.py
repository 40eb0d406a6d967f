"""Vector codes, near vectors and hard negatives against SQL and plain numpy versions."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from cloudloom.llm import catalog, hard_negatives, near_vectors, vector_codes

from .helpers import canon

SCHEMA = "vec_id long, embedding array<float>, label int"
NAMES = ("id", "ints", "kept", "w", "n", "node", "cell", "score", "uid", "shard", "code", "error", "of", "low")


def _frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in NAMES if extra else ():
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


def _groups(seed=0, n=150, d=32):
    """Random directions, copies at several similarities, and awkward rows."""
    rnd = np.random.default_rng(seed)
    turn = lambda x, c: c * x + math.sqrt(1 - c * c) * near_vectors.unit(rnd.normal(size=(1, d)))[0]
    rows, base = [], near_vectors.unit(rnd.normal(size=(n, d)))
    for i, x in enumerate(base):
        rows.append((i, (x * rnd.choice([1, 3])).tolist(), int(rnd.integers(10))))
        if i % 3 == 0:
            rows += [(1000 + 10 * i + j, turn(x, c).tolist(), int(rnd.integers(10))) for j, c in enumerate((.99, .97, .95, .9))]
    rows += [(9000 + i, turn(base[0], .995).tolist(), i % 3) for i in range(90)]
    rows += [(500 + i, rows[i][1], None if i == 2 else 4) for i in range(4)]
    rows += [(700, None, 1), (701, [1.0] * (d - 1) + [None], 2), (702, [float("nan")] * d, 3), (703, [1.0] * (d - 1) + [float("inf")], 3), (704, [0.0] * d, 3), (None, base[5].tolist(), 5), rows[3], rows[3], (None, rnd.normal(size=d).tolist(), None)]
    return rows


def _same_as_sql(df, name, rows):
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": pa.array([r[2] for r in rows], pa.int32())}))
    cur = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = cur.fetchall()
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(want, names)
    return want


def test_masks_find_the_nearest_entry():
    rnd = np.random.default_rng(3)
    for entries, w in ((64, 4), (64, 1), (7, 3), (1, 5)):
        book = rnd.integers(-9, 9, size=(entries, w))
        x = rnd.integers(-12, 12, size=(3000, w))
        d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        entry, dist = vector_codes.Slices(book).nearest(x)
        assert (entry == d.argmin(axis=1)).all() and (dist == d.min(axis=1)).all()  # argmin takes the lower of ties
        s, r = vector_codes.Slices(book), rnd.integers(0, 8, size=3000)
        inside = (np.abs(x[:, None] - book[None]) <= r[:, None, None]).all(axis=2)
        assert (s.masks(x, r) == (inside * (np.uint64(1) << np.arange(entries, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)).all()


def test_vector_codes_match_sql(spark):
    rows = _groups()
    got = vector_codes.compress(_frame(spark, rows))
    assert len(_same_as_sql(got, "op11_vector_codes", rows)) == len(rows) - 4
    few = rows[:5]
    _same_as_sql(vector_codes.compress(_frame(spark, few)), "op11_vector_codes", few)


def test_vector_codes_refuse_what_has_no_result(spark):
    with pytest.raises(ValueError, match="components in one table"):
        vector_codes.compress(_frame(spark, [(1, [1.0] * 16, 1), (2, [1.0] * 32, 1)]))
    with pytest.raises(ValueError, match="do not divide"):
        vector_codes.compress(_frame(spark, [(1, [1.0] * 17, 1)]))
    with pytest.raises(ValueError, match="beyond"):
        vector_codes.compress(_frame(spark, [(1, [1e9] * 16, 1)]))


@pytest.mark.parametrize("tile", [1024, 24])
def test_near_vectors_match_sql(spark, monkeypatch, tile):
    rows = [r for r in _groups(1) if not (r[0] is not None and 1000 <= r[0] < 9000 and r[0] % 10 == 3)]  # the limit itself is another test's
    monkeypatch.setattr(near_vectors, "TILE", tile)
    monkeypatch.setattr(near_vectors.Grid, "_margin", lambda *a: 0.6)  # wide enough to meet all
    want = _same_as_sql(near_vectors.near_vectors(_frame(spark, rows)), "op12_near_vectors", rows)
    assert max(r[1] for r in want) >= 90


def test_near_vectors_recall_at_the_limit(spark):
    """Pairs just above the least similarity, the hardest ones: nine of ten are found, and nothing below it."""
    rnd = np.random.default_rng(8)
    base = near_vectors.unit(rnd.normal(size=(4000, 64)))
    away = rnd.normal(size=base.shape)
    away = near_vectors.unit(away - (away * base).sum(axis=1, keepdims=True) * base)
    cos = np.where(np.arange(4000) % 2 == 0, .901, .899)[:, None]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(np.concatenate([base, cos * base + np.sqrt(1 - cos * cos) * away]))]
    got = {r.vec_id: r for r in near_vectors.near_vectors(_frame(spark, rows, False)).collect()}
    found = sum(got[i].n_links for i in range(0, 4000, 2))
    assert 1800 <= found <= 2000 and sum(r.n_links for r in got.values()) == 2 * found
    assert all(got[i].component_id == got[i + 4000].component_id for i in range(0, 4000, 2) if got[i].n_links)


@pytest.mark.parametrize("shard,block", [(1024, 1024), (16, 3)])
def test_hard_negatives_match_sql(spark, monkeypatch, shard, block):
    rows = [r for r in _groups(2) if r[0] is None or r[0] < 9000] + [(50 * i + 20000, r[1], r[2]) for i, r in enumerate(_groups(4, 60)[:80])]
    ids = [r[0] for r in rows]
    rows = [r for r in rows if r[0] is None or ids.count(r[0]) == 1]
    monkeypatch.setattr(hard_negatives, "SHARD", shard)
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "PASS", 4)
    want = _same_as_sql(hard_negatives.mine_embeddings(_frame(spark, rows)), "op13_hard_negatives", rows)
    assert len(want) > 100


def test_threshold_leaves_rows_unread():
    """Where a few components decide, most rows are never scored, and the result is that of reading all."""
    rnd = np.random.default_rng(6)
    vecs = rnd.integers(-3, 4, size=(2000, 8)).astype(np.int32)
    vecs[:, 0] = rnd.permutation(np.arange(2000) * 50)
    ids, labels = np.arange(2000), rnd.integers(0, 2, 2000)
    a = np.array([[100, 0, 0, 1, 0, 0, 0, -1]])
    lists = hard_negatives.Lists(np.full((1, 1), -(1 << 62)), np.full((1, 1), 1 << 62), np.full((1, 1), hard_negatives.NONE), 5)
    scored = hard_negatives.search_shard(ids, labels, vecs, np.argsort(vecs, axis=0, kind="stable"), np.array([-1]), np.array([1]), a, lists, True)
    score = vecs.astype(np.int64) @ a[0]
    own = np.flatnonzero(labels == 1)
    assert scored < 1000 and lists.id[0, 0].tolist() == own[np.lexsort((own, -score[own]))][:5].tolist()


def test_repeated_rows_and_ties_of_hard_negatives(spark):
    e = [[1.0 if i == j else 0.0 for j in range(4)] for i in range(4)]
    rows = [(0, e[0], 0), (1, e[0], 1), (1, e[0], 1), (2, [.5, .5, .0, .0], 2), (3, [.5, .0, .5, .0], 3), (3, [.5, .0, .5, .0], 3), (4, [.96, .0, .0, .0], 2), (7, None, 1), (8, e[0], None)]
    got = sorted(map(tuple, hard_negatives.mine_embeddings(_frame(spark, rows)).collect()))
    one = [(0, 1, k, i, 65536, 32768) for k, i in ((1, 2), (2, 3), (3, 3))]
    assert got == sorted(one * 2)


def test_empty_tables(spark):
    for rows in ([], [(1, None, 1), (2, [float("nan")] * 16, 2)]):
        df = _frame(spark, rows)
        assert vector_codes.compress(df).count() == 0
        assert near_vectors.near_vectors(df).count() == len(rows)
        assert hard_negatives.mine_embeddings(df).count() == 0
