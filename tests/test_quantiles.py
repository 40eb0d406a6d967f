"""Quantiles by refined bins against numpy, and the operators that use them."""

import numpy as np
import pytest

from cloudloom.functions.values import query_intensity
from cloudloom.operators import export as ex
from cloudloom.operators import quantiles

PROBS = (0.0, 0.37, 0.5, 0.9, 1.0)


def _got(df, groups):
    return {tuple(r[g] for g in groups) + (r.p,): r.quantile for r in df.collect()}


@pytest.mark.parametrize("few", [0, 100_000])
def test_groups_against_numpy(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "BINS", 64)
    monkeypatch.setattr(quantiles, "FEW", few)
    rng = np.random.default_rng(5)
    data = {
        "even": rng.uniform(-3, 3, 700), "heavy": np.exp(rng.normal(size=400) * 6), "ties": rng.integers(0, 4, 500) * 1.0,
        "one": np.array([7.25]), "same": np.full(40, -2.5), "wide": np.array([-1.7e308, -1.0, 0.0, 1.7e308]), None: np.arange(11.0),
    }
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("even", None), ("even", float("nan")), ("one", float("inf")), ("empty", None)]
    table = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = _got(quantiles.exact_quantiles(table, ["g"], "v", PROBS), ["g"])
    assert len(got) == len(data) * len(PROBS)
    for k, vs in data.items():
        ordered = np.sort(vs)
        for p in PROBS:
            at = p * (len(vs) - 1)
            low, high, w = ordered[int(np.floor(at))], ordered[int(np.ceil(at))], at - np.floor(at)
            assert np.isclose(got[(k, p)], low * (1 - w) + high * w, rtol=1e-12, atol=0), (k, p)


def test_whole_table_and_clashing_names(spark):
    table = spark.createDataFrame([(i % 3, float(i), 1, 2) for i in range(30)], "k int, v double, lo int, want int")
    assert _got(quantiles.exact_quantiles(table, [], "v", [0.5]), []) == {(0.5,): 14.5}
    assert _got(quantiles.exact_quantiles(table, ["k", "want"], "v", [0.5]), ["k", "want"]) == {(0, 2, 0.5): 13.5, (1, 2, 0.5): 14.5, (2, 2, 0.5): 15.5}
    assert quantiles.exact_quantiles(table.limit(0), ["k"], "v", [0.5]).count() == 0


def test_spacing_measures_every_point_unless_a_sample_is_asked(spark, cloud):
    xyz = np.array([(i * i * 0.5, 0.0, 0.0) for i in range(12)])
    gaps = [0.5] + [abs(2 * i - 1) * 0.5 for i in range(1, 12)]
    row = ex.sample_spacing(cloud(xyz)).first()
    assert np.allclose([row.p50, row.p90], np.percentile(gaps, [50, 90]))
    assert tuple(ex.sample_spacing(cloud(xyz[:1])).first()) == (0.0, 0.0)
    assert ex.sample_spacing(cloud(xyz), sample=4).first().p50 > 0


def test_intensity_caps_per_query(spark):
    rows = [("a", float(i)) for i in range(-3, 21)] + [("b", -1.0), (None, 4.0), (None, 8.0)]
    out = query_intensity(spark.createDataFrame(rows, "query string, value double"), "value", 50.0)
    got = {(r.query, r.value): r.norm for r in out.collect()}
    assert np.isclose(got[("a", 7.0)], 7 / 10.5)
    assert got[("a", -3.0)] == 0 and got[("a", 20.0)] == 1 and got[("b", -1.0)] == 0 and np.isclose(got[(None, 4.0)], 4 / 6)
