import random

from cloudloom.llm import catalog, mixing, quality_rules

from .helpers import documents, same_as_sql

SMALL = "/root/testdata/sf0.001/documents.parquet"


def _rows(seed=1, n=150):
    rnd = random.Random(seed)
    vocab = ["a", "b7", "#tag", "é", "word", "long|er", "x" * 40, "7"]
    rows = []
    for i in range(n):
        lines = [" ".join(rnd.choice(vocab) for _ in range(rnd.randrange(0, 12))) for _ in range(rnd.randrange(1, 5))]
        if rnd.random() < 0.5:
            lines.insert(rnd.randrange(len(lines) + 1), rnd.choice(["Read  more at page 7 of this fine site", " read more at page 3 of this fine site\t", "Footer"]))
        if rnd.random() < 0.2:
            lines.append(" ".join(f"u{rnd.randrange(10**6)}" for _ in range(30)))
        rows.append((i, rnd.choice(["\n", "\n\n", "\r\n"]).join(lines), rnd.choice(["s1", "s1", "s2", "é", None])))
    # Thirty documents whose common line is more than half of them, and thirty with enough beside it.
    rows += [(1000 + i, "Subscribe to our weekly letter and never miss a story again today\n" + " ".join(f"v{i}x{j}" for j in range(8 if i < 30 else 40)), "s1") for i in range(60)]
    rows += [(500, None, "s1"), (501, "", None), (502, " \t\n", "s2"), (None, "one two three", "s1"), (None, None, None), (503, "w " * 4000, "s9"), rows[3], rows[3], (504, "", "empty source")]
    return rows


def test_quality_rules_match_sql(spark):
    rows = _rows()
    got = quality_rules.quality_rules(documents(spark, rows, extra=True))
    same_as_sql(got, catalog.ORACLES["op7_quality_rules"], {"documents": rows})
    assert 0 < got.filter("NOT kept AND NOT base_failed").count()
    kept = quality_rules.keep_good(documents(spark, rows))
    assert kept.count() == got.filter("kept").count() and kept.columns == documents(spark, []).columns


def test_quality_rules_on_tables(spark):
    same_as_sql(catalog.QUERIES["op7_quality_rules"](spark, "/root/testdata/sf0.001"), catalog.ORACLES["op7_quality_rules"], {"documents": SMALL})


def test_mix_matches_sql(spark):
    rows = _rows(2)
    docs = documents(spark, rows, extra=True)
    got = mixing.mix_sources(docs)
    same_as_sql(got, catalog.ORACLES["op6_mix_sources"], {"documents": rows})
    assert got.filter("taken > 2 * size OR taken < 0").count() == 0
    repeated = mixing.repeat_documents(docs, got)
    assert repeated.columns == docs.columns and repeated.count() > 0


def test_mix_on_tables(spark):
    got = catalog.QUERIES["op6_mix_sources"](spark, "/root/testdata/sf0.001")
    same_as_sql(got, catalog.ORACLES["op6_mix_sources"], {"documents": SMALL})
    for r in got.groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 0.5
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, catalog.QUERIES["op6_mix_sources"](spark, "/root/testdata/sf0.001").collect()))


def test_sources_smaller_than_a_slot_get_their_target(spark, monkeypatch):
    """Forty sources of three words beside one of 30,000, with slots of some hundred words."""
    monkeypatch.setattr(mixing, "SLOTS", 1 << 8)
    rows = [(i, "a b c", f"s{i:02d}") for i in range(40)] + [(100 + i, "w " * 300, "z") for i in range(100)]
    got = mixing.mix_sources(documents(spark, rows)).collect()
    assert all(r.taken == r.target == 6 for r in got if r.source != "z")
    big = [r for r in got if r.source == "z"]
    assert sum(r.taken for r in big) == int(big[0].target + 0.5) and all(0 <= r.taken <= 2 * r.size for r in big)


def test_mix_in_several_cells(spark, monkeypatch):
    rows = _rows(3)
    want = sorted(map(repr, mixing.mix_sources(documents(spark, rows)).collect()))
    monkeypatch.setattr(mixing, "CELL_ROWS", 1)
    assert sorted(map(repr, mixing.mix_sources(documents(spark, rows)).collect())) == want


def test_empty_tables(spark):
    docs = documents(spark, [])
    assert quality_rules.quality_rules(docs).count() == 0
    assert mixing.mix_sources(docs).count() == 0
    assert mixing.mix_sources(documents(spark, [(1, None, "a"), (2, "", None)])).count() == 2
