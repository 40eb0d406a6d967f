"""A cross-section of the registered queries against the SQL checks, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
NAMES = [
    "fn17_label_to_class", "prd2_in_obb", "prd3_in_prism", "prd8_slice_export", "jn1_points_in_boxes", "jn1_points_in_prisms", "jn13_attribute_instances",
    "agg9_compare_per_class", "agg12_region_stats", "agg25_label_manifest", "win3_merge_vote", "lab8_undo_redo", "exp3_filters_remap", "val14_region_gate", "cam2_visible", "fn10_catmull_rom", "src3_las", "src6_instances", "src14_raw_source",
]


def _canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([0.0 if r[i] == 0 and isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    want = _canon(cur.fetchall(), [c[0] for c in cur.description])
    df = entry.queries()[name](spark, SMALL)
    assert _canon([tuple(r) for r in df.collect()], df.columns) == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
