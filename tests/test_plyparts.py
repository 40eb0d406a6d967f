import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from cloudloom.sources import fixedwidth as fw
from cloudloom.sources import sinks
from cloudloom.sources.plyparts import INDEX, PlyPartsWriter, listed, place


@pytest.fixture(autouse=True)
def _sources(spark):
    fw.register(spark)


def _rows(spark, n=1000):
    pdf = pd.DataFrame({"scan_id": ["ab"[i % 2] for i in range(n)], "point_id": range(n), "x": np.arange(n) * 0.5, "y": 1.0, "z": -1.0, "r": 255, "g": 0, "b": 7, "class_id": [i % 5 - 1 for i in range(n)]})
    return spark.createDataFrame(pdf).repartition(7)


def _held(path):
    return sorted(f for f in os.listdir(path) if f.endswith(".ply"))


def test_scans_apart_in_order_and_appended(spark, tmp_path):
    path = f"file:{tmp_path}/out"
    assert sinks.write_parts(_rows(spark), path) == 1000
    got = spark.read.format("ply").option("rowsPerSplit", 33).load(path).toPandas().sort_values(["scan_id", "point_id"])
    for k, scan in enumerate("ab"):
        part = got[got.scan_id == scan]
        assert part.point_id.tolist() == list(range(500)) and part.x.tolist() == [0.5 * (2 * i + k) for i in range(500)]
        assert part.class_id.tolist() == [(2 * i + k) % 5 - 1 for i in range(500)]
    assert (got.r == 255).all() and (got.b == 7).all()
    assert sinks.write_parts(_rows(spark, 10), path, append=True) == 10
    again = spark.read.format("ply").load(path).filter("scan_id = 'b'")
    assert sorted(r.point_id for r in again.collect()) == list(range(505)) and again.filter("point_id = 500 AND x = 0.5").count() == 1
    assert sinks.write_parts(_rows(spark, 4), path) == 4
    assert spark.read.format("ply").load(path).count() == 4
    assert _held(f"{tmp_path}/out") == sorted(e["file"] for e in listed(path))


def test_empty_null_and_odd_columns(spark, tmp_path):
    path = str(tmp_path / "none")
    assert sinks.write_parts(_rows(spark).limit(0), path) == 0 and spark.read.format("ply").load(path).count() == 0
    nulls = spark.createDataFrame([(None, 1, 1.0, None, 2.0, None), ("s", 2, 0.0, 0.0, 0.0, 5)], "scan_id string, point_id long, x double, y double, z double, instance_id long")
    assert sinks.write_parts(nulls, path) == 2
    rows = {r.scan_id: r for r in spark.read.format("ply").load(path).collect()}
    assert rows[""].instance_id == 0 and np.isnan(rows[""].y) and rows["s"].instance_id == 5 and rows["s"].r is None
    with pytest.raises(Exception, match="PLY type"):
        sinks.write_parts(nulls.selectExpr("*", "'t' AS name"), path)
    with pytest.raises(Exception):
        sinks.write_parts(nulls.selectExpr("scan_id", "point_id", "x", "y", "z", "300 AS r", "0 AS g", "0 AS b"), path)
    assert spark.read.format("ply").load(path).count() == 2


def test_aborted_job_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_parts(_rows(spark, 20), path)
    before = _held(path), open(f"{path}/{INDEX}").read()

    def late(batches):
        for b in batches:
            yield b
            raise ValueError("lost")

    bad = _rows(spark).mapInArrow(late, _rows(spark).schema)
    with pytest.raises(Exception, match="lost"):
        bad.write.format("ply").option("rowsPerFile", 3).mode("overwrite").save(path)
    assert (_held(path), open(f"{path}/{INDEX}").read()) == before


def test_retried_task_counts_once(spark, tmp_path):
    """A first attempt dies after writing files; the second one's message is committed, the first one's files go."""
    path = str(tmp_path / "out")
    writer = PlyPartsWriter(path, _rows(spark, 1).schema, True, rows_per_file=4)
    batch = pa.RecordBatch.from_pydict({"scan_id": ["a"] * 10, "point_id": list(range(10)), "x": [float(i) for i in range(10)], "y": [0.0] * 10, "z": [0.0] * 10, "r": [1] * 10, "g": [2] * 10, "b": [3] * 10, "class_id": [9] * 10})

    def dies():
        yield batch
        raise ConnectionError

    with pytest.raises(ConnectionError):
        writer.write(dies())
    assert len(_held(path)) == 2
    other = PlyPartsWriter(path, _rows(spark, 1).schema, False)
    theirs = other.write(iter([batch]))
    writer.commit([writer.write(iter([batch, batch])), None])
    assert [e["rows"] for e in listed(path)] == [4, 4, 4, 4, 4] and len(_held(path)) == 6
    other.commit([theirs])
    got = spark.read.format("ply").load(path)
    assert got.count() == 30 and got.agg({"point_id": "max"}).first()[0] == 29 and len(_held(path)) == 6


def test_places():
    assert place("file:/a/b")[1] == place("file:///a/b")[1] == place("/a/b")[1] == "/a/b"


def test_bundle(spark, tmp_path):
    path = f"file://{tmp_path}/new/bundle"
    labels = _rows(spark, 50).selectExpr("scan_id", "point_id", "class_id", "class_id AS instance_id")
    manifest = spark.createDataFrame([("class", "1", 10.0)], "section string, key string, value double")
    hulls = spark.createDataFrame([(1, [0.0, 1.0])], "instance_id int, vertices array<double>")
    assert sinks.export_bundle(_rows(spark, 50).drop("class_id", "r", "g", "b"), labels, manifest, path, hulls) == 50
    assert spark.read.json(f"{path}/manifest").count() == 1 and spark.read.parquet(f"{path}/hulls").count() == 1
    assert spark.read.format("ply").load(f"{path}/points").filter("r = 0 AND class_id = instance_id").count() == 50
