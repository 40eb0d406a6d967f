import json
import struct

import numpy as np
import pytest

from cloudloom.sources import documents as doc
from cloudloom.sources import fixedwidth as fw
from cloudloom.sources import sinks


@pytest.fixture(autouse=True)
def _sources(spark):
    fw.register(spark)


def test_ply_optional_columns_and_splits(spark, cloud, tmp_path):
    xyz = np.random.default_rng(0).normal(size=(250, 3)).astype("f4").astype(float)
    path = str(tmp_path / "a.ply")
    assert sinks.write_ply(cloud(xyz), path) == 250
    assert fw.ply_vertex_count(path) == 250
    back = spark.read.format("ply").option("rowsPerSplit", 60).load(path).toPandas().sort_values("point_id")
    assert np.array_equal(back[["x", "y", "z"]].to_numpy(), xyz)
    assert back.r.isna().all() and back.label.isna().all()


def test_las_scale_offset_rgb(spark, tmp_path):
    n, fmt, size = 40, 3, 34
    head = bytearray(227)
    head[:4] = b"LASF"
    head[24], head[25] = 1, 2
    struct.pack_into("<H", head, 94, 227)
    struct.pack_into("<I", head, 96, 227)
    head[104] = fmt
    struct.pack_into("<H", head, 105, size)
    struct.pack_into("<I", head, 107, n)
    struct.pack_into("<6d", head, 131, 0.001, 0.001, 0.001, 10, 20, 30)
    rec = np.zeros(n, np.dtype({"names": ["X", "Y", "Z", "i", "r"], "formats": ["<i4"] * 3 + ["<u2", "<u2"], "offsets": [0, 4, 8, 12, 28], "itemsize": size}))
    rec["X"], rec["i"], rec["r"] = np.arange(n) * 1000, 7, 60000
    path = tmp_path / "a.las"
    path.write_bytes(bytes(head) + rec.tobytes())
    rows = spark.read.format("las").load(str(path)).orderBy("point_id").collect()
    assert len(rows) == n and rows[3].x == 13.0 and rows[3].y == 20.0 and rows[0].r == 60000 and rows[0].intensity == 7.0
    head[104] = fmt | 0x80
    path.write_bytes(bytes(head) + rec.tobytes())
    with pytest.raises(ValueError):
        fw.las_layout(str(path))


def test_npy_and_potree(spark, tmp_path):
    np.save(tmp_path / "l.npy", np.arange(-1, 30, dtype=np.int8))
    out = fw.read_labels_npy(spark, str(tmp_path / "l.npy"), 31, "s").orderBy("point_id").collect()
    assert out[0].value == -1 and len(out) == 31
    with pytest.raises(ValueError):
        fw.read_labels_npy(spark, str(tmp_path / "l.npy"), 30)
    tree = tmp_path / "tree"
    tree.mkdir()
    attrs = [{"name": "position", "size": 12}, {"name": "rgb", "size": 6}]
    (tree / "metadata.json").write_text(json.dumps({"scale": [0.01] * 3, "offset": [1, 2, 3], "attributes": attrs, "encoding": "DEFAULT"}))
    rec = np.zeros(5, np.dtype([("p", "<i4", 3), ("c", "<u2", 3)]))
    rec["p"][:, 0] = np.arange(5) * 100
    (tree / "octree.bin").write_bytes(rec.tobytes())
    assert [r.x for r in spark.read.format("potree").load(str(tree)).orderBy("point_id").collect()] == [1, 2, 3, 4, 5]


def test_documents(spark, tmp_path):
    ses = tmp_path / "s1"
    ses.mkdir()
    inst = [{"id": "a", "kind": "pointset", "segId": 3, "confirmed": True}, {"id": "b", "kind": "cuboid", "cls": "pipe"}]
    (ses / "instances.json").write_text(json.dumps({"instances": inst}))
    rows = doc.read_instances(spark, str(tmp_path / "*" / "instances.json"))
    assert rows.count() == 2 and rows.first().session_id == "s1"
    kept = doc.instances_for_invariants(rows).collect()
    assert len(kept) == 1 and kept[0].confirmed is False
    (ses / "paths.json").write_text(json.dumps({"paths": [{"instance_id": 1, "points": [[0, 0, 0], [1, 0, 0]], "radius": 0.2}]}))
    assert doc.read_centerlines(spark, str(ses / "paths.json")).first().smooth is False
    (ses / "bad.json").write_text(json.dumps({"paths": [{"instance_id": 1, "points": [[0, 0, 0]]}]}))
    with pytest.raises(Exception, match="lacks radius"):
        doc.read_centerlines(spark, str(ses / "bad.json")).collect()
    with pytest.raises(ValueError):
        doc.class_table(spark.createDataFrame([(0, 1, "a", None, None, "g", False), (1, 1, "b", None, None, "g", False)], "pos int, id int, name string, color string, rgb array<double>, `group` string, frozen boolean"))


def test_catalog_frames_and_runs(spark, tmp_path):
    for name, n in (("Beta", 5), ("alpha", 6)):
        (tmp_path / "ann" / name).mkdir(parents=True)
        (tmp_path / "ann" / name / "meta.json").write_text(json.dumps({"scan_name": name, "n_points": n, "schema_version": "2.0"}))
    (tmp_path / "leg").mkdir()
    for f in ("m.glb", "m.ply"):
        (tmp_path / "leg" / f).write_bytes(b"x")
    cat = doc.scan_catalog(spark, str(tmp_path / "ann" / "*" / "meta.json"), str(tmp_path / "leg"))
    assert [(r.tier, r.name, r.format) for r in cat.collect()] == [("legacy", "m", "glb"), ("annotated", "alpha", "ply"), ("annotated", "Beta", "ply")]
    assert doc.resolve_scan(cat, "annotated/Beta").first().n_points == 5
    run = tmp_path / "runs" / "r1"
    run.mkdir(parents=True)
    frames = [{"file": f"{i}.png", "position": [0, 0, 0], "yaw": 0.0} for i in range(4)]
    (run / "manifest.json").write_text(json.dumps({"frames": frames}))
    for i in range(4):
        (run / f"{i}.png").write_bytes(b"0" * (60_000 if i != 2 else 10))
    got = doc.read_frames(spark, str(run / "manifest.json"), str(tmp_path / "runs"), stride=2)
    assert [r.file for r in got.collect()] == ["0.png"] and list(got.first().target) == [1.0, 0.0, 0.0]
    assert doc.discover_render_runs(spark, str(run / "manifest.json")).first().n_frames == 4


def test_save_keeps_newest_versions_and_checks(spark, tmp_path):
    lab = spark.createDataFrame([("s", 1, 0, 5)], "scan_id string, point_id bigint, class_id int, instance_id int")
    root = str(tmp_path / "store")
    for i in range(4):
        sinks.save_labels(lab, root, version=f"20240101_00000{i}", keep=1)
    assert sinks.current_version(spark, root) == "20240101_000003"
    assert sorted(p.name for p in (tmp_path / "store" / "versions").iterdir()) == ["20240101_000002", "20240101_000003"]
    from cloudloom.operators.quality import class_iff_instance

    bad = lab.selectExpr("scan_id", "point_id", "-1 AS class_id", "instance_id")
    with pytest.raises(ValueError, match="VAL1"):
        sinks.save_labels(bad, root, checks=[class_iff_instance(bad)])


def test_class_registry(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("classes:\n  big pipe: { color: [0.5, 0, 1], frozen: true }\n  tee: { id: 7, label: Tee, hotkey: x, group: g }\n  odd:\n")
    (tmp_path / "b.yaml").write_text("")
    rows = {r.name: (r.id, r.label, r.color, r.hotkey, r.group, r.frozen) for r in doc.read_class_registry(spark, str(tmp_path)).collect()}
    assert rows == {"big pipe": (0, "Big Pipe", "#8000ff", "1", "", True), "tee": (7, "Tee", "#5b8def", "x", "g", False), "odd": (2, "Odd", "#5b8def", "3", "", False)}
    (tmp_path / "c.yaml").write_text("classes:\n  a: { id: 1 }\n  b: {}\n")
    with pytest.raises(Exception, match="duplicate class id"):
        doc.read_class_registry(spark, str(tmp_path)).collect()
