"""Several scans that share ids, views without a range, late commands, saves in any order, and hull geometry."""

import numpy as np
import pandas as pd

from cloudloom.operators import aggregates as ag
from cloudloom.operators import export as ex
from cloudloom.operators import fusion as fu
from cloudloom.operators import hulls
from cloudloom.operators import labels as lb
from cloudloom.operators import quality as qa
from cloudloom.sources import sinks
from cloudloom.streaming.jobs import SessionHistory

LABELS = "scan_id string, point_id long, class_id int, instance_id int, category int"


def _labels(spark):
    return spark.createDataFrame([(s, i, 1 + (s == "b"), 5 + i % 2, 0) for s in "ab" for i in range(6)], LABELS)


def test_documents_of_one_scan_leave_others_alone(spark):
    labels = _labels(spark)
    doc = spark.createDataFrame([("a", 5, 1, False), ("a", 6, 1, True), ("b", 6, 2, True)], "scan_id string, segId int, class_id int, confirmed boolean")
    assert [tuple(r) for r in ag.orphan_instances(labels, doc).collect()] == [("b", 5)]
    conf = doc.selectExpr("scan_id", "segId AS instance_id", "confirmed")
    out = ex.apply_filters_remap(labels, conf, None, None)
    assert {(r.scan_id, r.instance_id, r.class_id) for r in out.collect()} == {("a", 5, -1), ("a", 6, 1), ("b", 5, 2), ("b", 6, 2)}
    assert ex.absent_instances(labels, conf).first()[0] == 1
    assert {tuple(r) for r in ex.instance_class_map(doc, labels).collect()} == {("a", 5, 1), ("a", 6, 1), ("b", 5, 2), ("b", 6, 2)}
    summary = spark.createDataFrame([("a", 5, 7)], "scan_id string, id int, class_id int")
    got = ag.segment_class_join(labels.drop("class_id"), summary)
    assert {(r.scan_id, r.instance_id, r.class_id) for r in got.collect()} == {("a", 5, 7), ("a", 6, -1), ("b", 5, -1), ("b", 6, -1)}
    blobs = spark.createDataFrame([], "scan_id string, instance_id int, n_points long")
    assert {(r.scan_id, r.key) for r in qa.instance_docs(labels, doc, blobs).collect()} == {("b", "5")}


def test_merge_takes_the_class_of_its_own_scan(spark):
    edit = lb.merge_instances(_labels(spark), 6, 5)
    assert {(r.scan_id, r.instance_id, r.class_id) for r in edit.labels.collect()} == {("a", 5, 1), ("b", 5, 2)}


def test_centerline_keeps_the_erased_delta(spark):
    labels, points = _labels(spark), spark.createDataFrame([(s, i, 1.0 * i, 0.0, 0.0) for s in "ab" for i in range(6)], "scan_id string, point_id long, x double, y double, z double")
    paths = spark.createDataFrame([(5, 1)], "instance_id int, path_id int")
    tube = [{"points": [[0.0, 0.0, 0.0], [1.0, 0.0, 0.0]], "radius": 0.1, "smooth": False}]
    edit, _ = lb.apply_centerline(points, labels, paths, tube, paths.select("path_id"), 1, 6, [5])
    assert [d.count() for d in edit.deltas] == [6, 4]


def test_projection_has_no_range_unless_asked(spark):
    points = spark.createDataFrame([("s", i, float(d), 0.0, 0.0) for i, d in enumerate((1, 79, 86, 121, 160, 301))], "scan_id string, point_id long, x double, y double, z double")
    frames = spark.createDataFrame([(0, [0.0, 0.0, 0.0], [1.0, 0.0, 0.0], 60.0, 100, 100)], "frame_id int, position array<double>, target array<double>, fov double, width int, height int")
    assert fu.project(points, frames).count() == 6
    assert sorted(r.point_id for r in fu.visible(points.filter("point_id = 1"), frames).collect()) == [1]
    rnd = np.random.default_rng(1).uniform(-150, 150, (3000, 3))
    cloud = spark.createDataFrame([("s", i, *map(float, p)) for i, p in enumerate(rnd)], points.schema)
    wide = frames.selectExpr("frame_id", "array(3D, 4D, 5D) AS position", "array(10D, 1D, -8D) AS target", "100D AS fov", "160 AS width", "90 AS height")
    ids = lambda df: sorted(r.point_id for r in df.select("point_id").collect())
    assert ids(fu.on_screen(fu.project(cloud, wide, 80.0), 80.0)) == ids(fu.on_screen(fu.project(cloud, wide), 80.0)) != []


class _Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class _Map(dict):
    def containsKey(self, key):
        return key in self

    def updateValue(self, key, value):
        self[key] = value


def test_late_commands_count_once():
    job = SessionHistory()
    job.state, job.seen = _Value(), _Map()
    batch = lambda *seqs: iter([pd.DataFrame({"edit_seq": seqs, "op": ["edit"] * len(seqs), "allocate": True, "high_water": 3})])
    first = pd.concat(job.handleInputRows(("s", "x"), batch(5, 4), None))
    late = pd.concat(job.handleInputRows(("s", "x"), batch(2, 5), None))
    assert first["edit_seq"].tolist() == [4, 5] and late["edit_seq"].tolist() == [2]
    assert late["new_instance_id"].tolist() == [6]


def test_latest_save_is_current_whatever_its_name(spark, tmp_path):
    root, labels = str(tmp_path), _labels(spark)
    sinks.save_labels(labels, root, version="20260101_000000")
    for _ in range(2):  # a repeated epoch
        sinks.save_labels(labels.filter("scan_id = 'a'"), root, version="auto_3", again=True)
    assert sinks.current_version(spark, root) == "auto_3" and sinks.load_labels(spark, root).count() == 6
    sinks.save_labels(labels, root, version="20260102_000000")
    assert sinks.load_labels(spark, root).count() == 12


def test_flat_hulls_are_small_and_boxes_closed(spark):
    rnd = np.random.default_rng(2)
    flat = rnd.uniform(0, 1, (3000, 2)) @ np.array([[1.0, 0.5, 0.0], [0.0, 0.3, 1.0]])
    kept = hulls._vertices(flat)
    assert len(kept) < 100 and {tuple(p) for p in kept} <= {tuple(p) for p in flat}
    pts = rnd.normal(size=(4000, 2))
    slow = hulls.hull_2d(pts[np.lexsort(pts.T)][:: 1])
    assert all(((b - a)[0] * (pts[:, 1] - a[1]) - (b - a)[1] * (pts[:, 0] - a[0]) >= -1e-9).all() for a, b in zip(slow, np.roll(slow, -1, axis=0)))
    verts, faces = hulls.box_mesh(np.array([0.0, 0.0, 0.0]), np.array([1.0, 2.0, 3.0]))
    a, b, c = (verts[faces[:, i]] for i in range(3))
    assert abs(np.einsum("ij,ij->i", a, np.cross(b, c)).sum() / 6 - 6.0) < 1e-12


def test_merge_tree_of_hulls(spark):
    rnd = np.random.default_rng(3)
    rows = [("s", int(i % 2), float(a), float(b)) for i, (a, b) in enumerate(rnd.normal(size=(3000, 2)))]
    df = spark.createDataFrame(rows, "scan_id string, instance_id int, x double, z double").repartition(50)
    got = hulls._hull_candidates(df, hulls.hull_2d, ["x", "z"], max_rows=20).toPandas()
    for i in (0, 1):
        want = {tuple(p) for p in hulls.hull_2d(np.array([r[2:] for r in rows if r[1] == i]))}
        assert want <= {tuple(p) for p in got[got.instance_id == i][["x", "z"]].to_numpy()}


def test_fitted_box_is_the_smallest_over_all_edges(spark):
    rnd = np.random.default_rng(4)
    turn = np.array([[np.cos(0.4), np.sin(0.4)], [-np.sin(0.4), np.cos(0.4)]])
    xz = rnd.uniform(-1, 1, (500, 2)) * (3, 1) @ turn + (10, -2)
    df = spark.createDataFrame([("s", 1, float(x), float(i % 3), float(z)) for i, (x, z) in enumerate(xz)], "scan_id string, instance_id int, x double, y double, z double")
    r = hulls.fit_gravity_obb(df).first()
    c, s = np.cos(r.ry), np.sin(r.ry)
    d = xz - (r.cx, r.cz)
    u, v = d[:, 0] * c - d[:, 1] * s, d[:, 0] * s + d[:, 1] * c
    assert (np.abs(u) <= r.sx / 2 + 1e-9).all() and (np.abs(v) <= r.sz / 2 + 1e-9).all()
    assert r.sx * r.sz < 6.2 * 2.2
