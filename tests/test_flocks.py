"""Views worked on in flocks against the same views by rows and pixels, and how many rows the points become."""

import numpy as np
import pytest

from cloudloom.operators import celltree, flocks
from cloudloom.operators import fusion as fu

FRAME = "frame_id int, position array<double>, target array<double>, fov double, width int, height int, rank int, run_id string, ord int"


def _frames(n):
    return [(i, [0.3 * (i % 3), 0.05 * i, -4.0], [0.2 * (i % 3), 0.0, 0.0], 40.0, 48 + i % 2, 36, i // 2, str(i % 2), i) for i in range(n)]


@pytest.fixture(scope="module")
def scene(spark, cloud):
    rng = np.random.default_rng(8)
    points = cloud(rng.normal(size=(400, 3))).selectExpr("*", "CAST(point_id % 7 AS INT) AS r", "3 AS g", "CAST(point_id % 2 AS INT) AS b")
    # A key with several rows, one with no number.
    points = points.selectExpr("scan_id", "CASE WHEN point_id < 8 THEN 5 WHEN point_id > 396 THEN NULL ELSE point_id END AS point_id", "x", "y", "z", "r", "g", "b").localCheckpoint()
    frames = spark.createDataFrame(_frames(6), FRAME)
    px = [(f, u, v, 10 * f + m, [1, 2, None, 4][(f + m) % 4], [0.25, 0.5, None, 1.0][(f + 2 * m) % 4]) for f in range(5) for u in range(-1, 50) for v in range(37) for m in range(3) if (u // 7 + v // 5 + m) % 2]
    masks = spark.createDataFrame(px + px[:9], "frame_id int, u int, v int, mask_id int, class_id int, score double").localCheckpoint()
    cells = spark.createDataFrame([(f, r, c, 3, 4, [1.0 + r, 2.0 * c] + [0.5] * (f == 1)) for f in range(5) for r in range(3) for c in range(4)], "frame_id int, row int, column int, map_h int, map_w int, feature array<double>")
    return points, frames, masks, cells


def _results(scene):
    points, frames, masks, cells = scene
    small_masks = masks.filter("u >= 0 AND u < 48")
    return {
        "registration": fu.registration_score(points, frames),
        "features": fu.fuse_features(points, frames, cells).selectExpr("point_id", "seen", "transform(feature, x -> round(x, 9)) AS f"),
        "votes": fu.class_votes(points, frames, masks, {4: 1}),
        "union": fu.query_hits(points, frames, masks, "union", 0.3)[0],
        "argmax": fu.query_hits(points, frames, masks, "argmax", 0.3)[0],
        "summary": fu.query_hits(points, frames, masks, "argmax", 0.3)[1],
        "latest": fu.masks_to_segments(points, frames, small_masks, 5)[1],
        "first": fu.masks_to_segments(points, frames, small_masks.filter("score IS NOT NULL"), 5, "first")[1],
        "instances": fu.auto_instances(points, frames, small_masks),
        "narrow": fu.auto_instances(points, frames, small_masks, gap=-0.1),
    }


def _rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_flocks_give_what_rows_and_pixels_give(scene, monkeypatch):
    monkeypatch.setattr(flocks, "HELD", 700)  # several turns over the points of a flock
    mine = {name: _rows(df) for name, df in _results(scene).items()}
    monkeypatch.setattr(fu, "CROWD", 0)
    theirs = {name: _rows(df) for name, df in _results(scene).items()}
    for name in mine:
        assert mine[name] and mine[name] == theirs[name], name


def test_points_do_not_multiply_by_views(spark, cloud, monkeypatch):
    """Forty views of one place make one row of each point, not forty."""
    monkeypatch.setattr(celltree, "LEAF", 8)
    points, frames = cloud(np.random.default_rng(1).normal(size=(300, 3)) * 0.3), spark.createDataFrame([(i, [0.0, 0.0, -4.0], *_frames(1)[0][2:]) for i in range(40)], FRAME)
    rows = fu._Met(points, frames, None)
    assert rows.few is None and rows.full is None and rows.points.count() <= 300
    assert rows.named.select("flock").distinct().count() == 1 and rows.named.count() == 40
    assert fu.visible(points, frames, keep=[]).count() > 300


def test_crowded_flocks_are_parted(spark, cloud, monkeypatch):
    monkeypatch.setattr(celltree, "FLOCK", 4)
    points, frames = cloud(np.random.default_rng(1).normal(size=(200, 3)) * 0.3), spark.createDataFrame([(i, [0.0, 0.0, -4.0], *_frames(1)[0][2:]) for i in range(16)], FRAME)
    assert 1 < fu._Met(points, frames, None).named.select("flock").distinct().count() <= 4


def test_every_frame_of_a_run_is_looked_at(spark, cloud):
    """Of 18 frames only one that is not the first of its pair sees the cloud."""
    frames = spark.createDataFrame([(i, [0.0, 0.0, -4.0], [0.0, 0.0, 0.0 if i == 3 else -9.0], 40.0, 32, 32, i, "a", i) for i in range(18)], FRAME)
    clouds = spark.createDataFrame([("s", "c", "v", "fp")], "scan_id string, canonical_id string, variant_id string, fingerprint string")
    runs = spark.createDataFrame([("s", "a", "c", "v", "fp")], "scan_id string, run_id string, run_canonical_id string, source_variant string, source_fingerprint string")
    got = fu.verify_registration(cloud(np.zeros((4, 3))), clouds, runs, frames)[0].collect()
    assert [(r.run_id, r.coverage, r.ok) for r in got] == [("a", 1.0, True)]
