"""Points met by cameras through the cell tree, and masks that take free points in turn, against brute force."""

import numpy as np
import pytest

from cloudloom.operators import celltree
from cloudloom.operators import fusion as fu

FRAME = "frame_id int, position array<double>, target array<double>, fov double, width int, height int"


def _on_screen(xyz, frame, far):
    """Positions of the points that a frame sees, without any tree."""
    _, pos, target, fov, width, height = frame
    fwd = np.subtract(target, pos) / (np.linalg.norm(np.subtract(target, pos)) + 1e-12)
    side = np.cross(fwd, [0.0, 1.0, 0.0])
    side /= np.linalg.norm(side) + 1e-12
    rel, focal = xyz - np.array(pos), height / 2 / np.tan(np.radians(fov) / 2)
    depth = rel @ fwd
    safe = np.maximum(depth, 1e-6)
    u, v = rel @ side * focal / safe + width / 2, -(rel @ np.cross(side, fwd)) * focal / safe + height / 2
    ok = (depth > fu.NEAR) & (u >= 0) & (u < width) & (v >= 0) & (v < height)
    return np.flatnonzero(ok & (depth < far) if far else ok)


@pytest.mark.parametrize("far", [None, 9.0])
def test_tree_keeps_every_point_in_view(spark, cloud, monkeypatch, far):
    monkeypatch.setattr(celltree, "LEAF", 8)
    rng = np.random.default_rng(3)
    xyz = np.vstack([rng.normal(size=(700, 3)) * 4, rng.normal(size=(300, 3)) * 0.01 + 500, np.zeros((200, 3))])
    frames = [(i, [float(v) for v in rng.uniform(-8, 8, 3)], [float(v) for v in rng.uniform(-2, 2, 3)], float(rng.uniform(5, 110)), 40 + i, 30) for i in range(12)]
    frames.append((99, [499.0, 500.0, 499.0], [500.0, 500.0, 500.0], 30.0, 40, 30))
    want = {(f[0], int(p)) for f in frames for p in _on_screen(xyz, f, far)}
    got = fu.on_screen(fu.project(cloud(xyz), spark.createDataFrame(frames, FRAME), far), far)
    pairs = [(r.frame_id, r.point_id) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want and (99, 800) in want


def test_leaves_outside_a_view_are_never_met(spark, cloud, monkeypatch):
    monkeypatch.setattr(celltree, "LEAF", 8)
    grid = np.array([(x * 0.1, 0.0, z * 0.1) for x in range(60) for z in range(60)])
    frame = spark.createDataFrame([(0, [1.0, 3.0, 1.5], [1.0, 0.0, 1.0], 6.0, 40, 40)], FRAME)
    met, seen = fu.project(cloud(grid), frame), _on_screen(grid, (0, [1.0, 3.0, 1.5], [1.0, 0.0, 1.0], 6.0, 40, 40), None)
    assert 0 < len(seen) <= met.count() < 150


def test_clouds_without_a_place(spark, cloud):
    frames = spark.createDataFrame([(0, [0.0, 0.0, -1.0], [0.0, 0.0, 0.0], 60.0, 40, 40)], FRAME)
    assert fu.project(cloud(np.zeros((1, 3))).limit(0), frames).count() == 0
    odd = np.array([[np.nan, 0, 0], [np.inf, 0, 0], [0, 0, 0], [0, 0, 0]], dtype=float)
    assert sorted(r.point_id for r in fu.project(cloud(odd), frames).collect()) == [2, 3]
    assert fu.project(cloud(odd), frames.limit(0)).count() == 0


def _in_turn(rows, least):
    free, out = {r[0] for r in rows}, {}
    for f, m in sorted({(r[1], r[2]) for r in rows}, key=lambda k: [(r[3], -r[4], -r[2]) for r in rows if r[1:3] == k][0]):
        mine = {r[0] for r in rows if r[1:3] == (f, m)} & free
        if len(mine) >= least:
            free -= mine
            out.update({p: (f, m) for p in mine})
    return out


@pytest.mark.parametrize("seed, least", [(0, 1), (1, 4), (2, 7)])
def test_masks_take_free_points_in_turn(spark, seed, least):
    rng = np.random.default_rng(seed)
    score = rng.integers(0, 4, (6, 4)) / 4
    rows = sorted({(int(p), f, f * 4 + m, 10 - f, float(score[f, m])) for f in range(6) for m in range(4) for p in rng.integers(0, 60, 9)})
    hit = spark.createDataFrame([("s", *r) for r in rows], "scan_id string, point_id long, frame_id int, mask_id int, rank int, score double")
    got = [(r.point_id, (r.frame_id, r.mask_id)) for r in fu.first_come(hit, least).collect()]
    assert len(got) == len(dict(got)) and dict(got) == _in_turn(rows, least) != {}


def test_a_chain_of_masks_that_depend_on_each_other(spark):
    """Mask k shares its only spare point with mask k + 1, so every other one stands."""
    rows = [(p, k, k, k, 0.5) for k in range(9) for p in (k, k + 1)]
    hit = spark.createDataFrame([("s", *r) for r in rows], "scan_id string, point_id long, frame_id int, mask_id int, rank int, score double")
    assert {(r.point_id, r.mask_id) for r in fu.first_come(hit, 2).collect()} == {(p, k) for k in range(0, 9, 2) for p in (k, k + 1)}
    assert fu.first_come(hit.limit(0), 2).count() == 0
