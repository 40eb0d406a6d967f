"""Points tested in the tile that makes their z-buffer, against brute force and against views that go by pixels."""

import numpy as np
import pytest

from cloudloom.operators import fusion as fu

FRAME = "frame_id int, position array<double>, target array<double>, fov double, width int, height int"


@pytest.fixture(scope="module")
def scene(spark, cloud):
    rng = np.random.default_rng(5)
    frames = [(i, [0.1 * i, 0.0, -4.0 - i], [0.0, 0.0, 0.0], 50.0, 300 - 40 * i, 150 + 20 * i) for i in range(3)]
    frames.append((2, [0.0, 1.0, -4.0], [0.0, 0.0, 0.0], 50.0, 200, 140))  # an id given twice
    points = cloud(np.vstack([rng.normal(size=(900, 3)), [[0.0, 0.0, 1.0]] * 3])).selectExpr("*", "CAST(point_id % 5 AS INT) AS r", "1 AS g", "2 AS b")
    return points, spark.createDataFrame(frames, FRAME)


def _by_hand(points, frames, far):
    seen = [tuple(r) for r in fu.on_screen(fu.project(points, frames, far), far).select("frame_id", "u", "v", "width", "height", "depth", "point_id").collect()]
    low = {}
    for f, u, v, w, h, d, _ in seen:
        for a in range(max(u - 2, 0), min(u + 3, w)):
            for b in range(max(v - 2, 0), min(v + 3, h)):
                low[f, a, b] = min(low.get((f, a, b), np.inf), d)
    return seen, low


@pytest.mark.parametrize("crowd", [1_000_000, 900, 0])
def test_visible_points_by_tiles_and_by_pixels(scene, monkeypatch, crowd):
    monkeypatch.setattr(fu, "CROWD", crowd)
    monkeypatch.setattr(fu, "TILE", 64)
    seen, low = _by_hand(*scene, 80.0)
    want = sorted((f, u, v, p) for f, u, v, _, _, d, p in seen if d <= low[f, u, v] + max(fu.TOL_ABS, fu.TOL_REL * low[f, u, v]))
    got = fu.visible(*scene)
    assert sorted(tuple(r) for r in got.select("frame_id", "u", "v", "point_id").collect()) == want
    assert 0 < len(want) < len(seen) and got.columns[:3] == fu.PIX and "depth" in got.columns
    narrow = fu.visible(*scene, keep=["point_id"])
    assert narrow.columns == [*fu.PIX, "point_id"] and sorted(tuple(r) for r in narrow.collect()) == want


@pytest.mark.parametrize("crowd", [1_000_000, 0])
def test_images_by_tiles_and_by_pixels(scene, monkeypatch, crowd):
    monkeypatch.setattr(fu, "CROWD", crowd)
    monkeypatch.setattr(fu, "TILE", 64)
    _, low = _by_hand(*scene, None)
    got = fu.raster_render(*scene).collect()
    assert len(got) == len(low) and {(r.frame_id, r.u, r.v): r.depth for r in got} == low


def test_a_point_moves_once(scene):
    """One exchange of points for the z-buffer and the test, and only the columns asked for."""
    plan = fu.visible(*scene, keep=["point_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(frame_id") == 1 and "SortMergeJoin" not in plan
