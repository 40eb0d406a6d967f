import numpy as np

from cloudloom.operators.cluster import dbscan, sor_outliers
from cloudloom.operators.hulls import convex_hulls, fit_gravity_obb, hull_3d
from cloudloom.operators.sampling import random_sample
from cloudloom.operators.spatial import knn, nearest_neighbor
from pyspark.sql import functions as F


def _brute(q, p, k, same):
    d2 = ((q[:, None] - p[None]) ** 2).sum(-1)
    out = []
    for i in range(len(q)):
        order = np.lexsort((np.arange(len(p)), d2[i]))
        out.append([j for j in order if not (same and j == i)][:k])
    return out


def test_knn_with_dense_spot_and_copies(cloud):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(300, 3))
    a[:100] = rng.normal(size=(100, 3)) * 1e-2 + 5  # a third of all rows in one spot
    a[100:150] = 1.0                                  # coincident copies
    p = cloud(a)
    got = knn(p, p, 4).toPandas().sort_values(["point_id", "rank"]).groupby("point_id").nn_id.apply(list)
    assert list(got) == _brute(a, a, 4, True)


def test_nearest_from_far_away_queries(cloud):
    rng = np.random.default_rng(2)
    p, q = rng.normal(size=(200, 3)), rng.normal(size=(80, 3))
    q[:40] += 50
    got = nearest_neighbor(cloud(q, 1000), cloud(p)).toPandas().sort_values("point_id").nn_id
    assert list(got) == [r[0] for r in _brute(q, p, 1, False)]


def test_dbscan_against_brute_force(cloud):
    rng = np.random.default_rng(3)
    a = np.concatenate([rng.normal(size=(80, 3)) * 0.3, rng.normal(size=(60, 3)) * 0.2 + [2, 0, 0], np.repeat([[5.0, 5, 5]], 20, 0), rng.uniform(-3, 6, (30, 3))])
    got = dbscan(cloud(a), 0.3, 6).toPandas().sort_values("point_id").cluster_id.to_numpy()
    near = ((a[:, None] - a[None]) ** 2).sum(-1) <= 0.09
    core, want = near.sum(1) >= 6, np.full(len(a), -1)
    for i in np.flatnonzero(core):
        stack = [i] if want[i] < 0 else []
        while stack:
            j = stack.pop()
            if want[j] < 0:
                want[j] = i
                stack += [k for k in np.flatnonzero(near[j] & core) if want[k] < 0]
    for i in np.flatnonzero(~core):
        c = want[near[i] & core]
        want[i] = c.min() if len(c) else -1
    assert (got == want).all()


def test_too_few_points_have_no_outliers(cloud):
    assert sor_outliers(cloud(np.random.default_rng(0).normal(size=(5, 3))), 16).count() == 0


def test_hull_of_a_cube_and_flat_fallback(cloud):
    corners = np.array([[x, y, z] for x in (0, 1) for y in (0, 1) for z in (0, 1)], dtype=float)
    pts = np.concatenate([corners, np.random.default_rng(0).uniform(0, 1, (50, 3))])
    verts, _f = hull_3d(pts)
    assert len(verts) == 8
    row = convex_hulls(cloud(pts).withColumn("instance_id", F.lit(1))).first()
    assert abs(row.volume - 1) < 1e-9 and not row.is_box
    flat = pts.copy()
    flat[:, 1] = 0.5
    assert convex_hulls(cloud(flat).withColumn("instance_id", F.lit(1))).first().is_box


def test_gravity_box_finds_the_yaw(cloud):
    rng = np.random.default_rng(4)
    local = np.concatenate([rng.uniform(-1, 1, (200, 3)) * [2, 0.5, 0.5], [[x, 0, z] for x in (-2, 2) for z in (-0.5, 0.5)]])
    c, s = np.cos(0.4), np.sin(0.4)
    world = np.stack([local[:, 0] * c + local[:, 2] * s, local[:, 1], -local[:, 0] * s + local[:, 2] * c], 1)
    r = fit_gravity_obb(cloud(world).withColumn("instance_id", F.lit(1))).first()
    assert sorted([round(r.sx, 3), round(r.sz, 3)]) == [1.005, 4.005]


def test_random_sample_is_exact_and_repeatable(cloud):
    p = cloud(np.random.default_rng(5).normal(size=(500, 3)))
    a = {r.point_id for r in random_sample(p, 77, 3).collect()}
    b = {r.point_id for r in random_sample(p.repartition(5), 77, 3).collect()}
    assert len(a) == 77 and a == b
    assert random_sample(p, 900, 3).count() == 500
