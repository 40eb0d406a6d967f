"""Work that must not outgrow its input: hulls of many small instances, depth images, tables that are folders."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cloudloom.operators import cluster, hulls, spatial
from cloudloom.operators import fusion as fu


def test_a_batch_of_small_instances_stays_one_table():
    rows = [("s", i, float(x), float(x * x)) for i in range(300) for x in range(3)] + [("s", 999, np.cos(t), np.sin(t) * (1 + t % 2)) for t in range(200)]
    pdf = pd.DataFrame(rows, columns=["scan_id", "instance_id", "x", "z"])
    (out,) = hulls._reducer(hulls.hull_2d, ["x", "z"])([pdf])
    assert (out.instance_id < 999).sum() == 900
    kept = out[out.instance_id == 999][["x", "z"]].to_numpy()
    assert len(kept) < 200 and np.array_equal(np.unique(kept, axis=0), np.unique(hulls.hull_2d(pdf[pdf.instance_id == 999][["x", "z"]].to_numpy()), axis=0))


@pytest.mark.parametrize("seed", range(3))
def test_every_point_is_inside_its_hull(seed):
    pts = np.random.default_rng(seed).normal(size=(400, 3)).round(1)
    verts, faces = hulls.hull_3d(pts)
    a, b, c = (verts[faces[:, i]] for i in range(3))
    normal = np.cross(b - a, c - a)
    assert (np.einsum("fi,pi->fp", normal, pts) - np.einsum("fi,fi->f", normal, a)[:, None]).max() < 1e-9
    # Closed: every edge once in each direction.
    edges = [tuple(e) for f in faces.tolist() for e in ((f[0], f[1]), (f[1], f[2]), (f[2], f[0]))]
    assert len(edges) == len(set(edges)) and {e[::-1] for e in edges} == set(edges)


@pytest.mark.parametrize("splat", [0, 2])
def test_least_row_around_each_pixel(spark, splat):
    rng = np.random.default_rng(splat)
    sizes = {1: (150, 70), 2: (64, 65), 3: (1, 3)}
    rows = []
    for f, (w, h) in sizes.items():
        at = {(int(u), int(v)) for u, v in zip(rng.integers(0, w, 60), rng.integers(0, h, 60))} | {(0, 0), (w - 1, h - 1)}
        rows += [(f, u, v, w, h, float(rng.integers(0, 3)), None if rng.random() < 0.2 else 2**60 + int(rng.integers(0, 9))) for u, v in sorted(at)]
    rows.append((3, 0, 1, 2, 3, -1.0, 7))  # a frame listed twice, with another size
    want = {}
    for f, u, v, w, h, d, p in rows:
        for a in range(max(0, u - splat), min(w, u + splat + 1)):
            for b in range(max(0, v - splat), min(h, v + splat + 1)):
                key = (d, -1 if p is None else p)
                want[f, a, b] = min(want.get((f, a, b), key), key)
    pixels = spark.createDataFrame(rows, "frame_id int, u int, v int, width int, height int, d double, p long").repartition(3)
    got = fu._least_around(pixels, splat, ["d", "p"]).collect()
    assert {(r.frame_id, r.u, r.v): (r.d, -1 if r.p is None else r.p) for r in got} == want and len(got) == len(want)


def test_pixels_made_from_few_frames_are_not_broadcast(spark):
    """Spark takes exploded rows for as few as the frames they come from."""
    masks = spark.range(4).select(F.col("id").cast("int").alias("frame_id"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("u"), F.lit(0).alias("v"), F.lit(1).alias("class_id"), F.lit(0.5).alias("score"))
    vis = spark.createDataFrame([("s", 1, 0, 3, 0)], "scan_id string, point_id long, frame_id int, u int, v int")
    out = fu._best_scores(vis, masks)
    assert "Broadcast" not in out._jdf.queryExecution().sparkPlan().toString() and out.count() == 1


def test_replay_of_a_table_that_is_a_folder(spark, tmp_path):
    rows = [(i, [float(i % 5) / 10, float(i // 5) / 10, 0.0, 0.0], i % 4) for i in range(24)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = entry.queries()["str1_replay_stream"](spark, str(tmp_path))
    assert sorted(r.point_id for r in got.collect()) == list(range(24))


def test_box_pairs_are_met_once_and_not_in_one_task(spark):
    rng = np.random.default_rng(5)
    col = "scan_id string, shape_id long, class_id int, cx double, cy double, cz double, sx double, sy double, sz double"
    make = lambda n, first: [("s", first + i, int(rng.integers(0, 2)), *map(float, rng.uniform(-1, 1, 3).round(1)), *map(float, rng.choice([0.2, 0.5, 0.9], 3))) for i in range(n)]
    a, b = make(40, 0), make(50, 100)
    want = {}
    for g in a:
        for p in b:
            side = [max(0.0, min(g[3 + k] + g[6 + k] / 2, p[3 + k] + p[6 + k] / 2) - max(g[3 + k] - g[6 + k] / 2, p[3 + k] - p[6 + k] / 2)) for k in range(3)]
            inter = np.prod(side)
            if inter > 0:
                want[g[1], p[1]] = (inter / (np.prod(g[6:]) + np.prod(p[6:]) - inter), g[2] == p[2])
    pairs = cluster._box_pairs(spark.createDataFrame(a, col), spark.createDataFrame(b, col))
    got = pairs.collect()
    assert len(got) == len(want) and {(r.gt_id, r.pred_id): round(r.iou, 9) for r in got} == {k: round(v[0], 9) for k, v in want.items()}
    assert pairs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = cluster._box_pairs(spark.createDataFrame(a, col), spark.createDataFrame(b, col), True, 0.1).collect()
    assert {(r.gt_id, r.pred_id) for r in few} == {k for k, (v, same) in want.items() if same and v >= 0.1}


def _linked(rows, radius):
    """Components of rows (scan, point, instance, position) by plain search over touching cells; cells of one lowest point are one."""
    cells = {}
    for scan, point, inst, pos in rows:
        cells.setdefault((scan, inst, *[math.floor(v / radius) for v in pos]), []).append(point)
    low, seen, comp = {c: min(p) for c, p in cells.items()}, {}, {}
    same = {}
    for c, p in low.items():
        same.setdefault((c[0], p), []).append(c)
    for start in cells:
        if start in seen:
            continue
        todo, group = [start], []
        seen[start] = True
        while todo:
            c = todo.pop()
            group.append(c)
            near = [(*c[:2], c[2] + i, c[3] + j, c[4] + k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
            for o in near + same[c[0], low[c]]:
                if o in cells and o not in seen:
                    seen[o] = True
                    todo.append(o)
        for c in group:
            comp[c] = min(low[g] for g in group)
    first = {}
    for c, points in cells.items():
        key = (*c[:2], comp[c])
        first[key] = min(points + [first.get(key, points[0])])
    number = {k: sum(1 for o in first if o[:2] == k[:2] and first[o] < first[k]) for k in first}
    return {(scan, point): number[scan, inst, comp[scan, inst, *[math.floor(v / radius) for v in pos]]] for scan, point, inst, pos in rows}


def test_components_across_blocks_are_those_of_all_cells(spark):
    rnd = random.Random(7)
    rows = []
    for scan in ("a", "b"):
        for inst in range(3):
            # Walks that cross many blocks, below zero too, and loose points.
            at = [rnd.uniform(-30, 0) for _ in range(3)]
            for _ in range(250):
                at = [v + rnd.uniform(-0.9, 1.3) for v in at]
                rows.append((scan, len(rows), inst, tuple(at)))
            rows += [(scan, len(rows) + i, inst, tuple(rnd.uniform(-40, 60) for _ in range(3))) for i in range(150)]
    rnd.shuffle(rows)
    points = spark.createDataFrame([(s, p, *map(float, at)) for s, p, _, at in rows], "scan_id string, point_id bigint, x double, y double, z double")
    labels = spark.createDataFrame([(s, p, i) for s, p, i, _ in rows], "scan_id string, point_id bigint, instance_id int")
    got = {(r.scan_id, r.point_id): r.component_id for r in cluster.components(points, labels, 1.0).collect()}
    assert got == _linked(rows, 1.0) and max(got.values()) > 50


def test_blocks_of_cells_are_linked_by_their_task(spark):
    """Two filled cubes that touch: the graph of all tasks holds the few links of blocks, not 13 for each cell."""
    side = range(-20, 20)
    rows = [("s", (i * 100 + j) * 100 + k + 1_000_000, 1, (i + 0.5, j + 0.5, k + 0.5)) for i in side for j in side for k in side if max(abs(i), abs(j), abs(k)) < 12 or min(i, j, k) >= 11]
    cells = spark.createDataFrame([(s, i, *[math.floor(v) for v in at], p) for s, p, i, at in rows], "scan_id string, instance_id int, gx bigint, gy bigint, gz bigint, node bigint")
    linked, made = [], cluster.connected_components
    try:
        cluster.connected_components = lambda e, *rest: linked.append(e.distinct().count()) or made(e, *rest)
        out = cluster._linked_cells(cells).select("component").distinct().collect()
    finally:
        cluster.connected_components = made
    assert [r[0] for r in out] == [min(r[1] for r in rows)] and linked[0] < 100 < len(rows)


def test_neighbours_of_sparse_leaves_are_looked_for_nearby(spark, monkeypatch):
    """Most leaves hold fewer than k positions: a bound from their nearest leaves leaves few pairs, and the same neighbours."""
    rnd = np.random.default_rng(3)
    at = np.concatenate([rnd.uniform(-4, 4, (900, 3)), rnd.normal(2, 0.05, (200, 3)), np.repeat(rnd.uniform(-4, 4, (20, 3)), 3, axis=0)])
    cloud = spark.createDataFrame([("s", i, *map(float, p)) for i, p in enumerate(at)], "scan_id string, point_id bigint, x double, y double, z double").cache()
    asked, counted = [], spatial._tasks
    monkeypatch.setattr(spatial, "_tasks", lambda s, pairs: asked.append(pairs) or counted(s, pairs))
    d = ((at[:, None] - at[None]) ** 2).sum(2)
    np.fill_diagonal(d, -1)
    k, made = 30, []
    for least in (1 << 60, 0):
        monkeypatch.setattr(spatial, "_PAIRS_UNBOUND", least)
        got = spatial.knn(cloud, cloud, k).select("point_id", "rank", "nn_id").collect()
        made.append((sorted(map(tuple, got)), asked[-1]))
    assert made[0][0] == made[1][0] and made[1][1] < made[0][1]
    near = np.lexsort((np.broadcast_to(np.arange(len(at)), d.shape), d), axis=1)[:, 1:k + 1]
    assert made[0][0] == [(i, r + 1, int(n)) for i, row in enumerate(near) for r, n in enumerate(row)]


def test_radius_pairs_of_a_full_cell_are_dealt_to_several_tasks(spark, monkeypatch):
    """Columns travel with the points; a cell that makes too many pairs for a task is split, and no pair is lost or doubled."""
    rnd = np.random.default_rng(6)
    at = np.concatenate([rnd.normal(0.5, 0.1, (120, 3)), rnd.uniform(-3, 3, (200, 3))])
    cloud = spark.createDataFrame([("s", i, *map(float, p), i % 7) for i, p in enumerate(at)], "scan_id string, point_id bigint, x double, y double, z double, tag int")
    monkeypatch.setattr(spatial, "_PAIRS_A_TASK", 5_000)
    d = ((at[:, None] - at[None]) ** 2).sum(2)
    rows = spatial.radius_pairs(cloud, cloud, 0.7, b_cols=["tag"]).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.a_id, r.b_id, r.b_tag) for r in rows) == [(int(i), int(j), int(j) % 7) for i, j in zip(*np.nonzero(d <= 0.49))]
    assert len({r.task for r in rows if r.a_id < 120 and r.b_id < 120}) > 1
