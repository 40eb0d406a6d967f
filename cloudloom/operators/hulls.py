"""Convex hulls, gravity-aligned boxes and hull meshes per instance.

Hull work is pre-reduced where the points lie: each task keeps only its own
partial hull vertices, and partial hulls are merged in a tree of bounded groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import BOX_FLOOR, FIT_PAD
from ..session import cut, small

SEG = ["scan_id", "instance_id"]
#: Rows of an instance in a batch up to which a hull of them would not pay.
FEW = 64


def _rim(pts: np.ndarray, directions: int = 32) -> np.ndarray:
    """Without most inner points: those strictly inside the polygon of the extremes of some directions."""
    if len(pts) <= directions:
        return pts
    turn = np.arange(directions) * (2 * np.pi / directions)
    ring = pts[np.argmax(pts @ np.stack([np.cos(turn), np.sin(turn)]), axis=0)]
    inside = np.ones(len(pts), bool)
    for a, b in zip(ring, np.roll(ring, -1, axis=0)):
        if (a != b).any():
            inside &= (b[0] - a[0]) * (pts[:, 1] - a[1]) - (b[1] - a[1]) * (pts[:, 0] - a[0]) > 0
    return pts[~inside] if (ring != ring[0]).any() else pts


def hull_2d(pts: np.ndarray) -> np.ndarray:
    """Counter-clockwise hull vertices; collinear input leaves its two ends."""
    pts = np.unique(_rim(pts), axis=0)
    if len(pts) < 3:
        return pts

    def chain(seq):
        out = []
        for p in seq:
            while len(out) > 1:
                a, b = out[-2], out[-1]
                if (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) > 0:
                    break
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def hull_3d(pts: np.ndarray):
    """(vertices, outward triangles) by incremental insertion, or None when flat."""
    pts = np.unique(np.asarray(pts, dtype=float), axis=0)
    if len(pts) < 4:
        return None
    scale = max(float(np.ptp(pts, axis=0).max()), 1e-12)
    eps = 1e-10 * scale
    i0 = 0
    i1 = int(np.argmax(((pts - pts[i0]) ** 2).sum(1)))
    axis = pts[i1] - pts[i0]
    off = np.linalg.norm(np.cross(pts - pts[i0], axis), axis=1)
    i2 = int(np.argmax(off))
    if off[i2] <= eps * scale:
        return None
    normal = np.cross(axis, pts[i2] - pts[i0])
    normal /= np.linalg.norm(normal)
    height = (pts - pts[i0]) @ normal
    i3 = int(np.argmax(np.abs(height)))
    if abs(height[i3]) <= eps * 10:
        return None
    inner = pts[[i0, i1, i2, i3]].mean(0)

    def planes(tri):
        """Triangles that face outwards, with their unit normals and distances."""
        a, b, c = pts[tri[:, 0]], pts[tri[:, 1]], pts[tri[:, 2]]
        n = np.cross(b - a, c - a)
        n /= np.linalg.norm(n, axis=1, keepdims=True) + 1e-300
        d = (n * a).sum(1)
        turn = n @ inner > d
        sign = np.where(turn, -1.0, 1.0)
        return np.where(turn[:, None], tri[:, [0, 2, 1]], tri), n * sign[:, None], d * sign

    faces, normals, offs = planes(np.array([(i0, i1, i2), (i0, i1, i3), (i0, i2, i3), (i1, i2, i3)]))
    rest = np.arange(len(pts))
    dist = pts @ normals.T - offs
    while True:
        top = dist.max(1)
        rest_out = top > eps
        if not rest_out.any():
            break
        rest, dist, top = rest[rest_out], dist[rest_out], top[rest_out]
        far = int(np.argmax(top))
        seen = dist[far] > eps
        # The rim of what the farthest point sees: edges of one seen face only.  Distances to unseen faces stay as they are.
        edges = faces[seen][:, [0, 1, 1, 2, 2, 0]].reshape(-1, 2)
        _, first, times = np.unique(edges.min(1) * len(pts) + edges.max(1), return_index=True, return_counts=True)
        rim = edges[np.sort(first[times == 1])]
        new, n, d = planes(np.column_stack([rim, np.full(len(rim), rest[far])]))
        faces, normals, offs = np.concatenate([faces[~seen], new]), np.concatenate([normals[~seen], n]), np.concatenate([offs[~seen], d])
        dist = np.concatenate([dist[:, ~seen], pts[rest] @ n.T - d], axis=1)
    used, place = np.unique(faces, return_inverse=True)
    return pts[used], place.reshape(-1, 3)


def _reducer(hull, names):
    def run(batches):
        for pdf in batches:
            # A batch holds few rows of most instances: those go on as they are, and the batch stays one table.
            many = pdf.groupby(SEG, sort=False)[names[0]].transform("size") > FEW
            parts = [pdf[~many]]
            for key, grp in pdf[many].groupby(SEG, sort=False):
                out = pd.DataFrame(hull(grp[names].to_numpy(float)), columns=names)
                out.insert(0, "scan_id", key[0])
                out.insert(1, "instance_id", key[1])
                parts.append(out)
            yield pd.concat(parts)

    return run


def _vertices(pts: np.ndarray) -> np.ndarray:
    """Points whose hull is the hull of all; of a flat set, its hull in its own plane."""
    got = hull_3d(pts)
    if got is not None:
        return got[0]
    pts = np.unique(pts, axis=0)
    if len(pts) < 4:
        return pts
    # The two directions of most variance span the plane (or line) of a flat set.
    axes = np.linalg.svd(pts - pts.mean(0), full_matrices=False)[2][:2]
    flat = (pts - pts[0]) @ axes.T
    rim = {tuple(p) for p in hull_2d(flat).tolist()}
    return pts[[tuple(p) in rim for p in flat.tolist()]]


def _hull_candidates(rows: DataFrame, hull, names: list[str], max_rows: int = 4096) -> DataFrame:
    """Few rows per instance whose hull equals the instance's hull.

    Each task keeps the hulls of its own rows where a batch holds many of them; instances with more than ``max_rows`` rows left are merged in groups of
    about that size, level by level, until they are small or all that is left is hull.
    """
    schema = "scan_id string, instance_id int, " + ", ".join(f"{n} double" for n in names)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        keep = pd.DataFrame(hull(pdf[names].to_numpy(float)), columns=names)
        keep.insert(0, "scan_id", pdf["scan_id"].iloc[0])
        keep.insert(1, "instance_id", pdf["instance_id"].iloc[0])
        return keep

    left = cut(rows.select(*SEG, *[F.col(n).cast("double").alias(n) for n in names]).mapInPandas(_reducer(hull, names), schema))
    before = None
    while True:
        sizes = left.groupBy(*SEG).agg(F.count("*").alias("_n")).filter(F.col("_n") > max_rows)
        total = sizes.agg(F.sum("_n")).first()[0]
        if total is None or (before is not None and total > 0.9 * before):
            return left
        before = total
        groups = F.ceil(F.col("_n") / max_rows).cast("int")
        wide = left.join(sizes, SEG).withColumn("_g", F.pmod(F.xxhash64(*names), groups))
        wide = wide.groupBy(*SEG, "_g").applyInPandas(lambda pdf: merge(pdf), schema)
        left = cut(left.join(sizes, SEG, "left_anti").unionByName(wide))


def fit_gravity_obb(points: DataFrame) -> DataFrame:
    """Yaw-only smallest-footprint box per (scan_id, instance_id)."""
    flat = points.filter("instance_id >= 0")
    ends = flat.groupBy(*SEG).agg(F.count("*").alias("n"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    cand = _hull_candidates(flat, hull_2d, ["x", "z"])

    def box(pdf: pd.DataFrame) -> pd.DataFrame:
        rim = hull_2d(pdf[["x", "z"]].to_numpy(float))
        edges = np.diff(rim, axis=0, append=rim[:1]) if len(rim) >= 3 else np.array([[1.0, 0.0]])
        along = edges / np.linalg.norm(edges, axis=1, keepdims=True)
        # One frame per edge: the edge and its left normal; all corners of the rim in all frames at once.
        frames = np.stack([along, along[:, ::-1] * (-1.0, 1.0)], axis=1)
        seen = frames @ rim.T
        low, high = seen.min(axis=2), seen.max(axis=2)
        i = int(np.argmin((high - low).prod(axis=1)))
        centre = (low[i] + high[i]) / 2 @ frames[i]
        size = np.maximum(high[i] - low[i], BOX_FLOOR) + FIT_PAD
        return pd.DataFrame([{
            "scan_id": pdf["scan_id"].iloc[0], "instance_id": pdf["instance_id"].iloc[0], "cx": centre[0], "cz": centre[1],
            "sx": size[0], "sz": size[1], "ry": -float(np.arctan2(along[i, 1], along[i, 0])),
        }])

    rects = cand.groupBy(*SEG).applyInPandas(
        box, "scan_id string, instance_id int, cx double, cz double, sx double, sz double, ry double"
    )
    return rects.join(ends, SEG).select(
        *SEG, "n", "cx", ((F.col("y0") + F.col("y1")) / 2.0).alias("cy"), "cz", "sx",
        (F.col("y1") - F.col("y0") + FIT_PAD).alias("sy"), "sz", "ry",
    )


def box_mesh(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners and outward triangles of an axis-aligned box: two triangles for each end of each axis."""
    bits = np.indices((2, 2, 2)).reshape(3, 8).T
    faces = []
    for axis in range(3):
        ring = np.zeros((4, 3), int)
        ring[:, (axis + 1) % 3] = [0, 1, 1, 0]
        ring[:, (axis + 2) % 3] = [0, 0, 1, 1]
        for end in (0, 1):
            ring[:, axis] = end
            quad = (ring if end else ring[::-1]) @ [4, 2, 1]
            faces += [quad[[0, 1, 2]], quad[[0, 2, 3]]]
    return np.where(bits == 1, high, low), np.array(faces)


def convex_hulls(points: DataFrame, resolution: float = 0.05) -> DataFrame:
    """(scan_id, instance_id, n, vertices, faces, volume) per segment; flat or tiny ones are boxes."""
    seg = points.filter("instance_id >= 0")
    counts = seg.groupBy(*SEG).agg(F.count("*").alias("n"))
    cand = _hull_candidates(seg, _vertices, ["x", "y", "z"])
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pts = pdf[["x", "y", "z"]].to_numpy(float)
        n = int(pdf["n"].iloc[0])
        got = hull_3d(pts) if n >= 4 else None
        if got is None:
            pad = resolution * 0.4 if n == 1 else resolution * 0.05
            verts, faces = box_mesh(pts.min(0) - pad, pts.max(0) + pad)
        else:
            verts, faces = got
        a, b, c = (verts[faces[:, i]] for i in range(3))
        volume = float(np.einsum("ij,ij->i", a, np.cross(b, c)).sum() / 6.0)
        return pd.DataFrame([{
            "scan_id": pdf["scan_id"].iloc[0], "instance_id": pdf["instance_id"].iloc[0], "n": n,
            "vertices": verts.tolist(), "faces": faces.tolist(), "is_box": got is None, "volume": abs(volume),
        }])

    return cand.join(counts, SEG).groupBy(*SEG).applyInPandas(
        build,
        "scan_id string, instance_id int, n bigint, vertices array<array<double>>, faces array<array<int>>, is_box boolean, volume double",
    )


def instance_meshes(points: DataFrame, ids: DataFrame, min_points: int = 100) -> DataFrame:
    """Hull mesh per wanted instance, or the reason it was skipped."""
    want = points.join(small(ids.select(*SEG).distinct()), SEG, "left_semi")
    sizes = want.groupBy(*SEG).count()
    big = want.join(sizes.filter(F.col("count") >= min_points).select(*SEG), SEG, "left_semi")
    mesh = convex_hulls(big).filter("NOT is_box").select(*SEG, "vertices", "faces")
    out = ids.select(*SEG).distinct().join(sizes, SEG, "left").join(mesh, SEG, "left")
    reason = F.when(F.coalesce("count", F.lit(0)) < min_points, "too few points").when(F.col("faces").isNull(), "coplanar")
    return out.select(*SEG, F.coalesce("count", F.lit(0)).alias("n_points"), "vertices", "faces", reason.alias("skipped"))
