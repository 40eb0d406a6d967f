"""Point-in-shape predicates: boxes, prisms, tubes, balls and op chains.

Every predicate is one boolean column; cheap bounds come before exact tests so
Parquet statistics and short-circuiting can drop most points early.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import col, euler_matrix

CHAIN_EPS = 1e-6


def in_aabb(low, high, x="x", y="y", z="z") -> Column:
    ok = F.lit(True)
    for c, a, b in zip((x, y, z), low, high):
        ok = ok & col(c).between(col(a), col(b))
    return ok


def in_obb(center, size, rotation, eps: float = 0.0, xyz=("x", "y", "z")) -> Column:
    """|(p - c) @ R| <= size / 2 on every axis, R from Euler XYZ radians."""
    r = euler_matrix(*rotation)
    d = [col(c) - col(o) for c, o in zip(xyz, center)]
    ok = F.lit(True)
    for j in range(3):
        local = d[0] * r[j] + d[1] * r[3 + j] + d[2] * r[6 + j]
        ok = ok & (F.abs(local) <= col(size[j]) / 2.0 + F.lit(eps))
    return ok


def obb_aabb(center, size, rotation) -> tuple[list[Column], list[Column]]:
    """Axis-aligned bounds of a rotated box, derived from |R| * half size."""
    r = euler_matrix(*rotation)
    low, high = [], []
    for i in range(3):
        reach = sum((F.abs(r[3 * i + j]) * col(size[j]) / 2.0 for j in range(3)), F.lit(1e-9))
        low.append(col(center[i]) - reach)
        high.append(col(center[i]) + reach)
    return low, high


def bounded_obb(center, size, rotation, eps: float = 0.0) -> Column:
    """``in_obb`` for literal boxes, preceded by pushable axis bounds."""
    half = math.sqrt(sum((float(s) / 2.0 + eps) ** 2 for s in size)) * (1 + 1e-9)
    low = [float(c) - half for c in center]
    high = [float(c) + half for c in center]
    return in_aabb(low, high) & in_obb(center, size, rotation, eps)


def in_ring(polygon: Column, x="x", z="z") -> Column:
    """Even-odd ray cast in XZ against an array of [x, z] vertices."""
    px, pz = col(x), col(z)
    ring = col(polygon)
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a = F.element_at(ring, i)
        b = F.element_at(ring, F.when(i == n, F.lit(1)).otherwise(i + 1))
        straddles = (a[1] > pz) != (b[1] > pz)
        rise = F.when(b[1] != a[1], b[1] - a[1]).otherwise(F.lit(1.0))
        return straddles & (px < a[0] + (pz - a[1]) * (b[0] - a[0]) / rise)

    hits = F.aggregate(F.sequence(F.lit(1), n), F.lit(False), lambda acc, i: acc != crosses(i))
    return F.when(n < 3, F.lit(False)).otherwise(hits)


def in_prism(polygon, y0, height, xyz=("x", "y", "z")) -> Column:
    x, y, z = xyz
    h = col(height)
    return (h > 0) & col(y).between(col(y0), col(y0) + h) & in_ring(polygon, x, z)


def literal_prism(prism: dict) -> Column:
    """Prism test for a literal shape, with derived bounds in front."""
    ring = [[float(a), float(b)] for a, b in prism["polygon"]]
    if len(ring) < 3 or float(prism["height"]) <= 0:
        return F.lit(False)
    y0, h = float(prism["y0"]), float(prism["height"])
    xs, zs = [p[0] for p in ring], [p[1] for p in ring]
    bounds = in_aabb((min(xs), y0, min(zs)), (max(xs), y0 + h, max(zs)))
    array = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ring])
    return bounds & in_ring(array)


def segment_d2(a, b, xyz=("x", "y", "z")) -> Column:
    """Squared distance to segment a-b; a zero-length one is a point."""
    p, a, b = [col(c) for c in xyz], [col(c) for c in a], [col(c) for c in b]
    d = [q - s for q, s in zip(b, a)]
    rel = [q - s for q, s in zip(p, a)]
    l2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    along = rel[0] * d[0] + rel[1] * d[1] + rel[2] * d[2]
    t = F.when(l2 < 1e-12, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), along / F.when(l2 < 1e-12, F.lit(1.0)).otherwise(l2)))
    )
    off = [q - t * s for q, s in zip(rel, d)]
    return off[0] * off[0] + off[1] * off[1] + off[2] * off[2]


def in_tube(paths: list[dict]) -> Column:
    """Within ``radius`` of any chord of any literal path."""
    from .geometry import sample_path

    hit = F.lit(False)
    for path in paths:
        pts, radius = sample_path(path), float(path["radius"])
        for a, b in zip(pts, pts[1:]):
            low = [min(p, q) - radius for p, q in zip(a, b)]
            high = [max(p, q) + radius for p, q in zip(a, b)]
            hit = hit | (in_aabb(low, high) & (segment_d2(a, b) <= radius * radius))
    return hit


def in_ball(center, radius: float, ray=None, depth: float | None = None) -> Column:
    """Ball test, optionally culled to ``depth`` along a view ray."""
    d = [col(c) - col(o) for c, o in zip("xyz", center)]
    ok = d[0] * d[0] + d[1] * d[1] + d[2] * d[2] <= radius * radius
    if ray is not None and depth is not None:
        n = math.sqrt(sum(float(v) ** 2 for v in ray)) or 1.0
        along = sum((q * (float(v) / n) for q, v in zip(d, ray)), F.lit(0.0))
        ok = ok & (along <= depth)
    return ok


def in_shape(shape: dict) -> Column:
    kind = shape.get("type")
    if kind == "obb":
        return bounded_obb(shape["center"], shape["size"], shape["rotation"])
    if kind == "prism":
        return literal_prism(shape)
    if kind == "tube":
        return in_tube(shape["paths"])
    raise ValueError(f"unknown shape type: {kind!r}")


def ops_chain(ops: list[dict]) -> Column:
    """Ordered keep (intersect) / delete (subtract) boxes; an empty chain keeps all."""
    alive = F.lit(True)
    for op in ops:
        inside = bounded_obb(op["center"], op["size"], op["rotation"], CHAIN_EPS)
        alive = alive & (~inside if op.get("op", "keep") == "delete" else inside)
    return alive


def in_box(box: dict, inside: bool = True) -> Column:
    hit = bounded_obb(box["center"], box["size"], box["rotation"])
    return hit if inside else ~hit


def region_mask(prism: dict, offset=(0.0, 0.0, 0.0)) -> Column:
    """A stored region tested in the display frame (prism moved by -offset)."""
    dx, dy, dz = (float(v) for v in offset)
    moved = {
        "polygon": [[a - dx, b - dz] for a, b in prism["polygon"]],
        "y0": float(prism["y0"]) - dy,
        "height": prism["height"],
    }
    return literal_prism(moved)


def drop_unlabeled(labels: DataFrame) -> DataFrame:
    return labels.filter(F.col("class_id") >= 0)


def slice_export(points: DataFrame, ops: list[dict], z_up: bool, offset=(0.0, 0.0, 0.0)) -> DataFrame:
    """Points surviving the chain in the display frame, returned in source frame."""
    from .frames import to_display

    shown = dict(zip("xyz", to_display("sx", "sy", "sz", z_up, offset)))
    src = points.withColumnsRenamed({"x": "sx", "y": "sy", "z": "sz"})
    kept = src.withColumns(shown).filter(ops_chain(ops)).drop("x", "y", "z")
    return kept.withColumnsRenamed({"sx": "x", "sy": "y", "sz": "z"}).select(*points.columns)
