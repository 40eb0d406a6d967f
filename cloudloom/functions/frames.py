"""Coordinate frames, rotations and cameras as column expressions.

A vector is a tuple of three columns; a rotation is nine columns, row-major.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small

# Euler XYZ radians per up-axis preset.
ORIENTATION_PRESETS = {
    "Y+": (0.0, 0.0, 0.0),
    "Z+": (-math.pi / 2, 0.0, 0.0),
    "X+": (0.0, 0.0, math.pi / 2),
    "Y-": (math.pi, 0.0, 0.0),
    "Z-": (math.pi / 2, 0.0, 0.0),
    "X-": (0.0, 0.0, -math.pi / 2),
}
RECENTER_GATE = 1000.0
GIMBAL = 0.9999999


def col(v) -> Column:
    return v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(float(v))


def z_up_to_y_up(x, y, z):
    return col(x), col(z), -col(y)


def y_up_to_z_up(x, y, z):
    return col(x), -col(z), col(y)


def with_xyz(df: DataFrame, xyz) -> DataFrame:
    return df.withColumns(dict(zip(("x", "y", "z"), xyz)))


def is_z_up(source_mesh, source_laz) -> Column:
    """Y-up only when sampled from a mesh and not from a LAZ file."""
    given = lambda c: F.coalesce(col(c), F.lit("")) != ""
    return ~(given(source_mesh) & ~given(source_laz))


def recenter_offsets(points: DataFrame) -> DataFrame:
    """(scan_id, ox, oy, oz): the mean where any |mean| >= 1000 m, else zero."""
    means = points.groupBy("scan_id").agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"])
    far = F.greatest(*[F.abs(f"m{a}") for a in "xyz"]) >= RECENTER_GATE
    return means.select(
        "scan_id", *[F.when(far, F.col(f"m{a}")).otherwise(F.lit(0.0)).alias(f"o{a}") for a in "xyz"]
    )


def recenter(points: DataFrame) -> DataFrame:
    offsets = recenter_offsets(points)
    moved = points.join(small(offsets), "scan_id")
    return moved.withColumns({a: F.col(a) - F.col(f"o{a}") for a in "xyz"})


def to_display(x, y, z, z_up: bool, offset=(0.0, 0.0, 0.0)):
    xyz = z_up_to_y_up(x, y, z) if z_up else (col(x), col(y), col(z))
    return tuple(c - col(o) for c, o in zip(xyz, offset))


def to_source(x, y, z, z_up: bool, offset=(0.0, 0.0, 0.0)):
    xyz = tuple(col(c) + col(o) for c, o in zip((x, y, z), offset))
    return y_up_to_z_up(*xyz) if z_up else xyz


def euler_matrix(rx, ry, rz) -> list[Column]:
    """Intrinsic XYZ: R = Rx * Ry * Rz."""
    rx, ry, rz = col(rx), col(ry), col(rz)
    ca, sa, cb, sb, cc, sc = F.cos(rx), F.sin(rx), F.cos(ry), F.sin(ry), F.cos(rz), F.sin(rz)
    return [
        cb * cc, -(cb * sc), sb,
        ca * sc + sa * sb * cc, ca * cc - sa * sb * sc, -(sa * cb),
        sa * sc - ca * sb * cc, sa * cc + ca * sb * sc, ca * cb,
    ]


def euler_from_basis(u, v, w):
    """Euler XYZ of the rotation whose columns are u, v, w."""
    u, v, w = ([col(c) for c in t] for t in (u, v, w))
    m13 = F.greatest(F.least(w[0], F.lit(1.0)), F.lit(-1.0))
    free = F.abs(m13) < GIMBAL
    rx = F.when(free, F.atan2(-w[1], w[2])).otherwise(F.atan2(v[2], v[1]))
    rz = F.when(free, F.atan2(-v[0], u[0])).otherwise(F.lit(0.0))
    return rx, F.asin(m13), rz


def dot(a, b) -> Column:
    return sum((p * q for p, q in zip(a[1:], b[1:])), a[0] * b[0])


def cross(a, b):
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def unit(a, eps: float = 1e-12):
    n = F.sqrt(dot(a, a)) + eps
    return tuple(c / n for c in a)


def apply_transform(matrix, x, y, z):
    """Rows of a 4x4 ``matrix`` (16 columns or numbers) applied to a point."""
    m = [col(v) for v in matrix]
    p = (col(x), col(y), col(z))
    return tuple(m[4 * i] * p[0] + m[4 * i + 1] * p[1] + m[4 * i + 2] * p[2] + m[4 * i + 3] for i in range(3))


def compose_transform(from_matrix, to_matrix, z_up: bool = False):
    """16 numbers taking frame A to frame V through the shared canonical frame."""
    import numpy as np

    a = np.asarray(from_matrix, dtype=float).reshape(4, 4)
    v = np.asarray(to_matrix, dtype=float).reshape(4, 4)
    t = np.linalg.inv(v) @ a
    if z_up:
        turn = np.array([[1, 0, 0, 0], [0, 0, 1, 0], [0, -1, 0, 0], [0, 0, 0, 1]], dtype=float)
        t = turn @ t @ turn.T
    return [float(x) for x in t.ravel()]


def shift_prism(prism, dx, dy, dz) -> Column:
    """Prism struct {polygon [[x, z]], y0, height} moved by a vector."""
    prism = col(prism)
    ring = F.transform(prism["polygon"], lambda p: F.array(p[0] + col(dx), p[1] + col(dz)))
    return F.struct(
        ring.alias("polygon"), (prism["y0"] + col(dy)).alias("y0"), prism["height"].alias("height")
    )


def prism_aabb(prism) -> dict[str, Column]:
    prism = col(prism)
    xs = F.transform(prism["polygon"], lambda p: p[0])
    zs = F.transform(prism["polygon"], lambda p: p[1])
    return {
        "x0": F.array_min(xs), "y0": prism["y0"], "z0": F.array_min(zs),
        "x1": F.array_max(xs), "y1": prism["y0"] + prism["height"], "z1": F.array_max(zs),
    }


def fov_vertical(fov, axis, width, height) -> Column:
    """Vertical field of view in degrees; a horizontal one is converted; default 60."""
    fov = F.coalesce(col(fov), F.lit(60.0))
    from_h = F.degrees(2.0 * F.atan(F.tan(F.radians(fov) / 2.0) * col(height) / col(width)))
    return F.when(F.coalesce(col(axis), F.lit("vertical")) == "horizontal", from_h).otherwise(fov)


def yaw_target(position, target, yaw) -> Column:
    """The stored target, or one metre ahead along the yaw angle."""
    pos, yaw = col(position), col(yaw)
    ahead = F.array(pos[0] + F.cos(yaw), pos[1] + F.lit(0.0), pos[2] + F.sin(yaw))
    return F.coalesce(col(target), ahead)


def look_at(position, target, up=(0.0, 1.0, 0.0)) -> list[Column]:
    """World-to-camera rows: nine rotation columns then three translations."""
    pos = [col(position)[i] for i in range(3)]
    fwd = unit(tuple(col(target)[i] - pos[i] for i in range(3)))
    side = unit(cross(fwd, [col(u) for u in up]))
    top = cross(side, fwd)
    rows = [side, top, tuple(-c for c in fwd)]
    return [c for row in rows for c in row] + [-dot(row, pos) for row in rows]


def camera_to_native(position, target, recenter_offset, georef_offset, z_up: bool):
    """Display-frame camera vectors moved to the raw file's frame."""
    out = []
    for v in (position, target):
        moved = [col(v)[i] + col(recenter_offset[i]) for i in range(3)]
        native = y_up_to_z_up(*moved) if z_up else moved
        out.append(F.array(*[n + col(g) for n, g in zip(native, georef_offset)]))
    return tuple(out)
