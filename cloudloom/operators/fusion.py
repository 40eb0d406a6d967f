"""Camera projection and multi-view fusion; pixels, masks and feature maps are tables.

``frames`` has (frame_id, position array, target array, fov, width, height).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import look_at
from ..schema import UNSET
from ..session import cut, is_empty, many, small
from .celltree import meet_flocks, meet_views, meet_views_apart
from .flocks import HELD, Flock, each, gather, packed

KEY = ["scan_id", "point_id"]
PIX = ["frame_id", "u", "v"]
# Depth test tolerances, splat radius, range, near plane.
TOL_REL, TOL_ABS, SPLAT, MAX_DEPTH, NEAR = 0.01, 0.15, 2, 80.0, 0.05
BACKGROUND = 0.05
#: Side of the tiles in which images are worked on.
TILE = 128
#: Points that a view may meet for the points of each of its tiles to be held by one task; those of fuller views go by pixels.
CROWD = 1_000_000
#: Pixels of the largest image that a task holds whole; larger ones are worked on in tiles.
WHOLE = 1 << 24


def with_views(frames: DataFrame, up=(0.0, 1.0, 0.0)) -> DataFrame:
    view = look_at("position", "target", up)
    focal = (F.col("height") / 2.0) / F.tan(F.radians("fov") / 2.0)
    return frames.select(
        "frame_id", "width", "height", focal.alias("focal"), *[c.alias(f"m{i}") for i, c in enumerate(view)]
    )


def project(points: DataFrame, frames: DataFrame, max_depth: float | None = None, up=(0.0, 1.0, 0.0)) -> DataFrame:
    """(keys, frame_id, pu, pv, depth, in_front, width, height) with sub-pixel coordinates.

    Points meet the frames whose view can hold them through a tree of cells, so the work follows the points in view and
    not points times frames.  Views have no far end unless ``max_depth`` is given; rows outside a view may be missing.
    """
    return _projected(meet_views(points, with_views(frames, up), NEAR, max_depth))


def _projected(joined: DataFrame) -> DataFrame:
    cam = [sum((F.col(f"m{3 * i + j}") * F.col(a) for j, a in enumerate("xyz")), F.col(f"m{9 + i}")) for i in range(3)]
    depth = -cam[2]
    safe = F.greatest(depth, F.lit(1e-6))
    drop = [f"m{i}" for i in range(12)] + ["focal"]
    return joined.withColumns(
        {
            "pu": cam[0] * F.col("focal") / safe + F.col("width") / 2.0,
            "pv": -cam[1] * F.col("focal") / safe + F.col("height") / 2.0,
            "depth": depth, "in_front": depth > NEAR,
        }
    ).drop(*drop)


def on_screen(proj: DataFrame, max_depth: float | None) -> DataFrame:
    ok = F.col("in_front") & (F.col("pu") >= 0) & (F.col("pu") < F.col("width")) & (F.col("pv") >= 0) & (F.col("pv") < F.col("height"))
    if max_depth is not None:
        ok = ok & (F.col("depth") < max_depth)
    return proj.filter(ok).withColumns({"u": F.floor("pu").cast("int"), "v": F.floor("pv").cast("int")})


def _seen(points: DataFrame, frames: DataFrame, max_depth: float | None) -> tuple[DataFrame, DataFrame | None]:
    """Points on screen, of views that meet at most ``CROWD`` points and of fuller ones, if there are any."""
    parts = meet_views_apart(points, with_views(frames), NEAR, max_depth, CROWD)
    return tuple(part if part is None else on_screen(_projected(part), max_depth) for part in parts)


def _tiled(rows: DataFrame, splat: int) -> DataFrame:
    """Each row in the few tiles (_tu, _tv) that the window around its pixel touches."""
    def tiles(c, size):
        low, high = F.greatest(F.col(c) - splat, F.lit(0)), F.least(F.col(c) + splat, F.col(size) - 1)
        return F.explode(F.sequence(F.floor(low / TILE).cast("int"), F.floor(high / TILE).cast("int")))

    return rows.withColumn("_tu", tiles("u", "width")).withColumn("_tv", tiles("v", "height"))


def _least_depth(rows: pa.Table, splat: int) -> tuple:
    """The least depth around each pixel of one tile, infinite where there is none, and the tile's corner."""
    at, up, us, vs, ws, hs, depth = (rows[c].to_numpy() for c in ("_tu", "_tv", "u", "v", "width", "height", "depth"))
    u0, v0 = at[0] * TILE, up[0] * TILE
    best = np.full((TILE, TILE), np.inf)
    for w, h in sorted(set(zip(ws.tolist(), hs.tolist()))):
        mine = (ws == w) & (hs == h)
        low = np.full((TILE + 2 * splat, TILE + 2 * splat), np.inf)
        np.minimum.at(low, (vs[mine] - v0 + splat, us[mine] - u0 + splat), depth[mine])
        low = np.minimum.reduce([low[k:k + TILE] for k in range(2 * splat + 1)])
        low = np.minimum.reduce([low[:, k:k + TILE] for k in range(2 * splat + 1)])
        np.minimum(best[:h - v0, :w - u0], low[:h - v0, :w - u0], out=best[:h - v0, :w - u0])
    return best, u0, v0


def _least_around(pixels: DataFrame, splat: int, order: list[str]) -> DataFrame:
    """(frame_id, u, v, order columns): the least row in the (2r+1)^2 window around a pixel; empty windows are left out.

    ``pixels`` = (frame_id, u, v, width, height, order columns), nulls first.  Images are cut into tiles, and a pixel goes
    to the few tiles that its window touches instead of to every pixel of its window.
    """
    def least(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in order], null_placement="at_start"))
        n, (at, up, us, vs, ws, hs) = len(rows), (rows[c].to_numpy() for c in ("_tu", "_tv", "u", "v", "width", "height"))
        u0, v0 = at[0] * TILE, up[0] * TILE
        best = np.full((TILE, TILE), n)
        for w, h in sorted(set(zip(ws.tolist(), hs.tolist()))):
            # Places in the order of the rows, the least written last; a window is a minimum along each axis.
            mine = np.flatnonzero((ws == w) & (hs == h))[::-1]
            place = np.full((TILE + 2 * splat, TILE + 2 * splat), n)
            place[vs[mine] - v0 + splat, us[mine] - u0 + splat] = mine
            place = np.minimum.reduce([place[k:k + TILE] for k in range(2 * splat + 1)])
            place = np.minimum.reduce([place[:, k:k + TILE] for k in range(2 * splat + 1)])
            np.minimum(best[:h - v0, :w - u0], place[:h - v0, :w - u0], out=best[:h - v0, :w - u0])
        v, u = np.nonzero(best < n)
        got = rows.select(["frame_id", *order]).take(best[v, u])
        return got.append_column("u", pa.array(u + u0, pa.int32())).append_column("v", pa.array(v + v0, pa.int32())).select([*PIX, *order])

    kept = pixels.select(*PIX, "width", "height", *order)
    types = {f.name: f.dataType.simpleString() for f in kept.schema.fields} | {"u": "int", "v": "int"}
    return _tiled(kept, splat).groupBy("frame_id", "_tu", "_tv").applyInArrow(least, ", ".join(f"`{c}` {types[c]}" for c in [*PIX, *order]))


def depth_buffer(seen: DataFrame, splat: int = SPLAT) -> DataFrame:
    """(frame_id, u, v, zmin): the minimum is taken per pixel before the splat, which changes nothing but the cost."""
    low = seen.groupBy(*PIX, "width", "height").agg(F.min("depth").alias("zmin"))
    return _least_around(low, splat, ["zmin"])


class _Met:
    """Points and the views that may see them: in flocks, and the rows on screen of views in none (``few`` by tiles, ``full`` by pixels)."""

    def __init__(self, points: DataFrame, frames: DataFrame, max_depth: float | None):
        self.view = with_views(frames)
        self.points, self.named, *rest = meet_flocks(points, self.view, NEAR, max_depth, CROWD, WHOLE)
        self.few, self.full = (part if part is None else on_screen(_projected(part), max_depth) for part in rest)
        self.far, self.row = max_depth, on_screen(_projected(points.limit(0).join(self.view, F.lit(False))), max_depth)

    def made(self, work, schema: T.StructType | str, keep: list[str], beside: DataFrame | None = None, splat: int = SPLAT) -> DataFrame:
        """What ``work`` makes of each flock, whose points bring the columns ``keep``."""
        return each(gather(self.points, self.view, self.named, keep, beside), work, schema, NEAR, self.far, splat)

    def others(self, tol_rel: float, tol_abs: float, splat: int, kept: list[str]) -> DataFrame | None:
        """Visible rows of the views in no flock, if there are any."""
        return None if self.few is None and self.full is None else _visible_rows(self.few, self.full, tol_rel, tol_abs, splat, kept)


def visible(points: DataFrame, frames: DataFrame, tol_rel: float = TOL_REL, tol_abs: float = TOL_ABS, splat: int = SPLAT, max_depth: float = MAX_DEPTH, keep: list[str] | None = None) -> DataFrame:
    """Projected rows whose depth is within tolerance of the splatted z-buffer; with ``keep``, pixels and these columns only.

    Points meet the z-buffers of a flock of views in one task; those of views in no flock meet them by tiles or by pixels.
    """
    met = _Met(points, frames, max_depth)
    kept = [*PIX, *([c for c in met.row.columns if c not in (*PIX, "in_front")] if keep is None else keep)]
    types = {f.name: f.dataType for f in met.row.schema}
    schema = T.StructType([T.StructField(c, types[c]) for c in kept])
    size = {"width": met.row.schema["width"].dataType, "height": met.row.schema["height"].dataType}
    whole = {c: pa.from_numpy_dtype(np.dtype({"int": "i4", "bigint": "i8", "smallint": "i2", "tinyint": "i1", "float": "f4"}.get(t.simpleString(), "f8"))) for c, t in size.items()}
    own = [c for c in kept if c in points.columns]

    def rows(flock: Flock):
        for k in range(len(flock.frames)):
            place, u, v, pu, pv, depth = flock.visible(k, tol_rel, tol_abs)
            if len(place):
                got = flock.points.select(own).take(place)
                extra = {"frame_id": flock.frames.take(pa.array(np.full(len(place), k))), "u": pa.array(u, pa.int32()), "v": pa.array(v, pa.int32()), "pu": pa.array(pu), "pv": pa.array(pv), "depth": pa.array(depth)}
                extra |= {c: pa.array(np.full(len(place), n)).cast(whole[c]) for c, n in zip(size, flock.image(k))}
                yield pa.table({c: got[c] if c in own else extra[c] for c in kept})

    out, rest = met.made(rows, schema, own, splat=splat), met.others(tol_rel, tol_abs, splat, kept)
    return out if rest is None else out.unionByName(rest)


def _visible_rows(few: DataFrame | None, full: DataFrame | None, tol_rel: float, tol_abs: float, splat: int, kept: list[str]) -> DataFrame:
    """Rows of ``few`` that pass the test in the task that makes the z-buffer of their tile, and rows of ``full`` that join it by pixels."""
    def pass_test(rows: pa.Table) -> pa.Table:
        best, u0, v0 = _least_depth(rows, splat)
        us, vs, depth = rows["u"].to_numpy() - u0, rows["v"].to_numpy() - v0, rows["depth"].to_numpy()
        home = np.flatnonzero((us >= 0) & (us < TILE) & (vs >= 0) & (vs < TILE))
        low = best[vs[home], us[home]]
        return rows.select(kept).take(home[depth[home] <= low + np.maximum(tol_abs, tol_rel * low)])

    out = []
    if few is not None:
        # Only the columns asked for travel: a plan cannot leave out what goes through a task.
        rows = few.select(*kept, *[c for c in ("width", "height", "depth") if c not in kept])
        out.append(_tiled(rows, splat).groupBy("frame_id", "_tu", "_tv").applyInArrow(pass_test, T.StructType([T.StructField(f.name, f.dataType) for f in few.select(*kept).schema])))
    if full is not None:
        full = cut(full)
        ok = F.col("depth") <= F.col("zmin") + F.greatest(F.lit(tol_abs), tol_rel * F.col("zmin"))
        out.append(full.join(many(depth_buffer(full, splat)), PIX).filter(ok).select(*kept))
    return reduce(DataFrame.unionByName, out)


def _key_types(points: DataFrame) -> list[T.StructField]:
    return [T.StructField(f.name, f.dataType) for f in points.select(*KEY).schema]


def _numbered(flock: Flock) -> tuple[np.ndarray, np.ndarray, bool]:
    """The number of each point's key, a point of each key, and whether a key has several points."""
    number = flock.keys(KEY)
    if number is None:
        every = np.arange(len(flock.points))
        return every, every, False
    return number, np.unique(number, return_index=True)[1], True


def raster_render(points: DataFrame, frames: DataFrame, splat: int = SPLAT) -> DataFrame:
    """(frame_id, u, v, depth, r, g, b): nearest colour per covered pixel."""
    few, full = _seen(points, frames, None)
    order = ["depth", "point_id", "r", "g", "b"]
    out = _least_around(few, splat, order)
    if full is not None:
        best = full.groupBy(*PIX, "width", "height").agg(F.min(F.struct(*order)).alias("w"))
        out = out.unionByName(_least_around(best.select(*PIX, "width", "height", "w.*"), splat, order))
    return out.select(*PIX, "depth", "r", "g", "b")


def points_in_mask(points: DataFrame, frames: DataFrame, mask: DataFrame, depth: DataFrame, splat: int = SPLAT, empty_accepts: bool = True) -> DataFrame:
    """(keys, frame_id, mask_id): points on mask pixels that pass the depth image.

    ``depth`` lists filled pixels only.  Where the whole window is empty the
    point passes, as the computed comparison does; ``empty_accepts=False`` drops it.
    """
    seen = on_screen(project(points, frames, None), None)
    size = frames.select("frame_id", "width", "height")
    window = depth_buffer(depth.join(small(size), "frame_id"), splat)
    hit = seen.join(many(mask.select(*PIX, "mask_id")), PIX).join(window, PIX, "left")
    within = F.col("depth") <= F.col("zmin") + F.greatest(F.lit(TOL_ABS), TOL_REL * F.col("zmin"))
    ok = F.coalesce(within, F.lit(empty_accepts))
    return hit.filter(ok).select(*KEY, "frame_id", "mask_id")


def _times_seen(met: _Met) -> DataFrame:
    """(keys, seen): how often each point is visible, in one row or several."""
    def count(flock: Flock):
        n = np.zeros(len(flock.points), np.int64)
        for k in range(len(flock.frames)):
            n[flock.visible(k, TOL_REL, TOL_ABS)[0]] += 1
        hit = np.flatnonzero(n)
        yield flock.points.select(KEY).take(hit).append_column("seen", pa.array(n[hit]))

    out, rest = met.made(count, T.StructType([*_key_types(met.points), T.StructField("seen", T.LongType())]), KEY), met.others(TOL_REL, TOL_ABS, SPLAT, [*PIX, *KEY])
    return out if rest is None else out.unionByName(rest.groupBy(*KEY).agg(F.count("*").alias("seen")))


def registration_score(points: DataFrame, frames: DataFrame, pixels: DataFrame | None = None, color_tol: int = 40) -> DataFrame:
    """One row: coverage, photometric, n_seen, n_points, n_frames."""
    if pixels is not None:
        vis = visible(points, frames, keep=[*KEY, *"rgb"])
        cols = pixels.select(*PIX, *[F.col(c).alias(f"p{c}") for c in "rgb"])
        vis = vis.join(many(cols), PIX, "left")
        diff = sum((F.abs(F.col(c) - F.col(f"p{c}")) for c in "rgb"), F.lit(0.0)) / 3.0
        per = vis.groupBy(*KEY).agg(F.count("*").alias("t"), F.count_if(diff < color_tol).alias("a"))
    else:
        per = _times_seen(_Met(points, frames, MAX_DEPTH)).groupBy(*KEY).agg(F.lit(0).cast("bigint").alias("t"), F.lit(0).cast("bigint").alias("a"))
    score = per.agg(F.count("*").alias("n_seen"), F.coalesce(F.sum("t"), F.lit(0)).alias("t"), F.coalesce(F.sum("a"), F.lit(0)).alias("a"))
    total = points.agg(F.count("*").alias("n_points"))
    n_frames = frames.agg(F.count("*").alias("n_frames"))
    one = score.join(total, how="cross").join(n_frames, how="cross")
    return one.select(
        F.when(F.col("n_points") > 0, F.col("n_seen") / F.col("n_points")).otherwise(0.0).alias("coverage"),
        F.when(F.col("t") > 0, F.col("a") / F.col("t")).alias("photometric"), "n_seen", "n_points", "n_frames",
    )


def check_registration(score: DataFrame, min_coverage: float = 0.35, min_photometric: float = 0.5, floor: float = 0.05) -> DataFrame:
    """Adds ok and reasons; with colours the photometric share decides, else coverage."""
    p, cov = F.col("photometric"), F.col("coverage")
    reasons = F.array_compact(
        F.array(
            F.when(p < min_photometric, "photometric agreement too low"),
            F.when(p.isNotNull() & (cov < floor), "nothing projects into the frames"),
            F.when(p.isNull() & (cov < min_coverage), "coverage too low and no colours to confirm"),
        )
    )
    return score.withColumn("reasons", reasons).withColumn("ok", F.size("reasons") == 0)


def resolve_render_run(clouds: DataFrame, runs: DataFrame) -> DataFrame:
    """(scan_id, run_id, action, reason): use_direct, remap or fail.

    ``clouds`` = (scan_id, canonical_id, variant_id, fingerprint); ``runs`` =
    (scan_id, run_id, run_canonical_id, source_variant, source_fingerprint).
    """
    rows = runs.join(clouds, "scan_id")
    no_pin = F.coalesce("source_variant", F.lit("")) == ""
    no_pin = no_pin | F.col("run_canonical_id").isNull()
    foreign = F.col("run_canonical_id") != F.col("canonical_id")
    same = (F.col("source_variant") == F.col("variant_id")) & (
        F.col("source_fingerprint").isNull() | (F.col("source_fingerprint") == F.col("fingerprint"))
    )
    action = F.when(no_pin | foreign, "fail").when(same, "use_direct").otherwise("remap")
    reason = F.when(no_pin, "no source pin").when(foreign, "different scan")
    return rows.select("scan_id", "run_id", action.alias("action"), reason.alias("reason"))


def pick_frames(frames: DataFrame, stride: int = 1, max_frames: int = 0) -> DataFrame:
    """Every stride-th frame per run, capped per run when ``max_frames`` > 0."""
    pos = F.row_number().over(Window.partitionBy("run_id").orderBy("ord")) - 1
    out = frames.withColumn("_p", pos).filter(F.col("_p") % stride == 0)
    if max_frames > 0:
        out = out.filter(F.col("_p") < stride * max_frames)
    return out.drop("_p")


def verify_registration(points: DataFrame, clouds: DataFrame, runs: DataFrame, frames: DataFrame, pixels: DataFrame | None = None):
    """(per run verdicts, one overall row), from all frames of each run: cross-scan runs fail hard; nothing verifiable is ok."""
    actions = cut(resolve_render_run(clouds, runs))
    live = cut(frames.join(small(actions.filter("action != 'fail'").select("run_id")), "run_id", "left_semi"))
    vis = visible(points, live, keep=[*KEY, *("rgb" if pixels is not None else "")]).join(small(live.select("frame_id", "run_id")), "frame_id")
    if pixels is not None:
        vis = vis.join(many(pixels.select(*PIX, *[F.col(c).alias(f"p{c}") for c in "rgb"])), PIX, "left")
        diff = sum((F.abs(F.col(c) - F.col(f"p{c}")) for c in "rgb"), F.lit(0.0)) / 3.0
    else:
        diff = F.lit(None).cast("double")
    per = vis.groupBy("run_id", *KEY).agg(F.count("*").alias("t"), F.count_if(diff < 40).alias("a"))
    score = per.groupBy("run_id").agg(F.count("*").alias("n_seen"), F.sum("t").alias("t"), F.sum("a").alias("a"))
    total = points.count()
    has = pixels is not None
    graded = check_registration(
        live.select("run_id").distinct().join(score, "run_id", "left").select(
            "run_id", F.coalesce(F.col("n_seen") / max(total, 1), F.lit(0.0)).alias("coverage"),
            (F.when(F.col("t") > 0, F.col("a") / F.col("t")) if has else F.lit(None).cast("double")).alias("photometric"),
        )
    )
    verdict = actions.join(graded, "run_id", "left").withColumn(
        "ok", F.when(F.col("action") == "fail", False).otherwise(F.coalesce("ok", F.lit(True)))
    )
    overall = verdict.agg(
        (F.count("coverage") > 0).alias("checked"), F.coalesce(F.min("ok"), F.lit(True)).alias("ok"),
        F.count_if(F.col("action") == "fail").alias("hard_fails"),
    )
    return verdict, overall


def fuse_features(points: DataFrame, frames: DataFrame, cells: DataFrame) -> DataFrame:
    """(keys, feature, seen): bilinear samples of per-frame maps, averaged and unit length.

    ``cells`` = (frame_id, row, column, map_h, map_w, feature).  Centres follow
    the half-pixel convention and indices clamp at the border.
    """
    met = _Met(points, frames, MAX_DEPTH)
    schema = T.StructType([*_key_types(points), T.StructField("seen", T.LongType()), T.StructField("s", T.ArrayType(T.DoubleType()))])
    parts = met.made(_sampled, schema, KEY, cells.select("frame_id", "row", "column", "map_h", "map_w", F.col("feature").cast("array<double>").alias("feature")))
    rest = met.others(TOL_REL, TOL_ABS, SPLAT, [*PIX, *KEY, "width", "height"])
    if rest is not None:
        parts = parts.unionByName(_sampled_rows(cut(rest), cells))
    # A point has a row for each flock that sees it.
    parts = parts.filter(" AND ".join(f"{c} IS NOT NULL" for c in KEY))
    both = lambda a, b: F.zip_with(a, b, lambda x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(x + y))
    all_ = parts.groupBy(*KEY).agg(F.sum("seen").alias("seen"), F.collect_list("s").alias("s"))
    all_ = all_.withColumn("s", F.aggregate("s", F.array().cast("array<double>"), both)).filter(F.size("s") > 0)
    norm = F.greatest(F.sqrt(F.aggregate(F.transform("s", lambda e: e / F.col("seen")), F.lit(0.0), lambda a, e: a + e * e)), F.lit(1e-6))
    return all_.select(*KEY, F.transform("s", lambda e: e / F.col("seen") / norm).alias("feature"), F.col("seen").cast("int").alias("seen"))


def _corners(u, v, width, height, map_h, map_w):
    """(column, row, weight) of the four cells around each pixel's place on a map."""
    gx, gy = (np.clip((p + 0.5) / n * m - 0.5, 0.0, m - 1.0) for p, n, m in ((u, width, map_w), (v, height, map_h)))
    x0, y0 = np.floor(gx), np.floor(gy)
    fx, fy = gx - x0, gy - y0
    for dx, dy, w in ((0, 0, (1 - fx) * (1 - fy)), (1, 0, fx * (1 - fy)), (0, 1, (1 - fx) * fy), (1, 1, fx * fy)):
        yield np.minimum(x0 + dx, map_w - 1).astype(np.int64), np.minimum(y0 + dy, map_h - 1).astype(np.int64), w


def _sampled(flock: Flock):
    """(keys, seen, s): the sums of the samples of each point that a flock sees."""
    frame = np.array([{f: k for k, f in enumerate(flock.frames.to_pylist())}[f] for f in flock.beside["frame_id"].to_pylist()], np.int64)
    row, column, map_h, map_w = (flock.beside[c].to_numpy().astype(np.int64) for c in ("row", "column", "map_h", "map_w"))
    feature = flock.beside["feature"].combine_chunks()
    feature = feature.combine_chunks() if isinstance(feature, pa.ChunkedArray) else feature
    length = pc.fill_null(pc.list_value_length(feature), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    wide = int(length.max(initial=0))
    table = np.zeros((len(length), wide))
    table[np.arange(wide) < length[:, None]] = pc.fill_null(feature.flatten(), 0.0).to_numpy(zero_copy_only=False)
    mine = [np.flatnonzero(frame == k) for k in range(len(flock.frames))]
    n, step = len(flock.points), max(1, HELD // max(wide, 1))
    for first in range(0, n, step):
        last = min(first + step, n)
        seen, top, total = np.zeros(last - first, np.int64), np.zeros(last - first, np.int64), np.zeros((last - first, wide))
        for k, at in enumerate(mine):
            place, u, v, *_ = flock.visible(k, TOL_REL, TOL_ABS)
            here = (place >= first) & (place < last)
            place, u, v = place[here] - first, u[here], v[here]
            seen[place] += 1
            at = at[(row[at] >= 0) & (column[at] >= 0)]
            if not len(at) or not len(place):
                continue
            # Cells given more than once count as often.
            over = int(column[at].max()) + 1
            ids, which = np.unique(row[at] * over + column[at], return_inverse=True)
            sums, longest = np.zeros((len(ids), wide)), np.zeros(len(ids), np.int64)
            np.add.at(sums, which, table[at])
            np.maximum.at(longest, which, length[at])
            for h, w in sorted(set(zip(map_h[mine[k]].tolist(), map_w[mine[k]].tolist()))):
                for c, r, weight in _corners(u, v, *flock.image(k), h, w):
                    spot = np.minimum(np.searchsorted(ids, r * over + c), len(ids) - 1)
                    ok = np.flatnonzero((weight > 0) & (c < over) & (ids[spot] == r * over + c))
                    total[place[ok]] += weight[ok, None] * sums[spot[ok]]
                    top[place[ok]] = np.maximum(top[place[ok]], longest[spot[ok]])
        hit = np.flatnonzero(seen)
        ends = pa.array(np.r_[0, np.cumsum(top[hit])].astype(np.int32))
        lists = pa.ListArray.from_arrays(ends, pa.array(total[hit][np.arange(wide) < top[hit][:, None]]))
        yield flock.points.select(KEY).take(first + hit).append_column("seen", pa.array(seen[hit])).append_column("s", lists)


def _sampled_rows(vis: DataFrame, cells: DataFrame) -> DataFrame:
    """``_sampled`` of visible rows."""
    dims = small(cells.select("frame_id", "map_h", "map_w").distinct())
    at = vis.join(dims, "frame_id")
    gx = (F.col("u") + 0.5) / F.col("width") * F.col("map_w") - 0.5
    gy = (F.col("v") + 0.5) / F.col("height") * F.col("map_h") - 0.5
    gx = F.greatest(F.lit(0.0), F.least(gx, F.col("map_w") - F.lit(1.0)))
    gy = F.greatest(F.lit(0.0), F.least(gy, F.col("map_h") - F.lit(1.0)))
    at = at.withColumns({"gx": gx, "gy": gy}).withColumns({"x0": F.floor("gx"), "y0": F.floor("gy")})
    fx, fy = F.col("gx") - F.col("x0"), F.col("gy") - F.col("y0")
    corner = lambda dx, dy, w: F.struct(
        F.least(F.col("x0") + dx, F.col("map_w") - 1).cast("int").alias("column"),
        F.least(F.col("y0") + dy, F.col("map_h") - 1).cast("int").alias("row"), w.alias("w"),
    )
    four = F.array(
        corner(0, 0, (1 - fx) * (1 - fy)), corner(1, 0, fx * (1 - fy)), corner(0, 1, (1 - fx) * fy), corner(1, 1, fx * fy)
    )
    hit = at.select(*KEY, "frame_id", F.explode(four).alias("c")).select(*KEY, "frame_id", "c.*").filter("w > 0")
    got = hit.join(small(cells.select("frame_id", "row", "column", "feature")), ["frame_id", "row", "column"])
    flat = got.select(*KEY, "w", F.posexplode("feature").alias("i", "f"))
    total = flat.groupBy(*KEY, "i").agg(F.sum(F.col("w") * F.col("f")).alias("s"))
    vec = total.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda e: e["s"]).alias("s"))
    seen = vis.groupBy(*KEY).agg(F.count("*").alias("seen"))
    return seen.join(vec, KEY, "left")


def _best_scores(vis: DataFrame, masks: DataFrame) -> DataFrame:
    """(keys, frame_id, class_id, score): best mask score per pixel and class."""
    best = masks.groupBy(*PIX, "class_id").agg(F.max("score").alias("score"))
    return vis.select(*KEY, *PIX).join(many(best), PIX).select(*KEY, "frame_id", "class_id", "score")


def _rising(value):
    """The place of a value in Spark's order: nulls first, NaN last."""
    return (value is not None, value != value, 0 if value is None or value != value else value)


def _scored(met: _Met, masks: DataFrame, hits: Callable) -> DataFrame:
    """(keys, class_id, s, n, seen): what each class gets of a point by ``hits``; rows with ``seen`` tell how often it is visible.

    ``hits`` takes sums, counts, numbers of points and the painted scores of a view.
    """
    schema = T.StructType([*_key_types(met.points), masks.schema["class_id"], *[T.StructField(c, t) for c, t in (("s", T.DoubleType()), ("n", T.LongType()), ("seen", T.LongType()))]])

    def work(flock: Flock):
        images = flock.packs(["class_id", "score"])
        classes = list(dict.fromkeys(c for of_view in images.values() for c, _ in of_view))
        own, one, _ = _numbered(flock)
        step = max(1, HELD // max(len(classes), 1))
        for first in range(0, len(one), step):
            last = min(first + step, len(one))
            seen = np.zeros(last - first, np.int64)
            total, count, valid = np.zeros((len(classes), last - first)), np.zeros((len(classes), last - first), np.int64), np.zeros((len(classes), last - first), bool)
            for k in range(len(flock.frames)):
                place, u, v, *_ = flock.visible(k, TOL_REL, TOL_ABS)
                point = own[place] - first
                here = (point >= 0) & (point < last - first)
                point, pixel = point[here], (v * flock.image(k)[0] + u)[here]
                np.add.at(seen, point, 1)
                if k in images and len(point):
                    hits(total, count, valid, point, pixel, {c: i for i, c in enumerate(classes)}, {key: flock.painted(k, runs) for key, runs in images[k].items()})
            keys = flock.points.select(KEY).take(one[first:last])

            def rows(at, class_id, s, n, seen):
                got = keys.take(at)
                for name, values in (("class_id", class_id), ("s", s), ("n", n), ("seen", seen)):
                    got = got.append_column(name, values)
                return got

            hit = np.flatnonzero(seen)
            kind = flock.beside["class_id"].type
            yield rows(hit, pa.nulls(len(hit), kind), pa.nulls(len(hit), pa.float64()), pa.nulls(len(hit), pa.int64()), pa.array(seen[hit]))
            for i, c in enumerate(classes):
                at = np.flatnonzero(count[i])
                yield rows(at, pa.array([c] * len(at), kind), pa.array(total[i][at], mask=~valid[i][at]), pa.array(count[i][at]), pa.nulls(len(at), pa.int64()))

    return met.made(work, schema, KEY, packed(masks, ["class_id", "score"]))


def _add_scores(total, count, valid, point, pixel, classes, images) -> None:
    """Adds the best score of each class at a point's pixel."""
    for c, i in classes.items():
        mine = sorted((key for key in images if key[0] == c), key=lambda key: _rising(key[1]))
        if not mine:
            continue
        best = np.full(len(images[mine[0]]), -1)
        for n, key in enumerate(mine):
            best[images[key]] = n
        rank = best[pixel]
        score = np.array([0.0 if key[1] is None else key[1] for key in mine])
        sure = np.array([key[1] is not None for key in mine])
        at, rank = point[rank >= 0], rank[rank >= 0]
        np.add.at(total[i], at, score[rank])
        np.add.at(count[i], at, 1)
        valid[i][at[sure[rank]]] = True


def _over(images, thresh: float) -> dict:
    """Painted scores above a threshold."""
    return {key: image for key, image in images.items() if key[1] is not None and not key[1] <= thresh}


def class_votes(points: DataFrame, frames: DataFrame, masks: DataFrame, merges: dict[int, int] | None = None) -> DataFrame:
    """(keys, class_id, seen): highest summed score; background 0 holds 0.05; unseen is -1."""
    met = _Met(points, frames, MAX_DEPTH)
    parts, rest = _scored(met, masks, _add_scores), met.others(TOL_REL, TOL_ABS, SPLAT, [*PIX, *KEY])
    if rest is not None:
        rest = cut(rest)
        best = _best_scores(rest, masks).groupBy(*KEY, "class_id").agg(F.sum("score").alias("s"))
        parts = parts.unionByName(best, True).unionByName(rest.groupBy(*KEY).agg(F.count("*").alias("seen")), True)
    parts = cut(parts)
    cls = F.col("class_id")
    for a, b in (merges or {}).items():
        cls = F.when(cls == a, b).otherwise(cls)
    votes = parts.filter("seen IS NULL").withColumn("class_id", cls).groupBy(*KEY, "class_id").agg(F.sum("s").alias("s"))
    top = votes.filter(F.col("class_id") != 0).groupBy(*KEY).agg(F.max_by(F.struct("class_id", "s"), F.struct("s", (-F.col("class_id")).alias("o"))).alias("t"))
    seen = parts.filter("seen IS NOT NULL").groupBy(*KEY).agg(F.sum("seen").alias("seen"))
    won = F.when(F.col("t.s") > BACKGROUND, F.col("t.class_id")).otherwise(F.lit(0))
    return points.select(*KEY).join(seen, KEY, "left").join(top, KEY, "left").select(
        *KEY, F.when(F.col("seen").isNull(), UNSET).otherwise(won).cast("int").alias("class_id"), F.coalesce("seen", F.lit(0)).alias("seen")
    )


def query_hits(points: DataFrame, frames: DataFrame, masks: DataFrame, assign: str = "argmax", thresh: float = 0.3):
    """(per point and query hits, one summary row per query); ``class_id`` names the query."""
    def union(total, count, valid, point, pixel, classes, images):
        _add_scores(total, count, valid, point, pixel, classes, _over(images, thresh))

    def argmax(total, count, valid, point, pixel, classes, images):
        images = _over(images, thresh)
        order = sorted(images, key=lambda key: (_rising(key[1]), key[0] is not None, 0 if key[0] is None else -key[0]))
        best = np.full(max((len(image) for image in images.values()), default=0), -1)
        for n, key in enumerate(order):
            best[images[key]] = n
        if not order:
            return
        # Rows of one key in a view are one hit.
        rank = best[pixel]
        at, rank = point[rank >= 0], rank[rank >= 0]
        by = np.lexsort((rank, at))
        at, rank = at[by], rank[by]
        last = np.r_[at[1:] != at[:-1], True][:len(at)]
        np.add.at(count, (np.array([classes[key[0]] for key in order])[rank[last]], at[last]), 1)

    met = _Met(points, frames, MAX_DEPTH)
    parts, rest = _scored(met, masks, argmax if assign == "argmax" else union), met.others(TOL_REL, TOL_ABS, SPLAT, [*PIX, *KEY])
    if rest is not None:
        rest = cut(rest)
        rows = _best_scores(rest, masks).filter(F.col("score") > thresh)
        if assign == "argmax":
            rows = rows.groupBy(*KEY, "frame_id").agg(F.max_by("class_id", F.struct("score", (-F.col("class_id")).alias("o"))).alias("class_id"))
        parts = parts.unionByName(rows.groupBy(*KEY, "class_id").agg(F.count("*").alias("n")), True).unionByName(rest.groupBy(*KEY).agg(F.count("*").alias("seen")), True)
    parts = cut(parts)
    hits = parts.filter("seen IS NULL").groupBy(*KEY, F.col("class_id").alias("query")).agg(F.sum("n").alias("hits"))
    seen = parts.filter("seen IS NOT NULL").select(*KEY).distinct().agg(F.count("*").alias("n_seen"))
    n = points.agg(F.count("*").alias("n"))
    cover = seen.join(n, how="cross").select(F.round(100.0 * F.col("n_seen") / F.greatest("n", F.lit(1)), 2).alias("coverage_pct"))
    summary = hits.groupBy("query").agg(F.count("*").alias("n_hit")).join(cover, how="cross")
    return hits, summary


def first_come(hit: DataFrame, min_points: int) -> DataFrame:
    """(keys, frame_id, mask_id): the owners that masks get when each in turn takes its free points, if ``min_points`` are.

    ``hit`` = (keys, frame_id, mask_id, rank, score).  Masks are decided many at a time.  The points on which all earlier
    masks failed are surely free: enough of them, and the mask stands.  The points that no standing mask comes before may
    yet be free: too few of them, and it fails.  The earliest open mask always gets decided.  A point leaves as soon as
    its first mask that has not failed stands, so that later rounds read open points only.  A mask counts with its
    highest score; with ``min_points`` below one every mask stands.
    """
    mask = ["frame_id", "mask_id"]
    best = cut(hit.groupBy(*mask).agg(F.max("score").alias("score")))
    live = hit.select(*KEY, *mask, "rank").distinct().join(small(best), mask).withColumn("stands", F.lit(False))
    ahead = Window.partitionBy(*KEY).orderBy("rank", F.desc("score"), F.desc("mask_id"), "frame_id").rowsBetween(Window.unboundedPreceding, -1)
    owned = []
    while True:
        seen = live.withColumn("before", F.coalesce(F.max("stands").over(ahead), F.lit(False))).withColumn("first", F.count(F.lit(1)).over(ahead) == 0)
        seen = cut(seen.filter(~F.col("before")).drop("before"))
        # A point is settled once its first mask left stands; no other row of it is left then.
        owned.append(seen.filter(F.col("first") & F.col("stands")).select(*KEY, *mask))
        live = seen.filter(~(F.col("first") & F.col("stands")))
        votes = cut(live.filter(~F.col("stands")).groupBy(*mask).agg(F.count_if("first").alias("sure"), F.count("*").alias("may")))
        if is_empty(votes):
            break
        now = votes.select(*mask, (F.col("sure") >= min_points).alias("wins"), (F.col("may") < min_points).alias("fails"))
        live = live.join(small(now), mask, "left").filter(~F.coalesce("fails", F.lit(False)))
        live = live.withColumn("stands", F.col("stands") | F.coalesce("wins", F.lit(False))).drop("wins", "fails", "first")
    return reduce(DataFrame.unionByName, owned)


def _hits(flock: Flock, own: np.ndarray):
    """(view, {(mask_id, score, rank): numbers of the keys that the mask hits}) of each view with masks."""
    images = flock.packs(["mask_id", "score", "rank"])
    for k in sorted(images):
        place, u, v, *_ = flock.visible(k, TOL_REL, TOL_ABS)
        pixel = v * flock.image(k)[0] + u
        yield k, {key: np.unique(own[place[flock.painted(k, runs)[pixel]]]) for key, runs in images[k].items()}


def _of_masks(flock: Flock, points: pa.Table, k: np.ndarray, masks: list[tuple], which: np.ndarray) -> pa.Table:
    """Rows of points beside the view and mask that each belongs to."""
    out = points.append_column("frame_id", flock.frames.take(pa.array(k)))
    for n, name in enumerate(("mask_id", "score", "rank")):
        out = out.append_column(name, pa.array([mask[n] for mask in masks], flock.beside[name].type).take(pa.array(which)))
    return out.select([*KEY, "frame_id", "mask_id", "score", "rank"])


def _hit_rows(flock: Flock):
    own, one, _ = _numbered(flock)
    for k, of_view in _hits(flock, own):
        for mask, at in of_view.items():
            if len(at):
                yield _of_masks(flock, flock.points.select(KEY).take(one[at]), np.full(len(at), k), [mask], np.zeros(len(at), np.int64))


def _latest(flock: Flock, min_points: int):
    """The last mask of enough points on each point, by rank, score and number, and rows of all masks that hit."""
    own, one, _ = _numbered(flock)
    masks = [(k, key) for k, of_view in flock.packs(["mask_id", "score", "rank"]).items() for key in of_view]
    masks.sort(key=lambda m: (_rising(m[1][2]), _rising(m[1][1]), _rising(m[1][0])))
    place = {m: n for n, m in enumerate(masks)}
    best, info = np.full(len(one), -1), []
    for k, of_view in _hits(flock, own):
        for mask_id in {key[0] for key in of_view}:
            mine = [(key, at) for key, at in of_view.items() if key[0] == mask_id and len(at)]
            if mine:
                score = min((key[1] for key, _ in mine), key=lambda s: (s is None, s is not None and s != s, s if s is not None and s == s else 0))
                info.append((k, (mask_id, score, mine[0][0][2])))
            if sum(len(at) for _, at in mine) >= min_points:
                for key, at in mine:
                    best[at] = np.maximum(best[at], place[k, key])
    at = np.flatnonzero(best >= 0)
    view = np.array([k for k, _ in masks], np.int64)
    got = _of_masks(flock, flock.points.select(KEY).take(one[at]), view[best[at]] if len(at) else np.zeros(0, np.int64), [key for _, key in masks], best[at])
    yield got.append_column("info", pa.nulls(len(got), pa.bool_()))
    empty = pa.table({c: pa.nulls(len(info), flock.points[c].type) for c in KEY})
    got = _of_masks(flock, empty, np.array([k for k, _ in info], np.int64), [key for _, key in info], np.arange(len(info)))
    yield got.append_column("info", pa.array([True] * len(info), pa.bool_()))


def masks_to_segments(points: DataFrame, frames: DataFrame, masks: DataFrame, min_points: int = 20, conflict: str = "latest"):
    """(keys, segment_id) and (segment_id, mask_id, n_points): one mask, one segment.

    ``frames`` carries ``rank`` (run time, frame order); ``masks`` = (frame_id, u,
    v, mask_id, score).  ``latest``: later and higher scores overwrite.  ``first``:
    in the order of ``rank``, then falling score and mask_id, a mask takes the points still free if they are enough.
    """
    met = _Met(points, frames, MAX_DEPTH)
    ranked = frames.select("frame_id", "rank")
    types = {f.name: f.dataType for f in [*frames.select("frame_id", "rank").schema, *masks.select("mask_id", "score").schema]}
    schema = T.StructType([*_key_types(points), *[T.StructField(c, types[c]) for c in ("frame_id", "mask_id", "score", "rank")]])
    beside = packed(masks.select(*PIX, "mask_id", "score"), ["mask_id", "score"]).join(small(ranked), "frame_id")
    rest = met.others(TOL_REL, TOL_ABS, SPLAT, [*PIX, *KEY])
    if rest is not None:
        rest = cut(rest.join(many(masks), PIX).select(*KEY, "frame_id", "mask_id", "score").distinct().join(small(ranked), "frame_id"))
    if conflict == "latest":
        # The views of a mask are in one flock, which can count its points; rows of owners have keys, rows of masks have ``info``.
        both = T.StructType([*schema, T.StructField("info", T.BooleanType())])
        parts = met.made(lambda flock: _latest(flock, min_points), both, KEY, beside)
        if rest is not None:
            big = rest.groupBy("frame_id", "mask_id").count().filter(F.col("count") >= min_points).select("frame_id", "mask_id")
            parts = parts.unionByName(rest.join(small(big), ["frame_id", "mask_id"], "left_semi"), True)
            parts = parts.unionByName(rest.groupBy("frame_id", "mask_id").agg(F.min("rank").alias("rank"), F.min("score").alias("score")).withColumn("info", F.lit(True)), True)
        parts = cut(parts)
        won = parts.filter("info IS NULL").groupBy(*KEY).agg(F.max_by(F.struct("frame_id", "mask_id"), F.struct("rank", "score", "mask_id")).alias("w"))
        owner, about = won.select(*KEY, "w.*"), parts.filter("info").select("frame_id", "mask_id", "rank", "score")
    else:
        hit = met.made(_hit_rows, schema, KEY, beside)
        hit = cut(hit if rest is None else hit.unionByName(rest))
        owner, about = first_come(hit, min_points), hit.groupBy("frame_id", "mask_id").agg(F.min("rank").alias("rank"), F.min("score").alias("score"))
    sizes = owner.groupBy("frame_id", "mask_id").agg(F.count("*").alias("n_points"), F.lit(0).alias("_z"))
    info = sizes.join(small(about), ["frame_id", "mask_id"])
    # Numbered within a rank, after the masks of all lower ranks: only one row per rank is counted in one task.
    ahead = info.groupBy("rank").count().select("rank", (F.sum("count").over(Window.orderBy("rank")) - F.col("count")).alias("_ahead"))
    place = F.row_number().over(Window.partitionBy("rank").orderBy("score", "mask_id", "frame_id")) - 1 + F.col("_ahead")
    seg = cut(info.join(small(ahead), "rank").withColumn("segment_id", place.cast("int")))
    return owner.join(small(seg), ["frame_id", "mask_id"]).select(*KEY, "segment_id"), seg.select("segment_id", "frame_id", "mask_id", "n_points")


def auto_instances(points: DataFrame, frames: DataFrame, masks: DataFrame, min_area_frac: float = 0.001, gap: float = 0.05) -> DataFrame:
    """(keys, mask_id): in frame and mask order, a mask takes a point only when nearer by ``gap``.

    The order matters only inside one point, whose list is bounded by the masks
    that see it; the fold is one array expression.
    """
    area = masks.groupBy("frame_id", "mask_id").count()
    size = frames.select("frame_id", "rank", F.floor(F.lit(min_area_frac) * F.col("width") * F.col("height")).alias("need"))
    big = area.join(small(size), "frame_id").filter(F.col("count") >= F.col("need")).select("frame_id", "mask_id", "rank")
    met = _Met(points, frames, MAX_DEPTH)
    rest = met.others(TOL_REL, TOL_ABS, SPLAT, [*PIX, *KEY, "depth"])
    # A key that one row has, which one flock sees, is decided there; of others the masks that can still count are told.
    often = cut(points.groupBy(*KEY).agg(F.count("*").alias("n")).filter("n > 1").select(*KEY, F.lit(True).alias("often")))
    alone = (F.col("_in") == 1) & F.col("often").isNull() & F.lit(rest is None and gap >= 0)
    for c in KEY:
        alone = alone & F.col(c).isNotNull()
    met.points = met.points.join(small(often), KEY, "left").withColumn("alone", alone)
    types = {f.name: f.dataType for f in [*big.select("rank", "mask_id").schema]}
    schema = T.StructType([*_key_types(points), *[T.StructField(c, types[c]) for c in ("rank", "mask_id")], T.StructField("depth", T.DoubleType()), T.StructField("m", T.IntegerType())])
    beside = packed(masks.select(*PIX, "mask_id"), ["mask_id"]).join(small(big), ["frame_id", "mask_id"]).select("frame_id", "mask_id", "rank", "_pack")
    parts = met.made(lambda flock: _nearer(flock, gap), schema, [*KEY, "alone"], beside)
    if rest is not None:
        hit = rest.join(many(masks.select(*PIX, "mask_id")), PIX).join(small(big), ["frame_id", "mask_id"])
        parts = parts.unionByName(hit.select(*KEY, "rank", "mask_id", "depth"), True)
    order = F.array_sort(F.collect_list(F.when(F.col("m").isNull(), F.struct("rank", "mask_id", "depth"))))
    start = F.struct(F.lit(UNSET).cast("int").alias("m"), F.lit(float("inf")).alias("d"))
    fold = F.aggregate(
        "seq", start,
        lambda a, e: F.when(e["depth"] < a["d"] - gap, F.struct(e["mask_id"].cast("int").alias("m"), e["depth"].alias("d"))).otherwise(a),
    )
    return parts.groupBy(*KEY).agg(order.alias("seq"), F.max("m").alias("m")).select(*KEY, F.coalesce("m", fold["m"]).alias("mask_id"))


def _nearer(flock: Flock, gap: float):
    """For keys that are ``alone`` the mask (m) that the fold ends with; for others the (rank, mask_id, depth) that may count.

    After a mask the depth kept is at most its own by ``gap``, so a later one that is no nearer is never taken.
    """
    own, one, many_rows = _numbered(flock)
    images = flock.packs(["mask_id", "rank"])
    steps: dict[tuple, list[int]] = {}
    for k, of_view in images.items():
        for mask_id, rank in of_view:
            steps.setdefault((rank, mask_id), []).append(k)
    alone = flock.points["alone"].to_numpy(zero_copy_only=False).astype(bool)[one] if not many_rows else np.zeros(len(one), bool)
    kept, mask, least, hit = np.full(len(one), np.inf), np.full(len(one), UNSET), np.full(len(one), np.inf), np.zeros(len(one), bool)
    keys, held, looked = flock.points.select(KEY), [], (None, None)

    def told() -> pa.Table:
        at, rank, mask_id, depth = zip(*held)
        sizes = [len(a) for a in at]
        out = keys.take(one[np.concatenate(at)])
        for name, values in (("rank", rank), ("mask_id", mask_id)):
            out = out.append_column(name, pa.array(list(values), flock.beside[name].type).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))))
        return out.append_column("depth", pa.array(np.concatenate(depth))).append_column("m", pa.nulls(len(out), pa.int32()))

    for rank, mask_id in sorted(steps, key=lambda s: (_rising(s[0]), _rising(s[1]))):
        found = []
        for k in steps[rank, mask_id]:
            if looked[0] != k:
                looked = (k, flock.visible(k, TOL_REL, TOL_ABS))
            place, u, v, _, _, depth = looked[1]
            on = flock.painted(k, images[k][mask_id, rank])[v * flock.image(k)[0] + u]
            found.append((own[place[on]], depth[on]))
        at, depth = (np.concatenate(c) for c in zip(*found))
        if gap < 0:
            held.append((at, rank, mask_id, depth))
        else:
            if len(found) > 1 or many_rows:
                by = np.lexsort((depth, at))
                by = by[np.r_[True, at[by][1:] != at[by][:-1]]] if len(by) else by
                at, depth = at[by], depth[by]
            hit[at] = True
            take = depth < kept[at] - gap
            kept[at[take]], mask[at[take]] = depth[take], int(mask_id) if mask_id is not None else UNSET
            tell = (depth < least[at]) & ~alone[at]
            least[at] = np.minimum(least[at], depth)
            if tell.any():
                held.append((at[tell], rank, mask_id, depth[tell]))
        if sum(len(a) for a, *_ in held) > 1_000_000:
            yield told()
            held = []
    if held:
        yield told()
    at = np.flatnonzero(alone & hit)
    out = keys.take(one[at])
    for name in ("rank", "mask_id"):
        out = out.append_column(name, pa.nulls(len(at), flock.beside[name].type))
    yield out.append_column("depth", pa.nulls(len(at), pa.float64())).append_column("m", pa.array(mask[at].astype(np.int32)))


def project_masks(points: DataFrame, frames: DataFrame, mask: DataFrame, depth: DataFrame, accepted: DataFrame, n_masks: int, fingerprint: str, expected: str) -> DataFrame:
    """(keys, mask_id) of accepted masks; a wrong fingerprint or mask id is an error."""
    if fingerprint != expected:
        raise ValueError("capture belongs to another cloud")
    bad = accepted.filter(~F.col("mask_id").between(0, n_masks - 1))
    if not is_empty(bad):
        raise ValueError("mask id out of range")
    wanted = mask.join(small(accepted.select("mask_id").distinct()), "mask_id", "left_semi")
    return points_in_mask(points, frames, wanted.select(*PIX, "mask_id"), depth).select(*KEY, "mask_id").distinct()
