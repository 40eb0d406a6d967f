"""Triangle tables: area-weighted surface sampling and face selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, small


def face_areas(triangles: DataFrame) -> DataFrame:
    """``triangles`` = (face_id, ax..cz, ...); adds area."""
    e = {f"{p}{a}": F.col(f"{q}{a}") - F.col(f"a{a}") for p, q in (("u", "b"), ("v", "c")) for a in "xyz"}
    nx = e["uy"] * e["vz"] - e["uz"] * e["vy"]
    ny = e["uz"] * e["vx"] - e["ux"] * e["vz"]
    nz = e["ux"] * e["vy"] - e["uy"] * e["vx"]
    return triangles.withColumn("area", 0.5 * F.sqrt(nx * nx + ny * ny + nz * nz))


def mesh_sample(triangles: DataFrame, n: int, seed: int = 0, texels: DataFrame | None = None, texture_size=(0, 0)) -> DataFrame:
    """(scan_id, point_id, x, y, z, r, g, b, face_id): n area-weighted surface points.

    A face gets the whole steps its area covers on the running total of areas,
    so counts add up to n exactly.  Running totals come from per-slice sums plus
    a window inside each slice.  Colour: texture, else vertex mean, else face,
    else grey.
    """
    slices = 64
    faces = face_areas(triangles).withColumn("_s", F.pmod(F.xxhash64("face_id"), F.lit(slices * 64)))
    faces = cut(faces)
    sums = faces.groupBy("_s").agg(F.sum("area").alias("_a"))
    total = sums.agg(F.sum("_a")).first()[0]
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_s", F.coalesce(F.sum("_a").over(before), F.lit(0.0)).alias("_base"))
    inner = Window.partitionBy("_s").orderBy("face_id").rowsBetween(Window.unboundedPreceding, 0)
    run = faces.join(small(base), "_s").withColumn("_hi", F.col("_base") + F.sum("area").over(inner))
    # The last face of one slice and the first of the next must share one bound.
    nxt = F.lead("_hi").over(Window.partitionBy("_s").orderBy("face_id"))
    low = F.coalesce(F.lag("_hi").over(Window.partitionBy("_s").orderBy("face_id")), F.col("_base"))
    ends = base.select((F.col("_s")).alias("_s"), F.lead("_base").over(Window.orderBy("_s")).alias("_end"))
    run = run.withColumns({"_lo": low, "_last": nxt.isNull()}).join(small(ends), "_s")
    high = F.when(F.col("_last"), F.coalesce("_end", F.lit(total))).otherwise(F.col("_hi"))
    step = lambda c: F.floor(c / total * n).cast("bigint")
    first, stop = step(F.col("_lo")), F.when(F.col("_last") & F.col("_end").isNull(), F.lit(n)).otherwise(step(high))
    pts = run.withColumns({"_f": first, "_t": stop}).filter("_t > _f").withColumn("point_id", F.explode(F.sequence(F.col("_f"), F.col("_t") - 1)))
    unit = lambda salt: F.pmod(F.xxhash64("point_id", F.lit(seed + salt)), F.lit(1 << 30)) / float(1 << 30)
    s, t = F.sqrt(unit(1)), unit(2)
    w = {"a": 1 - s, "b": s * (1 - t), "c": s * t}
    mix = lambda f: sum((w[v] * F.col(f"{v}{f}") for v in "abc"), F.lit(0.0))
    out = pts.select("scan_id", "point_id", "face_id", *[mix(a).alias(a) for a in "xyz"], *[c for c in triangles.columns if c not in ("scan_id", "face_id")],
                     *([mix("u").alias("tu"), mix("v").alias("tv")] if "au" in triangles.columns else []))
    color = {c: [] for c in "rgb"}
    if texels is not None:
        wide, tall = texture_size
        clip = lambda v, top: F.greatest(F.lit(0), F.least(F.floor(v).cast("int"), F.lit(top - 1)))
        out = out.withColumns({"px": clip(F.col("tu") * wide, wide), "py": clip((1 - F.col("tv")) * tall, tall)})
        out = out.join(texels.select("px", "py", *[F.col(c).alias(f"t{c}") for c in "rgb"]), ["px", "py"], "left")
        color = {c: [F.col(f"t{c}")] for c in "rgb"}
    if "ar" in triangles.columns:
        for c in "rgb":
            color[c].append(((F.col(f"a{c}") + F.col(f"b{c}") + F.col(f"c{c}")) / 3).cast("int"))
    if "face_r" in triangles.columns:
        for c in "rgb":
            color[c].append(F.col(f"face_{c}"))
    return out.select("scan_id", "point_id", "x", "y", "z", *[F.coalesce(*color[c], F.lit(128)).cast("int").alias(c) for c in "rgb"], "face_id")


def faces_in_selection_bbox(triangles: DataFrame, selected: DataFrame, padding: float = 0.0) -> DataFrame:
    """Faces whose centroid lies in the padded bounds of the selected points; none is an error."""
    box = selected.agg(*[f(a).alias(f"{p}{a}") for p, f in (("l", F.min), ("h", F.max)) for a in "xyz"])
    ok = F.lit(True)
    for a in "xyz":
        mid = (F.col(f"a{a}") + F.col(f"b{a}") + F.col(f"c{a}")) / 3.0
        ok = ok & mid.between(F.col(f"l{a}") - padding, F.col(f"h{a}") + padding)
    out = triangles.join(F.broadcast(box), how="cross").filter(ok).select("face_id")
    if out.isEmpty():
        raise ValueError("no face inside the selection")
    return out
