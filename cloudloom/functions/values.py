"""Colour, naming, parsing and fingerprint columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.quantiles import exact_quantiles
from ..schema import CATEGORIES, UNSET
from ..session import small
from .frames import col

# Fallback class palette, fixed colours.
FALLBACK_PALETTE = [
    "#5b8def", "#10b981", "#f5a524", "#a855f7", "#ef4444", "#06b6d4", "#facc15", "#84cc16",
    "#f472b6", "#22d3ee", "#f97316", "#8b5cf6", "#e11d48", "#d946ef", "#9ca3af",
]
NEGATIVE_GREY = "#7c8088"
MISSING_GREY = 0.55
UNASSIGNED_GREY = 60

# Label keywords in priority order and their class names.
LABEL_KEYWORDS = [
    (["pipe"], "pipe"),
    (["tank", "vessel", "drum", "silo"], "tank"),
    (["flat_surface", "wall", "floor", "ceiling", "beam", "structural", "plane"], "structural"),
    (["fitting", "elbow", "joint", "flange"], "fitting"),
    (["equipment", "pump", "valve", "motor", "instrument"], "equipment"),
]
UNKNOWN_NAMES = ["unknown", "other", "uncategorized", "unlabeled"]


def _per_scan_max(points: DataFrame, value: Column, name: str) -> DataFrame:
    top = points.groupBy("scan_id").agg(F.max(value).alias(name))
    return points.join(small(top), "scan_id")


def rgb16_to_8(points: DataFrame) -> DataFrame:
    """High byte of 16-bit colours where the scan's maximum exceeds 255."""
    out = _per_scan_max(points, F.greatest("r", "g", "b"), "top")
    wide = F.col("top") > 255
    return out.withColumns(
        {c: F.when(wide, F.shiftright(F.col(c).cast("int"), 8)).otherwise(F.col(c).cast("int")) for c in "rgb"}
    ).drop("top")


def color_normalize(channel) -> Column:
    return F.coalesce(col(channel) / 255.0, F.lit(MISSING_GREY))


def intensity_normalize(points: DataFrame) -> DataFrame:
    out = _per_scan_max(points, F.col("intensity"), "top")
    scaled = F.when(F.col("top") > 0, F.col("intensity") / F.col("top")).otherwise(F.col("intensity"))
    return out.withColumn("intensity", scaled).drop("top")


def class_palette(registry: DataFrame, class_map: DataFrame) -> DataFrame:
    """(id, label, color) over the union of both name tables; the registry wins."""
    both = registry.select("id", F.col("label").alias("a")).join(
        class_map.groupBy("id").agg(F.min("label").alias("b")), "id", "full"
    )
    colors = F.array(*[F.lit(c) for c in FALLBACK_PALETTE])
    pick = F.element_at(colors, (F.pmod("id", F.lit(len(FALLBACK_PALETTE))) + 1).cast("int"))
    return both.select(
        "id", F.coalesce("a", "b").alias("label"),
        F.when(F.col("id") >= 0, pick).otherwise(NEGATIVE_GREY).alias("color"),
    )


def _hue_rgb(h: Column, s: Column, v: Column) -> list[Column]:
    out = []
    for n in (5.0, 3.0, 1.0):
        k = F.pmod(F.lit(n) + h * 6.0, F.lit(6.0))
        out.append(F.floor(255.0 * (v - v * s * F.greatest(F.lit(0.0), F.least(k, 4.0 - k, F.lit(1.0))))).cast("int"))
    return out


def instance_color(instance_id, seed: int = 0) -> dict[str, Column]:
    """Hash-derived HSV colour; negative ids are grey 60."""
    i = col(instance_id)
    unit = lambda salt: F.pmod(F.xxhash64(i, F.lit(seed + salt)), F.lit(10007)) / 10007.0
    rgb = _hue_rgb(unit(1), 0.5 + 0.5 * unit(2), 0.6 + 0.4 * unit(3))
    return {c: F.when(i < 0, UNASSIGNED_GREY).otherwise(v) for c, v in zip("rgb", rgb)}


def label_to_class(df: DataFrame, label: str, classes: DataFrame, unknown_fallback: bool = True) -> DataFrame:
    """Adds class_id: exact name, then keyword, then an unknown-style class, then -1."""
    key = F.lower(F.trim(F.col(label)))
    target = F.lit(None).cast("string")
    for words, name in reversed(LABEL_KEYWORDS):
        has = F.lit(False)
        for w in words:
            has = has | key.contains(w)
        target = F.when(has, F.lit(name)).otherwise(target)
    names = classes.groupBy(F.lower("name").alias("name")).agg(F.min("id").alias("id"))
    names = small(names)
    exact = names.select(F.col("name").alias("_key"), F.col("id").alias("_exact"))
    word = names.select(F.col("name").alias("_word"), F.col("id").alias("_hit"))
    out = df.withColumns({"_key": F.when(key != "", key), "_word": F.when(key != "", target)})
    out = out.join(exact, "_key", "left").join(word, "_word", "left")
    best = [F.col("_exact"), F.col("_hit")]
    if unknown_fallback:
        other = classes.filter(F.lower("name").isin(UNKNOWN_NAMES)).agg(F.min_by("id", "id").alias("_other"))
        out = out.join(F.broadcast(other), how="cross")
        best.append(F.col("_other"))
    return out.withColumn("class_id", F.coalesce(*best, F.lit(UNSET)).cast("int")).drop(
        "_key", "_word", "_exact", "_hit", "_other"
    )


def parse_category(value) -> Column:
    """Category code from a name or number; anything else is an error."""
    v = col(value).cast("string")
    out = F.raise_error(F.concat(F.lit("unknown category: "), F.coalesce(v, F.lit("null")))).cast("int")
    for name, code in CATEGORIES.items():
        out = F.when((v == name) | (v == str(code)), F.lit(code)).otherwise(out)
    return out


def coerce_class(df: DataFrame, value: str, classes: DataFrame) -> DataFrame:
    """Adds class_id from an id or a class name; an unknown name is an error."""
    v = F.trim(F.col(value).cast("string"))
    number = v.try_cast("int")
    names = small(classes.groupBy(F.lower("name").alias("_name")).agg(F.min("id").alias("_id")))
    out = df.withColumn("_name", F.lower(v)).join(names, "_name", "left")
    bad = F.raise_error(F.concat(F.lit("unknown class: "), F.coalesce(v, F.lit("null")))).cast("int")
    return out.withColumn("class_id", F.coalesce(number, F.col("_id").cast("int"), bad)).drop("_name", "_id")


def slug_id(text) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(text))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def naming_ok(name) -> Column:
    """<scene>_<vendor>[_<density>] in lower case; a warning, never an error."""
    return col(name).rlike("^[a-z0-9]+(-[a-z0-9]+)*_[a-z0-9-]+(_[a-z0-9-]+)?$")


def utc_stamp(ts=None, pattern: str = "yyyy-MM-dd'T'HH:mm:ss'Z'") -> Column:
    """UTC text stamp (the session time zone is UTC); version dirs use yyyyMMdd_HHmmss."""
    return F.date_format(F.current_timestamp() if ts is None else col(ts), pattern)


def table_fingerprint(df: DataFrame, columns: list[str], chunk: int = 100_000) -> DataFrame:
    """One row per scan: sha256 over ordered chunk digests, for a given row order key.

    A chunk holds the rows of one run of point ids, at most ``chunk`` of them,
    so no group grows with the scan; the second level hashes digests only.
    Digests move as 32 bytes, which sort as their hexadecimal digits do; a text that is no longer moves as it is.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    short = F.octet_length(text) <= 32
    rows = df.select("scan_id", F.floor(F.col("point_id") / chunk).alias("part"), F.struct("point_id", F.when(short, text).alias("t"), F.when(~short, F.unhex(F.sha2(text, 256))).alias("h")).alias("row"))
    hashed = lambda s: F.struct(s["point_id"], F.coalesce(F.unhex(F.sha2(s["t"], 256)), s["h"]).alias("h"))
    joined = lambda sorted_rows: F.sha2(F.concat_ws("", F.transform(sorted_rows, lambda s: F.lower(F.hex(s["h"])))), 256)
    digest = lambda c: joined(F.array_sort(F.collect_list(c)))
    parts = rows.groupBy("scan_id", "part").agg(F.unhex(joined(F.array_sort(F.transform(F.collect_list("row"), hashed)))).alias("h"))
    for level in range(1, 4):
        wide = parts.select("scan_id", F.floor(F.col("part") / chunk).alias("up"), F.struct("part", "h").alias("row"))
        parts = wide.groupBy("scan_id", F.col("up").alias("part")).agg(F.unhex(digest("row")).alias("h"))
    return parts.groupBy("scan_id").agg(digest(F.struct("part", "h")).alias("fingerprint"))


def cache_key(*parts) -> Column:
    """First 16 hex digits of the sha256 of the joined parts."""
    return F.substring(F.sha2(F.concat_ws(",", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]), 256), 1, 16)


def query_intensity(values: DataFrame, value: str, pct: float = 95.0) -> DataFrame:
    """Adds norm: value / percentile of the positive values, clipped to [0, 1]."""
    cap = exact_quantiles(values.filter(F.col(value) > 0), ["query"], value, [pct / 100.0])
    cap = cap.select(F.col("query").alias("_query"), F.col("quantile").alias("cap"))
    out = values.join(small(cap), F.col("query").eqNullSafe(F.col("_query")), "left").drop("_query")
    ratio = F.when(F.col("cap") > 0, F.col(value) / F.col("cap")).otherwise(F.lit(0.0))
    return out.withColumn("norm", F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio))).drop("cap")


def overlay_colour(hits: DataFrame, palette: DataFrame, conflict: str = "argmax", floor: float = 0.25) -> DataFrame:
    """(scan_id, point_id, r, g, b) from per-query norm values of hit points.

    ``argmax`` shows the query with most hits (lower query id on ties); ``blend``
    mixes the palette by norm.  Brightness never falls below ``floor``.
    """
    hit = hits.filter(F.col("value") > 0).join(small(palette), "query")
    keys = ["scan_id", "point_id"]
    if conflict == "blend":
        total = F.greatest(F.sum("norm"), F.lit(1e-6))
        bright = floor + (1 - floor) * F.max("norm")
        return hit.groupBy(*keys).agg(
            *[F.floor(F.sum(F.col("norm") * F.col(c)) / total * bright).cast("int").alias(c) for c in "rgb"]
        )
    win = hit.groupBy(*keys).agg(
        F.max_by(F.struct("norm", "r", "g", "b"), F.struct("value", (-F.col("query")).alias("q"))).alias("w")
    )
    bright = floor + (1 - floor) * F.col("w.norm")
    return win.select(*keys, *[F.floor(F.col(f"w.{c}") * bright).cast("int").alias(c) for c in "rgb"])
