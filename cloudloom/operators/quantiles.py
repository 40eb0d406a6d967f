"""Exact quantiles of large groups: the bin that holds a rank is cut finer and finer, so no task holds a group's values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, is_empty, small

#: Bins that the open range of a rank is cut into in one pass.
BINS = 4096
#: Values left in all open ranges together that are ranked by sorting instead of by further passes.
FEW = 100_000


def exact_quantiles(values: DataFrame, groups: list[str], value: str, probs) -> DataFrame:
    """(groups, p, quantile, n): linear interpolation between neighbouring ranks, as ``percentile`` has it.

    A rank starts with the whole range of its group.  A pass counts the values of each open range by bin and keeps, for
    every rank, the one bin that holds it, with the bin's own least and greatest value as the next range.  A rank is found
    when these agree.  Least and greatest value never share a bin, so every pass leaves fewer values; rows outside open
    ranges are not read on.  Nulls, NaN and infinite values are left out; a group without other values gives no row; a
    null group is a group; no groups at all means one.
    """
    key = F.struct(*[F.col(g) for g in groups]) if groups else F.struct(F.lit(0).alias("all"))
    rows = cut(values.select(key.alias("k"), F.col(value).cast("double").alias("v")).filter(F.abs(F.col("v")) < float("inf")))
    ends = cut(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    asked = ends.select("*", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p")).withColumn("at", F.col("p") * (F.col("n") - 1))
    # Two ranks per quantile, counted from 0; ``rank`` is the one looked for inside [lo, hi].
    ranks = asked.select("k", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("want"), "lo", "hi").distinct().withColumn("rank", F.col("want"))
    found, live = [], rows
    open_ = cut(ranks)
    while True:
        found.append(open_.filter("lo = hi").select("k", "want", F.col("lo").alias("v")))
        open_ = open_.filter("lo < hi")
        if is_empty(open_):
            break
        spans = small(open_.select("k", "lo", "hi").distinct().select(F.col("k").alias("rk"), "lo", "hi"))
        # Open ranges of a group are equal or apart, so a value meets one of them at most; halves keep widths finite.
        live = cut(live.select("k", "v").join(spans, F.col("k").eqNullSafe(F.col("rk")) & F.col("v").between(F.col("lo"), F.col("hi"))).drop("rk"))
        if live.count() <= FEW:
            nth = F.row_number().over(Window.partitionBy("k", "lo").orderBy("v")) - 1
            sorted_ = live.select(F.col("k").alias("rk"), F.col("lo").alias("rlo"), "v", nth.alias("nth"))
            same = F.col("k").eqNullSafe(F.col("rk")) & (F.col("lo") == F.col("rlo")) & (F.col("rank") == F.col("nth"))
            found.append(sorted_.join(small(open_), same).select("k", "want", "v"))
            break
        part = F.try_divide(F.col("v") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2)
        place = F.when(F.col("v") == F.col("lo"), 0).when(F.col("v") == F.col("hi"), BINS - 1).otherwise(F.least(F.floor(part * BINS), F.lit(BINS - 1)))
        bins = live.groupBy("k", "lo", "hi", place.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        bins = bins.withColumn("upto", F.sum("c").over(Window.partitionBy("k", "lo", "hi").orderBy("bin")))
        bins = bins.select(F.col("k").alias("rk"), F.col("lo").alias("rlo"), "low", "high", "c", "upto")
        same = F.col("k").eqNullSafe(F.col("rk")) & (F.col("lo") == F.col("rlo"))
        hit = bins.join(small(open_), same & (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
        open_ = cut(hit.select("k", "want", F.col("low").alias("lo"), F.col("high").alias("hi"), (F.col("rank") - F.col("upto") + F.col("c")).alias("rank")))
    value_of = found[0]
    for more in found[1:]:
        value_of = value_of.unionByName(more)
    value_of = cut(value_of)
    ends = asked.select(F.col("k").alias("ak"), "p", "at", "n")
    both = ends.join(small(value_of), F.col("ak").eqNullSafe(F.col("k")) & F.col("want").isin(F.floor("at"), F.ceil("at")))
    low, high = F.min_by("v", "want"), F.max_by("v", "want")
    out = both.groupBy("ak", "p", "at", "n").agg(low.alias("low"), high.alias("high"))
    weight = F.col("at") - F.floor("at")
    return out.select(*[F.col("ak")[g].alias(g) for g in groups], "p", (F.col("low") * (1 - weight) + F.col("high") * weight).alias("quantile"), "n")
