"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = 100) -> DataFrame:
    """(node, component): component = the smallest node id reachable.

    ``edges`` has columns (a, b) of any orderable type.  Neighbour minima are
    plain aggregates, so a hub is pre-combined on every map task and never
    gathered into one group.
    """
    live = cut(edges.filter(F.col("a") != F.col("b")).select("a", "b").distinct())
    seen = live.select(F.col("a").alias("node")).union(live.select("b")).distinct()
    before = None
    for _ in range(max_rounds):
        # Large star: every larger neighbour of u moves to the minimum of u's neighbourhood.
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        big = (
            both.filter(F.col("b") > F.col("a")).join(low, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        )
        # Small star: u and its smaller neighbours move to the smallest of them.
        big = big.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = big.groupBy("a").agg(F.min("b").alias("m"))
        live = (
            big.join(low, "a").select(F.col("b").alias("u"), "m")
            .union(low.select(F.col("a").alias("u"), "m"))
            .filter("u != m").select(F.col("u").alias("a"), F.col("m").alias("b")).distinct()
        )
        live = cut(live)
        after = live.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(after) == before:
            break
        before = tuple(after)
    else:
        raise RuntimeError("components did not settle")
    roots = live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    base = seen if nodes is None else nodes.select(F.col(nodes.columns[0]).alias("node")).distinct()
    return base.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
