"""Mixing sources to target weights by a low-discrepancy schedule; column functions, joins and windows only.

The documents of a source lie one after the other, in shuffled order, on an axis of words that is cut into equal blocks.
The schedule has one slot per block of the mix: slot i is the golden-ratio point frac(i * 0.618...), which falls into the
interval of one source on the cumulated target shares.  The r-th slot of a source takes its block r modulo its blocks.
What the slots of a source leave below or above its target is taken or given back where they end on the axis, so every
source gets its target to the word, also one that is smaller than a slot.
Running sums are taken in two steps, over cells and within cells, so that no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, small
from .common import NARROW_ROWS
from .quality_rules import words_of

GOLDEN = 0.6180339887498949
#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: The mix is cut into so many slots at most: the resolution of the schedule.
SLOTS = 1 << 20
#: Cells of [0, 1) by which slots find their source.
CELLS = 4096
#: Rows of a cell in a running sum over documents, on average.
CELL_ROWS = 20_000


def running(df: DataFrame, group: str, cell: str, order: list, value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the group that come before, by cell and then by ``order``."""
    df = df.withColumn("_v", value)
    sums = df.groupBy(group, cell).agg(F.sum("_v").alias("_s"))
    ahead = Window.partitionBy(group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, cell, F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(group, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.join(sums, [group, cell]).withColumn(name, F.col("_ahead") + F.sum("_v").over(inside) - F.col("_v")).drop("_v", "_s", "_ahead")


def source_targets(sizes: DataFrame, share: float, most: float) -> DataFrame:
    """(rank, source, source_size, target, total): one row per source.

    Targets are level * weight, or ``most`` times the size where that is less; the level is where they sum up to the mix.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    each = each.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    each = each.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") - 1) % len(WEIGHTS) + 1)).withColumn("cap", most * F.col("source_size"))
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("total", share * F.sum("source_size").over(whole))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    each = each.withColumn("level", level)
    each = each.withColumn("level", F.min_by(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level")), F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("rank")))).over(whole))
    return each.select("rank", "source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"), "total")


def schedule(sources: DataFrame, block: int, total: float) -> DataFrame:
    """(rank, block, times): how often the mix takes each block of each source."""
    spark = sources.sparkSession
    ahead = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    spans = sources.filter("target > 0").withColumn("lo", F.coalesce(F.sum("target").over(ahead), F.lit(0.0)) / total)
    spans = spans.withColumn("hi", F.coalesce(F.lead("lo").over(Window.orderBy("rank")), F.lit(2.0)))
    spans = spans.select("rank", "lo", "hi", F.ceil(F.col("source_size") / block).alias("n_blocks"), F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.floor(F.least("hi", F.lit(1.0)) * CELLS))).alias("cell"))
    slots = spark.range(-int(-total // block)).withColumn("u", F.col("id") * GOLDEN - F.floor(F.col("id") * GOLDEN)).withColumn("cell", F.floor(F.col("u") * CELLS))
    slots = slots.join(spans, "cell").filter("u >= lo AND u < hi").select("rank", "n_blocks", "id", F.floor(F.col("id") / CELLS).alias("part"))
    ranked = running(slots, "rank", "part", ["id"], F.lit(1), "turn").filter(F.col("turn") < 2 * F.col("n_blocks"))
    return ranked.groupBy("rank", (F.col("turn") % F.col("n_blocks")).alias("block")).agg(F.count(F.lit(1)).alias("times"))


def with_remainders(sources: DataFrame, plan: DataFrame, block: int) -> DataFrame:
    """Adds reach and due: the words of its wrapped axis that a source's slots cover, and those that its target asks for.

    Slots are dealt in turn, so they cover the axis from its start on.  What lies between reach and due is the remainder
    of the source, less than a few blocks: all of the target where a source is smaller than a slot.
    """
    turns = plan.groupBy("rank").agg(F.sum("times").alias("turns"))
    blocks = F.greatest(F.ceil(F.col("source_size") / block), F.lit(1))
    turns_ = F.coalesce("turns", F.lit(0))
    reach = F.floor(turns_ / blocks) * F.col("source_size") + F.least(turns_ % blocks * block, F.col("source_size"))
    due = F.floor(F.col("target") + 0.5).cast("long")
    return sources.join(turns, "rank", "left").withColumns({"reach": reach.cast("long"), "due": due}).drop("turns")


def _words_before(end: str) -> Column:
    """Words of the document at ``at`` before a place on its source's wrapped axis."""
    rounds = F.floor(F.col(end) / F.col("source_size"))
    return rounds * F.col("size") + F.greatest(F.lit(0), F.least("size", F.col(end) - rounds * F.col("source_size") - F.col("at")))


def mix_sources(docs: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) per row of ``docs``.

    size counts words; taken counts the words of the document in the mix, repeats included.  A null text has size 0 and
    taken 0; a null source is a source of its own that comes last; rows with a null doc_id take part; of repeated rows
    each is a document of its own.  Other columns are not read; an empty table gives no rows.  The order of documents
    comes from the digest of their ids, so reruns agree.
    """
    rows = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), F.size(words_of(F.col("text"))).cast("long").alias("size")))
    sources = cut(source_targets(rows, share, most))
    top = sources.agg(F.max("total"), F.max("rank")).first()
    if not top[0]:
        return rows.join(sources, rows.source.eqNullSafe(sources.source)).select("doc_id", "size", "source_size", F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"), rows.source)
    block, digits = max(1, -int(-top[0] // SLOTS)), 1
    n = rows.count()
    while 16**digits * CELL_ROWS < n:
        digits += 1
    plan = cut(schedule(sources, block, top[0]))
    sources = cut(with_remainders(sources, plan, block))
    placed = rows.join(F.broadcast(sources) if top[1] <= CELL_ROWS else sources, rows.source.eqNullSafe(sources.source)).select("doc_id", rows.source, "size", "rank", "source_size", "target", "reach", "due")
    placed = placed.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).withColumn("cell", F.substring("h", 1, digits))
    placed = running(placed, "rank", "cell", ["h", "size"], F.col("size"), "at")
    row = ["doc_id", "source", "size", "rank", "source_size", "target", "reach", "due", "at"]
    pieces = placed.filter("size > 0").select(*row, F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("block"))
    pieces = pieces.withColumn("words", F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("at"), F.col("block") * block))
    taken = pieces.join(plan, ["rank", "block"], "left").groupBy(*row).agg(F.sum(F.coalesce("times", F.lit(0)) * F.col("words")).alias("taken"))
    taken = taken.withColumn("taken", F.col("taken") + _words_before("due") - _words_before("reach"))
    none = placed.filter("size = 0").select(*row, F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(none).select("doc_id", "size", "source_size", "target", "taken", "source")


def repeat_documents(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes its words, rounded to whole documents; all columns stay.

    Counts other than one are looked up by id and source, both null-safe, so texts stay where they are while the counts
    are few enough to be broadcast.  Rows that share id and source get the largest of their counts.
    """
    n = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    times = mixed.select(F.col("doc_id").alias("id"), F.col("source").alias("of"), n.alias("n")).groupBy("id", "of").agg(F.max("n").alias("n"))
    times = cut(times.filter("n <> 1"))
    rows = docs.select(F.struct("*").alias("row"))
    rows = rows.join(small(times, NARROW_ROWS // 2), F.col("row.doc_id").eqNullSafe(F.col("id")) & F.col("row.source").cast("string").eqNullSafe(F.col("of")), "left")
    copies = F.expr("array_repeat(0, coalesce(n, 1))")
    return rows.select("row", F.explode(copies)).select("row.*")
