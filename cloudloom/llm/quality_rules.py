"""Quality rules with cross-document line frequency; column functions, joins and grouping only.

Base rules look at one text.  The method then hashes normalised lines, counts in how many distinct documents of a host
(the ``source``) each line occurs, removes lines above the limits and rejects documents of which too little is left.
Rows are rejoined by a 128-bit key, so the counts never shuffle texts; ``clean_good`` does where its marks are too many
to be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, small
from .common import NARROW_ROWS, SPACE

BLANK = " \t\n\x0b\f\r"
#: Width of the word windows that must not repeat.
WINDOW = 5
#: Removed lines that may be broadcast (two longs and a short host name each).
LINES = 100_000


def words_of(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK))
    return F.when(F.length(body) == 0, F.array().cast("array<string>")).otherwise(F.split(body, SPACE))


def _repeated(windows: Column) -> Column:
    """Words covered by windows whose hash occurs at least twice."""

    def covered(z: Column) -> Column:
        at = F.filter(z, lambda x, i: (F.get(z, i - 1)["w"] == x["w"]) | (F.get(z, i + 1)["w"] == x["w"]))
        return F.sort_array(F.transform(at, lambda x: x["i"]))

    ordered = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
    places = F.transform(F.array(ordered), covered)  # binds the sorted array once
    steps = F.transform(places, lambda p: F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))))
    total = F.aggregate(F.flatten(steps), F.lit(0), lambda a, x: a + x)
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), total).otherwise(0)


def _row_key() -> tuple[Column, Column]:
    """128 bits that stand for (doc_id, source, text); rows that agree in these get one verdict."""
    text, host = F.coalesce("text", F.lit("")), F.coalesce("source", F.lit("\x00"))
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    return F.xxhash64(own, host, text), F.xxhash64(text, host, own, F.lit(1))


def _keyed(docs: DataFrame) -> DataFrame:
    k1, k2 = _row_key()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("\x00")).alias("host"), k1.alias("k1"), k2.alias("k2"))


def base_rules(docs: DataFrame, min_words: int, max_repeat: int) -> DataFrame:
    """Counts of each text alone, and whether it fails on them."""
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANK))) > 0)
    got = (
        docs.withColumn("words", words_of(text)).withColumn("lines", lines)
        .withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
        .withColumn("windows", F.when(F.size("h") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("h") - WINDOW), lambda i: F.xxhash64(*(F.get("h", i + j) for j in range(WINDOW))))).otherwise(F.array().cast("array<bigint>")))
    )
    got = got.select(
        "doc_id", "k1", "k2", F.size("words").cast("long").alias("n_words"), F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("windows")).cast("long").alias("n_repeat_words"),
    )
    return got.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words")))


def removed_words(docs: DataFrame, min_docs: int, max_share: float) -> DataFrame:
    """(k1, k2, n_removed, at): words in lines that more documents of the host have than allowed, and places of these lines."""
    line = F.lower(F.btrim(F.regexp_replace(F.regexp_replace("line", SPACE, " "), "[0-9]", "0"), F.lit(BLANK)))
    lines = (
        docs.select("k1", "k2", "host", F.xxhash64("text").alias("body"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .withColumn("line", line).filter("line <> ''")
        .select("k1", "k2", "host", "body", "pos", F.xxhash64("line").alias("hash"), F.size(F.split("line", " ")).alias("w"))
    )
    hosts = docs.select("host", F.xxhash64("text").alias("body")).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("all_docs"))
    # Copies of one text are one document, so a copied text is not taken for boilerplate.
    often = lines.select("host", "hash", "body").distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") > min_docs)
    over = cut(often.join(hosts, "host").filter(F.col("n_docs") > max_share * F.col("all_docs")).select("host", "hash"))
    found = lines.join(small(over, LINES), ["host", "hash"]).groupBy("k1", "k2", "pos").agg(F.first("w").alias("w"))
    return found.groupBy("k1", "k2").agg(F.sum("w").alias("n_removed"), F.sort_array(F.collect_list("pos")).alias("at"))


def quality_rules(docs: DataFrame, min_words: int = 10, max_repeat: int = 20, min_docs: int = 20, max_share: float = 0.0, min_left: float = 0.5) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed) per row of ``docs``.

    A line goes when more than ``min_docs`` documents of its host have it, whatever the host's size; ``max_share`` above 0
    asks for that share of the host's documents too.  Copies of one text count once, and lines are compared in lower case, with digits as 0 and single spaces.  A document
    is kept unless it fails the base rules, or fewer than ``min_words`` words or less than ``min_left`` of its words stay.
    A null text has no words and fails; documents with a null source are one host; a null doc_id is returned as null;
    repeated rows get one verdict and are all returned; other columns are not read; an empty table gives no rows.
    """
    return judged(docs, min_words, max_repeat, min_docs, max_share, min_left).drop("k1", "k2", "at")


def judged(docs, min_words=10, max_repeat=20, min_docs=20, max_share=0.0, min_left=0.5) -> DataFrame:
    docs = _keyed(docs)
    got = base_rules(docs, min_words, max_repeat).join(removed_words(docs, min_docs, max_share), ["k1", "k2"], "left")
    got = got.withColumn("n_removed", F.coalesce("n_removed", F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("n_removed")
    kept = ~F.col("base_failed") & (left >= min_words) & (left >= min_left * F.col("n_words"))
    return got.select("k1", "k2", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "n_removed", "at")


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; the rejected ones are what is joined."""
    bad = cut(judged(docs, **limits).filter("NOT kept").select("k1", "k2").distinct())
    k1, k2 = _row_key()
    rows = docs.select(F.struct("*").alias("row"), k1.alias("k1"), k2.alias("k2"))
    return rows.join(small(bad, NARROW_ROWS // 2), ["k1", "k2"], "left_anti").select("row.*")


def clean_good(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that the rules keep, without the lines above the limits; all columns stay.

    A removed line goes with its line break; other lines stay byte for byte.  A column n_chars, where there is one,
    follows a text that lost lines.
    """
    marks = cut(judged(docs, **limits).filter("NOT kept OR at IS NOT NULL").select("k1", "k2", F.col("kept").alias("stays"), "at").distinct())
    # Keys and places as bytes: what may be broadcast is bounded by both.
    if (marks.agg(F.sum(24 + 4 * F.size(F.coalesce("at", F.array().cast("array<int>"))))).first()[0] or 0) <= 16 * NARROW_ROWS:
        marks = F.broadcast(marks)
    k1, k2 = _row_key()
    rows = docs.select(F.struct("*").alias("row"), k1.alias("k1"), k2.alias("k2")).join(marks, ["k1", "k2"], "left").filter(F.coalesce("stays", F.lit(True)))
    # The kept stretches: from after each removed line to the next.
    starts = F.concat(F.array(F.lit(0)), F.transform("at", lambda x: x + 1))
    stretches = lambda z: F.flatten(F.zip_with(starts, F.concat("at", F.array(F.size(z))), lambda a, b: F.slice(z, a + 1, b - a)))
    rest = F.transform(F.array(F.split("row.text", "\n")), lambda z: F.array_join(stretches(z), "\n"))[0]  # splits once
    lost = F.col("at").isNotNull()
    rows = rows.select("row", lost.alias("lost"), F.when(lost, rest).otherwise(F.col("row.text")).alias("rest"))
    count = lambda c: F.when(F.col("lost"), F.char_length("rest").cast(docs.schema[c].dataType)).otherwise(F.col("row.n_chars"))
    new = {"text": lambda c: F.col("rest"), "n_chars": count}
    return rows.select(*(new[c](c).alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
