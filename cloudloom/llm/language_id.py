"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are added up as logarithms: the likelihood of the text's byte trigrams, the language that the
markup declares, the suffix of the address, and a prior of the host.  The last three are learnt from the rows themselves:
posteriors of the text alone are summed by declared language, suffix, host and parent domain; a host's prior is smoothed
towards its domain's and that towards the prior of all rows, and each row is taken out of its own host's sums.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, small

BINS = 1 << 14
#: Trigrams overlap and depend on one another: a text counts as this many independent ones at most.
TEXT_WEIGHT = 60
#: Pseudo-rows of the level above in a host's or domain's prior, and in the tables of declared language and suffix.
HOST_WEIGHT, TABLE_WEIGHT = 5.0, 1.0
#: Bytes of the model's table on the driver and in each Python worker; more languages than fit are an error.
MODEL_BYTES = 256 << 20


def _bins(raw: bytes) -> np.ndarray:
    """Hashed byte trigrams of a text in lower case."""
    a = np.frombuffer(raw.lower(), np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.empty(0, np.int64)
    code = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


class Model:
    """Log-likelihoods (languages x bins); of fixed size for a number of languages."""

    def __init__(self, names: list[str], table: np.ndarray, shares: list[float]):
        self.names, self.table, self.shares = names, table, shares


def fit(training: DataFrame) -> Model:
    """Trigram model from all rows (lang, text) of every labelled language, however few rows it has.

    Counts are summed in Spark, and at most languages x bins numbers come back; a table over MODEL_BYTES is a ValueError.
    """
    training = training.select("lang", "text").filter("lang IS NOT NULL")
    rows = training.groupBy("lang").count()
    most = MODEL_BYTES // (8 * BINS)
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"over {most} labelled languages need a table of over {MODEL_BYTES} bytes; raise language_id.MODEL_BYTES")
    shares = {r["lang"]: r["count"] / sum(x["count"] for x in found) for r in found}
    names = sorted(shares)
    at_name = {n: i for i, n in enumerate(names)}

    def counts(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                bins = _bins(raw or b"")
                if len(bins):
                    if lang not in sums:
                        sums[lang] = np.zeros(BINS, np.int64)
                    sums[lang] += np.bincount(bins, minlength=BINS)
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(c[at], pa.int64())], names=["lang", "bin", "n"])

    table = np.full((len(names), BINS), 0.5)
    for r in training.mapInArrow(counts, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toLocalIterator():
        table[at_name[r["lang"]], r["bin"]] += r["n"]
    table = np.log(table / table.sum(axis=1, keepdims=True)) if names else table
    return Model(names, table, [shares[n] for n in names])


def text_scores(records: DataFrame, model: Model) -> DataFrame:
    """``records`` with its text replaced by ``ll``: tempered log-likelihood of each language."""
    columns = [c for c in records.columns if c != "text"]
    sent = records.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        table = np.ascontiguousarray(sent.value.table.T)
        for batch in batches:
            scores = np.zeros((batch.num_rows, table.shape[1]))
            for i, raw in enumerate(batch.column(len(columns)).cast(pa.binary()).to_pylist()):
                bins = _bins(raw or b"")
                if len(bins):
                    scores[i] = table[bins].mean(axis=0) * (len(bins) * TEXT_WEIGHT / (len(bins) + TEXT_WEIGHT))
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * scores.shape[1]
            yield pa.record_batch([*batch.columns[:len(columns)], pa.ListArray.from_arrays(ends, pa.array(scores.ravel()))], names=[*columns, "ll"])

    kinds = ", ".join(f"`{c}` {records.schema[c].dataType.simpleString()}" for c in columns)
    return records.select(*columns, "text").mapInArrow(run, f"{kinds}, ll array<double>")


def _numbers(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def _bind(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def _softmax(logs: Column) -> Column:
    """Posteriors of an array of logarithms; the expression does not grow with the number of languages."""
    raised = lambda z: _bind(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp(x - top)))
    shared = lambda e: _bind(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total))
    return _bind(logs, lambda z: _bind(raised(z), shared))


def language_id(records: DataFrame, model: Model) -> DataFrame:
    """``records`` without text and with (lang, p, text_lang): the likeliest language, its posterior, and that of the text alone.

    Needs the columns text, declared and host; suffix and parent domain come from the host.  A null declared language or
    host is no evidence; a null or short text has equal likelihoods.  Equal posteriors give the language that comes first
    in the alphabet; without any language lang and p are null.  All other columns are carried along, whatever their
    names; repeated rows are returned as often as they come; an empty table gives no rows.
    """
    names = model.names
    if not names:
        none = F.lit(None).cast("string")
        return records.drop("text").select("*", none.alias("lang"), F.lit(None).cast("double").alias("p"), none.alias("text_lang"))
    ids = range(len(names))
    carried = [c for c in records.columns if c not in ("text", "declared", "host")]
    packed = records.select(F.struct(*carried, F.lit(0).alias("_")).alias("_row"), "declared", "host", "text")
    rows = text_scores(packed, model)
    host = F.lower("host")
    alone = _softmax(F.zip_with("ll", _numbers(math.log(x) for x in model.shares), lambda x, y: x + y))
    rows = cut(rows.select(
        "_row", "declared", "host", F.lower("declared").alias("_d"), host.alias("_h"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("_m"),
        F.regexp_extract(host, r"\.([^.]+)$", 1).alias("_s"), "ll", alone.alias("own"),
    ))
    sums = F.array(*(F.sum(F.col("own")[i]) for i in ids)).alias("n")
    every = rows.agg(F.count(F.lit(1)).alias("c"), sums).first()
    totals = [x or 0.0 for x in every["n"]]
    prior = [(x + 1.0) / (every["c"] + len(names)) for x in totals]

    def table(key: str, to: str) -> DataFrame:
        """log P(value | language), smoothed; one row per value."""
        sizes = rows.filter(F.length(key) > 0).groupBy(key).agg(sums)
        return sizes.select(key, F.zip_with(F.zip_with("n", _numbers(TABLE_WEIGHT * p for p in prior), lambda x, p: x + p), _numbers(x + TABLE_WEIGHT for x in totals), lambda x, t: F.log(x / t)).alias(to))

    domains = rows.groupBy("_m").agg(F.count(F.lit(1)).alias("c"), sums)
    domains = domains.select("_m", F.zip_with("n", _numbers(HOST_WEIGHT * p for p in prior), lambda x, p: (x + p) / (F.col("c") + HOST_WEIGHT)).alias("m"))
    hosts = rows.filter("_h IS NOT NULL").groupBy("_h", "_m").agg(F.count(F.lit(1)).alias("c"), sums).join(domains, "_m").select("_h", "c", F.col("n").alias("h"), "m")
    declared, suffixes, hosts = cut(table("_d", "d")), cut(table("_s", "s")), cut(hosts)
    # Rows that may be broadcast hold an array of languages each.
    most = lambda n: max(1, 4 * n // max(4, len(names)))
    got = rows.join(small(declared, most(10_000)), "_d", "left").join(small(suffixes, most(10_000)), "_s", "left").join(small(hosts, most(50_000)), "_h", "left")
    mine = F.zip_with(F.zip_with("h", "own", lambda h, p: F.greatest(h - p, F.lit(0.0))), "m", lambda x, m: (x + HOST_WEIGHT * m) / (F.col("c") - 1 + HOST_WEIGHT))
    logs = F.zip_with("ll", F.coalesce(mine, _numbers(prior)), lambda x, p: x + F.log(p))
    for evidence in ("d", "s"):
        logs = F.zip_with(logs, F.coalesce(evidence, _numbers([0.0] * len(names))), lambda x, y: x + y)
    got = got.select("_row", "declared", "host", _softmax(logs).alias("post"), "own")
    pick = lambda c: F.element_at(F.array(*map(F.lit, names)), F.array_position(c, F.array_max(c)).cast("int"))
    return got.select(*(F.col("_row")[c].alias(c) for c in carried), "declared", "host", pick(F.col("post")).alias("lang"), F.array_max("post").alias("p"), pick(F.col("own")).alias("text_lang"))


def page_records(pages: DataFrame) -> DataFrame:
    """(page_id, text, declared, host) of web pages: visible text, the lang attribute, and the host of the url."""
    html = F.coalesce("html", F.lit(""))
    shown = F.regexp_replace(html, r"(?is)<(script|style|nav)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    lang = F.regexp_extract(html, r"""(?i)<html\b[^>]*?\slang\s*=\s*["']?([a-z]{2,3})""", 1)
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#:]*)", 1)
    null = lambda c: F.when(F.length(c) > 0, c)
    return pages.select("page_id", shown.alias("text"), null(lang).alias("declared"), null(host).alias("host"))
