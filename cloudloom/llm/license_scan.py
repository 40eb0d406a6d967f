"""License scans by sparse TF-IDF cosine to templates, and inheritance from the nearest directory; DataFrame functions only.

Every line of a file is compared with every template, but only where it can reach the threshold: a line whose cosine with
a template is at least t holds one of the template's heaviest tokens, those without which the rest weighs less than t.
These tokens index the templates.  A file without an own license takes that of the licence file in its own or else the
nearest ancestor directory; directories are joined by path, each with its ancestors.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, small

#: Common one-line statements of well-known licenses.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistributed under the BSD 3-Clause License."),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
)
THRESHOLD = 0.6
#: Names of files that speak for their directory.
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)([._-].*)?$"


def tokens(text: Column) -> Column:
    """Words of lower-case ASCII letters, digits, dots and hyphens between them."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:[.-][a-z0-9]+)*"), 0)


def _weights(files: DataFrame, templates) -> tuple[dict[str, float], float]:
    """idf of the templates' tokens over all files, and of a token that no template has (as rare as can be)."""
    import re

    words = sorted({w for _, t in templates for w in re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", t.lower())})
    held = files.select(F.explode(F.array_intersect(tokens(F.coalesce("text", F.lit(""))), F.array(*map(F.lit, words)))).alias("w"))
    found = {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most the templates' tokens
    n = files.count()
    idf = lambda df: math.log((1 + n) / (1 + df)) + 1
    return {w: idf(found.get(w, 0)) for w in words}, idf(0)


def _vectors(templates, weights):
    """[(name, {token: weight of unit length}, heaviest tokens)] of the templates."""
    import re

    out = []
    for name, text in templates:
        tf = Counter(re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", text.lower()))
        raw = {w: c * weights[w] for w, c in tf.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        unit = {w: x / norm for w, x in raw.items()}
        heavy, rest = [], 1.0
        for w in sorted(unit, key=lambda w: (-unit[w], w)):
            if rest < THRESHOLD**2 - 1e-9:
                break
            heavy.append(w)
            rest -= unit[w] ** 2
        out.append((name, unit, heavy))
    return out


def own_licenses(files: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(path, license, score): the best template of each file that reaches the threshold in one of its lines."""
    weights, unseen = _weights(files, templates)
    vectors = _vectors(templates, weights)
    anchors = sorted({w for _, _, heavy in vectors for w in heavy})
    index = F.create_map(*(x for w in anchors for x in (F.lit(w), F.array(*(F.lit(i) for i, v in enumerate(vectors) if w in v[2])))))
    idf = F.create_map(*(x for w, v in weights.items() for x in (F.lit(w), F.lit(v))))
    lines = files.select("path", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).withColumn("t", tokens(F.col("line")))
    lines = lines.filter(F.arrays_overlap("t", F.array(*map(F.lit, anchors))))
    # A line's length: for each distinct token, (times it occurs * idf) squared.
    count = lambda w: F.size(F.filter("t", lambda x: x == w))
    lines = lines.withColumn("v", F.transform(F.array_distinct("t"), lambda w: F.struct(w.alias("w"), (count(w) * F.coalesce(idf[w], F.lit(unseen))).alias("x"))))
    lines = lines.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, p: a + p["x"] * p["x"])))
    hits = lines.withColumn("i", F.explode(F.array_distinct(F.flatten(F.transform(F.array_intersect("t", F.array(*map(F.lit, anchors))), lambda w: index[w])))))
    unit = F.element_at(F.array(*(F.create_map(*(x for w, v in u.items() for x in (F.lit(w), F.lit(v)))) for _, u, _ in vectors)), F.col("i") + 1)
    hits = hits.withColumn("u", unit).withColumn("score", F.aggregate("v", F.lit(0.0), lambda a, p: a + p["x"] * F.coalesce(F.col("u")[p["w"]], F.lit(0.0))) / F.col("norm"))
    names = F.element_at(F.array(*(F.lit(name) for name, _, _ in vectors)), F.col("i") + 1)
    hits = hits.filter(F.col("score") >= THRESHOLD).select("path", names.alias("license"), F.round("score", 6).alias("score"))
    return hits.groupBy("path").agg(F.max(F.struct("score", F.col("license"))).alias("m")).select("path", "m.license", "m.score")


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def scan_licenses(files: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, path, own_license, own_score, license, license_dir) per row of ``files`` (doc_id, path, text).

    own_license comes from the file's lines; license is that or else the license of the nearest directory at or above
    the file that has a licence file with one, and license_dir is this directory (empty: the root).  Of several licence
    files in a directory the best score counts, then the name last in the alphabet.  Rows that share a path are one file
    with all their lines.  A null or empty text has no license; a null path has none and inherits nothing; a null doc_id
    is returned as null; other columns are not read; an empty table gives no rows.
    """
    files = files.select("doc_id", "path", "text")
    own = cut(own_licenses(files.filter("path IS NOT NULL"), templates))
    name = F.regexp_extract("path", r"(?s)([^/]*)$", 1)
    dirs = own.filter(F.regexp_like(name, F.lit(LICENCE_FILE))).groupBy(directory(F.col("path")).alias("above")).agg(F.max(F.struct("score", "license")).alias("m"))
    dirs = cut(dirs.select("above", F.col("m.license").alias("license")))
    below = files.select(directory(F.col("path")).alias("dir")).filter("dir IS NOT NULL").distinct()
    parts = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    near = below.withColumn("above", F.explode(F.array_distinct(ups))).join(small(dirs, 50_000), "above")
    near = near.groupBy("dir").agg(F.max_by(F.struct("above", "license"), F.length("above")).alias("d"))
    near = cut(near.select("dir", F.col("d.above").alias("above"), F.col("d.license").alias("inherited")))
    rows = files.select("doc_id", "path", directory(F.col("path")).alias("dir"))
    rows = rows.join(small(own.select("path", F.col("license").alias("own_license"), F.col("score").alias("own_score")), 50_000), "path", "left").join(small(near, 50_000), "dir", "left")
    mine = F.col("own_license").isNotNull()
    return rows.select("doc_id", "path", "own_license", "own_score", F.coalesce("own_license", "inherited").alias("license"), F.when(~mine, F.col("above")).alias("license_dir"))


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files: source/lang/shelf of 64 ids/name; the first three of a shelf are the licence files of the shelf, the language and the source."""
    place, source, lang = F.pmod("doc_id", F.lit(64)), F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none"))
    shelf = F.floor(F.col("doc_id") / 64).cast("string")
    own = F.col("doc_id").cast("string")
    path = (
        F.when(place == 0, F.concat_ws("/", source, lang, shelf, F.lit("LICENSE")))
        .when(place == 1, F.concat_ws("/", source, lang, F.concat(F.lit("LICENSE."), own)))
        .when(place == 2, F.concat_ws("/", source, F.concat(F.lit("LICENSE."), own)))
        .otherwise(F.concat_ws("/", source, lang, shelf, F.concat(own, F.lit(".txt"))))
    )
    return docs.select("doc_id", path.alias("path"), "text")
