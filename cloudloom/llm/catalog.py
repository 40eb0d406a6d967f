"""Queries of this folder over the shared test tables, and SQL checks where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunk_dedup, exact_dedup, hard_negatives, language_id, license_scan, mixing, near_vectors, ngram_jaccard, quality_rules, sentencepiece_codec, token_counts, url_filters, vector_codes
from .common import read

QUERIES, ORACLES = {}, {}


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file; it is never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


@query(r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
  sha256(body) AS text_sha256, CAST(octet_length(encode(body)) AS BIGINT) AS n_bytes
FROM t WINDOW w AS (PARTITION BY body)""")
def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, folder, "documents"))


@query()
def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_codec.round_trip(read(spark, folder, "documents"), tokenizer("piece_bpe_32k.model"))


def _license_sql() -> str:
    names = ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(license_scan.TEMPLATES))
    return r"""
WITH f AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, 'none') AS s, coalesce(lang, 'none') AS l,
  CAST(doc_id AS VARCHAR) AS d, CAST(CAST(floor(doc_id / 64) AS BIGINT) AS VARCHAR) AS shelf, doc_id % 64 AS place FROM documents),
g AS (SELECT *, CASE place WHEN 0 THEN s || '/' || l || '/' || shelf || '/LICENSE' WHEN 1 THEN s || '/' || l || '/LICENSE.' || d
  WHEN 2 THEN s || '/LICENSE.' || d ELSE s || '/' || l || '/' || shelf || '/' || d || '.txt' END AS path FROM f),
tp AS (SELECT * FROM (VALUES {names}) AS v(i, name, body)),
tt AS (SELECT i, w, count(*) AS tf FROM (SELECT i, unnest(regexp_extract_all(lower(body), '[a-z0-9]+(?:[.-][a-z0-9]+)*')) AS w FROM tp) GROUP BY i, w),
df AS (SELECT w, count(*) AS df FROM (SELECT DISTINCT rid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:[.-][a-z0-9]+)*')) AS w FROM f) GROUP BY w),
n AS (SELECT count(*) AS n FROM f),
idf AS (SELECT w, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS x FROM (SELECT DISTINCT w FROM tt) LEFT JOIN df USING (w), n),
tv AS (SELECT i, w, tf * x / sqrt(sum((tf * x) ** 2) OVER (PARTITION BY i)) AS u FROM tt JOIN idf USING (w)),
ln AS (SELECT path, row_number() OVER () AS lid, line FROM (SELECT path, unnest(string_split(text, chr(10))) AS line FROM g)),
lt AS (SELECT lid, w, count(*) AS tf FROM (SELECT lid, unnest(regexp_extract_all(lower(line), '[a-z0-9]+(?:[.-][a-z0-9]+)*')) AS w FROM ln) GROUP BY lid, w),
lv AS (SELECT lid, w, tf * coalesce(x, ln(1 + n) + 1) AS v FROM lt LEFT JOIN idf USING (w), n),
nm AS (SELECT lid, sqrt(sum(v * v)) AS norm FROM lv GROUP BY lid),
dt AS (SELECT lid, i, sum(v * u) AS dot FROM lv JOIN tv USING (w) GROUP BY lid, i),
h AS (SELECT path, name AS license, round(dot / norm, 6) AS score FROM dt JOIN nm USING (lid) JOIN ln USING (lid) JOIN tp USING (i) WHERE dot / norm >= 0.6),
own AS (SELECT path, license AS own_license, score AS own_score FROM h QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, license DESC) = 1),
dirs AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS above, own_license AS license FROM own WHERE regexp_matches(path, '/LICENSE[^/]*$')
  QUALIFY row_number() OVER (PARTITION BY above ORDER BY own_score DESC, own_license DESC) = 1),
near AS (SELECT rid, above, license FROM g JOIN dirs ON starts_with(path, above || '/')
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(above) DESC) = 1)
SELECT doc_id, path, own_license, own_score, coalesce(own_license, license) AS license, CASE WHEN own_license IS NULL THEN above END AS license_dir
FROM g LEFT JOIN own USING (path) LEFT JOIN near USING (rid)""".replace("{names}", names)


@query(_license_sql())
def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan_licenses(license_scan.document_files(read(spark, folder, "documents")))


@query()
def op4_chunk_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_dedup.substring_dedup(read(spark, folder, "documents"))


@query(r"""
WITH lab AS (SELECT doc_id AS page_id, bool_or(coalesce(quality = 0, false) OR coalesce(toxic = 1, false)) AS bad FROM labels GROUP BY doc_id),
p0 AS (SELECT row_number() OVER () AS rid, page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT rid, page_id, url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM p0),
t AS (SELECT rid, page_id, host, path, list_distinct(list_filter(list_concat(list_concat(
  list_transform(string_split_regex(host, '[.-]'), lambda w: 'h:' || w),
  list_transform(string_split_regex(lower(path), '[/.]'), lambda w: 'p:' || regexp_replace(w, '[0-9]+', '0', 'g'))),
  list_transform(string_split(query, '&'), lambda w: 'q:' || regexp_extract(w, '^([^=]*)', 1))), lambda w: length(w) > 2)) AS items FROM p),
b AS (SELECT rid, bad, unnest(items) AS x FROM t JOIN lab USING (page_id)),
n AS (SELECT greatest(10, CAST(ceil(0.001 * count(DISTINCT rid)) AS BIGINT)) AS least FROM b),
c AS (SELECT rid, bad, [x] AS s FROM b UNION ALL SELECT a.rid, a.bad, [a.x, b.x] FROM b AS a JOIN b ON a.rid = b.rid AND a.x < b.x
  UNION ALL SELECT a.rid, a.bad, [a.x, b.x, d.x] FROM b AS a JOIN b ON a.rid = b.rid AND a.x < b.x JOIN b AS d ON a.rid = d.rid AND b.x < d.x),
r AS (SELECT s FROM c, n GROUP BY s, least HAVING count(*) FILTER (bad) >= least AND count(*) FILTER (bad) / count(*) >= 0.7),
m AS (SELECT rid, count(*) AS n_rules FROM t, r WHERE list_has_all(items, s) GROUP BY rid),
l AS (SELECT *, CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM t LEFT JOIN m USING (rid))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN n_rules > 0 THEN 'block' ELSE 'allow' END AS verdict,
  coalesce(n_rules, 0) AS n_rules FROM l""")
def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    labels = read(spark, folder, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return url_filters.filter_urls(read(spark, folder, "pages"), labels)


@query(r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
sz AS (SELECT rid, doc_id, source, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM d),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sz GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM s0),
s2 AS (SELECT *, [3, 1, 2][(rank - 1) % 3 + 1] AS w, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s1),
s3 AS (SELECT *, (total - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lv FROM s2
  WINDOW b AS (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT lv AS level FROM s3 WHERE lv * w <= cap ORDER BY cap / w, rank LIMIT 1),
s AS (SELECT rank, source, source_size, total, least(cap, level * w) AS target FROM s3, lv),
b AS (SELECT greatest(1, CAST(ceil(max(total) / 1048576) AS BIGINT)) AS block, CAST(ceil(max(total) / greatest(1, ceil(max(total) / 1048576))) AS BIGINT) AS n FROM s),
sp AS (SELECT rank, CAST(ceil(source_size / block) AS BIGINT) AS n_blocks, coalesce(sum(target) OVER o, 0) / total AS lo FROM s, b
  WHERE target > 0 WINDOW o AS (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sl AS (SELECT i, i * 0.6180339887498949::DOUBLE - floor(i * 0.6180339887498949::DOUBLE) AS u FROM b, unnest(range(n)) AS r(i)),
rk AS (SELECT rank, n_blocks, row_number() OVER (PARTITION BY rank ORDER BY i) - 1 AS turn FROM sl ASOF JOIN sp ON sl.u >= sp.lo),
sc AS (SELECT rank, turn % n_blocks AS block_no, count(*) AS times FROM rk WHERE turn < 2 * n_blocks GROUP BY ALL),
tu AS (SELECT rank, sum(times) AS turns FROM sc GROUP BY rank),
rm AS (SELECT s.*, CAST(floor(target + 0.5) AS BIGINT) AS due, greatest(1, CAST(ceil(source_size / block) AS BIGINT)) AS nb, CAST(coalesce(turns, 0) AS BIGINT) AS turns FROM s CROSS JOIN b LEFT JOIN tu USING (rank)),
re AS (SELECT *, turns // nb * source_size + least(turns % nb * block, source_size) AS reach FROM rm CROSS JOIN b),
pl AS (SELECT rid, doc_id, size, sz.source, rank, source_size, target, due, reach, coalesce(sum(size) OVER (PARTITION BY rank
  ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), size, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sz JOIN re s ON sz.source IS NOT DISTINCT FROM s.source),
pc AS (SELECT rid, rank, k AS block_no, least(start + size, (k + 1) * block) - greatest(start, k * block) AS words
  FROM pl, b, unnest(range(CAST(start // block AS BIGINT), CAST((start + size - 1) // block AS BIGINT) + 1)) AS r(k) WHERE size > 0),
tk AS (SELECT rid, sum(times * words) AS taken FROM pc JOIN sc USING (rank, block_no) GROUP BY rid)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE CAST(coalesce(taken, 0)
  + due // source_size * size + greatest(0, least(size, due % source_size - start))
  - reach // source_size * size - greatest(0, least(size, reach % source_size - start)) AS BIGINT) END AS taken, source FROM pl LEFT JOIN tk USING (rid)""")
def op6_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(read(spark, folder, "documents"))


@query(r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
u AS (SELECT rid, unnest(words) AS word, unnest(range(len(words))) AS pos FROM w),
g AS (SELECT rid, pos, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS win
  FROM u WINDOW o AS (PARTITION BY rid ORDER BY pos)),
r AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, win) AS n FROM g WHERE win IS NOT NULL) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT pos + k) AS n_repeat_words FROM r, unnest(range(5)) AS x(k) GROUP BY rid),
l AS (SELECT rid, host, md5(text) AS body, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
nl AS (SELECT rid, host, body, lower(trim(regexp_replace(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g'), ' ')) AS line FROM l),
often AS (SELECT host, line, count(DISTINCT body) AS n_docs FROM nl WHERE line <> '' GROUP BY host, line),
gone AS (SELECT rid, sum(len(string_split(line, ' '))) AS n_removed FROM nl JOIN often USING (host, line)
  WHERE n_docs > 20 GROUP BY rid),
b AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed
  FROM w LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND n_words - n_removed >= 10 AND n_words - n_removed >= 0.5 * n_words AS kept FROM f""")
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_rules(read(spark, folder, "documents"))


@query()
def op8_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(read(spark, folder, "documents"), size=3, num=90, den=100)


@query()
def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """All documents and all pages; documents have their source as host and no markup."""
    docs, pages = read(spark, folder, "documents"), read(spark, folder, "pages")
    null = F.lit(None)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), null.cast("long").alias("page_id"), "text", null.cast("string").alias("declared"), F.col("source").alias("host"))
    shown = language_id.page_records(pages).select(null.cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), "text", "declared", "host")
    return language_id.language_id(texts.unionByName(shown), language_id.fit(docs)).withColumn("p", F.round("p", 6))


@query()
def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(read(spark, folder, "documents"), tokenizer("word_bpe_49k.json"))


#: Rows whose vector has only finite components, with whole-numbered components v and unit vector u.
_VECTORS = r"""
good AS (SELECT row_number() OVER () AS rid, vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
e AS (SELECT *, list_transform(x, lambda c: CAST(floor(256 * c) AS DOUBLE)) AS v FROM good)"""


def _codes_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS) -> str:
    """Assignment and averaging spelled out once per round."""
    steps = [
        f"p AS (SELECT rid, k AS part, list_slice(v, k * len(v) // {parts} + 1, (k + 1) * len(v) // {parts}) AS c FROM e, range({parts}) AS r(k))",
        f"f AS (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS entry FROM e QUALIFY entry < {entries})",
        "b0 AS (SELECT part, entry, c FROM p JOIN f USING (rid))",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (SELECT rid, part, min(CAST(list_inner_product(p.c, p.c) - 2 * list_inner_product(p.c, b.c) + list_inner_product(b.c, b.c) AS BIGINT) * 64 + entry) AS hit
  FROM p JOIN b{i} AS b USING (part) GROUP BY rid, part)""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT part, entry, list(floor(s / n) ORDER BY pos) AS c FROM (SELECT part, hit % 64 AS entry, pos, sum(c[pos]) AS s, count(*) AS n
  FROM a{i} JOIN p USING (rid, part), range(1, len(c) + 1) AS r(pos) GROUP BY part, hit % 64, pos) GROUP BY part, entry)""")
            steps.append(f"b{i + 1} AS (SELECT part, entry, coalesce(m.c, b.c) AS c FROM b{i} AS b LEFT JOIN m{i} AS m USING (part, entry))")
    steps.append(f"""o AS (SELECT rid, string_agg(format('{{:02x}}', hit % 64), '' ORDER BY part) AS code, CAST(sum(hit // 64) AS BIGINT) AS error FROM a{rounds} GROUP BY rid)""")
    steps.append(f"h AS (SELECT sha256(string_agg(CAST(CAST(c[pos] AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{rounds}, range(1, len(c) + 1) AS r(pos))")
    last = "SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o JOIN e USING (rid), h"
    return f"WITH {_VECTORS},\n" + ",\n".join(steps) + "\n" + last


@query(_codes_sql())
def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compress(read(spark, folder, "embeddings"))


@query(rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings),
u AS (SELECT rid, CAST(embedding AS DOUBLE[]) AS x FROM d WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
l AS (SELECT a.rid AS a, b.rid AS b FROM u AS a JOIN u AS b ON a.rid <> b.rid AND list_cosine_similarity(a.x, b.x) >= 0.9),
r AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT r.a AS rid, min(d.vec_id) AS component_id FROM r JOIN d ON r.b = d.rid GROUP BY r.a),
n AS (SELECT a AS rid, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM d JOIN c USING (rid) LEFT JOIN n USING (rid)""")
def op12_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors.near_vectors(read(spark, folder, "embeddings"))


@query(rf"""
WITH {_VECTORS},
g AS (SELECT rid, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v FROM e WHERE vec_id IS NOT NULL AND label IS NOT NULL),
s AS (SELECT a.rid, a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM g AS a JOIN g AS b ON a.id <> b.id WHERE a.id % 50 = 0),
p AS (SELECT rid, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY rid ORDER BY score DESC, id) AS place FROM s WHERE same QUALIFY place <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.rid, place ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (rid, anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3""")
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.mine_embeddings(read(spark, folder, "embeddings"))
