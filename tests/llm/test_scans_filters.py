import collections
import itertools
import random

import pyarrow as pa
import pyarrow.parquet
import pytest

from cloudloom.llm import catalog, license_scan, url_filters

from .helpers import same_as_sql

TABLES = {t: f"/root/testdata/sf0.001/{t}.parquet" for t in ("documents", "pages", "labels")}


def test_license_scan_on_tables(spark):
    same_as_sql(catalog.QUERIES["op3_license_scan"](spark, "/root/testdata/sf0.001"), catalog.ORACLES["op3_license_scan"], TABLES)


def test_license_scan_inherits_from_nearest(spark):
    mit, gpl = license_scan.TEMPLATES[0][1], license_scan.TEMPLATES[2][1]
    rows = [
        (1, "LICENSE", mit), (2, "a/b/c.txt", "text\nthe the the"), (3, "a/LICENSE.md", "x\n" + gpl.upper()), (4, "a/b/d.txt", f"say\n{mit}\n"), (5, "z.txt", None),
        (6, None, mit), (None, "q/w/e", ""), (7, "q/w/e", ""), (8, "a/licensed.txt", mit), (9, "b/license", "the public version of the work"), (10, "b/x", "reserved"), (10, "b/x", "reserved"),
    ]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string").selectExpr("*", "1 AS score", "2 AS license", "3 AS dir", "4 AS above")
    got = {(r.doc_id, r.path): (r.own_license, r.license, r.license_dir) for r in license_scan.scan_licenses(files).collect()}
    assert got == {
        (1, "LICENSE"): ("MIT", "MIT", None), (2, "a/b/c.txt"): (None, "GPL-3.0", "a"), (3, "a/LICENSE.md"): ("GPL-3.0", "GPL-3.0", None), (4, "a/b/d.txt"): ("MIT", "MIT", None),
        (5, "z.txt"): (None, "MIT", ""), (6, None): (None, None, None), (None, "q/w/e"): (None, "MIT", ""), (7, "q/w/e"): (None, "MIT", ""), (8, "a/licensed.txt"): ("MIT", "MIT", None),
        (9, "b/license"): (None, "MIT", ""), (10, "b/x"): (None, "MIT", ""),
    }
    assert license_scan.scan_licenses(files.limit(0)).count() == 0


def test_url_filter_on_tables(spark):
    same_as_sql(catalog.QUERIES["op5_url_filter"](spark, "/root/testdata/sf0.001"), catalog.ORACLES["op5_url_filter"], TABLES)


def test_url_filter_mines_rules(spark, tmp_path):
    rnd = random.Random(5)
    pages, labels = [], []
    for i in range(600):
        host = rnd.choice(["good.example.fr", "cheap-pills.site.it", "casino-win.site.it", "News.Example.NET", "x.example.com", "y.org"])
        url = f"http{rnd.choice(['', 's'])}://{host}/{rnd.choice(['en', 'fr', 'de'])}/{rnd.randrange(99)}{rnd.choice(['', '?utm=1&ref=2', '#top', '.html'])}"
        pages.append((i, url))
        labels.append((i, int(not ("pills" in url or ("casino" in url and "ref" in url))), int(rnd.random() < 0.05)))
    pages += [(None, None), (700, None), (701, "no scheme"), (702, "ftp://HOST.net"), (703, "a://É.Example.net/en/"), (704, "://org/fr/x"), (3, pages[3][1]), (705, "http://a\nb.net/")]
    labels += [(None, 0, 1), (5, None, None), (5, 0, 0)]
    for name, rows, cols in (("pages", pages, ("page_id", "url")), ("labels", labels, ("doc_id", "quality", "toxic"))):
        kinds = [pa.int64(), pa.string()] if name == "pages" else [pa.int64(), pa.int32(), pa.int32()]
        table = pa.table({c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(zip(cols, kinds))})
        pa.parquet.write_table(table, f"{tmp_path}/{name}.parquet")
    got = catalog.QUERIES["op5_url_filter"](spark, str(tmp_path))
    same_as_sql(got, catalog.ORACLES["op5_url_filter"], {n: f"{tmp_path}/{n}.parquet" for n in ("pages", "labels")})
    assert got.filter("n_rules > 0 AND rule IS NULL AND verdict = 'block'").count() > 20
    clash = spark.read.parquet(f"{tmp_path}/pages.parquet").selectExpr("*", "1 AS host", "2 AS rule", "3 AS tokens", "4 AS _url")
    bad = spark.createDataFrame([], "page_id long, bad boolean")
    assert url_filters.filter_urls(clash, bad).count() == len(pages)
    assert url_filters.filter_urls(clash.limit(0), bad).count() == 0


@pytest.mark.parametrize("url,host,path", [(None, "", ""), ("x", "", ""), ("a://B/c://D?e", "b", "/c://D"), ("a://B?c", "b", ""), ("a://É#/x", "É", ""), ("://h/", "h", "/")])
def test_host_and_path(spark, url, host, path):
    from pyspark.sql import functions as F

    assert tuple(spark.range(1).select(*url_filters.host_path(F.lit(url).cast("string"))).first()) == (host, path)


def _rules_by_counting(rows, least, confidence, most):
    """All combinations of at most ``most`` tokens that are often bad, by counting them basket by basket."""
    seen, bad = collections.Counter(), collections.Counter()
    for items, is_bad in rows:
        for k in range(1, most + 1):
            for combo in itertools.combinations(sorted(items), k):
                seen[combo] += 1
                bad[combo] += is_bad
    return {c: (n, n / seen[c]) for c, n in bad.items() if n >= least and n / seen[c] >= confidence}


def test_long_urls_are_mined_whole(spark):
    """Urls of 16 to 60 tokens that come together or overlap: every rule of up to three tokens, and no subset of 60."""
    rnd = random.Random(8)
    names = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    urls = [("http://ab.cd/" + "/".join(names), True)] * 11
    urls += [("http://ef.gh/" + "/".join(sorted(rnd.sample(names[:24], 16))), rnd.random() < 0.8) for _ in range(60)]
    urls += [("http://ab.cd/" + names[i % 60], False) for i in range(30)] + [(None, True), ("none", True)]
    table = spark.createDataFrame(urls, "url string, bad boolean")
    baskets = [(r.t, r.bad) for r in table.select(url_filters.tokens("url").alias("t"), "bad").collect() if r.t]
    want = _rules_by_counting(baskets, 10, 0.7, 3)
    got = {tuple(sorted(r["items"])): (r.n, r.confidence) for r in url_filters.mine_rules(table, 0.001, 10, 0.7, 3).collect()}
    assert len(want) > 30_000 and got == want
    narrow = table.filter("url LIKE '%ef.gh%'")
    assert {tuple(sorted(r["items"])) for r in url_filters.mine_rules(narrow, 0.001, 40, 0.7, 2).collect()} == set(_rules_by_counting([b for b in baskets if "h:ef" in b[0]], 40, 0.7, 2))
    assert url_filters.mine_rules(table.filter("NOT bad"), 0.001, 10, 0.7, 3).count() == 0
