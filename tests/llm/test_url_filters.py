import re

import duckdb

from rosterlake.llm import url_filters as op

URLS = [
    None, "", "no scheme", "http://a.net", "http://a.net/", "HTTP://A.NET/x?y=/z", "https://example.net/en/1#top", "https://x.example.net/en/1",
    "https://example.net/EN/1", "https://example.com/de/", "https://m.example.com/de/7?x#y", "https://badexample.com/de/1", "https://example.com/de", "http://é.org/fr/é",
    "http://ÀB.ORG/fr/", "://", "://net/", "http://net?x", "x://y://net/", "http://org/fr/\n", "https://example.com/en/1", "https://example.com/en/1",
]


def parts(url):
    head, sep, rest = (url or "").partition("://")
    m = re.match(r"([^/?#]*)([^?#]*)", rest if sep else "")
    host, path = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]
    fits = [(len(r), r, v) for v, r in op.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def brute(urls):
    rows = {k: parts(u) for k, u in enumerate(urls)}
    listed = {host for host, _, _, verdict in rows.values() if verdict == "block"}
    return {k: (host, path, rule, verdict or ("block" if host in listed else "allow")) for k, (host, path, rule, verdict) in rows.items()}


def test_rules_and_cascade(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    found = {r.page_id: tuple(r)[1:] for r in op.judge(pages).collect()}
    assert found == brute(URLS)


def test_segments(spark):
    urls = [f"http://h{k % 97}.example.{'com' if k % 2 else 'org'}/{('de', 'en', 'fr')[k % 3 if k % 97 < 40 else 1]}/{k}" for k in range(600)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for most in (5, 1 << 20):
        assert {r.page_id: tuple(r)[1:] for r in op.judge(pages, segment_keys=most).collect()} == brute(urls)


def test_the_cascade_decides(spark, monkeypatch):
    """Without the filters, pages of listed hosts would pass."""
    found = {r.page_id: r.verdict for r in op.op9_url_filters(spark, "/root/testdata/sf0.01").collect()}
    monkeypatch.setattr(op.Cascade, "holds", lambda self, key="key": op.F.lit(False))
    without = {r.page_id: r.verdict for r in op.op9_url_filters(spark, "/root/testdata/sf0.01").collect()}
    changed = {k for k in found if found[k] != without[k]}
    assert changed and all(found[k] == "block" for k in changed)


def test_cascade_is_exact(spark):
    from rosterlake.llm.scratch import Scratch

    keys = spark.range(20000).selectExpr("concat('k', id) AS key", "id % 7 = 0 AS listed")
    cascade = op.Cascade(Scratch(spark, "test"), keys, "all")
    assert len(cascade.levels) > 1
    assert keys.where(cascade.holds() != keys["listed"]).count() == 0


def test_same_as_sql(spark, sf):
    found = {tuple(r) for r in op.op9_url_filters(spark, sf).collect()}
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS FROM '{sf}/pages.parquet'")
    assert found == set(db.sql(op.OP9_SQL).fetchall())


def test_no_python(spark, sf):
    plan = op.op9_url_filters(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Join", plan)


def test_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.net/", "h", "p", "r", "k", 5)], "page_id long, url string, host string, path string, rule string, key string, segment int")
    assert [tuple(r) for r in op.judge(pages).collect()] == [(1, "a.net", "/", "net/", "block")]


def test_empty(spark):
    assert op.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
