"""Targets of canonical links and refreshes, relative ones included."""

import time

from conform.llm import urls


def test_targets_are_resolved_and_pass_blocks_on(spark):
    canonical = '<link rel="canonical" href="{}">'.format
    html = {"/es/y": "a.org/es/y", "//B.net/es/": "b.net/es/", "z": "a.org/d/e/z", "../z?q": "a.org/d/z?q", "./..": "a.org/d/", "../../../z": "a.org/z",
            "?q": "a.org/d/e/f?q", "#f": None, "HTTPS://c.org/x#f": "c.org/x", "mailto:x": None}
    rows = [(i, "http://A.org/d/e/f?x=/1", canonical(t), b) for i, (t, b) in enumerate(html.items())]
    rows += [(20, "http://a.org/1", '<base href="/sub/"><link rel="alternate canonical" href=x>', "a.org/sub/x"),
             (21, "http://a.org/1", "<meta http-equiv='refresh' content='0; url=\"/r\"'>", "a.org/r"),
             (22, "http://a.org", canonical("x"), "a.org/x"), (23, "http://a.org/1", '<link data-href="/no" title="a>b" href="/y" rel="canonical">', "a.org/y"),
             (24, "http://a.org/1", '<link rel="canonically" href="/no">', None), (25, "http://a.org/1", '<meta http-equiv="refresh" content="30">', None),
             (26, None, canonical("http://b.org/"), None), (27, "http://a.org/1", None, None), (28, "http://a.org/1", '<base href="http://o.org/p/q"><link rel=canonical href=x>', "o.org/p/x")]
    for i, url, page, want in rows:
        assert isinstance(i, int) and (want is None or url)
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    edges = sorted(map(tuple, urls.page_links(pages).collect()))
    keys = {"http://A.org/d/e/f?x=/1": "a.org/d/e/f?x=/1", "http://a.org/1": "a.org/1", "http://a.org": "a.org"}
    assert edges == sorted((keys[u], b) for _, u, _, b in rows if b)
    rules = spark.createDataFrame([("net", "/es/", "block")], "host string, path string, verdict string")
    got = urls.judge(pages, rules, urls.page_links(pages))
    assert {r.page_id: r.verdict for r in got.collect()}[1] == "block"


def test_a_query_keeps_addresses_apart(spark):
    canonical = '<link rel="canonical" href="http://b.net/es/">'
    pages = spark.createDataFrame([(1, "http://a.com.org/x?id=1", canonical), (2, "http://a.com.org/x?id=2", "")], "page_id long, url string, html string")
    rules = spark.createDataFrame([("net", "/es/", "block")], "host string, path string, verdict string")
    got = urls.judge(pages, rules, urls.page_links(pages))
    assert {r.page_id: r.verdict for r in got.collect()} == {1: "block", 2: "allow"}


def test_very_long_tags(spark):
    """A megabyte inside a tag: not closed, closed, and full of quoted values."""
    end = ' rel="canonical" href="/y">'
    for middle, closed in (("a" * (1 << 20), False), ("a" * (1 << 20), True), ('t="v" ' * 170_000, True), ("<link " * 170_000, False), ('"' + "x " * 500_000, False), ("a=" * 500_000, True)):
        start = time.time()
        assert urls.declared("canonical <link " + middle + (end if closed else "")) == (None, ["/y"] if closed else [])
        assert time.time() - start < 1
    pages = spark.createDataFrame([(1, "http://a.org/1", "canonical <link " + "a" * (1 << 20)), (2, "http://a.org/2", "<link " + 't="v" ' * 170_000 + end)], "page_id long, url string, html string")
    assert [tuple(r) for r in urls.page_links(pages).collect()] == [("a.org/2", "a.org/y")]
