"""Verdicts against the SQL and planted aliases."""

from urllib.parse import urljoin

import duckdb
import pandas as pd

from orelode.llm import url_filters

ROWS = [
    (1, "https://www.EXAMPLE.com/en/1", ""),
    (2, "https://a.b.example.com/en/x?y=1", ""),
    (3, "http://example.net/es/", ""),
    (4, "http://net/fr/", ""),
    (5, "http://xnet/fr/", ""),
    (6, None, None),
    (7, "no scheme/en/", "<link rel=canonical href='http://q.example.org/c'>"),
    (8, "http://q.example.org/alias", '<head><link href="http://z.example.net/es/1" rel="canonical"></head>'),
    (9, "http://q.example.org/other", '<meta http-equiv="refresh" content="0; URL=/alias">'),
    (10, "http://q.example.org/third", '<LINK rel="canonical" href="//q.example.org/other">'),
    (11, "http://r.example.org/x", '<link rel="canonical" href="http://y.example.net/fr/9">'),
    (12, "http://t.example.com/fr/ok", '<link rel="canonical" href="http://r.example.org/x">'),
    (13, "http://s.example.org/self", '<link rel="canonical" href="http://s.example.org/self">'),
    (14, "ftp://example.com", ""),
    (15, "http://example.com?x=/en/", ""),
    (16, "http://clean.example.org/a#://b", '<link rel="canonical" href="http://clean.example.org/a">'),
    (16, "http://clean.example.org/a#://b", '<link rel="canonical" href="http://clean.example.org/a">'),
    (None, "http://q.example.org/third", ""),
]


def by_sql(rows):
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
    return [tuple(r) for r in con.execute(url_filters.SQL).fetchall()]


def test_verdicts(spark):
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, rule string")
    got = [tuple(r) for r in url_filters.judged(pages).collect()]
    assert sorted(map(str, got)) == sorted(map(str, by_sql(ROWS)))
    verdict = {r[0]: r[4] for r in got}
    assert [verdict[k] for k in (1, 2, 3, 4, 5, 6)] == ["allow", "block", "block", "block", "allow", "allow"]
    assert [verdict[k] for k in (8, 9, 10, None)] == ["block"] * 4  # aliases of a blocked page
    assert verdict[11] == verdict[12] == "allow"  # an explicit allow in the class
    assert url_filters.judged(pages.limit(0)).collect() == []


def test_given_redirects(spark):
    pages = spark.createDataFrame([(1, "http://u.example.org/1", None)], "page_id long, url string, html string")
    edges = spark.createDataFrame([("http://u.example.org/1", "http://v.example.org/2"), ("http://v.example.org/2", "http://example.net/es/"), (None, "x")], "a string, b string")
    assert url_filters.judged(pages, edges).first().verdict == "block"


def test_relative_and_further_links(spark):
    page, no = "http://h.example.org/a/b/c?q=1#f", "no url"
    links = ["page2.html", "../x", "../../../x/", "?p=1", "./", "..", "d/../e?u=http://z/", "/r/../s", "//o.example.org/x", "http://o.example.org/./y", "g?a=1&amp;b=2", "#top"]
    rows = [(page, f'<link rel="canonical" href="{x}">') for x in links] + [(page, f'<meta http-equiv="refresh" content="0; url={x}">') for x in links]
    rows += [("http://h.example.org", '<link rel=canonical href="k"><link rel=canonical href="?p=1">'), (no, "<link rel=canonical href=k>"), (page, "<link rel=canonical href='mailto:x'>"), (page, None), (None, "<link rel=canonical href=k>")]
    got = sorted(map(tuple, url_filters.page_links(spark.createDataFrame(rows, "url string, html string")).collect()))
    want = [(page, urljoin(page, x.replace("&amp;", "&"))) for x in links if not x.startswith("http")] * 2 + [(page, "http://o.example.org/./y")] * 2
    assert got == sorted([*want, ("http://h.example.org", "http://h.example.org/k"), ("http://h.example.org", "http://h.example.org?p=1")])
    canonical, refresh = '<link rel="canonical" href="%s">', '<meta http-equiv="refresh" content="0; url=%s">'
    pages = [
        (1, "http://a.example.net/x/1", canonical % "../es/1"),
        (2, "http://u.example.org/2", canonical % "http://u.example.org/3" + canonical % "http://b.example.net/es/2"),
        (3, "http://v.example.org/2", refresh % "http://v.example.org/3" + refresh % "http://b.example.net/es/3"),
        (4, "http://w.example.org/d/?p=1", canonical % "?p=2"),
        (5, "http://w.example.org/d/?p=2", canonical % "http://b.example.net/fr/"),
        (6, "http://x.example.org/", canonical % "es/1"),
    ]
    verdict = {r.page_id: r.verdict for r in url_filters.judged(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert verdict == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow"}
    assert verdict == {r[0]: r[4] for r in by_sql(pages)}


def test_odd_tags_in_query_and_sql(spark):
    """What is a link, what isn't, and what it is resolved against: the query and the SQL agree on each."""
    blocked, canonical = "http://b.example.net/es/", '<link rel="canonical" href="%s">'
    pages = [
        ('<link rel="canonical" data-href="http://b.example.net/es/" href="http://u.example.org/x">', "allow"),
        ('<link rel=canonical data-href="http://b.example.net/es/">', "allow"),
        (f'<link href="{blocked}" rel="nofollow canonical">', "block"),
        (f"<link rel='canonical next' href='  {blocked}\n'>", "block"),
        (f'<link rel="canonical-x" href="{blocked}">', "allow"),
        (f"<!-- {canonical % blocked} -->", "allow"),
        (f"<script>var x = '{canonical % blocked}'</script>", "allow"),
        (f"<base href='http://b.example.net/'>{canonical % 'es/1'}", "block"),
        (f"<base target=_top><base href='/es/'>{canonical % 'http://x.example.org/'}", "allow"),
        (f"<BASE HREF=//b.example.net/fr/x><meta http-equiv=refresh content='3; URL=y'>", "block"),
        (f"<meta http-equiv=refresh content='0;url={blocked}'>", "block"),
        (f'<meta content="0; url=\'{blocked}\'" http-equiv="Refresh">', "block"),
        (f'<meta name="refresh" content="0; url={blocked}">', "allow"),
        (f'<link rel="canonical" href="{blocked}', "allow"),
        (f"{canonical % 'http://k.example.org/1'}{canonical % '../../b/./c/..'}{canonical % blocked}", "block"),
        ("<link rel=canonical href=>", "allow"),
    ]
    rows = [(i, f"http://p{i}.example.org/a/b?q", html) for i, (html, _) in enumerate(pages)]
    got = {r.page_id: r.verdict for r in url_filters.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {r[0]: r[4] for r in by_sql(rows)}
    assert got == dict(enumerate(v for _, v in pages))
