"""Main text of planted pages, the cut against all labellings, and odd markup."""

import random
import re
import time
from html import unescape
from itertools import product

import pytest

from orelode.llm import html_text as H
from orelode.llm import page_samples as S

P1 = "It was a long day on the river, and the boats came in one by one as the light went down over the hills."
P2 = "Nobody spoke. The second paragraph has a <a href='/x'>link</a>, an &eacute;, and 3 &lt; 4 &amp; more."
W2 = "Nobody spoke. The second paragraph has a link, an é, and 3 < 4 & more."
NAV = "<nav><ul><li><a href=/a>Home</a><li><a href=/b>About us and our long story</a></ul></nav>"
PAGES = [
    (f"{NAV}<article><h1>Title</h1><p>{P1}</p><p>{P2}</p></article><footer>&copy; us</footer>", ["Title", P1, W2]),
    (f"<div id=header><a href=/>Logo</a></div><div class='sidebar'><p>{P1}</p></div><div id=content><h1>Title</h1><p>{P1}<p>{P2}</div><div class=footer>All rights reserved, {P1}</div>", ["Title", P1, W2]),
    (f"<main><h1>Title</h1><div class='ad-slot advert'>Buy now, {P1}</div><p>{P1}</p><aside><h2>See also</h2><p>{P1}</p></aside><p>Short one.</p></main>", ["Title", P1, "Short one."]),
    (f"<article><h1>Title</h1><p>{P1}</p><section id=comments><h2>Comments</h2><article><p>{P1}</p></article></section></article>", ["Title", P1]),
    (f"<article><h1>Title</h1><p>{P1}</p><form><label>Your mail</label><input><p>Subscribe for more of this, it is free.</p><button>Go</button></form></article><div class='cookie-notice'><p>{P1}</p></div>", ["Title", P1]),
    (f"<body><article><h1>Title</h1><p><b>{P1}<br><p>{P2}</p></article>", ["Title", P1, W2]),
    (f"<article><h1>Title</h1><ul><li>{P1}</li><li>Two</li></ul><table><tr><td>a</td><td>b</td></tr></table><pre>x\n  y</pre></article>", ["Title", P1, "Two", "a", "b", "x y"]),
    (f"<p hidden>{P1}</p><main><p style='display: none'>{P1}</p><p>{P1}</p></main>", [P1]),
    ("<script>var a='<article><p>no</p></article>'</script><style>p{}</style><!-- <p>no</p> --><title>no</title>", []),
    (f"{NAV}<footer>{P1}</footer>", []),
    ("", []),
    (f"<article><p>{P1}", [P1]),
    (f'<article><p title="a > b">{P1}</p><p title=\'x>y {P1}</p></article>', [P1, f"y {P1}"]),  # a quote that nothing closes ends its tag at the next >
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_pages(page, want):
    assert H.main_text(page).split("\n") == (want or [""])


def test_without_marks():
    """No semantic tags and no telling names: link density and lengths decide."""
    menu = "<div>" + "".join(f"<a href=/{i}>Item {i}</a> " for i in range(12)) + "</div>"
    page = f"<body>{menu}<div><h1>A title of some words</h1><p>{P1}</p><p>{P1} Again.</p><p>{P1} And on.</p></div>{menu}</body>"
    got = H.main_text(page)
    assert P1 in got and "Item 3" not in got


def test_broken_markup():
    rng = random.Random(1)
    parts = ["<p>", "</p>", "<div", ">", "<a href='", '"', "</article>", "<article>", "&amp", "&#x41;", "<!--", "-->", "text ", "<script>", "</script>", "<br/>", "<li>", "</ul>", "<", "&", "<![CDATA[", "]]>", "<?x"]
    for _ in range(500):
        H.main_text("".join(rng.choices(parts, k=rng.randrange(60))))
    assert "x" in H.main_text("<article>" + "<p>x</p>" * 3000)
    H.main_text("<div>" * 20_000 + "x")
    H.main_text('<a title="' * 3000)


def test_cut_is_least():
    rng = random.Random(2)
    for _ in range(150):
        n = rng.randrange(1, 9)
        source, sink = [rng.random() * 2 for _ in range(n)], [rng.random() * 2 for _ in range(n)]
        links = {(i, j): rng.random() * 1.5 for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}

        def cost(side, source=source, sink=sink, links=links):
            return sum(b if s else a for s, a, b in zip(side, source, sink, strict=True)) + sum(w for (i, j), w in links.items() if side[i] != side[j])

        got = H.minimum_cut(source, sink, links)
        assert cost(got) == pytest.approx(min(cost(s) for s in product((False, True), repeat=n)))


def test_whole_pages_against_all_labellings():
    """Costs, edges and the cut together: no labelling of a page's blocks costs less than the one returned."""
    rng, done = random.Random(4), 0
    for source in S.pages(31, 150):
        made, has_main = H.whole(source)
        if not 2 <= (n := len(made.blocks)) <= 12:
            continue
        weights = tuple(tuple(w * rng.choice((0.2, 1)) for w in own) for own in H.fitted())  # unsure ones too, where edges decide
        cost = [H.costs(H.odds(b, has_main, made.root.prose, weights[has_main])) for b in made.blocks]
        links = H.edges(made.blocks)

        def energy(side, cost=cost, links=links):
            return sum(c[1] if s else c[0] for s, c in zip(side, cost, strict=True)) + sum(w for (i, j), w in links.items() if side[i] != side[j])

        got = [keep for _, keep in H.labelled(source, weights)]
        assert energy(got) == pytest.approx(min(energy(s) for s in product((False, True), repeat=n)))
        done += 1
    assert done > 20


@pytest.mark.parametrize("outer", ["no-sidebar", "page-with-side-nav", "header-fixed", "social-history", "post-header", "page-notice", "sidebar-layout", "sidebar", "has-menu"])
def test_names_around_the_article(outer):
    body = f"<h1>Title</h1><p>{P1}</p><p>{P1} More.</p>"
    want = f"Title\n{P1}\n{P1} More."
    for page in (f'<div class="{outer}"><article>{body}</article></div>', f'<div class="{outer}">{NAV}{body}</div>', f'{NAV}<article class="{outer}">{body}</article><footer>{P1}</footer>', f'<body class="{outer}"><main>{body}</main></body>'):
        assert H.main_text(page) == want


def test_nothing_else_goes():
    """Formulas, fallbacks and marked-up words inside the article stay."""
    page = f"<article><p>where <math><mi>E</mi>=<mi>mc</mi></math> holds, <span aria-hidden=true>as</span> said</p><noscript><p>{P1}</p></noscript><object><p>{P1}</p></object></article>"
    assert H.main_text(page) == f"where E=mc holds, as said\n{P1}\n{P1}"


#: Layouts that the generator doesn't know, with their content as C and all else as B blocks.
LAYOUTS = [
    "<body class='home blog logged-out'><div id=page class='hfeed site'><header id=masthead class=site-header><p class=site-title><a href=/>B</a></p><nav id=site-navigation><div class=menu-main-container><ul><li><a>B</a></li><li><a>B</a></li><li><a>B</a></li></ul></div></nav></header><div id=content class=site-content><div id=primary class=content-area><main><article class='post-1 type-post hentry category-news tag-social'><header class=entry-header><h1>C</h1></header><div class=entry-content><p>C</p><p>C</p><h2>C</h2><ul><li>C</li><li>C</li></ul><p>C</p></div><footer class=entry-footer><span class=cat-links>B</span></footer></article><div id=comments class=comments-area><h2>B</h2><ol class=comment-list><li><article><p>B</p></article></li><li><article><p>B</p></article></li></ol></div></main></div><aside id=secondary class=widget-area><section class=widget><h2>B</h2><ul><li><a>B</a></li></ul></section></aside></div><footer id=colophon><div class=site-info>B</div></footer></div></body>",
    "<table width=100%><tr><td colspan=2><a>B</a> | <a>B</a> | <a>B</a></td></tr><tr><td width=150><a>B</a><br><a>B</a><br><a>B</a></td><td><h1>C</h1><p>C</p><p>C</p><p>C</p></td></tr><tr><td colspan=2><font size=1>B</font></td></tr></table>",
    "<div class=md-container><div class='md-sidebar md-sidebar--primary'><nav class=md-nav><ul><li><a>B</a></li><li><a>B</a></li><li><a>B</a></li></ul></nav></div><div class=md-content><article class='md-content__inner md-typeset'><h1>C</h1><p>C</p><pre>C</pre><h2>C</h2><p>C</p><table><tr><th>C</th><th>C</th></tr><tr><td>C</td><td>C</td></tr></table><blockquote>C</blockquote></article></div></div><footer class=md-footer><a>B</a><div class=md-copyright>B</div></footer>",
    "<div id=app><div class=topbar-outer><a>B</a><a>B</a></div><div class=css-1x2y><div class=css-9z><h1>C</h1><div class=css-byline>C</div><div class=css-p>C</div><div class=css-p>C</div><div class=css-p>C</div><div class=css-p>C</div></div><div class=css-rail><div>B</div><a>B</a><a>B</a><a>B</a></div></div><div class=css-legal>B</div></div>",
    "<main id=main role=main><section class=hero><h1>C</h1><p>C</p></section><section><h2>C</h2><p>C</p><div class=advertisement data-slot=3><p>B</p></div><p>C</p><figure><figcaption>C</figcaption></figure><p>C</p></section><section class=newsletter-signup><h3>B</h3><form><p>B</p></form></section><section aria-label=Related class=related-stories><h2>B</h2><ul><li><a>B</a></li><li><a>B</a></li></ul></section></main>",
    "<div class=forum><div class=breadcrumbs><a>B</a> &gt; <a>B</a></div><div class=story><h2>C</h2><p>C</p><p>C</p></div><div id=disqus_thread><div class=comment-body>B</div><div class=comment-body>B</div></div></div><div class=gdpr-consent role=dialog><p>B</p></div>",
    "<div class='layout layout--two-col'><div class=layout__main><div class=story-body><h1>C</h1><p>C</p><p>C</p><div class=share-tools><a>B</a><a>B</a></div><p>C</p><p>C</p></div></div><div class=layout__aside><div class=most-popular><h2>B</h2><ol><li><a>B</a></li><li><a>B</a></li><li><a>B</a></li></ol></div></div></div><div class=page-footer><p>B</p></div>",
    "<nav aria-label=Breadcrumb><ol><li><a>B</a></li><li><a>B</a></li></ol></nav><article itemscope class='product-review has-sidebar'><header><h1>C</h1><p>C</p></header><p>C</p><p>C</p><aside class=pullquote><p>B</p></aside><p>C</p></article><section id=reader-reviews class=reviews><h2>B</h2><div class=review><p>B</p></div></section>",
]


def test_held_out_layouts():
    """Characters of content kept, and of what is kept, over layouts that the classifier wasn't fitted on."""
    rng, hit, kept, there = random.Random(8), 0, 0, 0
    maker = S.Maker(rng)
    for layout in LAYOUTS * 25:
        texts = {}

        def fill(m, texts=texts, layout=layout):
            tag = layout[: m.start()].rsplit("<", 1)[1].split(">")[0].split()[0]
            short = tag[0] == "h" and tag[1:].isdigit() or tag in ("a", "td", "th", "span")
            text = " ".join(maker.words(rng.randrange(1, 7)).split()) if short else " ".join(maker.sentence() for _ in range(rng.choice((1, 1, 2, 4, 6))))
            texts[text] = m[0]
            return text

        page = re.sub(r"(?<=>)[BC](?=<)", fill, layout)
        got = H.main_text(page).split("\n")
        there += sum(len(t) for t, k in texts.items() if k == "C")
        kept += sum(map(len, got))
        hit += sum(len(t) for t in got if texts.get(t) == "C")
    precision, recall = hit / kept, hit / there
    print(f"held out: precision {precision:.3f}, recall {recall:.3f}")
    assert precision > 0.95 and recall > 0.95


@pytest.mark.parametrize("part", ["<a ", "<div>x", '<a title="', '<a ">" ', "<li><a>x", "<span>", "<!--", "<", "</", "<i><hr>", "<a '\">"])
def test_time_grows_with_the_page(part):
    began = time.perf_counter()
    H.main_text(part * (300_000 // len(part)))
    assert time.perf_counter() - began < 5  # seconds; a quadratic parser takes minutes


def test_rows(spark):
    rows = [(i, f"http://e.org/{i}", p, "x") for i, (p, _) in enumerate(PAGES)] + [(None, None, None, "x"), (0, "http://e.org/0", PAGES[0][0], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url): r.text for r in H.extracted(pages).collect()}
    assert got == {(i, f"http://e.org/{i}"): "\n".join(w) for i, (_, w) in enumerate(PAGES)} | {(None, None): ""}
    assert H.extracted(pages).count() == len(rows) and H.extracted(pages.limit(0)).collect() == []


def test_the_small_table(spark):
    """Whole articles of the test pages, read off their markup."""
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        article = re.search("<article>(.*)</article>", r.html, re.DOTALL)[1]
        blocks = [" ".join(unescape(b.replace("<br>", " ").replace("<b>", "")).split()) for b in re.split("</?(?:h1|p)>", article)]
        assert H.main_text(r.html) == "\n".join(b for b in blocks if b)


def test_names_are_read_whole():
    """However many names an attribute has, and however long they are."""
    many = " ".join(f"n{i}" for i in range(500))
    assert H.hints("div", f'class="{many} sidebar"') == H.hints("div", 'class="sidebar"') != 0
    assert H.hints("div", f'class="{"x" * 5000}-sidebar"') == H.hints("div", 'class="x-sidebar"') != 0
