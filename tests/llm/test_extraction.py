import pytest

from longbox.llm import extraction

DDL = "page_id BIGINT, url STRING, html STRING, text STRING"
WORDS = "one two three four five six seven eight nine ten"
SHELL = ('<!DOCTYPE html><html><head><meta charset="utf-8"><title>The title</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>'
         '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">All comics</a></li></ul></nav><!-- ad 0 --><div class="ad">Buy this now please.</div>'
         '{}<footer>&copy; site &middot; Some words of the footer.</footer></body></html>')


@pytest.fixture(scope="module")
def cost(spark):
    pages = [(i, "u", SHELL.format(f"<article><h1>T {i}</h1><p><b>{WORDS}<br><p>{WORDS}</p></article>"), "x") for i in range(40)]
    return extraction.learn(spark.createDataFrame(pages, DDL))


def test_weights_come_from_labelled_pages(cost):
    assert all(cost[t] < 1 for t in ("p", "h1", "b", "br")) and all(cost[t] > 40 for t in ("nav", "li", "div", "footer", "title"))


@pytest.mark.parametrize("body, wanted", [
    ("<article><h1>T</h1><p><b>a &amp; b<br><p>x&nbsp;y\n z</p><p>Short.</p></article>", "T a & b x y z Short."),
    (f"<div id=page><main><h1>Be</h1><p>{WORDS}</p><aside>see also this and that</aside><p>last</p></main></div>", f"Be {WORDS} last"),
    (f"<article><header><h1>Title</h1></header><p>{WORDS}<div class='comments'><p>First! {WORDS}</p></div></article>", f"Title {WORDS}"),
    (f"<header>Site name and slogan</header><article><p>foo<b>bar</b> {WORDS}</p><form><input name=q>search here</form><p>end</article><div class=\"cookie-notice\">We use {WORDS}</div>", f"foobar {WORDS} end"),
    (f"<article><p>{WORDS} 1 < 2 and &lt;b&gt; &amp x &a</p><script>if (a<b) {{ document.write('<p>no</p>') }}</script><p>end", f"{WORDS} 1 < 2 and <b> & x &a end"),
    ("<article></article>", ""),
])
def test_pages(cost, body, wanted):
    assert extraction.main_text(SHELL.format(body) if "footer" not in body else body, cost) == wanted


def test_the_region_has_the_largest_sum(cost):
    page = SHELL.format(f"<article><p>{WORDS}</p></article>")
    items = list(extraction.scored(page, cost))
    sums = [sum(s for s, _ in items[a:b]) for a in range(len(items)) for b in range(a, len(items) + 1)]
    text = extraction.main_text(page, cost)
    assert max(sums) == len(text.split()) and text == WORDS


def test_edge_rows(spark, cost):
    long = " ".join(f"w{i}" for i in range(50000))
    rows = [(1, "u", None, "x"), (1, "u", "", "x"), (None, None, "just words", "x"), (2, "u", f"<p>{long}", "x"), (3, "u", "<p <b", "x"), (4, "u", "<!-- open", "x"), (5, "u", "<script>x", "x"), (6, "u", "<" * 3000, "x")]
    got = extraction.extract(spark.createDataFrame(rows, DDL), cost)
    assert got.columns == ["page_id", "url", "text"]
    texts = [r["text"] for r in got.collect()]
    assert sorted(texts) == sorted(["", "", "just words", long, "<p <b", "", "", "<" * 3000])
    assert extraction.extract(spark.createDataFrame([], DDL), cost).count() == 0 and extraction.learn(spark.createDataFrame([], DDL)) == {}


def test_the_given_pages(spark):
    import html
    import re
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    cost = extraction.learn(pages)
    for row in extraction.extract(pages, cost).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"(?s)<article>(.*?)</article>", row["html"])[1]
        plain = html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", article)))
        assert row["text"] == " ".join(plain.split())


@pytest.mark.parametrize("body, wanted", [
    (f'<div class="layout no-sidebar"><article><p>{WORDS}</p></article></div>', WORDS),
    (f'<div class="has-sidebar"><article><p>{WORDS}</p></article></div>', WORDS),
    (f'<div class="sidebar"><main><p>{WORDS}</p></main></div>', WORDS),
    (f'<form id=search action="/"><div class=menu><article><p>{WORDS}</p></article></div></form>', WORDS),
    (f'<article><h2 id="related-work">Related work</h2><p>{WORDS}</p><h2 id="related">More</h2><p>a <span id="share">b</span></p></article>', f"Related work {WORDS} More a b"),
    (f'<article><p>{WORDS}</p><section id="search-trees"><p>x y</p></section><div id="notice-period"><p>{WORDS}</p></div></article>', f"{WORDS} x y {WORDS}"),
    # still left out
    (f'<article><p>{WORDS}</p><div class="post share"><p>x y</p></div><div id="comments"><p>z</p></div></article>', WORDS),
    (f'<main><article><p>{WORDS}</p></article><div id="comments"><article><p>First!</p></article></div></main>', WORDS),
    (f'<article><p>{WORDS}</p><div class="related"><article><p>See this.</p></article></div></article>', WORDS),
])
def test_only_whole_names_hide_and_never_what_holds_the_article(cost, body, wanted):
    assert extraction.main_text(SHELL.format(body), cost) == wanted


BLOCKS = [f"b{i} {WORDS} {WORDS}" for i in range(40)]


@pytest.mark.parametrize("body, wanted", [
    # pages that do not mark their content
    ("".join(f"<div>{b}</div>" for b in BLOCKS), " ".join(BLOCKS)),
    (f"<p>{BLOCKS[0]}</p><ul><li>x</li><li>y z</li></ul><p>{BLOCKS[1]}</p><p>{BLOCKS[2]}</p>", f"{BLOCKS[0]} x y z {BLOCKS[1]} {BLOCKS[2]}"),
    (f"<section><h2>A</h2><p>{BLOCKS[0]}</p></section><section><h2>B</h2><p>{BLOCKS[1]}</p></section>", f"A {BLOCKS[0]} B {BLOCKS[1]}"),
    # compound names of adverts, notices and comments
    *[(f"<article><p>{WORDS}</p><div {a}><p>BUY NOW</p></div><p>end</p></article>", f"{WORDS} end") for a in (
        'class="ad-slot"', 'class="comment-list"', 'class="cookie-notice"', 'class="post-comments"', 'id="user-comments"', 'id=adSlot', 'class="x ad_unit"')],
    *[(f"<article><p>{WORDS}</p><section {a}><p>x y</p></section></article>", f"{WORDS} x y") for a in (
        'class="no-ads"', 'id="ad-hoc-networks"', 'class="has-comments"', 'id="cookie-recipes"', 'id="notice-period"')],
])
def test_unmarked_pages_and_compound_names(cost, body, wanted):
    assert extraction.main_text(SHELL.format(body), cost) == wanted


@pytest.mark.parametrize("page", ["<a " * 40000, "<a b='" * 40000, "<div>" * 40000, '<a ">" ' * 40001, "<" * 100000, "<div>" * 20000 + "</p>" * 20000,
                                  "<article>" * 20000 + "<main>" * 20000, "<!-- <a>" * 30000, "<script></x>" * 20000])
def test_odd_pages_take_linear_time(cost, page):
    import time
    started = time.process_time()
    extraction.main_text(page, cost)
    assert time.process_time() - started < 3
