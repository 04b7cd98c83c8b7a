import html
import re

import pytest

from quernel.llm import html_extraction as H


def simple(page):
    found = re.search(r"<article>(.*?)(?:</article>|$)", page or "", re.S)
    blocks = re.split(r"</?(?:p|h1)>", found[1]) if found else []
    out = [" ".join(html.unescape(re.sub(r"</?b>", "", re.sub("<br>", " ", b))).split()) for b in blocks]
    return "\n".join(b for b in out if b)


def test_query_equals_brute_force(spark, sf):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = H.op10_html_extraction(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]]["url"], simple(pages[r["page_id"]]["html"]), len(r["text"]))


def site(i):
    return f"""<html><head><title>t</title><style>p{{}}</style></head><body><div class="top-nav"><a href="/">Home</a></div>
    <div id="c{i}"><div class="post"><h2>Title {i}</h2><p>First {i} &amp; <b>more</b><br>text &#233; &lt;x&gt;</p><p>Second   {i}<ul><li>a{i}<li>b{i}</ul><p>Share this</p></div>
    <div class="comments"><p>nice {i}</p></div></div><div class="sidebar"><p>about {i}</p></div><form><input>Search</form><script>var a = "</p>";</script><footer>c</footer></body></html>"""


@pytest.mark.parametrize("copies", [1, 6])
def test_wrapper_without_an_article_element(spark, copies):
    rows = [(i, "http://a.example/x", site(i)) for i in range(6)] + [(90, None, None), (91, "x", ""), (92, "http://b.example/", site(0)), (93, "http://b.example/", "<p>unclosed <b>text"), (93, "http://b.example/", "<p>unclosed <b>text")]
    pages = spark.createDataFrame(rows * copies, "page_id long, url string, html string")
    got = {}
    for r in H.extract_pages(pages).collect():
        got.setdefault(r["page_id"], set()).add(r["text"])
    want = lambda i: f"Title {i}\nFirst {i} & more text é <x>\nSecond {i}\na{i}\nb{i}"
    assert all(got[i] == {want(i)} for i in range(6))  # 'Share this' belongs to the template
    assert got[90] == {""} and got[91] == {""} and got[93] == {"unclosed text"}
    assert got[92] == {want(0) + "\nShare this"}  # one page shows no template


def test_folding_and_alignment():
    def wrapper(page):
        return H.expression(H.parse(page))

    one, two = wrapper("<ul><li>a</ul><p>x</p>"), wrapper("<ul><li>a<li>b<li>c</ul><h2>t</h2><p>y</p><h2>t</h2><p>z</p>")
    merged = H.merge(one, two)
    labels = [(n[H.LABEL], n[H.PLUS], n[H.OPTIONAL]) for n in merged[H.CHILDREN]]
    assert labels == [("ul", False, False), ("h2", True, True), ("p", True, False)]
    assert merged[H.CHILDREN][0][H.CHILDREN][0][H.PLUS]
    assert merged[H.CHILDREN][1][H.TEXT] == "t" and merged[H.CHILDREN][2][H.TEXT] is None


@pytest.mark.parametrize("page", ["<", "<a", "<!--", "<!-- x", "<p", "<p class='", '<p class="a>b</p>', "</p></div>", "<script>", "<b" * 50, "&#x110000; &bogus; &amp", "<div>" * 500 + "x", "<p>a<!-- c --><![CDATA[ d ]]>b</p>"])
def test_broken_markup_does_not_fail(page):
    assert isinstance(H.extract(page, None), str)


def test_empty_table(spark):
    assert H.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


SIDE = '<div class="sidebar"><p>about {i}</p></div><div class="comments"><p>a comment of some length about {i}</p></div>'
SHELLS = {
    "body": '<body class="no-sidebar"><div><article><h1>Title {i}</h1><p>Text {i}</p></article></div>' + SIDE + "</body>",
    "layout": '<body><div class="layout has-sidebar"><article><h1>Title {i}</h1><p>Text {i}</p></article>' + SIDE + "</div></body>",
    "id": '<body><div id="search-page"><article><h1>Title {i}</h1><p>Text {i}</p></article></div>' + SIDE + "</body>",
    "article": '<body><article class="post has-comments"><h1>Title {i}</h1><p>Text {i}</p></article>' + SIDE + "</body>",
    "inner": '<body><main><article class="post comments-open social"><h1>Title {i}</h1><p>Text {i}</p></article>' + SIDE + "</main></body>",
    "right": '<body><div class="content right-sidebar"><article><h1>Title {i}</h1><p>Text {i}</p></article>' + SIDE + "</div></body>",
    "nested": '<body class="menu"><div class="overlay"><div class="widget"><h1>Title {i}</h1><p>Text {i}</p></div></div>' + SIDE + "</body>",
    "form": '<body><form id="page"><div><article><h1>Title {i}</h1><p>Text {i}</p></article></div></form></body>',
    "both": '<html class="no-search"><body class="home comments"><div class="header-layout"><div>Title {i}<p>Text {i}</p></div></div>' + SIDE + "</body></html>",
}


@pytest.mark.parametrize("shell", SHELLS)
@pytest.mark.parametrize("n", [1, 7])
def test_marked_containers_of_the_main_text(spark, shell, n):
    pages = spark.createDataFrame([(i, "http://a.example/x", SHELLS[shell].replace("{i}", f"{i}" * 9)) for i in range(n)], "page_id long, url string, html string")
    for r in H.extract_pages(pages).collect():
        name = f"{r['page_id']}" * 9
        assert r["text"] == f"Title {name}\nText {name}"


def test_long_comments_stay_out():
    talk = "".join(f"<article><p>comment {k} of many on {{i}}</p></article>" for k in range(30))
    for post in ('<div class="post"><p>Text {i}</p></div>', "<article><p>Text {i}</p></article>"):
        for kind in ("comments", "comment-list"):
            page = f'<body>{post}<div class="{kind}">{talk}</div><div class="related"><p>{"More " * 9}</p></div></body>'
            wrapper = None
            for i in range(6):
                new = H.expression(H.parse(page.replace("{i}", str(i))))
                wrapper = H.merge(wrapper, new) if wrapper else new
            for rule in (H.rule_of(wrapper), None):
                assert H.extract(page.replace("{i}", "3"), rule) == "Text 3"


def test_page_without_main_text_does_not_take_its_sidebar():
    page = '<body><article></article><div class="sidebar"><p>about us</p></div><div class="cookie-notice">We use cookies</div></body>'
    assert H.extract(page, None) == ""


@pytest.mark.parametrize("bad", [[], [None], [""], ["<p>unclosed"], ["plain"], ["<html><head></head></html>"], [None, "", "cut"]])
def test_template_text_of_any_length_goes_despite_broken_pages(spark, bad):
    notice, short = "Nothing here is <b>advice</b>. " * 40, "All rights reserved"
    page = '<html><body><div class="x"><article><h1>Title {i}</h1><p>Text {i} ' + "word{i} " * 50 + f"</p><div>{notice}</div><section>{short}<ul><li>a{{i}}</ul>The end</section></article></div></body></html>"
    pages = [page.replace("{i}", str(i)) for i in range(12)]
    rows = [(i, "http://a.example/x", p) for i, p in enumerate(pages)] + [(90 + k, "http://a.example/y", pages[0][: pages[0].index("Nothing") + 99] if p == "cut" else p) for k, p in enumerate(bad)]
    got = {r["page_id"]: r["text"] for r in H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert got[i] == f"Title {i}\nText {i} " + " ".join([f"word{i}"] * 50) + f"\na{i}"


def test_common_text_is_judged_alike_in_any_order():
    pages = ["<article><h1>Title %d</h1><p>%s</p></article>" % (i, "same " * 99 if i % 20 else f"other {i}") for i in range(100)]
    for step in (1, 7, 33):
        parts = []
        for first in range(step):
            held = None
            for page in pages[first::step]:
                new = H.expression(H.parse(page))
                held = H.merge(held, new) if held else new
            parts.append(held)
        wrapper = parts[0]
        for part in parts[1:]:
            wrapper = H.merge(wrapper, part)
        rule = H.rule_of(wrapper)
        assert H.extract(pages[1], rule) == "Title 1" and H.extract(pages[20], rule) == "Title 20\nother 20"
    varied = None
    for i in range(100):
        new = H.expression(H.parse("<article><h1>T%d</h1><p>%s</p></article>" % (i, "yes" if i % 3 else "no")))
        varied = H.merge(varied, new) if varied else new
    assert H.extract("<article><h1>T1</h1><p>yes</p></article>", H.rule_of(varied)) == "T1\nyes"


def rule_from(pages):
    held = None
    for page in pages:
        new = H.expression(H.parse(page))
        held = H.merge(held, new) if held else new
    return H.rule_of(held)


@pytest.mark.parametrize("depth", [100, 149, 150, 160, 400])
def test_marked_elements_go_at_any_depth(depth):
    page = "<body>" + "<div>" * depth + '<p>main {i}</p><div class="comments"><div>reader <p>comment</p></div></div><p>more {i}</p><aside>x</aside>' + "</div>" * depth + "<p>end {i}</p></body>"
    pages = [page.replace("{i}", f"{k}" * 20) for k in range(6)]
    want = lambda k: "\n".join(f"{w} " + f"{k}" * 20 for w in ("main", "more", "end"))
    assert H.extract(pages[3], rule_from(pages)) == want(3) and H.extract(pages[3], None) == want(3)


def test_region_follows_the_mass_of_the_slots_not_the_tag():
    """An article that holds a fixed teaser loses to the container of the varying text."""
    page = '<body><div class="left"><article><h3>Welcome</h3><p>Our site</p></article></div><div class="text"><h1>Title {i}</h1><p>{long}</p><p>More {i}</p></div></body>'
    pages = [page.replace("{i}", str(k)).replace("{long}", f"word{k} " * 40) for k in range(8)]
    for k, page in enumerate(pages):
        assert H.extract(page, rule_from(pages)) == f"Title {k}\n" + " ".join([f"word{k}"] * 40) + f"\nMore {k}"


@pytest.mark.parametrize("kind", ["search results", "widget promo", "share"])
def test_misleading_names_of_the_only_text(kind):
    pages = [f'<body><nav>menu</nav><div class="{kind}"><h2>Title {k}</h2><p>Text {k} of the page</p></div><footer>f</footer></body>' for k in range(5)]
    rule = rule_from(pages)
    for k, page in enumerate(pages):
        assert H.extract(page, rule) == f"Title {k}\nText {k} of the page"


def test_template_text_on_hosts_of_every_size():
    """One rule for all sizes: three pages are too few to call a text the template's, four are enough."""
    for n in (1, 2, 3, 4, 5, 40):
        pages = [f"<article><h1>Title {k}</h1><div>{'Same on all. ' * 20}</div><p>Text {k}</p></article>" for k in range(n)]
        got = H.extract(pages[0], rule_from(pages))
        assert ("Same on all" in got) == (n < 4) and got.startswith("Title 0") and got.endswith("Text 0")


def test_common_lengths_equal_brute_force():
    import random

    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        best = H.common_lengths(a, b)
        slow = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                slow[i][j] = slow[i + 1][j + 1] + 1 if a[i] == b[j] else max(slow[i + 1][j], slow[i][j + 1])
        assert best.tolist() == slow


def test_pages_of_many_siblings_are_aligned_in_time():
    import time

    pages = ["".join(f'<div class="{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}{x}">t</div>' for k in range(4000)) for x in "ab"]
    began = time.time()
    rule_from(pages)
    assert time.time() - began < 20


def test_very_long_page_and_clashing_columns(spark):
    page = "<article><h1>T</h1>" + "<p>" + "long text &amp; more " * 100_000 + "</p></article>"
    rows = spark.createDataFrame([(1, "http://a.example/", page, "x", 5, None)], "page_id long, url string, html string, host string, salt int, rule string")
    got = H.extract_pages(rows).first()
    assert got["text"] == "T\n" + ("long text & more " * 100_000).strip()


KEPT = [  # (what stands in the article, what has to stay of it, what has to go)
    ('<section id="discussion"><h2>Discussion</h2><p>We discuss result {i}.</p></section>', ["Discussion", "We discuss result {i}."], []),
    ('<h2 id="related-work">Related work</h2><p>Others did {i}.</p>', ["Related work", "Others did {i}."], []),
    ('<pre><code>x = {i} <span class="hljs-comment"># set x to 3</span></code></pre>', ["x = {i} # set x to 3"], []),
    ('<p class="side-effects">Side effects of {i}.</p>', ["Side effects of {i}."], []),
    ('<div class="dialog"><p>Who is number {i}?</p></div>', ["Who is number {i}?"], []),
    ('<p>Find <b class="search">term{i}</b> in a text.</p>', ["Find term{i} in a text."], []),
    ('<h2>Ingredients</h2><p>Flour {i}</p><h2>Method</h2><p>Stir {i}</p>', ["Ingredients", "Flour {i}", "Method", "Stir {i}"], []),
    ("<p>The energy <math><mi>E</mi><mo>=</mo><mi>m</mi></math> joule {i}</p>", ["The energy E=m joule {i}"], []),
    ('<p>Before <span class="ad">Buy {i}</span> after.</p>', ["Before after."], ["Buy"]),
    ('<div class="cmt-list"><p>Reader {i} says no.</p></div>', [], ["Reader"]),
    ('<div id="feedback"><p>Send us {i}.</p></div>', [], ["Send us"]),
    ('<div role="dialog"><p>Accept {i}?</p></div>', [], ["Accept"]),
    ('<p class="share-links">Share {i}</p>', [], ["Share"]),
]


@pytest.mark.parametrize("count", [1, 3, 12])
@pytest.mark.parametrize("extra, stays, goes", KEPT)
def test_text_of_the_article_stays(count, extra, stays, goes):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    pages = []
    for i in range(count):
        text = " ".join(f"{w}{i}{k}" for k in range(8) for w in words)
        pages.append(f'<html><body><nav>Home</nav><article><h1>Title {i}</h1><p>{text}</p>{extra.replace("{i}", str(i))}<p>Last {i} words.</p></article><footer>f</footer></body></html>')
    for order in (pages, pages[::-1]):
        wrapper = None
        for page in order:
            tree = H.expression(H.parse(page))
            wrapper = tree if wrapper is None else H.merge(wrapper, tree)
        rule = H.rule_of(wrapper)
        for i, page in enumerate(pages):
            lines = H.extract(page, rule).split("\n")
            assert [b for b in lines if b in [s.replace("{i}", str(i)) for s in stays]] == [s.replace("{i}", str(i)) for s in stays], lines
            assert not any(g in line for g in goes for line in lines), lines
            assert lines[0] == f"Title {i}" and lines[-1] == f"Last {i} words."
