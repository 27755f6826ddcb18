"""Main text of hand-made pages, and templates over a host's pages."""

import random
import time
from collections import Counter
from xml.etree import ElementTree

import pytest

from chartula.llm.html_text import Page, main_text


def text(html):
    return "\n\n".join(Page(html).texts)


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>one<p>two<br>lines\n here", "one\n\ntwo lines here"),
        ("<p>a <b>bold<p>next</b> end", "a bold\n\nnext end"),
        ("<ul><li>one<li>two</ul>", "one\n\ntwo"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"),
        ("<title>t</title><script>if (a < b) '</p>'</script><style>p{}</style><p>x</p>", "x"),
        ("<nav>menu</nav><header>top</header><article><header><h1>Title</h1></header><p>x</article><footer>end</footer>", "Title\n\nx"),
        ("<div class='with-sidebar'><article><p>x</p></article><div class='sidebar'>s</div></div>", "x"),
        ("<div class='ad'>buy</div><p>x<div id='cookieNotice'>c</div><form><p>f</p></form>", "x"),
        ("<main><p>x</p><section class='comments'><article><p>reader</p></article></section></main>", "x"),
        ("<div class='added'>kept</div><div class='shadow'>too</div>", "kept\n\ntoo"),
        ("<p hidden>h</p><p style='display: none'>n</p><p>x &lt;b&gt; &eacute;&#233;&nbsp;y</p>", "x <b> éé y"),
        ("<p>x</p><!-- c --><p>a < b</p></div></p>", "x\n\na < b"),
        ("<div><div><p>deep", "deep"),
    ],
)
def test_page(html, want):
    assert text(html) == want


def test_template_of_a_site(spark):
    def page(n):
        return f"<div><p>Brought to you by the site</p></div><div><p>Story {n}</p><p>{'Shared' if n % 3 == 0 else n}</p></div>"

    rows = [(n, f"http://Site.example/{n}", page(n), "x") for n in range(12)] + [(20, "http://small.example/", page(20), "x"), (21, None, page(21), "x"), (22, "http://site.example/x", None, "x"), (None, "nonsense", "<p>y", "x")]
    pages = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string, host string")
    out = {r.page_id: r for r in main_text(pages).collect()}
    assert out[1].text == "Story 1\n\n1" and out[3].text == "Story 3\n\nShared"
    assert out[20].text.startswith("Brought") and out[21].text.startswith("Brought")
    assert out[22].text == "" and out[22].n_chars == 0 and out[None].text == "y"
    assert all(r.n_chars == len(r.text) for r in out.values())
    assert main_text(pages).count() == 17 and main_text(pages.limit(0)).count() == 0


def site(spark, pages):
    rows = [(n, f"http://host.example/{n}", html) for n, html in enumerate(pages)]
    return {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_copies_of_a_page_keep_their_article(spark):
    def page(n):
        return f"<body><div><p>Menu of the site</p></div><article><p>Story {n}</p><p>More of {n}</p></article></body>"

    found = site(spark, [page(0)] * 12 + [page(n) for n in range(1, 9)])
    assert found == {n: f"Story {m}\n\nMore of {m}" for n in range(20) for m in [max(0, n - 11)]}


@pytest.mark.parametrize("head", ["<head><title>t</title><body><p>x</p>", "<html><head><meta charset=u><p>x", "<head><title>t</title>x", "<head><style>p{}</style></head><body><head><p>x</p>"])
def test_a_head_ends_without_its_tag(head):
    assert text(head) == "x"


LONG = "All of the words of the story are here. " * 8


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>top</p><article class='post comments-open'><p>x y z</p></article>", "x y z"),
        ("".join(f"<div class='elementor-widget-container'><p>{n} {LONG}</p></div>" for n in range(3)) + "<p>end", "\n\n".join(f"{n} {LONG}".strip() for n in range(3)) + "\n\nend"),
        (f"<article><p>x</p></article><div class='comments'><p>{LONG}</p></div>", "x"),
        (f"<p>x</p><div class='comments'><p>{LONG}</p></div>", "x"),
        (f"<p>{LONG}</p><div class='widget'><p>{LONG[:-40]}</p></div>", LONG.strip()),
        # Parts of a page go, however long they are beside its article, and whether or not anything is left.
        (f"<p>A short article.</p><div class='sidebar'><p>{LONG}</p></div>", "A short article."),
        (f"<p>A short article.</p><div id='newsletter-signup'>{LONG}</div><section class='cookie-consent'>{LONG}</section>", "A short article."),
        (f"<div class='menu'><p>{LONG}</p></div>", ""),
        (f"<div class='comments'><article><p>{LONG}</p></article></div>", ""),
        (f"<div class='widget'><article><p>{LONG}</p></article></div>", LONG.strip()),
        # Words of the article that sound like parts of a page.
        ("<article><p class='share-price'>The share price rose</p><div class='share-price'>again</div></article>", "The share price rose\n\nagain"),
        ("<article><h2 class='related'>Related work</h2><p>Press <button>OK</button> to go on</p></article>", "Related work\n\nPress OK to go on"),
        ("<article><p>x = <math><mi>y</mi></math></p><object data='f'><p>fallback</p></object></article>", "x = y\n\nfallback"),
        ("<article><p>x</p><div class='social-share-buttons'>tweet</div><div class='related-posts'>more</div><div><button>Buy</button></div></article>", "x"),
    ],
)
def test_class_words_are_about_one_element(html, want):
    assert text(html) == want


def test_templates_of_sections_and_of_marked_pages(spark):
    def page(n):
        return f"<div><ul><li>Menu {n % 3}</li></ul></div><div><p>Story {n}</p><p>More of {n}</p></div>"

    assert site(spark, [page(n) for n in range(36)])[7] == "Story 7\n\nMore of 7"
    # The menu is seen on pages whose article is marked, and goes where it is not.
    marked = [f"<ul><li>Menu</li></ul><article><p>Story {n}</p></article>" for n in range(12)]
    assert site(spark, [*marked, "<ul><li>Menu</li></ul><div><p>Bare</p></div>"])[12] == "Bare"
    # A line that many articles share stays in them.
    lines = [f"<article><p>Story {n}</p><p>{'Shared' if n % 3 == 0 else n}</p></article>" for n in range(36)]
    assert site(spark, lines)[3] == "Story 3\n\nShared"


def test_a_hundred_thousand_nested_tags():
    began = time.process_time()
    deep = Page("<div>" * 100_000 + "<p>deep")
    mixed = Page("<div><span>a" * 30_000 + "<hr></x>" * 20_000)
    assert deep.texts == ["deep"] and len(mixed.texts) == 30_000
    assert time.process_time() - began < 5


def test_a_very_long_page(spark):
    html = "<nav>menu</nav>" + "".join(f"<p>paragraph {n} &amp; more</p>" for n in range(60_000))
    pages = spark.createDataFrame([(1, "http://h/1", html, 3)], "page_id long, url string, html string, texts int")
    (row,) = main_text(pages).collect()
    assert row.text == "\n\n".join(f"paragraph {n} & more" for n in range(60_000)) and row.n_chars == len(row.text)


def test_templates_by_plain_counting(spark):
    """A random site without marks: what recurs on 10 different pages and 1 % of a host's different pages goes."""
    draw = random.Random(5)
    parts = [f"<div><ul><li>part {n}</li><li>of the site</li></ul></div>" for n in range(30)]

    def page(n):
        chosen = [f"<section><p>Story {n}</p><p>line {draw.randrange(60)}</p></section>"] + draw.sample(parts[: 1 + n % 30], draw.randrange(0, min(4, 1 + n % 30)))
        draw.shuffle(chosen)
        return "<body>" + "".join(chosen) + "</body>"

    html = {n: page(n) for n in range(400)} | {1000 + n: page(5) for n in range(30)}
    html |= {1100 + n: html[7] for n in range(30)}
    host = {n: "big.example" if n % 4 else "small.example" for n in html}
    want = {}
    for name in set(host.values()):
        pages = {n: parse(h) for n, h in html.items() if host[n] == name}
        versions = {tuple(t for t, _ in p): p for p in pages.values()}
        counts = Counter(tree for p in versions.values() for tree in {tree for _, trees in p for tree in trees})
        recurring = {tree for tree, found in counts.items() if found >= 10 and found >= 0.01 * len(versions)}
        for n, p in pages.items():
            want[n] = "\n\n".join(t for t, trees in p if not recurring & set(trees))
    rows = [(n, f"http://{host[n]}/{n}", h) for n, h in html.items()]
    found = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == want and any("of the site" not in t for t in want.values()) and any("line" in t for t in want.values())


def parse(html):
    """(text, written-out subtrees around it, but for those that hold all texts) for the plain markup above."""
    root = ElementTree.fromstring(html)
    found = []

    def walk(element, around):
        here = [*around, element]
        if element.text and element.text.strip():
            found.append((element.text, here))
        for child in element:
            walk(child, here)

    walk(root, [])
    common = set.intersection(*({id(e) for e in around} for _, around in found))
    return [(text, [ElementTree.tostring(e) for e in around if id(e) not in common]) for text, around in found]
