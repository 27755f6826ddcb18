"""Main text of web pages, with site templates removed.

A page becomes text blocks and elements, each element with its parent's number and the hash of its subtree. Spark
counts the hashes by host, before any other rule; a subtree that recurs on many different pages of a host is the site's
template, and all blocks inside it go. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are also known by their element, their role, or a class that says nothing else. Where a page marks its
article, only what is inside is kept. Every rule is about one element; none looks at how much text it would drop.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartula.llm.common import stored, tidied
from chartula.llm.url_filter import host_of
from chartula.operators.joins import salted_join

#: A subtree is template from this many different pages of a host and this share of its different pages on;
#: inside of what a page marks as its article, where authors repeat lines of their own, from the second share on.
LEAST_PAGES, LEAST_SHARE, LEAST_MARKED_SHARE = 10, 0.01, 0.5
#: ``version`` tells different pages apart, ``marked`` is for those that mark an article; ``at`` is the element of each text, ``counted`` the subtrees.
PAGE_SCHEMA = (
    "page_id long, url string, host string, version long, marked boolean, texts array<string>, at array<int>, "
    "parents array<int>, trees array<bigint>, counted array<bigint>"
)

# Element names and class words.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = set(
    "aside audio button canvas datalist dialog footer form head iframe input menu nav noscript"
    " option script select style svg template textarea title video".split()
)
DROPPED_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
DROPPED_WORDS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs captcha comment comments consent cookie cookies"
    " disclaimer disqus footer login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo"
    " promotion recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
HEADER_WORDS = {"header", "topbar"}
#: What else a class of such a part may say; with any other word it is about something else (``share-price``, ``with-sidebar``).
HELPER_WORDS = set(
    "area bar block blocks body bottom box button buttons card col column container content form global group heading holder icon icons inner item"
    " items label left link links list main message outer overlay page panel post posts primary right row secondary section side site slot story stories"
    " text thread title top unit widget widgets wrap wrapper".split()
)
#: Elements of running text: a class does not drop them, and a button inside of one is a word of it.
TEXT_ELEMENTS = set("p li td th dd dt h1 h2 h3 h4 h5 h6 blockquote caption figcaption pre span b i em strong a code q small sub sup u".split())
#: Reader comments are none of the article even if nothing else is marked.
COMMENT_WORDS = set("comment comments disqus replies reply respond".split())
HEAD_ELEMENTS = set("base basefont bgsound head link meta noframes noscript script style template title".split())
#: An element of the key closes an open element of the value, up to the nearest element of the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select", "datalist"}),
}
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class _Element:
    __slots__ = ("number", "parent", "tag", "dropped", "words", "main", "inside", "flow", "parts", "tree")

    def __init__(self, number: int, parent: _Element | None, tag: str):
        self.number, self.parent, self.tag = number, parent, tag
        #: Known by element or role, and the class words that name it.
        self.dropped, self.words = False, frozenset()
        self.main = tag in ("article", "main")
        #: Whether it stands inside of a marked article, and inside of running text.
        self.inside = parent is not None and (parent.inside or parent.main)
        self.flow = tag in TEXT_ELEMENTS or parent is not None and parent.flow and tag not in BLOCKS
        self.parts: list[str] = [tag]
        self.tree = 0


def class_words(classes: str) -> set[str]:
    """The words of those classes that name a part of a page and nothing else."""
    found: set[str] = set()
    for name in classes.split():
        words = {w.lower() for w in _SPLIT.split(name) if w}
        if words <= DROPPED_WORDS | HEADER_WORDS | HELPER_WORDS:
            found |= words & (DROPPED_WORDS | HEADER_WORDS)
    return found


class PageParser(HTMLParser):
    """Collects the elements of a page and its texts, each with its element; tolerant of missing and stray tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[_Element] = [_Element(0, None, "")]
        self.elements = list(self.stack)
        self.open: Counter = Counter()
        self.texts: list[str] = []
        self.found: list[tuple[str, _Element]] = []

    def _flush(self) -> None:
        if self.texts:
            text = " ".join("".join(self.texts).split())
            self.texts = []
            if text:
                self.stack[-1].parts.append(text)
                self.found.append((text, self.stack[-1]))

    def finish(self) -> None:
        self.close()
        self._flush()
        self._close(1)

    def _close(self, position: int) -> None:
        while len(self.stack) > position:
            element = self.stack.pop()
            self.open[element.tag] -= 1
            element.tree = xxhash.xxh64_intdigest("\x01".join(element.parts)) - (1 << 63)
            element.parts = []
            self.stack[-1].parts.append(str(element.tree))

    def _close_open(self, names: set[str], until: set[str]) -> None:
        if not any(self.open[name] for name in names):
            return
        for position in range(len(self.stack) - 1, 0, -1):
            if self.stack[position].tag in names:
                return self._close(position)
            if self.stack[position].tag in until:
                return None

    def _leave_head(self, anywhere: bool = False) -> None:
        """Close a head whose end tag is missing."""
        if anywhere or self.stack[-1].tag == "head":
            self._close_open({"head"}, {"html", "body"})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "head" and self.open["body"]:
            return
        if tag not in HEAD_ELEMENTS:
            self._leave_head(tag == "body")
        if tag in BLOCKS:
            self._flush()
            self._close_open({"p"}, BLOCKS - {"p"})
        elif tag == "br":
            self.texts.append(" ")
        if tag in CLOSES:
            self._close_open(*CLOSES[tag])
        if tag in VOID:
            return
        element = _Element(len(self.elements), self.stack[-1], tag)
        inline = tag == "button" and element.parent.flow
        if tag in DROPPED and not inline:
            self._flush()
            element.dropped = True
        if attrs:
            values = {name: value or "" for name, value in attrs}
            role = values.get("role", "").lower()
            hidden = "hidden" in values or values.get("aria-hidden") == "true" or bool(_HIDDEN.search(values.get("style", "")))
            element.dropped |= hidden or role in DROPPED_ROLES
            element.main |= role == "main" or "articlebody" in values.get("itemprop", "").lower()
            if tag not in TEXT_ELEMENTS and tag not in ("html", "body"):
                words = class_words(f"{values.get('class', '')} {values.get('id', '')}")
                element.words = frozenset(words - HEADER_WORDS if element.inside else words)
        element.dropped |= tag == "header" and not element.inside
        self.open[tag] += 1
        self.elements.append(element)
        self.stack.append(element)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag in DROPPED and not (tag == "button" and self.stack[-1].flow):
            self._flush()
        if not self.open[tag]:
            return
        for position in range(len(self.stack) - 1, 0, -1):
            if self.stack[position].tag == tag:
                return self._close(position)

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._leave_head()
        if not self.stack[-1].dropped:
            self.texts.append(data)


def _subtree_sums(elements: list[_Element], own: list[int]) -> list[int]:
    """For each element the sum over it and all below; an element's number is greater than its parent's."""
    sums = list(own)
    for element in reversed(elements[1:]):
        sums[element.parent.number] += sums[element.number]
    return sums


class Page:
    """A parsed page: its article's texts with their elements, and each element's parent and subtree.

    A subtree that holds all texts of the article is the page rather than a template in it; its tree is 0.
    """

    def __init__(self, html: str | None):
        parser = PageParser()
        parser.feed(html or "")
        parser.finish()
        elements = parser.elements
        gone = [False] * len(elements)
        for e in elements[1:]:
            gone[e.number] = gone[e.parent.number] or e.dropped
        # A class does not drop what holds everything that the page marks as its article, unless it names comments.
        mains = [int(e.main and not gone[e.number]) for e in elements]
        held = _subtree_sums(elements, mains)
        for e in elements[1:]:
            holds_all = held[0] > 0 and held[e.number] == held[0]
            named = e.words & COMMENT_WORDS if holds_all else e.words
            gone[e.number] = gone[e.parent.number] or e.dropped or bool(named)
        inside = [False] * len(elements)
        for e in elements[1:]:
            inside[e.number] = not gone[e.number] and (e.main or inside[e.parent.number])
        kept = [(text, e.number) for text, e in parser.found if not gone[e.number]]
        self.marked = any(e.main and not gone[e.number] for e in elements)
        if self.marked:
            kept = [(text, n) for text, n in kept if inside[n]]
        blocks = [0] * len(elements)
        for _, n in kept:
            blocks[n] += 1
        below = _subtree_sums(elements, blocks)
        self.texts, self.at = [t for t, _ in kept], [n for _, n in kept]
        self.parents = [e.parent.number if e.parent else 0 for e in elements]
        self.trees = [0 if kept and below[e.number] == len(kept) else e.tree for e in elements]
        self.counted = sorted(set(self.trees[1:]) - {0})
        self.version = xxhash.xxh64_intdigest("\x01".join(self.texts)) - (1 << 63)


def _lists(lists: list[list], kind: pa.DataType) -> pa.Array:
    return pa.array(lists, pa.list_(kind))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "host", "version", "marked", "texts", "at", "parents", "trees", "counted"]
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            some = batch.slice(at, 500)
            found = [Page(html) for html in some.column("html").to_pylist()]
            columns = [some.column(c) for c in names[:3]] + [pa.array([p.version for p in found], pa.int64()), pa.array([p.marked for p in found], pa.bool_())]
            kinds = {"texts": pa.string(), "at": pa.int32(), "parents": pa.int32(), "trees": pa.int64(), "counted": pa.int64()}
            columns += [_lists([getattr(p, name) for p in found], kind) for name, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays(columns, names)


def without_templates(texts: list[str], at: list[int], parents: list[int], trees: list[int], recurring: set[int]) -> str:
    """The texts outside of all recurring subtrees, joined by empty lines."""
    if not recurring:
        return "\n\n".join(texts)
    gone = [False] * len(parents)
    for n in range(1, len(parents)):
        gone[n] = gone[parents[n]] or trees[n] in recurring
    return "\n\n".join([text for text, n in zip(texts, at, strict=True) if not gone[n]])


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c) for c in ("texts", "at", "parents", "trees", "recurring")]
        written = [without_templates(*(c[n].as_py() for c in columns[:4]), set(columns[4][n].as_py())) for n in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(written, pa.string())], ["page_id", "url", "text"])


def templates(parsed: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """host, templates, certain: the subtrees that recur on many different pages of a host, and those that also count in articles.

    Pages with the same text blocks count once. A subtree of the list is on a fixed share of the host's pages at least, so a host's list is no longer
    than its pages' average number of subtrees divided by that share.
    """
    named = parsed.filter("host <> ''")
    pages = named.groupBy("host").agg(F.count_distinct("version").alias("pages")).filter(F.col("pages") >= least_pages)
    trees = named.select("host", "version", F.explode("counted").alias("tree")).distinct()
    counts = trees.groupBy("host", "tree").agg(F.count(F.lit(1)).alias("found")).filter(F.col("found") >= least_pages)
    recurring = counts.join(pages, "host").filter(F.col("found") >= least_share * F.col("pages"))
    certain = F.when(F.col("found") >= LEAST_MARKED_SHARE * F.col("pages"), F.col("tree"))
    return recurring.groupBy("host").agg(F.collect_list("tree").alias("templates"), F.collect_list(certain).alias("certain"))


def main_text(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """page_id, url, text, n_chars per row of ``pages(page_id, url, html)``.

    White space inside a block is one space, blocks are joined by an empty line, ``n_chars`` counts code
    points. A null html gives an empty text. Pages without a host (null or odd URL) have no template.
    Repeated rows are returned each, an empty table gives no rows, other columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"), "html")
    parsed = stored(rows.mapInArrow(tidied(_parse), PAGE_SCHEMA), "pages")
    # Stored first, so that its size is known when the join is planned: while it is small, no page is moved; a large host is spread.
    found = salted_join(parsed, stored(templates(parsed, least_pages, least_share), "templates"), ["host"], "left", salt_on=["page_id", "version"])
    of_host = F.coalesce(F.when(F.col("marked"), F.col("certain")).otherwise(F.col("templates")), F.array().cast("array<bigint>"))
    # Only those of the host's subtrees that the page has go on to its text.
    ready = found.select("page_id", "url", "texts", "at", "parents", "trees", F.array_intersect("counted", of_host).alias("recurring"))
    text = ready.mapInArrow(tidied(_assemble), "page_id long, url string, text string")
    return text.withColumn("n_chars", F.length("text").cast("long"))
