"""Markup bodies as block arrays and markdown: storage XHTML and document JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartula.functions import text as tx

BLOCK = "block_type string, seq int, level int, text string, link string"

DOCUMENT_SCHEMA = """struct<content: array<struct<
    type: string,
    attrs: struct<level: int, language: string, panelType: string, title: string>,
    content: array<struct<
        type: string, text: string,
        attrs: struct<url: string, text: string, id: string, shortName: string>,
        marks: array<struct<type: string, attrs: struct<href: string>>>,
        content: array<struct<
            type: string, text: string,
            content: array<struct<
                type: string, text: string,
                attrs: struct<url: string, text: string, id: string, shortName: string>,
                marks: array<struct<type: string, attrs: struct<href: string>>>>>>>>>>>>"""


def strip_tags(html: Column) -> Column:
    return tx.strip(F.regexp_replace(html, r"<[^>]+>", ""))


def unescape(text: Column) -> Column:
    for entity, char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")]:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def inner_text(html: Column) -> Column:
    return tx.strip(unescape(F.regexp_replace(html, r"<[^>]+>", "")))


def collapse_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def _found(html: Column, pattern: str, kind: str, level=None, text=None, link=None) -> Column:
    """Blocks of one kind, numbered in document order; the callables read the matched text."""
    none = F.lit(None).cast("string")
    return F.transform(
        F.regexp_extract_all(html, F.lit("(?s)" + pattern), F.lit(0)),
        lambda m, i: F.struct(
            F.lit(kind).alias("block_type"),
            i.alias("seq"),
            (level(m).cast("int") if level else F.lit(None).cast("int")).alias("level"),
            (text(m) if text else inner_text(m)).alias("text"),
            (link(m) if link else none).alias("link"),
        ),
    )


def storage_blocks(html: Column) -> Column:
    """Headings, paragraphs, list items, code, links and images of an XHTML body."""

    def attribute(name: str):
        return lambda m: F.regexp_extract(m, name + r'="([^"]*)"', 1)

    def code_text(m: Column) -> Column:
        body = F.regexp_extract(m, r"(?s)<ac:plain-text-body>\s*<!\[CDATA\[(.*?)\]\]>", 1)
        return tx.strip(body)

    def code_language(m: Column) -> Column:
        return F.regexp_extract(m, r'ac:name="language"[^>]*>([^<]*)<', 1)

    return F.concat(
        _found(html, r"<h[1-6](?:\s[^>]*)?>.*?</h[1-6]>", "heading", level=lambda m: F.substring(m, 3, 1)),
        _found(html, r"<p(?:\s[^>]*)?>.*?</p>", "paragraph"),
        _found(html, r"<li(?:\s[^>]*)?>.*?</li>", "list_item"),
        _found(html, r"<pre(?:\s[^>]*)?>.*?</pre>", "code"),
        _found(
            html,
            r'<ac:structured-macro[^>]*ac:name="code".*?</ac:structured-macro>',
            "code",
            text=code_text,
            link=code_language,
        ),
        _found(html, r'<a\s[^>]*href="[^"]*"[^>]*>.*?</a>', "link", link=attribute("href")),
        _found(html, r"<img\s[^>]*>", "image", text=attribute("alt"), link=attribute("src")),
    )


def storage_markdown(html: Column) -> Column:
    """Markdown of an XHTML body: headings, emphasis, code, links, images, flat lists, quotes."""
    md = html
    rules = [
        (
            r'(?s)<ac:structured-macro[^>]*ac:name="code"[^>]*>(?:\s*<ac:parameter[^>]*ac:name="language"[^>]*>'
            r"\s*([^<]*?)\s*</ac:parameter>)?.*?<ac:plain-text-body>\s*<!\[CDATA\[\s*(.*?)\s*\]\]>\s*"
            r"</ac:plain-text-body>\s*</ac:structured-macro>",
            "\n\n```$1\n$2\n```\n\n",
        ),
        *((rf"(?s)<h{n}(?:\s[^>]*)?>\s*(.*?)\s*</h{n}>", "\n\n" + "#" * n + " $1\n\n") for n in range(1, 7)),
        (r"(?s)<pre(?:\s[^>]*)?>(.*?)</pre>", "\n\n```\n$1\n```\n\n"),
        (r"(?s)<p(?:\s[^>]*)?>\s*(.*?)\s*</p>", "\n\n$1\n\n"),
        (r"<br\s*/?>", "\n"),
        (r"<hr\s*/?>", "\n\n---\n\n"),
        (r"(?s)<(?:strong|b)>(.*?)</(?:strong|b)>", "**$1**"),
        (r"(?s)<(?:em|i)>(.*?)</(?:em|i)>", "*$1*"),
        (r"(?s)<code>(.*?)</code>", "`$1`"),
        (r'(?s)<a\s[^>]*href="([^"]*)"[^>]*>\s*(.*?)\s*</a>', "[$2]($1)"),
        (r'<img\s[^>]*src="([^"]*)"[^>]*alt="([^"]*)"[^>]*>', "![$2]($1)"),
        (r'<img\s[^>]*alt="([^"]*)"[^>]*src="([^"]*)"[^>]*>', "![$1]($2)"),
        (r"(?s)<blockquote(?:\s[^>]*)?>\s*(.*?)\s*</blockquote>", "\n\n> $1\n\n"),
        (r"(?s)<li(?:\s[^>]*)?>\s*(.*?)\s*</li>", "- $1\n"),
        (r"</?(?:ul|ol)(?:\s[^>]*)?>", "\n\n"),
        (r"<[^>]+>", ""),
    ]
    for pattern, replacement in rules:
        md = F.regexp_replace(md, pattern, replacement)
    return collapse_blank_lines(tx.strip(unescape(md)))


def _inline(node: Column) -> Column:
    """One inline node with its marks applied in order."""

    def mark(value: Column, m: Column) -> Column:
        kind = m["type"]
        return (
            F.when(kind == "strong", F.concat(F.lit("**"), value, F.lit("**")))
            .when(kind == "em", F.concat(F.lit("*"), value, F.lit("*")))
            .when(kind == "code", F.concat(F.lit("`"), value, F.lit("`")))
            .when(kind == "strike", F.concat(F.lit("~~"), value, F.lit("~~")))
            .when(
                kind == "link",
                F.concat(
                    F.lit("["), value, F.lit("]("), F.coalesce(m["attrs"]["href"], F.lit("")), F.lit(")")
                ),
            )
            .otherwise(value)
        )

    marks = F.coalesce(
        node["marks"], F.array().cast("array<struct<type: string, attrs: struct<href: string>>>")
    )
    url = node["attrs"]["url"]
    name = F.coalesce(
        F.nullif(node["attrs"]["text"], F.lit("")), node["attrs"]["id"], F.lit("unknown")
    )
    return (
        F.when(
            node["type"] == "text", F.aggregate(marks, F.coalesce(node["text"], F.lit("")), mark)
        )
        .when(node["type"] == "hardBreak", F.lit("\n"))
        .when(node["type"] == "inlineCard", F.concat(F.lit("["), url, F.lit("]("), url, F.lit(")")))
        .when(node["type"] == "mention", F.concat(F.lit("@"), name))
        .when(node["type"] == "emoji", F.coalesce(node["attrs"]["shortName"], F.lit("")))
        .otherwise(F.lit(""))
    )


def _join(nodes: Column, render) -> Column:
    return F.array_join(F.transform(nodes, render), "")


def document_blocks(body: Column) -> Column:
    """Top-level blocks of a document JSON body; list items one level deep."""
    parsed = F.from_json(body, DOCUMENT_SCHEMA)["content"]
    none = F.lit(None).cast("string")

    def block(kind: Column, level: Column, text: Column, link: Column, i: Column) -> Column:
        return F.struct(
            kind.alias("block_type"),
            i.alias("seq"),
            level.cast("int").alias("level"),
            text.alias("text"),
            link.alias("link"),
        )

    def of(node: Column, i: Column) -> Column:
        kind = node["type"]
        listed = kind.isin("bulletList", "orderedList")
        plain = F.array(
            block(
                F.when(kind == "codeBlock", F.lit("code")).otherwise(kind),
                F.when(kind == "heading", F.coalesce(node["attrs"]["level"], F.lit(1))),
                F.when(
                    kind == "codeBlock",
                    _join(node["content"], lambda c: F.coalesce(c["text"], F.lit(""))),
                ).otherwise(F.coalesce(_join(node["content"], _inline), F.lit(""))),
                F.when(kind == "codeBlock", F.coalesce(node["attrs"]["language"], F.lit(""))).otherwise(none),
                i,
            )
        )
        items = F.transform(
            F.filter(node["content"], lambda c: c["type"] == "listItem"),
            lambda item, n: block(
                F.when(kind == "orderedList", F.lit("ordered_item")).otherwise(F.lit("list_item")),
                n + F.lit(1),
                _join(F.flatten(F.transform(item["content"], lambda p: p["content"])), _inline),
                none,
                i,
            ),
        )
        return F.when(listed, items).otherwise(plain)

    return F.coalesce(
        F.flatten(F.transform(parsed, of)), F.array().cast(f"array<struct<{_typed(BLOCK)}>>")
    )


def _typed(fields: str) -> str:
    return ", ".join(": ".join(f.split()) for f in fields.split(","))


def document_markdown(body: Column) -> Column:
    def render(b: Column) -> Column:
        kind = b["block_type"]
        return (
            F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), b["level"]), F.lit(" "), b["text"]))
            .when(kind == "code", F.concat(F.lit("```"), b["link"], F.lit("\n"), b["text"], F.lit("\n```")))
            .when(kind == "rule", F.lit("---"))
            .when(kind == "list_item", F.concat(F.lit("- "), b["text"]))
            .when(kind == "ordered_item", F.concat(b["level"].cast("string"), F.lit(". "), b["text"]))
            .otherwise(b["text"])
        )

    lines = F.transform(
        document_blocks(body),
        lambda b: F.struct(
            b["block_type"].isin("list_item", "ordered_item").alias("item"), render(b).alias("text")
        ),
    )
    kept = F.filter(lines, lambda x: x["text"] != "")
    # Items of a list stay on consecutive lines, other blocks are set apart.
    joined = F.aggregate(
        kept,
        F.struct(F.lit("").alias("md"), F.lit(False).alias("item")),
        lambda s, x: F.struct(
            F.concat(
                s["md"],
                F.when(s["md"] == "", F.lit(""))
                .when(s["item"] & x["item"], F.lit("\n"))
                .otherwise(F.lit("\n\n")),
                x["text"],
            ).alias("md"),
            x["item"].alias("item"),
        ),
    )
    return tx.strip(joined["md"])
