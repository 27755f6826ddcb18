"""Text, URL, chunking and markup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartula.catalog.registry import query
from chartula.functions import markup, metadata, scores, urls
from chartula.functions import text as tx
from chartula.operators import chunks as ck
from chartula.operators import links, model

WS = tx.WHITESPACE
_NETLOC = r"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1)"
_PATH = r"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def netloc_sql(u: str) -> str:
    return _NETLOC.format(u=u)


def path_sql(u: str) -> str:
    return _PATH.format(u=u)


def strip_sql(x: str) -> str:
    return f"trim({x}, '{WS}')"


def word_count_sql(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '[{WS}]+'), lambda w: w <> ''))"


TAGLESS_SQL = "regexp_replace(html, '<[^>]+>', '', 'g')"


# --- URLs ------------------------------------------------------------------------------------


@query(
    "url_source_id",
    f"""SELECT page_id, CASE WHEN {netloc_sql('url')} <> '' THEN {netloc_sql('url')}
               ELSE {path_sql('url')} END AS source_id FROM pages""",
)
def url_source_id(t):
    return t.pages.select("page_id", urls.source_id(F.col("url")).alias("source_id"))


@query("url_defrag", "SELECT page_id, split_part(url, '#', 1) AS url FROM pages")
def url_defrag(t):
    return t.pages.select("page_id", urls.defragment(F.col("url")).alias("url"))


def _varied_url():
    """Text-file, sitemap-file and sitemap-path variants of the stored urls."""
    bare = F.regexp_replace("url", "[?#].*$", "")
    return (
        F.when(F.col("page_id") % 4 == 0, F.concat("url", F.lit("/notes.txt")))
        .when(F.col("page_id") % 4 == 1, F.concat(bare, F.lit("/sitemap.xml")))
        .when(F.col("page_id") % 4 == 2, F.concat(bare, F.lit("/sitemap/a")))
        .otherwise(F.col("url"))
    )


@query(
    "url_class",
    f"""WITH v AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url || '/notes.txt'
            WHEN 1 THEN regexp_replace(url, '[?#].*$', '') || '/sitemap.xml'
            WHEN 2 THEN regexp_replace(url, '[?#].*$', '') || '/sitemap/a' ELSE url END AS url FROM pages)
        SELECT page_id, CASE WHEN url LIKE '%.txt' THEN 'text_file'
            WHEN url LIKE '%sitemap.xml' OR contains({path_sql('url')}, 'sitemap') THEN 'sitemap'
            ELSE 'webpage' END AS url_class FROM v""",
)
def url_class(t):
    return t.pages.select("page_id", urls.url_class(_varied_url()).alias("url_class"))


@query(
    "wiki_page_id",
    """SELECT page_id, CASE page_id % 5 WHEN 0 THEN CAST(page_id AS VARCHAR) WHEN 1 THEN CAST(page_id AS VARCHAR)
           WHEN 2 THEN CAST(page_id AS VARCHAR) WHEN 3 THEN CAST(page_id AS VARCHAR) END AS wiki_id
       FROM pages""",
)
def wiki_page_id(t):
    root = F.concat(F.lit("https://"), urls.netloc(F.col("url")))
    pid = F.col("page_id").cast("string")
    layouts = (
        F.when(F.col("page_id") % 5 == 0, F.concat(root, F.lit("/pages/viewpage.action?pageId="), pid))
        .when(F.col("page_id") % 5 == 1, F.concat(root, F.lit("/wiki/spaces/KEY/pages/"), pid, F.lit("/Title")))
        .when(F.col("page_id") % 5 == 2, F.concat(root, F.lit("/wiki/api/v2/pages/"), pid))
        .when(F.col("page_id") % 5 == 3, F.concat(root, F.lit("/rest/api/content/"), pid))
        .otherwise(F.concat(root, F.lit("/display/KEY/Title")))
    )
    return t.pages.select("page_id", urls.wiki_page_id(layouts).alias("wiki_id"))


@query(
    "repo_name",
    "SELECT c_custkey, replace(c_name, '#', '-') AS repo FROM customer",
)
def repo_name(t):
    url = F.concat(F.lit("https://git.example/team/"), F.replace("c_name", F.lit("#"), F.lit("-")), F.lit(".git"))
    return t.customer.select("c_custkey", urls.repo_name(url).alias("repo"))


# --- pages -------------------------------------------------------------------------------------


@query("landed_pages", "SELECT url, length(html) AS n_chars FROM pages WHERE html IS NOT NULL AND html <> ''")
def landed_pages(t):
    return ck.landed_pages(t.pages, text_col="html").select("url", F.length("html").cast("long").alias("n_chars"))


@query(
    "page_text",
    f"SELECT page_id, {strip_sql(TAGLESS_SQL)} AS text FROM pages",
)
def page_text(t):
    return t.pages.select("page_id", markup.strip_tags(F.col("html")).alias("text"))


def _inner_sql(x: str) -> str:
    text = f"regexp_replace({x}, '<[^>]+>', '', 'g')"
    for entity, char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&amp;", "&")]:
        text = f"replace({text}, '{entity}', '{char}')"
    return strip_sql(text)


def _blocks_sql(kind: str, pattern: str, level: str = "NULL", text: str | None = None, link: str = "NULL") -> str:
    return f"""SELECT page_id, '{kind}' AS block_type, CAST(i - 1 AS INTEGER) AS seq,
            CAST({level} AS INTEGER) AS level, {text or _inner_sql('m')} AS text, CAST({link} AS VARCHAR) AS link
        FROM (SELECT page_id, unnest(l) AS m, generate_subscripts(l, 1) AS i
              FROM (SELECT page_id, regexp_extract_all(html, '(?s){pattern}') AS l FROM pages))"""


_HEADING_SQL = _blocks_sql("heading", r"<h[1-6](?:\s[^>]*)?>.*?</h[1-6]>", level="m[3:3]")


@query("page_headings", f"SELECT page_id, seq, level, text FROM ({_HEADING_SQL})")
def page_headings(t):
    return _page_blocks(t).filter("block_type = 'heading'").select("page_id", "seq", "level", "text")


def _page_blocks(t):
    rows = t.pages.select("page_id", F.explode(markup.storage_blocks(F.col("html"))).alias("b"))
    return rows.select("page_id", "b.*")


@query(
    "page_blocks",
    " UNION ALL ".join(
        [
            _HEADING_SQL,
            _blocks_sql("paragraph", r"<p(?:\s[^>]*)?>.*?</p>"),
            _blocks_sql("list_item", r"<li(?:\s[^>]*)?>.*?</li>"),
            _blocks_sql("code", r"<pre(?:\s[^>]*)?>.*?</pre>"),
            _blocks_sql(
                "link",
                r'<a\s[^>]*href="[^"]*"[^>]*>.*?</a>',
                link="""regexp_extract(m, 'href="([^"]*)"', 1)""",
            ),
            _blocks_sql(
                "image",
                r"<img\s[^>]*>",
                text="""regexp_extract(m, 'alt="([^"]*)"', 1)""",
                link="""regexp_extract(m, 'src="([^"]*)"', 1)""",
            ),
        ]
    ),
)
def page_blocks(t):
    return _page_blocks(t)


_HREFS_SQL = """SELECT url, unnest(l) AS href, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS position
    FROM (SELECT url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages)"""
_INTERNAL_SQL = f"""CASE WHEN {netloc_sql('href')} <> '' THEN {netloc_sql('href')} = {netloc_sql('url')}
    ELSE NOT regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\\-]*:') END"""
_TARGET_SQL = f"""split_part(CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN href
    WHEN href LIKE '//%' THEN regexp_extract(url, '^([^/]*:)', 1) || href
    WHEN href LIKE '/%' THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1) || href
    WHEN href LIKE '#%' OR href LIKE '?%'
        THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1) || {path_sql('url')} || href
    ELSE regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1)
        || CASE WHEN regexp_replace({path_sql('url')}, '[^/]*$', '') = '' THEN '/'
                ELSE regexp_replace({path_sql('url')}, '[^/]*$', '') END || href END, '#', 1)"""


@query(
    "page_links",
    f"SELECT url, position, href, {_TARGET_SQL} AS target, {_INTERNAL_SQL} AS internal FROM ({_HREFS_SQL})",
)
def page_links(t):
    return links.outlinks(t.pages)


@query(
    "link_counts",
    f"""SELECT p.url, CAST(count(h.href) FILTER (WHERE {_INTERNAL_SQL.replace('url', 'h.url').replace('href', 'h.href')}) AS INTEGER) AS internal,
            CAST(count(h.href) FILTER (WHERE NOT ({_INTERNAL_SQL.replace('url', 'h.url').replace('href', 'h.href')})) AS INTEGER) AS external
        FROM pages p LEFT JOIN ({_HREFS_SQL}) h ON p.url = h.url GROUP BY p.url""",
)
def link_counts(t):
    return links.link_counts(t.pages)


# --- chunking -----------------------------------------------------------------------------------


def _structured(text):
    """Documents with blank lines, code fences or neither, by document."""
    return (
        F.when(F.col("doc_id") % 3 == 0, text)
        .when(F.col("doc_id") % 3 == 1, F.replace(text, F.lit("\n"), F.lit("\n\n")))
        .otherwise(F.replace(text, F.lit(", "), F.lit("\n```\n")))
    )


_STRUCTURED_SQL = """CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN replace(text, chr(10), chr(10) || chr(10))
    ELSE replace(text, ', ', chr(10) || '```' || chr(10)) END"""


def _last_sql(pattern: str) -> str:
    """0-based position of the last occurrence in w, -1 when absent."""
    rev = pattern[::-1]
    n = len(pattern)
    quoted = rev.replace("\n", "' || chr(10) || '")
    at = f"strpos(reverse(w), '{quoted}')"
    return f"CASE WHEN {at} = 0 THEN -1 ELSE length(w) - {at} - {n} + 1 END"


def chunk_sql(source: str, size: int) -> str:
    """Recursive statement of the boundary-aware chunking over ``source(doc_id, md)``."""
    least = size * 0.3
    return f"""WITH RECURSIVE src AS ({source}),
    walk(doc_id, md, start, stop) AS (
        SELECT doc_id, md, 0, 0 FROM src WHERE length(md) > 0
        UNION ALL
        SELECT doc_id, md, stop, CASE
            WHEN stop + {size} >= length(md) THEN length(md)
            WHEN fence > {least} THEN stop + fence
            WHEN para >= 0 THEN stop + CASE WHEN para > {least} THEN para ELSE {size} END
            WHEN dot > {least} THEN stop + dot + 1 ELSE stop + {size} END
        FROM (SELECT *, {_last_sql('```')} AS fence, {_last_sql(chr(10) * 2)} AS para, {_last_sql('. ')} AS dot
              FROM (SELECT *, substring(md, CAST(stop + 1 AS BIGINT), {size}) AS w FROM walk WHERE stop < length(md)))
    ),
    cut AS (SELECT doc_id, start, {strip_sql('substring(md, CAST(start + 1 AS BIGINT), CAST(stop - start AS BIGINT))')} AS content
            FROM walk WHERE stop > 0),
    chunk AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS chunk_number,
                     content FROM cut WHERE content <> '')
    """


def _markdown(t, structured=False):
    text = F.col("text")
    return t.documents.select("doc_id", (_structured(text) if structured else text).alias("markdown"))


@query("chunk_documents", chunk_sql("SELECT doc_id, text AS md FROM documents", 5000) + "SELECT * FROM chunk")
def chunk_documents(t):
    return ck.chunk_texts(_markdown(t))


@query(
    "chunk_structured",
    chunk_sql(f"SELECT doc_id, {_STRUCTURED_SQL} AS md FROM documents", 1000) + "SELECT * FROM chunk",
)
def chunk_structured(t):
    return ck.chunk_texts(_markdown(t, structured=True), size=1000)


@query(
    "paragraph_chunks",
    f"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)),
                 chr(10) || chr(10)), lambda x: {strip_sql('x')}), lambda x: length(x) > 50) AS l FROM documents)
        SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS chunk_number, unnest(l) AS content FROM p""",
)
def paragraph_chunks(t):
    text = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return ck.paragraph_texts(t.documents.select("doc_id", text.alias("markdown")))


_HEADED_SQL = "replace(text, chr(10), chr(10) || '## ')"


@query(
    "chunk_stats",
    chunk_sql(f"SELECT doc_id, {_HEADED_SQL} AS md FROM documents", 5000)
    + f"""SELECT doc_id, chunk_number, CAST(length(content) AS INTEGER) AS char_count,
        CAST({word_count_sql('content')} AS INTEGER) AS word_count,
        array_to_string(list_transform(regexp_extract_all(content, '(?m)^#+[{WS}]+.+$'),
            lambda h: regexp_replace(h, '(?s)^(#+)[{WS}]+(.+)$', '\\1 \\2')), '; ') AS headers FROM chunk""",
)
def chunk_stats(t):
    text = F.replace("text", F.lit("\n"), F.lit("\n## "))
    rows = ck.chunk_texts(t.documents.select("doc_id", text.alias("markdown")))
    return ck.with_section_info(rows).drop("content")


_FENCED_SQL = "replace(text, chr(10), chr(10) || '```' || CASE WHEN doc_id % 2 = 0 THEN 'sql' ELSE '' END || chr(10))"


def fenced_documents(t):
    mark = F.concat(F.lit("\n```"), F.when(F.col("doc_id") % 2 == 0, F.lit("sql")).otherwise(F.lit("")), F.lit("\n"))
    return t.documents.select("doc_id", "source", F.replace("text", F.lit("\n"), mark).alias("markdown"))


def code_blocks_sql(source: str, min_length: int) -> str:
    section_code = strip_sql("CASE WHEN lang <> '' THEN substring(sec, CAST(strpos(sec, chr(10)) + 1 AS BIGINT)) ELSE sec END")
    first = strip_sql("split_part(sec, chr(10), 1)")
    return f"""WITH src AS ({source}),
    parts AS (SELECT *, CASE WHEN starts_with({strip_sql('md')}, '```') THEN 3 ELSE 0 END AS skip FROM src),
    segs AS (SELECT *, string_split(substring(md, skip + 1), '```') AS s FROM parts),
    pairs AS (SELECT *, unnest(range((len(s) - 1) // 2)) AS j FROM segs),
    spots AS (SELECT *, s[2 * j + 2] AS sec,
              skip + 6 * j + list_sum(list_transform(s[1:2 * j + 1], lambda x: length(x))) AS a FROM pairs),
    lang AS (SELECT *, CASE WHEN contains(sec, chr(10)) AND {first} <> '' AND NOT contains({first}, ' ')
              AND length({first}) < 20 THEN {first} ELSE '' END AS lang, a + 6 + length(sec) AS z FROM spots),
    blk AS (SELECT *, {section_code} AS code,
              {strip_sql('substring(md, CAST(greatest(a - 1000, 0) + 1 AS BIGINT), CAST(least(a, 1000) AS BIGINT))')} AS context_before,
              {strip_sql('substring(md, CAST(z + 1 AS BIGINT), 1000)')} AS context_after FROM lang)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY j) - 1 AS INTEGER) AS chunk_number, code,
           lang AS language, context_before, context_after,
           context_before || chr(10) || chr(10) || code || chr(10) || chr(10) || context_after AS full_context
    FROM blk WHERE length(code) >= {min_length}"""


@query("code_blocks", code_blocks_sql(f"SELECT doc_id, {_FENCED_SQL} AS md FROM documents", 100))
def code_blocks(t):
    return ck.code_blocks(fenced_documents(t).drop("source"), min_length=100)


@query(
    "code_blocks_numbered",
    f"""SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id, chunk_number) - 1 AS BIGINT) AS chunk_number, language
        FROM ({code_blocks_sql(f"SELECT doc_id, {_FENCED_SQL} AS md FROM documents", 100)})""",
)
def code_blocks_numbered(t):
    """Example numbers running over the whole corpus, as in a site-wide crawl."""
    rows = ck.code_blocks(fenced_documents(t).drop("source"), min_length=100)
    return ck.number_across(rows.select("doc_id", "chunk_number", "language"), ["doc_id"])


def _first_of_code(prompts: list[str]) -> list[str]:
    """A stand-in for a model: the first characters of the prompt's code."""
    return [p.partition("\n\nCode:\n")[2].partition("\n\nAfter:\n")[0][:40] for p in prompts]


@query(
    "code_summaries",
    f"""SELECT doc_id, chunk_number, {strip_sql('left(code, 40)')} AS summary
        FROM ({code_blocks_sql(f"SELECT doc_id, {_FENCED_SQL} AS md FROM documents", 100)})""",
)
def code_summaries(t):
    blocks = ck.code_blocks(fenced_documents(t).drop("source"), min_length=100)
    return model.summarise_code(blocks, _first_of_code).select("doc_id", "chunk_number", "summary")


# --- windows, clips, composed texts ----------------------------------------------------------------


@query(
    "prompt_windows",
    """SELECT doc_id, left(text, 25000) AS document_window, left(text, 5000) AS source_window,
              left(text, 2000) AS page_window, right(text, 500) AS before_window, left(text, 1500) AS code_window
       FROM documents""",
)
def prompt_windows(t):
    text = F.col("text")
    return t.documents.select(
        "doc_id",
        tx.head(text, 25000).alias("document_window"),
        tx.head(text, 5000).alias("source_window"),
        tx.head(text, 2000).alias("page_window"),
        tx.tail(text, 500).alias("before_window"),
        tx.head(text, 1500).alias("code_window"),
    )


@query(
    "summary_clip",
    f"""SELECT doc_id, CASE WHEN s IS NULL OR {strip_sql('s')} = '' THEN 'Content from ' || source
            WHEN length(s) > 500 THEN left(s, 500) || '...' ELSE s END AS summary
        FROM (SELECT doc_id, source, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE text END AS s FROM documents)""",
)
def summary_clip(t):
    summary = F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(F.col("doc_id") % 5 == 1, "  ").otherwise(F.col("text"))
    return t.documents.select("doc_id", tx.clip_summary(summary, F.col("source")).alias("summary"))


@query(
    "composed_texts",
    """SELECT conv_id, turn, role || chr(10) || '---' || chr(10) || text AS contextual,
              text || chr(10) || chr(10) || 'Summary: ' || role AS code_text,
              'Code example for ' || text || chr(10) || chr(10) || 'Summary: Example code showing ' || text AS query_text
       FROM conversations""",
)
def composed_texts(t):
    role, text = F.col("role"), F.col("text")
    return t.conversations.select(
        "conv_id",
        "turn",
        tx.contextual_text(role, text).alias("contextual"),
        tx.code_embed_text(text, role).alias("code_text"),
        tx.code_query_text(text).alias("query_text"),
    )


# --- metadata, keywords, scores ------------------------------------------------------------------


@query(
    "metadata_fields",
    chunk_sql("SELECT doc_id, text AS md FROM documents", 5000)
    + f"""SELECT 'doc/' || c.doc_id || '#' || chunk_number AS id, CAST(length(content) AS INTEGER) AS chunk_size,
            CAST({word_count_sql('content')} AS INTEGER) AS word_count, 'doc/' || c.doc_id AS url, source, lang
          FROM chunk c JOIN documents d ON c.doc_id = d.doc_id""",
)
def metadata_fields(t):
    """Chunk metadata written as JSON and read back by key."""
    pages = t.documents.select(
        F.concat(F.lit("doc/"), "doc_id").alias("url"),
        F.col("source").alias("source_id"),
        "lang",
        F.col("text").alias("markdown"),
    )
    rows = ck.chunk_rows(pages, extra=F.struct("lang"))
    value = metadata.variant(F.col("metadata"))

    def read(key: str, kind: str):
        return F.variant_get(value, f"$.{key}", kind)

    return rows.select(
        "id",
        read("chunk_size", "int").alias("chunk_size"),
        read("word_count", "int").alias("word_count"),
        read("url", "string").alias("url"),
        read("source", "string").alias("source"),
        read("lang", "string").alias("lang"),
    )


@query("metadata_filter", "SELECT event_id, user_id FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) = 42")
def metadata_filter(t):
    return t.events.filter(metadata.contains(F.col("props"), {"k": 42})).select("event_id", "user_id")


# The keywords of the hit report and the order in which snippets look for them.
HIT_KEYWORDS = ["the", "and", "open", "read", "tion", "ou", "der", "file", "path"]
SNIPPET_KEYWORDS = ["file", "open", "read", "der", "and"]


@query(
    "keyword_hit_rank",
    f"""WITH h AS (SELECT doc_id, text, list_filter({HIT_KEYWORDS}, lambda k: contains(lower(text), k)) AS hits FROM documents),
    s AS (SELECT doc_id, text, hits, CASE {' '.join(f"WHEN contains(lower(text), '{k}') THEN greatest(strpos(lower(text), '{k}') - 100, 1)" for k in SNIPPET_KEYWORDS)}
          ELSE 1 END AS spot FROM h WHERE len(hits) > 0)
    SELECT doc_id, CAST(len(hits) AS INTEGER) AS keyword_count, array_to_string(hits, ', ') AS keywords,
           CASE WHEN length(text) > 400 THEN substring(text, CAST(spot AS BIGINT), 400) || '...' ELSE text END AS snippet FROM s""",
)
def keyword_hit_rank(t):
    text = F.col("text")
    hits = t.documents.select("doc_id", "text", tx.keyword_hits(text, HIT_KEYWORDS).alias("hits"))
    return (
        hits.filter(F.size("hits") > 0)
        .select(
            "doc_id",
            F.size("hits").alias("keyword_count"),
            F.array_join("hits", ", ").alias("keywords"),
            tx.keyword_snippet(text, SNIPPET_KEYWORDS).alias("snippet"),
        )
        .orderBy(F.desc("keyword_count"), "doc_id")
    )


_RESPONSE_SQL = """CASE o_orderkey % 8 WHEN 0 THEN 'Score: ' || (o_orderkey % 13) WHEN 1 THEN '0.' || (o_orderkey % 10)
    WHEN 2 THEN CAST(o_orderkey % 1500 AS VARCHAR) || ' points' WHEN 3 THEN 'highly rated' WHEN 4 THEN 'Irrelevant'
    WHEN 5 THEN 'poor match' WHEN 6 THEN '' ELSE o_orderpriority END"""


@query(
    "response_scores",
    f"""WITH r AS (SELECT o_orderkey, {_RESPONSE_SQL} AS response FROM orders),
    n AS (SELECT *, TRY_CAST(nullif(regexp_extract(response, '\\d*\\.?\\d+'), '') AS DOUBLE) AS x, lower(response) AS w FROM r)
    SELECT o_orderkey, round(CASE WHEN x <= 1 THEN x WHEN x <= 10 THEN x / 10 WHEN x <= 100 THEN x / 100
        WHEN x IS NOT NULL THEN least(x / 1000, 1.0)
        WHEN w LIKE '%high%' OR w LIKE '%very relevant%' OR w LIKE '%excellent%' THEN 0.9
        WHEN w LIKE '%good%' OR w LIKE '%relevant%' OR w LIKE '%moderate%' THEN 0.7
        WHEN w LIKE '%low%' OR w LIKE '%poor%' OR w LIKE '%irrelevant%' THEN 0.3 ELSE 0.5 END, 6) AS score FROM n""",
)
def response_scores(t):
    key = F.col("o_orderkey")
    response = (
        F.when(key % 8 == 0, F.concat(F.lit("Score: "), key % 13))
        .when(key % 8 == 1, F.concat(F.lit("0."), key % 10))
        .when(key % 8 == 2, F.concat(key % 1500, F.lit(" points")))
        .when(key % 8 == 3, "highly rated")
        .when(key % 8 == 4, "Irrelevant")
        .when(key % 8 == 5, "poor match")
        .when(key % 8 == 6, "")
        .otherwise(F.col("o_orderpriority"))
    )
    return t.orders.select("o_orderkey", F.round(scores.parse_score(response), 6).alias("score"))
