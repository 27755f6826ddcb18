"""Readers' parsing steps and model contracts, over records written from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartula import schemas
from chartula.catalog.registry import query
from chartula.catalog.text_queries import chunk_sql
from chartula.functions import markup
from chartula.operators import chunks as ck
from chartula.operators import model
from chartula.plans import sync
from chartula.sources import pages, wiki

# --- sitemaps ------------------------------------------------------------------------------------


@query(
    "sitemap_urls",
    """SELECT 'map' || page_id AS path, i AS position, CASE i WHEN 0 THEN split_part(url, '?', 1) ELSE 'https://x/' || page_id END AS url
       FROM pages, (VALUES (0), (1)) v(i) WHERE page_id % 3 <> 2""",
)
def sitemap_urls(t):
    """One sitemap per page, with and without a namespace; every third is malformed."""
    ns = F.when(F.col("page_id") % 3 == 0, ' xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"').otherwise("")
    end = F.when(F.col("page_id") % 3 == 2, "").otherwise("</urlset>")
    xml = F.concat(
        F.lit("<urlset"), ns, F.lit("><url><loc>"), F.substring_index("url", "?", 1), F.lit("</loc></url><url><loc>https://x/"),
        F.col("page_id"), F.lit("</loc></url>"), end,
    )
    return pages.sitemap_urls(t.pages.select(F.concat(F.lit("map"), "page_id").alias("path"), xml.alias("xml")))


# --- wiki pages ------------------------------------------------------------------------------------


def _document_json(text):
    """Document JSON with a heading, a paragraph, a code block and a list."""
    inline = F.array(F.struct(F.lit("text").alias("type"), text.alias("text")))
    nested = F.array(F.struct(F.lit("paragraph").alias("type"), inline.alias("content")))

    def block(kind: str, **attrs):
        return F.struct(
            F.lit(kind).alias("type"),
            F.struct(
                F.lit(attrs.get("level")).cast("int").alias("level"), F.lit(attrs.get("language")).cast("string").alias("language")
            ).alias("attrs"),
            inline.alias("content"),
        )

    def listed(kind: str):
        items = F.array(*(F.struct(F.lit("listItem").alias("type"), nested.alias("content")) for _ in range(2)))
        return F.struct(F.lit(kind).alias("type"), items.alias("content"))

    blocks = [block("heading", level=2), block("paragraph"), block("codeBlock", language="sql"), listed("orderedList")]
    return F.concat(
        F.lit('{"type": "doc", "content": ['), F.concat_ws(",", *(F.to_json(b) for b in blocks)), F.lit("]}")
    )


@query(
    "document_blocks",
    """SELECT c_custkey, v.block_type, CAST(v.seq AS INTEGER) AS seq, CAST(v.level AS INTEGER) AS level, c_name AS text, v.link
       FROM customer, (VALUES ('heading', 0, 2, NULL), ('paragraph', 1, NULL, NULL), ('code', 2, NULL, 'sql'),
           ('ordered_item', 3, 1, NULL), ('ordered_item', 3, 2, NULL)) v(block_type, seq, level, link)""",
)
def document_blocks(t):
    blocks = markup.document_blocks(_document_json(F.col("c_name")))
    return t.customer.select("c_custkey", F.explode(blocks).alias("b")).select("c_custkey", "b.*")


_MD = "'## ' || c_name || '\n\n' || c_name || '\n\n```sql\n' || c_name || '\n```\n\n1. ' || c_name || '\n2. ' || c_name"


@query(
    "wiki_pages_cloud",
    f"""SELECT CAST(c_custkey AS VARCHAR) AS page_id, c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN 'K' || c_nationkey ELSE CAST(c_nationkey AS VARCHAR) END AS space_key,
           'https://w/p/' || c_custkey AS url, {_MD} AS markdown_content, 'n' || c_nationkey AS author, '2024-01-01' AS created,
           '2024-02-' || c_custkey AS last_modified, c_mktsegment || ',' AS labels, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS parent_page_id
       FROM customer""",
)
def wiki_pages_cloud(t):
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")

    def one(name, value):
        return F.struct(value.alias(name))

    record = F.struct(
        key.alias("id"),
        F.col("c_name").alias("title"),
        nation.alias("spaceId"),
        F.when(F.col("c_custkey") % 2 == 0, one("key", F.concat(F.lit("K"), nation))).alias("space"),
        F.when(F.col("c_custkey") % 3 != 0, nation).alias("parentId"),
        F.lit("2024-01-01").alias("createdAt"),
        one("atlas_doc_format", one("value", _document_json(F.col("c_name")))).alias("body"),
        F.struct(
            one("displayName", F.concat(F.lit("n"), nation)).alias("by"), F.concat(F.lit("2024-02-"), key).alias("createdAt")
        ).alias("version"),
        one("results", F.array(one("name", F.col("c_mktsegment")), one("name", F.lit(None).cast("string")))).alias("labels"),
        F.struct(F.lit("https://w").alias("base"), F.concat(F.lit("/p/"), key).alias("webui")).alias("_links"),
    )
    rows = wiki.wiki_pages(t.customer.select(F.to_json(record).alias("json")), "cloud")
    return rows.withColumn("labels", F.array_join("labels", ","))


_ON_PREMISES_SQL = """SELECT CAST(c_custkey AS VARCHAR) AS page_id, c_name AS title, 'K' || c_nationkey AS space_key, '/p/' || c_custkey AS url,
           '# ' || c_name || '\n\nin **' || c_mktsegment || '** & [more](https://h/' || c_custkey || ')\n\n- a\n- b' AS markdown_content,
           CASE WHEN c_custkey % 5 <> 0 THEN 'editor ' || c_nationkey END AS author,
           '2024-02-' || c_custkey AS created, '2024-02-' || c_custkey AS last_modified,
           CASE WHEN c_custkey % 3 = 0 THEN [] ELSE ['seg-' || lower(c_mktsegment), 'n' || c_nationkey] END AS labels,
           CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) END AS parent_page_id FROM customer"""


def _on_premises_pages(t):
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")

    def one(name, value):
        return F.struct(value.alias(name))

    body = F.concat(
        F.lit("<h1>"), "c_name", F.lit("</h1><p>in <strong>"), "c_mktsegment", F.lit('</strong> &amp; <a href="https://h/'), key,
        F.lit('">more</a></p><ul><li>a</li><li>b</li></ul>'),
    )
    by = F.when(F.col("c_custkey") % 5 != 0, one("displayName", F.concat(F.lit("editor "), nation)))
    labels = F.when(F.col("c_custkey") % 3 != 0, F.array(one("name", F.concat(F.lit("seg-"), F.lower("c_mktsegment"))), one("name", F.concat(F.lit("n"), nation))))
    record = F.struct(
        key.alias("id"),
        F.col("c_name").alias("title"),
        one("key", F.concat(F.lit("K"), nation)).alias("space"),
        one("storage", one("value", body)).alias("body"),
        F.struct(by.alias("by"), F.concat(F.lit("2024-02-"), key).alias("when")).alias("version"),
        one("labels", one("results", labels)).alias("metadata"),
        F.when(F.col("c_custkey") % 2 == 0, F.array(one("id", F.lit("root")), one("id", nation))).alias("ancestors"),
        one("webui", F.concat(F.lit("/p/"), key)).alias("_links"),
    )
    return wiki.wiki_pages(t.customer.select(F.to_json(record).alias("json")), "on_premises")


def _joined_labels(rows, column="labels"):
    return rows.withColumn(column, F.array_join(column, ","))


@query(
    "wiki_pages_on_premises",
    f"SELECT * REPLACE (array_to_string(labels, ',') AS labels) FROM ({_ON_PREMISES_SQL})",
)
def wiki_pages_on_premises(t):
    return _joined_labels(_on_premises_pages(t))


@query(
    "wiki_snapshot",
    f"""SELECT url || '#0' AS id, markdown_content AS content, 'confluence:' || space_key AS source_id, 'confluence' AS source_type, space_key, page_id,
           title AS page_title, array_to_string(labels, ',') AS labels, author, last_modified, parent_page_id FROM ({_ON_PREMISES_SQL})""",
)
def wiki_snapshot(t):
    """Wiki pages synchronised into an empty store: chunks with all of a page's metadata."""
    empty = [t.spark.createDataFrame([], s) for s in (schemas.CHUNKS, schemas.CODE_EXAMPLES)]
    chunks = sync.sync(wiki.snapshot_rows(_on_premises_pages(t)), *empty, meta=F.col("meta")).chunks
    held = "source_type string, space_key string, page_id string, page_title string, labels array<string>, author string, last_modified string, parent_page_id string"
    return _joined_labels(chunks.select("id", "content", "source_id", F.from_json("metadata", held).alias("m")).select("id", "content", "source_id", "m.*"))


# --- model contracts --------------------------------------------------------------------------------


@query(
    "contextual_chunks",
    chunk_sql("SELECT doc_id, text AS md FROM documents", 5000)
    + """SELECT 'doc/' || c.doc_id AS url, chunk_number, CASE WHEN lang = 'de' THEN content
            ELSE least(length(text), 25000) || chr(10) || '---' || chr(10) || content END AS embed_text, lang <> 'de' AS contextual_embedding
         FROM chunk c JOIN documents d ON d.doc_id = c.doc_id""",
)
def contextual_chunks(t):
    """Chunk contexts from a stand-in model that answers with the size of the document window
    and refuses German documents."""
    pages_ = t.documents.select(F.concat(F.lit("doc/"), "doc_id").alias("url"), "lang", F.col("text").alias("markdown"))
    marked = pages_.select("url", F.when(F.col("lang") == "de", F.concat(F.lit("REFUSE"), "markdown")).otherwise(F.col("markdown")).alias("markdown"))
    chunks = ck.chunk_texts(pages_.drop("lang"))

    def answer(prompts: list[str]) -> list[str]:
        out = []
        for prompt in prompts:
            window = prompt.removeprefix("Document:\n")
            if window.startswith("REFUSE"):
                raise RuntimeError("refused")
            out.append(str(window.rindex("\n\nPassage from it:\n")))
        return out

    return model.contextualise(chunks, marked, answer).drop("content")


@query(
    "source_summaries",
    """SELECT source AS source_id, CASE WHEN source LIKE 'src1%' THEN 'Content from ' || source
           WHEN length(left(arg_min(text, doc_id), 5000)) > 500 THEN left(source || repeat('.', length(left(arg_min(text, doc_id), 5000))), 500) || '...'
           ELSE source || repeat('.', length(left(arg_min(text, doc_id), 5000))) END AS summary
       FROM documents GROUP BY source""",
)
def source_summaries(t):
    """Source summaries from a stand-in model; sources that give no text get the default."""
    from chartula.operators import corpus_stats

    docs = t.documents.select("doc_id", F.col("source").alias("source_id"), F.col("text").alias("markdown"))
    texts = corpus_stats.source_first_text(docs, "doc_id")
    texts = texts.withColumn("text", F.when(F.col("source_id").startswith("src1"), " ").otherwise(F.col("text")))

    def answer(prompts: list[str]) -> list[str]:
        out = []
        for prompt in prompts:
            source, rest = prompt.removeprefix("Source: ").split("\n\nContent:\n", 1)
            out.append(source + "." * rest.rindex("\n\nDescribe the source"))
        return out

    return model.summarise_sources(texts, answer).select("source_id", "summary")
