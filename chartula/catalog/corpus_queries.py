"""Source roll-ups, table writers, synchronisation and reachability queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartula.catalog.registry import query
from chartula.catalog.text_queries import chunk_sql, code_blocks_sql, strip_sql, word_count_sql
from chartula.functions import text as tx
from chartula.operators import chunks as ck
from chartula.operators import corpus_stats, links
from chartula.plans import sync as sy
from chartula.sources import tables

_CHUNKS = chunk_sql("SELECT doc_id, text AS md FROM documents", 5000)


def document_pages(t):
    return t.documents.select(
        F.concat(F.lit("doc/"), "doc_id").alias("url"),
        "doc_id",
        F.col("source").alias("source_id"),
        F.col("text").alias("markdown"),
    )


@query(
    "source_word_counts",
    _CHUNKS
    + f"""SELECT source AS source_id, CAST(sum({word_count_sql('content')}) AS BIGINT) AS total_words
        FROM chunk JOIN documents USING (doc_id) GROUP BY source""",
)
def source_word_counts(t):
    chunks = ck.chunk_texts(document_pages(t))
    return corpus_stats.source_word_counts(
        chunks.select("source_id", tx.word_count(F.col("content")).alias("word_count"))
    )


@query(
    "source_first_text",
    "SELECT source AS source_id, left(arg_min(text, doc_id), 5000) AS text FROM documents GROUP BY source",
)
def source_first_text(t):
    return corpus_stats.source_first_text(document_pages(t), "doc_id")


@query(
    "source_joined_text",
    f"""SELECT source AS source_id, CAST(sum({word_count_sql('text')}) AS BIGINT) AS total_words,
            left(string_agg(left(text, 2000), chr(10) || chr(10) ORDER BY doc_id), 5000) AS text
        FROM documents WHERE length(text) > 0 GROUP BY source""",
)
def source_joined_text(t):
    return corpus_stats.source_joined_text(document_pages(t), "doc_id")


@query(
    "conversation_text",
    f"""SELECT conv_id AS source_id, CAST(sum({word_count_sql('text')}) AS BIGINT) AS total_words,
            left(string_agg(left(text, 2000), chr(10) || chr(10) ORDER BY turn), 5000) AS text
        FROM conversations WHERE length(text) > 0 GROUP BY conv_id""",
)
def conversation_text(t):
    turns = t.conversations.select(F.col("conv_id").alias("source_id"), "turn", F.col("text").alias("markdown"))
    return corpus_stats.source_joined_text(turns, "turn")


def _source_rows(t):
    return t.documents.groupBy(F.col("source").alias("source_id")).agg(
        F.concat(F.lit("from "), F.min("lang")).alias("summary"), F.sum("n_chars").alias("total_words")
    )


@query(
    "source_listing",
    """SELECT s.source AS source_id, 'from ' || min(lang) AS summary, CAST(sum(n_chars) AS BIGINT) AS total_words,
              count(*) FILTER (WHERE lang <> 'en') AS chunks FROM documents s GROUP BY source""",
)
def source_listing(t):
    chunks = t.documents.filter("lang <> 'en'").select(F.col("source").alias("source_id"))
    return corpus_stats.source_listing(_source_rows(t), chunks)


@query(
    "source_listing_prefix",
    """SELECT source AS source_id, 'from ' || min(lang) AS summary, CAST(sum(n_chars) AS BIGINT) AS total_words,
              count(*) AS chunks FROM documents WHERE source LIKE 'src1%' GROUP BY source""",
)
def source_listing_prefix(t):
    chunks = t.documents.select(F.col("source").alias("source_id"))
    return corpus_stats.source_listing(_source_rows(t), chunks, prefix="src1")


@query(
    "source_upsert",
    """WITH old AS (SELECT source AS source_id, min(lang) AS summary, CAST(count(*) AS BIGINT) AS words FROM documents
                    WHERE lang = 'en' GROUP BY source),
    new AS (SELECT source AS source_id, max(lang) AS summary, CAST(sum(n_chars) AS BIGINT) AS words FROM documents
            WHERE lang IN ('de', 'fr') GROUP BY source)
    SELECT coalesce(n.source_id, o.source_id) AS source_id, CASE WHEN n.source_id IS NULL THEN o.summary ELSE n.summary END AS summary,
           CASE WHEN n.source_id IS NULL THEN o.words ELSE n.words END AS total_words,
           CASE WHEN o.source_id IS NULL THEN '2025-01-02' ELSE '2024-01-01' END AS created,
           CASE WHEN n.source_id IS NULL THEN '2024-01-01' ELSE '2025-01-02' END AS updated
    FROM old o FULL OUTER JOIN new n ON o.source_id = n.source_id""",
)
def source_upsert(t):
    then = F.lit("2024-01-01").cast("timestamp")
    old = t.documents.filter("lang = 'en'").withColumnRenamed("source", "source_id").groupBy("source_id")
    new = t.documents.filter("lang IN ('de', 'fr')").withColumnRenamed("source", "source_id").groupBy("source_id")
    existing = old.agg(F.min("lang").alias("summary"), F.count(F.lit(1)).alias("total_words")).select(
        "*", then.alias("created_at"), then.alias("updated_at")
    )
    updates = new.agg(F.max("lang").alias("summary"), F.sum("n_chars").alias("total_words"))
    rows = tables.upsert_sources(existing, updates, F.lit("2025-01-02").cast("timestamp"))
    return rows.select(
        "source_id",
        "summary",
        "total_words",
        F.date_format("created_at", "yyyy-MM-dd").alias("created"),
        F.date_format("updated_at", "yyyy-MM-dd").alias("updated"),
    )


@query(
    "replace_by_url",
    """WITH new AS (SELECT page_id, split_part(url, '#', 1) AS url, CAST(page_id % 2 AS INTEGER) AS chunk_number,
                           'new ' || page_id AS content FROM pages WHERE url LIKE 'https:%'),
    last AS (SELECT url, chunk_number, arg_max(content, page_id) AS content FROM new GROUP BY url, chunk_number),
    old AS (SELECT split_part(url, '#', 1) AS url, CAST(i AS INTEGER) AS chunk_number, 'old ' || page_id AS content
            FROM pages, range(3) r(i))
    SELECT * FROM old WHERE url NOT IN (SELECT url FROM new) UNION ALL SELECT url, chunk_number, content FROM last""",
)
def replace_by_url(t):
    url = F.substring_index("url", "#", 1).alias("url")
    old = t.pages.select(
        url,
        F.explode(F.sequence(F.lit(0), F.lit(2))).alias("chunk_number"),
        F.concat(F.lit("old "), "page_id").alias("content"),
    )
    new = t.pages.filter(F.col("url").startswith("https:")).select(
        url,
        (F.col("page_id") % 2).cast("int").alias("chunk_number"),
        F.concat(F.lit("new "), "page_id").alias("content"),
        "page_id",
    )
    return tables.replace_by_url(old, new, order="page_id")


@query(
    "delete_by_urls",
    "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
def delete_by_urls(t):
    stored = t.documents.select(F.col("doc_id").alias("url"), "doc_id", "source")
    gone = t.labels.filter("toxic = 1").select(F.col("doc_id").alias("url"))
    return tables.delete_by_url(stored, gone).select("doc_id", "source")


@query(
    "missing_sources",
    """SELECT DISTINCT 'src' || n_nationkey AS source_id FROM nation
       WHERE 'src' || n_nationkey NOT IN (SELECT source FROM documents)""",
)
def missing_sources(t):
    stored = t.nation.select(F.concat(F.lit("src"), "n_nationkey").alias("source_id"))
    known = t.documents.select(F.col("source").alias("source_id")).distinct()
    return tables.missing_sources(stored, known)


# --- synchronisation ------------------------------------------------------------------------------

# Stored state: every document but the German ones, stamped with its length.  Snapshot: every
# document but the Spanish ones; toxic documents have changed and French ones are empty.
_STORED_SQL = "SELECT 'doc/' || doc_id AS url, source AS source_id, CAST(n_chars AS VARCHAR) AS stamp FROM documents WHERE lang <> 'de'"
_SNAPSHOT_SQL = """SELECT 'doc/' || d.doc_id AS url, source AS source_id, CASE WHEN lang = 'fr' THEN ' ' ELSE text END AS markdown,
    CASE WHEN l.toxic = 1 THEN 'changed' ELSE CAST(n_chars AS VARCHAR) END AS last_modified, d.doc_id
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE lang <> 'es'"""
_STATUS_SQL = f"""SELECT n.url, n.source_id, n.doc_id, n.markdown, CASE WHEN {strip_sql('n.markdown')} = '' THEN 'skipped_empty'
    WHEN n.last_modified <> '' AND n.last_modified = s.stamp THEN 'skipped_unchanged' ELSE 'stored' END AS status
    FROM ({_SNAPSHOT_SQL}) n LEFT JOIN ({_STORED_SQL}) s ON n.url = s.url AND n.source_id = s.source_id"""


def _stored_chunks(t):
    pages = document_pages(t).join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id").filter("lang <> 'de'")
    rows = ck.chunk_rows(
        pages.select("url", "source_id", "markdown", F.col("n_chars").cast("string").alias("last_modified")),
        extra=F.struct("last_modified"),
    )
    return rows.drop("word_count").withColumn("embedding", F.lit(None).cast("array<float>"))


def _snapshot(t):
    docs = t.documents.filter("lang <> 'es'").join(t.labels.select("doc_id", "toxic"), "doc_id", "left")
    return docs.select(
        F.concat(F.lit("doc/"), "doc_id").alias("url"),
        F.col("source").alias("source_id"),
        F.when(F.col("lang") == "fr", " ").otherwise(F.col("text")).alias("markdown"),
        F.when(F.col("toxic") == 1, "changed").otherwise(F.col("n_chars").cast("string")).alias("last_modified"),
    )


def _stored_examples(t):
    return t.documents.filter("lang <> 'de'").select(
        F.concat(F.lit("doc/"), "doc_id", F.lit("#0")).alias("id"),
        F.concat(F.lit("doc/"), "doc_id").alias("url"),
        F.lit(0).alias("chunk_number"),
        F.lit("code").alias("content"),
        F.lit("summary").alias("summary"),
        F.lit("{}").alias("metadata"),
        F.col("source").alias("source_id"),
        F.lit(None).cast("array<float>").alias("embedding"),
    )


def _sync(t, **options):
    return sy.sync(_snapshot(t), _stored_chunks(t), _stored_examples(t), **options)


@query("sync_diff", f"SELECT url, source_id, status FROM ({_STATUS_SQL})")
def sync_diff(t):
    stored = sy.stored_state(_stored_chunks(t))
    return sy.page_status(_snapshot(t), stored).select("url", "source_id", "status")


@query(
    "orphan_urls",
    f"""SELECT s.url, s.source_id FROM ({_STORED_SQL}) s WHERE s.url NOT IN (SELECT url FROM ({_SNAPSHOT_SQL}))
        AND s.source_id IN (SELECT source_id FROM ({_SNAPSHOT_SQL}))""",
)
def orphan_urls(t):
    return sy.orphans(sy.stored_state(_stored_chunks(t)), _snapshot(t))


@query(
    "sync_chunks",
    chunk_sql(f"SELECT doc_id, markdown AS md FROM ({_STATUS_SQL}) WHERE status = 'stored'", 5000)
    + f""", stored AS ({chunk_sql("SELECT doc_id, text AS md FROM documents WHERE lang <> 'de'", 5000)} SELECT * FROM chunk),
    gone AS (SELECT doc_id FROM documents WHERE lang = 'es')
    SELECT 'doc/' || doc_id || '#' || chunk_number AS id, content FROM chunk
    UNION ALL SELECT 'doc/' || doc_id || '#' || chunk_number, content FROM stored
    WHERE doc_id NOT IN (SELECT doc_id FROM gone) AND doc_id NOT IN (SELECT doc_id FROM chunk)""",
)
def sync_chunks(t):
    """Chunk table after a full synchronisation."""
    return _sync(t, full=True).chunks.select("id", "content")


@query(
    "sync_duplicates",
    chunk_sql(f"SELECT doc_id, markdown AS md FROM ({_STATUS_SQL}) WHERE status = 'stored'", 5000)
    + f""", stored AS ({chunk_sql("SELECT doc_id, text AS md FROM documents WHERE lang <> 'de'", 5000)} SELECT * FROM chunk),
    gone AS (SELECT doc_id FROM documents WHERE lang = 'es')
    SELECT 'doc/' || doc_id || '#' || chunk_number AS id, content FROM chunk
    UNION ALL SELECT 'doc/' || doc_id || '#' || chunk_number, content FROM stored
    WHERE doc_id NOT IN (SELECT doc_id FROM gone) AND doc_id NOT IN (SELECT doc_id FROM chunk)""",
)
def sync_duplicates(t):
    """Every page also occurs with an earlier stamp and another text; the later one counts."""
    earlier = _snapshot(t).withColumns({"markdown": F.lit("an earlier text"), "last_modified": F.lit("0")})
    pages = _snapshot(t).unionByName(earlier)
    return sy.sync(pages, _stored_chunks(t), _stored_examples(t), full=True).chunks.select("id", "content")


@query(
    "sync_examples",
    """SELECT 'doc/' || d.doc_id || '#0' AS id, repeat('x', 1000 + CAST(d.doc_id AS INTEGER) % 7) AS content, true AS fresh
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1 AND lang NOT IN ('es', 'fr')
    UNION ALL SELECT 'doc/' || d.doc_id || '#0', 'code', false
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE lang NOT IN ('es', 'de') AND (lang = 'fr' OR coalesce(l.toxic, 0) <> 1)""",
)
def sync_examples(t):
    """Code examples after a full synchronisation: changed pages have a new code block each."""
    docs = t.documents.select("doc_id", "text").join(t.labels.filter("toxic = 1").select("doc_id"), "doc_id")
    fenced = docs.select(
        F.concat(F.lit("doc/"), "doc_id").alias("url"),
        F.concat("text", F.lit("\n```py\n"), F.expr("repeat('x', CAST(1000 + doc_id % 7 AS INT))"), F.lit("\n```")).alias("_fenced"),
    )
    pages = _snapshot(t).join(fenced, "url", "left")
    changed = (F.col("last_modified") == "changed") & (F.col("markdown") != " ")
    pages = pages.withColumn("markdown", F.when(changed, F.col("_fenced")).otherwise(F.col("markdown"))).drop("_fenced")
    found = sy.sync(pages, _stored_chunks(t), _stored_examples(t), full=True).examples
    return found.select("id", "content", (F.col("summary") != "summary").alias("fresh"))


@query(
    "sync_summary",
    chunk_sql(f"SELECT doc_id, markdown AS md FROM ({_STATUS_SQL}) WHERE status = 'stored'", 5000)
    + f""", st AS ({_STATUS_SQL})
    SELECT (SELECT count(*) FROM st WHERE status = 'stored') AS pages_processed,
           (SELECT count(*) FROM st WHERE status = 'skipped_unchanged') AS pages_skipped_unchanged,
           (SELECT count(*) FROM st WHERE status = 'skipped_empty') AS pages_skipped_empty,
           CAST(0 AS BIGINT) AS pages_failed, (SELECT count(*) FROM chunk) AS total_chunks_stored,
           CAST(0 AS BIGINT) AS total_code_examples_stored,
           (SELECT count(*) FROM documents WHERE lang = 'es') AS orphaned_pages_deleted""",
)
def sync_summary(t):
    return _sync(t, full=True).summary


@query(
    "ingestion_summary",
    _CHUNKS
    + f""", ex AS ({code_blocks_sql("SELECT doc_id, replace(text, chr(10), chr(10) || '```' || chr(10)) AS md FROM documents", 1000)}),
    firsts AS (SELECT string_agg('doc/' || doc_id, ',' ORDER BY doc_id) || ',...' AS urls FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 5))
    SELECT (SELECT count(*) FROM documents) AS pages_crawled, (SELECT count(*) FROM chunk) AS chunks_stored,
           (SELECT count(DISTINCT source) FROM documents) AS sources_updated, (SELECT count(*) FROM ex) AS code_examples_stored,
           urls AS urls_crawled FROM firsts""",
)
def ingestion_summary(t):
    pages = document_pages(t)
    fenced = pages.withColumn("markdown", F.replace("markdown", F.lit("\n"), F.lit("\n```\n")))
    chunks = ck.chunk_texts(pages)
    row = corpus_stats.ingestion_summary(pages, chunks, ck.code_blocks(fenced), "doc_id")
    return row.withColumn("urls_crawled", F.array_join("urls_crawled", ","))


@query(
    "integrity_report",
    """WITH c AS (SELECT d.doc_id, e.embedding, l.doc_id AS labelled FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id
                  LEFT JOIN labels l ON d.doc_id = l.doc_id),
    n AS (SELECT count(*) AS total, count(*) FILTER (WHERE embedding IS NULL OR len(embedding) <> 64) AS wrong,
                 count(*) FILTER (WHERE labelled IS NULL) AS bare FROM c)
    SELECT total AS total_documents, (SELECT count(*) FROM conversations) AS total_code_examples,
           wrong = 0 AS embedding_dimension_consistency, true AS vector_search_functional, bare = 0 AS metadata_preserved,
           true AS source_info_preserved, wrong > 0 OR bare > 0 AS corruption_detected,
           concat_ws('; ', CASE WHEN wrong > 0 THEN wrong || ' rows do not have 64 dimensions' END,
               CASE WHEN bare > 0 THEN bare || ' rows have no metadata' END) AS validation_errors FROM n""",
)
def integrity_report(t):
    stored = (
        t.documents.select("doc_id")
        .join(t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
        .join(t.labels.select("doc_id", F.to_json(F.struct("quality")).alias("metadata")), "doc_id", "left")
    )
    sources = t.documents.select("source").distinct()
    row = corpus_stats.integrity_report(stored, t.conversations, sources, 64)
    return row.withColumn("validation_errors", F.array_join("validation_errors", "; "))


@query(
    "reembed_counts",
    "SELECT count(*) AS n, CAST(count(*) AS BIGINT) AS good, CAST(sum(length(text)) AS DOUBLE) AS length FROM documents WHERE trim(text) <> ''",
)
def reembed_counts(t):
    """Re-embedding of the stored texts into 32 dimensions with a stand-in model that answers with their lengths."""
    stored = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.lit(None).cast("array<float>").alias("embedding"))
    moved = sy.reembed(stored.filter("trim(content) <> ''"), lambda texts: [[len(x)] * 32 for x in texts], 32)
    return moved.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("embedding") == 32).alias("good"), F.sum(F.get("embedding", F.lit(0)).cast("double")).alias("length"))


@query(
    "migration_digest",
    """SELECT part, count(*) AS rows_before, CAST(sum(CASE WHEN doc_id % 97 = 0 THEN 0 WHEN doc_id % 89 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS rows_after
       FROM (SELECT doc_id, doc_id % 64 AS part FROM documents) GROUP BY part HAVING bool_or(doc_id % 97 = 0 OR doc_id % 89 = 0 OR doc_id % 83 = 0)""",
)
def migration_digest(t):
    """Parts of a copied table with a lost, doubled or changed row, found by order-free digests of the stored texts."""
    stored = t.documents
    times = F.when(F.col("doc_id") % 97 == 0, 0).when(F.col("doc_id") % 89 == 0, 2).otherwise(1)
    changed = F.when(F.col("doc_id") % 83 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    copied = stored.withColumn("text", changed).select("*", F.explode(F.array_repeat(F.lit(0), times)).alias("copy"))
    return corpus_stats.differing_parts(stored, copied, stored.columns, F.col("doc_id") % 64)


# --- reachability ------------------------------------------------------------------------------------

# Link graph: each customer is a page linking to the pages its orders fall on; pages of
# customers in debt cannot be read.
_LINK_SQL = "SELECT 'p' || o_custkey AS src, 'p' || (o_orderkey // 10) AS dst FROM orders"
_OK_SQL = "SELECT 'p' || c_custkey AS url FROM customer WHERE c_acctbal >= 0"
_STARTS_SQL = "SELECT 'p' || c_custkey AS url FROM customer WHERE c_nationkey = 0 AND c_mktsegment = 'BUILDING'"


@query(
    "link_reachability",
    f"""WITH RECURSIVE l AS ({_LINK_SQL}), good AS ({_OK_SQL}),
    walk(url, depth) AS (SELECT url, 0 FROM ({_STARTS_SQL})
        UNION SELECT l.dst, w.depth + 1 FROM walk w JOIN good g ON g.url = w.url JOIN l ON l.src = w.url WHERE w.depth < 2)
    SELECT w.url, CAST(min(depth) AS INTEGER) AS depth, bool_or(g.url IS NOT NULL) AS ok
    FROM walk w LEFT JOIN good g ON g.url = w.url GROUP BY w.url""",
)
def link_reachability(t):
    fragment = F.concat(F.lit("#"), F.col("o_orderkey") % 3)
    edges = t.orders.select(
        F.concat(F.lit("p"), "o_custkey").alias("src"),
        F.concat(F.lit("p"), F.floor(F.col("o_orderkey") / 10), fragment).alias("dst"),
    )
    pages = t.customer.select(F.concat(F.lit("p"), "c_custkey").alias("url"), (F.col("c_acctbal") >= 0).alias("ok"))
    starts = t.customer.filter("c_nationkey = 0 AND c_mktsegment = 'BUILDING'").select(
        F.concat(F.lit("p"), "c_custkey").alias("url")
    )
    return links.reachable(edges, pages, starts, 3)


@query(
    "page_links_reachability",
    """SELECT url, CAST(min(depth) AS INTEGER) AS depth, bool_or(ok) AS ok FROM (
         SELECT split_part(url, '#', 1) AS url, 0 AS depth, true AS ok FROM pages
         UNION ALL SELECT target, 1, false FROM (
            SELECT DISTINCT split_part(CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href ELSE href END, '#', 1) AS target
            FROM (SELECT url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages))
         WHERE target NOT IN (SELECT split_part(url, '#', 1) FROM pages)) GROUP BY url""",
)
def page_links_reachability(t):
    """Every stored page is a start; one level of its links is followed."""
    found = links.outlinks(t.pages).select(F.col("url").alias("src"), F.col("target").alias("dst"))
    pages = t.pages.select("url", F.lit(True).alias("ok"))
    return links.reachable(found, pages, t.pages.select("url"), 2)


_TREE_SQL = """SELECT 'root' AS parent, 'r' || r_regionkey AS child, r_regionkey AS ord FROM region
    UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, n_nationkey FROM nation
    UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, c_custkey FROM customer"""
_TREE_OK_SQL = """SELECT 'root' AS page_id UNION ALL SELECT 'r' || r_regionkey FROM region
    UNION ALL SELECT 'n' || n_nationkey FROM nation WHERE n_nationkey <> 7
    UNION ALL SELECT 'c' || c_custkey FROM customer WHERE c_acctbal >= 0"""


_WALK_SQL = f"""WITH RECURSIVE tree AS ({_TREE_SQL}), good AS ({_TREE_OK_SQL}),
    walk(page_id, depth, key) AS (SELECT 'root', 0, CAST([] AS INTEGER[])
        UNION ALL SELECT t.child, w.depth + 1, list_append(w.key, CAST(t.ord AS INTEGER)) FROM walk w JOIN good g ON g.page_id = w.page_id
        JOIN tree t ON t.parent = w.page_id WHERE w.depth < 3),
    o AS (SELECT w.*, g.page_id IS NOT NULL AS ok, count(g.page_id) OVER (ORDER BY depth, key ROWS UNBOUNDED PRECEDING) AS c
          FROM walk w LEFT JOIN good g ON g.page_id = w.page_id)
    SELECT page_id, CAST(depth AS INTEGER) AS depth, ok FROM o"""


@query("page_tree_uncapped", _WALK_SQL)
def page_tree_uncapped(t):
    """The whole tree to its depth limit."""
    return links.page_tree(*_tree(t), "root", max_depth=3).select("page_id", "depth", "ok")


@query("page_tree", f"{_WALK_SQL} WHERE c < 300 OR (c = 300 AND ok)")
def page_tree(t):
    return links.page_tree(*_tree(t), "root", max_depth=3, max_pages=300).select("page_id", "depth", "ok")


def _tree(t):
    """Pages with their children, and which of them can be read."""
    tree = (
        t.region.select(
            F.lit("root").alias("parent"), F.concat(F.lit("r"), "r_regionkey").alias("child"), F.col("r_regionkey").alias("ord")
        )
        .unionByName(
            t.nation.select(
                F.concat(F.lit("r"), "n_regionkey").alias("parent"),
                F.concat(F.lit("n"), "n_nationkey").alias("child"),
                F.col("n_nationkey").alias("ord"),
            )
        )
        .unionByName(
            t.customer.select(
                F.concat(F.lit("n"), "c_nationkey").alias("parent"),
                F.concat(F.lit("c"), "c_custkey").alias("child"),
                F.col("c_custkey").cast("int").alias("ord"),
            )
        )
    )
    pages = (
        t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("page_id"), F.lit(True).alias("ok"))
        .unionByName(
            t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("page_id"), (F.col("n_nationkey") != 7).alias("ok"))
        )
        .unionByName(
            t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("page_id"), (F.col("c_acctbal") >= 0).alias("ok"))
        )
        .unionByName(t.spark.range(1).select(F.lit("root").alias("page_id"), F.lit(True).alias("ok")))
    )
    return tree, pages
