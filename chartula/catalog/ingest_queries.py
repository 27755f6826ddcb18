"""Queries of the ingest job, with stand-in models."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartula.catalog.corpus_queries import _stored_chunks, _stored_examples
from chartula.catalog.registry import query
from chartula.catalog.text_queries import chunk_sql, strip_sql, word_count_sql
from chartula.plans import ingest as ig
from chartula.schemas import SOURCES

# Stored: every document but the German ones.  Ingested: the German and the French documents, each
# with a block of code at its end.
_MD = "text || chr(10) || '```py' || chr(10) || repeat('x = 1;', 200 + CAST(doc_id AS INTEGER) % 5) || chr(10) || '```'"
_NEW = f"SELECT doc_id, {_MD} AS md FROM documents WHERE lang IN ('de', 'fr')"


def _vector(texts: list[str]) -> list[list[float]]:
    """A stand-in for an embedding model: the first component is the length."""
    return [[float(len(t)), 1.0, 2.0, 3.0] for t in texts]


def _answer(prompts: list[str]) -> list[str]:
    """A stand-in for a text model: the first characters of what the prompt is about."""
    return [(p.partition("\n\nCode:\n")[2].partition("\n\nAfter:\n")[0] or p.partition("\n\nContent:\n")[2])[:30] for p in prompts]


def _ingested(t):
    code = F.expr("repeat('x = 1;', CAST(200 + doc_id % 5 AS INT))")
    pages = t.documents.filter("lang IN ('de', 'fr')").select(
        F.concat(F.lit("doc/"), "doc_id").alias("url"),
        F.col("source").alias("source_id"),
        F.concat("text", F.lit("\n```py\n"), code, F.lit("\n```")).alias("markdown"),
    )
    sources = t.spark.createDataFrame([], SOURCES)
    now = F.lit("2025-01-01").cast("timestamp")
    return ig.ingest(pages, _stored_chunks(t), _stored_examples(t), sources, embed=_vector, dim=4, complete=_answer, now=now, batch_size=500)


@query(
    "ingest_chunks",
    chunk_sql(_NEW, 5000)
    + f""", stored AS ({chunk_sql("SELECT doc_id, text AS md FROM documents WHERE lang NOT IN ('de', 'fr')", 5000)} SELECT * FROM chunk)
    SELECT 'doc/' || doc_id || '#' || chunk_number AS id, content, CAST(length(content) AS DOUBLE) AS first_value FROM chunk
    UNION ALL SELECT 'doc/' || doc_id || '#' || chunk_number, content, NULL FROM stored""",
)
def ingest_chunks(t):
    return _ingested(t).chunks.select("id", "content", F.get("embedding", F.lit(0)).cast("double").alias("first_value"))


@query(
    "ingest_examples",
    """SELECT 'doc/' || doc_id || '#0' AS id, repeat('x = 1;', 200 + CAST(doc_id AS INTEGER) % 5) AS content, left(repeat('x = 1;', 9), 30) AS summary,
           CAST(1200 + 6 * (CAST(doc_id AS INTEGER) % 5) + 11 + 30 AS DOUBLE) AS first_value FROM documents WHERE lang IN ('de', 'fr')
       UNION ALL SELECT 'doc/' || doc_id || '#0', 'code', 'summary', NULL FROM documents WHERE lang NOT IN ('de', 'fr')""",
)
def ingest_examples(t):
    return _ingested(t).examples.select("id", "content", "summary", F.get("embedding", F.lit(0)).cast("double").alias("first_value"))


@query(
    "ingest_sources",
    chunk_sql(_NEW, 5000)
    + f""", words AS (SELECT source, sum({word_count_sql('content')}) AS n FROM chunk c JOIN documents d ON d.doc_id = c.doc_id GROUP BY source),
    opening AS (SELECT source, arg_min({_MD}, 'doc/' || doc_id) AS md FROM documents WHERE lang IN ('de', 'fr') GROUP BY source)
    SELECT o.source AS source_id, {strip_sql('left(md, 30)')} AS summary, CAST(n AS BIGINT) AS total_words FROM opening o JOIN words w ON w.source = o.source""",
)
def ingest_sources(t):
    return _ingested(t).sources.select("source_id", "summary", "total_words")


@query(
    "embed_missing",
    chunk_sql("SELECT doc_id, text AS md FROM documents WHERE lang <> 'de'", 5000)
    + """SELECT 'doc/' || doc_id || '#' || chunk_number AS id, CAST(length(content) AS DOUBLE) AS first_value FROM chunk""",
)
def embed_missing(t):
    """Chunks stored without vectors, as after a synchronisation, get theirs."""
    filled = ig.embed_missing(_stored_chunks(t), _vector, 4, batch_size=500)
    return filled.select("id", F.get("embedding", F.lit(0)).cast("double").alias("first_value"))
