"""Retrieval for a table of queries: filters, vector or hybrid ranking, source type, rerank."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartula.functions import text as tx
from chartula.operators import hybrid, model
from chartula.operators.ranking import top_per_group
from chartula.operators.vector_search import top_k_multi

def fetch(hits: DataFrame, chunks: DataFrame, columns: list[str], id_col: str = "id") -> DataFrame:
    """Stored columns of the hits (Spark knows the size of the hits and chooses the join)."""
    return chunks.select(id_col, *columns).join(hits, id_col)


def search(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = 5,
    *,
    source: str | None = None,
    source_type: str | None = None,
    where: Column | None = None,
    use_hybrid: bool = False,
    rerank: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    keyword_columns: tuple[str, ...] = ("content",),
    columns: tuple[str, ...] = ("url", "chunk_number", "content", "metadata", "source_id"),
) -> DataFrame:
    """Ranked rows per query from ``queries(query_id, query, embedding)``.

    The source and metadata filters run before the ranking.  The source type is tested after
    the oversampled vector ranking and inside the keyword search.  A query without a vector only
    finds keywords.  ``rerank`` gets the rows (with content, if it is among ``columns``) and the
    queries and gives the rows in their new order, as the functions below do.
    """
    rows = chunks
    if source is not None and source.strip():
        rows = rows.filter(F.col("source_id") == source)
    if where is not None:
        rows = rows.filter(where)
    wide = k * hybrid.OVERSAMPLE if (use_hybrid or source_type) else k
    vector_hits = top_k_multi(rows, queries, wide)
    if source_type is not None:
        sourced = fetch(vector_hits, rows, ["source_id"])
        vector_hits = sourced.filter(hybrid.source_type_is(F.col("source_id"), source_type)).drop("source_id")
    if use_hybrid:
        typed = rows.filter(hybrid.source_type_is(F.col("source_id"), source_type))
        keyword_hits = hybrid.keyword_matches(
            typed, queries, k * hybrid.OVERSAMPLE, columns=keyword_columns
        )
        hits = hybrid.merge_hits(vector_hits, keyword_hits, k)
    else:
        hits = top_per_group(vector_hits.drop("rank"), ["query_id"], [F.desc("similarity"), F.asc("id")], k)
    found = fetch(hits, rows, list(columns))
    return found if rerank is None else rerank(found, queries)


def search_code(
    examples: DataFrame,
    queries: DataFrame,
    embed: Callable,
    dim: int,
    k: int = 5,
    *,
    source_id: str | None = None,
    use_hybrid: bool = False,
    rerank: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    columns: tuple[str, ...] = ("url", "chunk_number", "content", "summary", "metadata", "source_id"),
) -> DataFrame:
    """``search`` over code examples for ``queries(query_id, query)``.

    Queries are embedded as the description of an example; keywords may match the code or its summary.
    """
    asked = queries.withColumn("embed_text", tx.code_query_text(F.col("query")))
    asked = model.embed_texts(asked, embed, dim, text_col="embed_text").drop("embed_text")
    return search(
        examples, asked, k, source=source_id, use_hybrid=use_hybrid, rerank=rerank,
        keyword_columns=("content", "summary"), columns=columns,
    )


def rerank_by_similarity(
    results: DataFrame, queries: DataFrame, embed: Callable, dim: int, *, max_results: int = hybrid.MAX_RERANK
) -> DataFrame:
    """Rerank by the cosine of re-embedded queries and contents; ineligible queries keep their order."""
    fit = results.join(hybrid.rerank_eligible(results, queries, max_results=max_results), "query_id", "left_semi")
    texts = fit.select("query_id", "id", hybrid.rerank_text(F.col("content")).alias("content"))
    asked = model.embed_texts(queries.select("query_id", "query"), embed, dim, text_col="query")
    scores = hybrid.similarity_scores(model.embed_texts(texts, embed, dim), asked)
    return hybrid.apply_scores(results, scores)


def rerank_by_pairs(
    results: DataFrame, queries: DataFrame, score: Callable, *, max_results: int = hybrid.MAX_RERANK, batch_size: int = model.BATCH
) -> DataFrame:
    """Rerank by a (query, text) scorer; ineligible queries keep their order, a batch that fails scores zero."""
    fit = results.join(hybrid.rerank_eligible(results, queries, max_results=max_results), "query_id", "left_semi")
    pairs = fit.select("query_id", "id", "content").join(queries.select("query_id", "query"), "query_id")
    return hybrid.apply_scores(results, model.score_pairs(pairs, score, batch_size=batch_size))
