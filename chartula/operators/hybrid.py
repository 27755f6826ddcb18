"""The three-tier merge of vector and keyword hits, source types, and reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartula.functions import text as tx
from chartula.functions import vectors
from chartula.operators.keywords import keyword_matches
from chartula.operators.ranking import top_per_group

__all__ = ["apply_scores", "keyword_matches", "merge_hits", "rerank_eligible", "rerank_text", "similarity_scores", "source_type_is"]

# Fixed values of the merge.
BOOST = 1.2
KEYWORD_SIMILARITY = 0.5
OVERSAMPLE = 2
WIKI_PREFIX = "confluence:"
MAX_RERANK = 50


def source_type_is(source_id: Column, source_type: str | None) -> Column:
    """``wiki``: prefixed source ids; ``web``: the others; None: all."""
    if source_type is None:
        return F.lit(True)
    wiki = F.coalesce(source_id, F.lit("")).startswith(WIKI_PREFIX)
    if source_type == "wiki":
        return wiki
    if source_type == "web":
        return ~wiki
    raise ValueError(f"unknown source type {source_type!r}")


def merge_hits(
    vector_hits: DataFrame,
    keyword_hits: DataFrame,
    k: int,
    *,
    id_col: str = "id",
    query_id_col: str = "query_id",
) -> DataFrame:
    """Three tiers per query: in both (keyword order, boosted), vector only, keyword only.

    Inputs are ranked hits with ``rank``; the result keeps tier order and is not re-sorted by
    similarity.
    """
    keys = [query_id_col, id_col]
    vec = vector_hits.select(*keys, "similarity", F.col("rank").alias("_v"))
    kw = keyword_hits.select(*keys, F.col("rank").alias("_k"))
    both = F.col("_v").isNotNull() & F.col("_k").isNotNull()
    merged = vec.join(kw, keys, "full_outer").select(
        *keys,
        F.when(both, 1).when(F.col("_v").isNotNull(), 2).otherwise(3).alias("tier"),
        F.when(F.col("_k").isNotNull() & F.col("_v").isNotNull(), F.col("_k"))
        .otherwise(F.coalesce("_v", "_k"))
        .alias("_tier_rank"),
        F.when(both, F.least(F.lit(1.0), F.col("similarity") * BOOST))
        .when(F.col("_v").isNotNull(), F.col("similarity"))
        .otherwise(F.lit(KEYWORD_SIMILARITY))
        .alias("similarity"),
    )
    order = [F.asc("tier"), F.asc("_tier_rank"), F.asc(id_col)]
    return top_per_group(merged, [query_id_col], order, k).drop("_tier_rank")


# --- reranking ---------------------------------------------------------------------------------


def rerank_eligible(results: DataFrame, queries: DataFrame, *, max_results: int = MAX_RERANK) -> DataFrame:
    """Query ids whose results may be reranked: a non-blank query and 1 to ``max_results``
    results that all have content."""
    sizes = results.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("content").isNull()).alias("_bad")
    )
    fit = sizes.filter((F.col("_n") <= max_results) & (F.col("_bad") == 0)).select("query_id")
    asked = queries.filter(~tx.is_blank(F.col("query"))).select("query_id")
    return fit.join(asked, "query_id", "left_semi")


def apply_scores(results: DataFrame, scores: DataFrame, *, id_col: str = "id") -> DataFrame:
    """Reorder ranked ``results`` by ``scores(query_id, id, rerank_score)``, best first.

    Adds ``original_rank`` (from 0).  Ties keep their order; a query with any result left
    unscored keeps its original order altogether.
    """
    joined = results.join(scores.select("query_id", id_col, "rerank_score"), ["query_id", id_col], "left")
    query = Window.partitionBy("query_id")
    complete = F.count_if(F.col("rerank_score").isNull()).over(query) == 0
    joined = joined.withColumn("original_rank", (F.col("rank") - 1).cast("int")).withColumn(
        "_complete", complete
    )
    score = F.when(F.col("_complete"), F.col("rerank_score"))
    order = query.orderBy(F.desc_nulls_last(score), F.asc("original_rank"))
    return joined.withColumn("rank", F.row_number().over(order)).drop("_complete")


def similarity_scores(
    results: DataFrame, queries: DataFrame, *, id_col: str = "id", embedding_col: str = "embedding"
) -> DataFrame:
    """Scores for ``apply_scores`` from result and query embeddings."""
    asked = queries.select("query_id", F.col(embedding_col).alias("_query"))
    score = F.round(vectors.cosine(F.col(embedding_col), F.col("_query")), vectors.RANK_PLACES)
    return results.join(asked, "query_id").select("query_id", id_col, score.alias("rerank_score"))


def rerank_text(content: Column) -> Column:
    """Text to embed for reranking; blank content gets a placeholder."""
    return F.when(tx.is_blank(content), F.lit("[empty]")).otherwise(content)
