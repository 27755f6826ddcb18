"""The ingest job: landed pages to the next state of the chunk, example and source tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartula.functions import text as tx
from chartula.functions import urls, vectors
from chartula.operators import chunks as ck
from chartula.operators import corpus_stats, model
from chartula.operators.ranking import last_per_key
from chartula.plans.sync import _rows_like
from chartula.sources import tables

Embed = Callable[[list[str]], list[Sequence[float]]]
Complete = Callable[[list[str]], list[str]]


@dataclass
class Ingested:
    chunks: DataFrame
    examples: DataFrame
    sources: DataFrame


def ingest(
    pages: DataFrame,
    chunks: DataFrame,
    examples: DataFrame,
    sources: DataFrame,
    *,
    embed: Embed,
    dim: int,
    complete: Complete,
    now: Column,
    contextual: bool = False,
    order: str | None = None,
    size: int = tx.CHUNK_SIZE,
    min_code_length: int = tx.MIN_CODE_LENGTH,
    batch_size: int = model.BATCH,
) -> Ingested:
    """Pages ``(url, markdown[, source_id])`` replace the stored pages of the same URL.

    Chunks get vectors (of the chunk, or with ``contextual`` of the chunk behind a model-written
    context), code blocks a summary and a vector, and sources a summary and their word count.  Of
    several rows for one URL the last by ``order`` counts, then by its text.  Pages without a text
    are left out.
    """
    landed = ck.landed_pages(pages)
    if "source_id" not in landed.columns:
        landed = landed.withColumn("source_id", urls.source_id(F.col("url")))
    wanted = ["url", "source_id", "markdown"] + ([order] if order else [])
    landed = last_per_key(landed.select(*dict.fromkeys(wanted)), ["url"], [*([order] if order else []), "markdown"])
    landed = landed.select("url", "source_id", "markdown")

    rows = ck.chunk_rows(landed, size=size)
    words = corpus_stats.source_word_counts(rows)
    if contextual:
        rows = model.contextualise(rows, landed, complete)
        marked = F.concat(F.left("metadata", F.length("metadata") - 1), F.lit(',"contextual_embedding":true}'))
        rows = rows.withColumn("metadata", F.when(F.col("contextual_embedding"), marked).otherwise(F.col("metadata")))
    rows = model.embed_texts(rows, embed, dim, text_col="embed_text" if contextual else "content", batch_size=batch_size)

    blocks = ck.code_blocks(landed, min_length=min_code_length)
    # What only the summary needs does not travel on to the vectors.
    told = model.summarise_code(blocks, complete).drop("context_before", "context_after").withColumn("embed_text", tx.code_embed_text(F.col("code"), F.col("summary")))
    told = model.embed_texts(told, embed, dim, text_col="embed_text", batch_size=batch_size)
    facts = F.struct(
        F.col("chunk_number").alias("chunk_index"),
        "url",
        F.col("source_id").alias("source"),
        F.length("code").alias("char_count"),
        tx.word_count(F.col("code")).alias("word_count"),
        "language",
    )
    told = told.withColumns({"id": ck.chunk_id(), "content": F.col("code"), "metadata": F.to_json(facts)})

    openings = corpus_stats.source_first_text(landed, "url")
    described = model.summarise_sources(openings, complete).select("source_id", "summary").join(words, "source_id", "left")
    return Ingested(
        chunks=tables.replace_by_key(chunks, _rows_like(chunks, rows), "url"),
        examples=tables.match_keys(examples, landed, ["url"], "left_anti").select(*examples.columns).unionByName(_rows_like(examples, told)),
        sources=tables.upsert_sources(sources, described.select("source_id", "summary", F.coalesce("total_words", F.lit(0)).alias("total_words")), now),
    )


def embed_missing(table: DataFrame, embed: Embed, dim: int, *, text_col: str = "content", batch_size: int = model.BATCH) -> DataFrame:
    """Vectors for the rows that have none yet, as synchronised chunks do, and for those whose embedding failed.

    A failed one is the zero vector of a text that is not blank; all other rows stay as they are.
    """
    failed = vectors.is_unusable(F.col("embedding")) & ~tx.is_blank(F.col(text_col))
    wanted = F.col("embedding").isNull() | F.coalesce(failed, F.lit(False))
    filled = model.embed_texts(table.filter(wanted).drop("embedding"), embed, dim, text_col=text_col, batch_size=batch_size)
    return table.filter(~wanted).unionByName(filled.select(*table.columns))
