"""Pages to chunk rows, paragraph rows and code-example rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartula.functions import text as tx
from chartula.functions import urls
from chartula.session import cut_lineage


def landed_pages(pages: DataFrame, *, text_col: str = "markdown", ok: Column | None = None) -> DataFrame:
    """Successfully landed pages with a non-empty body."""
    kept = pages.filter(F.col(text_col).isNotNull() & (F.length(text_col) > 0))
    return kept if ok is None else kept.filter(ok)


def chunk_arrays(
    pages: DataFrame, *, text_col: str = "markdown", size: int = tx.CHUNK_SIZE
) -> DataFrame:
    """The other columns and the ordered ``chunks`` of each text.

    Row-local: no shuffle, and the whole text is read once.
    """
    others = [c for c in pages.columns if c != text_col]
    cut = pages.select(
        *others,
        F.length(text_col).alias("_length"),
        tx.blocks(F.col(text_col), size).alias("_pieces"),
    )
    cut = cut.withColumn("_cuts", tx.chunk_cuts(F.col("_pieces"), F.col("_length"), size))
    return cut.select(
        *others, tx.chunks_from_cuts(F.col("_pieces"), F.col("_cuts"), size).alias("chunks")
    )


def chunk_texts(
    pages: DataFrame, *, text_col: str = "markdown", size: int = tx.CHUNK_SIZE
) -> DataFrame:
    """One row per chunk: the other columns, ``chunk_number`` from 0, and ``content``."""
    others = [c for c in pages.columns if c != text_col]
    rows = chunk_arrays(pages, text_col=text_col, size=size)
    return _one_row_each(rows, others, "chunks", "content")


def _one_row_each(rows: DataFrame, others: list[str], array: str, item: str) -> DataFrame:
    """Explode ``array`` with positions.

    The outer form and a filter on the position: an inner explode of a computed column makes
    the optimizer test the array's size below the projection, computing it twice or more.
    """
    exploded = rows.select(*others, F.posexplode_outer(array).alias("chunk_number", item))
    return exploded.filter(F.col("chunk_number").isNotNull())


def paragraph_texts(
    pages: DataFrame, *, text_col: str = "markdown", min_length: int = 50
) -> DataFrame:
    others = [c for c in pages.columns if c != text_col]
    return pages.select(
        *others,
        F.posexplode(tx.paragraphs(F.col(text_col), min_length)).alias("chunk_number", "content"),
    )


def with_section_info(chunks: DataFrame) -> DataFrame:
    """Adds ``headers``, ``char_count`` and ``word_count``."""
    return chunks.withColumn("_info", tx.section_info(F.col("content"))).select(
        *chunks.columns, "_info.*"
    )


def chunk_rows(
    pages: DataFrame,
    *,
    size: int = tx.CHUNK_SIZE,
    crawl_type: Column | None = None,
    crawl_time: Column | None = None,
    extra: Column | None = None,
) -> DataFrame:
    """Rows of the chunk table for ``(url, markdown[, source_id])``.

    ``source_id`` is taken from the input when present, else derived from the URL.
    """
    with_source = pages if "source_id" in pages.columns else pages.withColumn(
        "source_id", urls.source_id(F.col("url"))
    )
    rows = with_section_info(chunk_texts(with_source, size=size))
    fields = {
        "chunk_size": F.length("content"),
        "headers": F.col("headers"),
        "char_count": F.col("char_count"),
        "word_count": F.col("word_count"),
        "chunk_index": F.col("chunk_number"),
        "url": F.col("url"),
        "source": F.col("source_id"),
    }
    if crawl_type is not None:
        fields["crawl_type"] = crawl_type
    if crawl_time is not None:
        fields["crawl_time"] = crawl_time
    return rows.select(
        chunk_id().alias("id"),
        "url",
        "chunk_number",
        "content",
        _metadata(fields, extra).alias("metadata"),
        "source_id",
        "word_count",
    )


def chunk_id() -> Column:
    return F.concat_ws("#", F.col("url"), F.col("chunk_number").cast("string"))


def _metadata(fields: dict[str, Column], extra: Column | None) -> Column:
    """JSON text of the known keys followed by the fields of the ``extra`` struct."""
    known = F.to_json(F.struct(*(value.alias(name) for name, value in fields.items())))
    if extra is None:
        return known
    more = F.to_json(extra)
    joined = F.concat(F.left(known, F.length(known) - 1), F.lit(","), F.substring(more, 2, F.length(more)))
    return F.when(more.isNull() | (more == "{}"), known).otherwise(joined)


def code_block_arrays(
    pages: DataFrame, *, text_col: str = "markdown", min_length: int = tx.MIN_CODE_LENGTH
) -> DataFrame:
    """The other columns and the ordered ``blocks`` of fenced code of each text."""
    others = [c for c in pages.columns if c != text_col]
    # Texts without a fence are not taken apart.
    text = F.when(F.contains(F.col(text_col), F.lit(tx.FENCE)), F.col(text_col)).otherwise(F.lit(""))
    parts = pages.select(
        *others,
        F.length(text).alias("_length"),
        tx.fence_skip(text).alias("_skip"),
        tx.fence_parts(text).alias("_parts"),
        tx.blocks(text, tx.CONTEXT_LENGTH).alias("_pieces"),
    )
    parts = parts.withColumn("_at", tx.fence_positions(F.col("_parts"), F.col("_skip")))
    found = tx.code_blocks(
        F.col("_parts"), F.col("_at"), F.col("_pieces"), F.col("_length"), min_length
    )
    return parts.select(*others, found.alias("blocks"))


def code_blocks(
    pages: DataFrame, *, text_col: str = "markdown", min_length: int = tx.MIN_CODE_LENGTH
) -> DataFrame:
    """One row per fenced block: ``chunk_number`` restarts at 0 on every page."""
    others = [c for c in pages.columns if c != text_col]
    fenced = pages.filter(F.contains(F.col(text_col), F.lit(tx.FENCE)))
    found = code_block_arrays(fenced, text_col=text_col, min_length=min_length)
    rows = _one_row_each(found, others, "blocks", "_block").select(*others, "chunk_number", "_block.*")
    return rows.withColumn(
        "full_context", F.concat_ws("\n\n", "context_before", "code", "context_after")
    )


def number_across(rows: DataFrame, doc_order: list[str], number: str = "chunk_number") -> DataFrame:
    """Running number over the whole corpus instead of per document.

    Counts per document are prefix-summed in two levels (inside range buckets, then over the
    bucket totals), so no task ever sees all rows.
    """
    sized = rows.groupBy(*doc_order).agg(F.count(F.lit(1)).alias("_n"))
    ranged = sized.repartitionByRange(*doc_order).withColumn("_bucket", F.spark_partition_id())
    ranged = cut_lineage(ranged)  # the bucket of a row must not change between its two uses
    within = Window.partitionBy("_bucket").orderBy(*doc_order)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_bucket").agg(F.sum("_n").alias("_total"))
    totals = totals.select("_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    offsets = ranged.withColumn("_own", F.sum("_n").over(within) - F.col("_n")).join(
        F.broadcast(totals), "_bucket"
    )
    offsets = offsets.select(*doc_order, (F.col("_base") + F.col("_own")).alias("_offset"))
    return rows.join(offsets, doc_order).withColumn(
        number, (F.col("_offset") + F.col(number)).cast("long")
    ).select(*rows.columns)
