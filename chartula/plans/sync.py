"""Incremental synchronisation of page snapshots into the stored tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartula.functions import text as tx
from chartula.operators import chunks as ck
from chartula.operators import corpus_stats, model
from chartula.operators.ranking import last_per_key
from chartula.session import cut_lineage
from chartula.sources import tables

@dataclass
class SyncResult:
    outcomes: DataFrame
    chunks: DataFrame
    examples: DataFrame
    orphans: DataFrame
    summary: DataFrame
    touched: DataFrame


def stored_state(chunks: DataFrame, *, modified: Column | None = None) -> DataFrame:
    """``(url, source_id, stored_modified)`` of the chunk table."""
    stamp = modified if modified is not None else F.get_json_object("metadata", "$.last_modified")
    return chunks.groupBy("url", "source_id").agg(F.max(stamp).alias("stored_modified"))


def page_status(pages: DataFrame, stored: DataFrame, *, skip_unchanged: bool = True) -> DataFrame:
    """Adds ``status``: skipped_empty, skipped_unchanged or stored.

    Change detection compares the modification stamps as text; a page without one is stored.
    """
    joined = pages.join(stored, ["url", "source_id"], "left")
    same = F.coalesce(
        (F.col("last_modified") != "") & (F.col("last_modified") == F.col("stored_modified")), F.lit(False)
    )
    status = F.when(tx.is_blank(F.col("markdown")), F.lit("skipped_empty"))
    if skip_unchanged:
        status = status.when(same, F.lit("skipped_unchanged"))
    return joined.withColumn("status", status.otherwise(F.lit("stored"))).drop("stored_modified")


def orphans(stored: DataFrame, pages: DataFrame) -> DataFrame:
    """Stored ``(url, source_id)`` missing from a full snapshot.

    Only sources that occur in the snapshot are considered, so an empty snapshot of a source
    never deletes it.
    """
    seen = pages.select("source_id").distinct()
    present = pages.select("url", "source_id").distinct()
    known = stored.select("url", "source_id").distinct().join(seen, "source_id", "left_semi")
    return known.join(present, ["url", "source_id"], "left_anti").select("url", "source_id")


def sync(
    pages: DataFrame,
    chunks: DataFrame,
    examples: DataFrame,
    *,
    full: bool = False,
    skip_unchanged: bool = True,
    size: int = tx.CHUNK_SIZE,
    min_code_length: int = tx.MIN_CODE_LENGTH,
    meta: Column | None = None,
    order: str = "last_modified",
) -> SyncResult:
    """Next state of the chunk and example tables for a snapshot
    ``(url, source_id, markdown, last_modified)``.

    Chunks carry no vectors yet where they are new; embedding is a separate step over
    ``embedding IS NULL``.  ``full`` also removes pages missing from the snapshot.  Of several
    rows for one (url, source_id) the last by ``order`` counts, then by its text.  ``touched``
    has the URLs whose stored rows change.
    """
    pages = last_per_key(pages, ["url", "source_id"], [order, "markdown"])
    # A partial snapshot only needs the stored state of its own pages.
    known = chunks if full else tables.match_keys(chunks, pages, ["url"], "left_semi")
    stored = stored_state(known)
    judged = cut_lineage(page_status(pages, stored, skip_unchanged=skip_unchanged))
    changed = judged.filter(F.col("status") == "stored")
    extra = F.struct("last_modified") if meta is None else meta
    new_chunks = _rows_like(chunks, ck.chunk_rows(_with_meta(changed, extra), size=size, extra=F.col("_meta")))
    blocks = ck.code_blocks(
        changed.select("url", "source_id", "last_modified", "markdown"), min_length=min_code_length
    )
    new_examples = _rows_like(
        examples,
        blocks.select(
            ck.chunk_id().alias("id"),
            "url",
            "chunk_number",
            F.col("code").alias("content"),
            F.lit(model.DEFAULT_CODE_SUMMARY).alias("summary"),
            F.to_json(
                F.struct(
                    F.col("chunk_number").alias("chunk_index"),
                    "url",
                    F.col("source_id").alias("source"),
                    F.length("code").alias("char_count"),
                    tx.word_count(F.col("code")).alias("word_count"),
                    "language",
                )
            ).alias("metadata"),
            "source_id",
        ),
    )
    gone = orphans(stored, pages) if full else stored.select("url", "source_id").filter(F.lit(False))
    gone = cut_lineage(gone)
    changed_urls = changed.select("url")
    kept_chunks = tables.match_keys(chunks, changed_urls, ["url"], "left_anti")
    kept_examples = tables.match_keys(examples, changed_urls.union(gone.select("url")), ["url"], "left_anti")
    if full:
        kept_chunks = tables.match_keys(kept_chunks, gone, ["url", "source_id"], "left_anti")
    # Counted inside the page's row; pages that are not stored are not taken apart.
    stored_text = F.when(F.col("status") == "stored", F.col("markdown")).otherwise(F.lit(""))
    counted = judged.select("url", "source_id", "status", stored_text.alias("markdown"), stored_text.alias("_text"))
    counted = ck.chunk_arrays(counted, size=size)
    counted = ck.code_block_arrays(counted, text_col="_text", min_length=min_code_length)
    outcomes = counted.select(
        "url",
        "source_id",
        "status",
        F.size("chunks").cast("long").alias("chunks_stored"),
        F.size("blocks").cast("long").alias("code_examples_stored"),
    )
    return SyncResult(
        outcomes=outcomes,
        chunks=kept_chunks.select(*chunks.columns).unionByName(new_chunks),
        examples=kept_examples.select(*examples.columns).unionByName(new_examples),
        orphans=gone,
        summary=corpus_stats.outcome_summary(outcomes, gone),
        touched=changed_urls.union(gone.select("url")).distinct(),
    )


def _with_meta(pages: DataFrame, meta: Column) -> DataFrame:
    """Pages with their extra metadata carried as one column through chunking."""
    return pages.select("url", "source_id", "markdown", meta.alias("_meta"))


def _rows_like(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` in the columns of ``table``; columns not computed yet are NULL."""
    return rows.select(
        *(
            F.col(f.name).cast(f.dataType).alias(f.name)
            if f.name in rows.columns
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in table.schema
        )
    )


def reembed(table: DataFrame, embed, dim: int, *, text_col: str = "content") -> DataFrame:
    """All rows with vectors recomputed in a new dimension."""
    rows = model.embed_texts(table.drop("embedding"), embed, dim, text_col=text_col)
    return rows.select(*table.columns)


def migrate(table: DataFrame, sources: DataFrame, embed, dim: int, root: str, *, text_col: str = "content") -> DataFrame:
    """Re-embed ``table`` into a table at the new path ``root`` and report on what stands there.

    The old table stays in place as the backup.  The report is ``integrity_report`` with ``digests_match``: whether the
    rows, but for their vectors, are the same many times the same, told without a join.
    """
    tables.publish(reembed(table, embed, dim, text_col=text_col), root)
    moved = tables.current(table.sparkSession, root, table.schema)
    kept = [c for c in table.columns if c != "embedding"]
    same = corpus_stats.same_rows(table.select(*kept), moved.select(*kept))
    return corpus_stats.integrity_report(moved, None, sources, dim).withColumn("key", F.lit(0)).join(same.withColumn("key", F.lit(0)), "key").drop("key")


