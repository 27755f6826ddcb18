"""Snapshot files arriving in a folder, synchronised batch by batch.

The stream keeps the last modification stamp of every page as state, so a micro-batch finds unchanged pages without
reading the stored tables; only the buckets of pages that did change are read and overwritten.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from chartula.plans.sync import sync
from chartula.schemas import CHUNKS, CODE_EXAMPLES
from chartula.sources import tables

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastStamp(StatefulProcessor):
    """Of a page's snapshots in a batch hands on the last one, if its stamp is not the one that was handed on before.

    The last is the one with the greatest stamp, then text, as in the batch form.  A page without a stamp always
    counts as changed; a blank page is never handed on and leaves the state as it is.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stamp = handle.getValueState("stamp", T.StructType([T.StructField("stamp", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for some in rows:
            for row in some.to_dict("records"):
                order = (row["last_modified"] is not None, row["last_modified"] or "", row["markdown"] is not None, row["markdown"] or "")
                if best is None or order > best[0]:
                    best = (order, row)
        row = best[1]
        if not (row["markdown"] or "").strip():
            return
        stamp = row["last_modified"] or ""
        if stamp and self.stamp.exists() and self.stamp.get()[0] == stamp:
            return
        self.stamp.update((stamp,))
        yield pd.DataFrame([row])

    def close(self) -> None:
        pass


def changed_pages(pages: DataFrame) -> DataFrame:
    """The pages of a stream ``(url, source_id, markdown, last_modified, ...)`` that differ from their last snapshot.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    keyed = pages.groupBy("url", "source_id")
    return keyed.transformWithStateInPandas(LastStamp(), outputStructType=pages.schema, outputMode="Append", timeMode="None")


def sync_stream(
    spark: SparkSession,
    snapshots: str,
    schema: T.StructType,
    chunk_root: str,
    example_root: str,
    checkpoint: str,
    *,
    fmt: str = "parquet",
    files_per_batch: int | None = None,
    buckets: int = tables.BUCKETS,
    **options,
) -> StreamingQuery:
    """Run every snapshot file not processed yet through the batch synchronisation.

    Each micro-batch overwrites the buckets of both tables that its changed pages fall into, a batch without changed
    pages none.  A batch that is run again starts from the same state and replaces the same pages, so replays do not
    duplicate rows.  With ``full``, or with ``skip_unchanged=False``, the batches go to the synchronisation as they are.
    """
    for root, own in ((chunk_root, CHUNKS), (example_root, CODE_EXAMPLES)):
        tables.create(spark, root, own, buckets=buckets)
    stateful = not options.get("full") and options.get("skip_unchanged", True)

    def apply(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        # The state has told unchanged pages; a page that was deleted from the store must not be judged by it.
        batch = batch.persist()
        try:
            only = None if options.get("full") else tables.buckets_of(batch, buckets=buckets)
            if only is not None and not only:
                return
            chunks = tables.current(session, chunk_root, CHUNKS, only)
            examples = tables.current(session, example_root, CODE_EXAMPLES, only)
            result = sync(batch, chunks, examples, **(options | {"skip_unchanged": False} if stateful else options))
            # Examples first: until the chunks are written, a replay finds all of its work still to do.
            touched = only if stateful else tables.buckets_of(result.touched, buckets=buckets)
            if touched:
                tables.publish(result.examples, example_root, touched, buckets=buckets)
                tables.publish(result.chunks, chunk_root, touched, buckets=buckets)
        finally:
            batch.unpersist()

    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    pages = reader.load(snapshots)
    if stateful:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
        pages = changed_pages(pages)
    return (
        pages.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
