"""Stored tables: replace by key, upsert, delete, and writes that only touch what changed.

The functions compute the next state of a table.  A table is stored as a partitioned Parquet table: hash buckets of
its key are the partition column, ``publish`` overwrites the buckets that changed (Spark's dynamic partition
overwrite) and readers prune to the buckets they ask for.  An overwrite only reaches partitions it has rows for, so
every bucket also holds a marker, a row without a key, that is written with it; a bucket that loses all its rows is
emptied all the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartula.operators.ranking import last_per_key
from chartula.session import cut_lineage


def match_keys(table: DataFrame, wanted: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join of a large table with the distinct keys of ``wanted``.

    The keys are worked out first, so Spark knows their size in bytes when it picks the join.
    """
    return table.join(cut_lineage(wanted.select(*keys).distinct()), list(keys), how)


def replace_by_key(
    existing: DataFrame, incoming: DataFrame, key: str | Sequence[str]
) -> DataFrame:
    """Drop every stored row whose key is in ``incoming`` and add the incoming rows."""
    keys = [key] if isinstance(key, str) else list(key)
    kept = match_keys(existing, incoming, keys, "left_anti")
    return kept.unionByName(incoming.select(*existing.columns))


def replace_by_url(existing: DataFrame, incoming: DataFrame, order: str | None = None) -> DataFrame:
    """Chunk and code-example sink: replaces whole pages.

    With ``order``, of several incoming rows for one (url, chunk_number) the last wins.
    """
    if order is not None:
        incoming = last_per_key(incoming, ["url", "chunk_number"], [order])
    return replace_by_key(existing, incoming, "url")


def replace_repository(existing: DataFrame, incoming: DataFrame, repos: DataFrame) -> DataFrame:
    """Clear the given repositories, also those the rebuild left empty, then add the new rows."""
    kept = match_keys(existing, repos, ["repo"], "left_anti")
    return kept.unionByName(incoming.select(*existing.columns))


def delete_by_url(table: DataFrame, urls: DataFrame) -> DataFrame:
    return match_keys(table, urls, ["url"], "left_anti")


def upsert_sources(existing: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """New summary and word count replace the old ones; the creation time is kept."""
    old, new = existing.alias("o"), updates.alias("n")
    joined = old.join(new, F.col("o.source_id") == F.col("n.source_id"), "full_outer")
    is_new = F.col("n.source_id").isNotNull()

    def newest(column: str) -> Column:
        return F.when(is_new, F.col(f"n.{column}")).otherwise(F.col(f"o.{column}")).alias(column)

    return joined.select(
        F.coalesce("n.source_id", "o.source_id").alias("source_id"),
        newest("summary"),
        newest("total_words"),
        F.coalesce("o.created_at", now).alias("created_at"),
        F.when(is_new, now).otherwise(F.col("o.updated_at")).alias("updated_at"),
    )


def missing_sources(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Referential check: source ids used by chunks but absent from the source table."""
    return chunks.select("source_id").distinct().join(sources, "source_id", "left_anti")


# --- storage ---------------------------------------------------------------------------------

# Buckets of a table (many more for a large one), the column they are made of, and files of a bucket.
BUCKETS = 64
BUCKET_KEY = "url"
FILES = 4
BUCKET = "bucket"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def buckets_of(keys: DataFrame, key: str = BUCKET_KEY, buckets: int = BUCKETS) -> list[int]:
    """The buckets some keys fall into: at most as many numbers as there are buckets."""
    return sorted(row[0] for row in keys.select(bucket_of(F.col(key), buckets)).distinct().collect())


def publish(df: DataFrame, root: str, touched: Sequence[int] | None = None, key: str = BUCKET_KEY, buckets: int = BUCKETS) -> None:
    """Store ``df`` as the next state of its table.

    With ``touched``, only these buckets have changed: the rows of all others are left out of the
    write and keep their files.  Rows without a key are not kept.  ``df`` may be read from the table itself.
    """
    spark = df.sparkSession
    rows = df.filter(F.col(key).isNotNull()).withColumn(BUCKET, bucket_of(F.col(key), buckets))
    markers = spark.range(buckets).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema), F.col("id").cast("int").alias(BUCKET))
    both = rows.unionByName(markers)
    if touched is not None:
        both = both.filter(F.col(BUCKET).isin([int(b) for b in touched]))
    # A bucket lies in a few files by hash, whatever its size and the number of tasks that made its rows.
    dealt = both.repartition(F.col(BUCKET), F.pmod(F.xxhash64(F.lit(1), *df.columns[:3]), F.lit(FILES)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(root)


def create(spark: SparkSession, root: str, schema: T.StructType, key: str = BUCKET_KEY, buckets: int = BUCKETS) -> None:
    """An empty table, where there is none yet."""
    if current(spark, root, schema, key=key) is None:
        publish(spark.createDataFrame([], schema), root, key=key, buckets=buckets)


def current(spark: SparkSession, root: str, schema: T.StructType, only: Sequence[int] | None = None, key: str = BUCKET_KEY) -> DataFrame | None:
    """The table as last published, or only some of its buckets (no other partition is read); None before the first time."""
    try:
        rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(root)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if only is not None:
        rows = rows.filter(F.col(BUCKET).isin([int(b) for b in only]))
    return rows.filter(F.col(key).isNotNull()).drop(BUCKET)
