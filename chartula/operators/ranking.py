"""Bounded top-k per group that does not depend on group size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16


def top_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    *,
    salt_on: Sequence[str] = (),
    rank: str = "rank",
    salts: int = SALTS,
) -> DataFrame:
    """The first ``k`` rows of every group under ``order``, with their 1-based ``rank``.

    With ``salt_on`` a group is first cut into ``salts`` parts by hash and reduced to ``k``
    rows per part, so a group that holds most of the table is spread over many tasks; both
    steps also drop rows map-side before the exchange.
    """
    if salt_on:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_on), F.lit(salts)))
        parts = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn(rank, F.row_number().over(parts)).filter(F.col(rank) <= k)
        df = df.drop("_salt", rank)
    groups = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(groups)).filter(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the smallest under ``order``; combined map-side."""
    return _pick(df, keys, order, F.min_by)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the largest under ``order``; combined map-side."""
    return _pick(df, keys, order, F.max_by)


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    chosen = pick(F.struct(*df.columns), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(chosen).select("_row.*")
