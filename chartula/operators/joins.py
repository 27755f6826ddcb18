"""Equi-joins that stay balanced when one key holds much of the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 8


def salted_join(
    skewed: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    *,
    salt_on: Sequence[str],
    salts: int = SALTS,
) -> DataFrame:
    """Join a table with hot keys to a smaller one.

    Rows of ``skewed`` are spread over ``salts`` parts of their key by a hash of ``salt_on``,
    and every ``lookup`` row is repeated once per part.  ``how`` is inner, left or left_semi.
    """
    spread = skewed.withColumn("_salt", F.pmod(F.xxhash64(*salt_on), F.lit(salts)).cast("int"))
    parts = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    repeated = lookup.withColumn("_salt", parts)
    return spread.join(repeated, [*keys, "_salt"], how).drop("_salt")
