"""Vector expressions over ARRAY<FLOAT>, computed in double."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Similarities are rounded to this many places before they are ranked, so that the order of
# near ties does not depend on how rows were batched or partitioned.
RANK_PLACES = 9


def literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(a: Column) -> Column:
    return F.sqrt(
        F.aggregate(a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0.0 when either vector has zero length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0.0, F.lit(0.0)).otherwise(dot(a, b) / lengths)


def cosine_to(a: Column, vector: Sequence[float]) -> Column:
    """Cosine similarity to a constant vector whose length is computed once."""
    length = sum(float(x) * float(x) for x in vector) ** 0.5
    if length == 0.0:
        return F.lit(0.0)
    own = norm(a)
    return F.when(own == 0.0, F.lit(0.0)).otherwise(dot(a, literal(vector)) / (own * F.lit(length)))


def fit_dimension(a: Column, dim: int) -> Column:
    """Truncate or zero-pad to ``dim``."""
    padding = F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(dim) - F.size(a), F.lit(0)))
    return F.concat(F.slice(a, 1, dim), padding)


def is_unusable(a: Column) -> Column:
    """Missing, empty or all-zero embedding."""
    return F.coalesce(F.forall(a, lambda x: x == 0), F.lit(True))


def has_dimension(a: Column, dim: int) -> Column:
    return F.coalesce(F.size(a) == dim, F.lit(False))
