"""Nearest neighbours by block matrix join.

Queries and candidates meet in tiles. A tile multiplies vectors that are quantised to int8, each with a scale
of its own. The rounding of a component is at most half a step, which bounds the error of every product; pairs
whose upper bound stays below the k-th lower bound of their query (or below what is already certain) are out,
the others are multiplied again in double precision. Heaps merge the tiles' hits. The bounds never lose a
neighbour, so recall is 1.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartula.llm.vector_blocks import Best, search, usable

LEVELS = 127
#: Up to this many dimensions the sums of int8 products are exact in single precision.
SINGLE_DIMS = (1 << 24) // LEVELS**2


def quantised(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, the scale of each row, and the sum of the absolute values of each row."""
    scale = np.abs(matrix).max(axis=1) / LEVELS
    scale[scale == 0] = 1
    values = np.rint(matrix / scale[:, None]).astype(np.int8)
    return values, scale, np.abs(values.astype(np.int32)).sum(axis=1).astype(np.float64)


def tile_hits(best: Best, first: int, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, matrix: np.ndarray) -> None:
    """Add what a tile can contribute to the best hits of its queries."""
    (a, scale_a, sum_a), (b, scale_b, sum_b) = quantised(queries), quantised(matrix)
    dim = queries.shape[1]
    kind = np.float32 if dim <= SINGLE_DIMS else np.float64
    scales = scale_a[:, None] * scale_b
    middle = (a.astype(kind) @ b.astype(kind).T) * scales
    # |xy - x'y'| <= half a step of one times the other's rounded sum, both ways, plus the product of the halves.
    error = scales * (0.5 * (sum_a[:, None] + sum_b) + 0.25 * dim) * (1 + 1e-9)
    lower = np.where(own, -np.inf, middle - error)
    bar = best.bar[first : first + len(queries)].copy()
    if len(ids) >= best.k:
        bar = np.maximum(bar, np.partition(lower, len(ids) - best.k, axis=1)[:, len(ids) - best.k])
    rows, columns = np.nonzero((middle + error >= bar[:, None]) & ~own)
    scores = np.einsum("ij,ij->i", queries[rows], matrix[columns])
    best.add(rows + first, ids[columns], scores)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The k nearest (largest inner product) of each query: query_id, rank, vec_id, score.

    Queries are the rows of ``vectors(vec_id, embedding)`` whose vec_id is divisible by ``every``;
    candidates are all rows but those with the query's own id, nearest first, ties by smaller vec_id.
    Vectors that are null, zero, empty or hold null or non-finite components take no part, nor do rows
    without an id; vectors of other lengths than the query's are no candidates. Repeated rows are
    candidates each; other columns are not read; an empty table gives no rows.
    """
    usable_rows = usable(vectors).filter(F.exists("vector", lambda x: x != 0))
    return search(usable_rows, usable_rows.filter(F.col("vec_id") % every == 0), tile_hits, k, "double")
