"""Exact top-k by vector approximations.

Every block of candidates is scanned by its approximation first: each dimension is cut into ``CELLS`` cells of
equal width between the block's extremes, and a vector is known by its cell numbers. The edges of its cells
bound its score from above. Exact vectors are then read in the order of the bounds, best first, until the k-th
score found is above every bound that is left.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartula.llm.vector_blocks import Best, search, usable

CELLS = 64
#: Exact vectors that are read for a query at a time.
READ = 16
#: Components are multiplied by this and rounded down.
SCALE = 256.0
#: Integers up to this are exact in double precision; beyond it, Python's integers do the sums.
EXACT = float(1 << 53)
LONG = np.iinfo(np.int64)


def approximation(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell numbers (uint8) of each vector, and the edges of the cells: edges[d, c] to edges[d, c + 1]."""
    low, high = matrix.min(axis=0), matrix.max(axis=0)
    edges = low[:, None] + (high - low)[:, None] * (np.arange(CELLS + 1) / CELLS)
    edges[:, 0], edges[:, -1] = low, high
    width = np.where(high > low, high - low, 1) / CELLS
    cells = np.clip(np.floor((matrix - low) / width), 0, CELLS - 1).astype(np.uint8)
    # Rounding may put a value on the wrong side of an edge; then its cell is moved.
    place = np.arange(matrix.shape[1])
    cells -= (matrix < edges[place, cells]).astype(np.uint8)
    cells += (matrix > edges[place, cells + 1]).astype(np.uint8)
    return cells, edges


def upper_bounds(queries: np.ndarray, cells: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For each query and approximation the largest inner product that its cells allow."""
    place = np.arange(edges.shape[0])
    low, high = edges[place, cells], edges[place, cells + 1]
    bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    # Sums of edges are rounded; the margin keeps the bound above the score.
    margin = 1e-12 * (np.abs(queries) @ np.maximum(np.abs(low), np.abs(high)).max(axis=0))
    return bounds + margin[:, None]


def exact_scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer inner products of rows, held at the ends of the range of 64 bits."""
    if not len(left):
        return np.zeros(0, np.int64)
    if np.abs(left).max() * np.abs(right).max() * left.shape[1] < EXACT:
        return np.einsum("ij,ij->i", left, right).astype(np.int64)
    sums = (sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for x, y in zip(left, right, strict=True))
    return np.array([min(max(s, LONG.min), LONG.max) for s in sums], np.int64)


def scan(best: Best, first: int, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, matrix: np.ndarray) -> None:
    """Add what a tile can contribute to the best hits of its queries."""
    cells, edges = approximation(matrix)
    bounds = np.where(own, -np.inf, upper_bounds(queries, cells, edges))
    rows = np.arange(len(queries))
    while len(rows):
        take = min(READ, len(ids))
        columns = np.argpartition(bounds[rows], len(ids) - take, axis=1)[:, len(ids) - take :]
        found = bounds[rows[:, None], columns]
        # Equal scores are read too: the smaller id counts.
        wanted = (found > -np.inf) & (found >= best.bar[first + rows][:, None])
        r, c = np.nonzero(wanted)
        r, c = rows[r], columns[r, c]
        best.add(r + first, ids[c], exact_scores(queries[r], matrix[c]))
        bounds[r, c] = -np.inf
        rows = rows[wanted.all(axis=1)] if take < len(ids) else rows[:0]


def exact_top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = SCALE) -> DataFrame:
    """The k highest integer inner products of each query: query_id, rank, vec_id, score.

    Components become floor(scale * x). Queries are the rows of ``vectors(vec_id, embedding)`` whose
    vec_id is divisible by ``every``; candidates are all rows but those with the query's own id, highest
    score first, ties by smaller vec_id. Vectors that are null, empty or hold null or non-finite
    components take no part, nor do rows without an id; vectors of other lengths than the query's are no
    candidates; scores beyond 64 bits are held at the end of the range. Repeated rows are candidates
    each; other columns are not read; an empty table gives no rows.
    """
    usable_rows = usable(vectors)
    return search(usable_rows, usable_rows.filter(F.col("vec_id") % every == 0), scan, k, "long", scale)
