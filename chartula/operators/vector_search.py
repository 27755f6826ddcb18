"""Cosine top-k over stored vectors: one query, a table of queries, and coarse cells.

A single query is a plain expression plan (filter, similarity, ordered limit).  A table of
queries is scored block-wise: every task multiplies its Arrow batches with a block of queries
and keeps only its own best ``k`` per query, so the pairs are never rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartula.functions import vectors
from chartula.operators.ranking import top_per_group
from chartula.session import cut_lineage

# Queries a task holds, in bytes of doubles; no more than that is ever broadcast.
QUERY_BLOCK_BYTES = 16 * 1024 * 1024
# Similarities held at a time inside a task (queries x rows).
SCORE_TILE = 1_000_000
# Blocks of queries that a field of the grid holds at most.
GRID_BLOCKS = 4
# The cell of vectors without a direction; every query looks into it.
LOOSE_CELL = -1
# Stored rows and queries of a cell that meet in one task, at most on average; with many dimensions fewer, in
# bytes of doubles, but not less than the least.
CELL_ROWS, CELL_QUERIES = 65_536, 32_768
CELL_BYTES, LEAST_CELL_ROWS, LEAST_CELL_QUERIES = 32 * 1024 * 1024, 8_192, 4_096
# Queries of a tile, at most; rows that are scored in double precision before a bar is known, at least and for each hit.
QUERY_TILE, HEAD_ROWS, HEAD_FACTOR = 512, 256, 8


class DimensionMismatch(ValueError):
    """A stored or query vector does not have the configured dimension."""


def check_dimensions(df: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Aggregate form of the dimension guard: one row of counts."""
    good = vectors.has_dimension(F.col(column), dim)
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col(column).isNull()).alias("missing"),
        F.count_if(F.col(column).isNotNull() & ~good).alias("mismatched"),
    )


def require_dimension(df: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """``df`` unchanged; a row whose vector has another dimension fails the job."""
    size = F.size(column)
    message = F.concat(
        F.lit(f"embedding dimension mismatch: expected {dim}, got "), size.cast("string")
    )
    checked = F.when(F.col(column).isNull() | (size == dim), F.col(column)).otherwise(
        F.raise_error(message).cast(df.schema[column].dataType)
    )
    return df.withColumn(column, checked)


def top_k(
    chunks: DataFrame,
    query_vector: Sequence[float],
    k: int = 10,
    *,
    where: Column | None = None,
    prefilter: bool = True,
    id_col: str = "id",
    embedding_col: str = "embedding",
) -> DataFrame:
    """Best ``k`` rows for one query vector, ties broken by id.

    ``prefilter=False`` applies ``where`` after the ranking, which may return fewer rows.
    """
    rows = chunks.filter(F.col(embedding_col).isNotNull())
    if where is not None and prefilter:
        rows = rows.filter(where)
    rows = require_dimension(rows, len(query_vector), embedding_col)
    score = F.round(vectors.cosine_to(F.col(embedding_col), query_vector), vectors.RANK_PLACES)
    rows = (
        rows.withColumn("similarity", score)
        .drop(embedding_col)
        .orderBy(F.desc("similarity"), F.asc(id_col))
        .limit(k)
    )
    return rows.filter(where) if where is not None and not prefilter else rows


# --- tables of queries -----------------------------------------------------------------------


def top_k_multi(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = 10,
    *,
    id_col: str = "id",
    embedding_col: str = "embedding",
    query_id_col: str = "query_id",
    block_bytes: int = QUERY_BLOCK_BYTES,
) -> DataFrame:
    """Best ``k`` ids per query: ``(query_id, id, similarity, rank)``.

    ``queries`` has ``query_id`` and ``embedding``; queries and chunks without a vector take no part.
    A query table of one block is broadcast.  A larger one lies in the columns of a grid and the chunks in
    its rows: every field of the grid is one task's stream, first the queries, then the chunks.
    """
    asked = queries.select(query_id_col, embedding_col).filter(F.col(embedding_col).isNotNull())
    rows = chunks.select(id_col, embedding_col).filter(F.col(embedding_col).isNotNull())
    schema = _hit_schema(chunks, queries, id_col, query_id_col)
    count, dim = asked.agg(F.count(F.lit(1)), F.max(F.size(embedding_col))).first()
    if dim is None:
        return chunks.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(1))
    if count * 8 * dim <= block_bytes:
        hits = rows.mapInArrow(_block_scorer(asked, dim, k, schema), schema)
    else:
        columns = grid_columns(count * 8 * dim, GRID_BLOCKS * block_bytes, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        hits = _grid(rows, asked, columns).mapInArrow(_grid_scorer(dim, k, schema), schema)
    # A query has k hits of each task at most, so it needs no parts.
    return top_per_group(hits, [query_id_col], [F.desc("similarity"), F.asc(id_col)], k)


def grid_columns(query_bytes: int, block_bytes: int, fields: int) -> int:
    """Columns of a grid: enough for blocks of this size, and somewhat more columns than rows.

    A chunk is copied once a column; a query once a row, and its hits of each row are merged.
    """
    return max(-(-query_bytes // block_bytes), math.ceil(1.5 * math.sqrt(fields)))


def _hit_schema(chunks, queries, id_col, query_id_col) -> T.StructType:
    return T.StructType(
        [
            T.StructField(query_id_col, queries.schema[query_id_col].dataType),
            T.StructField(id_col, chunks.schema[id_col].dataType),
            T.StructField("similarity", T.DoubleType()),
        ]
    )


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.list_value_length(column)
    if len(column) and pc.any(pc.not_equal(lengths, dim)).as_py():
        raise DimensionMismatch(f"expected {dim} dimensions, got {pc.unique(lengths).to_pylist()}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), dim)


def _unit(matrix: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


class _Best:
    """The best rows so far for each query of a block."""

    def __init__(self, ids: pa.Array, vectors_: pa.Array, dim: int, k: int, names: list[str]):
        self.ids, self.matrix, self.dim, self.k = ids, _unit(_matrix(vectors_, dim)), dim, k
        self.query_id, self.id, _ = self.names = names
        self.kept: pa.Table | None = None

    def add(self, ids: pa.Array, vectors_: pa.Array) -> None:
        order = pc.sort_indices(ids)
        ids, stored = ids.take(order), _unit(_matrix(vectors_.take(order), self.dim)).T
        tile = max(1, SCORE_TILE // len(ids))
        found = []
        for first in range(0, len(self.matrix), tile):
            scores = np.round(self.matrix[first : first + tile] @ stored, vectors.RANK_PLACES)
            which, at = _best_positions(scores, self.k)
            found.append((which + first, at, scores[which, at]))
        which, at, scores = (np.concatenate(parts) for parts in zip(*found))
        part = pa.table({"q": which, self.id: ids.take(pa.array(at)), "similarity": scores})
        self.kept = part if self.kept is None else _merge(self.kept, part, self.id, self.k)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.kept is not None:
            found = [self.ids.take(self.kept.column("q").combine_chunks()), self.kept.column(self.id), self.kept.column("similarity")]
            yield from pa.table(found, names=self.names).to_batches()


def _block_scorer(asked: DataFrame, dim: int, k: int, schema: T.StructType):
    """Scores Arrow batches of (id, vector) with one block of queries, which the caller has measured."""
    held = asked.toArrow().combine_chunks()
    parts = [c.chunk(0) if c.num_chunks else c.combine_chunks() for c in held.columns]
    _matrix(parts[1], dim)
    shipped, names = asked.sparkSession.sparkContext.broadcast(parts), schema.names

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Best(*shipped.value, dim, k, names)
        for batch in batches:
            if batch.num_rows:
                found.add(batch.column(0), batch.column(1))
        yield from found.rows()

    return best


def _grid(rows: DataFrame, asked: DataFrame, columns: int) -> DataFrame:
    """Chunks in each column of their row, queries in each row of their column.

    A field holds one block of queries, whatever the number of rows; there are as many fields as the
    session has shuffle partitions, so the copies of the queries stay within one block a task.
    """
    height = max(1, -(-int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // columns))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    (query_id, vector), id_ = asked.columns, rows.columns[0]
    left = asked.select(F.lit(0).alias("_kind"), F.col(query_id).alias("_query"), F.lit(None).cast(rows.schema[id_].dataType).alias("_id"), F.col(vector).alias("_vector"), place(query_id, columns).alias("_column"), every(height).alias("_row"))
    right = rows.select(F.lit(1).alias("_kind"), F.lit(None).cast(asked.schema[query_id].dataType).alias("_query"), F.col(id_).alias("_id"), F.col(vector).alias("_vector"), place(id_, height).alias("_row"), every(columns).alias("_column"))
    both = left.unionByName(right).repartition(height * columns, "_row", "_column")
    return both.sortWithinPartitions("_row", "_column", "_kind")


def _grid_scorer(dim: int, k: int, schema: T.StructType):
    names = schema.names

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, queries, found = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("_row", "_column", "_kind")], axis=1)
            edges = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)], strict=True):
                if begin == end:
                    continue
                run = batch.slice(begin, end - begin)
                if field != tuple(keys[begin, :2]):
                    if found is not None:
                        yield from found.rows()
                    field, queries, found = tuple(keys[begin, :2]), [], None
                if keys[begin, 2] == 0:
                    queries.append(run)
                elif queries:
                    if found is None:
                        block = pa.Table.from_batches(queries).combine_chunks()
                        found = _Best(block.column("_query").chunk(0), block.column("_vector").chunk(0), dim, k, names)
                    found.add(run.column("_id"), run.column("_vector"))
        if found is not None:
            yield from found.rows()

    return best


def _best_positions(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column indices of the ``k`` best columns per row, ties to the left."""
    n = scores.shape[1]
    if n > k:
        bar = np.partition(scores, n - k, axis=1)[:, n - k, None]
        which, at = np.nonzero((scores >= bar) & (scores > -np.inf))
    else:
        which, at = np.nonzero(scores > -np.inf)
    order = np.lexsort((at, -scores[which, at], which))
    which, at = which[order], at[order]
    place = np.arange(len(which)) - np.searchsorted(which, which)
    return which[place < k], at[place < k]


def _merge(kept: pa.Table, part: pa.Table, id_col: str, k: int) -> pa.Table:
    both = pa.concat_tables([kept, part])
    both = both.take(
        pc.sort_indices(
            both,
            sort_keys=[("q", "ascending"), ("similarity", "descending"), (id_col, "ascending")],
        )
    )
    which = both.column("q").to_numpy()
    place = np.arange(len(which)) - np.searchsorted(which, which)
    return both.filter(pa.array(place < k))


# --- coarse cells (approximate search) ----------------------------------------------------------


def fit_cells(chunks: DataFrame, cells: int, *, embedding_col: str = "embedding", seed: int = 7):
    """K-means model whose clusters serve as the partition column of the chunk table."""
    from pyspark.ml.clustering import KMeans

    return KMeans(
        k=cells, seed=seed, featuresCol="_features", predictionCol="cell", distanceMeasure="cosine"
    ).fit(_features(chunks, embedding_col))


def _features(df: DataFrame, embedding_col: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    usable = df.filter(~vectors.is_unusable(F.col(embedding_col)))
    return usable.withColumn("_features", array_to_vector(F.col(embedding_col).cast("array<double>")))


def assign_cells(model, chunks: DataFrame, *, embedding_col: str = "embedding") -> DataFrame:
    """All rows with their ``cell``; missing and zero vectors, which have no direction, share LOOSE_CELL."""
    placed = model.transform(_features(chunks, embedding_col)).drop("_features")
    loose = chunks.filter(vectors.is_unusable(F.col(embedding_col))).withColumn("cell", F.lit(LOOSE_CELL))
    return placed.unionByName(loose)


def top_k_approx(
    model,
    celled: DataFrame,
    queries: DataFrame,
    k: int = 10,
    *,
    probes: int = 4,
    embedding_col: str = "embedding",
    **names: str,
) -> DataFrame:
    """Exact scoring restricted to the ``probes`` nearest cells of each query (and the loose cell).

    Rows and queries meet by cell: a query is sent to its cells only, and a task scores the rows of a
    cell with the queries that look into it.  Large cells are cut by a hash of the id.
    """
    names = {"id_col": "id", "query_id_col": "query_id"} | names
    id_col, query_id_col = names["id_col"], names["query_id_col"]
    dim = queries.select(F.max(F.size(embedding_col))).first()[0] or 0
    centers = np.array(model.clusterCenters(), dtype=np.float64)
    shipped = queries.sparkSession.sparkContext.broadcast(_unit(centers))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def nearest(found: pa.Array) -> pa.Array:
        near = np.argsort(-np.round(_unit(_matrix(found, dim)) @ shipped.value.T, vectors.RANK_PLACES), axis=1, kind="stable")[:, :probes]
        cells = np.concatenate([near, np.full((len(near), 1), LOOSE_CELL)], axis=1).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1) * cells.shape[1], pa.int32()), pa.array(cells.ravel()))

    rows = _without_loose_ties(celled.filter(F.col(embedding_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(embedding_col).alias("_vector"), "cell"), dim, k)
    asked = queries.filter(F.col(embedding_col).isNotNull()).select(F.col(query_id_col).alias("_query"), F.col(embedding_col).alias("_asked"), F.explode(nearest(F.col(embedding_col))).alias("cell"))
    # One row for each cell: the parts into which its rows and its queries are cut.
    most_rows, most_queries = cell_limits(dim)
    row_parts = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / most_rows).alias("_parts"))
    query_parts = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / most_queries).alias("_asks"))
    grid = cut_lineage(row_parts.join(query_parts, "cell"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = rows.join(grid, "cell").select("cell", "_id", "_vector", F.pmod(F.xxhash64("_id"), "_parts").alias("_part"), every("_asks").alias("_ask"))
    right = asked.join(grid, "cell").select("cell", "_query", "_asked", F.pmod(F.xxhash64("_query"), "_asks").alias("_ask"), every("_parts").alias("_part"))
    by = ["cell", "_part", "_ask"]

    def best(stored: pa.Table, wanted: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        which, at, scores = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        if stored.num_rows and wanted.num_rows:
            order = pc.sort_indices(stored.column("_id"))
            which, at, scores = _best_pairs(_unit(_matrix(wanted.column("_asked"), dim)), _unit(_matrix(stored.column("_vector").take(order), dim)), k)
            at = order.to_numpy()[at]
        return pa.table([wanted.column("_query").take(pa.array(which)), stored.column("_id").take(pa.array(at)), pa.array(scores)], names=[query_id_col, id_col, "similarity"])

    hits = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(best, _hit_schema(celled, queries, id_col, query_id_col))
    # A query has k hits of each part of its cells at most, so it needs no parts of its own.
    return top_per_group(hits, [query_id_col], [F.desc("similarity"), F.asc(id_col)], k)


def cell_limits(dim: int) -> tuple[int, int]:
    """Stored rows and queries of a cell that one task holds, at most on average."""
    held = CELL_BYTES // (8 * max(1, dim))
    return min(CELL_ROWS, max(LEAST_CELL_ROWS, held)), min(CELL_QUERIES, max(LEAST_CELL_QUERIES, held // 2))


def _without_loose_ties(rows: DataFrame, dim: int, k: int) -> DataFrame:
    """Of the rows without a direction, which are equally similar to any query, the first ``k`` ids."""
    loose = (F.col("cell") == LOOSE_CELL) & vectors.is_unusable(F.col("_vector"))
    same = rows.filter(loose)
    if dim:  # else no query has a vector, and none is compared
        same = require_dimension(same, dim, "_vector")
    return rows.filter(~loose).unionByName(same.orderBy(F.asc_nulls_last("_id")).limit(k))


# --- the k best of a block -----------------------------------------------------------------------


def _best_pairs(asked: np.ndarray, stored: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and rounded similarity of the ``k`` best rows of each query, ties by row; unit or zero vectors.

    Products in single precision, whose error is bounded, find the pairs that may be among the best; these are
    multiplied again in double precision. The bound never loses a pair.
    """
    rows = _first_of_equal(stored, k)
    if len(rows) < len(stored):
        stored = stored[rows]
    low = stored.astype(np.float32)
    flat = ~asked.any(axis=1)
    still, asking = np.flatnonzero(flat), np.flatnonzero(~flat)
    # Without a direction: similarity 0 to every row.
    first = np.arange(min(k, len(rows)))
    found = [(np.repeat(still, len(first)), np.tile(first, len(still)), np.zeros(len(still) * len(first)))]
    head = min(len(rows), max(HEAD_ROWS, HEAD_FACTOR * k))
    tile = min(QUERY_TILE, max(1, SCORE_TILE // head))
    for begin in range(0, len(asking), tile):
        own = asking[begin : begin + tile]
        which, at, scores = _tile_best(asked[own], stored, low, k, head)
        found.append((own[which], at, scores))
    which, at, scores = (np.concatenate(parts) for parts in zip(*found))
    return which, rows[at], scores


def _first_of_equal(stored: np.ndarray, k: int) -> np.ndarray:
    """Rows without those that ``k`` equal ones precede: these have the same similarities."""
    whole = np.ascontiguousarray(stored).view(np.dtype((np.void, stored.dtype.itemsize * stored.shape[1]))).ravel()
    order = np.argsort(whole, kind="stable")
    new = np.ones(len(order), bool)
    for begin in range(1, len(order), LEAST_CELL_ROWS):
        own = order[begin - 1 : begin + LEAST_CELL_ROWS]
        new[begin : begin + LEAST_CELL_ROWS] = whole[own[1:]] != whole[own[:-1]]
    begins = np.flatnonzero(new)
    place = np.arange(len(order)) - np.repeat(begins, np.diff([*begins, len(order)]))
    return np.sort(order[place < k])


def _tile_best(asked: np.ndarray, stored: np.ndarray, low: np.ndarray, k: int, head: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_best_pairs`` for a tile of queries: after the head the rows pass by, and the bars (k-th best so far) rise."""
    wide, (n, dim) = asked.astype(np.float32), stored.shape
    # Rounding to single precision, the sum of the products, and rounding to RANK_PLACES.
    error = (dim + 8) * 2.0**-24 + 10.0**-vectors.RANK_PLACES
    step = max(1, SCORE_TILE // len(asked))
    scores = np.round(asked @ stored[:head].T, vectors.RANK_PLACES)
    which, at = _best_positions(scores, k)
    best, bars = (which, at, scores[which, at]), np.full(len(asked), -np.inf)

    def raise_bars() -> None:
        which, _, scores = best
        place = _place(which, len(asked))
        bars[which[place == k - 1]] = scores[place == k - 1]

    raise_bars()
    fresh, pending, due = [best], 0, 2 * head
    products, above = np.empty(len(asked) * step, np.float32), np.empty(len(asked) * step, bool)
    left = head
    while left < n:
        right = min(n, due, left + step)
        shape, size = (len(asked), right - left), len(asked) * (right - left)
        tile = np.matmul(wide, low[left:right].T, out=products[:size].reshape(shape))
        np.greater_equal(tile, (bars - error).astype(np.float32)[:, None], out=above[:size].reshape(shape))
        spots = _true_spots(above[:size])
        if len(spots) * 32 > size:
            # Many ties: only what is above the bar itself can matter, as earlier rows go first.
            exact = asked @ stored[left:right].T
            which, at = np.nonzero(exact > (bars + 0.25 * 10.0**-vectors.RANK_PLACES)[:, None])
            scores = exact[which, at]
        else:
            which, at = np.divmod(spots, right - left)
            scores = _products(asked, stored, which, at + left)
        scores = np.round(scores, vectors.RANK_PLACES)
        better = scores > bars[which]
        fresh.append((which[better], at[better] + left, scores[better]))
        pending += len(fresh[-1][0])
        left = right
        if left == due or left == n or pending > SCORE_TILE:
            # Rows of a query come in order, and the sort is stable: ties stay in the order of rows.
            which, at, scores = (np.concatenate(parts) for parts in zip(*fresh))
            order = np.lexsort((-scores, which))
            order = order[_place(which[order], len(asked)) < k]
            best = which[order], at[order], scores[order]
            raise_bars()
            fresh, pending, due = [best], 0, 2 * left
    return best


def _place(which: np.ndarray, n: int) -> np.ndarray:
    """The place of each entry among those of its query; entries of a query stand together."""
    counts = np.bincount(which, minlength=n)
    return np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def _true_spots(flags: np.ndarray) -> np.ndarray:
    """Where flags are true, few of many; eight are looked at at a time."""
    if len(flags) % 8:
        return np.flatnonzero(flags)
    words = np.flatnonzero(flags.view(np.uint64))
    word, bit = np.nonzero(flags.reshape(-1, 8)[words])
    return words[word] * 8 + bit


def _products(asked: np.ndarray, stored: np.ndarray, which: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Products of pairs in double precision, some of them at a time."""
    out, step = np.empty(len(which)), max(1, SCORE_TILE // asked.shape[1])
    for first in range(0, len(which), step):
        part = slice(first, first + step)
        out[part] = np.einsum("ij,ij->i", asked[which[part]], stored[at[part]])
    return out
