"""Vectors in blocks: the grid on which a query table meets all candidates.

A block holds up to ``BLOCK`` vectors of one length as one row (ids and a dense matrix as bytes). Every block
of queries meets every group of candidate blocks once; the pairs of blocks are formed by an equi-join on the
group's number, so the rows that move are blocks, not pairs of vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a block, at most; queries of a block, at most.
BLOCK, QUERY_BLOCK = 4096, 1024
BLOCK_SCHEMA = "dim int, ids binary, data binary"
HIT_SCHEMA = "query_id long, vec_id long, score {}"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector of rows with an id and finite components only (doubles)."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite)


def _packer(size: int, scale: float | None):
    def emit(dim: int, ids: list, parts: list) -> pa.RecordBatch:
        matrix = np.concatenate(parts).reshape(-1, dim)
        if scale is not None:
            matrix = np.floor(matrix * scale)
        columns = [pa.array([dim], pa.int32()), pa.array([np.concatenate(ids).astype("<i8").tobytes()]), pa.array([matrix.astype("<f8").tobytes()])]
        return pa.RecordBatch.from_arrays(columns, ["dim", "ids", "data"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, int]] = {}
        for batch in batches:
            vectors = batch.column("vector")
            lengths = np.diff(vectors.offsets.to_numpy())
            flat, begins = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths
            ids = batch.column("vec_id").to_numpy()
            for dim in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == dim)
                for at in range(0, len(rows), size):
                    own = rows[at : at + size]
                    values = flat[(begins[own][:, None] + np.arange(dim)).ravel()]
                    a, b, n = held.pop(dim, ([], [], 0))
                    a, b, n = [*a, ids[own]], [*b, values], n + len(own)
                    if n >= size:
                        yield emit(dim, a, b)
                    else:
                        held[dim] = (a, b, n)
        for dim, (a, b, _) in held.items():
            yield emit(dim, a, b)

    return pack


def blocks(vectors: DataFrame, size: int, scale: float | None = None) -> DataFrame:
    """``vectors(vec_id, vector)`` as blocks; with ``scale``, of floor(scale * x). Vectors without components are left out."""
    rows = vectors.filter(F.size("vector") > 0)
    return rows.mapInArrow(_packer(size, scale), BLOCK_SCHEMA)


def pair_up(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every block of queries beside every block of candidates of the same dimension.

    Candidate blocks are dealt into as many groups as there are shuffle partitions; a block of queries is
    sent to each group once and meets the group's blocks one after another.
    """
    groups = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    right = candidates.select("dim", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int").alias("group"), "ids", "data")
    left = queries.select("dim", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.col("ids").alias("query_ids"), F.col("data").alias("query_data"))
    return left.join(right.hint("shuffle_hash"), ["group", "dim"])


def search(vectors: DataFrame, queries: DataFrame, work: Callable, k: int, kind: str, scale: float | None = None) -> DataFrame:
    """The k best candidates of each query by ``work``, as query_id, rank, vec_id, score (``kind``).

    ``queries`` are rows of ``vectors``; an id among them that occurs more than once counts with its
    smallest vector. Only vectors of equal length meet.
    """
    asked = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    pairs = pair_up(blocks(asked, QUERY_BLOCK, scale=scale), blocks(vectors, BLOCK, scale=scale))
    hits = pairs.mapInArrow(scorer(work, k, "f8" if kind == "double" else "i8"), HIT_SCHEMA.format(kind))
    return merged(hits, k, kind)


class Best:
    """The k best hits of each query of a block so far."""

    def __init__(self, queries: int, k: int, kind: str):
        self.k = k
        self.rows, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.scores = np.zeros(0, kind)
        self.bar = np.full(queries, -np.inf)

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Hits as (query row, id, score); ``bar`` becomes the k-th best score, where there are k."""
        rows, ids, scores = (np.concatenate(x) for x in ((self.rows, rows), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, -scores if scores.dtype.kind == "f" else ~scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = place < self.k
        self.bar[rows[place == self.k - 1]] = scores[place == self.k - 1]
        self.rows, self.ids, self.scores = rows[kept], ids[kept], scores[kept]


def scorer(work: Callable, k: int, kind: str, tile: int = 256):
    """Run ``work(best, first, queries, own, ids, matrix)`` on tiles of the pairs of blocks that arrive.

    The pairs of one block of queries arrive one after another; its best hits leave when the next begins.
    ``own`` marks the pairs of a query with its own id.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, query_ids, best = None, None, None

        def leave() -> pa.RecordBatch:
            columns = [pa.array(query_ids[best.rows], pa.int64()), pa.array(best.ids, pa.int64()), pa.array(best.scores)]
            return pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])

        for batch in batches:
            for n in range(batch.num_rows):
                dim = batch.column("dim")[n].as_py()
                block = (dim, batch.column("query_ids")[n].as_py())
                if block != current:
                    if best is not None:
                        yield leave()
                    current, query_ids = block, np.frombuffer(block[1], "<i8")
                    best = Best(len(query_ids), k, kind)
                read = lambda name, type_: np.frombuffer(batch.column(name)[n].as_buffer(), type_)  # noqa: B023, E731
                queries, ids, matrix = read("query_data", "<f8").reshape(-1, dim), read("ids", "<i8"), read("data", "<f8").reshape(-1, dim)
                for at in range(0, len(queries), tile):
                    own = query_ids[at : at + tile, None] == ids[None, :]
                    work(best, at, queries[at : at + tile], own, ids, matrix)
        if best is not None:
            yield leave()

    return score


def _merger(k: int, kind: pa.DataType):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap: list[tuple] = []
        current: int | None = None

        def ranked() -> pa.RecordBatch:
            best = sorted(heap, reverse=True)
            columns = [pa.array([current] * len(best), pa.int64()), pa.array(range(1, len(best) + 1), pa.int32()), pa.array([-v for _, v in best], pa.int64()), pa.array([s for s, _ in best], kind)]
            return pa.RecordBatch.from_arrays(columns, ["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for query, vec_id, score in zip(*(batch.column(c).to_pylist() for c in ("query_id", "vec_id", "score")), strict=True):
                if query != current:
                    if heap:
                        yield ranked()
                    heap, current = [], query
                # The root is the worst that is kept: smallest score, then largest id.
                item = (score, -vec_id)
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
        if heap:
            yield ranked()

    return merge


def merged(hits: DataFrame, k: int, kind: str) -> DataFrame:
    """The k best hits of each query, merged by a heap: query_id, rank, vec_id, score."""
    rows = hits.repartition("query_id").sortWithinPartitions("query_id")
    return rows.mapInArrow(_merger(k, pa.float64() if kind == "double" else pa.int64()), f"query_id long, rank int, vec_id long, score {kind}")
