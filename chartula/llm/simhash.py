"""Near-duplicates by SimHash, compared exactly in tiles.

Equal fingerprints are one vertex from the start. Fingerprints are laid out in cells by the population counts of
their two halves: within the radius, the counts of two fingerprints differ by no more than the radius in sum, so
a cell only meets the cells around it. Cells are cut into tiles of bounded size; a task holds one tile and streams
what has to meet it. Large products are split again by the population counts of quarters, eighths and sixteenths,
and pairs of groups that are too far apart are skipped; what is left is one exclusive-or and bit count a pair.
A task reports a spanning forest of its links, never all pairs of a group, and components are found by
contracting edges in rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartula.llm.common import gathered, stored, tidied

WORDS, SEED, RADIUS = 4, 42, 4
#: Fingerprints of a tile, on average at most; pairs that are compared at a time; hashes that are counted at a time.
TILE, PRODUCT, COUNTED = 1 << 16, 1 << 21, 1 << 16


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64 bits, each set if it is set in more than half of the shingles' XXH64 hashes (A-Z lower-cased)."""
    # Both only treat ASCII: lower() A-Z, split() space, tab, LF, VT, FF and CR.
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    begins = [0, *accumulate(len(p) + 1 for p in parts)]
    size = min(words, len(parts))
    hashes = (xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(begins, begins[size:]))
    total, counts, left = len(parts) - size + 1, np.zeros(64, np.int64), len(parts) - size + 1
    while left:
        own = np.fromiter(hashes, ">u8", min(left, COUNTED))
        counts += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        left -= len(own)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def fingerprint_column(text: Column, words: int = WORDS) -> Column:
    @F.pandas_udf(T.LongType())
    def column(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(t, words) for t in texts), np.uint64, len(texts)).view(np.int64))

    return column(text)


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, parts: int = 4) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes of all pairs of fingerprints (uint64) that differ in at most ``radius`` bits."""
    if len(a) * len(b) <= PRODUCT or parts > 16:
        step = max(1, PRODUCT // max(1, len(b)))
        for at in range(0, len(a), step):
            i, j = np.nonzero(np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius)
            yield i + at, j
        return
    width = 64 // parts
    mask = np.uint64((1 << width) - 1)
    groups = []
    for values in (a, b):
        counts = np.stack([np.bitwise_count((values >> np.uint64(width * p)) & mask) for p in range(parts)], axis=1)
        # Population counts of a part take five bits; numbers of the different lists of counts.
        codes = (counts.astype(np.uint64) << (np.arange(parts, dtype=np.uint64) * np.uint64(64 // parts if parts > 12 else 5))).sum(axis=1, dtype=np.uint64)
        _, first, number = np.unique(codes, return_index=True, return_inverse=True)
        order = np.argsort(number, kind="stable")
        groups.append((counts[first].astype(np.int16), np.split(order, np.cumsum(np.bincount(number))[:-1])))
    (lists_a, rows_a), (lists_b, rows_b) = groups
    for counts, own in zip(lists_a, rows_a, strict=True):
        near = np.flatnonzero(np.abs(lists_b - counts).sum(axis=1) <= radius)
        if len(near):
            met = np.concatenate([rows_b[n] for n in near])
            for i, j in close_pairs(a[own], b[met], radius, parts * 2):
                yield own[i], met[j]


def forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each vertex of some links to the smallest vertex of its component."""
    vertices, number = np.unique(np.concatenate([left, right]), return_inverse=True)
    i, j = np.split(number, 2)
    label = np.arange(len(vertices))
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, before[i], low)
        np.minimum.at(label, before[j], low)
        label = label[label]
        if (label == before).all():
            break
    moved = label != np.arange(len(vertices))
    return vertices[moved], vertices[label[moved]]


def _tile_links(radius: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, own, held = None, [], None

        def links(other: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i, j in close_pairs(held, other, radius):
                if len(i):
                    a, b = held[i].view(np.int64), other[j].view(np.int64)
                    a, b = forest(a[a != b], b[a != b])
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["src", "dst"])

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if held is None and own:
                held = np.concatenate(own)
                yield from links(held)

        # Rows come by tile, its own fingerprints first.
        for batch in batches:
            columns = gathered(iter([batch]))
            if columns is None:
                continue
            starts = np.flatnonzero(np.diff(columns["tile"]) | np.diff(columns["visitor"].astype(np.int8))) + 1
            for rows in np.split(np.arange(batch.num_rows), starts):
                number, visitor = columns["tile"][rows[0]], columns["visitor"][rows[0]]
                values = columns["fp"][rows].view(np.uint64)
                if number != tile:
                    yield from settle()
                    tile, own, held = number, [], None
                if not visitor:
                    own.append(values)
                else:
                    yield from settle()
                    if held is not None:
                        yield from links(values)
        yield from settle()

    return compare


def tiled(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """tile, visitor, fp: each tile's own fingerprints, and those of other tiles that have to meet it."""
    high, low = F.bit_count(F.shiftrightunsigned("fp", 32)), F.bit_count(F.col("fp").bitwiseAND((1 << 32) - 1))
    placed = fps.select("fp", (high * 33 + low).alias("cell"))
    # At most 33 * 33 rows, whatever the table.
    cells = placed.groupBy("cell").count().select("cell", F.ceil(F.col("count") / TILE).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts").cast("long"))
    own = placed.join(F.broadcast(cells), "cell").select("fp", "cell", part.alias("part"), "parts")
    tile = (F.shiftleft(F.col("cell").cast("long"), 40) + F.col("part")).alias("tile")
    residents = own.select(tile, F.lit(False).alias("visitor"), "fp")
    later = F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1))
    within = own.filter("part + 1 < parts").select("fp", "cell", later.alias("part")).select(tile, F.lit(True).alias("visitor"), "fp")
    steps = [(h, w) for h in range(radius + 1) for w in range(-radius, radius + 1) if h + abs(w) <= radius and (h, w) > (0, 0)]
    around = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(w).alias("w")) for h, w in steps])
    moved = placed.select("fp", "cell", F.explode(around).alias("step")).filter((F.col("cell") % 33 + F.col("step.w")).between(0, 32))
    visits = moved.select("fp", (F.col("cell") + 33 * F.col("step.h") + F.col("step.w")).alias("cell")).join(F.broadcast(cells), "cell")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))
    visitors = visits.select("fp", "cell", every.alias("part")).select(tile, F.lit(True).alias("visitor"), "fp")
    return residents.unionByName(within).unionByName(visitors)


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """src, dst: edges that connect all fingerprints (column fp, distinct) within ``radius`` bits, and no others."""
    rows = tiled(fps, radius).repartition("tile").sortWithinPartitions("tile", "visitor")
    return rows.mapInArrow(tidied(_tile_links(radius)), "src long, dst long")


def components(edges: DataFrame) -> DataFrame:
    """vertex, root for every vertex of ``edges(src, dst)`` that is not the root of its component.

    In a round each vertex moves to the smallest of itself and its neighbours, by a hash of each round's own, so that
    no order of the numbers makes a path slow; edges move along and loops go, until no edge is left. Then the moves
    are followed to their end.
    """
    moves = []
    edges = stored(edges.distinct(), "edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        rank = lambda c, n=len(moves): F.xxhash64(F.lit(n), c)
        nearest = both.groupBy("src").agg(F.min_by("dst", rank("dst")).alias("to"))
        lower = (rank("to") < rank("src")) | ((rank("to") == rank("src")) & (F.col("to") < F.col("src")))
        move = stored(nearest.select(F.col("src").alias("vertex"), F.when(lower, F.col("to")).otherwise(F.col("src")).alias("root")), "moves")
        moves.append(move)
        at = edges
        for end in ("src", "dst"):
            at = at.join(move.withColumnRenamed("vertex", end), end).drop(end).withColumnRenamed("root", end)
        edges = stored(at.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "edges")
    if not moves:
        return edges.select(F.col("src").alias("vertex"), F.col("dst").alias("root"))
    reached = moves.pop()
    while moves:
        earlier = moves.pop()
        later = reached.select(F.col("vertex").alias("root"), F.col("root").alias("end"))
        reached = stored(earlier.join(later, "root", "left").select("vertex", F.coalesce("end", "root").alias("root")), "reached")
    return reached.filter("vertex <> root")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """doc_id, fp (long), component_id, root per row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest doc_id that can be reached over fingerprints (of ``words``-word shingles) at most
    ``radius`` bits apart. Null and wordless texts have the fingerprint 0 and are linked like any other. Rows with a null
    id are linked too; a component without any id has a null component_id. ``root`` is one fingerprint of
    the component and tells all components apart. Repeated rows are returned
    each, an empty table gives no rows, other columns are not read.
    """
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_column(F.col("text").cast("string"), words).alias("fp")), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes.select("fp"), radius))
    rooted = stored(classes.join(roots.withColumnRenamed("vertex", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(least, "root").select("fp", "component_id", "root")
    return rows.join(labels, "fp").select("doc_id", "fp", "component_id", "root")


def fingerprint_hex(fp: Column) -> Column:
    """A fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
