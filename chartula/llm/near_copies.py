"""Near copies by the words they share: sets of five-word shingles whose Jaccard similarity is 0.8 or more.

Equal sets are one vertex from the start. Bands of minimum hashes only propose pairs: 32 bands of 5 rows miss a pair
of similarity 0.8 with a probability of 3 in a million, and more similar ones less often. First each set is compared
with one smallest set of its buckets; then, in buckets that still hold several components, all pairs across components
are looked at by their sizes and by a byte of each minimum hash, tile by tile, each pair in the first band it shares;
those that may be near copies are compared, the likeliest first, unless their components have been joined meanwhile.
Pairs that another method proposes are compared with the first ones. Every link is decided on the whole sets of shingles, made anew from texts: no sets are stored, and no texts are moved
but those of documents in such buckets or pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartula.llm.common import gathered, stored, tidied
from chartula.llm.simhash import components
from chartula.operators.joins import salted_join

WORDS, SEED = 5, 42
BANDS, ROWS = 32, 5
#: Shingles that are hashed at a time.
COUNTED = 1 << 12
#: Of the bytes of 160 minimum hashes, a pair of similarity 0.8 shares fewer than this three times in a million.
SHARED = 105
#: A set with more pairs than this is dealt out to so many parts; sets of a bucket that are compared at a time.
PAIRS, SALTS, TILE = 256, 64, 1 << 10
#: Texts that are fetched by a broadcast of their keys (8 bytes each); more are fetched by a shuffle.
BROADCAST_KEYS = 1_000_000
SKETCH_SCHEMA = "doc_id long, fp long, place long, size int, sketch binary, bands array<long>"

_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)
_TERMS = _RANDOM.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The different XXH64 hashes of a text's shingles, sorted (A-Z lower-cased; a shorter text is one shingle)."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    begins = [0, *accumulate(len(p) + 1 for p in parts)]
    size = min(words, len(parts))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(begins, begins[size:])), np.uint64))


def set_digest(hashes: np.ndarray) -> int:
    """64 bits that tell sets of shingles apart."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minimum hashes of a set that is not empty."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
    for at in range(0, len(short), COUNTED):
        np.minimum(least, (short[None, at : at + COUNTED] * _FACTORS + _TERMS).min(axis=1), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """A number for each band of a signature."""
    return np.array([xxhash.xxh64_intdigest(rows.tobytes(), n) for n, rows in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def sketch(least: np.ndarray) -> bytes:
    """A byte of each minimum hash."""
    return (least & np.uint32(255)).astype(np.uint8).tobytes()


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "fp", "place", "size", "sketch", "bands"]
    for batch in batches:
        fps, sizes, sketches, numbers = [], [], [], []
        texts = batch.column("text")
        for n in range(batch.num_rows):
            held = shingles(texts[n].as_py())
            least = signature(held) if len(held) else None
            fps.append(set_digest(held))
            sizes.append(len(held))
            sketches.append(b"" if least is None else sketch(least))
            numbers.append(np.zeros(0, np.int64) if least is None else bands(least).view(np.int64))
        ends = np.concatenate([[0], np.cumsum([len(b) for b in numbers])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *numbers])))
        columns = [batch.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64)), batch.column("place"), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), lists]
        yield pa.RecordBatch.from_arrays(columns, names)


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """band, fp: once for all equal sets of a batch, so copies do not pile up in a band."""
    for batch in batches:
        _, first = np.unique(batch.column("fp").to_numpy(), return_index=True)
        own = batch.take(pa.array(first))
        lists = own.column("bands")
        repeated = np.repeat(own.column("fp").to_numpy(), np.diff(lists.offsets.to_numpy()))
        yield pa.RecordBatch.from_arrays([lists.flatten(), pa.array(repeated)], ["band", "fp"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([set_digest(shingles(t)) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps)], [*batch.schema.names, "fp"])


def with_digest(rows: DataFrame) -> DataFrame:
    """``rows`` with the digest of the shingles of their column text as the column fp."""
    return rows.mapInArrow(tidied(_digests), rows.withColumn("fp", F.lit(0).cast("long")).schema)


def alike(one: np.ndarray, other: np.ndarray) -> bool:
    """Whether two sets have a similarity of 0.8 or more, in whole numbers."""
    if 5 * min(len(one), len(other)) < 4 * max(len(one), len(other)):
        return False
    return 9 * len(np.intersect1d(one, other, assume_unique=True)) >= 4 * (len(one) + len(other))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """src, dst of pairs that are alike; each part of a src begins with the src's own text."""
    key, held = None, None
    for batch in batches:
        found: list[tuple[int, int]] = []
        columns = [batch.column(c) for c in ("src", "salt", "dst")]
        texts = batch.column("text")
        for n, (src, salt, dst) in enumerate(zip(*(c.to_pylist() for c in columns), strict=True)):
            if (src, salt) != key:
                key, held = (src, salt), shingles(texts[n].as_py())
            elif src != dst and alike(held, shingles(texts[n].as_py())):
                found.append((src, dst))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["src", "dst"])


def _texts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """fp and text for ``wanted(fp, place)``: one text of each set."""
    wanted = stored(wanted, "places")
    places = wanted.select("place")
    if wanted.count() <= BROADCAST_KEYS:
        places = F.broadcast(places)
    texts = docs.select("place", "text").join(places, "place", "left_semi").groupBy("place").agg(F.min("text").alias("text"))
    return texts.join(wanted, "place").select("fp", "text")


def _linked(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """src, dst: the pairs whose sets are alike. A src with many pairs is dealt out, with its text, to several tasks."""
    hot = pairs.groupBy("src").count().filter(F.col("count") > PAIRS).select("src", F.lit(SALTS).alias("salts"))
    dealt = pairs.join(hot, "src", "left").withColumn("salt", F.pmod(F.xxhash64("dst"), F.coalesce("salts", F.lit(1))).cast("int")).select("src", "salt", "dst")
    asked = stored(dealt.unionByName(dealt.select("src", "salt", F.col("src").alias("dst")).distinct()), "asked")
    wanted = asked.select(F.col("dst").alias("fp")).distinct().join(classes, "fp").select("fp", "place")
    texts = _texts(wanted, docs).withColumnRenamed("fp", "dst")
    rows = asked.join(texts, "dst").withColumn("later", F.col("src") != F.col("dst")).repartition("src", "salt").sortWithinPartitions("src", "salt", "later")
    return rows.select("src", "salt", "dst", "text").mapInArrow(tidied(_compare), "src long, dst long")


class _Tile:
    """Sets of a bucket that are compared with each other and with visitors; a set is made from its text when first needed."""

    def __init__(self, rows: dict[str, np.ndarray]):
        self.rows = rows
        self.held: dict[int, np.ndarray] = {}

    def shingles(self, n: int) -> np.ndarray:
        if n not in self.held:
            self.held[n] = shingles(self.rows["text"][n])
        return self.held[n]


class _Roots:
    """Which components have already been joined here."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, root: int) -> int:
        while (up := self.parent.get(root, root)) != root:
            self.parent[root] = root = self.parent.get(up, up)
        return root

    def join(self, one: int, other: int) -> None:
        self.parent[self.find(one)] = self.find(other)


def _tile_pairs(own: _Tile, other: _Tile, band: int, roots: _Roots) -> Iterator[tuple[int, int]]:
    """fp pairs that are alike and join components. A pair is looked at in the first band it shares only."""
    a, b = own.rows, other.rows
    for at in range(0, len(b["fp"]), 64):
        some = slice(at, at + 64)
        small, large = np.minimum(a["size"][:, None], b["size"][some]), np.maximum(a["size"][:, None], b["size"][some])
        fits = (5 * small >= 4 * large) & (a["root"][:, None] != b["root"][some])
        if own is other:
            fits &= np.arange(len(a["fp"]))[:, None] < np.arange(len(b["fp"]))[some]
        i, j = np.nonzero(fits)
        j = j + at
        found = []
        for begin in range(0, len(i), 1 << 14):
            x, y = i[begin : begin + (1 << 14)], j[begin : begin + (1 << 14)]
            shared = (a["sketch"][x] == b["sketch"][y]).sum(axis=1)
            same = a["bands"][x] == b["bands"][y]
            first = a["bands"][x, same.argmax(axis=1)] == band
            near = (shared >= SHARED) & first
            found.append((shared[near], x[near], y[near]))
        if not found:
            continue
        shared, x, y = (np.concatenate(f) for f in zip(*found, strict=True))
        # The likeliest first: what hangs together by them need not be compared any more.
        for n in np.argsort(-shared, kind="stable"):
            k, m = int(x[n]), int(y[n])
            one, two = int(a["root"][k]), int(b["root"][m])
            if roots.find(one) != roots.find(two) and alike(own.shingles(k), other.shingles(m)):
                roots.join(one, two)
                yield int(a["fp"][k]), int(b["fp"][m])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """src, dst: links between components, tile by tile (a tile's own rows first, then visitors)."""
    key, parts, own, roots = None, [], None, _Roots()

    def settled() -> Iterator[tuple[int, int]]:
        nonlocal own
        if own is None and parts:
            own = _Tile({c: np.concatenate([p[c] for p in parts]) for c in parts[0]})
            yield from _tile_pairs(own, own, key[0], roots)

    def batch_of(links: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["src", "dst"])

    for batch in batches:
        columns = gathered(iter([batch.select(["band", "part", "visitor", "fp", "root", "size"])]))
        if columns is None:
            continue
        columns["sketch"] = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
        columns["bands"] = batch.column("bands").flatten().to_numpy().reshape(-1, BANDS)
        columns["text"] = np.array(batch.column("text").to_pylist(), object)
        keys = np.stack([columns.pop(c).astype(np.int64) for c in ("band", "part", "visitor")], axis=1)
        starts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
        for rows in np.split(np.arange(len(keys)), starts):
            band, part, visitor = keys[rows[0]].tolist()
            values = {c: v[rows] for c, v in columns.items()}
            if (band, part) != key:
                yield from batch_of(list(settled()))
                key, parts, own, roots = (band, part), [], None, _Roots()
            if not visitor:
                parts.append(values)
            else:
                yield from batch_of(list(settled()))
                if own is not None:
                    yield from batch_of(list(_tile_pairs(own, _Tile(values), band, roots)))
    yield from batch_of(list(settled()))


def _across(members: DataFrame, roots: DataFrame, rows: DataFrame, classes: DataFrame, docs: DataFrame, tile: int) -> DataFrame:
    """src, dst: links between components that meet in a bucket, enough of them to join what belongs together."""
    reached = members.select("band", "fp").distinct().join(roots.withColumnRenamed("vertex", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    reached = stored(reached, "reached")
    several = reached.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high")
    several = stored(several.select("band", F.ceil(F.col("n") / tile).cast("int").alias("tiles")), "several")
    left = stored(salted_join(reached, several, ["band"], salt_on=["fp"]), "left")
    fps = stored(left.select("fp").distinct(), "compared")
    sketches = rows.join(fps, "fp", "left_semi").dropDuplicates(["fp"]).select("fp", "size", "sketch", "bands")
    texts = _texts(fps.join(classes, "fp").select("fp", "place"), docs)
    held = left.join(sketches.join(texts, "fp"), "fp").withColumn("own", F.pmod(F.xxhash64("fp"), "tiles").cast("int"))
    kept = ["band", "fp", "root", "size", "sketch", "bands", "text"]
    residents = held.select(*kept, F.col("own").alias("part"), F.lit(0).alias("visitor"))
    later = F.explode(F.sequence(F.col("own") + 1, F.col("tiles") - 1))
    visitors = held.filter("own + 1 < tiles").select(*kept, later.alias("part"), F.lit(1).alias("visitor"))
    dealt = residents.unionByName(visitors).repartition("band", "part").sortWithinPartitions("band", "part", "visitor")
    return dealt.mapInArrow(tidied(_near), "src long, dst long").distinct()


def place(text: Column) -> Column:
    """The number of a text in ``near_copies``."""
    return F.xxhash64(text.cast("string"))


def near_copies(docs: DataFrame, tile: int = TILE, proposed: DataFrame | None = None) -> DataFrame:
    """doc_id, fp (long), component_id, root per row of ``docs(doc_id, text)``.

    ``proposed(place, other)`` are pairs of texts, by their numbers, that are compared too, whatever their minimum hashes.

    ``component_id`` is the smallest doc_id that can be reached over sets of shingles of similarity 0.8 or
    more, ``fp`` the digest of a row's own set. Null and wordless texts are equal. Rows with a null id are linked
    too; a component without any id has a null component_id. ``root`` is one digest of the component and tells
    all components apart. Repeated rows are returned each, an empty table gives no rows, other columns are not read.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("place", place(F.col("text")))
    rows = stored(read.mapInArrow(tidied(_sketches), SKETCH_SCHEMA), "sketches")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("place").alias("place")), "classes")
    placed = rows.select("fp", "bands").mapInArrow(tidied(_band_rows), "band long, fp long")
    buckets = stored(placed.groupBy("band").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low < high").select("band", "low"), "buckets")
    members = stored(salted_join(placed, buckets, ["band"], salt_on=["fp"]), "members")
    first = stored(members.groupBy("fp").agg(F.min("low").alias("low")).filter("low < fp").select(F.col("low").alias("src"), F.col("fp").alias("dst")), "pairs")
    if proposed is not None:
        # A text stands for its set of shingles; each pair of sets is compared once.
        sets = rows.select("place", "fp").distinct()
        pairs = proposed.join(sets.withColumnRenamed("fp", "src"), "place").join(sets.select(F.col("place").alias("other"), F.col("fp").alias("dst")), "other")
        ordered = pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).filter("src < dst")
        first = stored(first.unionByName(ordered).distinct(), "asked-pairs")
    links = stored(_linked(first, classes, read), "links")
    roots = components(links)
    across = stored(_across(members, roots, rows, classes, read, tile), "across")
    if not across.isEmpty():
        roots = components(links.unionByName(across))
    rooted = stored(classes.join(roots.withColumnRenamed("vertex", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = stored(rooted.join(least, "root").select("fp", "component_id", "root"), "labels")
    return rows.select("doc_id", "fp").join(labels, "fp").select("doc_id", "fp", "component_id", "root")
