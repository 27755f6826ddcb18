"""Repeated byte strings, removed: a depth-limited radix sort of suffixes in most-significant-digit passes.

The suffixes that matter are cut off at the threshold: windows of ``LENGTH`` bytes. They are sorted by digits, and
after each pass groups of one leave. The first digit is chosen by content: of all grams of ``GRAM`` bytes inside a
window the one with the smallest hash, its anchor. Equal windows have equal anchors at equal places, and one anchor
serves all windows around it, so the first pass handles about one row for every (LENGTH - GRAM) / 2 bytes instead
of one for each byte:

1. digit *anchor*: rows are anchors with the block of windows they serve. An anchor that occurs once ends here, and
   so do anchors whose blocks are equal in all bytes: the first stays, the others are repeats;
2. digit *core*: the blocks of the other anchors are cut into steps of ``STEP`` neighbouring windows. What all windows
   of a step have in common is its core; a core that occurs once ends here. A row carries the few bytes around the
   core, and windows are compared by them;
3. digit *window*: only windows around very frequent cores are dealt out one by one.

Groups are thinned out before each shuffle: of equal rows in a batch only the first travels, and where a group has
many different rows in a batch, they travel by keys of their own to the next pass, and a mark tells the group. So no
key holds more rows than a few for each batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartula.llm.common import gathered, mixed, stored, text_bytes, tidied

LENGTH, GRAM = 100, 24
#: Grams of a window, and window starts that are hashed at a time.
PLACES, CHUNK = LENGTH - GRAM + 1, 1 << 18
#: Windows of a step, bytes that all windows of a step share, and different rows of a core that travel from a batch.
STEP = 16
CORE, FEW = LENGTH - STEP + 1, 32
#: What a row is about: a group's member, the mark of a group that the next pass compares, windows known to be repeats, windows to compare.
BLOCK_ROW, MARK, REPEAT, COMPARE = range(4)
ROW_SCHEMA = "key long, doc long, alt long, geo long, digest long"
SPAN_SCHEMA = "doc long, alt long, first long, last long, kind int"
MARGINS = ["left0", "left1", "right0", "right1"]
STEP_SCHEMA = "key long, doc long, alt long, geo long, core long, " + ", ".join(f"{m} long" for m in MARGINS)
CORE_SCHEMA = SPAN_SCHEMA + ", key long, " + ", ".join(f"{m} long" for m in MARGINS)
WINDOW_SCHEMA = "key long, more long, doc long, alt long, first long"


class Rolling:
    """Hashes of all substrings of a chunk: polynomials over 64-bit integers with random odd bases."""

    def __init__(self, seed: int):
        random = np.random.default_rng(seed)
        self.values = random.integers(0, 1 << 64, 256, np.uint64)
        base = int(random.integers(0, 1 << 61)) * 8 + 3
        size = CHUNK + 2 * LENGTH
        self.up = self._powers(base, size)
        self.down = self._powers(pow(base, -1, 1 << 64), size)

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        return np.cumprod(steps)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.down[: len(data)], out=sums[1:])
        return sums

    def of(self, prefix: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return mixed((prefix[end] - prefix[start]) * self.up[start])


_ROLLING: list[Rolling] = []


def rolling() -> list[Rolling]:
    if not _ROLLING:
        _ROLLING.extend(Rolling(seed) for seed in (1, 2))
    return _ROLLING


def places(data: np.ndarray, ends: np.ndarray, begin: int, stop: int) -> tuple[np.ndarray, ...]:
    """Bytes, their hash sums, the gram hashes, and each window's anchor, for window starts from ``begin`` to ``stop``.

    ``data`` holds texts end to end, ``ends`` their ends. Places count from ``begin``; windows that are not
    inside one text have the place -1.
    """
    one, _ = rolling()
    part = data[begin : stop + LENGTH - 1]
    prefix = one.prefix(part)
    grams = len(part) - GRAM + 1
    if len(part) < LENGTH:
        return part, prefix, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = one.of(prefix, slice(0, grams), slice(GRAM, GRAM + grams))
    # Hash above, place below: the minimum is the smallest hash, and of equal ones the leftmost.
    low = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64)
    span = 1
    while span * 2 <= PLACES:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < PLACES:
        low = np.minimum(low[: len(low) - (PLACES - span)], low[PLACES - span :])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    for end in ends[(ends > begin) & (ends < begin + len(part))] - begin:
        place[max(0, end - LENGTH + 1) : end] = -1
    return part, prefix, hashes, place


def anchors(data: np.ndarray, ends: np.ndarray, begin: int, stop: int) -> tuple[np.ndarray, ...]:
    """Blocks of the window starts from ``begin`` to ``stop``: first and last start, anchor, and two hashes."""
    part, _, hashes, place = places(data, ends, begin, stop)
    if not len(place):
        return tuple(np.zeros(0, t) for t in ("i8", "i8", "i8", "u8", "u8"))
    change = np.flatnonzero(place[1:] != place[:-1]) + 1
    first = np.concatenate([[0], change])
    last = np.concatenate([change, [len(place)]]) - 1
    inside = place[first] >= 0
    first, last = first[inside], last[inside]
    anchor = place[first]
    two = rolling()[1]
    block = two.of(two.prefix(part), first, last + LENGTH)
    shape = ((anchor - first) << 7 | (anchor - last)).astype(np.uint64)
    return first + begin, last + begin, anchor + begin, hashes[anchor], mixed(block ^ shape)


def steps(data: np.ndarray, ends: np.ndarray, wanted: np.ndarray, begin: int, stop: int) -> tuple[np.ndarray, ...]:
    """The ``wanted`` windows (a flag for each byte) by step: core start, range of starts before it, key, margins.

    Step ``n`` of an anchor holds the windows that start n * STEP to n * STEP + STEP - 1 bytes before it.
    Margins are the STEP bytes before and after the core, zero where no wanted window of the step reaches.
    """
    part, prefix, _, place = places(data, ends, begin, stop)
    starts = np.flatnonzero(wanted[begin : begin + len(place)] & (place >= 0))
    core = place[starts] - (place[starts] - starts) // STEP * STEP
    new = _changes(core, starts - np.arange(len(starts)))
    heads = np.flatnonzero(new)
    first, last = starts[heads], starts[np.concatenate([heads[1:], [len(starts)]]) - 1] if len(starts) else starts
    core = core[heads]
    key = rolling()[0].of(prefix, core, core + CORE) + ((place[first] - core) // STEP).astype(np.uint64)
    around = np.zeros(len(part) + 4 * STEP, np.uint8)
    around[2 * STEP : 2 * STEP + len(part)] = part
    margins = []
    for side in (core - STEP, core + CORE):
        at = side[:, None] + np.arange(STEP)
        inside = (at >= first[:, None]) & (at < last[:, None] + LENGTH)
        margins += list((around[at + 2 * STEP] * inside).view("<i8").reshape(-1, 2).T)
    return core + begin, core - last, core - first, key.view(np.int64), *margins


def _pack(place: np.ndarray, first: np.ndarray, last: np.ndarray, kind: int) -> np.ndarray:
    return place << 16 | (place - first) << 9 | (place - last) << 2 | kind


def _unpack(geo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start, and the kind."""
    place = geo >> 16
    return place - (geo >> 9 & 127), place - (geo >> 2 & 127), geo & 3


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def sorted_out(key: np.ndarray, digest: np.ndarray, doc: np.ndarray, alt: np.ndarray, geo: np.ndarray):
    """One pass over rows of the same anchors: indexes of single rows, first rows, repeats and rows to compare.

    Rows of an anchor whose blocks are all equal leave a first row; those of an anchor with differing
    blocks (or with a mark) leave one row to compare for each different block. The other rows of an equal
    block are repeats, but for copies of the first row itself.
    """
    order = np.argsort(key, kind="stable")
    new = _changes(key[order])
    group = np.cumsum(new) - 1
    alone = np.bincount(group)[group] == 1
    single, order = order[alone], order[~alone]
    order = order[np.lexsort((geo[order], alt[order], doc[order], digest[order], key[order]))]
    k, d, a, g = key[order], doc[order], alt[order], geo[order]
    new_key = _changes(k)
    group = np.cumsum(new_key) - 1
    mark = g & 3 == MARK
    new_block = _changes(k, digest[order], mark)
    differing = (np.bincount(group, new_block) > 1)[group] if len(group) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(new_block, np.arange(len(order)), 0))
    same = (d == d[head]) & (a == a[head]) & (g == g[head])
    return single, order[new_block & ~differing], order[~new_block & ~same & ~mark], order[new_block & differing & ~mark], k[new_key & differing]


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of texts (doc, alt, text), thinned out batch by batch."""
    for batch in batches:
        data, ends = text_bytes(batch.column("text"))
        parts = [anchors(data, ends, at, at + CHUNK) for at in range(0, len(data), CHUNK)]
        if not parts:
            continue
        first, last, place, key, digest = (np.concatenate(p) for p in zip(*parts, strict=True))
        row = np.searchsorted(ends, place, "right") - 1
        doc, alt = batch.column("doc").to_numpy()[row], batch.column("alt").to_numpy()[row]
        begin = ends[row]
        first, last, place = first - begin, last - begin, place - begin
        key, digest = key.view(np.int64), digest.view(np.int64)
        geo = _pack(place, first, last, BLOCK_ROW)
        single, stay, repeat, compare, marked = sorted_out(key, digest, doc, alt, geo)
        # Rows that are settled go along by a key of their document, so neighbours meet again.
        route = mixed(doc.view(np.uint64) ^ alt.view(np.uint64)).view(np.int64)
        spread = mixed(route.view(np.uint64) + place.view(np.uint64)).view(np.int64)
        keep, zeros = np.concatenate([single, stay]), np.zeros(len(marked), np.int64)
        columns = (
            np.concatenate([key[keep], route[repeat], spread[compare], marked]),
            np.concatenate([doc[keep], doc[repeat], doc[compare], zeros]),
            np.concatenate([alt[keep], alt[repeat], alt[compare], zeros]),
            np.concatenate([geo[keep], geo[repeat] | REPEAT, geo[compare] | COMPARE, zeros | MARK]),
            np.concatenate([digest[keep], np.zeros(len(repeat) + len(compare) + len(marked), np.int64)]),
        )
        yield from _emitted(columns, ["key", "doc", "alt", "geo", "digest"])


def _emitted(columns: tuple, names: list[str], types: dict | None = None) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), 1 << 17):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 17)], (types or {}).get(n, pa.int64())) for c, n in zip(columns, names, strict=True)], names)


def merged_spans(doc: np.ndarray, alt: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of window starts of the same document that touch or overlap, as one."""
    order = np.lexsort((first, alt, doc))
    doc, alt, first, last = doc[order], alt[order], first[order], last[order]
    if not len(doc):
        return doc, alt, first, last
    new = _changes(doc, alt)
    # The furthest end so far within a document: each document's ends are lifted above all earlier ones.
    lift = (np.cumsum(new) - 1) * (int(last.max()) + 2)
    furthest = np.maximum.accumulate(last + lift)
    new[1:] |= first[1:] + lift[1:] > furthest[:-1] + 1
    starts = np.flatnonzero(new)
    stops = np.concatenate([starts[1:], [len(doc)]]) - 1
    return doc[starts], alt[starts], first[starts], furthest[stops] - lift[stops]


def _second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of some anchors: spans of repeats, and stretches of windows to compare."""
    rows = gathered(batches)
    if rows is None:
        return
    key, digest, doc, alt, geo = (rows[c] for c in ("key", "digest", "doc", "alt", "geo"))
    settled = geo & 2 == 2
    open_ = np.flatnonzero(~settled)
    _, _, repeat, compare, _ = (open_[i] if n < 4 else i for n, i in enumerate(sorted_out(key[open_], digest[open_], doc[open_], alt[open_], geo[open_])))
    kind = geo & 3
    repeat = np.concatenate([np.flatnonzero(kind == REPEAT), repeat])
    compare = np.concatenate([np.flatnonzero(kind == COMPARE), compare])
    first, last, _ = _unpack(geo)
    names, types = ["doc", "alt", "first", "last", "kind"], {"kind": pa.int32()}
    for chosen, number in ((repeat, REPEAT), (compare, COMPARE)):
        spans = merged_spans(doc[chosen], alt[chosen], first[chosen], last[chosen])
        yield from _emitted((*spans, np.full(len(spans[0]), number)), names, types)


def _firsts(key: np.ndarray, more: np.ndarray, doc: np.ndarray, alt: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the first of each group of equal windows, and of its repeats."""
    order = np.lexsort((first, alt, doc, more, key))
    k, m, d, a, f = key[order], more[order], doc[order], alt[order], first[order]
    new = _changes(k, m)
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    same = (d == d[head]) & (a == a[head]) & (f == f[head])
    return order[new], order[~new & ~same]


def _step_geo(core: np.ndarray, low: np.ndarray, high: np.ndarray, kind: int) -> np.ndarray:
    return core << 10 | high << 6 | low << 2 | kind


def _masks() -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each distance of a start before the core: which bytes of the margins the window has."""
    place = np.arange(STEP)
    left = np.where(place[None, :] >= STEP - place[:, None], 255, 0).astype(np.uint8)
    right = np.where(place[None, :] < STEP - 1 - place[:, None], 255, 0).astype(np.uint8)
    return [m.view("<i8").reshape(-1, 2)[:, n] for m in (left, right) for n in (0, 1)]


def expanded(rows: dict[str, np.ndarray], chosen: np.ndarray) -> tuple[np.ndarray, ...]:
    """The windows of some step rows: 128-bit digest in two numbers, document, start."""
    geo = rows["geo"][chosen]
    low, high = geo >> 2 & 15, geo >> 6 & 15
    counts = high - low + 1
    row = np.repeat(chosen, counts)
    distance = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
    one, two = mixed(rows["key"][row].view(np.uint64) + distance.view(np.uint64)), rows["key"][row].view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)
    for name, mask in zip(MARGINS, _masks(), strict=True):
        margin = (rows[name][row] & mask[distance]).view(np.uint64)
        one, two = mixed(one ^ margin), mixed(two + margin)
    two = mixed(two ^ distance.view(np.uint64)) | np.uint64(1)
    return one.view(np.int64), two.view(np.int64), rows["doc"][row], rows["alt"][row], (rows["geo"][row] >> 10) - distance


def _equal_rows(rows: dict[str, np.ndarray], chosen: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of the same cores in order: their indexes, group numbers, and which are different, repeated, or marks."""
    geo = rows["geo"][chosen]
    kind, reach, core = geo & 3, geo >> 2 & 255, geo >> 10
    sides = [rows[m][chosen] for m in MARGINS]
    keys = (core, rows["alt"][chosen], rows["doc"][chosen], reach, *sides, kind, rows["key"][chosen])
    order = np.lexsort(keys)
    core, alt, doc, reach, *sides, kind, key = (k[order] for k in keys)
    new = _changes(key, kind, reach, *sides)
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    same = (doc == doc[head]) & (alt == alt[head]) & (core == core[head])
    return chosen[order], np.cumsum(_changes(key)) - 1, new, ~new & ~same, kind == MARK


def _step_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Steps of the stretches to compare in some texts, thinned out batch by batch."""
    for batch in batches:
        names = batch.schema.names
        data, ends = text_bytes(batch.column(names.index("text")))
        stretches = batch.column(names.index("stretches"))
        text = np.repeat(np.arange(batch.num_rows), np.diff(stretches.offsets.to_numpy()))
        flat = stretches.flatten()
        flags = np.zeros(len(data) + 1, np.int32)
        np.add.at(flags, ends[text] + flat.field("first").to_numpy(), 1)
        np.add.at(flags, ends[text] + flat.field("last").to_numpy() + 1, -1)
        wanted = np.cumsum(flags) > 0
        parts = [steps(data, ends, wanted, at, at + CHUNK) for at in range(0, len(data), CHUNK)]
        if not parts:
            continue
        core, low, high, key, *margins = (np.concatenate(p) for p in zip(*parts, strict=True))
        row = np.searchsorted(ends, core, "right") - 1
        rows = dict(zip(MARGINS, margins, strict=True)) | {"key": key, "doc": batch.column(names.index("doc")).to_numpy()[row], "alt": batch.column(names.index("alt")).to_numpy()[row]}
        rows["geo"] = _step_geo(core - ends[row], low, high, BLOCK_ROW)
        order, group, new, repeated, _ = _equal_rows(rows, np.arange(len(key)))
        many = (np.bincount(group, new) > FEW)[group] if len(group) else np.zeros(0, bool)
        travel, compare, repeat = order[new & ~many], order[new & many], order[repeated]
        marked = np.unique(rows["key"][compare])
        route = mixed(rows["doc"].view(np.uint64) ^ rows["alt"].view(np.uint64))
        spread = mixed(route + rows["geo"].view(np.uint64))
        chosen = np.concatenate([travel, compare, repeat])
        kinds = np.repeat([BLOCK_ROW, COMPARE, REPEAT], [len(travel), len(compare), len(repeat)])
        keys = np.concatenate([rows["key"][travel], rows["key"][compare], route[repeat].view(np.int64)])
        dealt = np.concatenate([rows["key"][travel], spread[compare].view(np.int64), route[repeat].view(np.int64)])
        zeros = np.zeros(len(marked), np.int64)
        columns = [dealt, rows["doc"][chosen], rows["alt"][chosen], rows["geo"][chosen] | kinds, *(np.where(kinds == REPEAT, 0, rows[m][chosen]) for m in MARGINS)]
        # A row that is dealt out by a key of its own still carries the core's.
        columns.insert(4, np.where(kinds == COMPARE, keys, 0))
        ends_ = [marked, zeros, zeros, zeros | MARK, zeros, zeros, zeros, zeros, zeros]
        yield from _emitted(tuple(np.concatenate(c) for c in zip(columns, ends_, strict=True)), ["key", "doc", "alt", "geo", "core", *MARGINS])


def _core_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of some cores: spans of repeats, and rows that the last pass has to compare."""
    rows = gathered(batches)
    if rows is None:
        return
    kind = rows["geo"] & 3
    order, group, new, repeated, mark = _equal_rows(rows, np.flatnonzero(kind < REPEAT))
    if len(order):
        marked = (np.bincount(group, mark) > 0)[group]
        several = (np.bincount(group, new) > 1)[group]
    else:
        marked = several = np.zeros(0, bool)
    windows = expanded(rows, order[new & several & ~marked])
    _, again = _firsts(*windows)
    geo = rows["geo"][np.concatenate([np.flatnonzero(kind == REPEAT), order[repeated]])]
    holder = np.concatenate([np.flatnonzero(kind == REPEAT), order[repeated]])
    first = np.concatenate([(geo >> 10) - (geo >> 6 & 15), windows[4][again]])
    last = np.concatenate([(geo >> 10) - (geo >> 2 & 15), windows[4][again]])
    spans = merged_spans(np.concatenate([rows["doc"][holder], windows[2][again]]), np.concatenate([rows["alt"][holder], windows[3][again]]), first, last)
    names, types = ["doc", "alt", "first", "last", "kind", "key", *MARGINS], {"kind": pa.int32()}
    zeros = np.zeros(len(spans[0]), np.int64)
    yield from _emitted((*spans, zeros + REPEAT, *[zeros] * 5), names, types)
    left = np.flatnonzero(kind == COMPARE)
    from_mark = order[new & marked & ~mark]
    keys = np.concatenate([rows["core"][left], rows["key"][from_mark]])
    left = np.concatenate([left, from_mark])
    yield from _emitted((rows["doc"][left], rows["alt"][left], rows["geo"][left], rows["geo"][left], np.full(len(left), COMPARE), keys, *(rows[m][left] for m in MARGINS)), names, types)


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the windows around very frequent cores, thinned out; ``more`` is 0 for what is already a repeat."""
    names = ["key", "more", "doc", "alt", "first"]
    for batch in batches:
        rows = gathered(iter([batch]))
        if rows is not None:
            rows["geo"] = rows.pop("first")
            key, more, doc, alt, first = expanded(rows, np.arange(batch.num_rows))
            head, repeat = _firsts(key, more, doc, alt, first)
            yield from _emitted((key[head], more[head], doc[head], alt[head], first[head]), names)
            route = mixed(doc[repeat].view(np.uint64) ^ alt[repeat].view(np.uint64)).view(np.int64)
            yield from _emitted((route, np.zeros(len(repeat), np.int64), doc[repeat], alt[repeat], first[repeat]), names)


def _core_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The core pass, and what it leaves to compare as window rows (in one worker)."""
    for batch in _core_pass(batches):
        if batch.num_rows and batch.column("kind")[0].as_py() == COMPARE:
            yield from _window_rows(iter([batch]))


def _third_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = gathered(batches)
    if rows is None:
        return
    key, more, doc, alt, first = (rows[c] for c in ("key", "more", "doc", "alt", "first"))
    settled = more == 0
    open_ = np.flatnonzero(~settled)
    _, repeat = _firsts(*(c[open_] for c in (key, more, doc, alt, first)))
    chosen = np.concatenate([np.flatnonzero(settled), open_[repeat]])
    spans = merged_spans(doc[chosen], alt[chosen], first[chosen], first[chosen])
    yield from _emitted((*spans, np.full(len(spans[0]), REPEAT)), ["doc", "alt", "first", "last", "kind"], {"kind": pa.int32()})


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns by number, and doc, alt, text; ``alt`` tells rows apart where an id occurs more than once."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    repeated = not docs.select(doc.alias("doc")).groupBy("doc").count().filter("count > 1").isEmpty()
    text = F.col("text").cast("string")
    alt = F.xxhash64(text) if repeated else F.lit(0).cast("long")
    numbered = (F.col(c).alias(str(n)) for n, c in enumerate(docs.columns) if c != "text")
    return docs.select(*numbered, doc.alias("doc"), alt.alias("alt"), text.alias("text"))


def _lists(spans: DataFrame, name: str) -> DataFrame:
    return spans.groupBy("doc", "alt").agg(F.collect_list(F.struct("first", "last")).alias(name))


def with_spans(docs: DataFrame) -> DataFrame:
    """row (all columns of ``docs``), text, and starts and stops: spans of window starts that are repeats, in any order."""
    keyed = _keyed(docs)
    blocks = keyed.select("doc", "alt", "text").mapInArrow(tidied(_first_pass), ROW_SCHEMA).repartition("key").mapInArrow(tidied(_second_pass), SPAN_SCHEMA)
    spans = stored(blocks, "repeats")
    # Both joins deal out the same columns of the documents alike, so that Spark does it once.
    compared = keyed.join(_lists(spans.filter(F.col("kind") == COMPARE), "stretches").hint("shuffle_hash"), ["doc", "alt"])
    # In an order of its own, so that a task that runs again makes the same batches and thins them out alike.
    steps_ = compared.sortWithinPartitions("doc", "alt").mapInArrow(tidied(_step_rows), STEP_SCHEMA).repartition("key")
    inner = steps_.mapInArrow(tidied(_core_pass), CORE_SCHEMA)
    digests = steps_.mapInArrow(tidied(_core_windows), WINDOW_SCHEMA)
    last = digests.repartition("key").mapInArrow(tidied(_third_pass), SPAN_SCHEMA)
    repeats = [t.filter(F.col("kind") == REPEAT).select("doc", "alt", "first", "last") for t in (spans, inner, last)]
    found = keyed.join(_lists(repeats[0].unionByName(repeats[1]).unionByName(repeats[2]), "spans").hint("shuffle_hash"), ["doc", "alt"], "left")
    row = F.struct(*[F.col("text" if c == "text" else f"`{n}`").alias(c) for n, c in enumerate(docs.columns)])
    ends = (F.transform("spans", lambda s: s[end]).alias(name) for end, name in (("first", "starts"), ("last", "stops")))
    return found.select(row.alias("row"), "text", *ends)


def removed_runs(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes that windows starting in the spans cover, as (begin, end)."""
    runs: list[tuple[int, int]] = []
    for start, stop in sorted(zip(starts, stops, strict=True)):
        if runs and start <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], int(stop) + LENGTH))
        else:
            runs.append((int(start), int(stop) + LENGTH))
    return runs


def without(raw: bytes, runs: list[tuple[int, int]], whole_characters: bool) -> tuple[bytes, int, int]:
    """The bytes outside of the runs, how many were removed, and in how many runs.

    With ``whole_characters`` a run gives up the bytes of characters that it only covers in part.
    """
    kept, at, number = [], 0, 0
    for begin, end in runs:
        if whole_characters:
            while begin < end and raw[begin] & 0xC0 == 0x80:
                begin += 1
            while end > begin and end < len(raw) and raw[end] & 0xC0 == 0x80:
                end -= 1
        if begin < end:
            kept.append(raw[at:begin])
            at, number = end, number + 1
    kept.append(raw[at:])
    rest = b"".join(kept)
    return rest, len(raw) - len(rest), number


def stripped(text: Column, starts: Column, stops: Column, whole_characters: bool = False) -> Column:
    """struct(kept binary, n_bytes, n_removed, n_spans) of a text (null: empty) and its spans."""

    def column(texts: pd.Series, firsts: pd.Series, lasts: pd.Series) -> pd.DataFrame:
        rows = []
        for value, first, last in zip(texts, firsts, lasts, strict=True):
            raw = (value or "").encode()
            rest, removed, number = without(raw, removed_runs(first, last) if first is not None else [], whole_characters)
            rows.append((rest, len(raw), removed, number))
        return pd.DataFrame(rows, columns=["kept", "n_bytes", "n_removed", "n_spans"])

    # Said to be nondeterministic, so that a filter on the result does not evaluate it a second time.
    once = F.pandas_udf(column, "kept binary, n_bytes long, n_removed long, n_spans long").asNondeterministic()
    return once(text, starts, stops)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) per row of ``docs(doc_id, text)``.

    Every byte that is covered by a string of LENGTH bytes that also starts earlier (in a document with a
    smaller doc_id, or earlier in the same document) is removed; strings are judged on the input. A null
    text is empty; a null doc_id comes after all others. Rows that share an id and a text are one
    document listed more than once; rows that share only the id are documents in the order of a hash of
    their texts. An empty table gives no rows, other columns are not read.
    """
    found = with_spans(docs.select("doc_id", "text"))
    cut = found.select(F.col("row.doc_id").alias("doc_id"), stripped(F.col("text"), F.col("starts"), F.col("stops")).alias("cut"))
    return cut.select("doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans", "cut.kept")
