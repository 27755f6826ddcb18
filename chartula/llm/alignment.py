"""Alignment of two tokenizers: byte offsets where tokens of both end cut a text into groups; overlapping tokens are linked.

Most texts are read word by word: between something that is no white space and a space, neither tokenizer has a
token that goes on, so every different word of a task is encoded and aligned once and looked up after that. Longer
texts are dealt out as byte ranges. A range gives a fragment: the tokens that end in it, as an open prefix up to
the first common end, closed groups, and an open suffix behind the last common end. Fragments compose
associatively (a suffix and the next prefix make one more group), so a tree of Spark tasks reduces them, a bounded
number at a time, and a range may cut tokens and groups anywhere.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartula.llm.byte_bpe import Places, shown_bytes
from chartula.llm.common import stored, tidied
from chartula.operators.joins import salted_join

BYTE_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Longer texts are dealt out in ranges of so many bytes; so many fragments are composed by one task at a time.
RANGE, FAN = 1 << 16, 16
#: Words, and bytes of words, that a task remembers; characters that are read and links that are handed on at a time.
WORDS, WORD_CHARACTERS, CHARACTERS_AT_ONCE, LINKS_AT_ONCE = 1 << 18, 1 << 23, 1 << 19, 1 << 20
#: A table of more pairs than this (17 bytes each) is joined by shuffling, not broadcast.
BROADCAST_PAIRS = 2_000_000
ALIGNED_SCHEMA = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, pairs array<long>, times array<int>, groups_sha256 string"
RANGE_SCHEMA = "row long, doc_id long, place long, ranges long, start long, low long, high long, text string"
_SUMS = ["n_a", "n_b", "n_groups", "n_links"]
_OPEN = [f"{end}_{what}" for end in ("prefix", "suffix") for what in ("a", "a_ends", "b", "b_ends")]
FRAGMENT_SCHEMA = (
    "row long, doc_id long, place long, bad boolean, first_cut long, n_a long, n_b long, n_groups long, n_links long, pairs array<long>, times array<int>, "
    + ", ".join(f"{name} array<long>" for name in _OPEN)
    + ", joints array<struct<place: long, groups: string>>, groups string"
)
_WORD_END = re.compile(r"(?<=\S)(?= [\s\S])")
_NOTHING = np.zeros(0, np.int64)

Tokens = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class Pair:
    """Both tokenizers, with the bytes of their tokens. The second one writes a space before every text."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        # Spark runs a task for every core already.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        byte_of = {c: b for b, c in enumerate(shown_bytes())}
        with open(byte_path, encoding="utf-8") as file:
            special = {t["content"] for t in json.load(file)["added_tokens"]}
        named = self.a.get_vocab()
        self.a_bytes = [b""] * (max(named.values()) + 1)
        for token, number in named.items():
            self.a_bytes[number] = token.encode() if token in special else bytes(byte_of[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_widths, self.b_widths = (np.array([len(t) for t in tokens], np.int64) for tokens in (self.a_bytes, self.b_bytes))
        # Where no token goes on: pairs of neighbouring bytes (first) and characters (second) that no token holds.
        self.a_joined = {t[n : n + 2] for t in self.a_bytes for n in range(len(t) - 1)}
        self.b_joined = {p[n : n + 2] for p in pieces for n in range(len(p) - 1)}
        self.tables = [np.frombuffer(b"".join(tokens), np.uint8) for tokens in (self.a_bytes, self.b_bytes)]
        self.table_begins = [np.cumsum(w) - w for w in (self.a_widths, self.b_widths)]
        self._forget()

    def encoded(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Ids under both and whether the tokens spell the text, for texts that begin with a space or go on from another."""
        a = self.a.encode_batch_fast(texts, add_special_tokens=False)
        # A line feed is a token of its own, after which a text goes on as in the middle of another one.
        b = self.b.encode([t[1:] if t[0] == " " else "\n" + t for t in texts], num_threads=1)
        for text, own, other in zip(texts, a, b, strict=True):
            other = other if text[0] == " " else other[2:]
            raw = text.encode()
            spelled = b"".join([self.a_bytes[i] for i in own.ids]) == raw == b"".join([self.b_bytes[i] for i in other])
            yield np.array(own.ids, np.int64), np.array(other, np.int64), spelled

    def tokens(self, a: np.ndarray, b: np.ndarray, start: int = 0) -> Tokens:
        return a, start + np.cumsum(self.a_widths[a]), b, start + np.cumsum(self.b_widths[b])

    def links(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of overlapping tokens, a * 2**32 + b, and how many each token of a has."""
        a, a_ends, b, b_ends = tokens
        first = np.searchsorted(b_ends, a_ends - self.a_widths[a], "right")
        count = np.searchsorted(b_ends, a_ends, "left") - first + 1
        return (np.repeat(a, count) << 32) | b[_spread(first, count)], count

    def safe(self, text: str, at: int) -> bool:
        """Whether both tokenizers surely end a token before ``text[at]``, whatever stands further away."""
        before, after = text[at - 1], text[at]
        if before.isspace():
            return False
        if after == " ":
            return at + 1 < len(text)
        return not after.isspace() and before + after not in self.b_joined and before.encode()[-1:] + after.encode()[:1] not in self.a_joined

    def _forget(self) -> None:
        self.words, self.held = Places(), 0
        self.counts = np.zeros((0, 4), np.int64)
        self.bad, self.groups = np.zeros(0, bool), []
        self.pool, self.begins = _NOTHING, _NOTHING

    def _learn(self) -> None:
        """Align all words that are new to the task at once: end to end they are one text that is cut after each word."""
        words, self.words.new = self.words.new, []
        raw = [w.encode() for w in words]
        lengths = np.array([len(r) for r in raw], np.int64)
        found = []
        for codes, widths, table, begins in zip(self._codes(words), (self.a_widths, self.b_widths), self.tables, self.table_begins, strict=True):
            sizes = np.array([len(c) for c in codes], np.int64)
            found.append((np.fromiter(chain.from_iterable(codes), np.int64, sizes.sum()), sizes, widths, table, begins))
        good = np.ones(len(words), bool)
        for ids, sizes, widths, _, _ in found:
            good &= np.bincount(np.repeat(np.arange(len(words)), sizes), widths[ids], len(words)) == lengths
        for ids, sizes, widths, table, begins in found:
            own = ids[np.repeat(good, sizes)]
            spelled = table[_spread(begins[own], widths[own])]
            wanted = np.frombuffer(b"".join([r for r, g in zip(raw, good, strict=True) if g]), np.uint8)
            wrong = np.repeat(np.flatnonzero(good), lengths[good])[spelled != wanted]
            good[wrong] = False
            # What was found wrong is left out of the second comparison too.
        counts = np.zeros((len(words), 4), np.int64)
        streams = [ids[np.repeat(good, sizes)] for ids, sizes, *_ in found]
        for side, (_, sizes, *_) in enumerate(found):
            counts[:, side] = sizes
        tokens = self.tokens(*streams)
        ends = np.cumsum(lengths[good])
        links, of_a = self.links(tokens)
        written, cuts = group_texts(tokens)
        # Groups and links of each word, by where the word ends.
        last = np.searchsorted(cuts, ends) + 1
        counts[good, 2] = np.diff(last, prepend=0)
        a_stops = np.cumsum(counts[good, 0])
        total = np.concatenate([[0], np.cumsum(of_a)])
        counts[good, 3] = np.diff(total[a_stops], prepend=0)
        texts = np.full(len(words), "", object)
        if good.any():
            offsets = pa.array(np.concatenate([[0], last]), pa.int32())
            texts[good] = pc.binary_join(pa.ListArray.from_arrays(offsets, written), ";").to_pylist()
        self.groups += texts.tolist()
        self.counts = np.concatenate([self.counts, counts])
        self.bad = np.concatenate([self.bad, ~good])
        self.begins = np.concatenate([self.begins, len(self.pool) + np.cumsum(counts[:, 3]) - counts[:, 3]])
        self.pool = np.concatenate([self.pool, links])
        self.held += int(lengths.sum())

    def _codes(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids under both for texts that begin with a space."""
        a = [c.ids for c in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        return a, self.b.encode([t[1:] for t in texts], num_threads=1)

    def aligned(self, texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, str]]:
        """Per text: counts of tokens, groups and links, different links, their numbers, and the digest of the groups."""
        if len(self.words) > WORDS or self.held > WORD_CHARACTERS:
            self._forget()
        indexes = []
        for text in texts:
            words = _WORD_END.split(" " + text) if text else []
            indexes.append(np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)))
        if self.words.new:
            self._learn()
        for index in indexes:
            if not len(index) or self.bad[index].any():
                yield [0] * 4, _NOTHING, _NOTHING, ""
                continue
            counts = self.counts[index]
            found = self.pool[_spread(self.begins[index], counts[:, 3])]
            digest = hashlib.sha256(";".join([self.groups[i] for i in index.tolist()]).encode()).hexdigest()
            yield counts.sum(axis=0).tolist(), *np.unique(found, return_counts=True), digest


def _spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of stretches that begin at ``begins``, in turn."""
    total = np.cumsum(sizes)
    return np.repeat(begins - total + sizes, sizes) + np.arange(total[-1] if len(total) else 0)


@lru_cache(maxsize=2)
def _loaded(byte_path: str, piece_path: str) -> Pair:
    return Pair(byte_path, piece_path)


def group_texts(tokens: Tokens) -> tuple[pa.Array, np.ndarray]:
    """Each group as ``a1,a2|b1,b2``, and where it ends, for tokens whose last ends are equal."""
    a, a_ends, b, b_ends = tokens
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
    sides = []
    for ids, ends in ((a, a_ends), (b, b_ends)):
        stops = np.concatenate([[0], np.searchsorted(ends, cuts) + 1])
        sides.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pc.cast(pa.array(ids), pa.string())), ","))
    return pc.binary_join_element_wise(*sides, "|"), cuts


def group_text(tokens: Tokens) -> tuple[str, int]:
    """Groups as ``a1,a2|b1;a3|b2`` and their number, for tokens whose last ends are equal."""
    written, cuts = group_texts(tokens)
    return ";".join(written.to_pylist()), len(cuts)


def _cut(tokens: Tokens, low, high) -> Tokens:
    """The tokens that end in (low, high]."""
    a, a_ends, b, b_ends = tokens
    i, j = np.searchsorted(a_ends, [low, high], "right")
    k, m = np.searchsorted(b_ends, [low, high], "right")
    return a[i:j], a_ends[i:j], b[k:m], b_ends[k:m]


def _joined(one: Tokens, other: Tokens) -> Tokens:
    return tuple(np.concatenate(ends) for ends in zip(one, other, strict=True))


def _totals(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate([_NOTHING, *pairs]), return_inverse=True)
    return keys, np.bincount(place, weights=np.concatenate([_NOTHING, *times]), minlength=len(keys)).astype(np.int64)


class Fragment:
    """What a byte range knows of a document. Without a common end, all its tokens are the prefix."""

    def __init__(self, pair: Pair, bad: bool = False):
        self.pair, self.bad, self.first_cut = pair, bad, -1
        self.sums = np.zeros(4, np.int64)
        self.pairs, self.times = _NOTHING, _NOTHING
        self.prefix: Tokens = (_NOTHING,) * 4
        self.suffix: Tokens = (_NOTHING,) * 4
        #: Groups that arose where fragments were composed, with the range whose closed groups they precede.
        self.joints: list[tuple[int, str]] = []
        #: Closed groups of the range itself; composed fragments leave them to the ranges.
        self.groups = ""

    @classmethod
    def of(cls, pair: Pair, tokens: Tokens, place: int, bad: bool) -> Fragment:
        made = cls(pair, bad)
        if bad:
            return made
        a, a_ends, b, b_ends = tokens
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        if not len(cuts):
            made.prefix = tokens
            return made
        made.first_cut = place
        made.prefix, made.suffix = _cut(tokens, -1, cuts[0]), _cut(tokens, cuts[-1], max(a_ends[-1], b_ends[-1]))
        closed = _cut(tokens, cuts[0], cuts[-1])
        if len(cuts) > 1:
            made.groups, number = group_text(closed)
            made._count(closed, number)
        return made

    def _count(self, closed: Tokens, number: int) -> None:
        links, _ = self.pair.links(closed)
        self.sums += [len(closed[0]), len(closed[2]), number, len(links)]
        keys, times = np.unique(links, return_counts=True)
        self.pairs, self.times = _totals([self.pairs, keys], [self.times, times])

    def joint(self, tokens: Tokens, place: int) -> None:
        """One more closed group."""
        self.joints.append((place, group_text(tokens)[0]))
        self._count(tokens, 1)

    def then(self, after: Fragment) -> Fragment:
        """The composition of two fragments that stand next to each other."""
        made = Fragment(self.pair, self.bad or after.bad)
        if made.bad:
            return made
        made.sums = self.sums + after.sums
        made.joints = self.joints + after.joints
        made.pairs, made.times = _totals([self.pairs, after.pairs], [self.times, after.times])
        cut, cut_after = self.first_cut >= 0, after.first_cut >= 0
        made.first_cut = self.first_cut if cut else after.first_cut
        made.prefix = self.prefix if cut else _joined(self.prefix, after.prefix)
        made.suffix = after.suffix if cut_after else _joined(self.suffix, after.prefix) if cut else self.suffix
        if cut and cut_after:
            made.joint(_joined(self.suffix, after.prefix), after.first_cut)
        return made

    def as_row(self) -> dict:
        lists = dict(zip(_OPEN, (*self.prefix, *self.suffix), strict=True))
        sums = dict(zip(_SUMS, self.sums.tolist(), strict=True))
        joints = [{"place": place, "groups": groups} for place, groups in sorted(self.joints)]
        return {"bad": self.bad, "first_cut": self.first_cut, **sums, "pairs": self.pairs, "times": self.times, **lists, "joints": joints, "groups": self.groups}

    @classmethod
    def from_row(cls, pair: Pair, row: dict) -> Fragment:
        made = cls(pair, row["bad"])
        made.first_cut, made.sums = row["first_cut"], np.array([row[n] for n in _SUMS], np.int64)
        made.pairs, made.times = np.array(row["pairs"], np.int64), np.array(row["times"], np.int64)
        lists = [np.array(row[n], np.int64) for n in _OPEN]
        made.prefix, made.suffix = tuple(lists[:4]), tuple(lists[4:])
        made.joints = [(j["place"], j["groups"]) for j in row["joints"]]
        return made


def _int_lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([_NOTHING, *arrays])).cast(kind))


def _some_at_a_time(pair: Pair, texts: pa.Array) -> Iterator[tuple]:
    waiting, size = [], 0
    for n in range(len(texts)):
        waiting.append(texts[n].as_py() or "")
        size += len(waiting[-1])
        if size >= CHARACTERS_AT_ONCE or n == len(texts) - 1:
            yield from pair.aligned(waiting)
            waiting, size = [], 0


def _whole(paths: tuple[str, str]):
    def align_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _loaded(*paths)
        for batch in batches:
            begin, size, held = 0, 0, []
            for n, found in enumerate(_some_at_a_time(pair, batch.column("text"))):
                held.append(found)
                size += len(found[1])
                if size >= LINKS_AT_ONCE or n == batch.num_rows - 1:
                    sums, pairs, times, digests = zip(*held, strict=True)
                    columns = [batch.column(c).slice(begin, len(held)) for c in ("row", "doc_id")]
                    columns += [pa.array(c, pa.int64()) for c in zip(*sums, strict=True)]
                    columns += [_int_lists(pairs, pa.int64()), _int_lists(times, pa.int32()), pa.array(digests)]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", *_SUMS, "pairs", "times", "groups_sha256"])
                    begin, size, held = n + 1, 0, []

    return align_partition


def byte_ranges(pair: Pair, text: str, size: int) -> Iterator[tuple[int, int, int, str]]:
    """(start, low, high, part): byte ranges (low, high] of space + text, each with the part, from byte start on, that decides its tokens."""
    text = " " + text
    at = byte = low = 0
    total = len(text.encode())
    while low < total:
        high = min(low + size, total)
        # ``at`` stands at a safe place at or before the byte ``low``; go on to one at or behind ``high``.
        end, done = at, byte
        while done < high:
            step = max(1, (high - done) // 4)
            done += len(text[end : end + step].encode())
            end += step
        end = min(end, len(text))
        while end < len(text) and not pair.safe(text, end):
            end += 1
        part = text[at:end]
        yield byte, low, high, part
        # The next range starts from the last safe place that is not behind its first byte.
        back, reached = end, byte + len(part.encode())
        while reached > high:
            back -= 1
            reached -= len(text[back].encode())
        while back > at and not (back < len(text) and pair.safe(text, back)):
            back -= 1
            reached -= len(text[back].encode())
        at, byte, low = back, reached, high


def _ranges(paths: tuple[str, str], size: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _loaded(*paths)
        names = [f.split()[0] for f in RANGE_SCHEMA.split(", ")]
        types = [pa.int64()] * 7 + [pa.string()]
        for batch in batches:
            for n in range(batch.num_rows):
                row, doc_id, text = (batch.column(c)[n].as_py() for c in ("row", "doc_id", "text"))
                ranges = -(-(len(text.encode()) + 1) // size)
                rows = ((row, doc_id, place, ranges, *found) for place, found in enumerate(byte_ranges(pair, text, size)))
                while some := list(islice(rows, FAN)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names)

    return deal


def _fragment_batch(rows: list[dict]) -> pa.RecordBatch:
    joint = pa.list_(pa.struct([("place", pa.int64()), ("groups", pa.string())]))
    types = {"bad": pa.bool_(), "groups": pa.string(), "joints": joint, "times": pa.list_(pa.int32()), **dict.fromkeys(["pairs", *_OPEN], pa.list_(pa.int64()))}
    names = ["row", "doc_id", "place", "bad", "first_cut", *_SUMS, "pairs", "times", *_OPEN, "joints", "groups"]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types.get(n, pa.int64())) for n in names], names)


def _fragments(paths: tuple[str, str]):
    def read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _loaded(*paths)
        for batch in batches:
            for r in batch.to_pylist():
                ((a, b, spelled),) = pair.encoded([r["text"]])
                tokens = _cut(pair.tokens(a, b, r["start"]), r["low"], r["high"]) if spelled else (_NOTHING,) * 4
                made = Fragment.of(pair, tokens, r["place"], not spelled)
                yield _fragment_batch([{"row": r["row"], "doc_id": r["doc_id"], "place": r["place"], **made.as_row()}])

    return read_ranges


def _composer(paths: tuple[str, str]):
    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, key, held = _loaded(*paths), None, None
        for batch in batches:
            for n in range(batch.num_rows):
                (r,) = batch.slice(n, 1).to_pylist()
                fragment = Fragment.from_row(pair, r)
                if (r["row"], r["place"]) == key[:2] if key else False:
                    held = held.then(fragment)
                    continue
                if key:
                    yield _fragment_batch([{"row": key[0], "place": key[1], "doc_id": key[2], **held.as_row()}])
                key, held = (r["row"], r["place"], r["doc_id"]), fragment
        if key:
            yield _fragment_batch([{"row": key[0], "place": key[1], "doc_id": key[2], **held.as_row()}])

    return compose


def _finished(paths: tuple[str, str]):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first group of a document is the prefix of its one fragment; nothing is left of the suffix."""
        pair = _loaded(*paths)
        for batch in batches:
            for n in range(batch.num_rows):
                (r,) = batch.slice(n, 1).to_pylist()
                fragment = Fragment.from_row(pair, r)
                if not fragment.bad:
                    fragment.joint(fragment.prefix, fragment.first_cut)
                yield _fragment_batch([{"row": r["row"], "doc_id": r["doc_id"], "place": 0, **fragment.as_row()}])

    return finish


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each document's groups, which come in order."""
    key, digest, empty, rows = None, None, True, []
    for batch in batches:
        for row, groups in zip(batch.column("row").to_pylist(), batch.column("groups").to_pylist(), strict=True):
            if row != key:
                if digest:
                    rows.append((key, digest.hexdigest()))
                key, digest, empty = row, hashlib.sha256(), True
            if groups:
                digest.update((groups if empty else ";" + groups).encode())
                empty = False
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["row", "groups_sha256"])
            rows = []
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], ["row", "groups_sha256"])


def _long(rows: DataFrame, paths: tuple[str, str], size: int) -> DataFrame | None:
    """ALIGNED_SCHEMA for texts of several ranges."""
    ranges = stored(rows.mapInArrow(tidied(_ranges(paths, size)), RANGE_SCHEMA), "ranges")
    most = ranges.agg(F.max("ranges")).first()[0]
    if most is None:
        return None
    fragments = stored(ranges.repartition("row", "place").mapInArrow(tidied(_fragments(paths)), FRAGMENT_SCHEMA), "fragments")
    level = fragments.withColumn("groups", F.lit("")).withColumn("at", F.col("place"))
    while most > 1:
        level = level.withColumn("place", F.floor(F.col("at") / FAN).cast("long"))
        level = level.repartition("row", "place").sortWithinPartitions("row", "place", "at").drop("at").mapInArrow(_composer(paths), FRAGMENT_SCHEMA).withColumn("at", F.col("place"))
        most = -(-most // FAN)
    found = stored(level.drop("at").mapInArrow(_finished(paths), FRAGMENT_SCHEMA), "composed")
    own = fragments.select("row", "place", F.lit(1).alias("part"), "groups")
    joints = found.select("row", F.explode("joints").alias("j")).select("row", F.col("j.place").alias("place"), F.lit(0).alias("part"), F.col("j.groups").alias("groups"))
    texts = own.unionByName(joints).repartition("row").sortWithinPartitions("row", "place", "part")
    joined = found.drop("groups").join(texts.mapInArrow(_digests, "row long, groups_sha256 string"), "row")
    zero = {**{n: F.lit(0).cast("long") for n in _SUMS}, "pairs": F.array().cast("array<long>"), "times": F.array().cast("array<int>"), "groups_sha256": F.lit("")}
    return joined.select("row", "doc_id", *[F.when(F.col("bad"), zero[n]).otherwise(F.col(n)).alias(n) for n in zero])


def align(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, size: int = RANGE) -> DataFrame:
    """Tokens, groups and links per row of ``docs(doc_id, text)``, stored.

    Columns: row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, pairs (the different links as a * 2**32 + b,
    sorted), times (how often each occurs), groups_sha256. A null or empty text, and one whose tokens do not spell it,
    has zeros, no pairs and ''. A null doc_id stays null, repeated rows are aligned each, other columns are not read,
    an empty table gives no rows. Texts of more than ``size`` bytes are dealt out in ranges.
    """
    if byte_path is None or piece_path is None:
        import public_tokenizers

        byte_path, piece_path = byte_path or public_tokenizers.path(BYTE_VOCABULARY), piece_path or public_tokenizers.path(PIECE_VOCABULARY)
    paths = (byte_path, piece_path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    length = F.coalesce(F.octet_length("text"), F.lit(0))
    short = stored(rows.filter(length < size).mapInArrow(tidied(_whole(paths)), ALIGNED_SCHEMA), "aligned")
    longer = _long(rows.filter(length >= size), paths, size)
    return short if longer is None else short.unionByName(stored(longer, "aligned-long"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, a, b, documents (how many hold the link), best (no other link of ``a`` is in more documents)."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("documents"))
    counts = stored(counts.select("pair", F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND((1 << 32) - 1).cast("int").alias("b"), "documents"), "pairs")
    most = counts.groupBy("a").agg(F.max("documents").alias("most"))
    return counts.join(most, "a").select("pair", "a", "b", "documents", (F.col("documents") == F.col("most")).alias("best"))


def scored(aligned: DataFrame, counts: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``aligned`` with n_best (links that are a best one) and count_sum (documents, summed over links); 0 without links.

    A pair table within ``broadcast_pairs`` rows goes to every task; a larger one meets salted links by a shuffle.
    """
    lookup = stored(counts.select("pair", "documents", "best"), "lookup")
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    if lookup.count() <= broadcast_pairs:
        met = links.join(F.broadcast(lookup), "pair")
    else:
        met = salted_join(links, lookup, ["pair"], salt_on=["row"], salts=64)
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("documents") * F.col("times")).alias("count_sum"))
    found = aligned.drop("pairs", "times").join(sums, "row", "left")
    return found.select(*found.columns[:-2], *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")])
