"""Packing documents into token sequences by the sum-of-squares rule.

Every task packs the documents of its own partition, one after another. A document of a window or more gives
full windows first; the rest is an item. Open windows are only known by their fill: ``counts[f]`` windows are
filled up to ``f``. An item of ``s`` tokens goes to the fill level (0: a new window) for which the sum of the
squared counts grows least afterwards, so no fill level piles up. At the end of a task the windows that are
still open are poured into full ones, and what remains is cut at powers of two, which need no padding.
Windows never hold documents of two tasks: nothing is shuffled, and a lost task is simply packed again.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartula.llm.common import tidied

WINDOW = 4096
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Letters and pieces of words of Latin-1 characters under the vocabulary's splitting rule (fixed values).
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECES = re.compile(rf"'(?:[std]|re|ve|m|ll)|[{_LETTERS}]+|[{_DIGITS}]|\n|[^{_LETTERS}{_DIGITS}\n]+")
_LATIN = re.compile(r"[\x21-\x7e\xa1-\xff]+")
_WORD_END = "</w>"
#: Tokens that are put together at a time.
TOKENS_AT_ONCE = 2_000_000


class WordEncoder:
    """Token ids of texts under a vocabulary in which white space only separates words.

    White space ends every token, so a text's ids are those of its words in turn, and each different word
    of a batch is encoded once. Words of Latin-1 characters take a short cut: their pieces are cut here and
    merged by a second library under the same merge table, in which the mark of a word's end is a byte of
    its own (merged first, as its ranks stand before those of all other merges). All other words go
    through the vocabulary's own library. The tests compare both ways.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec["added_tokens"]]
        # Byte-level vocabularies show printable Latin-1 bytes as themselves, the rest from U+0100 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in shown} | {chr(0x100 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {}
        for token, number in spec["model"]["vocab"].items():
            if token not in self.special:
                stem = token.removesuffix(_WORD_END) or token
                ranks[bytes(byte[c] for c in stem) + (b"\0" if stem != token else b"")] = number
        self.merger = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.line = ranks[b"\n\0"]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end and their number for each word."""
        plain = [bool(_LATIN.fullmatch(w)) and not any(s in w for s in self.special) for w in words]
        lines = "".join([w + "\n" for w, p in zip(words, plain, strict=True) if p]).lower()
        ids = self.merger.encode_to_numpy("".join([p + "\0" for p in _PIECES.findall(lines)]), disallowed_special=())
        ends = np.flatnonzero(ids == self.line)
        sizes = np.zeros(len(words), np.int64)
        chosen = np.array(plain, bool)
        sizes[chosen] = np.diff(ends, prepend=-1) - 1
        ids = ids[ids != self.line].astype(np.uint32)
        if chosen.all():
            return ids, sizes
        others = self.tokenizer.encode_batch_fast([w for w, p in zip(words, plain, strict=True) if not p], add_special_tokens=False)
        sizes[~chosen] = [len(e.ids) for e in others]
        pool = np.empty(sizes.sum(), np.uint32)
        place = np.repeat(chosen, sizes)
        pool[place] = ids
        pool[~place] = np.fromiter((i for e in others for i in e.ids), np.uint32)
        return pool, sizes

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For some texts at a time: all ids end to end, and the number of ids of each text (null: none)."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = words.flatten().dictionary_encode()
        pool, sizes = self._words(coded.dictionary.to_pylist())
        begins = np.cumsum(sizes) - sizes
        index = coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[index])])[words.offsets.to_numpy() - words.offsets[0].as_py()]
        words_end = words.offsets.to_numpy() - words.offsets[0].as_py()
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + TOKENS_AT_ONCE, "right")) - 1)
            own = index[words_end[at] : words_end[to]]
            lengths = sizes[own]
            shift = begins[own] - (np.cumsum(lengths) - lengths)
            yield pool[np.repeat(shift, lengths) + np.arange(ends[to] - ends[at])], np.diff(ends[at : to + 1])
            at = to


class SumOfSquares:
    """Open windows by fill level. A piece is (document, start, length, ids)."""

    def __init__(self, size: int):
        self.size = size
        self.counts = np.zeros(size + 1, np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(size + 1)]

    def level_for(self, item: int) -> int:
        """The level f, with f + item inside the window, whose choice lets the sum of squares grow least.

        Moving a window from f to f + item changes the sum by 2 * (counts[f + item] - counts[f]) + 2;
        a new window by 2 * counts[item] + 1, a window that gets full by 1 - 2 * counts[f]. Ties go to
        the fullest window.
        """
        change = 2 * (self.counts[item:] - self.counts[: self.size + 1 - item]) + 2
        change[0] = 2 * self.counts[item] + 1
        change[-1] = 1 - 2 * self.counts[self.size - item]
        change[1:][self.counts[1 : self.size + 1 - item] == 0] = np.iinfo(np.int64).max
        return len(change) - 1 - int(change[::-1].argmin())

    def put(self, piece: tuple) -> list[tuple] | None:
        """Place a piece; the pieces of a window that it fills up."""
        item = piece[2]
        level = self.level_for(item)
        window = self.open[level].pop() if level else []
        self.counts[level] -= bool(level)
        window.append(piece)
        if level + item == self.size:
            return window
        self.open[level + item].append(window)
        self.counts[level + item] += 1
        return None

    def rest(self) -> Iterator[tuple]:
        """The pieces of all open windows, the fullest window first."""
        for level in range(self.size, -1, -1):
            for window in self.open[level]:
                yield from window


def _cut(piece: tuple, at: int) -> tuple[tuple, tuple]:
    doc, start, length, ids = piece
    return (doc, start, at, ids[:at]), (doc, start + at, length - at, ids[at:])


def poured(pieces: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    """Windows filled with the pieces in turn, cut where one is full; the last part in powers of two."""
    window: list[tuple] = []
    room = size
    for piece in pieces:
        while piece[2] > room:
            head, piece = _cut(piece, room)
            yield [*window, head]
            window, room = [], size
        window.append(piece)
        room -= piece[2]
        if not room:
            yield window
            window, room = [], size
    left = size - room
    while left:
        most = 1 << (left.bit_length() - 1)
        part, need = [], most
        while need:
            piece = window.pop(0)
            if piece[2] > need:
                piece, back = _cut(piece, need)
                window.insert(0, back)
            part.append(piece)
            need -= piece[2]
        yield part
        left -= most


def _packer(path: str, size: int, end_id: int):
    def pack_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, levels = WordEncoder(path), SumOfSquares(size)
        first, made = TaskContext.get().partitionId() << 40, 0
        rows: list[tuple] = []

        def place(window: list[tuple]) -> None:
            nonlocal made
            offset = 0
            for (doc_id, tokens), start, length, ids in window:
                crc = zlib.crc32(np.ascontiguousarray(ids, "<u4"))
                rows.append((doc_id, start, length, crc, tokens, first + made, offset))
                offset += length
            made += 1

        def taken() -> pa.RecordBatch:
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
            rows.clear()
            return batch

        for batch in batches:
            doc_ids = iter(batch.column("doc_id").to_pylist())
            for ids, lengths in encoder.encode(batch.column("text")):
                for doc_id, end, n in zip(itertools.islice(doc_ids, len(lengths)), np.cumsum(lengths).tolist(), lengths.tolist(), strict=True):
                    own = np.empty(n + 1, "<u4")
                    own[:n], own[n] = ids[end - n : end], end_id
                    doc, start = (doc_id, n + 1), 0
                    while n + 1 - start >= size:
                        place([(doc, start, size, own[start : start + size])])
                        start += size
                    if start <= n and (full := levels.put((doc, start, n + 1 - start, own[start:].copy()))):
                        place(full)
                if len(rows) >= 20_000:
                    yield taken()
        for window in poured(levels.rest(), size):
            place(window)
        if rows:
            yield taken()

    return pack_partition


def pack(docs: DataFrame, vocabulary_path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of all rows of ``docs(doc_id, text)`` in sequences of at most ``window`` tokens.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null or empty text
    is the end id alone. A null doc_id stays null, repeated rows are packed each, other columns are not
    read, an empty table gives no rows.
    """
    if vocabulary_path is None:
        import public_tokenizers

        vocabulary_path = public_tokenizers.path(VOCABULARY)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(_packer(vocabulary_path, window, end_id)), SCHEMA)
