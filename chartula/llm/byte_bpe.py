"""Byte-level BPE by the tokenizers library, from a table of ranks: texts to ids with offsets, and back to bytes.

The library works on characters, so every byte is shown as one printable character; the table is undone when
ids are decoded. A rank table names no merges: each way of cutting a token into two tokens is one, in the order
of the ranks. Texts are cut into pieces by the vocabulary's pattern first. Every different piece of a task is
encoded once and looked up after that. Rows are independent: nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from chartula.llm.common import tidied

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
TOKENS_SCHEMA = "doc_id long, ids array<int>"
#: Characters of a text that are cut into pieces at a time; tokens that are put together at a time.
CHARACTERS_AT_ONCE, TOKENS_AT_ONCE = 1 << 18, 1 << 20
#: Pieces, and characters of pieces, that a task remembers.
PIECES, PIECE_CHARACTERS = 1 << 18, 1 << 23
#: Between something and a space, no piece of the pattern goes on.
_GAP = re.compile(r"\S(?= )")


def shown_bytes() -> list[str]:
    """The character that stands for each byte: itself where Latin-1 can print it, else one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Bytes of each token and its id."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def blocks(text: str, size: int = CHARACTERS_AT_ONCE) -> Iterator[str]:
    """``text`` in parts of at least ``size`` characters that end in gaps."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + size)
        end = gap.end() if gap else len(text)
        yield text[at:end] if at or end < len(text) else text
        at = end


class Splitter:
    """The pieces of texts under a pattern, with letters, numbers and white space as the rank table's own library knows them.

    Libraries follow different versions of Unicode, so the classes of the pattern are asked of that library once in a
    process and written out as ranges. Fewer ranges are faster: texts within Latin-1 or the basic plane have their own.
    """

    def __init__(self, pattern: str):
        import tiktoken

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        known = {}
        for name in (r"\p{L}", r"\p{N}", r"\s"):
            asked = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
            known[name] = asked.decode_bytes(asked.encode_ordinary(every)).decode()
        self.latin, self.basic, self.full = (
            re.compile(_written_out(pattern, {name: _ranges(c for c in own if ord(c) < top) for name, own in known.items()})) for top in (0x100, 0x10000, 0x110000)
        )

    def __call__(self, text: str) -> list[str]:
        """The pieces, in turn."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return (self.basic if len(text.encode("utf-16-le")) == 2 * len(text) else self.full).findall(text)
        return self.latin.findall(text)


def _ranges(characters: Iterable[str]) -> str:
    points = np.array(sorted(map(ord, characters)))
    runs = np.split(points, np.flatnonzero(np.diff(points) > 1) + 1)
    return "".join(f"\\U{run[0]:08x}-\\U{run[-1]:08x}" for run in runs)


def _written_out(pattern: str, classes: dict[str, str]) -> str:
    """``pattern`` with ranges in place of its classes, alone and in brackets."""

    def ranges(found: re.Match) -> str:
        if found["set"] is None:
            return f"[^{classes[r'\s']}]" if found[0] == r"\S" else f"[{classes[found[0]]}]"
        inside = found["set"]
        for name, own in classes.items():
            inside = inside.replace(name, own)
        return f"[{found['not']}{inside}]"

    return re.sub(r"\[(?P<not>\^?)(?P<set>[^\]]*)\]|\\p\{[LN]\}|\\[sS]", ranges, pattern)


class Places(dict):
    """Numbers of pieces in the order of their first look-up; ``new`` are those nobody has encoded yet."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        self[piece] = number = len(self)
        return number


class Decoder:
    """Ids of one table of ranks back to bytes, and the characters they cover."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, number in ranks.items():
            tokens[number] = token
        self.widths = np.array([len(t) for t in tokens], np.int64)
        self.begins = np.cumsum(self.widths) - self.widths
        self.table = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids. Characters that are split over tokens are whole again once their bytes stand together."""
        widths = self.widths[ids]
        total = np.cumsum(widths)
        return self.table[np.repeat(self.begins[ids] - total + widths, widths) + np.arange(total[-1] if len(total) else 0)]

    def offsets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token and the one behind its last. Tokens that share a character both hold it."""
        raw, ends = self.decode(ids), np.cumsum(self.widths[ids])
        number = np.cumsum((raw & 0xC0) != 0x80) - 1
        begins = ends - self.widths[ids]
        return number[begins], number[ends - 1] + 1


class ByteBpe:
    """Encoder of one table of ranks."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        # Spark runs a task for every core already.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        ranks = read_ranks(path)
        shown = shown_bytes()
        show = lambda token: "".join(shown[b] for b in token)
        merges = [(show(t[:n]), show(t[n:])) for t in sorted(ranks, key=ranks.get) for n in range(1, len(t)) if t[:n] in ranks and t[n:] in ranks]
        # A piece that is a token as a whole is that token, whatever its merges would give.
        self.tokenizer = Tokenizer(models.BPE(vocab={show(t): i for t, i in ranks.items()}, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.split = Splitter(pattern)
        self.decoder = Decoder(path)
        self._forget()

    def _forget(self) -> None:
        self.place, self.held = Places(), 0
        self.pool, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self) -> None:
        """Encode the pieces that are new to the task."""
        pieces, self.place.new = self.place.new, []
        codes = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        sizes = np.fromiter((len(c.ids) for c in codes), np.int64, len(codes))
        ids = np.fromiter((i for c in codes for i in c.ids), np.int32, sizes.sum())
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.pool = np.concatenate([self.pool, ids])
        self.held += sum(map(len, pieces))

    def encode_some(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; texts are parts of bounded size together."""
        if len(self.place) > PIECES or self.held > PIECE_CHARACTERS:
            self._forget()
        indexes = []
        for text in texts:
            pieces = self.split(text)
            indexes.append(np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces)))
        if self.place.new:
            self._learn()
        found = []
        for index in indexes:
            sizes = self.sizes[index]
            total = np.cumsum(sizes)
            found.append(self.pool[np.repeat(self.starts[index] - total + sizes, sizes) + np.arange(total[-1] if len(total) else 0)])
        return found

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in turn. Texts are read in blocks, so many characters at a time."""
        waiting: list[str] = []
        counts: list[int] = []
        size = 0
        for number, text in enumerate(texts):
            parts = blocks(text)
            if len(text) > CHARACTERS_AT_ONCE:
                yield from self._put_together(waiting, counts)
                waiting, counts, size = [], [], 0
                yield np.concatenate([np.zeros(0, np.int32), *(self.encode_some([part])[0] for part in parts)])
                continue
            waiting += parts
            counts.append(len(waiting))
            size += len(text)
            if size > CHARACTERS_AT_ONCE or number == len(texts) - 1:
                yield from self._put_together(waiting, counts)
                waiting, counts, size = [], [], 0

    def _put_together(self, parts: list[str], counts: list[int]) -> Iterator[np.ndarray]:
        found, at = self.encode_some(parts), 0
        for count in counts:
            yield np.concatenate([np.zeros(0, np.int32), *found[at:count]])
            at = count


@lru_cache(maxsize=2)
def _loaded(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


@lru_cache(maxsize=2)
def _decoder(path: str) -> Decoder:
    return Decoder(path)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays), pa.int32()))


def id_digest(ids: np.ndarray) -> str:
    """Lowercase hexadecimal SHA-256 of the decimal ids, joined by commas."""
    digest = hashlib.sha256()
    for at in range(0, len(ids), TOKENS_AT_ONCE):
        written = pc.cast(pa.array(ids[at : at + TOKENS_AT_ONCE]), pa.string())
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(written)], pa.int32()), written), ",")
        digest.update((b"," if at else b"") + whole[0].as_buffer())
    return digest.hexdigest()


def _encoder(path: str, pattern: str, offsets: bool, digests: bool):
    def encode_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _loaded(path, pattern)
        for batch in batches:
            ids, begin, held, size = batch.column("doc_id"), 0, [], 0
            for n, found in enumerate(coder.encode(pc.fill_null(batch.column("text"), "").to_pylist())):
                held.append(found)
                size += len(found)
                if size >= TOKENS_AT_ONCE or n == batch.num_rows - 1:
                    columns, names = [ids.slice(begin, len(held)), _lists(held)], ["doc_id", "ids"]
                    if offsets:
                        spans = [coder.decoder.offsets(f) for f in held]
                        columns += [_lists([s[side].astype(np.int32) for s in spans]) for side in (0, 1)]
                        names += ["begins", "ends"]
                    if digests:
                        columns.append(pa.array([id_digest(f) for f in held], pa.string()))
                        names.append("ids_sha256")
                    yield pa.RecordBatch.from_arrays(columns, names)
                    begin, held, size = n + 1, [], 0

    return encode_partition


def _decode(path: str):
    def decode_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _decoder(path)
        known = coder.widths > 0
        for batch in batches:
            ids = batch.column("ids")
            begin, texts, size = 0, [], 0
            for n in range(batch.num_rows):
                values = ids[n].values
                own = np.zeros(0, np.int32) if values is None else pc.fill_null(values, -1).to_numpy(zero_copy_only=False)
                fits = values is not None and (not len(own) or (own.min() >= 0 and own.max() < len(known) and known[own].all()))
                texts.append(coder.decode(own).tobytes() if fits else None)
                size += len(texts[-1] or b"")
                if size >= 4 * TOKENS_AT_ONCE or n == batch.num_rows - 1:
                    rows = batch.slice(begin, len(texts))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.binary())], [*batch.schema.names, "decoded"])
                    begin, texts, size = n + 1, [], 0

    return decode_partition


def encode(docs: DataFrame, vocabulary_path: str | None = None, pattern: str | None = None, offsets: bool = False, digests: bool = False) -> DataFrame:
    """doc_id and ids per row of ``docs(doc_id, text)``.

    ``offsets`` adds the characters of each token as begins and ends, ``digests`` the digest of the ids as ids_sha256.
    No special token is made; their strings are plain text. A null or empty text has no ids. A null doc_id stays
    null, repeated rows are encoded each, other columns are not read, an empty table gives no rows. A text is
    read in blocks, whole; one piece without any gap is encoded in one go, whatever its length.
    """
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = TOKENS_SCHEMA + ", begins array<int>, ends array<int>" * offsets + ", ids_sha256 string" * digests
    return rows.mapInArrow(tidied(_encoder(_ranks_path(vocabulary_path), pattern, offsets, digests)), schema)


def _ranks_path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        return public_tokenizers.path(VOCABULARY)
    return path


def decode(tokens: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """``tokens`` with the bytes of their column ids as the column decoded (in place of one of that name).

    Null ids, and ids among which one is null or not in the vocabulary, decode to null; no ids to no bytes.
    """
    rows = tokens.drop("decoded")
    return rows.mapInArrow(tidied(_decode(_ranks_path(vocabulary_path))), StructType([*rows.schema, StructField("decoded", BinaryType())]))


def decoded_text(decoded: Column) -> Column:
    """Decoded bytes as text. What is no whole character, as at the ends of a cut sequence, becomes U+FFFD."""
    return F.make_valid_utf8(decoded.cast("string"))
