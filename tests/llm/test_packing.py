"""Packing: ids as the vocabulary's library gives them, every id once, little padding."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from chartula.llm import packing

PATH = public_tokenizers.path(packing.VOCABULARY)
ODD = [
    None, "", " \t\n", "It's DON'T we'll I'D x're", "Ünïcödé ÀÉÎ ß ÿ × ÷ ª º µ", "汉字 and ελληνικά ΣΑΣ", "e\u0301 A\u030a", "a\u00a0b\u2003c\u0085d", "x\x00y \x01 \x7f",
    "<|endoftext|> a<|startoftext|>b", "1234 5a6 ½²³ ---!!! #$%", "a" * 300 + "!" * 50, "'s''t 'LL", "\U0001f600 ok", "İstanbul ǅ Ǆ",
]


def ids_of(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library():
    found = list(packing.WordEncoder(PATH).encode(pa.array(ODD, pa.string())))
    lengths = np.concatenate([n for _, n in found])
    ids = np.split(np.concatenate([i for i, _ in found]), np.cumsum(lengths)[:-1])
    assert [i.tolist() for i in ids] == [ids_of(t) for t in ODD]


def test_latin_words_equal_the_library():
    random = np.random.default_rng(4)
    letters = [chr(c) for c in (*range(33, 127), *range(161, 256))]
    text = " ".join("".join(random.choice(letters, random.integers(1, 9))) for _ in range(5000))
    ((ids, _),) = packing.WordEncoder(PATH).encode(pa.array([text]))
    assert ids.tolist() == ids_of(text)


def test_level_grows_the_squares_least():
    random = np.random.default_rng(0)
    levels = packing.SumOfSquares(32)
    for number, item in enumerate(random.integers(1, 32, 300)):
        item = int(item)
        before = levels.counts.copy()
        options = {}
        for level in [0, *np.flatnonzero(before[1:33]) + 1]:
            if level + item <= 32:
                after = before.copy()
                after[level] -= bool(level)
                after[level + item] += level + item < 32
                options[int(level)] = int((after**2).sum())
        assert options[levels.level_for(item)] == min(options.values())
        levels.put((number, 0, item, np.zeros(item)))
        assert (levels.counts == [len(w) if n else 0 for n, w in enumerate(levels.open)]).all()


def test_pieces(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + n, t) for n, t in enumerate(ODD)] + [(None, "no id")], "doc_id long, text string"))
    rows = packing.pack(docs.repartition(3)).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(texts)
    for doc_id, own in pieces.items():
        ids = np.array([*ids_of(texts[doc_id]), packing.END_ID], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= packing.WINDOW
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    assert padding == 0
    # Documents below a window stay whole but for the ends of the tasks.
    short = Counter(r.doc_id for r in rows if r.doc_tokens < packing.WINDOW)
    assert sum(n > 1 for n in short.values()) < 0.2 * len(short)
    assert packing.pack(docs.limit(0)).count() == 0
