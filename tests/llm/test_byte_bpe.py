"""Byte-level BPE: ids as the rank table's own library gives them, offsets by plain counting, exact round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from chartula.llm import byte_bpe, catalog

PATH, PATTERN = public_tokenizers.path(byte_bpe.VOCABULARY), public_tokenizers.PATTERN
ODD = [
    None, "", " ", "\n\n  x", "a  b  c　d \t\r\n ", "It's we'll I'D x're 's''t", "Ünïcödé ß ÿ × ª", "汉字 と かな ελληνικά ΣΑΣ हिन्दी", "é Å", "\x00 \x01\x7f",
    "<|endoftext|> <s>", "1234 5a6 ½²³ ---!!! #$%", "=" * 3000, "a" * 5000 + "!" * 50, "\U0001f600\U0001f468‍\U0001f469 ok", "\U0003d0d1 a\U000325a3b \U00012582 7\U000125cf", "﻿   x\u0085y", "x" + " " * 700 + "y",
]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.ByteBpe(PATH, PATTERN)


def ids_of(coder, text):
    (ids,) = coder.encode([text])
    return ids.tolist()


def varied(count):
    draw = random.Random(3)
    alphabets = ["ab", "=- *#\n", "aeiourstln' ", "".join(map(chr, range(0x20, 0x250))), "".join(map(chr, range(0x4E00, 0x4E80))) + " 的。", "".join(map(chr, range(0x1F600, 0x1F640)))]
    return ["".join(draw.choice(draw.choice(alphabets) if n % 2 else alphabets[n % 6]) for _ in range(draw.randrange(1, 80))) for n in range(count)]


def test_ids_equal_the_library(library, coder):
    for text in [t for t in ODD if t] + varied(20_000):
        assert ids_of(coder, text) == library.encode_ordinary(text), text


def test_every_token_and_repeated_tokens(library, coder):
    draw, tokens = random.Random(5), [t for t in byte_bpe.read_ranks(PATH) if len(t) > 1]
    for token in draw.sample(tokens, 5_000):
        text = (token * draw.randrange(1, 5) + token[: draw.randrange(len(token))]).decode("utf-8", "ignore")
        assert ids_of(coder, text) == library.encode_ordinary(text), text


def test_unassigned_characters_of_either_library(library, coder):
    points = [*range(0x0860, 0x0900), *range(0x1C80, 0x1C90), *range(0xA7C0, 0xA800), *range(0x10D40, 0x10DC0), *range(0x11B60, 0x11C00), *range(0x12540, 0x12660), *range(0x32300, 0x32600)]
    for point in points:
        text = f"a{chr(point)}b 1{chr(point)}2 !{chr(point)}"
        assert ids_of(coder, text) == library.encode_ordinary(text), hex(point)


def test_blocks_and_forgetting_change_nothing(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "PIECES", 50)
    small = byte_bpe.ByteBpe(PATH, PATTERN)
    monkeypatch.setattr(byte_bpe, "CHARACTERS_AT_ONCE", 100)
    monkeypatch.setattr(byte_bpe.blocks, "__defaults__", (100,))
    text = " ".join(t for t in ODD + varied(300) if t)
    assert "".join(byte_bpe.blocks(text)) == text and len(list(byte_bpe.blocks(text))) > 50
    texts = [text, "", *[t for t in ODD if t], text[::-1], "x"]
    assert [ids.tolist() for ids in small.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_offsets(coder):
    for text in [t for t in ODD if t] + varied(500):
        owner = [n for n, c in enumerate(text) for _ in c.encode()]
        ids = np.array(ids_of(coder, text))
        at = 0
        for number, begin, end in zip(ids, *coder.decoder.offsets(ids), strict=True):
            width = len(coder.decoder.decode(np.array([number])))
            assert (begin, end) == (owner[at], owner[at + width - 1] + 1)
            at += width
        assert at == len(owner)


def test_tables(spark, library):
    rows = [(n, t, 5, "x") for n, t in enumerate(ODD)] + [(None, "no id", 1, "y"), (3, ODD[3], 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string")
    found = catalog.op11(docs).collect()
    want = [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, _, _ in rows]
    digest = lambda raw: hashlib.sha256(raw).hexdigest()
    key = lambda row: (row[0] is None, row[0] or 0, row[2])
    assert sorted([tuple(r) for r in found], key=key) == sorted([(i, len(ids), digest(",".join(map(str, ids)).encode()), digest(raw)) for i, ids, raw in want], key=key)
    assert catalog.op11(docs.limit(0)).count() == 0
    spans = byte_bpe.encode(docs.filter("doc_id = 6"), offsets=True).first()
    assert spans.begins[0] == 0 and spans.ends[-1] == len(ODD[6])


def test_decoding_of_odd_ids(spark):
    tokens = spark.createDataFrame([(1, [0, 1], 2), (2, [], 2), (3, None, 2), (4, [0, None], 2), (5, [50256], 2), (6, [-1], 2)], "doc_id long, ids array<int>, decoded int")
    found = {r.doc_id: r.decoded for r in byte_bpe.decode(tokens).collect()}
    assert {i: b if b is None else bytes(b) for i, b in found.items()} == {1: b'!"', 2: b"", 3: None, 4: None, 5: None, 6: None}


def test_split_characters_are_whole_again(spark, coder):
    text = "\U0001f468‍\U0001f469"
    ids = ids_of(coder, text)
    assert len(ids) > 3
    tokens = spark.createDataFrame([(n, ids[:n]) for n in range(1, len(ids) + 1)], "doc_id long, ids array<int>")
    texts = {r.doc_id: r.t for r in byte_bpe.decode(tokens).select("doc_id", byte_bpe.decoded_text(byte_bpe.F.col("decoded")).alias("t")).collect()}
    assert texts[len(ids)] == text and texts[1].endswith("�")


def test_smallest_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r.doc_id: r for r in catalog.QUERIES["op11_byte_bpe"](spark, "/root/testdata/sf0.001").collect()}
    for row in docs.collect():
        ids = library.encode_ordinary(row.text or "")
        assert found[row.doc_id].n_tokens == len(ids)
        assert found[row.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[row.doc_id].decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()
