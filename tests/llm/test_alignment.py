"""Alignment of tokenizers against plain loops over whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from chartula.llm import alignment, catalog

A, B = (public_tokenizers.path(p) for p in (alignment.BYTE_VOCABULARY, alignment.PIECE_VOCABULARY))
SCHEMA = "doc_id long, text string, row string, pairs int"
ODD = [
    None, "", " ", "  ", "\n", "a", " a  b \n c ", "trail  ", "trail ", "\t x\r\n  y", "don't  stop'll 's", "▁", "a▁b c", "x\x00y <0x41> <s> </s> <unk> <|endoftext|>",
    "é é 汉字和かな ελληνικά हिन्दी. 汉字", "\U0001f468‍\U0001f469 \U0001f600", "a b　c\x85d e\x1cf g", "ﬁ ① ½ ﷺ", "=" * 300 + " " * 50 + "-" * 33, "12345 6.7e8 $$$ ((()))", "\U0003d0d1 x\U000325a3y",
]


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(A, B)


def varied(count, most=60):
    draw = random.Random(8)
    alphabets = ["ab ", "the quick brown fox. ", "=- *#\n", "".join(map(chr, range(0x20, 0x250))), "".join(map(chr, range(0x4E00, 0x4E80))) + "的。，", "".join(map(chr, range(0x410, 0x450))) + "  "]
    return ["".join(draw.choice(draw.choice(alphabets) if n % 2 else alphabets[n % 6]) for _ in range(draw.randrange(1, most))) for n in range(count)]


def plain(pair, text):
    """Ids, links (with repeats) and groups of one text."""
    if not text:
        return [], [], [], []
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    pieces = [pair.b.id_to_piece(i) for i in b]
    raw_b = [bytes([int(p[3:5], 16)]) if pair.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces, strict=True)]
    raw_a = [pair.a_bytes[i] for i in a]
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return [], [], [], []
    spans = []
    for raw in (raw_a, raw_b):
        ends = np.cumsum([len(t) for t in raw]).tolist()
        spans.append(list(zip([0, *ends[:-1]], ends, strict=True)))
    links, groups, i, j = [], [], 0, 0
    while i < len(a):
        p, q = i, j
        while True:
            links.append((a[p], b[q]))
            end_a, end_b = spans[0][p][1], spans[1][q][1]
            if end_a == end_b:
                break
            p, q = p + (end_a < end_b), q + (end_b < end_a)
        groups.append((a[i : p + 1], b[j : q + 1]))
        i, j = p + 1, q + 1
    return a, b, links, groups


def wanted(pair, texts):
    found = [plain(pair, t) for t in texts]
    documents = Counter(link for _, _, links, _ in found for link in set(links))
    most = {}
    for (a, _), n in documents.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for a, b, links, groups in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(groups), len(links), sum(documents[k] == most[k[0]] for k in links), sum(documents[k] for k in links), digest))
    return out


def found(spark, texts):
    docs = spark.createDataFrame([(n, t, "r", 1) for n, t in enumerate(texts)], SCHEMA)
    return [tuple(r)[1:] for r in sorted(catalog.op13(docs).collect())]


def test_texts_by_words(spark, pair):
    texts = ODD + varied(400)
    want = wanted(pair, texts)
    assert found(spark, texts) == want
    assert sum(w[0] == 0 for w in want) < len(texts) / 4


@pytest.mark.parametrize("size", [7, 64])
def test_texts_by_ranges(spark, pair, size, monkeypatch):
    monkeypatch.setattr(alignment, "RANGE", size)
    monkeypatch.setattr(alignment.align, "__defaults__", (None, None, size))
    monkeypatch.setattr(alignment, "FAN", 3)
    texts = ODD + varied(60, 400)
    assert found(spark, texts) == wanted(pair, texts)


def test_ranges_hold_every_byte_once(pair):
    for text in [t for t in ODD if t] + varied(300, 300):
        raw, low = (" " + text).encode(), 0
        for start, begin, high, part in alignment.byte_ranges(pair, text, 10):
            assert begin == low and start <= begin and start + len(part.encode()) >= high and raw[start:].startswith(part.encode())
            low = high
        assert low == len(raw)


def test_composition_is_associative(pair):
    draw = random.Random(1)
    for text in [t for t in varied(200, 200) if plain(pair, t)[0]]:
        parts = []
        for place, (start, low, high, part) in enumerate(alignment.byte_ranges(pair, text, draw.randrange(1, 9))):
            ((a, b, spelled),) = pair.encoded([part])
            assert spelled
            parts.append(alignment.Fragment.of(pair, alignment._cut(pair.tokens(a, b, start), low, high), place, False))

        def composed(some):
            if len(some) == 1:
                return some[0]
            at = draw.randrange(1, len(some))
            return composed(some[:at]).then(composed(some[at:]))

        one, other = composed(parts).as_row(), composed(parts).as_row()
        assert all(np.array_equal(one[k], other[k]) if k != "groups" else True for k in one)
        a, b, links, groups = plain(pair, text)
        assert one["n_groups"] + 1 == len(groups) and len(one["suffix_a"]) == 0


def test_a_long_text_without_gaps_is_dealt_out(pair):
    text = "".join(random.Random(3).choice("汉字和的一是不了人我在有他这为之大来以个中上们") for _ in range(4000))
    sizes = [len(part.encode()) for *_, part in alignment.byte_ranges(pair, text, 1000)]
    assert len(sizes) == 13 and max(sizes) < 1500


def test_repeated_rows_empty_tables_and_both_joins(spark, pair):
    texts = ["the quick brown fox", "the quick brown fox", None, "jumps over"]
    want = wanted(pair, texts)
    docs = spark.createDataFrame([(1, texts[0], "r", 1), (1, texts[1], "r", 1), (None, texts[2], "r", 1), (None, texts[3], "r", 1)], SCHEMA)
    assert sorted(tuple(r)[1:] for r in catalog.op13(docs).collect()) == sorted(want)
    assert catalog.op13(docs.limit(0)).count() == 0
    aligned = alignment.align(docs)
    counts = alignment.pair_counts(aligned)
    ways = [sorted(map(str, alignment.scored(aligned, counts, bound).collect())) for bound in (0, 1000)]
    assert ways[0] == ways[1]


def test_smallest_table(spark, pair):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    got = sorted(catalog.QUERIES["op13_alignment"](spark, "/root/testdata/sf0.001").collect())
    assert [tuple(r)[1:] for r in got] == wanted(pair, [r.text for r in docs])
