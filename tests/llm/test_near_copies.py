"""Near copies against plain sets of shingles."""

import math
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chartula.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(text):
    parts = (text or "").encode().lower().split()
    size = min(5, len(parts))
    return {tuple(parts[n : n + size]) for n in range(len(parts) - size + 1)} if parts else set()


def groups(texts):
    sets = {i: plain(t) for i, t in texts.items()}
    group = {i: i for i in texts}
    alike = [(i, j) for i in sets for j in sets if i < j and (5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))]
    for _ in sets:
        for i, j in alike:
            group[i] = group[j] = min(group[i], group[j])
    return group


def varied():
    """Texts with one to ten changed words, chains of them, and odd ones."""
    draw = random.Random(7)
    texts = {}
    for n in range(12):
        words = [f"w{draw.randrange(5000)}" for _ in range(120)]
        for step in range(8):
            texts[n * 10 + step] = " ".join(words)
            for _ in range(draw.randrange(1, 4)):
                words[draw.randrange(len(words))] = f"x{draw.randrange(5000)}"
    return texts | {900: None, 901: " ", 902: "one two", 903: "One  TWO", 904: "one three"}


@pytest.mark.parametrize("tile", [near_copies.TILE, 3])
def test_components(spark, tile):
    texts = varied()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_copies.near_copies(docs, tile).collect()}
    want = groups(texts)
    assert found == want and 12 < len(set(want.values())) < len(texts)


def test_stage_drops_near_copies_that_differ_in_many_bits(spark):
    words = [f"w{n}" for n in range(120)]
    copy = words[:40] + ["other"] + words[41:80] + ["another"] + words[81:]
    docs = spark.createDataFrame([(1, " ".join(words), "en", "s", 0), (2, " ".join(copy), "en", "s", 0), (3, "something else", "en", "s", 0)], SCHEMA)
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_stage_on_the_smallest_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "")
    assert {r.doc_id for r in kept.collect()} == set(groups({r.doc_id: r.text for r in docs.collect()}).values())


def test_many_near_copies_of_one_text(spark, monkeypatch):
    """A large group, of which few are close to each other, hangs together by the text they all come from."""
    monkeypatch.setattr(near_copies, "PAIRS", 20)
    draw = random.Random(9)
    words = [f"w{n}" for n in range(200)]
    texts = {0: " ".join(words)}
    for n in range(1, 150):
        own = list(words)
        for at in draw.sample(range(200), 3):
            own[at] = f"x{draw.randrange(10**6)}"
        texts[n] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()) + [(500, texts[7]), (501, "alone")], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_copies.near_copies(docs, 16).collect()}
    assert found == groups(texts | {500: texts[7], 501: "alone"})


def test_the_sketch_never_misses_a_link():
    draw = random.Random(4)
    for _ in range(300):
        size = draw.randrange(1, 300)
        one = [draw.getrandbits(64) for _ in range(size)]
        shared = -(-8 * size // 9)
        other = one[:shared] + [draw.getrandbits(64) for _ in range(size - shared)]
        a, b = (near_copies.np.unique(near_copies.np.array(x, near_copies.np.uint64)) for x in (one, other))
        assert near_copies.alike(a, b)
        prints = [near_copies.np.frombuffer(near_copies.sketch(near_copies.signature(x)), near_copies.np.uint8) for x in (a, b)]
        assert (prints[0] == prints[1]).sum() >= near_copies.SHARED


def test_sketch_bound():
    """The chance that a pair of similarity 0.8 shares too few bytes."""
    lost = sum(math.comb(160, k) * 0.8**k * 0.2 ** (160 - k) for k in range(near_copies.SHARED))
    assert lost < 1e-5


def test_stage_goes_through_fingerprints(spark, monkeypatch):
    """Operator 10 proposes pairs that the sets decide: near copies go without any band, what is only close in bits stays."""
    words = [f"w{n}" for n in range(4000)]
    texts = {1: " ".join(words), 2: " ".join(words[:200] + ["other"] + words[201:]), 3: "something else", 4: None, 5: " "}
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], SCHEMA)
    pairs = {frozenset(r) for r in corpus_pipeline.fingerprint_pairs(docs).collect()}
    numbers = {r.doc_id: r.n for r in docs.select("doc_id", near_copies.place(F.col("text")).alias("n")).collect()}
    assert frozenset((numbers[1], numbers[2])) in pairs and frozenset((numbers[4], numbers[5])) in pairs
    assert not any(numbers[3] in p for p in pairs)
    proposed = spark.createDataFrame([(numbers[1], numbers[2]), (numbers[1], numbers[3])], "place long, other long")
    # No band proposes anything here.
    monkeypatch.setattr(near_copies, "_band_rows", lambda batches: (b.slice(0, 0).select(["fp", "fp"]).rename_columns(["band", "fp"]) for b in batches))
    found = {r.doc_id: r.component_id for r in near_copies.near_copies(docs, proposed=proposed).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
