"""SimHash against bit-by-bit fingerprints and all pairs."""

import re

import numpy as np
import pytest
import xxhash

from chartula.llm import simhash
from chartula.llm.common import stored


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[n : n + 4]).encode(), 42) for n in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO\x0bthree", "É a b c d e f g", "a b c d " * 50, "x y z w v u t s"])
def test_fingerprint(text, monkeypatch):
    monkeypatch.setattr(simhash, "COUNTED", 7)
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def near(random, size):
    base = random.integers(0, 1 << 64, size, np.uint64)
    flips = np.zeros(size, np.uint64)
    for _ in range(6):
        flips ^= np.where(random.random(size) < 0.6, np.uint64(1) << random.integers(0, 64, size).astype(np.uint64), np.uint64(0))
    return np.unique(np.concatenate([base, base ^ flips]))


@pytest.mark.parametrize("product", [1 << 4, 1 << 10, 1 << 21])
def test_close_pairs(product, monkeypatch):
    monkeypatch.setattr(simhash, "PRODUCT", product)
    random = np.random.default_rng(5)
    a, b = near(random, 120), near(random, 90)
    b = np.unique(np.concatenate([b, a[::3] ^ np.uint64(5)]))
    got = {(int(x), int(y)) for i, j in simhash.close_pairs(a, b, 4) for x, y in zip(i, j, strict=True)}
    want = set(zip(*(x.tolist() for x in np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= 4)), strict=True))
    assert got == want and want


def classes(edges, vertices):
    parent = {v: v for v in vertices}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in vertices}


def test_forest_keeps_components():
    random = np.random.default_rng(1)
    left, right = random.integers(0, 60, 50), random.integers(0, 60, 50)
    vertices = set(left.tolist()) | set(right.tolist())
    a, b = simhash.forest(left, right)
    assert len(a) < len(vertices)
    assert classes(zip(a.tolist(), b.tolist(), strict=True), vertices) == classes(zip(left.tolist(), right.tolist(), strict=True), vertices)


def test_components_of_paths_and_stars(spark):
    edges = [(n, n + 1) for n in range(40)] + [(100, n) for n in range(101, 120)] + [(200, 201), (201, 200), (199, 201)]
    out = {r.vertex: r.root for r in simhash.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    vertices = {v for e in edges for v in e}
    # Any vertex of a component may be its root; the same one for all of its vertices.
    found, want = {v: out.get(v, v) for v in vertices}, classes(edges, vertices)
    least = {}
    for v in sorted(vertices):
        least.setdefault(found[v], v)
    assert {v: least[found[v]] for v in vertices} == want and all(want[root] == want[v] for v, root in found.items())


def test_a_rising_path_takes_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(simhash, "stored", lambda df, tag: rounds.append(tag) or stored(df, tag))
    found = simhash.components(spark.createDataFrame([(n, n + 1) for n in range(1000)], "src long, dst long"))
    roots = {r.vertex: r.root for r in found.collect()}
    assert len(set(roots.values())) == 1 and len(roots) == 1000
    assert rounds.count("moves") < 20


def test_links_over_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 3)
    values = near(np.random.default_rng(3), 150)
    fps = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    edges = [(r.src, r.dst) for r in simhash.links(fps).collect()]
    signed = values.view(np.int64).tolist()
    want = [(signed[i], signed[j]) for i, j in zip(*np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= 4), strict=True)]
    assert classes(edges, signed) == classes(want, signed)


def test_near_duplicates(spark):
    text = " ".join(f"word{n}" for n in range(400))
    rows = [(5, text, 1), (3, text.upper(), 2), (9, None, 3), (8, "", 4), (7, "other words entirely here", 5), (7, "other words entirely here", 5), (None, text, 6), (None, "alone and unlike", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    out = sorted(((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(docs).collect()))
    assert out == [(0, 0), (0, 3), (3, 3), (5, 3), (7, 7), (7, 7), (8, 8), (9, 8)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
