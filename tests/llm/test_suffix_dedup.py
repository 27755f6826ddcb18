"""Suffix dedup against a table of all windows."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from chartula.llm import suffix_dedup as sd
from chartula.llm.common import gathered


def brute(texts: list[str | None]) -> list[np.ndarray]:
    seen, masks = set(), []
    for text in texts:
        raw = (text or "").encode()
        mask = np.zeros(len(raw), bool)
        for at in range(len(raw) - sd.LENGTH + 1):
            window = raw[at : at + sd.LENGTH]
            if window in seen:
                mask[at : at + sd.LENGTH] = True
            seen.add(window)
        masks.append(mask)
    return masks


def passes(texts: list[str | None], per_batch: int) -> list[np.ndarray]:
    """All three passes in this process, one partition."""
    types = [("doc", pa.int64()), ("alt", pa.int64()), ("text", pa.string())]

    def batches(numbers, more=()):
        for at in range(0, len(numbers), per_batch):
            own = numbers[at : at + per_batch]
            columns = [pa.array(own, pa.int64()), pa.array([0] * len(own), pa.int64()), pa.array([texts[n] for n in own], pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array([m[n] for n in own]) for m in more], [n for n, _ in types] + ["stretches"] * len(more))

    spans = gathered(sd._second_pass(sd._first_pass(batches(range(len(texts))))))
    masks = [np.zeros(len((t or "").encode()), bool) for t in texts]
    if spans is None:
        return masks
    stretches: dict[int, list] = {}
    rows = list(zip(*(spans[c].tolist() for c in ("doc", "first", "last", "kind")), strict=True))
    for doc, first, last, kind in rows:
        if kind == sd.COMPARE:
            stretches.setdefault(doc, []).append({"first": first, "last": last})
    repeats = [r[:3] for r in rows if r[3] == sd.REPEAT]
    if stretches:
        cores = gathered(sd._core_pass(sd._step_rows(batches(sorted(stretches), [stretches]))))
        names = ("doc", "first", "last", "kind")
        repeats += [r[:3] for r in zip(*(cores[c].tolist() for c in names), strict=True) if r[3] == sd.REPEAT]
        left = {c: v[cores["kind"] == sd.COMPARE] for c, v in cores.items() if c not in ("last", "kind")}
        more = gathered(sd._third_pass(sd._window_rows(iter([pa.RecordBatch.from_pydict(left)]))))
        if more is not None:
            repeats += zip(*(more[c].tolist() for c in names[:3]), strict=True)
    for doc, first, last in repeats:
        masks[doc][first : last + sd.LENGTH] = True
    return masks


def planted(seed: int, size: int) -> list[str | None]:
    random = np.random.default_rng(seed)
    word = lambda: "".join(random.choice(list("abé"), random.integers(1, 6)))
    passages = [" ".join(word() for _ in range(40)) for _ in range(4)]
    texts: list[str | None] = [None, "", "short"]
    for _ in range(size):
        parts = []
        for _ in range(random.integers(1, 5)):
            passage = passages[random.integers(4)]
            cut = random.integers(0, len(passage))
            parts.append([passage, passage[cut:], passage[:cut], " ".join(word() for _ in range(20)), "a" * random.integers(1, 400)][random.integers(5)])
        texts.append("".join(parts))
    return texts + texts[-3:]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize(("per_batch", "few"), [(1, 32), (5, 0), (5, 2), (1000, 1), (1000, 32)])
def test_passes_equal_brute_force(seed, per_batch, few, monkeypatch):
    monkeypatch.setattr(sd, "FEW", few)
    texts = planted(seed, 25)
    for got, want in zip(passes(texts, per_batch), brute(texts), strict=True):
        assert (got == want).all()


def test_chunks_do_not_matter(monkeypatch):
    monkeypatch.setattr(sd, "CHUNK", 300)
    monkeypatch.setattr(sd, "_ROLLING", [])
    texts = planted(9, 20)
    for got, want in zip(passes(texts, 7), brute(texts), strict=True):
        assert (got == want).all()


def test_frequent_anchor_travels_as_a_mark():
    common = "the very same line that all documents have "
    texts = [f"{n:060d}" + common + f"{n * 7919:060d}" for n in range(300)]
    rows = gathered(sd._first_pass(iter([pa.RecordBatch.from_pydict({"doc": list(range(300)), "alt": [0] * 300, "text": texts})])))
    _, counts = np.unique(rows["key"], return_counts=True)
    assert counts.max() <= 2


def test_rows_and_whole_characters(spark):
    long = "Ünïcödé " * 40
    rows = [(3, long, "x"), (1, long, "x"), (2, None, None), (4, "", "y"), (3, long, "x"), (5, "own text " + long[:150], "z"), (None, long, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc string").withColumnRenamed("doc", "alt")
    out = {(r.doc_id, r.n_removed) for r in sd.remove_repeats(docs).collect()}
    # doc_id 3 occurs twice with one text: one document. Null ids come last.
    texts = [long, None, long, "", "own text " + long[:150], long]
    masks = brute(texts)
    assert out == {(1, masks[0].sum()), (2, 0), (3, masks[2].sum()), (4, 0), (5, masks[4].sum()), (None, masks[5].sum())}
    by_id = {r.doc_id: r for r in sd.remove_repeats(docs).collect()}
    raw = texts[4].encode()
    kept = np.frombuffer(raw, np.uint8)[~masks[4]].tobytes()
    assert hashlib.sha256(bytes(by_id[5].kept)).digest() == hashlib.sha256(kept).digest()
    assert by_id[5].n_bytes == len(raw) and by_id[2].n_bytes == 0 and by_id[2].n_spans == 0
    # Runs that begin or end inside a character give it up.
    raw = "aéb".encode()
    assert sd.without(raw, [(2, 4)], True)[0] == "aé".encode()
    assert sd.without(raw, [(0, 2)], True)[0] == "éb".encode()
    assert sd.without(raw, [(1, 2)], True) == (raw, 0, 0)


def test_one_id_with_two_texts(spark):
    random = np.random.default_rng(6)
    text, other = ("".join(random.choice(list("abcdefghij"), size)) for size in (100, 130))
    docs = spark.createDataFrame([(1, text + other), (1, other + text), (1, other + text)], "doc_id long, text string")
    out = sorted(r.n_removed for r in sd.remove_repeats(docs).collect())
    assert out in ([0, 230, 230], [0, 0, 230])


def test_empty_table(spark):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_are_in_order_before_they_are_thinned_out(spark):
    docs = spark.createDataFrame([(1, "a b c " * 40), (2, "a b c " * 40)], "doc_id long, text string")
    plan = sd.with_spans(docs)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = [plan[n + 1 : n + 3] for n, line in enumerate(plan) if "_step_rows(" in line]
    assert below and all(any("Sort [doc#" in line for line in lines) for lines in below), plan
