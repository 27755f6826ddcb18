"""The mix against targets by hand, and its documents against the thresholds' promises."""

import re

import pytest
from pyspark.sql import functions as F

from chartula.llm import mixing


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=str) + [s for s in sizes if s is None]
    weight = dict(zip(names, (mixing.WEIGHTS * len(names)), strict=False))
    budget, out, rest = 1.5 * sum(sizes.values()), {}, set(names)
    while rest:
        total = sum(weight[s] for s in rest)
        over = [s for s in rest if budget * weight[s] / total >= 2 * sizes[s]]
        if not over:
            return out | {s: budget * weight[s] / total for s in rest}
        for s in over:
            out[s] = 2 * sizes[s]
        budget -= sum(out[s] for s in over)
        rest -= set(over)
    return out


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 10, "b": 1000, "c": 5, "d": 0, None: 70}, {"s%d" % n: n * n for n in range(30)}, {"a": 0, "b": 0}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()] + [(s, 0) for s in sizes], "source string, size long")
    got = {r.source: (r.source_size, r.target) for r in mixing.source_targets(rows).collect()}
    want = targets(sizes)
    assert {s: n for s, (n, _) in got.items()} == sizes
    for source, (_, target) in got.items():
        assert target == pytest.approx(want[source], abs=1e-6)


def test_taken(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.select("doc_id", "text", F.when(F.col("source") == "src3", None).when(F.col("source").isin("src1", "src2", "src5"), "hot").otherwise(F.col("source")).alias("source"), F.lit(1).alias("size"), F.lit(2).alias("bound"))
    out = mixing.mix(docs).collect()
    texts = {r.doc_id: (r.source, r.text) for r in docs.collect()}
    assert len(out) == len(texts)
    by: dict = {}
    for r in out:
        source, text = texts[r.doc_id]
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", text))
        assert r.taken in (0, r.size, 2 * r.size) and r.taken == r.copies * r.size
        by.setdefault(source, []).append(r)
    want = targets({s: sum(r.size for r in own) for s, own in by.items()})
    for source, own in by.items():
        assert own[0].target == pytest.approx(want[source])
        # The nearest that whole documents allow: half the largest document away at most.
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) / 2 + 1
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in out}


def test_budgets_are_nested(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    taken = [{r.doc_id: r.copies for r in mixing.mix(docs, share=share).collect()} for share in (0.3, 0.8, 1.2)]
    assert all(a[d] <= b[d] for a, b in zip(taken, taken[1:], strict=False) for d in a)


def test_odd_rows(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (2, None, "s"), (3, "", None), (None, "x y", None), (None, "z", "t"), (4, "x\u00a0y\x0bz", "t")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(r.size for r in out) == [0, 0, 1, 2, 2, 3, 3]
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
