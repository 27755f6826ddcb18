import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartula.functions import vectors
from chartula.operators import corpus_stats, hybrid, model
from chartula.operators import vector_search as vs
from chartula.plans import retrieve


def vector_frame(spark, matrix, name="id"):
    return spark.createDataFrame(
        [(i, [float(x) for x in row]) for i, row in enumerate(matrix)], f"{name} long, embedding array<float>"
    )


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    stored = rng.normal(size=(300, 16)).astype(np.float32)
    stored[17] = 0
    stored[40:60] = stored[20:40]
    asked = np.vstack([stored[:5], rng.normal(size=(20, 16)).astype(np.float32), np.zeros((1, 16), np.float32)])
    return stored, asked


def brute(stored, asked, k):
    def unit(m):
        m = m.astype(np.float64)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    scores = np.round(unit(asked) @ unit(stored).T, 9)
    return {q: [int(i) for i in np.lexsort((np.arange(len(stored)), -scores[q]))[:k]] for q in range(len(asked))}


def ids(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
    return out


def test_multi_matches_brute_force_at_any_partitioning(spark, data):
    stored, asked = data
    frame, queries = vector_frame(spark, stored), vector_frame(spark, asked, "query_id")
    want = brute(stored, asked, 7)
    for parts in (1, 8):
        assert ids(vs.top_k_multi(frame.repartition(parts), queries, 7)) == want


def test_multi_in_query_groups(spark, data):
    stored, asked = data
    frame, queries = vector_frame(spark, stored), vector_frame(spark, asked, "query_id")
    assert ids(vs.top_k_multi(frame, queries, 3, block_bytes=2 * 8 * 16 * 9)) == brute(stored, asked, 3)


def test_multi_in_a_grid_of_64_blocks(spark, data):
    """Many blocks of queries are rows of one plan: one scan of the chunks, no job and no broadcast for a block."""
    stored, _ = data
    frame, queries = vector_frame(spark, stored), vector_frame(spark, stored, "query_id")
    missing = spark.createDataFrame([(901, None)], "query_id long, embedding array<float>")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("grid", "grid")
    hits = vs.top_k_multi(frame.repartition(5), queries.unionByName(missing), 4, block_bytes=-(-300 * 8 * 16 // 64))
    jobs = len(tracker.getJobIdsForGroup("grid"))
    spark.sparkContext.setJobGroup("rest", "rest")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert ids(hits) == brute(stored, stored, 4)
    assert jobs <= 3 and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    assert plan.count("MapInArrow") == 1


def test_multi_in_small_tiles(spark, data, monkeypatch):
    stored, asked = data
    frame, queries = vector_frame(spark, stored).coalesce(1), vector_frame(spark, asked, "query_id")
    monkeypatch.setattr(vs, "SCORE_TILE", 700)
    assert ids(vs.top_k_multi(frame, queries, 3)) == brute(stored, asked, 3)


def test_single_equals_multi_and_is_a_bounded_sort(spark, data):
    stored, asked = data
    frame = vector_frame(spark, stored)
    one = vs.top_k(frame, [float(x) for x in asked[6]], 9)
    assert [r.id for r in one.collect()] == brute(stored, asked, 9)[6]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan and "Arrow" not in plan


def test_wrong_dimension_fails(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<float>")
    with pytest.raises(Exception, match="dimension mismatch"):
        vs.top_k(frame, [1.0, 2.0, 3.0]).collect()
    queries = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "query_id long, embedding array<float>")
    with pytest.raises(Exception, match="dimensions"):
        vs.top_k_multi(frame, queries).collect()


def test_approximate_search_recall(spark, data):
    stored, asked = data
    frame, queries = vector_frame(spark, stored), vector_frame(spark, asked[:25], "query_id")
    cells = vs.fit_cells(frame, 4)
    celled = vs.assign_cells(cells, frame)
    exact = brute(stored, asked[:25], 5)
    part = ids(vs.top_k_approx(cells, celled, queries, 5, probes=3))
    hits = sum(len(set(part[q]) & set(exact[q])) for q in exact)
    assert hits / (5 * 25) > 0.8
    every = ids(vs.top_k_approx(cells, celled, queries, 5, probes=4))
    assert all(set(every[q]) == set(exact[q]) for q in exact)


def unit_rows(kind, n, dim, rng):
    """Unit or zero vectors: plain ones, with many equal, with many equal similarities, or almost equal."""
    rows = rng.normal(size=(n, dim))
    if kind == "equal":
        rows[rng.random(n) < 0.5] = rows[0]
        rows[rng.random(n) < 0.1] = 0
    elif kind == "ties":
        rows = np.where(rng.random((n, dim)) < 0.05, np.rint(rows), 0.0)
    elif kind == "near":
        rows = rows[:1] + 1e-7 * rows
    return vs._unit(rows.astype(np.float32).astype(np.float64))


@pytest.mark.parametrize("kind", ["plain", "equal", "ties", "near"])
@pytest.mark.parametrize("k", [1, 10, 300])
def test_best_pairs_of_a_block(kind, k):
    rng = np.random.default_rng(k)
    stored, asked = unit_rows(kind, 2100, 24, rng), unit_rows(kind, 530, 24, rng)
    asked[::9], asked[1::9] = stored[: len(asked[::9])], 0
    which, at, scores = vs._best_pairs(asked, stored, k)
    exact = np.round(asked @ stored.T, vectors.RANK_PLACES)
    order = np.lexsort((at, -scores, which))
    assert np.array_equal(which[order], np.repeat(np.arange(530), k))
    want = np.argsort(-exact, axis=1, kind="stable")[:, :k]
    assert np.array_equal(at[order].reshape(530, k), want)
    assert np.array_equal(scores[order].reshape(530, k), np.take_along_axis(exact, want, axis=1))


def test_few_pairs_of_a_block_are_multiplied_exactly(monkeypatch):
    rng, pairs = np.random.default_rng(1), []
    exactly = vs._products
    monkeypatch.setattr(vs, "_products", lambda *a: pairs.append(len(a[2])) or exactly(*a))
    vs._best_pairs(unit_rows("plain", 600, 64, rng), unit_rows("plain", 8000, 64, rng), 10)
    assert 0 < sum(pairs) < 600 * 8000 // 50
    # Of equal vectors the first k count, however many there are.
    assert vs._first_of_equal(np.tile(unit_rows("plain", 2, 8, rng), (20_000, 1)), 3).tolist() == [0, 1, 2, 3, 4, 5]


def cell_frames(spark):
    """Vectors of which a third is zero or missing, and some ids and vectors occur twice."""
    rng = np.random.default_rng(9)
    matrix = rng.normal(size=(240, 8)).astype(np.float32)
    matrix[::4], matrix[100:120] = 0, matrix[101]
    rows = [(i % 230, None if i % 12 == 1 else [float(x) for x in v]) for i, v in enumerate(matrix)]
    frame = spark.createDataFrame(rows, "id long, embedding array<float>")
    return rows, frame, frame.withColumnRenamed("id", "query_id")


def test_all_cells_in_small_parts_are_exact(spark, monkeypatch):
    for name, most in (("CELL_ROWS", 30), ("CELL_QUERIES", 20)):
        monkeypatch.setattr(vs, name, most)
    rows, frame, queries = cell_frames(spark)
    cells = vs.fit_cells(frame, 3)
    hits = vs.top_k_approx(cells, vs.assign_cells(cells, frame), queries, 6, probes=3)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.similarity))
    used = [(i, np.array(v, float)) for i, v in rows if v is not None]
    unit = vs._unit(np.stack([v for _, v in used]))
    exact, want = np.round(unit @ unit.T, vectors.RANK_PLACES) + 0.0, {}
    for at, (q, _) in enumerate(used):
        want.setdefault(q, []).extend((i, exact[at, n]) for n, (i, _) in enumerate(used))
    assert {q: [(i, s + 0.0) for i, s in x] for q, x in got.items()} == {q: sorted(x, key=lambda p: (-p[1], p[0]))[:6] for q, x in want.items()}


def test_rows_without_direction_are_not_sent_to_every_query(spark):
    rows, frame, _ = cell_frames(spark)
    cells = vs.fit_cells(frame, 3)
    celled = vs.assign_cells(cells, frame).filter("embedding IS NOT NULL").select(F.col("id").alias("_id"), F.col("embedding").alias("_vector"), "cell")
    left = vs._without_loose_ties(celled, 8, 6)
    zero = sorted(i for i, v in rows if v is not None and not any(v))
    assert len(zero) > 30
    assert sorted(r["_id"] for r in left.filter(F.col("cell") == vs.LOOSE_CELL).collect()) == zero[:6]
    assert left.filter(F.col("cell") != vs.LOOSE_CELL).count() == sum(v is not None and any(v) for _, v in rows)


def test_a_zero_vector_of_another_dimension_fails(spark):
    _, frame, queries = cell_frames(spark)
    cells = vs.fit_cells(frame, 3)
    odd = spark.createDataFrame([(900, [0.0, 0.0])], frame.schema)
    with pytest.raises(Exception, match="dimension"):
        vs.top_k_approx(cells, vs.assign_cells(cells, frame.unionByName(odd)), queries, 6, probes=3).collect()


def test_no_query_with_a_vector_has_no_hits(spark):
    _, frame, queries = cell_frames(spark)
    cells = vs.fit_cells(frame, 3)
    assert vs.top_k_approx(cells, vs.assign_cells(cells, frame), queries.filter("embedding IS NULL"), 6, probes=3).count() == 0


def test_parts_of_a_cell_are_smaller_with_many_dimensions():
    assert vs.cell_limits(64) == (vs.CELL_ROWS, vs.CELL_QUERIES)
    assert vs.cell_limits(8) == (vs.CELL_ROWS, vs.CELL_QUERIES)
    assert vs.cell_limits(256) == (16_384, 8_192)
    assert vs.cell_limits(100_000) == (vs.LEAST_CELL_ROWS, vs.LEAST_CELL_QUERIES)


def test_closed_form_means(spark, data):
    stored, _ = data
    frame = vector_frame(spark, stored).withColumn("label", F.col("id") % 3)
    got = {r.label: r.mean_similarity for r in corpus_stats.separability(frame, "label").collect()}
    first = {r.label: r.mean_similarity for r in corpus_stats.consistency(frame, "label", "id").collect()}
    norms = np.linalg.norm(stored.astype(float), axis=1, keepdims=True)
    unit = np.divide(stored.astype(float), norms, out=np.zeros(stored.shape), where=norms > 0)
    for label in range(3):
        u = unit[label::3]
        s = u @ u.T
        assert got[label] == pytest.approx(s[np.triu_indices(len(u), 1)].mean(), abs=1e-9)
        assert first[label] == pytest.approx(s[0, 1:].mean(), abs=1e-9)


def expected_merge(vec, kw, k):
    """The merge rule, stated plainly over ranked lists of (id, similarity) and ids."""
    scores = dict(vec)
    out = [(i, min(1.0, scores[i] * 1.2)) for i in kw if i in scores]
    out += [(i, s) for i, s in vec if i not in kw]
    out += [(i, 0.5) for i in kw if i not in scores]
    return out[:k]


def test_merge_follows_the_rule(spark):
    rnd = random.Random(2)
    vec_rows, kw_rows, want = [], [], {}
    for q in range(30):
        pool = rnd.sample(range(50), 20)
        vec = [(i, round(0.99 - 0.05 * n, 3)) for n, i in enumerate(pool[: rnd.randint(0, 10)])]
        kw = sorted(rnd.sample(pool, rnd.randint(0, 10)))
        vec_rows += [(q, i, s, n + 1) for n, (i, s) in enumerate(vec)]
        kw_rows += [(q, i, n + 1) for n, i in enumerate(kw)]
        want[q] = expected_merge(vec, kw, 5)
    v = spark.createDataFrame(vec_rows, "query_id int, id long, similarity double, rank int")
    w = spark.createDataFrame(kw_rows, "query_id int, id long, rank int")
    got = {q: [] for q in want}
    for r in hybrid.merge_hits(v, w, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.id, pytest.approx(r.similarity)))
    assert got == want


def test_keyword_joins_agree(spark):
    rnd = random.Random(8)
    docs = [(i, "".join(rnd.choice("abAB%_ ") for _ in range(30)), rnd.choice(["ab", None, "zz"])) for i in range(200)]
    frame = spark.createDataFrame(docs, "id long, content string, summary string").repartition(6)
    words = ["a", "AB", "b%", "_", "", "zz", "ab", "absent", "ba b", None, "A%A"]
    queries = spark.createDataFrame(list(enumerate(words)), "query_id long, query string")
    want = set()
    for q, w in enumerate(words):
        if w is not None:
            found = [i for i, c, s in docs if w.lower() in c.lower() or w.lower() in (s or "").lower()][:6]
            want |= {(q, i, n + 1) for n, i in enumerate(found)}
    for bound in (0, 1000):
        hits = hybrid.keyword_matches(frame, queries, 6, columns=("content", "summary"), broadcast_postings=bound)
        assert {(r.query_id, r.id, r["rank"]) for r in hits.collect()} == want


def test_source_type(spark):
    frame = spark.createDataFrame([("confluence:K",), ("example.com",), (None,)], "s string")
    counts = [frame.filter(hybrid.source_type_is(F.col("s"), t)).count() for t in ("wiki", "web", None)]
    assert counts == [1, 2, 3]


def test_rerank_falls_back_to_original_order(spark):
    results = spark.createDataFrame(
        [("q1", i, f"text {i}", i + 1) for i in range(3)]
        + [("q2", i, None if i == 1 else "t", i + 1) for i in range(3)]
        + [("q3", i, "t", i + 1) for i in range(60)],
        "query_id string, id int, content string, rank int",
    )
    queries = spark.createDataFrame([("q1", "x"), ("q2", "x"), ("q3", "x"), ("q4", " ")], "query_id string, query string")
    scored = retrieve.rerank_by_pairs(results, queries, lambda pairs: [float(t[-1] == "2") for _, t in pairs])
    got = {}
    for r in scored.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.original_rank))
    assert got["q1"] == [(2, 2), (0, 0), (1, 1)]
    assert got["q2"] == [(i, i) for i in range(3)]
    assert got["q3"] == [(i, i) for i in range(60)]


def test_embedding_contract(spark):
    def flaky(texts):
        if any(t == "bad" for t in texts):
            raise RuntimeError("refused")
        return [[len(t), 1.0] for t in texts]

    frame = spark.createDataFrame([(1, "good"), (2, "bad"), (3, " "), (4, None), (5, "long text")], "id int, content string").coalesce(1)
    got = {r.id: r.embedding for r in model.embed_texts(frame, flaky, 2, delay=0, max_chars=4).collect()}
    assert got == {1: [4, 1], 2: [0, 0], 3: [0, 0], 4: [0, 0], 5: [4, 1]}


def test_generation_contracts(spark):
    blocks = spark.createDataFrame([("b", "code", "a"), ("b", "boom", "a")], "context_before string, code string, context_after string")

    def complete(prompts):
        if any("boom" in p for p in prompts):
            raise RuntimeError
        return [" fine " for _ in prompts]

    got = {r.code: r.summary for r in model.summarise_code(blocks.coalesce(1), complete).collect()}
    assert got == {"code": "fine", "boom": model.DEFAULT_CODE_SUMMARY}
    texts = spark.createDataFrame([("s1", "text"), ("s2", ""), ("s3", "boom")], "source_id string, text string")
    got = {r.source_id: r.summary for r in model.summarise_sources(texts, complete).collect()}
    assert got == {"s1": "fine", "s2": "Content from s2", "s3": "Content from s3"}
    chunks = spark.createDataFrame([("u", "one"), ("v", "boom")], "url string, content string")
    documents = spark.createDataFrame([("u", "whole"), ("v", "whole")], "url string, markdown string")
    got = {r.content: (r.embed_text, r.contextual_embedding) for r in model.contextualise(chunks, documents, complete).collect()}
    assert got == {"one": ("fine\n---\none", True), "boom": ("boom", False)}


def test_hashed_vectors(spark):
    import xxhash

    texts = ["The the cat", "", "dog é cat cat"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    got = {r.id: r.embedding for r in model.hash_embed(frame, 8).collect()}
    for i, text in enumerate(texts):
        want = np.zeros(8)
        for word in text.lower().split():
            h = np.uint64(xxhash.xxh64(word.encode(), seed=42).intdigest()).astype(np.int64)
            want[int(h) % 8] += 1
        length = np.linalg.norm(want)
        assert got[i] == pytest.approx(list(want / length if length else want), abs=1e-6)


def test_dimension_fitting(spark):
    frame = spark.createDataFrame([([1.0, 2.0, 3.0],)], "e array<float>")
    row = frame.select(vectors.fit_dimension(F.col("e"), 2).alias("a"), vectors.fit_dimension(F.col("e"), 5).alias("b")).first()
    assert (row.a, row.b) == ([1, 2], [1, 2, 3, 0, 0])


def test_wrong_vector_length_fails(spark):
    texts = spark.createDataFrame([("a",)], "content string")
    with pytest.raises(Exception, match="3 components instead of 4"):
        model.embed_texts(texts, lambda batch: [[1.0] * 3 for _ in batch], 4, tries=1).collect()


def test_failed_score_batch_is_zero(spark):
    def score(pairs):
        if any(text == "bad" for _, text in pairs):
            raise RuntimeError
        return [1.0] * len(pairs)

    pairs = spark.createDataFrame([("q", "good", 0), ("q", "bad", 0)], "query string, content string, n int").coalesce(1)
    assert [r.rerank_score for r in model.score_pairs(pairs, score).collect()] == [0.0, 0.0]
    assert [r.rerank_score for r in model.score_pairs(pairs.filter("content = 'good'"), score).collect()] == [1.0]


def keyword_brute(texts, asked, limit):
    out = {}
    for number, keyword in asked:
        if keyword is not None:
            found = sorted(i for i, columns in texts if any(keyword.lower() in (c or "").lower() for c in columns))[:limit]
            if found:
                out[number] = found
    return out


@pytest.mark.parametrize("bound", [0, 100_000])
def test_keywords_by_words_and_grams(spark, bound):
    """Short, long, odd and repeated keywords with and without a broadcast."""
    draw = random.Random(11)
    alphabet = "ab cd.\n(é字\U0001f600)[x]%_\\"
    texts = [(n, ["".join(draw.choice(alphabet) for _ in range(draw.randrange(0, 120))), draw.choice([None, "Ab C", "summary of " + "ab" * 40])]) for n in range(150)]
    cuts = [(t, draw.randrange(len(t)), draw.randrange(1, 60)) for _, (t, _) in texts for _ in range(2) if t]
    asked = list(enumerate(["", None, "a", "AB", "abab", "ababab", "summary of ab", "no such words at all", "zzzzzzz", ".", " ", "  ", "   ", " ab", "b ", "a b", " a ", "a  b"] + [t[i : i + n] for t, i, n in cuts] + ["abab", "ab"]))
    frame = spark.createDataFrame([(i, *c) for i, c in texts], "id long, content string, summary string")
    queries = spark.createDataFrame(asked, "query_id long, query string")
    hits = hybrid.keyword_matches(frame, queries, 5, columns=("content", "summary"), broadcast_postings=bound)
    assert ids(hits) == keyword_brute(texts, asked, 5)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_code_search_embeds_queries_as_descriptions(spark):
    examples = spark.createDataFrame([(1, "one", "s", "x", [1.0, 0.0]), (2, "two", "s", "x", [0.0, 1.0]), (3, "two", "s", "y", [0.0, 1.0])], "id long, content string, summary string, source_id string, embedding array<float>")
    queries = spark.createDataFrame([(7, "two")], "query_id long, query string")

    def embed(texts):
        return [[0.0, 1.0] if t == "Code example for two\n\nSummary: Example code showing two" else [1.0, 0.0] for t in texts]

    hits = retrieve.search_code(examples, queries, embed, 2, 2, source_id="x", columns=("content",)).orderBy("rank").collect()
    assert [(r.query_id, r.id, r.similarity) for r in hits] == [(7, 2, 1.0), (7, 1, 0.0)]


def test_rerank_inside_the_search(spark):
    chunks = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [0.9, 0.1]), (3, "c", [0.0, 1.0])], "id long, content string, embedding array<float>")
    queries = spark.createDataFrame([(1, "q", [1.0, 0.0]), (2, " ", [1.0, 0.0]), (3, "q", None)], "query_id long, query string, embedding array<float>")

    def embed(texts):
        return [[1.0, 0.0] if t in ("q", "b") else [0.0, 1.0] for t in texts]

    hits = retrieve.search(chunks, queries, 2, rerank=lambda r, q: retrieve.rerank_by_similarity(r, q, embed, 2), columns=("content",))
    assert ids(hits) == {1: [2, 1], 2: [1, 2]}


def test_frequent_words_give_their_first_texts_only(spark, monkeypatch):
    """No pair of a text and a keyword is ranked that comes after the first ones; null ids come first, long words are no matter."""
    from chartula.operators import keywords

    texts = [(n, f"Ab w{n % 7} xaby") for n in range(3000)] + [(None, "late cd"), (3001, "cd" * 2000)]
    frame = spark.createDataFrame(texts, "id long, content string").repartition(5)
    asked = spark.createDataFrame([("a",), ("ab",), ("w3",), ("cd",), ("cdcdc",), ("late",)], "query_id string").withColumn("query", F.col("query_id"))
    ranked, plain = [], keywords.top_per_group
    monkeypatch.setattr(keywords, "top_per_group", lambda rows, *args, **more: ranked.append(rows.count()) or plain(rows, *args, **more))
    hits = keywords.keyword_matches(frame, asked, 3)
    first = {"a": [None, 0, 1], "ab": [0, 1, 2], "w3": [3, 10, 17], "cd": [None, 3001], "cdcdc": [3001], "late": [None]}
    assert {(r.query_id, r.id, r["rank"]) for r in hits.collect()} == {(q, i, n + 1) for q, found in first.items() for n, i in enumerate(found)}
    assert ranked[0] <= 6 * 3 * keywords.SALTS


def test_grid_is_shaped_for_its_shuffle():
    """Copies of chunks and of queries stay in balance: with more vectors a row travels no more often, up to the block's size."""
    block = vs.GRID_BLOCKS * vs.QUERY_BLOCK_BYTES
    few, many = (vs.grid_columns(n * 512, block, 200) for n in (40_000, 1_200_000))
    assert few == many == 22
    assert vs.grid_columns(10 * 22 * block, block, 200) == 220


def test_score_tiles_are_small():
    assert vs.SCORE_TILE * 8 <= 8_000_000


def test_model_sees_its_columns_only_and_the_rest_goes_through(spark):
    from pyspark.sql import types as T

    rows = spark.range(700).select("id", F.create_map(F.lit("k"), F.col("id")).alias("other"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("text"))

    def fn(part):
        assert list(part.columns) == ["text"] and len(part) <= 7
        return part["text"].map(lambda t: None if t is None else t + "!")

    answered = model.apply_model(rows.coalesce(1), fn, ["text"], "said", T.StringType(), batch_size=7)
    assert "MapInPandas" not in answered._jdf.queryExecution().executedPlan().toString()
    found = answered.collect()
    assert [(r.id, r.other["k"], r.said) for r in found] == [(i, i, f"{i}!" if i % 3 else None) for i in range(700)]
