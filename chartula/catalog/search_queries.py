"""Vector, keyword, hybrid and rerank queries.

``embeddings`` stands for stored vectors, joined to ``documents`` by id where text is needed;
``benchmark`` passages serve as a query table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chartula.catalog.registry import query
from chartula.functions import text as tx
from chartula.functions import vectors
from chartula.operators import corpus_stats, hybrid, model
from chartula.operators import vector_search as vs
from chartula.plans import retrieve

_D = "CAST({} AS DOUBLE[])"


def cos_sql(a: str, b: str) -> str:
    """Cosine with 0 for zero vectors, rounded as for ranking."""
    a, b = _D.format(a), _D.format(b)
    length = f"sqrt(list_inner_product({a}, {a}) * list_inner_product({b}, {b}))"
    return f"round(CASE WHEN {length} = 0 THEN 0 ELSE list_inner_product({a}, {b}) / {length} END, 9)"


def _vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding", "label")


def _first_vector(t) -> list[float]:
    return [float(x) for x in t.embeddings.filter("vec_id = 0").first()["embedding"]]


_Q0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_HIT = "id, label, round(similarity, 6) AS similarity"


def _shown(hits):
    return hits.select("id", "label", F.round("similarity", 6).alias("similarity"))


@query(
    "vector_topk",
    f"""SELECT vec_id AS id, label, round({cos_sql('embedding', _Q0)}, 6) AS similarity FROM embeddings
        ORDER BY {cos_sql('embedding', _Q0)} DESC, vec_id LIMIT 10""",
)
def vector_topk(t):
    return _shown(vs.top_k(_vectors(t), _first_vector(t), 10))


@query(
    "vector_topk_filtered",
    f"""SELECT vec_id AS id, label, round({cos_sql('embedding', _Q0)}, 6) AS similarity FROM embeddings WHERE label = 3
        ORDER BY {cos_sql('embedding', _Q0)} DESC, vec_id LIMIT 10""",
)
def vector_topk_filtered(t):
    return _shown(vs.top_k(_vectors(t), _first_vector(t), 10, where=F.col("label") == 3))


@query(
    "vector_postfilter",
    f"""SELECT id, label, round(s, 6) AS similarity FROM (
            SELECT vec_id AS id, label, {cos_sql('embedding', _Q0)} AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 40)
        WHERE label = 3""",
)
def vector_postfilter(t):
    return _shown(vs.top_k(_vectors(t), _first_vector(t), 40, where=F.col("label") == 3, prefilter=False))


_ALL_PAIRS = f"""SELECT q.vec_id AS query_id, e.vec_id AS id, {cos_sql('e.embedding', 'q.embedding')} AS s
    FROM embeddings q, embeddings e"""


def _ranked_sql(scored: str, k: int) -> str:
    return f"""SELECT query_id, id, s, CAST(rank AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM ({scored})) WHERE rank <= {k}"""


@query("vector_topk_multi", f"SELECT query_id, id, round(s, 6) AS similarity, rank FROM ({_ranked_sql(_ALL_PAIRS, 10)})")
def vector_topk_multi(t):
    """Every stored vector as a query against all stored vectors."""
    stored = _vectors(t)
    hits = vs.top_k_multi(stored, stored.withColumnRenamed("id", "query_id"), 10)
    return hits.withColumn("similarity", F.round("similarity", 6))


@query("vector_topk_approx")
def vector_topk_approx(t):
    """Coarse-cell search; compared with the exact result by recall in the tests."""
    stored = _vectors(t)
    cells = vs.fit_cells(stored, 8)
    celled = vs.assign_cells(cells, stored)
    queries = stored.select(F.col("id").alias("query_id"), "embedding")
    return vs.top_k_approx(cells, celled, queries, 10, probes=4)


@query(
    "vector_topk_all_cells",
    f"SELECT query_id, id, round(s, 6) AS similarity, rank FROM ({_ranked_sql(_ALL_PAIRS, 10)})",
)
def vector_topk_all_cells(t):
    """Coarse-cell search that looks into every cell gives the exact result."""
    stored = _vectors(t)
    cells = vs.fit_cells(stored, 4)
    queries = stored.select(F.col("id").alias("query_id"), "embedding")
    hits = vs.top_k_approx(cells, vs.assign_cells(cells, stored), queries, 10, probes=4)
    return hits.withColumn("similarity", F.round("similarity", 6))


@query(
    "embedding_dim_check",
    """SELECT count(*) AS total_rows, count(*) FILTER (WHERE embedding IS NULL) AS missing,
              count(*) FILTER (WHERE len(embedding) <> 64) AS mismatched
       FROM (SELECT vec_id, CASE WHEN label = 1 THEN NULL WHEN label = 2 THEN embedding[1:32] ELSE embedding END AS embedding
             FROM embeddings)""",
)
def embedding_dim_check(t):
    damaged = F.when(F.col("label") == 1, F.lit(None)).when(F.col("label") == 2, F.slice("embedding", 1, 32))
    return vs.check_dimensions(t.embeddings.select("vec_id", damaged.otherwise(F.col("embedding")).alias("embedding")), 64)


@query(
    "vector_dim_map",
    """SELECT vec_id, CAST(len(s) AS INTEGER) AS short_size, CAST(len(l) AS INTEGER) AS long_size,
              round(CAST(s[48] AS DOUBLE), 6) AS short_last, round(CAST(l[64] AS DOUBLE), 6) AS long_kept,
              round(CAST(l[96] AS DOUBLE), 6) AS long_last
       FROM (SELECT vec_id, embedding[1:48] AS s, list_concat(embedding, [0.0 FOR i IN range(32)]) AS l FROM embeddings)""",
)
def vector_dim_map(t):
    fitted = t.embeddings.select(
        "vec_id",
        vectors.fit_dimension(F.col("embedding"), 48).alias("s"),
        vectors.fit_dimension(F.col("embedding"), 96).alias("l"),
    )

    def at(column: str, i: int):
        return F.round(F.get(column, F.lit(i - 1)).cast("double"), 6)

    return fitted.select(
        "vec_id",
        F.size("s").alias("short_size"),
        F.size("l").alias("long_size"),
        at("s", 48).alias("short_last"),
        at("l", 64).alias("long_kept"),
        at("l", 96).alias("long_last"),
    )


@query(
    "zero_vector_scan",
    """SELECT vec_id, label FROM embeddings WHERE label IN (0, 4)""",
)
def zero_vector_scan(t):
    """Rows whose vector is missing or all zero (labels 0 and 4 are blanked first)."""
    zeros = F.transform("embedding", lambda x: F.lit(0.0).cast("float"))
    blanked = F.when(F.col("label") == 0, zeros).when(F.col("label") == 4, F.lit(None)).otherwise(F.col("embedding"))
    rows = t.embeddings.withColumn("embedding", blanked)
    return rows.filter(vectors.is_unusable(F.col("embedding"))).select("vec_id", "label")


def _damaged(t):
    """Vectors of which some are all zero (ids divisible by 7) and some missing (divisible by 11)."""
    zeros = F.transform("embedding", lambda x: F.lit(0.0).cast("float"))
    blanked = F.when(F.col("vec_id") % 11 == 0, F.lit(None)).when(F.col("vec_id") % 7 == 0, zeros).otherwise(F.col("embedding"))
    return t.embeddings.withColumn("embedding", blanked)


_DAMAGED = """(SELECT vec_id, label, CASE WHEN vec_id % 7 = 0 THEN list_transform(embedding, lambda x: CAST(0 AS FLOAT)) ELSE embedding END AS embedding
    FROM embeddings WHERE vec_id % 11 <> 0)"""


@query(
    "vector_topk_cells_damaged",
    f"""SELECT query_id, id, round(s, 6) AS similarity, rank FROM ({_ranked_sql(_ALL_PAIRS.replace('FROM embeddings q, embeddings e', f'FROM {_DAMAGED} q, {_DAMAGED} e').replace(cos_sql('e.embedding', 'q.embedding'), f"CASE WHEN e.vec_id % 7 = 0 OR q.vec_id % 7 = 0 THEN 0.0 ELSE {cos_sql('e.embedding', 'q.embedding')} END"), 10)})""",
)
def vector_topk_cells_damaged(t):
    """All cells looked into, with zero and missing vectors in the table: still the exact result."""
    stored = _damaged(t).select(F.col("vec_id").alias("id"), "embedding")
    cells = vs.fit_cells(stored, 4)
    queries = stored.select(F.col("id").alias("query_id"), "embedding")
    hits = vs.top_k_approx(cells, vs.assign_cells(cells, stored), queries, 10, probes=4)
    return hits.withColumn("similarity", F.round("similarity", 6))


@query(
    "embedding_separability_damaged",
    f"""SELECT n.label, n.n, round(m.s, 6) AS mean_similarity FROM
        (SELECT label, count(*) FILTER (WHERE vec_id % 11 <> 0) AS n FROM embeddings GROUP BY label) n LEFT JOIN
        (SELECT a.label, avg(CASE WHEN a.vec_id % 7 = 0 OR b.vec_id % 7 = 0 THEN 0.0 ELSE {cos_sql('a.embedding', 'b.embedding')} END) AS s
         FROM {_DAMAGED} a JOIN {_DAMAGED} b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label) m ON m.label = n.label""",
)
def embedding_separability_damaged(t):
    rows = corpus_stats.separability(_damaged(t), "label")
    return rows.withColumn("mean_similarity", F.round("mean_similarity", 6))


@query(
    "embedding_consistency_damaged",
    f"""WITH f AS (SELECT label, arg_min(embedding, vec_id) AS first, min(vec_id) AS first_id, count(*) AS n FROM {_DAMAGED} GROUP BY label)
        SELECT f.label, max(f.n) AS n, round(avg(CASE WHEN e.vec_id % 7 = 0 OR f.first_id % 7 = 0 THEN 0.0 ELSE {cos_sql('f.first', 'e.embedding')} END), 6) AS mean_similarity
        FROM f JOIN {_DAMAGED} e ON e.label = f.label AND e.vec_id <> f.first_id GROUP BY f.label""",
)
def embedding_consistency_damaged(t):
    rows = corpus_stats.consistency(_damaged(t), "label", "vec_id")
    return rows.withColumn("mean_similarity", F.round("mean_similarity", 6))


@query(
    "embedding_separability",
    f"""SELECT a.label, max(n.n) AS n, round(avg({cos_sql('a.embedding', 'b.embedding')}), 6) AS mean_similarity
        FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id
        JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) n ON n.label = a.label GROUP BY a.label""",
)
def embedding_separability(t):
    rows = corpus_stats.separability(t.embeddings, "label")
    return rows.withColumn("mean_similarity", F.round("mean_similarity", 6))


@query(
    "embedding_consistency",
    f"""WITH f AS (SELECT label, arg_min(embedding, vec_id) AS first, min(vec_id) AS first_id, count(*) AS n
                   FROM embeddings GROUP BY label)
        SELECT f.label, max(f.n) AS n, round(avg({cos_sql('f.first', 'e.embedding')}), 6) AS mean_similarity
        FROM f JOIN embeddings e ON e.label = f.label AND e.vec_id <> f.first_id GROUP BY f.label""",
)
def embedding_consistency(t):
    rows = corpus_stats.consistency(t.embeddings, "label", "vec_id")
    return rows.withColumn("mean_similarity", F.round("mean_similarity", 6))


# --- text and vectors together ---------------------------------------------------------------------

# Source ids: documents in German and Spanish count as wiki pages.
_SOURCE_SQL = "CASE WHEN lang IN ('de', 'es') THEN 'confluence:' || source ELSE source END"
_CHUNKS_SQL = f"""SELECT d.doc_id AS id, d.text AS content, {_SOURCE_SQL} AS source_id, e.embedding
    FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id"""
_QUERIES_SQL = """SELECT b.item_id AS query_id, b.text AS query, e.embedding
    FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id"""
_WORDS_SQL = """SELECT DISTINCT unnest(string_split(text, ' ')) AS query_id FROM benchmark"""


def text_table(t):
    """The chunks without their vectors, which keywords do not need."""
    source = F.when(F.col("lang").isin("de", "es"), F.concat(F.lit(hybrid.WIKI_PREFIX), "source")).otherwise(
        F.col("source")
    )
    return t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), source.alias("source_id"))


def chunk_table(t):
    return text_table(t).join(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), "id", "left")


def query_table(t):
    """Every whole benchmark text; items without a vector ask by their text alone."""
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return asked.join(t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left")


def word_table(t):
    """Every different word of the benchmark texts, down to the empty one."""
    words = t.benchmark.select(F.explode(F.split("text", " ")).alias("query_id")).distinct()
    return words.withColumn("query", F.col("query_id"))


def _keyword_sql(k: int, where: str = "TRUE") -> str:
    return f"""SELECT query_id, id, CAST(rank AS INTEGER) AS rank FROM (
        SELECT q.query_id, c.id, row_number() OVER (PARTITION BY q.query_id ORDER BY c.id) AS rank
        FROM ({_QUERIES_SQL}) q JOIN ({_CHUNKS_SQL}) c ON contains(lower(c.content), lower(q.query)) WHERE {where})
        WHERE rank <= {k}"""


@query(
    "keyword_search",
    f"""SELECT query_id, id, CAST(rank AS INTEGER) AS rank FROM (
        SELECT q.query_id, c.id, row_number() OVER (PARTITION BY q.query_id ORDER BY c.id) AS rank
        FROM ({_WORDS_SQL}) q JOIN ({_CHUNKS_SQL}) c ON contains(lower(c.content), lower(q.query_id))) WHERE rank <= 20""",
)
def keyword_search(t):
    """Every different word of the benchmark as a keyword, most of them short or in many texts."""
    return hybrid.keyword_matches(text_table(t), word_table(t), 20)


@query("keyword_search_whole", _keyword_sql(20))
def keyword_search_whole(t):
    """Every whole benchmark text as a keyword."""
    return hybrid.keyword_matches(text_table(t), query_table(t), 20)


def _vector_sql(k: int, where: str = "TRUE") -> str:
    scored = f"""SELECT q.query_id, c.id, {cos_sql('c.embedding', 'q.embedding')} AS s, c.source_id
        FROM ({_QUERIES_SQL}) q, ({_CHUNKS_SQL}) c WHERE c.embedding IS NOT NULL AND q.embedding IS NOT NULL AND {where}"""
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank
        FROM ({scored})) WHERE rank <= {k}"""


def _hybrid_sql(k: int, vector: str, keyword: str) -> str:
    return f"""SELECT query_id, id, tier, CAST(rank AS INTEGER) AS rank, similarity FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, r, id) AS rank FROM (
            SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.id, k.id) AS id,
                CASE WHEN v.id IS NOT NULL AND k.id IS NOT NULL THEN 1 WHEN v.id IS NOT NULL THEN 2 ELSE 3 END AS tier,
                CASE WHEN v.id IS NOT NULL AND k.id IS NULL THEN v.rank ELSE k.rank END AS r,
                round(CASE WHEN k.id IS NULL THEN v.s WHEN v.id IS NULL THEN 0.5 ELSE least(1.0, 1.2 * v.s) END, 6) AS similarity
            FROM ({vector}) v FULL OUTER JOIN ({keyword}) k ON v.query_id = k.query_id AND v.id = k.id)) WHERE rank <= {k}"""


@query("hybrid_topk", _hybrid_sql(10, _vector_sql(20), _keyword_sql(20)))
def hybrid_topk(t):
    stored, asked = chunk_table(t), query_table(t)
    hits = hybrid.merge_hits(vs.top_k_multi(stored, asked, 20), hybrid.keyword_matches(text_table(t), asked, 20), 10)
    return hits.withColumn("similarity", F.round("similarity", 6))


_WIKI = "starts_with(source_id, 'confluence:')"


@query(
    "source_type_filter",
    f"""SELECT query_id, id, round(s, 6) AS similarity, source_id, CAST(rank AS INTEGER) AS rank FROM (
          SELECT query_id, id, s, source_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank
          FROM (SELECT query_id, id, s, source_id FROM ({_vector_sql(20)}) WHERE {_WIKI})) WHERE rank <= 10""",
)
def source_type_filter(t):
    hits = retrieve.search(chunk_table(t), query_table(t), 10, source_type="wiki", columns=("source_id",))
    return hits.withColumn("similarity", F.round("similarity", 6))


@query(
    "rag_query",
    f"""SELECT h.query_id, h.id, h.tier, h.rank, h.similarity, c.source_id, c.content FROM (
        {_hybrid_sql(5, f"SELECT * FROM ({_vector_sql(10)}) WHERE NOT {_WIKI}", _keyword_sql(10, f"NOT {_WIKI.replace('source_id', 'c.source_id')}"))}) h
        JOIN ({_CHUNKS_SQL}) c ON c.id = h.id""",
)
def rag_query(t):
    """Hybrid retrieval over web sources with the stored rows attached."""
    hits = retrieve.search(
        chunk_table(t), query_table(t), 5, source_type="web", use_hybrid=True, columns=("source_id", "content")
    )
    return hits.withColumn("similarity", F.round("similarity", 6))


@query(
    "rag_query_source",
    f"""SELECT query_id, id, round(s, 6) AS similarity, CAST(rank AS INTEGER) AS rank, source_id
        FROM ({_vector_sql(5, "c.source_id = 'src3'")})""",
)
def rag_query_source(t):
    hits = retrieve.search(chunk_table(t), query_table(t), 5, source="src3", columns=("source_id",))
    return hits.withColumn("similarity", F.round("similarity", 6))


# A stand-in for an embedding model that SQL can follow: how often a text has each of some letters.
LETTERS = "etaoinsrhldcumfp"


def letter_vectors(texts: list[str]) -> list[list[int]]:
    return [[text.count(letter) for letter in LETTERS] for text in texts]


def _letters_sql(text: str) -> str:
    return "[" + ", ".join(f"length({text}) - length(replace({text}, '{c}', ''))" for c in LETTERS) + "]"


_EXAMPLES_SQL = f"""SELECT *, {_letters_sql("(content || chr(10) || chr(10) || 'Summary: ' || summary)")} AS embedding FROM (
    SELECT conv_id * 1000 + turn AS id, text AS content, role || ' says ' || left(text, 60) AS summary, role AS source_id FROM conversations)"""
_CODE_QUERIES_SQL = f"""SELECT *, {_letters_sql("('Code example for ' || query || chr(10) || chr(10) || 'Summary: Example code showing ' || query)")} AS embedding
    FROM (SELECT item_id AS query_id, text AS query FROM benchmark)"""


def example_table(t):
    rows = t.conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.col("text").alias("content"),
        F.concat("role", F.lit(" says "), F.left("text", F.lit(60))).alias("summary"),
        F.col("role").alias("source_id"),
    ).withColumn("embed_text", tx.code_embed_text(F.col("content"), F.col("summary")))
    return model.embed_texts(rows, letter_vectors, len(LETTERS), text_col="embed_text").drop("embed_text")


_EXAMPLE_VECTOR = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM (
    SELECT q.query_id, c.id, {cos_sql('c.embedding', 'q.embedding')} AS s
    FROM ({_CODE_QUERIES_SQL}) q, ({_EXAMPLES_SQL}) c WHERE c.source_id = 'assistant')) WHERE rank <= 10"""
_EXAMPLE_KEYWORD = f"""SELECT query_id, id, rank FROM (
    SELECT q.query_id, c.id, row_number() OVER (PARTITION BY q.query_id ORDER BY c.id) AS rank
    FROM ({_CODE_QUERIES_SQL}) q JOIN ({_EXAMPLES_SQL}) c
    ON contains(lower(c.content), lower(q.query)) OR contains(lower(c.summary), lower(q.query)) WHERE c.source_id = 'assistant') WHERE rank <= 10"""


@query(
    "code_search",
    f"""SELECT h.*, c.summary FROM ({_hybrid_sql(5, _EXAMPLE_VECTOR, _EXAMPLE_KEYWORD)}) h
        JOIN ({_EXAMPLES_SQL}) c ON c.id = h.id""",
)
def code_search(t):
    """Code-example retrieval as one call: queries embedded as descriptions, keywords in the text or its summary."""
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = retrieve.search_code(example_table(t), asked, letter_vectors, len(LETTERS), 5, source_id="assistant", use_hybrid=True, columns=("summary",))
    return hits.withColumn("similarity", F.round("similarity", 6))


def _reranked_sql(hits: str) -> str:
    """``hits(query_id, id, rank)`` reordered by the letters of the whole query and the whole text."""
    return f"""SELECT query_id, id, CAST(o AS INTEGER) AS original_rank, round(score, 6) AS rerank_score,
        CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o) AS INTEGER) AS rank FROM (
            SELECT h.query_id, h.id, h.rank - 1 AS o, {cos_sql(_letters_sql("c.content"), _letters_sql("q.query"))} AS score
            FROM ({hits}) h JOIN ({_CHUNKS_SQL}) c ON c.id = h.id JOIN ({_QUERIES_SQL}) q ON q.query_id = h.query_id)"""


def by_letters(results, queries):
    return retrieve.rerank_by_similarity(results, queries, letter_vectors, len(LETTERS))


_RERANKED = ["query_id", "id", "original_rank", "rerank_score", "rank"]


@query("rerank_by_similarity", _reranked_sql(_vector_sql(10)))
def rerank_by_similarity(t):
    """Top ten per query reordered by another embedding of the whole texts."""
    hits = retrieve.search(chunk_table(t), query_table(t), 10, columns=("content",))
    return by_letters(hits, query_table(t)).withColumn("rerank_score", F.round("rerank_score", 6)).select(*_RERANKED)


@query(
    "rag_query_reranked",
    _reranked_sql(_hybrid_sql(5, f"SELECT * FROM ({_vector_sql(10)}) WHERE NOT {_WIKI}", _keyword_sql(10, f"NOT {_WIKI.replace('source_id', 'c.source_id')}"))),
)
def rag_query_reranked(t):
    """Hybrid retrieval over web sources, reranked inside the call."""
    hits = retrieve.search(chunk_table(t), query_table(t), 5, source_type="web", use_hybrid=True, rerank=by_letters, columns=("content",))
    return hits.withColumn("rerank_score", F.round("rerank_score", 6)).select(*_RERANKED)


@query(
    "rerank_guard",
    f"""WITH hits AS ({_keyword_sql(60)}), n AS (SELECT query_id, count(*) AS n FROM hits GROUP BY query_id)
        SELECT query_id FROM n WHERE n <= 50""",
)
def rerank_guard(t):
    """Queries whose keyword results are few enough to be reranked."""
    stored, asked = chunk_table(t), query_table(t)
    hits = hybrid.keyword_matches(text_table(t), asked, 60)
    results = hits.join(stored.select("id", "content"), "id")
    return hybrid.rerank_eligible(results, asked, max_results=50)


@query(
    "rerank_by_pairs",
    f"""WITH h AS (SELECT k.query_id, k.id, k.rank - 1 AS o, round(CAST(length(q.query) AS DOUBLE) / length(c.content), 9) AS s
          FROM ({_keyword_sql(10)}) k JOIN ({_CHUNKS_SQL}) c ON c.id = k.id JOIN ({_QUERIES_SQL}) q ON q.query_id = k.query_id)
        SELECT query_id, id, CAST(o AS INTEGER) AS original_rank, round(s, 6) AS rerank_score,
          CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, o) AS INTEGER) AS rank FROM h""",
)
def rerank_by_pairs(t):
    """Keyword results reordered by a pair scorer (share of the text the query makes up)."""
    stored, asked = chunk_table(t), query_table(t)
    results = hybrid.keyword_matches(text_table(t), asked, 10).join(stored.select("id", "content"), "id")
    ranked = retrieve.rerank_by_pairs(
        results, asked, lambda pairs: [round(len(q) / len(text), 9) for q, text in pairs]
    )
    return ranked.select("query_id", "id", "original_rank", F.round("rerank_score", 6).alias("rerank_score"), "rank")


_FAILING = "ch "


@query(
    "rerank_failing_batches",
    f"""WITH h AS (SELECT k.query_id, k.id, k.rank - 1 AS o, CASE WHEN contains(c.content, '{_FAILING}') THEN 0 ELSE round(CAST(length(q.query_id) AS DOUBLE) / length(c.content), 9) END AS s
          FROM (SELECT query_id, id, rank FROM (SELECT q.query_id, c.id, row_number() OVER (PARTITION BY q.query_id ORDER BY c.id) AS rank
                FROM ({_WORDS_SQL}) q JOIN ({_CHUNKS_SQL}) c ON contains(lower(c.content), lower(q.query_id)) WHERE q.query_id <> '') WHERE rank <= 10) k
          JOIN ({_CHUNKS_SQL}) c ON c.id = k.id JOIN ({_WORDS_SQL}) q ON q.query_id = k.query_id)
        SELECT query_id, id, CAST(o AS INTEGER) AS original_rank, round(s, 6) AS rerank_score,
          CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, o) AS INTEGER) AS rank FROM h""",
)
def rerank_failing_batches(t):
    """A pair scorer that fails on some texts, in batches of one: these score zero, and the others as they should."""
    stored, asked = chunk_table(t), word_table(t).filter("query <> ''")

    def score(pairs):
        if any(_FAILING in text for _, text in pairs):
            raise ValueError("the model cannot read this")
        return [round(len(q) / len(text), 9) for q, text in pairs]

    results = hybrid.keyword_matches(text_table(t), asked, 10).join(stored.select("id", "content"), "id")
    ranked = retrieve.rerank_by_pairs(results, asked, score, batch_size=1)
    return ranked.select("query_id", "id", "original_rank", F.round("rerank_score", 6).alias("rerank_score"), "rank")


@query(
    "model_embedding",
    """SELECT doc_id, round(CAST(CASE WHEN trim(text) = '' THEN 0 ELSE length(text) END AS DOUBLE), 6) AS first_value,
              CAST(4 AS INTEGER) AS dim FROM documents""",
)
def model_embedding(t):
    """Batch inference with a stand-in model: the first component is the text length."""
    rows = t.documents.select("doc_id", F.col("text").alias("content"))
    embedded = model.embed_texts(rows, lambda texts: [[len(x), 1, 2, 3] for x in texts], 4, batch_size=256)
    return embedded.select(
        "doc_id", F.get("embedding", F.lit(0)).cast("double").alias("first_value"), F.size("embedding").alias("dim")
    )


@query(
    "hash_embedding",
    """SELECT doc_id, CAST(64 AS INTEGER) AS dim, CAST(1.0 AS DOUBLE) AS length FROM documents WHERE trim(text) <> ''""",
)
def hash_embedding(t):
    """Hashed bag-of-words vectors over whole documents: dimension and unit length."""
    rows = model.hash_embed(t.documents.select("doc_id", F.col("text").alias("content")), 64)
    return rows.filter(~vectors.is_unusable(F.col("embedding"))).select(
        "doc_id", F.size("embedding").alias("dim"), F.round(vectors.norm(F.col("embedding")), 5).alias("length")
    )


@query("hash_embedding_search")
def hash_embedding_search(t):
    """Benchmark passages as queries over hashed document vectors."""
    docs = model.hash_embed(t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content")), 64)
    asked = model.hash_embed(
        t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("content")), 64
    )
    return vs.top_k_multi(docs, asked, 5)
