"""The operators as queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartula.llm import alignment, byte_bpe, conversation_repair, exact_topk, html_text, language, mixing, neighbours, packing, simhash, suffix_dedup, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The rules of the URL query: verdict, host, path.
URL_RULES = (
    url_filter.Rule("block", "net", "/"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
)


def query(name: str, table: str, sql: str | None = None):
    """Register ``fn(table)`` under ``name``."""

    def register(fn: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[name] = lambda spark, folder: fn(spark.read.parquet(f"{folder}/{table}.parquet"))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query(
    "op4_nearest_neighbours",
    "embeddings",
    """
    WITH v AS (
      SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), s AS (
      SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
    )
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
    """,
)
def op4(embeddings: DataFrame) -> DataFrame:
    return neighbours.nearest(embeddings, every=20, k=20)


@query(
    "op5_exact_topk",
    "embeddings",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
      SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
    )
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
    """,
)
def op5(embeddings: DataFrame) -> DataFrame:
    return exact_topk.exact_top_k(embeddings, every=50, k=5)


@query(
    "op6_warc",
    "pages",
    """
    WITH p AS (
      SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
    ), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
    SELECT page_id, payload_bytes, payload_digest,
      CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
    FROM f
    """,
)
def op6(pages: DataFrame) -> DataFrame:
    return warc.archived(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    "op7_url_filter",
    "pages",
    r"""
    WITH r AS (
      SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
    ), p AS (
      SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path
      FROM r
    ), m AS (
      SELECT *, CASE
        WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/'
      END AS rule FROM p
    )
    SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM m
    """,
)
def op7(pages: DataFrame) -> DataFrame:
    return url_filter.judge_urls(pages, URL_RULES)


@query("op8_mixing", "documents")
def op8(documents: DataFrame) -> DataFrame:
    return mixing.mix(documents)


@query("op9_packing", "documents")
def op9(documents: DataFrame) -> DataFrame:
    return packing.pack(documents)


@query("op3_language", "documents")
def op3(documents: DataFrame) -> DataFrame:
    return language.identify(documents)


@query("op10_simhash", "documents")
def op10(documents: DataFrame) -> DataFrame:
    found = simhash.near_duplicates(documents)
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query("op1_suffix_dedup", "documents")
def op1(documents: DataFrame) -> DataFrame:
    found = suffix_dedup.remove_repeats(documents)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_html_text", "pages")
def op2(pages: DataFrame) -> DataFrame:
    return html_text.main_text(pages)


@query("op11_byte_bpe", "documents")
def op11(documents: DataFrame) -> DataFrame:
    found = byte_bpe.decode(byte_bpe.encode(documents, digests=True))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op12_conversation_repair", "conversations")
def op12(conversations: DataFrame) -> DataFrame:
    turns = conversation_repair.damaged(conversations)
    return conversation_repair.repaired_digests(turns, conversation_repair.audits(turns))


@query("op13_alignment", "documents")
def op13(documents: DataFrame) -> DataFrame:
    aligned = alignment.align(documents)
    found = alignment.scored(aligned, alignment.pair_counts(aligned))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
