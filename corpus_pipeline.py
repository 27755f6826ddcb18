"""The corpus pipeline: documents to packed training sequences, stage by stage.

Each stage takes the documents that the stage before kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartula.llm import language, mixing, near_copies, packing, simhash, suffix_dedup
from chartula.llm.common import stored


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by a sufficient margin; rejected ones go."""
    found = language.predicted(F.col("text"), language.learn(docs))
    return docs.select(F.struct("*").alias("row"), found.alias("found")).filter(~F.col("found.rejected")).select("row.*")


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """place, other: each text of a SimHash component with one text of its fingerprint, and that with one of the component."""
    numbered = docs.select(near_copies.place(F.col("text")).alias("doc_id"), "text")
    found = simhash.near_duplicates(numbered, words=near_copies.WORDS).select(F.col("doc_id").alias("place"), "fp", "component_id").distinct()
    found = stored(found, "fingerprinted")
    least = stored(found.groupBy("fp", "component_id").agg(F.min("place").alias("other")), "of-fingerprints")
    within = found.join(least.select("fp", "other"), "fp").select("place", "other")
    between = least.select(F.col("other").alias("place"), F.col("component_id").alias("other"))
    return within.unionByName(between).filter("place <> other").distinct()


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id; of rows that share it and the shingles, one.

    Near copies share 0.8 or more of their five-word shingles. Fingerprints (operator 10, over such shingles) link texts,
    minimum hashes propose the pairs of 0.8 that lie further apart, and the sets of shingles decide on both. A group
    without any id keeps one row.
    """
    found = stored(near_copies.near_copies(docs, proposed=fingerprint_pairs(docs)), "near-duplicates")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    # Small tables are stored before a join with texts: Spark then knows their size and need not move the texts.
    later = stored(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct(), "later")
    kept = rows.join(later, "id", "left_anti")
    # Ids that are missing or occur more than once are rare; only their rows are told apart by shingles.
    odd = stored(found.groupBy(F.col("doc_id").alias("odd")).count().filter("count > 1 OR odd IS NULL").select("odd"), "odd-ids")
    if odd.isEmpty():
        return kept.select("row.*")
    is_odd = F.col("id").eqNullSafe(F.col("odd"))
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", "root").agg(F.min("fp").alias("first"))
    printed = near_copies.with_digest(rows.join(odd, is_odd, "left_semi").withColumn("text", F.col("row.text").cast("string")))
    chosen = printed.join(first, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("fp") == F.col("first")), "left_semi").dropDuplicates(["id", "fp"])
    return kept.join(odd, is_odd, "left_anti").select("row.*").unionByName(chosen.select("row.*"))


def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that occur earlier (in whole characters); a text that loses all goes."""
    found = suffix_dedup.with_spans(docs)
    cut = found.select("row", suffix_dedup.stripped(F.col("text"), F.col("starts"), F.col("stops"), whole_characters=True).alias("cut"))
    text = F.when(F.col("cut.n_removed") > 0, F.col("cut.kept").cast("string")).otherwise(F.col("row.text"))
    rows = cut.filter(F.col("cut.n_removed").isin(0) | (F.length("cut.kept") > 0)).select("row", text.alias("text"))
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    word_count = mixing.word_count(F.col("text"))
    place = mixing.row_hash(F.col("doc_id"), F.col("text"))
    limits = stored(mixing.limits(docs), "limits")
    rows = docs.select(F.struct("*").alias("row"), "source", word_count.alias("size"), place.alias("row_hash"))
    taken = rows.alias("r").join(limits.alias("l"), F.col("r.source").eqNullSafe(F.col("l.source")))
    return taken.select("row", mixing.copies().alias("copies")).filter("copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs)


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("repeats", remove_repeated_strings),
    ("mix", mix_sources),
    ("pack", pack),
]

#: No stage but the mix can be written in SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
