"""Language identification: held-out accuracy, and rows out of the ordinary."""

import zlib

import zstandard

from pyspark.sql import functions as F

from chartula.llm import language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out)
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) < 0.02 * len(rows)


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    changed = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    assert language.learn(docs) == language.learn(changed)


def test_odd_rows(spark):
    rows = [(n, text, lang, True) for n, (text, lang) in enumerate([("the cat and the dog " * 9, "en"), ("le chat et le chien " * 9, "fr"), (None, "en"), ("", "fr"), ("123 !?", None), ("the dog", None)] * 4)]
    docs = spark.createDataFrame([*rows, (None, "le chien et le chat", None, True), rows[0]], "doc_id long, text string, lang string, held_out boolean")
    out = language.identify(docs).collect()
    assert len(out) == 26
    odd = {n for n, text, _, _ in rows if text in (None, "", "123 !?")}
    assert {r.doc_id for r in out if r.lang_pred == "und"} == odd
    assert {r.lang_pred for r in out} == {"en", "fr", "und"}
    assert [r.held_out for r in out if r.doc_id is None] == [False]
    assert language.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_plain_predictor_over_whole_texts(spark):
    """A fresh compressor for each block and language, sums by plain loops; a long text and more labels than a few."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.range(1000, 1300).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id")).alias("text"), F.concat(F.lit("l"), F.col("id")).alias("lang"))
    dictionaries = language.learn(docs)
    assert all(0 < len(d) <= language.DICTIONARY_BYTES for d in dictionaries.values())
    assert len(language.learn(docs.unionByName(labels))) > 200
    texts = {r.doc_id: r.text for r in docs.collect()}
    longest = max(texts, key=lambda n: len(texts[n]))
    rows = spark.createDataFrame([(n, texts[n]) for n in list(texts)[:40]] + [(9999, texts[longest] * 30)], "doc_id long, text string")
    found = {r.doc_id: r.p for r in rows.select("doc_id", language.predicted(F.col("text"), dictionaries).alias("p")).collect()}
    for number, text in {r.doc_id: r.text for r in rows.collect()}.items():
        raw = language.letters(text or "").encode()
        sums = []
        for lang, words in dictionaries.items():
            size = 0
            for at in range(0, len(raw), language.BLOCK):
                held = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                size += len(zstandard.ZstdCompressor(level=language.LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress(raw[at : at + language.BLOCK]))
            sums.append((size, lang))
        sums.sort()
        if raw.strip():
            assert (found[number].lang, round(found[number].score, 9)) == (sums[0][1], round(1 - sums[0][0] / sums[1][0], 9))
