"""Language identification by compression.

For every language a raw-content dictionary is cut from a bounded sample of labelled texts. A text is reduced to
its letters and compressed block by block under each dictionary; the language with the smallest sum is the
prediction. Where the runner-up needs hardly more bytes, the prediction is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartula.llm.common import tidied
from chartula.operators.ranking import top_per_group

#: Bounds of what is learned for each label: passages, characters of a passage, bytes of a dictionary.
PASSAGES, PASSAGE_CHARS, DICTIONARY_BYTES = 256, 1000, 32 << 10
#: Bytes of a block, the compression level, and the least relative distance to the runner-up.
BLOCK, LEVEL, MARGIN = 1024, 6, 0.002
UNKNOWN = "und"
_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower case, everything between words one space."""
    return _NO_LETTERS.sub(" ", text.lower())


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the ids that nothing is learned from (null: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame) -> dict[str, bytes]:
    """A dictionary for each label of ``docs(doc_id, text, lang)``, from rows that are not held out.

    Of the PASSAGES ids of a label with the smallest hashes, one passage of each text is taken, in the order of
    the hashes, until the passages have twice DICTIONARY_BYTES bytes; their letters, cut at DICTIONARY_BYTES, are
    the dictionary. All labels have one. Rows without an id, a text or a label are not learned from; of rows that
    share an id the smallest passage counts; an empty table gives no dictionary.
    """
    place = F.xxhash64("doc_id")
    known = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.select("lang", place.alias("place"), "text")
    # Only hashes are ranked, in two steps; at most PASSAGES of them for each label then fetch their passages.
    chosen = top_per_group(known.select("lang", "place"), ["lang"], [F.asc("place")], PASSAGES, salt_on=["place"])
    begin = F.pmod(F.xxhash64("place"), F.greatest(F.lit(1), F.length("text") - PASSAGE_CHARS + 1)).cast("int") + 1
    passages = known.join(F.broadcast(chosen.select("lang", "place").distinct()), ["lang", "place"])
    passages = passages.select("lang", "place", F.substring("text", begin, F.lit(PASSAGE_CHARS)).alias("passage"))
    first = passages.groupBy("lang", "place").agg(F.min("passage").alias("passage"))
    before = F.sum(F.octet_length("passage")).over(Window.partitionBy("lang").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    enough = first.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < 2 * DICTIONARY_BYTES)
    found: dict[str, list] = {}
    for row in enough.select("lang", "place", "passage").collect():
        found.setdefault(row["lang"], []).append((row["place"], row["passage"]))
    return {lang: "\n".join(letters(p) for _, p in sorted(own)).encode()[:DICTIONARY_BYTES] for lang, own in sorted(found.items())}


def predictor(dictionaries: dict[str, bytes]) -> Callable[[str | None], tuple[str, float, bool]]:
    """A function from a text to (language, score, rejected).

    The score is the share by which the smallest sum stays below the second smallest (1 if there is one
    language only). A text that is null or has no letter is ``und``, score 0, rejected.
    """
    compressors = []
    for lang, raw in dictionaries.items():
        dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        if raw:
            dictionary.precompute_compress(level=LEVEL)
        compressors.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary if raw else None, write_content_size=False, write_checksum=False, write_dict_id=False)))

    def predict(text: str | None) -> tuple[str, float, bool]:
        own = letters(text or "")
        if not compressors or not any(map(str.isalpha, own)):
            return UNKNOWN, 0.0, True
        raw = own.encode()
        blocks = [raw[at : at + BLOCK] for at in range(0, len(raw), BLOCK)]
        sums = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in compressors)
        if len(sums) == 1:
            return sums[0][1], 1.0, False
        best, second = sums[0][0], sums[1][0]
        return sums[0][1], 1 - best / second, second - best < MARGIN * best

    return predict


def predicted(text: Column, dictionaries: dict[str, bytes]) -> Column:
    """struct(lang, score, rejected) of a text column."""

    def column(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = predictor(dictionaries)
        for texts in batches:
            yield pd.DataFrame(list(map(predict, texts)), columns=["lang", "score", "rejected"])

    return F.pandas_udf(tidied(column), "lang string, score double, rejected boolean")(text.cast("string"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected per row of ``docs(doc_id, text, lang)``.

    Learned labels only come from rows that are not held out; without any, every text is ``und``. So is a null text
    and one without letters, with score 0. Whole texts are compressed, whatever their length. Of labels with equal sums
    the first by name is predicted, with score 0.
    Rows with a null id are never held out. Repeated rows are returned each, an empty table gives no
    rows, other columns are not read.
    """
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predicted(F.col("text"), learn(docs)).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), F.col("found.rejected").alias("rejected"))
