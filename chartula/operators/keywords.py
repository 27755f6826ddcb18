"""Keyword search for tables of keywords: words and grams lead to candidates, ``contains`` decides.

A keyword without spaces is in a text if it is in a word of it: of each word that holds it the first texts are enough,
and of these words only those that begin first, so the pairs of texts and keywords are never made.  Any other keyword
that is found somewhere splits there into the words of the text: those inside of it are whole words of the text, its
first and last are parts of some.  So it is filed under the rarest of its inner words, counted in Spark; one without
inner words under all words of the corpus that hold its longest part, which grams find in the vocabulary.  Texts give
their different words, an equi-join leaves those in use, and only these pairs are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartula.operators.joins import salted_join
from chartula.operators.ranking import SALTS, top_per_group
from chartula.session import cut_lineage

#: Longest string by which a name or word is looked up inside of others.
GRAM = 4
#: Postings (a word and a keyword, or a word in use) that are broadcast; more of them meet the words of texts by a shuffle.
BROADCAST_POSTINGS = 1_000_000


def grams(text: Column, size: int) -> Column:
    """All strings of ``size`` characters in ``text``, with repeats."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def contained(parts: DataFrame, wholes: DataFrame, *, also: Sequence[str] = (), few: bool = False) -> DataFrame:
    """``(part, whole)`` for distinct names of which one stands inside the other, in time linear in their length.

    A name gives its strings of up to GRAM characters; a part is looked up by itself, or by the rarest of its own.
    With ``also``, columns of ``wholes`` of which the first tells them apart, these come back instead of the whole, which
    then does not travel with its strings.  ``few`` parts are broadcast.
    """
    kept = list(also) or ["whole"]

    def emitted(*sizes: int) -> DataFrame:
        return wholes.select(*kept, F.explode(F.array_distinct(F.concat(*[grams(F.col("whole"), n) for n in sizes]))).alias("gram"))

    def met(strings: DataFrame, filed: DataFrame) -> DataFrame:
        return strings.join(F.broadcast(filed), "gram") if few else salted_join(strings, filed, ["gram"], salt_on=kept[:1])

    short = F.length("part") <= GRAM
    own = parts.filter(short & (F.col("part") != "")).select("part", F.col("part").alias("gram"))
    some = parts.filter(~short).select("part", F.explode(F.array_distinct(grams(F.col("part"), GRAM))).alias("gram"))
    held = emitted(GRAM)
    if few:
        held = held.join(F.broadcast(some.select("gram").distinct()), "gram")
    counts = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # A part with a gram that no name holds is in no name.
    rarest = some.join(counts, "gram", "left").groupBy("part").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"), F.min(F.coalesce("n", F.lit(0))).alias("n"))
    near = met(emitted(GRAM), rarest.filter("n > 0").select("part", "gram"))
    if also:
        near = near.join(wholes.select(kept[0], "whole"), kept[0])
    found = near.filter(F.col("whole").contains(F.col("part"))).select("part", *kept)
    return met(emitted(*range(1, GRAM + 1)), own).select("part", *kept).unionByName(found)


def _postings(keywords: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """token, keyword: the words of texts under which a keyword is looked for.  A keyword without a posting is in no text."""
    parts = F.split("keyword", " ", -1)
    inner = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda p: p != "")
    split = keywords.select("keyword", parts.alias("parts"), F.array_distinct(inner).alias("inner"))
    counted = split.filter("size(inner) > 0").select("keyword", F.explode("inner").alias("token")).join(vocabulary, "token", "left")
    rarest = counted.groupBy("keyword").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"), F.min(F.coalesce("n", F.lit(0))).alias("n"))
    # Of keywords of one or two parts, the longer part ends or begins a word, or is in it.
    longest = F.reduce("parts", F.lit(""), lambda best, p: F.when(F.length(p) > F.length(best), p).otherwise(best))
    ends = split.filter("size(inner) = 0").select("keyword", "parts", longest.alias("part")).filter("part <> ''")
    found = salted_join(contained(ends.select("part").distinct(), vocabulary.select(F.col("token").alias("whole"))), ends, ["part"], salt_on=["whole"])
    whole, part = F.col("whole"), F.col("part")
    fits = (F.size("parts") == 1) | ((F.element_at("parts", 1) == part) & whole.endswith(part)) | ((F.element_at("parts", -1) == part) & whole.startswith(part))
    return rarest.filter("n > 0").select("token", "keyword").unionByName(found.filter(fits).select(whole.alias("token"), "keyword"))


def _first_ids(rows: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """``rows`` with one of the first ``limit`` different ids of their key, in each of some parts of it; all repeats stay."""
    parts = Window.partitionBy(*keys, "_part").orderBy(F.asc("_id"))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("_id"), F.lit(SALTS)))
    return dealt.withColumn("_place", F.dense_rank().over(parts)).filter(F.col("_place") <= limit).drop("_part", "_place")


def _first_of_words(keywords: DataFrame, vocabulary: DataFrame, tokens: Callable[..., DataFrame], limit: int, broadcast_postings: int) -> DataFrame:
    """``_id, keyword``: among others the first ``limit`` texts of each keyword without spaces.

    ``vocabulary(word, token, _id)`` has a number and the first text of each word.  Where the words that hold a keyword begin in
    ``limit`` different texts or more, no text after these is among the first, nor is a word that begins later needed.
    """
    few = keywords.count() <= broadcast_postings
    postings = contained(keywords.select(F.col("keyword").alias("part")), vocabulary.withColumnRenamed("token", "whole"), also=["word", "_id"], few=few)
    parted = _first_ids(postings.withColumnRenamed("part", "keyword"), ["keyword"], limit)
    begins = Window.partitionBy("keyword").orderBy(F.asc("_id"))
    needed = cut_lineage(parted.withColumn("place", F.dense_rank().over(begins)).filter(F.col("place") <= limit))
    last = needed.groupBy("keyword").agg(F.when(F.max("place") == limit, F.max("_id")).alias("last"))
    wanted = needed.select("word", "keyword").join(last, "keyword")
    # Null: some keyword of the word has no last text.
    lasts = wanted.groupBy("word").agg(F.when(~F.max(F.col("last").isNull()), F.max("last")).alias("last"))
    used = cut_lineage(vocabulary.select("token", "word").join(lasts, "word"))
    used = F.broadcast(used) if used.count() <= broadcast_postings else used
    early = F.col("last").isNull() | F.col("_id").isNull() | (F.col("_id") <= F.col("last"))
    first = _first_ids(tokens("_id").join(used, "token").filter(early).select("_id", "word"), ["word"], limit)
    return first.join(needed.select("word", "keyword"), "word").select("_id", "keyword")


def keyword_matches(
    chunks: DataFrame,
    queries: DataFrame,
    limit: int,
    *,
    id_col: str = "id",
    columns: Sequence[str] = ("content",),
    query_id_col: str = "query_id",
    query_col: str = "query",
    broadcast_postings: int = BROADCAST_POSTINGS,
) -> DataFrame:
    """First ``limit`` ids per query, by id, whose text contains the query: ``(query_id, id, rank)``.

    Matching is literal and ignores case; with several columns any of them may match.  A null text is
    empty, a null query matches nothing, an empty one everything.
    """
    asked = queries.select(F.col(query_id_col), F.lower(query_col).alias("keyword")).filter("keyword IS NOT NULL")
    words = cut_lineage(asked.select("keyword").distinct())
    named = [f"_t{n}" for n in range(len(columns))]
    rows = chunks.select(F.col(id_col).alias("_id"), *[F.lower(F.coalesce(c, F.lit(""))).alias(n) for c, n in zip(columns, named, strict=True)])
    texts = [F.col(n) for n in named]
    of_text = F.array_distinct(F.flatten(F.array(*[F.split(t, " ", -1) for t in texts])))

    def tokens(*keep: str) -> DataFrame:
        return rows.select(*keep, F.explode(of_text).alias("token")).filter("token <> ''")

    counted = tokens("_id").groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("_least"), F.max(F.col("_id").isNull()).alias("_unnamed"))
    # A null id comes before all others.
    vocabulary = cut_lineage(counted.select(F.monotonically_increasing_id().alias("word"), "token", "n", F.when(~F.col("_unnamed"), F.col("_least")).alias("_id")))
    blank = words.filter("trim(BOTH ' ' FROM keyword) = ''").select("keyword", F.length("keyword").alias("run"))
    filled = words.filter("trim(BOTH ' ' FROM keyword) <> ''")
    spaced = F.col("keyword").contains(" ")
    matches = _first_of_words(filled.filter(~spaced), vocabulary.drop("n"), tokens, limit, broadcast_postings)
    phrases = filled.filter(spaced)
    if not phrases.isEmpty():
        postings = cut_lineage(_postings(phrases, vocabulary.select("token", "n")))
        held = F.lit(False)
        for text in texts:
            held = held | text.contains(F.col("keyword"))
        if postings.count() <= broadcast_postings:
            # The text stays beside its words in one task, from the scan to the comparison.
            near = tokens("_id", *named).join(F.broadcast(postings), "token")
        else:
            near = salted_join(tokens("_id"), postings, ["token"], salt_on=["_id"]).select("_id", "keyword").distinct().join(rows, "_id")
        matches = matches.unionByName(near.filter(held).select("_id", "keyword"))
    # Keywords of nothing but spaces: each text has those up to its longest run of spaces.
    runs = F.array_max(F.concat(F.array(F.lit(0)), *[F.transform(F.regexp_extract_all(t, F.lit("( +)"), F.lit(1)), lambda r: F.length(r)) for t in texts]))
    if not blank.isEmpty():
        own = rows.select("_id", F.explode(F.sequence(F.lit(0), runs)).alias("run"))
        matches = matches.unionByName(salted_join(own, blank, ["run"], salt_on=["_id"]).select("_id", "keyword"))
    # Ranked once a keyword, whatever the number of its queries.
    ranked = top_per_group(_first_ids(matches, ["keyword"], limit).distinct(), ["keyword"], [F.asc("_id")], limit)
    return asked.join(ranked, "keyword").select(query_id_col, F.col("_id").alias(id_col), "rank")
