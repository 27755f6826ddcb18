"""Mixing sources to target weights, with DataFrame functions only.

Sizes are added up by source and hash bucket. Along the buckets of one source the running sum shows the bucket
in which the budget is reached; only the documents of that bucket are looked at again, with the next bits of the
hash, until the bits are used up. What is left is one hash threshold for each source, and the mix is a filter:
nothing is sorted, and the same documents are taken on every run. Thresholds are nested: a larger budget takes
all that a smaller one took.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartula.llm.common import stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
#: Bits of the hash that one histogram resolves, and the number of histograms.
BITS, LEVELS = 12, 4
_USED = BITS * LEVELS


def word_count(text: Column) -> Column:
    """Runs of characters other than space, tab, LF, VT, FF and CR (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def row_hash(doc_id: Column, text: Column) -> Column:
    """The upper bits of a hash of the id (of the text where the id is null), not negative."""
    whole = F.when(doc_id.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(doc_id))
    return F.shiftrightunsigned(whole, 64 - _USED)


def _bucket(level: int) -> Column:
    return F.shiftright("row_hash", _USED - BITS * (level + 1))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target of ``sizes(source, size)``.

    Sources in code point order, null last, have the ``weights`` in turn and divide ``share`` of all
    sizes. A target stops at ``cap`` times its source's size; the excess goes to the others by weight
    until none is above.
    """
    totals = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")).repartitionByRange(F.col("source").asc_nulls_last()).select("*", F.spark_partition_id().alias("part")), "sources")
    # Ranks: a running number within each range, plus the sources of the ranges before it.
    before = totals.groupBy("part").count().select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("before") + F.col("within"), F.lit(len(weights))) + 1).cast("int"))
    weighed = totals.withColumn("within", within).join(before, "part").select("source", "source_size", turn.alias("weight"))
    full = F.lit(float(cap)) * F.col("source_size")
    total = totals.agg(F.sum("source_size")).first()[0] or 0
    budget, level = share * total, 0.0
    # Raise the common level until the sources that stay below their cap take what the others leave.
    while True:
        capped = full <= F.col("weight") * level
        held, open_weight = weighed.agg(F.sum(F.when(capped, full)), F.sum(F.when(~capped, F.col("weight")))).first()
        raised = max(0.0, budget - (held or 0.0)) / open_weight if open_weight else level
        if raised <= level:
            break
        level = raised
    return weighed.select("source", "source_size", F.least(full, F.col("weight") * level).alias("target"))


def _thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """source, whole (times that every document is taken), bound (hashes below it are taken once more)."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = targets.select("source", whole.cast("int").alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("prefix"))
    for n in range(LEVELS):
        inside = rows.alias("r").join(state.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (_bucket(n - 1) == F.col("s.prefix") if n else F.lit(True)))
        histogram = inside.groupBy("r.source", _bucket(n).alias("bucket")).agg(F.sum("size").alias("size"))
        until = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
        sums = histogram.select("source", "bucket", "size", until.alias("until")).alias("h")
        joined = sums.join(state.alias("s"), F.col("h.source").eqNullSafe(F.col("s.source")))
        # The first bucket that would go past what is left; none: the bucket after the last one.
        past = F.col("until") > F.col("left")
        last = n == LEVELS - 1
        gap = (F.col("until") - F.col("left"), F.col("left") - F.col("until") + F.col("size"))
        crossing = F.min(F.when(past, F.struct("bucket", (F.col("until") - F.col("size")).alias("below"), (gap[0] < gap[1]).alias("take"))))
        found = joined.groupBy("s.source", "s.whole", "s.left", "s.prefix").agg(crossing.alias("at"), F.max("bucket").alias("most"))
        # The nearer side of the last boundary decides, so each source comes as near as its documents allow.
        end = F.coalesce(F.col("at.bucket") + F.when(F.col("at.take"), 1).otherwise(0), F.col("most") + 1) if last else F.coalesce(F.col("at.bucket"), F.col("most") + 1)
        left = F.col("left") - F.coalesce(F.col("at.below"), F.lit(0))
        fresh = found.select(F.col("source"), "whole", left.alias("left"), end.alias("prefix")).alias("f")
        # A source whose boundary bucket is empty keeps its boundary: no document lies inside.
        kept = state.alias("s").join(fresh, F.col("s.source").eqNullSafe(F.col("f.source")), "left")
        state = stored(kept.select("s.source", "s.whole", F.coalesce("f.left", "s.left").alias("left"), F.coalesce("f.prefix", F.shiftleft("s.prefix", BITS)).alias("prefix")), "budget")
    return state.select("source", "whole", F.col("prefix").alias("bound"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, row_hash of every row; the only step that reads texts."""
    return stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("row_hash")), "sizes")


def limits_of(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, whole, bound, source_size, target for the sources of ``sized`` rows."""
    targets = stored(source_targets(rows, weights, share, cap), "targets")
    bounds = _thresholds(rows, targets).alias("t")
    return bounds.join(targets.alias("g"), F.col("t.source").eqNullSafe(F.col("g.source"))).select("t.*", "g.source_size", "g.target")


def limits(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``limits_of`` for documents."""
    return limits_of(sized(docs), weights, share, cap)


def copies(cap: float = CAP) -> Column:
    """How often a row (row_hash) is taken under its source's limits (whole, bound)."""
    return (F.col("whole") + F.when((F.col("row_hash") < F.col("bound")) & (F.col("whole") < cap), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per row of ``docs(doc_id, text, source)``: doc_id, size, source_size, target, taken, copies.

    ``copies`` says how often the mix takes the document, ``taken`` the words of that. Null texts have
    size 0, null is a source of its own, rows with equal ids are taken together, an empty table gives no
    rows, other columns are not read.
    """
    rows = sized(docs)
    found = rows.alias("r").join(limits_of(rows, weights, share, cap).alias("l"), F.col("r.source").eqNullSafe(F.col("l.source")))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(cap)).cast("long").alias("taken"), copies(cap).alias("copies"))
