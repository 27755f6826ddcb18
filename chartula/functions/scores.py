"""Reading relevance scores out of model responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Response words and the score each class stands for, tested in this order.
SCORE_WORDS = [
    (["high", "very relevant", "excellent"], 0.9),
    (["good", "relevant", "moderate"], 0.7),
    (["low", "poor", "irrelevant"], 0.3),
]
NEUTRAL_SCORE = 0.5


def parse_score(response: Column) -> Column:
    """First number scaled into [0, 1], else a score by wording."""
    number = F.regexp_extract(response, r"(\d*\.?\d+)", 1).try_cast("double")
    scaled = (
        F.when(number <= 1.0, number)
        .when(number <= 10.0, number / 10.0)
        .when(number <= 100.0, number / 100.0)
        .when(number.isNotNull(), F.least(number / 1000.0, F.lit(1.0)))
    )
    lowered = F.lower(response)
    worded = F.lit(NEUTRAL_SCORE)
    for vocabulary, score in reversed(SCORE_WORDS):
        hit = F.lit(False)
        for word in vocabulary:
            hit = hit | lowered.contains(word)
        worded = F.when(hit, F.lit(score)).otherwise(worded)
    return F.when(response.isNull(), F.lit(0.0)).otherwise(F.coalesce(scaled, worded))
