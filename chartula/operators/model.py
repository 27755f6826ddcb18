"""The model edge: one Arrow-batched operator and the contracts built on it.

A model is any function from a list of inputs to a list of outputs.  The wrappers supply
prompts as Spark expressions and the fallbacks of each contract; no client is included.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from chartula.functions import text as tx

BATCH = 20
TRIES = 3
# Rows that go back to Spark together.
OUT_ROWS = 256
# Rows whose bucket counts are held as one dense matrix.
COUNT_ROWS = 1000
EMPTY_TEXT = "[empty]"
# Characters of a document that a chunk's prompt shows.
CONTEXT_WINDOW = 25_000
DEFAULT_CODE_SUMMARY = "Code example for demonstration purposes."


def apply_model(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], pd.Series],
    in_cols: Sequence[str],
    out_col: str,
    out_type: T.DataType,
    *,
    batch_size: int = BATCH,
) -> DataFrame:
    """Add ``out_col = fn(batch[in_cols])``, called on slices of at most ``batch_size`` rows.

    Only ``in_cols`` of a slice become pandas objects; all other columns go through as they came.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, out_type)])
    kind = to_arrow_type(out_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Some slices at a time leave together: neither is a batch held twice, nor does each of few rows travel alone.
            step = -(-OUT_ROWS // batch_size) * batch_size
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                answers = [fn(part.slice(first, batch_size).select(list(in_cols)).to_pandas()) for first in range(0, part.num_rows, batch_size)]
                column = pa.chunked_array([pa.array(a.tolist(), kind, from_pandas=True) for a in answers], kind).combine_chunks()
                yield pa.RecordBatch.from_arrays([*part.columns, *(column.chunks if isinstance(column, pa.ChunkedArray) else [column])], schema.names)
            del batch
            released()

    return df.mapInArrow(run, schema)


def released() -> None:
    """Give memory that is not in use back to the system: workers live on, beside those of other steps."""
    pa.default_memory_pool().release_unused()


def with_retries(
    call: Callable[[list], list], items: list, fallback, *, tries: int = TRIES, delay: float = 1.0
) -> list:
    """Batch call with doubling delays, then item by item, then ``fallback`` per item."""
    for attempt in range(tries):
        try:
            answers = list(call(items))
            if len(answers) != len(items):
                raise ValueError(f"{len(answers)} answers for {len(items)} inputs")
            return answers
        except Exception:
            if attempt < tries - 1:
                time.sleep(delay * 2**attempt)
    answers = []
    for item in items:
        try:
            answers.append(list(call([item]))[0])
        except Exception:
            answers.append(fallback)
    return answers


def embed_texts(
    df: DataFrame,
    embed: Callable[[list[str]], list[Sequence[float]]],
    dim: int,
    *,
    text_col: str = "content",
    out_col: str = "embedding",
    max_chars: int | None = None,
    tries: int = TRIES,
    delay: float = 1.0,
    batch_size: int = BATCH,
) -> DataFrame:
    """Vectors from a model; empty texts and failed texts get the zero vector.

    A vector of another length than ``dim`` fails the job.
    """
    zero = [0.0] * dim

    def fn(part: pd.DataFrame) -> pd.Series:
        texts = [t if isinstance(t, str) else "" for t in part[text_col]]
        asked = [i for i, t in enumerate(texts) if t.strip()]
        out: list[Sequence[float]] = [zero] * len(texts)
        if asked:
            answers = with_retries(
                embed, [texts[i][:max_chars] for i in asked], zero, tries=tries, delay=delay
            )
            for i, vector in zip(asked, answers):
                if len(vector) != dim:
                    raise ValueError(f"a vector of {len(vector)} components instead of {dim}")
                out[i] = [float(x) for x in vector]
        return pd.Series(out)

    return apply_model(df, fn, [text_col], out_col, T.ArrayType(T.FloatType()), batch_size=batch_size)


def generate(
    df: DataFrame,
    complete: Callable[[list[str]], list[str]],
    prompt: Column,
    out_col: str,
    *,
    drop: Sequence[str] = (),
    batch_size: int = BATCH,
) -> DataFrame:
    """Stripped model answers for a prompt expression, NULL where the call failed.

    Columns in ``drop`` serve the prompt only and are not sent along.
    """

    def fn(part: pd.DataFrame) -> pd.Series:
        answers = with_retries(complete, list(part["_prompt"]), None, tries=1)
        return pd.Series([a.strip() if isinstance(a, str) else None for a in answers], dtype=object)

    asked = df.withColumn("_prompt", prompt).drop(*drop)
    return apply_model(asked, fn, ["_prompt"], out_col, T.StringType(), batch_size=batch_size).drop("_prompt")


def context_prompt(document: Column, chunk: Column) -> Column:
    return F.concat(
        F.lit("Document:\n"),
        tx.head(document, CONTEXT_WINDOW),
        F.lit("\n\nPassage from it:\n"),
        chunk,
        F.lit("\n\nSay in one or two sentences where the passage stands in the document."),
    )


def contextualise(
    chunks: DataFrame, documents: DataFrame, complete: Callable[[list[str]], list[str]]
) -> DataFrame:
    """Prefix every chunk with a model-written context; failures keep the chunk.

    Row-aligned: the answer is a column of the chunk's own row.  Only the window of a document that
    the prompt shows is joined to its chunks.
    """
    joined = chunks.join(documents.select("url", tx.head(F.col("markdown"), CONTEXT_WINDOW).alias("_document")), "url", "left")
    prompt = context_prompt(F.coalesce("_document", F.lit("")), F.col("content"))
    answered = generate(joined, complete, prompt, "_context", drop=["_document"])
    done = F.col("_context").isNotNull()
    return answered.select(
        *chunks.columns,
        F.when(done, tx.contextual_text(F.col("_context"), F.col("content")))
        .otherwise(F.col("content"))
        .alias("embed_text"),
        done.alias("contextual_embedding"),
    )


def code_summary_prompt(before: Column, code: Column, after: Column) -> Column:
    return F.concat(
        F.lit("Before:\n"),
        tx.tail(before, 500),
        F.lit("\n\nCode:\n"),
        tx.head(code, 1500),
        F.lit("\n\nAfter:\n"),
        tx.head(after, 500),
        F.lit("\n\nSay in two or three sentences what the code shows."),
    )


def summarise_code(blocks: DataFrame, complete: Callable[[list[str]], list[str]]) -> DataFrame:
    prompt = code_summary_prompt(F.col("context_before"), F.col("code"), F.col("context_after"))
    answered = generate(blocks, complete, prompt, "summary")
    return answered.withColumn("summary", F.coalesce("summary", F.lit(DEFAULT_CODE_SUMMARY)))


def summarise_sources(texts: DataFrame, complete: Callable[[list[str]], list[str]]) -> DataFrame:
    """One summary per ``(source_id, text)``; empty or failed ones get the default."""
    prompt = F.concat(
        F.lit("Source: "),
        F.col("source_id"),
        F.lit("\n\nContent:\n"),
        tx.head(F.col("text"), 25000),
        F.lit("\n\nDescribe the source in three to five sentences."),
    )
    filled = texts.filter(~tx.is_blank(F.col("text")))
    blank = texts.filter(tx.is_blank(F.col("text"))).withColumn("summary", F.lit(None).cast("string"))
    answered = generate(filled, complete, prompt, "summary").unionByName(blank)
    return answered.withColumn("summary", tx.clip_summary(F.col("summary"), F.col("source_id")))


def score_pairs(
    pairs: DataFrame,
    score: Callable[[list[tuple[str, str]]], list[float]],
    *,
    query_col: str = "query",
    text_col: str = "content",
    out_col: str = "rerank_score",
    batch_size: int = BATCH,
) -> DataFrame:
    """Relevance of (query, text) pairs; empty texts, and all pairs of a batch that fails, score 0.0."""

    def fn(part: pd.DataFrame) -> pd.Series:
        texts = [t if isinstance(t, str) else "" for t in part[text_col]]
        asked = [i for i, t in enumerate(texts) if t.strip()]
        out = [0.0] * len(texts)
        if asked:
            queries = list(part[query_col])
            try:
                answers = list(score([(queries[i], texts[i]) for i in asked]))
            except Exception:  # noqa: BLE001  whatever the model raises, the batch has no scores
                answers = []
            if len(answers) != len(asked):
                answers = [0.0] * len(asked)
            for i, value in zip(asked, answers):
                out[i] = float(value)
        return pd.Series(out, dtype="float64")

    return apply_model(pairs, fn, [query_col, text_col], out_col, T.DoubleType(), batch_size=batch_size)


def hash_embed(
    df: DataFrame, dim: int, *, text_col: str = "content", out_col: str = "embedding"
) -> DataFrame:
    """Model-free vectors: lower-cased words hashed into ``dim`` buckets, unit length.

    Row-local.  Words are split and hashed by Spark; only bucket numbers reach the counting
    step, and texts without words get the zero vector.
    """

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def counted(buckets: pa.Array) -> pa.Array:
        parts = [_bucket_vectors(buckets.slice(at, COUNT_ROWS), dim) for at in range(0, len(buckets), COUNT_ROWS)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float32()))

    lowered = tx.words(F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    buckets = F.transform(lowered, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))
    return df.withColumn(out_col, counted(buckets))


def _bucket_vectors(buckets: pa.ListArray, dim: int) -> pa.ListArray:
    """Unit-length bucket counts of each list."""
    n = len(buckets)
    lengths = pc.list_value_length(buckets).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(n), lengths)
    values = buckets.flatten().to_numpy(zero_copy_only=False)
    counts = np.bincount(rows * dim + values, minlength=n * dim).reshape(n, dim).astype(np.float64)
    norms = np.linalg.norm(counts, axis=1, keepdims=True)
    unit = np.divide(counts, norms, out=np.zeros_like(counts), where=norms > 0)
    offsets = pa.array(np.arange(n + 1) * dim, pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(unit.ravel().astype(np.float32)))
