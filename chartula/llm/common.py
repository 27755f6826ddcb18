"""Helpers the operators share: stored intermediate tables and Arrow plumbing."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from chartula.session import ensure_checkpoint_dir


def shared_folder(spark, tag: str) -> str:
    """A new folder below the checkpoint folder, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here."""
    folder = shared_folder(df.sparkSession, tag)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def released() -> None:
    """Give memory that is not in use back to the system: idle Python workers live on beside the next ones."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:
        # Only some C libraries keep freed memory, and offer this.
        pass


def tidied(function: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """An Arrow or pandas function over a partition that hands its memory back at the end."""

    @wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            released()

    return run


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the offset of each text (null: empty)."""
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def gathered(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray] | None:
    """The columns of a whole partition of fixed-width, non-null values."""
    table = [b for b in batches if b.num_rows]
    if not table:
        return None
    whole = pa.Table.from_batches(table)
    return {name: whole.column(name).to_numpy() for name in whole.column_names}


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
