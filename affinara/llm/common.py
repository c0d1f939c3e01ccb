"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_held_out(doc_id: str) -> Column:
    """Rows that no model of this subpackage learns from; a null id counts as not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under fixed names; all others stay behind, whatever they are called."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send whole texts to the Python workers in batches of at most this many rows from now on.

    A batch is held several times on its way, in the JVM and in the worker.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


def tidy(function):
    """The same function over batches; its worker gives memory back to the machine when the task ends.

    Workers are kept for later tasks, so what a task leaves behind adds up on an executor.
    """

    def run(batches):
        try:
            yield from function(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return run


def texts_of(column) -> list[str]:
    """The strings of an Arrow column; null reads as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def blocks(batches, column: str, most: int):
    """Cut Arrow batches so that a block holds about ``most`` bytes of text; a longer row is a block of its own."""
    held, size = [], 0
    for batch in batches:
        lengths = batch.column(column)
        sizes = np.frombuffer(pa.array(pa.compute.fill_null(pa.compute.binary_length(lengths), 0)).cast(pa.int64()).buffers()[1], np.int64, len(batch)) if len(batch) else []
        start = 0
        for i, n in enumerate(sizes):
            if size and size + n > most:
                held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches([b for b in held if len(b)], batch.schema).combine_chunks()
                held, size, start = [], 0, i
            size += int(n)
        held.append(batch.slice(start))
    if any(len(b) for b in held):
        yield pa.Table.from_batches([b for b in held if len(b)], held[0].schema).combine_chunks()


def segments(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every segment, one segment after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - ends + lengths, lengths) + np.arange(total)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (one to one), in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def shared(spark: SparkSession, value):
    """Send a value of bounded size to every executor; the result, called inside a task, gives it back."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    kept = []

    def load():
        if not kept:
            kept.append(pickle.loads(sent.value))
        return kept[0]

    return load
