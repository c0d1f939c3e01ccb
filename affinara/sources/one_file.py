"""Ordered export into one file that many tasks write at once.

Rows are put in order by ranges, and a running total of their bytes gives every row
its offset. Tasks then write their rows at these offsets of one file, so no task and
not the driver ever holds the export. A task that is run again writes the same bytes
at the same places. The file gets its name when it is whole.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinara.operators.ranking import running_total


def shared_file(spark: SparkSession, path: str) -> str:
    """The path without its scheme; refused unless it lies on a mounted file system, where a file can be written at offsets."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    scheme = target.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme()
    if scheme != "file":
        raise ValueError(f"one file needs a mounted folder that driver and executors share, not {scheme}: write a folder of parts instead")
    return target.toUri().getPath()


def write_one_file(
    rows: DataFrame,
    path: str,
    line: Column,
    order: list[str],
    before: str = "",
    separator: str = "\n",
    after: str = "",
    closed: bool = True,
) -> None:
    """Write ``before``, the texts ``line`` of all rows in ``order`` and ``after`` to one new file.

    ``closed`` ends every text with the separator; otherwise it stands between texts only.
    A null text is empty, and no rows give ``before`` and ``after`` alone. Rows equal in
    ``order`` come in any order. The folder must be mounted on the driver and all executors.
    """
    target = shared_file(rows.sparkSession, path)
    if os.path.exists(target):
        raise FileExistsError(f"{path} already exists")
    head, gap = before.encode(), len(separator.encode())
    text = F.coalesce(line.cast("string"), F.lit(""))
    mark = F.lit(separator)
    own = rows.select(*[F.col(c).alias(f"_order{i}") for i, c in enumerate(order)], (F.concat(text, mark) if closed else F.concat(mark, text)).alias("_text"))
    own = own.withColumn("_bytes", F.octet_length("_text").cast("long")).withColumn("_tie", F.monotonically_increasing_id())
    placed = running_total(own, [*(f"_order{i}" for i in range(len(order))), "_tie"], "_bytes", "_end")
    start = F.col("_end") - F.col("_bytes")
    if not closed:
        # the first text has no separator before it
        first = start == 0
        placed = placed.select(
            F.when(first, F.substr("_text", F.lit(len(separator) + 1))).otherwise(F.col("_text")).alias("_text"),
            F.when(first, 0).otherwise(start - gap).alias("_at"),
        )
    else:
        placed = placed.select("_text", start.alias("_at"))

    folder, name = os.path.split(target)
    os.makedirs(folder or ".", exist_ok=True)
    partial = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
    base = len(head)

    def put(batches):
        out = os.open(partial, os.O_WRONLY)
        done = 0
        try:
            for batch in batches:
                if not len(batch):
                    continue
                texts = batch.column("_text").cast(pa.large_string())
                edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
                data = memoryview(texts.buffers()[2] or b"")
                at = batch.column("_at").to_numpy() + base
                # texts that follow each other in the file lie so in the batch too, and go out together
                starts = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1] + np.diff(edges)[:-1]) + 1, [len(at)]))
                for i, j in zip(starts[:-1], starts[1:], strict=True):
                    piece, where = data[edges[i] : edges[j]], int(at[i])
                    done += len(piece)
                    while len(piece):
                        n = os.pwrite(out, piece, where)
                        piece, where = piece[n:], where + n
            os.fsync(out)
        finally:
            os.close(out)
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["bytes"])

    try:
        with open(partial, "wb") as out:
            out.write(head)
        body = placed.mapInArrow(put, "bytes long").agg(F.sum("bytes")).head()[0] or 0
        if os.path.getsize(partial) != base + body:
            raise OSError(f"{path}: {os.path.getsize(partial)} bytes arrived of {base + body}; do all executors share the folder?")
        with open(partial, "ab") as out:
            out.write(after.encode())
        os.rename(partial, target)
    finally:
        if os.path.exists(partial):
            os.remove(partial)
