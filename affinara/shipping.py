"""How helper code and small tables reach the executors, and where tables are written."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table is sent to every task only if counting proves it has no more rows and bytes of text than this.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024
# Parts that a key's rows are cut into before a join with a table too large to send to every task.
SALTS = 64


def by_value(module) -> None:
    """Send this module's functions to the Python workers by value: nothing to install on executors."""
    cloudpickle.register_pickle_by_value(module)


# Folders written since the innermost ``scratch_of_job`` began.
_OWNED: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder in ``spark.checkpoint.dir`` (or the context's checkpoint folder)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _OWNED:
        _OWNED[-1].append(path)
    return path


@contextmanager
def scratch_of_job(spark: SparkSession):
    """Delete the scratch tables written inside when the job ends; what a caller keeps must be written elsewhere."""
    _OWNED.append([])
    try:
        yield
    finally:
        for path in _OWNED.pop():
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage as ``checkpoint()`` does and survives lost executors, but
    stays columnar: later reads prune columns and count rows from metadata.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether counting proves a table to have no more rows and bytes than this; reads one row more at most."""
    width = F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))
    found = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("rows"), width.alias("bytes")).head()
    return found["rows"] <= rows and found["bytes"] <= size


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a narrow table for broadcast after counting its rows and bytes; beyond the bounds it stays a shuffled join."""
    return F.broadcast(df) if is_small(df, rows) else df


def join_spread(rows: DataFrame, facts: DataFrame, on: list[str], spread_by: str, bound: int | None = None) -> DataFrame:
    """Join ``rows``, of which one key may hold a third, with ``facts``, which has one row per key.

    Small facts go to every task. Otherwise every fact is copied once per salt, and a
    key's rows are spread over the salts before the join, so no task gets a whole key.
    """
    if is_small(facts, BROADCAST_ROWS if bound is None else bound):
        return rows.join(F.broadcast(facts), on)
    copies = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by, F.lit(SALTS)), F.lit(SALTS)).cast("int"))
    return salted.join(copies.hint("merge"), [*on, "_salt"]).drop("_salt")
