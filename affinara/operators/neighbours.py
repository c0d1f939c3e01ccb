"""k best catalog rows for every query of a batch, exactly, without emitting all pairs.

Scoring each query against each catalog row is what an exact neighbour search
is; the plan only ever ships the k best of each block. Two physical forms, which
the caller picks:

* ``form="grid"`` (the default): catalog and queries meet in a grid of blocks
  (every catalog row is copied once per query block of its bucket, every query
  once per catalog block). Block sides are bounded and ids are spread by hash, so
  a bucket holding a third of all rows is simply many blocks. Blocks of whole tables
  are shuffled in units of up to ``UNIT_ROWS`` rows a side and cut inside the task.
* ``form="scan"``: the query batch goes to every task and the catalog is scanned
  where it lies, without a shuffle. For batches of at most ``scan_bytes``, which
  is measured in Spark before the batch is read; a larger one is refused.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from affinara import kernels
from affinara.shipping import by_value, join_spread, written

# A query batch that goes to every task may take so many bytes, unless the caller sets another bound.
SCAN_BYTES = 64 * 1024 * 1024
# Greatest sides of a block in the grid, and the side below which cutting finer is no use.
CATALOG_BLOCK = 4096
QUERY_BLOCK = 4096
LEAST_BLOCK = 256
# Rows of a side that are shuffled together: several blocks, so that a small block does not multiply the rows that move.
UNIT_ROWS = 8192
BLOCK_KEYS = ["band", "band_key", "block_c", "block_q"]


def k_nearest(
    catalog: DataFrame,
    queries: DataFrame,
    scorer,
    k: int,
    carry: Sequence[str] = (),
    in_buckets: bool = False,
    id_desc: bool = False,
    form: str = "grid",
    scan_bytes: int = SCAN_BYTES,
    catalog_block: int = CATALOG_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """``(qid, id, score, *carry, rank)``: the k best catalog rows of each query.

    ``catalog`` has ``id``, the scorer's columns and ``carry``; ``queries`` has
    ``qid`` and the scorer's columns. With ``in_buckets`` the catalog has ``band_keys``
    (or ``band`` and ``band_key``, one row per bucket) and the queries ``kept`` (bands, keys and bucket sizes), and only rows of a kept
    bucket meet.
    """
    by_value(kernels)
    schema = T.StructType(
        [
            T.StructField("qid", queries.schema["qid"].dataType),
            T.StructField("id", catalog.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
            *[T.StructField(name, catalog.schema[name].dataType) for name in carry],
        ]
    )
    if form not in ("grid", "scan"):
        raise ValueError(f"unknown form: {form}")
    if form == "scan" and in_buckets:
        raise ValueError("rows of a bucket meet in Spark: use form='grid'")
    if form == "scan":
        batch = whole_batch(queries, scan_bytes)
        found = catalog.mapInArrow(kernels.scan_scorer(batch, scorer, k, tuple(carry), id_desc), schema)
    else:
        if in_buckets:
            left, right = bucket_blocks(catalog, queries, catalog_block, query_block)
            left, right = left.drop("band_keys"), right.drop("kept")
            keys = BLOCK_KEYS
        else:
            left, right = table_blocks(catalog, queries, max(catalog_block, UNIT_ROWS), max(query_block, UNIT_ROWS))
            keys = BLOCK_KEYS[2:]
        # both sides may come from one table: give the query side's columns their own identity
        right = right.select([F.col(name).alias(name) for name in right.columns])
        # by number, so that few bytes with much work are not merged into few tasks
        parts = shuffle_partitions(catalog)
        left, right = left.repartition(parts, *keys), right.repartition(parts, *keys)
        run = kernels.block_scorer(to_arrow_schema(schema), scorer, k, tuple(carry), id_desc, catalog_block, query_block)
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)
    if in_buckets:
        # a pair that was met in several buckets counts once, whatever the last bits of its scores
        rest = [F.first(name).alias(name) for name in carry]
        found = found.groupBy("qid", "id").agg(F.max("score").alias("score"), *rest)
    order = [F.desc("id")] if id_desc else [F.desc("score"), F.asc("id")]
    place = F.row_number().over(W.partitionBy("qid").orderBy(*order))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def whole_batch(queries: DataFrame, most: int):
    """The query batch as an Arrow table, after measuring that its rows take at most ``most`` bytes."""
    width = F.length(F.to_json(F.struct("*")))
    measured = queries.agg(F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).head()["bytes"]
    if measured > most:
        raise ValueError(f"a batch of {measured} bytes is too large for form='scan': use form='grid'")
    return queries.toArrow()


def table_blocks(
    catalog: DataFrame, queries: DataFrame, catalog_block: int, query_block: int
) -> tuple[DataFrame, DataFrame]:
    """Both sides with block numbers: every catalog row and query meet in exactly one block."""
    # at least enough blocks on each side for a few per partition
    wanted = ceil(sqrt(4 * shuffle_partitions(catalog)))
    n_c = blocks(catalog.select(F.count(F.lit(1))).scalar(), catalog_block, wanted)
    n_q = blocks(queries.select(F.count(F.lit(1))).scalar(), query_block, wanted)
    return grid(catalog, queries, n_c, n_q)


def bucket_blocks(
    catalog: DataFrame, queries: DataFrame, catalog_block: int, query_block: int
) -> tuple[DataFrame, DataFrame]:
    """Both sides once per band and bucket they share, with block numbers inside the bucket."""
    on = BLOCK_KEYS[:2]
    rows = catalog if "band" in catalog.columns else catalog.select(F.posexplode("band_keys").alias(*on), *catalog.columns)
    looks = look_rows(queries)
    # one row per bucket that is looked into: far fewer than either side's rows
    sizes = looks.groupBy(*on).agg(F.count(F.lit(1)).alias("rows_q"), F.max("rows_c").alias("rows_c"))
    sizes = written(sizes, "looked-into")
    left, right = grid(
        join_spread(rows, sizes, on, "id"),
        join_spread(looks.drop("rows_c"), sizes, on, "qid"),
        blocks(F.col("rows_c"), catalog_block),
        blocks(F.col("rows_q"), query_block),
    )
    return left.drop("rows_c", "rows_q"), right.drop("rows_c", "rows_q")


def look_rows(queries: DataFrame) -> DataFrame:
    """The batch with one row per kept bucket: ``(band, band_key, rows_c)`` and the batch's columns."""
    return (
        queries.withColumn("_look", F.explode("kept"))
        .withColumn("band", F.col("_look.band"))
        .withColumn("band_key", F.col("_look.key"))
        .withColumn("rows_c", F.col("_look.size"))
        .drop("_look")
    )


def grid(catalog: DataFrame, queries: DataFrame, n_c: Column, n_q: Column) -> tuple[DataFrame, DataFrame]:
    return (
        catalog.withColumn("block_c", part_of("id", n_c)).withColumn("block_q", every(n_q)),
        queries.withColumn("block_c", every(n_c)).withColumn("block_q", part_of("qid", n_q)),
    )


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def blocks(rows: Column, size: int, wanted: int = 1) -> Column:
    """Number of blocks: none above ``size`` rows on average, and up to ``wanted`` if the rows allow."""
    bounded = F.ceil(rows / F.lit(size))
    useful = F.least(F.lit(wanted), F.ceil(rows / F.lit(min(size, LEAST_BLOCK))))
    return F.greatest(bounded, useful, F.lit(1)).cast("int")


def part_of(id_name: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(id_name), parts).cast("int")


def every(parts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), parts - 1))
