"""Exact cosine neighbours that skip whole blocks of the catalog by a bound.

Titles are ordered by their greatest weights and cut into blocks. An inverted index
holds, for every position, the blocks that use it with the greatest and the least
weight there; the sum over a query's positions bounds its cosine with every title of
a block. Each query first meets the block of its highest bound, which gives it k
scores to beat; then only the blocks whose bound reaches its k-th score. What is
skipped cannot hold one of the k best, so the rows are those of the full search.
Equal vectors score alike and are one row on each side (``operators.alike``).
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from affinara import kernels
from affinara.operators.alike import cosine_by_class
from affinara.operators.neighbours import BLOCK_KEYS, QUERY_BLOCK, every, grid, part_of, shuffle_partitions
from affinara.operators.neighbours import blocks as blocks_of
from affinara.operators.ranking import global_row_number
from affinara.shipping import broadcast_if_small, by_value, written

BLOCK_ROWS = 1024
# scores are compared as multiples of 1e-9; a bound is a sum of rounded products
SLACK = 1e-8
# Blocks whose bounds a task holds, and parts of the queries if their number allows.
BOUND_BLOCKS = 1024
BOUND_PARTS = 64


def norm(vector, kind: T.DataType):
    """Length of a dense or sparse vector."""
    values = vector if isinstance(kind, T.ArrayType) else vector["values"]
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def with_lengths(rows: DataFrame) -> DataFrame:
    length = norm(F.col("vector"), rows.schema["vector"].dataType)
    return rows.withColumn("_length", length).filter(F.col("_length") > 0)


def weights(rows: DataFrame, id_name: str) -> DataFrame:
    """``(id, pos, weight)`` of rows that have ``_length``."""
    vector = F.col("vector")
    if isinstance(rows.schema["vector"].dataType, T.ArrayType):
        cells = rows.select(id_name, "_length", F.posexplode(vector).alias("pos", "value"))
    else:
        pairs = F.arrays_zip(vector["indices"].alias("pos"), vector["values"].alias("value"))
        cells = rows.select(id_name, "_length", F.explode(pairs).alias("c")).select(id_name, "_length", "c.pos", "c.value")
    return cells.filter(F.col("value") != 0).select(id_name, "pos", (F.col("value") / F.col("_length")).alias("weight"))


def in_blocks(features: DataFrame, block_rows: int) -> DataFrame:
    """The titles with a cosine, and ``block``: neighbours in the order of their greatest weights share one."""
    rows = with_lengths(features)
    own = weights(rows, "id").groupBy("id").agg(
        F.slice(F.sort_array(F.collect_list(F.struct(F.abs("weight").alias("size"), "weight", "pos")), asc=False), 1, 2).alias("top")
    )
    keyed = rows.join(own, "id").select(
        "id", "vector", "rating", "_length", F.col("top")[0]["pos"].alias("_p"), F.col("top")[0]["weight"].alias("_w"), F.get("top", F.lit(1))["pos"].alias("_q")
    )
    numbered = global_row_number(keyed, ["_p", "_w", "_q", "id"], "_number")
    return numbered.withColumn("block", F.floor((F.col("_number") - 1) / block_rows).cast("int")).drop("_p", "_w", "_q", "_number")


def block_bounds(blocks: DataFrame) -> DataFrame:
    """``(pos, block, high, low)``: greatest and least weight of a position in each block that uses it."""
    sizes = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("rows"))
    used = weights(blocks, "block").groupBy("pos", "block").agg(F.max("weight").alias("high"), F.min("weight").alias("low"), F.count(F.lit(1)).alias("n"))
    all_use = F.col("n") == F.col("rows")
    used = used.join(sizes, "block")
    return used.select(
        "pos",
        "block",
        F.when(all_use, F.col("high")).otherwise(F.greatest("high", F.lit(0.0))).alias("high"),
        F.when(all_use, F.col("low")).otherwise(F.least("low", F.lit(0.0))).alias("low"),
    )


def bounded(asked: DataFrame, bounds: DataFrame, n_blocks: int, slack: float | None = None) -> DataFrame:
    """``(qid, block, bound)``, the highest bound of each query and part of the blocks; with ``slack`` ``(qid, block)``, all that reach ``kth``.

    No title of a block has a higher cosine with the query than the bound. Queries and
    blocks meet in a grid, so that only what is asked for becomes rows.
    """
    by_value(kernels)
    per_block = bounds.groupBy(F.col("block").alias("id")).agg(F.collect_list(F.struct("pos", "high", "low")).alias("cells"))
    rows = asked.select("qid", "vector", *([] if slack is None else ["kth"]))
    left, right = grid(per_block, rows, blocks_of(F.lit(n_blocks), BOUND_BLOCKS), blocks_of(asked.select(F.count(F.lit(1))).scalar(), QUERY_BLOCK, BOUND_PARTS))
    right, keys, parts = right.select([F.col(name).alias(name) for name in right.columns]), BLOCK_KEYS[2:], shuffle_partitions(asked)
    found = [T.StructField("qid", asked.schema["qid"].dataType), T.StructField("block", T.IntegerType())]
    schema = T.StructType([*found, T.StructField("bound", T.DoubleType())] if slack is None else found)
    left, right = left.repartition(parts, *keys), right.repartition(parts, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(kernels.bound_finder(to_arrow_schema(schema), slack), schema)


def met(blocks: DataFrame, asked: DataFrame, wanted: DataFrame, k: int, include_self: bool, query_block: int) -> DataFrame:
    """``(qid, id, score, rating)``: the k best of each wanted block for its queries."""
    by_value(kernels)
    schema = T.StructType(
        [
            T.StructField("qid", asked.schema["qid"].dataType),
            T.StructField("id", blocks.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
            T.StructField("rating", blocks.schema["rating"].dataType),
        ]
    )
    # a block that many queries want is met in several parts
    parts = wanted.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("parts"))
    parts = broadcast_if_small(written(parts, "wanted-blocks"))
    left = blocks.join(parts, "block").withColumn("part", every(F.col("parts"))).select("block", "part", "id", "vector", "rating")
    right = wanted.join(asked.select("qid", "vector"), "qid").join(parts, "block")
    right = right.withColumn("part", part_of("qid", F.col("parts"))).select(F.col("block").alias("block"), F.col("part").alias("part"), "qid", "vector")
    n = shuffle_partitions(blocks)
    left, right = left.repartition(n, "block", "part"), right.repartition(n, "block", "part")
    run = kernels.block_scorer(to_arrow_schema(schema), kernels.CosineScorer(exclude_self=not include_self), k, ("rating",))
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(run, schema)


def pruned_neighbours(
    features: DataFrame, queries: DataFrame, k: int = 10, include_self: bool = False, block_rows: int = BLOCK_ROWS, query_block: int = QUERY_BLOCK, report: list | None = None
) -> DataFrame:
    """The k most similar titles by exact cosine: ``(qid, id, score, rank, rating)``, from the blocks that may hold them.

    ``report``, if given, gets the number of pairs of distinct vectors in the blocks that were met, and of
    all of them. Zero vectors have no cosine: they are neither found nor answered, nor are rows without an id.
    """
    titles, asked = features.filter(F.col("id").isNotNull()), queries.filter(F.col("qid").isNotNull())
    options = {"block_rows": block_rows, "query_block": query_block, "report": report}
    return cosine_by_class(titles, asked, k, include_self, nearest=nearest_by_blocks, **options)


def nearest_by_blocks(
    features: DataFrame, queries: DataFrame, k: int, include_self: bool, block_rows: int, query_block: int, report: list | None = None
) -> DataFrame:
    """``pruned_neighbours`` of every row, also where vectors are equal."""
    blocks = written(in_blocks(features.select("id", "vector", "rating"), block_rows), "cosine-blocks")
    asked = written(with_lengths(queries.select("qid", "vector")), "cosine-queries")
    n_blocks = max(1, ceil(blocks.count() / block_rows))
    bounds = written(block_bounds(blocks), "cosine-bounds")
    first = bounded(asked, bounds, n_blocks).groupBy("qid").agg(F.max_by("block", F.struct("bound", -F.col("block"))).alias("block"))
    first = written(first, "first-blocks")
    found = written(met(blocks, asked, first, k, include_self, query_block), "first-found")
    reach = found.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
    more = bounded(asked.join(reach, "qid", "left"), bounds, n_blocks, SLACK).distinct()
    more = written(more.join(first, ["qid", "block"], "left_anti"), "more-blocks")
    if report is not None:
        sizes = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("rows"))
        pairs = first.unionByName(more).join(sizes, "block").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).head()["n"]
        report.append((pairs, blocks.count() * asked.count()))
    found = found.unionByName(met(blocks, asked, more, k, include_self, query_block))
    place = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)

