"""Approximate summaries that add up: sketches stored for each batch of titles, merged when they are asked for.

A batch (a day's titles, one file) leaves a few rows of fixed size behind, whatever
its length. Distinct counts and quantiles of any set of batches come from merging
their sketches; no title is read again. Writing a batch once more replaces it.

Errors: the distinct count has a standard error of ``1.04 / sqrt(2 ** LG_K)``, under
1 %; a quantile's rank is off by at most ``RANK_ERROR`` in 99 of 100 cases.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinara.operators.profile import LISTS, NUMBERS

LG_K = 14
KLL_K = 400
RANK_ERROR = 0.01
DISTINCT_ERROR = 0.03  # more than three standard errors
SCHEMA = "kind string, name string, n long, sketch binary, batch string"


def sketched(catalog: DataFrame, numbers: Sequence[str] = tuple(NUMBERS), lists: Sequence[str] = tuple(LISTS)) -> DataFrame:
    """``(kind, name, n, sketch)``: one row for each number column and each list column; nulls left out."""

    def tagged(name):
        return F.transform(F.coalesce(name, F.array().cast("array<string>")), lambda t: F.struct(F.lit(name).alias("name"), t.alias("token")))

    items = catalog.select(F.explode(F.concat(*map(tagged, lists))).alias("c")).select("c.name", "c.token")
    values = catalog.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in numbers])).alias("c"))
    values = values.select("c.name", "c.value").filter(F.col("value").isNotNull() & ~F.isnan("value"))
    distinct = items.groupBy("name").agg(F.count("token").alias("n"), F.hll_sketch_agg("token", LG_K).alias("sketch"))
    quantile = values.groupBy("name").agg(F.count("value").alias("n"), F.kll_sketch_agg_double("value", KLL_K).alias("sketch"))
    rows = distinct.withColumn("kind", F.lit("distinct")).unionByName(quantile.withColumn("kind", F.lit("quantile")))
    return rows.select("kind", "name", "n", "sketch")


def store(catalog: DataFrame, path: str, batch: str, **columns) -> None:
    """Keep a batch's sketches in a folder of their own."""
    sketched(catalog, **columns).withColumn("batch", F.lit(batch)).coalesce(1).write.mode("overwrite").parquet(f"{path}/{batch}")


def stored(spark: SparkSession, path: str, batches: Sequence[str]) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(*[f"{path}/{b}" for b in batches])


def distinct_estimates(rows: DataFrame) -> DataFrame:
    """``(list, n_distinct)`` of all batches together."""
    merged = rows.filter("kind = 'distinct'").groupBy(F.col("name").alias("list")).agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.select("list", F.hll_sketch_estimate("sketch").alias("n_distinct"))


def quantile_estimates(rows: DataFrame, shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``(column, share, value)`` of all batches together."""
    merged = rows.filter("kind = 'quantile'").groupBy(F.col("name").alias("column")).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    values = F.array(*[F.struct(F.lit(float(s)).alias("share"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(s))).alias("value")) for s in shares])
    return merged.select("column", F.explode(values).alias("v")).select("column", "v.share", "v.value")
