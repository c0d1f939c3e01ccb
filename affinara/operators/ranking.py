"""Exact global ranks and running totals without a one-partition window, and what builds on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from affinara.shipping import written


def in_slices(df: DataFrame, order: Sequence[str], slices: int | None = None) -> DataFrame:
    """``df`` in ranges of a total order: ``_slice`` numbers the ranges, ``_nth`` the rows inside each.

    The order must be total (end it with a unique column): then equal leading
    values do not make a large range. One range shuffle; the result is written
    once, because the range bounds come from a sample and must not be drawn twice.
    """
    if slices is None:
        slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()  # partition number above bit 33, row number below
    ordered = (
        df.repartitionByRange(slices, *order)
        .sortWithinPartitions(*order)
        .withColumn("_place", place)
        .withColumn("_slice", F.shiftright("_place", 33))
        .withColumn("_nth", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
        .drop("_place")
    )
    return written(ordered, "slices")


def shifted(sliced: DataFrame, inside: Column, slice_sum: Column, name: str) -> DataFrame:
    """Add to a value inside its slice the sum of all slices before it."""
    sums = sliced.groupBy("_slice").agg(slice_sum.alias("_sum"))
    # one row per slice here: bounded by the slice count, however many rows there are
    before = F.sum("_sum").over(W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
    starts = written(sums.select("_slice", F.coalesce(before, F.lit(0)).alias("_start")), "starts")
    return (
        sliced.withColumn("_inside", inside)
        .join(F.broadcast(starts), "_slice")
        .withColumn(name, F.col("_start") + F.col("_inside"))
        .drop("_slice", "_nth", "_start", "_inside")
    )


def global_row_number(
    df: DataFrame, order: Sequence[str], name: str = "row_number", slices: int | None = None
) -> DataFrame:
    """Row number of every row in one global order."""
    return shifted(in_slices(df, order, slices), F.col("_nth"), F.max("_nth"), name)


def running_total(
    df: DataFrame, order: Sequence[str], amount: str, name: str = "total", slices: int | None = None
) -> DataFrame:
    """Running total of an integer column in one global order."""
    inside = W.partitionBy("_slice").orderBy("_nth").rowsBetween(W.unboundedPreceding, 0)
    return shifted(in_slices(df, order, slices), F.sum(amount).over(inside), F.sum(amount), name)


def is_test(number: Column, every: int = 4) -> Column:
    return number % every == 0


def systematic_split(
    df: DataFrame, order: Sequence[str] = ("votes", "id"), every: int = 4, **options
) -> tuple[DataFrame, DataFrame]:
    """``(train, test)``: every n-th row of the order is test. Disjoint and exhaustive."""
    numbered = global_row_number(df, order, name="_number", **options)
    test = is_test(F.col("_number"), every)
    return numbered.filter(~test).drop("_number"), numbered.filter(test).drop("_number")


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    """Rows in random order, for exports that ask for it."""
    return df.orderBy(F.rand(seed))


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``(column, share, value)``: exact quantiles with linear interpolation, all columns in one pass.

    Works on the counts of distinct values, so repeated values cost one row.
    """
    return quantiles_of_counts(value_counts(df, columns), shares)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, n)``: how often each column holds each number, nulls left out."""
    return (
        df.select(
            F.explode(
                F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
            ).alias("cell")
        )
        .select("cell.column", "cell.value")
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def quantiles_of_counts(counts: DataFrame, shares: Sequence[float]) -> DataFrame:
    """``(column, share, value)`` from ``(column, value, n)``."""
    upto = running_total(counts, ["column", "value"], "n", name="upto")
    # cumulative counts within a column: subtract what came before the column
    spans = upto.groupBy("column").agg(F.sum("n").alias("all"), F.min(F.col("upto") - F.col("n")).alias("base"))
    placed = (
        upto.join(F.broadcast(spans), "column")  # one row per profiled column
        .withColumn("last", F.col("upto") - F.col("base") - 1)
        .withColumn("first", F.col("last") - F.col("n") + 1)
    )
    wanted = placed.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    at = F.col("share") * (F.col("all") - 1)
    low, high = F.floor(at), F.ceil(at)
    return (
        wanted.filter((F.col("last") >= low) & (F.col("first") <= high))
        .groupBy("column", "share")
        .agg(
            F.max(F.when((F.col("first") <= low) & (low <= F.col("last")), F.col("value"))).alias("_low"),
            F.max(F.when((F.col("first") <= high) & (high <= F.col("last")), F.col("value"))).alias("_high"),
            F.max(at - low).alias("_part"),
        )
        .select("column", "share", (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias("value"))
    )
