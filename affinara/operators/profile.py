"""Summaries of a title catalog: column statistics, distinct counts, histograms, frequencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinara.functions.sums import exact_mean, exact_sum
from affinara.functions.text import join_list
from affinara.operators.features import token_counts, top_tokens
from affinara.operators.ranking import quantiles, quantiles_of_counts
from affinara.shipping import written

NUMBERS = ["rating", "runtime", "votes"]
LISTS = ["genres", "directors", "writers"]
SHARES = {"q1": 0.25, "q2": 0.5, "q3": 0.75}


def column_summary(
    catalog: DataFrame, columns: Sequence[str] = tuple(NUMBERS), accuracy: int | None = None
) -> DataFrame:
    """Per column: ``n, mean, max, min, std, q1, q2, q3``; nulls left out.

    Exact by default, to the same bits in whatever order rows come. With an ``accuracy``
    the quartiles come from ``percentile_approx`` (a rank error of at most 1/accuracy) and
    the deviation from running moments, in the same single pass as the rest.
    """
    cells = catalog.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
        ).alias("cell")
    ).select("cell.column", "cell.value")
    basics = [
        F.count("value").alias("n"),
        exact_mean(F.col("value")).alias("mean"),
        F.max("value").alias("max"),
        F.min("value").alias("min"),
    ]
    if accuracy is not None:
        near = [F.percentile_approx("value", share, accuracy).alias(name) for name, share in SHARES.items()]
        return cells.groupBy("column").agg(*basics, F.stddev_samp("value").alias("std"), *near)
    # one row for each named column
    basic = F.broadcast(cells.groupBy("column").agg(*basics))
    squares = exact_sum(F.pow(F.col("value") - F.col("mean"), 2))
    basic = cells.join(basic, "column").groupBy("column", "n", "mean", "max", "min").agg(squares.alias("squares"))
    deviation = F.when(F.col("n") > 1, F.sqrt(F.col("squares") / (F.col("n") - 1)))
    basic = basic.select("column", "n", "mean", "max", "min", deviation.alias("std"))
    return basic.join(quartile_columns(quantiles(catalog, columns, list(SHARES.values()))), "column", "left")


def quartile_columns(found: DataFrame) -> DataFrame:
    return found.groupBy("column").agg(*[F.max(F.when(F.col("share") == s, F.col("value"))).alias(name) for name, s in SHARES.items()])


def flagged_count(catalog: DataFrame) -> DataFrame:
    """One row: number of titles with the flag set."""
    return catalog.agg(F.count_if(F.col("flag") == 1).alias("flagged"))


def distinct_counts(
    catalog: DataFrame,
    names: Sequence[str] = ("genres", "directors", "writers"),
    relative_error: float | None = None,
) -> DataFrame:
    """``(list, n_distinct)`` per list column, the missing mark counted as a value; one pass over the catalog.

    Exact by default; with a ``relative_error`` (standard deviation) from a sketch, without shuffling the values.
    """
    items = [
        F.transform(F.coalesce(F.col(name), F.array().cast("array<string>")), _tagged(name)) for name in names
    ]
    found = catalog.select(F.explode(F.concat(*items)).alias("item")).select("item.list", "item.token")
    if relative_error is not None:
        return found.groupBy("list").agg(F.approx_count_distinct("token", relative_error).alias("n_distinct"))
    return found.distinct().groupBy("list").agg(F.count(F.lit(1)).alias("n_distinct"))


def _tagged(name: str):
    return lambda t: F.struct(F.lit(name).alias("list"), t.alias("token"))


def histogram(df: DataFrame, name: str, bins: int = 10, times: str | None = None) -> DataFrame:
    """``(bin, low, high, n)``: equal-width bins from min to max; the last bin is closed, empty bins stay.

    A row counts once, or as often as its column ``times`` says.

    A value's bin is settled by comparing it with the bin edges, because
    one-decimal ratings lie on them and division alone may miss by one.
    """
    value = F.col(name).cast("double")
    low, high = F.min(value), F.max(value)
    spread = F.when(low == high, F.lit(0.5)).otherwise(F.lit(0.0))
    bounds = df.agg(F.struct((low - spread).alias("low"), (high + spread).alias("high"))).scalar()
    width = (F.col("bounds.high") - F.col("bounds.low")) / F.lit(float(bins))
    last = F.lit(bins - 1)

    def edge(i):
        return F.col("bounds.low") + i * width

    guess = F.col("guess")
    place = (
        F.when(F.col("value") < edge(guess), guess - 1)
        .when((guess < last) & (F.col("value") >= edge(guess + 1)), guess + 1)
        .otherwise(guess)
    )
    counts = (
        df.select(value.alias("value"), (F.lit(1) if times is None else F.col(times)).alias("times"))
        .filter(F.col("value").isNotNull())
        .withColumn("bounds", bounds)
        .withColumn("guess", F.least(F.floor((F.col("value") - F.col("bounds.low")) / width).cast("int"), last))
        .groupBy(place.alias("bin"))
        .agg(F.sum("times").alias("n"))
    )
    frame = (
        df.sparkSession.range(bins)
        .withColumn("bounds", bounds)
        .select(
            F.col("id").cast("int").alias("bin"),
            edge(F.col("id")).alias("low"),
            F.when(F.col("id") == last, F.col("bounds.high")).otherwise(edge(F.col("id") + 1)).alias("high"),
        )
    )
    return frame.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def token_frequency(catalog: DataFrame, name: str = "genres") -> DataFrame:
    """``(token, n)`` over all titles."""
    return token_counts(catalog, name)


def most_frequent(catalog: DataFrame, name: str = "directors", limit: int = 20) -> DataFrame:
    """``(token, n)``: the most frequent items, the missing mark counted as a value."""
    return top_tokens(catalog, name, limit, exclude=())


def raw_list_ranks(catalog: DataFrame, name: str = "directors", first: int = 2, last: int = 101) -> DataFrame:
    """``(value, n)``: unsplit list strings ranked ``first`` to ``last`` by frequency."""
    counts = (
        catalog.filter(F.col(name).isNotNull())
        .groupBy(join_list(F.col(name)).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.orderBy(F.desc("n"), "value").offset(first - 1).limit(last - first + 1)


def profile_counts(catalog: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """``(source, name, number, token, n)``: how often each value occurs, for all summaries at once.

    Each table is scanned once, and what repeats is added up before it is shuffled.
    """
    text, number = (lambda c: c.cast("string")), (lambda c: c.cast("double"))
    none = F.lit(None)

    def tagged(source, name, value=none, token=none):
        return F.struct(F.lit(source).alias("source"), F.lit(name).alias("name"), number(value).alias("number"), text(token).alias("token"))

    whole = [tagged("number", c, value=F.col(c)) for c in NUMBERS]
    whole += [tagged("flag", "flag", value=F.when(F.col("flag") == 1, 1)), tagged("raw", "directors", token=join_list(F.col("directors")))]
    def listed(name):
        return F.transform(F.coalesce(name, F.array().cast("array<string>")), lambda t: tagged("item", name, token=t))

    items = [listed(c) for c in LISTS]
    cells = catalog.select(F.explode(F.concat(F.array(*whole), *items)).alias("c"))
    for source, rows in (("train", train), ("test", test)):
        cells = cells.unionByName(rows.select(tagged(source, "rating", value=F.col("rating")).alias("c")))
    known = F.col("number").isNotNull() | F.col("token").isNotNull() | (F.col("source") == "item")
    return cells.select("c.*").filter(known).groupBy("source", "name", "number", "token").agg(F.count(F.lit(1)).alias("n"))


def profile(catalog: DataFrame, train: DataFrame, test: DataFrame) -> dict[str, DataFrame]:
    """All summaries by name, from one table of counts of distinct values: each input is scanned once."""
    counts = written(profile_counts(catalog, train, test), "profile-counts")
    of = lambda source: counts.filter(F.col("source") == source)
    numbers = of("number").select(F.col("name").alias("column"), F.col("number").alias("value"), "n")
    listed = lambda name: of("item").filter(F.col("name") == name).select("token", "n")
    ratings = {"all": numbers.filter(F.col("column") == "rating"), **{part: of(part).select(F.col("number").alias("value"), "n") for part in ("train", "test")}}
    raw = of("raw").select(F.col("token").alias("value"), "n")
    return {
        "summary": summary_of_counts(counts.sparkSession, numbers),
        "flagged": of("flag").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("flagged")),
        "distinct": of("item").groupBy(F.col("name").alias("list")).agg(F.count(F.lit(1)).alias("n_distinct")),
        **{f"histogram_{part}": histogram(rows, "value", times="n") for part, rows in ratings.items()},
        "genre_frequency": listed("genres"),
        "top_directors": listed("directors").orderBy(F.desc("n"), "token").limit(20),
        "raw_directors": raw.orderBy(F.desc("n"), "value").offset(1).limit(100),
    }


def summary_of_counts(spark: SparkSession, numbers: DataFrame) -> DataFrame:
    """``column_summary`` from ``(column, value, n)``; exact sums, so its bits are those of the rows' own summary."""
    times = F.col("n").cast("decimal(10,0)")
    total = F.sum(F.col("value").cast("decimal(26,12)") * times).cast("double")
    basic = numbers.groupBy("column").agg(
        F.sum("n").alias("n"), F.try_divide(total, F.sum("n")).alias("mean"), F.max("value").alias("max"), F.min("value").alias("min")
    )
    names = spark.createDataFrame([(c,) for c in NUMBERS], "column string")
    # one row for each profiled column
    basic = F.broadcast(names.join(basic, "column", "left").withColumn("n", F.coalesce("n", F.lit(0))))
    square = F.pow(F.col("value") - F.col("mean"), 2)
    squares = F.sum(square.cast("decimal(26,12)") * times).cast("double")
    spread = numbers.withColumnRenamed("n", "times").join(basic.select("column", "mean"), "column").withColumnRenamed("times", "n")
    spread = spread.groupBy("column").agg(squares.alias("squares"))
    found = basic.join(spread, "column", "left")
    deviation = F.when(F.col("n") > 1, F.sqrt(F.col("squares") / (F.col("n") - 1)))
    found = found.select("column", "n", "mean", "max", "min", deviation.alias("std"))
    return found.join(quartile_columns(quantiles_of_counts(numbers, list(SHARES.values()))), "column", "left")
