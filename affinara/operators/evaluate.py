"""Predictions against true ratings: errors, confusion matrix, mean prediction time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinara.functions.sums import exact_mean
from affinara.functions.text import round_half_even

# The confusion matrix covers the ratings 0 to 10.
LABELS = 11


def with_actual(predictions: DataFrame, actuals: DataFrame) -> DataFrame:
    """``(id, predicted, actual)``, paired by id."""
    return predictions.select(F.col("qid").alias("id"), "predicted").join(
        actuals.select("id", F.col("rating").alias("actual")), "id"
    )


def errors(pairs: DataFrame) -> DataFrame:
    """One row: ``n``, ``mse`` and ``rmse`` over the pairs that have both values."""
    squared = F.pow(F.col("predicted") - F.col("actual"), 2)
    return pairs.agg(
        F.count(squared).alias("n"), exact_mean(squared).alias("mse"), F.sqrt(exact_mean(squared)).alias("rmse")
    )


def confusion_matrix(pairs: DataFrame) -> DataFrame:
    """``(actual, predicted, n)`` for all 11 x 11 labels; both sides rounded half-even."""
    label = lambda name: round_half_even(F.col(name)).cast("int").alias(name)
    counts = pairs.select(label("actual"), label("predicted")).groupBy("actual", "predicted").agg(
        F.count(F.lit(1)).alias("n")
    )
    cells = pairs.sparkSession.range(LABELS * LABELS).select(
        F.floor(F.col("id") / LABELS).cast("int").alias("actual"), (F.col("id") % LABELS).cast("int").alias("predicted")
    )
    return cells.join(counts, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def mean_seconds(timed: DataFrame) -> DataFrame:
    """One row: mean of the recorded prediction times."""
    return timed.agg(exact_mean(F.col("seconds")).alias("mean_seconds"))


def evaluate(predictions: DataFrame, actuals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(metrics, confusion)``."""
    pairs = with_actual(predictions, actuals)
    return errors(pairs), confusion_matrix(pairs)
