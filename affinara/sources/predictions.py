"""Prediction files: one prediction per line, or tuples on one long line; and the report text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinara.functions.text import decimal_comma
from affinara.sources.one_file import write_one_file

# The two layouts' separators.
LINE_SEPARATOR = ": "
TUPLE_SEPARATOR = ", "
# Written in place of a prediction that could not be made; the parsers read it as null.
NO_PREDICTION = "none"


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``(id, predicted)`` from ``... <id>: 7,0``; lines that do not split in two are left out."""
    parts = F.split(F.trim(F.col(column)), LINE_SEPARATOR)
    return (
        lines.filter(F.size(parts) == 2)
        .select(
            F.element_at(F.split(F.trim(parts[0]), r"\s+"), -1).alias("id"),
            decimal_comma(parts[1]).alias("predicted"),
        )
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def parse_tuples(pieces: DataFrame, column: str = "value") -> DataFrame:
    """``(id, predicted, seconds)`` from pieces ``(id,rating,seconds)``, with or without brackets around."""
    fields = F.split(F.regexp_replace(F.col(column), r"^[()\s]+|[()\s]+$", ""), ",")
    return pieces.filter(F.size(fields) >= 3).select(
        F.trim(fields[0]).alias("id"),
        F.trim(fields[1]).try_cast("double").alias("predicted"),
        F.trim(fields[2]).try_cast("double").alias("seconds"),
    )


def read_tuples(spark: SparkSession, path: str) -> DataFrame:
    """The long line is split while it is read, so it never has to fit in one task."""
    return parse_tuples(spark.read.option("lineSep", TUPLE_SEPARATOR).text(path))


def line_text(id_col: Column, predicted: Column) -> Column:
    """``Predicted Rating for <id>: 7,0``; without a prediction ``Predicted Rating for <id>: none``."""
    shown = F.replace(F.format_string("%.1f", predicted), F.lit("."), F.lit(","))
    return F.concat(
        F.lit("Predicted Rating for "),
        id_col.cast("string"),
        F.lit(LINE_SEPARATOR),
        F.when(predicted.isNotNull(), shown).otherwise(NO_PREDICTION),
    )


def tuple_text(id_col: Column, predicted: Column, seconds: Column) -> Column:
    """``(<id>,<rating>,<seconds>)``."""
    return F.concat(
        F.lit("("),
        F.concat_ws(",", id_col.cast("string"), predicted.cast("string"), seconds.cast("string")),
        F.lit(")"),
    )


def write_lines(text: DataFrame, path: str) -> None:
    text.write.text(path)


def write_tuples(text: DataFrame, path: str) -> None:
    """Tuples in as many files as tasks, without brackets around them: ``read_tuples`` takes a whole folder.

    A reader that expects all tuples on one bracketed line reads what ``write_one_line`` makes.
    """
    text.write.option("lineSep", TUPLE_SEPARATOR).text(path)


def write_one_line(text: DataFrame, path: str, order: list[str], column: str = "value") -> None:
    """All tuples in order on one bracketed line of one file: ``((a,7.0,2.0), (b,6.0,2.5))``."""
    write_one_file(text, path, F.col(column), order, before="(", separator=TUPLE_SEPARATOR, after=")", closed=False)


def report(pairs: DataFrame) -> DataFrame:
    """Report lines ``(id, actual, predicted)`` as text, one row per query; missing values as ``NaN``.

    Lines have no order, so each names its query.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("NaN"))
    return pairs.select(
        F.concat(
            shown("id"), F.lit("\tactual "), shown("actual"), F.lit("\tpredicted "), shown("predicted")
        ).alias("value")
    )


def write_array(rows: DataFrame, path: str, value: str, order: list[str]) -> None:
    """One file with all values on one line, ``Array(a, b, ...)``, in ``order``; missing values as ``NaN``."""
    shown = F.coalesce(F.col(value).cast("string"), F.lit("NaN"))
    write_one_file(rows, path, shown, order, before="Array(", separator=TUPLE_SEPARATOR, after=")\n", closed=False)


def write_array_report(pairs: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A new folder with the true and the predicted ratings of ``(id, actual, predicted)``, one ``Array(...)`` file each.

    Both are in the same order, so the n-th values of the two files belong together if the order is total.
    """
    for name in ("actual", "predicted"):
        write_array(pairs, f"{path}/{name}.txt", name, order or ["id"])


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """``(value)``, one row for each value of an ``Array(...)`` file, in no order; ``NaN`` is null."""
    items = spark.read.option("lineSep", TUPLE_SEPARATOR).text(path)
    bare = F.regexp_replace("value", r"^\s*Array\(|\)\s*$", "")
    return items.select(F.when(bare != "NaN", bare).alias("value")).filter((bare != "") | bare.isNull())
