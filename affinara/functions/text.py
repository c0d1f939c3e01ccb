"""Text and number columns: list strings, missing marks, rounding, report text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the mark for "missing" in the title tables.
MISSING = "\\N"


def split_list(col: Column) -> Column:
    """Comma list to array. Trailing empty items are dropped, null stays null."""
    return F.when(col.rlike("^,+$"), F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace(col, ",+$", ""), ",")
    )


def join_list(col: Column) -> Column:
    """Array to comma list."""
    return F.concat_ws(",", col)


def int_or_zero(col: Column) -> Column:
    """Integer value of a text or number, 0 where it is missing."""
    return F.coalesce(col.try_cast("int"), F.lit(0))


def decimal_comma(col: Column) -> Column:
    """``7,0`` or ``7.0`` to a double; null where it is no number."""
    return F.replace(col, F.lit(","), F.lit(".")).try_cast("double")


def cut_text(col: Column, length: int = 3) -> Column:
    """First characters of a number's text form: cuts, does not round (6.79 -> 6.7)."""
    return F.substring(col.cast("string"), 1, length)


def round_half_up(col: Column, scale: int = 1) -> Column:
    return F.round(col, scale)


def round_half_even(col: Column, scale: int = 0) -> Column:
    return F.bround(col, scale)
