"""Sums and means of numbers with a fraction that do not depend on the order of the rows.

Adding doubles rounds after every step, so partitions and retries decide the last
bits. These add whole multiples of ``10 ** -places`` in DECIMAL(38), which is exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACES = 12


def exact_sum(value: Column, places: int = PLACES) -> Column:
    """Sum of a numeric column, nulls left out; null over no value.

    Every value is rounded to ``places`` first. A NaN or an infinity among the values
    decides the sum as it does in an ordinary one; a sum of ``10 ** (38 - places)`` or
    more is an error (null without ANSI mode).
    """
    value = value.cast("double")
    ordinary = F.abs(value) < F.lit(float("inf"))  # NaN is greater than all numbers in Spark
    exact = F.sum(F.when(ordinary, value).cast(f"decimal(38,{places})")).cast("double")
    return F.when(F.count_if(~ordinary) > 0, F.sum(value)).otherwise(exact)


def exact_mean(value: Column, places: int = PLACES) -> Column:
    """Mean of a numeric column, nulls left out; null over no value."""
    return F.try_divide(exact_sum(value, places), F.count(value))
