"""Attribute similarity of two titles as column expressions.

These score pairs that already sit in one row. ``operators.predict`` uses them for the
pairs that share a person, and ``kernels.AttributeScorer`` scores blocks of groups by the
same formula.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from affinara.functions.text import MISSING, int_or_zero


@dataclass(frozen=True)
class Weights:
    # The published attribute weights.
    flag: float = 1.0
    runtime: float = 1.0
    genres: float = 1.2
    writers: float = 2.0
    directors: float = 2.0

    @property
    def total(self) -> float:
        return self.flag + self.runtime + self.directors + self.writers + self.genres


def flag_similarity(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).otherwise(0.0)


def runtime_similarity(a: Column, b: Column) -> Column:
    """1 - |a-b| / (a+b+0.01); a missing runtime counts as 0 minutes."""
    x, y = int_or_zero(a), int_or_zero(b)
    return 1.0 - F.abs(x - y) / (x + y + F.lit(0.01))


def _numbered(items: Column) -> Column:
    """Items with their occurrence number, so that repeats stay apart in set functions."""
    return F.when(
        F.size(F.array_distinct(items)) == F.size(items),
        F.transform(items, lambda x: F.struct(x.alias("item"), F.lit(1).alias("nth"))),
    ).otherwise(
        F.transform(
            items,
            lambda x, i: F.struct(
                x.alias("item"),
                F.size(F.filter(F.slice(items, F.lit(1), i + 1), lambda y: y == x)).alias("nth"),
            ),
        )
    )


def counted(items: Column) -> Column:
    """Items as texts with their occurrence number: without repeats, and compared faster than ``_numbered`` ones."""
    return F.transform(_numbered(items), lambda x: F.concat_ws(":", x["nth"].cast("string"), x["item"]))


def counted_overlap(a: Column, b: Column, mode: str = "ratio") -> Column:
    """``list_overlap`` of two lists that ``counted`` made of known items."""
    common, longer = F.size(F.array_intersect(a, b)), F.greatest(F.size(a), F.size(b))
    if mode == "exact":
        return F.when((longer > 0) & (common == longer), 1.0).otherwise(0.0)
    return F.coalesce(F.try_divide(common.cast("double"), longer.cast("double")), F.lit(0.0))


def multiset_common(a: Column, b: Column) -> Column:
    """Number of items two lists share, counting repeats."""
    return F.size(F.array_intersect(_numbered(a), _numbered(b)))


def list_overlap(a: Column, b: Column, mode: str = "ratio") -> Column:
    """Shared items over the longer list's length; 0.0 if a list is null or holds the missing mark.

    ``mode="exact"`` gives 1.0 only for lists equal as multisets, else 0.0.
    """
    known = (
        a.isNotNull()
        & b.isNotNull()
        & ~F.array_contains(a, MISSING)
        & ~F.array_contains(b, MISSING)
    )
    if mode == "exact":
        value = F.when((F.size(a) > 0) & (F.array_sort(a) == F.array_sort(b)), 1.0).otherwise(0.0)
    elif mode == "ratio":
        value = F.coalesce(
            F.try_divide(multiset_common(a, b).cast("double"), F.greatest(F.size(a), F.size(b)).cast("double")),
            F.lit(0.0),
        )
    else:
        raise ValueError(f"unknown overlap mode: {mode}")
    return F.when(known, value).otherwise(0.0)


def attribute_score(a, b, weights: Weights = Weights(), overlap: str = "ratio", of_lists=list_overlap) -> Column:
    """Weighted attribute similarity in [0, 1]; ``a`` and ``b`` map an attribute name to its column."""
    return (
        weights.flag * flag_similarity(a("flag"), b("flag"))
        + weights.runtime * runtime_similarity(a("runtime"), b("runtime"))
        + weights.genres * of_lists(a("genres"), b("genres"), overlap)
        + weights.writers * of_lists(a("writers"), b("writers"), overlap)
        + weights.directors * of_lists(a("directors"), b("directors"), overlap)
    ) / weights.total
