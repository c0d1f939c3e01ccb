"""The title catalog: ratings, basics and crew in one table with list columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinara.functions.text import MISSING, split_list

LISTS = ["genres", "directors", "writers"]

# Library column names for the title tables' column names.
NAMES = {
    "tconst": "id",
    "averageRating": "rating",
    "numVotes": "votes",
    "titleType": "kind",
    "originalTitle": "title",
    "isAdult": "flag",
    "runtimeMinutes": "runtime",
}


def build_catalog(
    ratings: DataFrame, basics: DataFrame, crew: DataFrame, kinds: list[str] | None = None
) -> DataFrame:
    """Rated titles with their attributes; titles without a rating or crew row drop out."""
    if kinds is not None:
        basics = basics.filter(F.col("titleType").isin(*kinds))
    joined = ratings.join(basics, "tconst").join(crew, "tconst")
    return as_catalog(joined)


def as_catalog(titles: DataFrame) -> DataFrame:
    """Joined title rows (from TSV) with library names and lists split into arrays."""
    return with_lists(
        titles.select([F.col(old).alias(new) for old, new in NAMES.items() if old in titles.columns] + LISTS)
    )


def as_queries(titles: DataFrame) -> DataFrame:
    """Query titles (8 columns, no id) as a query batch; ``qid`` is a digest of the row's own content.

    Equal rows share a ``qid``: a prediction scores them once and returns a row for each.
    """
    content = [F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in titles.columns]
    return with_lists(
        titles.select(
            F.sha2(F.concat_ws("\t", *content), 256).alias("qid"),
            *[F.col(old).alias(new) for old, new in NAMES.items() if old in titles.columns],
            *LISTS,
        )
    )


def with_lists(df: DataFrame) -> DataFrame:
    return df.withColumns({name: split_list(F.col(name)) for name in LISTS})


def only_kinds(catalog: DataFrame, *kinds: str) -> DataFrame:
    return catalog.filter(F.col("kind").isin(*kinds))


def rows_with_ids(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id occurs in ``ids``: one join for the whole batch, repeats added up before the shuffle."""
    return catalog.join(ids.select("id").distinct(), "id", "left_semi")
