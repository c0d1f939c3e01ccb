"""Title tables as tab-separated text."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinara.sources.one_file import shared_file, write_one_file

# The columns of the title tables.
RATINGS = "tconst STRING, averageRating DOUBLE, numVotes INT"
BASICS = (
    "tconst STRING, titleType STRING, primaryTitle STRING, originalTitle STRING, isAdult INT, "
    "startYear INT, endYear INT, runtimeMinutes INT, genres STRING"
)
CREW = "tconst STRING, directors STRING, writers STRING"
QUERIES = (
    "averageRating STRING, titleType STRING, originalTitle STRING, isAdult INT, runtimeMinutes INT, "
    "genres STRING, directors STRING, writers STRING"
)
TITLES = (
    "tconst STRING, averageRating DOUBLE, numVotes INT, titleType STRING, originalTitle STRING, isAdult INT, "
    "runtimeMinutes INT, genres STRING, directors STRING, writers STRING"
)


def read_tsv(spark: SparkSession, path: str, schema: str | T.StructType, header: bool = True) -> DataFrame:
    """Tab-separated text with a declared schema. Quotes are plain characters in these files."""
    return (
        spark.read.schema(schema)
        .option("sep", "\t")
        .option("header", header)
        .option("quote", "")
        .option("enforceSchema", True)
        .csv(path)
    )


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, RATINGS)


def read_basics(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, BASICS).drop("primaryTitle", "startYear", "endYear")


def read_crew(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, CREW)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, QUERIES, header=False)


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """Joined title table, columns by position."""
    return read_tsv(spark, path, TITLES)


def feature_schema(names: list[str]) -> T.StructType:
    """Schema of a wide feature table; every feature is a number, never text."""
    return T.StructType(
        [
            T.StructField("id", T.StringType()),
            T.StructField("rating", T.DoubleType()),
            T.StructField("votes", T.LongType()),
            T.StructField("title", T.StringType()),
            *[T.StructField(name, T.DoubleType()) for name in names],
        ]
    )


def read_features(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Wide feature table; positions come from the vocabulary's names."""
    return read_tsv(spark, path, feature_schema(names))


# Tab-separated text without quoting.
PLAIN = {"sep": "\t", "quote": "", "escape": "", "emptyValue": ""}


def write_tsv(
    df: DataFrame,
    path: str,
    single_file: bool = False,
    mode: str = "errorifexists",
    header: bool = True,
    order: list[str] | None = None,
) -> None:
    """Tab-separated text, one file per task.

    ``single_file`` makes a new folder with one file, header once, rows in ``order`` (all
    columns by default), written by all tasks at once; it needs a mounted folder.
    """
    if not single_file:
        df.write.mode(mode).options(**PLAIN, header=header).csv(path)
        return
    if mode != "errorifexists":
        raise ValueError("a single file is only written to a new folder")
    if os.path.exists(shared_file(df.sparkSession, path)):
        raise FileExistsError(f"{path} already exists")
    names = "\t".join(df.columns) + "\n" if header else ""
    write_one_file(df, f"{path}/part-00000.csv", F.to_csv(F.struct("*"), PLAIN), order or df.columns, before=names)


def titles_out(catalog: DataFrame) -> DataFrame:
    """Catalog in the joined table's columns, lists as comma text."""
    from affinara.functions.text import join_list
    from affinara.operators.catalog import LISTS, NAMES

    back = {new: old for old, new in NAMES.items()}
    return catalog.select(
        *[F.col(name).alias(back[name]) for name in ("id", "rating", "votes", "kind", "title", "flag", "runtime")],
        *[F.when(F.col(name).isNotNull(), join_list(F.col(name))).alias(name) for name in LISTS],
    )
