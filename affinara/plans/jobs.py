"""The four programs as whole jobs: paths in, tables and predictions out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinara.functions.text import cut_text
from affinara.operators import catalog as C
from affinara.operators import evaluate as E
from affinara.operators import features as Fe
from affinara.operators import lsh as L
from affinara.operators import predict as P
from affinara.operators import profile as Pr
from affinara.operators import ranking as R
from affinara.shipping import scratch_of_job, scratch_path, written
from affinara.sources import predictions as Sp
from affinara.sources import tables as St


def join_titles(
    spark: SparkSession,
    basics: str,
    crew: str,
    ratings: str,
    out: str,
    kinds: list[str] | None = None,
    single_file: bool = False,
) -> DataFrame:
    """Join the three title tables, write the joined table as TSV and return the catalog read back from it."""
    catalog = C.build_catalog(
        St.read_ratings(spark, ratings), St.read_basics(spark, basics), St.read_crew(spark, crew), kinds
    )
    St.write_tsv(St.titles_out(catalog), out, single_file)
    return C.as_catalog(St.read_titles(spark, out))


def predict_by_attributes(
    spark: SparkSession, catalog: DataFrame, queries: str, out: str, kinds: tuple[str, ...] = ("movie",), **options
) -> DataFrame:
    """Predict a file of query titles and write one report line per query: its title, known and predicted rating."""
    # the files are parsed once; the search runs once, and the caller gets its stored result
    batch, kept = written(C.as_queries(St.read_queries(spark, queries)), "queries"), scratch_path(spark, "predicted")
    with scratch_of_job(spark):
        stored = written(catalog.select("id", "kind", *P.ATTRIBUTES, "rating", "votes"), "catalog")
        P.attribute_predict(stored, batch, kinds=list(kinds), **options).distinct().write.parquet(kept)
    predicted = spark.read.parquet(kept)
    pairs = batch.select("qid", "title", F.col("rating").alias("actual")).join(predicted, "qid", "left")
    named = pairs.withColumn("id", F.coalesce("title", "qid")).withColumn("predicted", cut_text(F.col("predicted")))
    Sp.write_lines(Sp.report(named), out)
    return predicted


def prepare_features(
    spark: SparkSession, titles: str, out: str, every: int = 4, wide_text: bool = False, most_columns: int = 20_000, **options
) -> tuple[DataFrame, DataFrame]:
    """From the joined TSV: write ``features``, ``vocabulary``, ``train`` and ``test`` below ``out``.

    Parquet with sparse vectors; ``wide_text`` also writes train and test as TSV
    with one column per position, refused for more than ``most_columns`` of them.
    """
    with scratch_of_job(spark):
        catalog = written(C.as_catalog(St.read_titles(spark, titles)), "catalog")
        features, vocabulary = Fe.build_features(catalog, **options)
        features.write.parquet(f"{out}/features")
        vocabulary.write.parquet(f"{out}/vocabulary")
        stored = spark.read.parquet(f"{out}/features")
        train, test = R.systematic_split(stored, every=every)
        for name, part in (("train", train), ("test", test)):
            part.write.parquet(f"{out}/{name}")
    train, test = spark.read.parquet(f"{out}/train"), spark.read.parquet(f"{out}/test")
    if wide_text:
        # as many names as a row has columns
        rows = spark.read.parquet(f"{out}/vocabulary").orderBy("pos").limit(most_columns + 1).collect()
        if len(rows) > most_columns:
            raise ValueError(f"more than {most_columns} positions are too wide for text with one column each")
        names = Fe.column_names([row["name"] for row in rows])
        St.write_tsv(Fe.wide_features(train, names), f"{out}/train_text")
        St.write_tsv(Fe.wide_features(test, names), f"{out}/test_text")
    return train, test


def predict_by_vectors(
    train: DataFrame,
    test: DataFrame,
    out: str,
    method: str = "lsh",
    k: int = 10,
    planes: int = 25,
    bands: int = 5,
    seed: str = "",
    **options,
) -> DataFrame:
    """Predict every test title from the training titles; write one prediction line per title."""
    if method not in ("exact", "lsh"):
        raise ValueError(f"unknown method: {method}")
    spark = train.sparkSession
    batch, kept = test.withColumnRenamed("id", "qid").select("qid", "vector"), scratch_path(spark, "predicted")
    with scratch_of_job(spark):
        if method == "exact":
            predicted = P.cosine_predict(train, batch, k, **options)
        else:
            index = written(L.lsh_index(train.select("id", "vector", "rating"), planes, bands, seed), "index")
            looks = written(L.lsh_index(batch, planes, bands, seed, id_name="qid"), "batch")
            predicted = L.lsh_predict(index, looks, k, **options)
        predicted.write.parquet(kept)
    stored = spark.read.parquet(kept)
    Sp.write_lines(stored.select(Sp.line_text(F.col("qid"), F.col("predicted"))), out)
    return stored


def evaluate_file(
    spark: SparkSession, titles: str, predictions: str, layout: str = "lines"
) -> tuple[DataFrame, DataFrame]:
    """``(metrics, confusion)`` of a saved prediction file against the joined title table."""
    read = {"lines": Sp.read_lines, "tuples": Sp.read_tuples}[layout]
    parsed = read(spark, predictions)
    metrics, confusion = E.evaluate(parsed.withColumnRenamed("id", "qid"), C.as_catalog(St.read_titles(spark, titles)))
    if layout == "tuples":
        metrics = metrics.withColumn("mean_seconds", E.mean_seconds(parsed).scalar())
    return metrics, confusion


def profile_titles(spark: SparkSession, titles: str, train: DataFrame, test: DataFrame) -> dict[str, DataFrame]:
    """All summaries of the joined title table and of the split."""
    # one pass over the text; every summary then reads only its own columns
    stored = written(
        C.as_catalog(St.read_titles(spark, titles)).select("flag", *Pr.NUMBERS, *C.LISTS), "titles"
    )
    return Pr.profile(stored, train, test)
