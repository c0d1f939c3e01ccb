"""The driver's tables in the shape of a title catalog and of feature vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinara.functions.text import MISSING, split_list
from affinara.shipping import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lists_per_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part: rating, votes, and the suppliers of first and second lines as comma text.

    Lines are first added up per part and supplier of interest, so a part with a
    third of all lines is spread over its suppliers before it is put together.
    """
    number, listed = F.col("l_linenumber"), F.col("l_linenumber").isin(1, 2)
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            "l_partkey", F.when(listed, number).alias("number"), F.when(listed, F.col("l_suppkey")).alias("supplier")
        )
        .agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("lines"))
    )

    def suppliers(line_number: int):
        found = F.array_sort(F.collect_list(F.when(F.col("number") == line_number, F.col("supplier").cast("string"))))
        return F.when(F.size(found) > 0, F.concat_ws(",", found)).otherwise(MISSING)

    return lines.groupBy("l_partkey").agg(
        F.round(F.sum("quantity") / F.sum("lines") / 5, 4).alias("rating"),
        F.sum("lines").alias("votes"),
        suppliers(1).alias("directors"),
        suppliers(2).alias("writers"),
    )


def title_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows with lists still as comma text."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_type").alias("kind"),
        F.col("p_name").alias("title"),
        (F.col("p_size") % 2).alias("flag"),
        F.when(F.col("p_size") % 10 != 0, F.col("p_size")).alias("runtime"),
        F.replace(F.col("p_name"), F.lit(" "), F.lit(",")).alias("genres"),
    )
    made = lists_per_part(spark, sf_dir)
    return part.join(made, part["id"] == made["l_partkey"]).drop("l_partkey")


def stored_catalog(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The named columns of the catalog as a written table, for jobs that read it several times."""
    return written(catalog(spark, sf_dir).select(*columns), "catalog")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = ["genres", "directors", "writers"]
    return title_rows(spark, sf_dir).withColumns({name: split_list(F.col(name)) for name in lists})


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a feature table: the label plays the rating."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("double").alias("rating")
    )


def hard_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog with what real tables hold too: null titles, null lists and repeated items."""
    genres = F.when(F.col("id") % 7 == 0, F.concat("genres", F.slice("genres", 1, 1))).otherwise(F.col("genres"))
    return catalog(spark, sf_dir).withColumns(
        {
            "title": F.when(F.col("id") % 11 != 0, F.col("title")),
            "genres": F.when(F.col("id") % 13 != 0, genres),
        }
    )


def hard_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors, one in seventeen of them all zero."""
    zero = F.transform("vector", lambda x: x * F.lit(0.0).cast("float"))
    return vectors(spark, sf_dir).withColumn("vector", F.when(F.col("id") % 17 == 0, zero).otherwise(F.col("vector")))


def as_batch(rows: DataFrame) -> DataFrame:
    """Rows as a query batch."""
    return rows.withColumnRenamed("id", "qid")
