"""A stored LSH index: buckets laid out on disk, searched where they lie, extended batch by batch.

Every generation (the first titles, then one for each appended batch) is a table with
one row for each title and band, bucketed and sorted by ``cell``, a hash of band, key
and part. A batch of queries is dealt by the same hash, so the titles are read and
joined without a shuffle, and a file holds only its own cells. A bucket of many titles
is several parts, so no file gets a whole hot bucket. Each generation has its bucket
sizes beside it; a search adds them up, which gives the sizes of the whole.

A generation counts once its row stands in ``generations``, so a job that dies
half-way leaves the index as it was. Compaction writes one generation in place of all;
searches that run meanwhile go on with the old ones, whose files stay.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from affinara import kernels
from affinara.functions.text import round_half_up
from affinara.operators import lsh as L
from affinara.operators.predict import for_every_query, k_first, mean_rating
from affinara.shipping import by_value, join_spread, written

PART_ROWS = 4096
MANIFEST = "generation string, number int, replaces array<string>, files int, planes int, bands int, seed string, titles long"


def generations(spark: SparkSession, path: str) -> list:
    """The rows of the generations that count, oldest first."""
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/generations").orderBy("number").collect()  # one row a batch
    replaced = {name for row in rows for name in row["replaces"]}
    return [row for row in rows if row["generation"] not in replaced]


def create(features: DataFrame, path: str, planes: int = 25, bands: int = 5, seed: str = "", files: int = 64) -> None:
    """A new index of ``(id, vector, rating)``."""
    _add(L.lsh_index(features.select("id", "vector", "rating"), planes, bands, seed), path, 0, [], files, planes, bands, seed)


def append(features: DataFrame, path: str) -> None:
    """Add titles that the index does not hold yet, as a generation of their own."""
    known = generations(features.sparkSession, path)
    last = known[-1]
    rows = L.lsh_index(features.select("id", "vector", "rating"), last["planes"], last["bands"], last["seed"])
    _add(rows, path, last["number"] + 1, [], last["files"], last["planes"], last["bands"], last["seed"])


def compact(spark: SparkSession, path: str) -> None:
    """One generation in place of all."""
    known = generations(spark, path)
    last = known[-1]
    # a title's rows differ in the band only; its keys make it whole again
    titles = None
    for row in known:
        part = table(spark, path, row).filter(F.col("band") == 0).select("id", "vector", "rating", "band_keys")
        titles = part if titles is None else titles.unionByName(part)
    _add(titles, path, last["number"] + 1, [r["generation"] for r in known], last["files"], last["planes"], last["bands"], last["seed"])


def _add(index: DataFrame, path, number, replaces, files, planes, bands, seed) -> None:
    spark, name = index.sparkSession, uuid.uuid4().hex
    index = written(index, "indexed")
    sizes = L.bucket_sizes(index).withColumn("parts", F.ceil(F.col("size") / PART_ROWS).cast("int"))
    sizes.write.parquet(f"{path}/{name}/sizes")
    sizes = spark.read.schema(sizes.schema).parquet(f"{path}/{name}/sizes")
    rows = join_spread(L.in_bands(index), sizes.select("band", "band_key", "parts"), L.BLOCK_KEYS[:2], "id")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("cell", cell())
    rows = rows.select("cell", "band", "band_key", "id", "vector", "rating", F.when(F.col("band") == 0, F.col("band_keys")).alias("band_keys"))
    # one file a bucket: rows are dealt as the files are
    rows.repartition(files, "cell").write.bucketBy(files, "cell").sortBy("cell").option("path", f"{path}/{name}/titles").saveAsTable(_name(path, name))
    row = (name, number, replaces, files, planes, bands, seed, index.count())
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/generations")


def cell():
    return F.xxhash64("band", "band_key", "part")


def _name(path: str, generation: str) -> str:
    return f"lsh_{hashlib.md5(path.encode()).hexdigest()[:8]}_{generation}"


def table(spark: SparkSession, path: str, row) -> DataFrame:
    """A generation's titles; a session that has not written them learns of the layout first."""
    name = _name(path, row["generation"])
    if not spark.catalog.tableExists(name):
        location = f"{path}/{row['generation']}/titles"
        schema = spark.read.parquet(location).schema
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (cell) SORTED BY (cell) INTO {row['files']} BUCKETS LOCATION '{location}'")
    return spark.table(name)


def sizes_of(spark: SparkSession, path: str, row) -> DataFrame:
    return spark.read.schema("band int, band_key long, size long, parts int").parquet(f"{path}/{row['generation']}/sizes")


def neighbours(queries: DataFrame, path: str, k: int = 10, max_share: float = 0.5, include_self: bool = False) -> DataFrame:
    """The k best among each query's candidates: ``(qid, id, score, rating, rank)``, as ``lsh.lsh_neighbours`` gives them."""
    spark = queries.sparkSession
    by_value(kernels)
    known = generations(spark, path)
    last = known[-1]
    batch = written(L.lsh_index(queries.select("qid", "vector"), last["planes"], last["bands"], last["seed"], id_name="qid"), "batch")
    sizes = None
    for row in known:
        own = sizes_of(spark, path, row)
        sizes = own if sizes is None else sizes.unionByName(own)
    total = written(sizes.groupBy("band", "band_key").agg(F.sum("size").alias("size")), "sizes")
    looks = L.look_rows(L.looked_into(None, batch, ["vector"], max_share, total)).drop("kept", "rows_c")
    found = None
    for row in known:
        met = _met(looks, table(spark, path, row), sizes_of(spark, path, row), k, include_self)
        found = met if found is None else found.unionByName(met)
    # a pair that was met in several buckets counts once
    found = found.groupBy("qid", "id").agg(F.max("score").alias("score"), F.first("rating").alias("rating"))
    return k_first(found, "qid", k)


def _met(looks: DataFrame, titles: DataFrame, sizes: DataFrame, k: int, include_self: bool) -> DataFrame:
    """``(qid, id, score, rating)``: each query's k best titles of every cell it looks into; cells are dealt as the files are."""
    parts = join_spread(looks, sizes.select("band", "band_key", "parts"), L.BLOCK_KEYS[:2], "qid")
    parts = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("cell", cell())
    asked = parts.select("cell", "band", "band_key", "qid", "vector")
    # only the cells that the batch looks into go to Python, each vector once
    wanted = asked.select("cell").distinct()
    own = titles.select("cell", "band", "band_key", "id", "vector", "rating").join(wanted.hint("merge"), "cell")
    schema = T.StructType(
        [
            T.StructField("qid", looks.schema["qid"].dataType),
            T.StructField("id", titles.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
            T.StructField("rating", titles.schema["rating"].dataType),
        ]
    )
    run = kernels.cell_scorer(to_arrow_schema(schema), kernels.CosineScorer(not include_self, null_is_self=True), k, ("rating",), L.BLOCK_KEYS[:2])
    return own.groupBy("cell").cogroup(asked.groupBy("cell")).applyInArrow(run, schema)


def predict(queries: DataFrame, path: str, k: int = 10, denominator: str = "found", **options) -> DataFrame:
    """``(qid, predicted)`` as ``lsh.lsh_predict`` gives it, from a stored index."""
    found = neighbours(queries, path, k, **options)
    means = found.groupBy("qid").agg(round_half_up(mean_rating(k, denominator)).alias("predicted"))
    return for_every_query(queries, means)
