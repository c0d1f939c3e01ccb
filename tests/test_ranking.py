import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinara.operators import ranking as R


def test_systematic_split_tiny(tiny):
    train, test = R.systematic_split(tiny)
    assert [r["id"] for r in test.collect()] == ["t2"]
    assert sorted(r["id"] for r in train.collect()) == ["t1", "t3", "t4", "t5"]


def test_row_number_with_one_hot_value(spark):
    """A third of all rows share one vote value: the ranges still split them."""
    rows = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 97).cast("int").alias("votes")
    )
    sliced = R.in_slices(rows, ["votes", "id"], 8)
    sizes = [r["n"] for r in sliced.groupBy("_slice").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 1000
    got = [r["id"] for r in R.global_row_number(rows, ["votes", "id"], "n", slices=8).orderBy("n").collect()]
    want = [r["id"] for r in rows.orderBy("votes", "id").collect()]
    assert got == want


def test_split_is_disjoint_and_exhaustive(spark):
    rows = spark.range(1003).select("id", (F.col("id") % 10).alias("votes"))
    train, test = R.systematic_split(rows)
    a, b = {r["id"] for r in train.collect()}, {r["id"] for r in test.collect()}
    assert not a & b and len(a | b) == 1003 and len(b) == 1003 // 4


def test_running_total(spark):
    rows = spark.range(200).select("id", (F.col("id") % 7).alias("n"))
    got = [r["t"] for r in R.running_total(rows, ["id"], "n", "t").orderBy("id").collect()]
    assert got == list(np.cumsum([i % 7 for i in range(200)]))


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [3.0, 1.0, 1.0, 1.0, 9.0, 2.5, None], [None, None]])
def test_quantiles(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r["share"]: r["value"] for r in R.quantiles(df, ["x"]).collect()}
    known = [v for v in values if v is not None]
    want = {q: float(np.quantile(known, q)) for q in (0.25, 0.5, 0.75)} if known else {}
    assert got == pytest.approx(want)
    if known:
        assert got[0.5] == statistics.median(known)


def test_shuffled_keeps_rows(spark):
    assert sorted(r["id"] for r in R.shuffled(spark.range(20), 3).collect()) == list(range(20))


def test_hot_key_is_spread_before_the_join(spark):
    from affinara.shipping import join_spread

    rows = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).alias("key"))
    facts = spark.range(97).select(F.col("id").alias("key"), (F.col("id") * 2).alias("fact"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = join_spread(rows, facts, ["key"], "id", bound=0)
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 30_000 and max(sizes) < 2 * 30_000 / 4
        assert joined.filter("fact <> 2 * key").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_scratch_tables_of_a_job_are_deleted(spark, tmp_path):
    import os

    from affinara.shipping import scratch_of_job, scratch_path

    with scratch_of_job(spark):
        path = scratch_path(spark, "gone")
        spark.range(3).write.parquet(path)
        assert os.path.isdir(path)
    assert not os.path.isdir(path)


def test_ranked_tables_hold_only_what_is_asked_for(spark, sf_dir):
    from affinara.plans import registry

    assert registry.QUERIES["split_test"](spark, sf_dir).columns == ["id", "votes", "rating"]
    plan = registry.QUERIES["global_rank"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "genres" not in plan and "directors" not in plan
