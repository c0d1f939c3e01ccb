"""Sketches of batches: merged they say what one sketch of everything says, within the stated errors."""

from pyspark.sql import functions as F

from affinara.operators import sketches as S
from affinara.shipping import scratch_path


def test_batches_merge_and_replace(spark):
    rows = spark.range(30_000).select(
        "id",
        (F.col("id") * 7919 % 30_000).cast("double").alias("rating"),
        F.array((F.col("id") % 5000).cast("string"), F.lit("x")).alias("genres"),
    )
    path, options = scratch_path(spark, "sketches"), {"numbers": ["rating"], "lists": ["genres"]}
    for i in range(4):
        S.store(rows.filter(F.col("id") % 4 == i), path, f"b{i}", **options)
    S.store(rows.filter("id % 4 = 2"), path, "b2", **options)  # once more
    kept = S.stored(spark, path, [f"b{i}" for i in range(4)])
    assert kept.filter("kind = 'quantile'").agg(F.sum("n")).head()[0] == 30_000
    (distinct,) = S.distinct_estimates(kept).collect()
    assert abs(distinct["n_distinct"] - 5001) <= 5001 * S.DISTINCT_ERROR
    for row in S.quantile_estimates(kept, [0.1, 0.5, 0.9]).collect():
        assert abs(row["value"] / 30_000 - row["share"]) <= S.RANK_ERROR + 1e-4
    some = S.stored(spark, path, ["b0", "b3"])
    assert some.filter("kind = 'quantile'").agg(F.sum("n")).head()[0] == 15_000


def test_nulls_and_no_rows(spark):
    schema = "rating double, genres array<string>"
    rows = spark.createDataFrame([(None, None), (float("nan"), ["a", None]), (2.0, [])], schema)
    found = {(r["kind"], r["name"]): r["n"] for r in S.sketched(rows, ["rating"], ["genres"]).collect()}
    assert found == {("distinct", "genres"): 1, ("quantile", "rating"): 1}
    assert S.sketched(rows.filter("false"), ["rating"], ["genres"]).count() == 0
