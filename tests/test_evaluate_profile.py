from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinara.functions.sums import exact_mean, exact_sum
from affinara.operators import evaluate as E
from affinara.operators import profile as Pr


def test_errors_join_by_id(spark):
    predictions = spark.createDataFrame([("b", 1.0), ("a", 2.0), ("x", 9.0)], "qid string, predicted double")
    actuals = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "id string, rating double")
    metrics, _ = E.evaluate(predictions, actuals)
    row = metrics.head()
    assert row["n"] == 2 and row["mse"] == 2.5 and row["rmse"] == pytest.approx(1.5811388300841898)


def test_confusion_matrix(spark):
    pairs = spark.createDataFrame([(6.5, 7.5), (6.0, 8.0), (0.2, 9.6)], "actual double, predicted double")
    cells = {(r["actual"], r["predicted"]): r["n"] for r in E.confusion_matrix(pairs).collect()}
    assert len(cells) == 121 and sum(cells.values()) == 3
    assert cells[(6, 8)] == 2 and cells[(0, 10)] == 1


def test_mean_seconds(spark):
    timed = spark.createDataFrame([(1.0,), (2.0,)], "seconds double")
    assert E.mean_seconds(timed).head()[0] == 1.5


@pytest.mark.parametrize(
    "values", [[i / 10 for i in range(10, 101)], [5.0, 5.0], [1.0, 2.0, 10.0], [0.1 * i for i in range(7)]]
)
def test_histogram_as_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    got = Pr.histogram(df, "x").orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=10)
    assert [r["n"] for r in got] == counts.tolist()
    assert [r["low"] for r in got] == pytest.approx(edges[:-1].tolist())


def test_summary_tiny(tiny):
    row = {r["column"]: r for r in Pr.column_summary(tiny).collect()}["runtime"]
    assert (row["n"], row["min"], row["max"], row["q2"]) == (3, 60.0, 100.0, 90.0)
    assert row["mean"] == pytest.approx(250 / 3)


def test_counts_tiny(tiny):
    assert {r["list"]: r["n_distinct"] for r in Pr.distinct_counts(tiny).collect()} == {
        "genres": 3, "directors": 4, "writers": 4,
    }
    assert Pr.flagged_count(tiny).head()[0] == 1
    assert [tuple(r) for r in Pr.most_frequent(tiny, "directors", 2).collect()] == [("d1", 2), ("d3", 2)]
    assert [tuple(r) for r in Pr.raw_list_ranks(tiny, "directors", 2, 3).collect()] == [("\\N", 1), ("d2,d3", 1)]
    assert {r["token"]: r["n"] for r in Pr.token_frequency(tiny).collect()} == {"Drama": 3, "War": 2, "\\N": 1}


def test_profile_names(tiny):
    out = Pr.profile(tiny, tiny.filter(F.col("id") != "t2"), tiny.filter(F.col("id") == "t2"))
    assert out["histogram_test"].agg(F.sum("n")).head()[0] == 1


def test_approximate_profile(spark, sf_dir):
    from affinara.plans import standin

    rows = standin.catalog(spark, sf_dir).cache()
    exact = {r["list"]: r["n_distinct"] for r in Pr.distinct_counts(rows).collect()}
    near = {r["list"]: r["n_distinct"] for r in Pr.distinct_counts(rows, relative_error=0.01).collect()}
    assert near.keys() == exact.keys() and all(abs(near[k] - exact[k]) <= 0.05 * exact[k] + 1 for k in exact)
    full = {r["column"]: r for r in Pr.column_summary(rows).collect()}
    for r in Pr.column_summary(rows, accuracy=10_000).collect():
        other = full[r["column"]]
        assert r["n"] == other["n"] and r["mean"] == pytest.approx(other["mean"])
        assert other["q1"] <= r["q2"] <= other["q3"]


def test_fused_profile_equals_the_single_summaries(spark, sf_dir):
    """Each input is scanned once; the frames are those that the single operators give."""
    from affinara.plans import standin

    rows = standin.stored_catalog(spark, sf_dir, "id", "flag", *Pr.NUMBERS, *Pr.LISTS)
    train, test = rows.filter("id % 4 > 0").select("rating"), rows.filter("id % 4 = 0").select("rating")
    out = Pr.profile(rows, train, test)
    single = {
        "summary": Pr.column_summary(rows),
        "flagged": Pr.flagged_count(rows),
        "distinct": Pr.distinct_counts(rows),
        "histogram_all": Pr.histogram(rows, "rating"),
        "histogram_train": Pr.histogram(train, "rating"),
        "histogram_test": Pr.histogram(test, "rating"),
        "genre_frequency": Pr.token_frequency(rows),
        "top_directors": Pr.most_frequent(rows),
        "raw_directors": Pr.raw_list_ranks(rows),
    }
    assert list(out) == list(single)
    near = lambda df: sorted([round(x, 9) if isinstance(x, float) else x for x in r] for r in df.select(sorted(df.columns)).collect())
    for name, df in single.items():
        assert near(out[name]) == near(df), name
    counts = Pr.profile_counts(rows, train, test)
    assert counts._jdf.queryExecution().executedPlan().toString().count("FileScan") == 3


@pytest.mark.parametrize("parts", [1, 4, 211])
def test_sums_do_not_depend_on_the_order_of_rows(spark, parts):
    rows = [(i, (0.1 * i) ** 3 - 7.3, i % 50, i % 9) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, rating double, runtime int, votes int").repartition(parts, F.rand(parts))
    row = Pr.column_summary(df).filter("column = 'rating'").head()
    exact = sum(Fraction(round(r[1], 12)).limit_denominator(10**12) for r in rows) / 1000
    assert row["mean"] == float(exact)
    one = Pr.column_summary(df.coalesce(1).orderBy("id")).filter("column = 'rating'").head()
    assert (row["mean"], row["std"]) == (one["mean"], one["std"])
    assert df.agg(exact_sum(F.col("rating"))).head()[0] == float(exact * 1000)
    odd = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double").agg(exact_sum(F.col("x")), exact_mean(F.col("x"))).head()
    assert odd[0] != odd[0] and odd[1] != odd[1]
