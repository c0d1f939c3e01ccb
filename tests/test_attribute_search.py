"""Attribute search with hot and rare people: same neighbours as scoring every pair, and few pairs made."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from affinara.functions.similarity import attribute_score
from affinara.functions.text import MISSING
from affinara.operators import predict as P

SCHEMA = (
    "id long, title string, flag int, runtime int, genres array<string>, writers array<string>, "
    "directors array<string>, rating double, votes int"
)


def titles(n, hot_share, seed=4, names=12):
    r = random.Random(seed)

    def people(most):
        kind = r.random()
        if kind < 0.05:
            return None
        if kind < 0.1:
            return [MISSING]
        found = [f"p{r.randint(0, n // 3)}" for _ in range(r.randint(0, most))]
        found += ["hot"] * (r.random() < hot_share) + ["warm"] * (r.random() < hot_share / 2)
        return found + found[:1] * (r.random() < 0.1)

    def row(i):
        genres = r.sample(["a", "b", "c", "d"], r.randint(0, 2)) if r.random() < 0.95 else None
        name = None if r.random() < 0.05 else f"t{r.randint(0, names)}"
        return i, name, r.choice([0, 1, None]), r.choice([60, 90, 91, None]), genres, people(2), people(3), r.random() * 10, r.randint(1, 99)

    return [row(i) for i in range(n)]


def every_pair(catalog, queries, k, overlap):
    left = queries.select("qid", *[F.col(n).alias(f"q_{n}") for n in P.ATTRIBUTES])
    pairs = left.crossJoin(catalog).filter(F.col("title") != F.col("q_title"))
    score = attribute_score(lambda n: F.col(n), lambda n: F.col(f"q_{n}"), overlap=overlap)
    place = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return pairs.withColumn("score", F.round(score, 9)).withColumn("rank", place).filter(F.col("rank") <= k)


@pytest.mark.parametrize("overlap", ["ratio", "exact"])
@pytest.mark.parametrize("hot_titles", [0, 4, 1 << 30])
def test_same_as_every_pair(spark, hot_titles, overlap):
    rows = titles(160, 0.35)
    catalog = spark.createDataFrame(rows, SCHEMA)
    queries = spark.createDataFrame(rows[:60], SCHEMA).withColumnRenamed("id", "qid")
    columns = ["qid", "id", "rank", "score"]
    found = P.attribute_neighbours(catalog, queries, 7, overlap=overlap, hot_titles=hot_titles, catalog_block=64, query_block=16)
    got = sorted(tuple(r) for r in found.select(columns).collect())
    assert got == sorted(tuple(r) for r in every_pair(catalog, queries, 7, overlap).select(columns).collect())


def test_a_person_with_a_third_of_all_titles_makes_no_pairs(spark):
    """Pairs from the index: at most the bound for each person of a query, whatever the hot people have."""
    counts = []
    for n in (600, 2400):
        rows = titles(n, 0.35, names=n)
        catalog = spark.createDataFrame(rows, SCHEMA)
        queries = spark.createDataFrame(rows[: n // 4], SCHEMA).withColumnRenamed("id", "qid")
        hot = P.hot_people(catalog, 20)
        assert {r["person"]["name"] for r in hot.collect()} == {"hot", "warm"}
        own = P.people(catalog, "id").join(hot, "person", "left_anti")
        asked = P.people(queries, "qid")
        counts.append(asked.join(own, "person").count())
        assert counts[-1] <= 20 * asked.count()
        cells = P.cells_of(P.with_hot_people(catalog, "id", hot), 5)
        assert cells.agg(F.max(F.size("members"))).head()[0] <= 10
    assert counts[1] < 6 * counts[0]  # in proportion to the rows (4 times), not to their square (16 times)


@pytest.mark.parametrize("overlap, most", [("ratio", 6), ("exact", 0)])
def test_measured_bound_gives_the_same_as_every_pair(spark, monkeypatch, overlap, most):
    """The bound is measured, and queries that are alike in all that the cells compare meet them once."""
    monkeypatch.setattr(P, "HOT_TITLES", 2)
    monkeypatch.setattr(P, "PAIRS_PER_QUERY", most)
    rows = titles(160, 0.35, names=5)
    catalog = spark.createDataFrame(rows, SCHEMA)
    queries = spark.createDataFrame(rows[:60], SCHEMA).withColumnRenamed("id", "qid")
    columns = ["qid", "id", "rank", "score"]
    got = sorted(tuple(r) for r in P.attribute_neighbours(catalog, queries, 7, overlap=overlap).select(columns).collect())
    assert got == sorted(tuple(r) for r in every_pair(catalog, queries, 7, overlap).select(columns).collect())


def test_cells_do_not_grow_with_the_titles_where_all_people_have_many(spark):
    """150 titles a person at both sizes: the index takes them, and titles equal but for their people are one cell."""
    counts = []
    for n in (1500, 6000):
        rows = [(i, f"t{i % 9}", 0, 60 + i % 5, ["a"], [f"w{i // 150}"] * (1 + i % 3), [f"d{i % (n // 150)}"], 1.0, 1) for i in range(n)]
        catalog = spark.createDataFrame(rows, SCHEMA)
        hot_titles = P.measured_hot_titles(catalog, catalog.filter("id % 4 = 0").withColumnRenamed("id", "qid"))
        assert 150 <= hot_titles < 300
        counts.append(P.cells_of(P.with_hot_people(catalog, "id", P.hot_people(catalog, hot_titles)), 5).count())
    assert counts == [10, 10]
