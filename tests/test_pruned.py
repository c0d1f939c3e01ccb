"""Exact cosine search with block bounds: the rows of the full search, from fewer pairs as tables grow."""

import random

import pytest
from pyspark.sql import functions as F

from affinara.operators import predict as P
from affinara.operators import pruned

SPARSE = "id long, vector struct<size:int, indices:array<int>, values:array<double>>, rating double"


def sparse_rows(n, positions, seed=2):
    r = random.Random(seed)

    def vector(i):
        at = sorted(r.sample(range(positions), r.randint(0, 4)))
        return positions, at, [r.choice([-1.0, 0.5, 3.0, 20.0]) * r.random() for _ in at]

    return [(i, vector(i), float(i % 7)) for i in range(n)]


def same(spark, features, queries, **options):
    columns = ["qid", "id", "rank", "score"]
    full = P.cosine_neighbours(features, queries, 6).select(columns).collect()
    found = P.cosine_neighbours(features, queries, 6, form="pruned", **options).select(columns).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, full)) and full


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_same_rows_as_the_full_search(spark, block_rows):
    features = spark.createDataFrame(sparse_rows(220, 12), SPARSE)
    queries = features.filter("id % 3 = 0").withColumnRenamed("id", "qid")
    same(spark, features, queries, block_rows=block_rows, query_block=16)


def test_dense_vectors_and_no_rows(spark):
    r = random.Random(1)
    rows = [(i, [r.choice([0.0, -1.0, 2.0]) for _ in range(5)], 1.0) for i in range(90)]
    features = spark.createDataFrame(rows, "id long, vector array<double>, rating double")
    same(spark, features, features.filter("id < 30").withColumnRenamed("id", "qid"), block_rows=10)
    nothing = features.filter("false")
    assert P.cosine_neighbours(nothing, features.withColumnRenamed("id", "qid"), form="pruned").count() == 0
    assert P.cosine_neighbours(features, nothing.withColumnRenamed("id", "qid"), form="pruned").count() == 0


def test_share_of_pairs_scored_falls_as_tables_grow(spark):
    """Blocks of one size over four times the titles: a smaller share of all pairs is met."""
    shares = []
    for n in (400, 1600):
        features = spark.createDataFrame(sparse_rows(n, 40), SPARSE)
        queries = features.filter("id % 10 = 0").withColumnRenamed("id", "qid")
        report = []
        pruned.pruned_neighbours(features, queries, 5, block_rows=50, report=report).agg(F.count("*")).collect()
        shares.append(report[0][0] / report[0][1])
    assert shares[1] < 0.8 * shares[0] and shares[1] < 0.5


def test_pairs_do_not_grow_with_copies_of_vectors(spark):
    """Six times the titles of the same vectors: as many pairs are met."""
    reports = []
    for copies in (1, 6):
        rows = [(i + 1000 * c, vector, rating) for c in range(copies) for i, vector, rating in sparse_rows(150, 12)]
        features = spark.createDataFrame(rows, SPARSE)
        report = []
        queries = features.filter("id % 5 = 0").withColumnRenamed("id", "qid")
        pruned.pruned_neighbours(features, queries, 5, block_rows=20, report=report).agg(F.count("*")).collect()
        reports.append(report)
    assert reports[0] == reports[1] and reports[0][0][0] > 0


def test_copies_of_vectors_give_the_rows_of_the_full_search(spark):
    rows = [(i + 100 * c, vector, rating + c) for c in range(4) for i, vector, rating in sparse_rows(60, 9)]
    features = spark.createDataFrame(rows, SPARSE)
    same(spark, features, features.filter("id % 3 = 0").withColumnRenamed("id", "qid"), block_rows=7)


def test_rows_without_an_id_are_neither_found_nor_answered(spark):
    rows = sparse_rows(80, 9)
    features = spark.createDataFrame([*rows, *[(None, vector, rating) for _, vector, rating in rows[:9]]], SPARSE)
    found = P.cosine_neighbours(features, features.withColumnRenamed("id", "qid"), 6, form="pruned", block_rows=7)
    named = features.filter("id is not null")
    expected = P.cosine_neighbours(named, named.withColumnRenamed("id", "qid"), 6)
    columns = ["qid", "id", "rank", "score"]
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, expected.select(columns).collect()))


def test_bounds_hold_where_an_id_has_several_rows(spark):
    """Two rows of one id among four of a block: the position that only they use may also be 0 there."""
    rows = [(1, (3, [0], [-2.0]), 1.0), (1, (3, [0], [-2.0]), 1.0), (2, (3, [1], [1.0]), 1.0), (3, (3, [1], [3.0]), 1.0)]
    blocks = pruned.with_lengths(spark.createDataFrame(rows, SPARSE)).withColumn("block", F.lit(0))
    bounds = {r["pos"]: (r["high"], r["low"]) for r in pruned.block_bounds(blocks).collect()}
    assert bounds == {0: (0.0, -1.0), 1: (1.0, 0.0)}
