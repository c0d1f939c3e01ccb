"""Search over distinct vectors: the rows of the full search, from as many pairs as there are distinct vectors."""

import random

import pytest
from pyspark.sql import functions as F

from affinara.operators import alike
from affinara.operators import lsh as L
from affinara.operators import predict as P

SPARSE = "id long, vector struct<size:int, indices:array<int>, values:array<double>>, rating double"


def sparse_rows(n, positions=9, kinds=25, seed=3):
    """Rows of few distinct vectors, a third of them one vector, some without any weight."""
    r = random.Random(seed)

    def vector():
        at = sorted(r.sample(range(positions), r.randint(0, 4)))
        return positions, at, [r.choice([-1.0, 1.0, 3.0]) for _ in at]

    known = [vector() for _ in range(kinds)]
    return [(i, known[0] if i % 3 == 0 else r.choice(known), float(i % 7)) for i in range(n)]


def batch_of(features):
    return features.filter("id % 4 = 0 OR id % 7 = 0 OR id IS NULL").withColumnRenamed("id", "qid")


def odd(spark, rows):
    """Rows that come twice, and ids that come with several vectors: such rows take places of their own, as in the full search."""
    again = [(rows[i][0], rows[i + 1][1], rows[i][2]) for i in range(0, 40, 4)]
    return spark.createDataFrame(rows + rows[:60] + again, SPARSE)


def listed(found):
    return sorted(map(tuple, found.select("qid", "id", "rank", "score", "rating").collect()))


def scored(found):
    # a repeated row may stand in either place of its own score
    return sorted(map(tuple, found.select("qid", "id", "rank", "score").collect()))


@pytest.mark.parametrize("include_self", [False, True])
def test_cosine_rows_are_those_of_the_full_search(spark, include_self):
    features = spark.createDataFrame(sparse_rows(240), SPARSE)
    for k in (1, 5, 100):
        full = P.cosine_neighbours(features, batch_of(features), k, include_self)
        found = P.cosine_neighbours(features, batch_of(features), k, include_self, form="classes")
        assert found.columns == full.columns and listed(found) == listed(full) != []


def test_cosine_rows_with_repeated_ids(spark):
    features = odd(spark, sparse_rows(200))
    full = P.cosine_neighbours(features, batch_of(features), 6)
    found = P.cosine_neighbours(features, batch_of(features), 6, form="classes")
    assert scored(found) == scored(full)


def test_dense_vectors_names_and_no_rows(spark):
    r = random.Random(1)
    rows = [(f"t{i}", [r.choice([0.0, -1.0, 2.0]) for _ in range(3)], 1.0) for i in range(90)] + [(None, [1.0, 1.0, 1.0], 2.0)]
    features = spark.createDataFrame(rows, "id string, vector array<double>, rating double")
    queries = features.withColumnRenamed("id", "qid")
    listed = lambda found: sorted((str(r["qid"]), str(r["id"]), r["score"]) for r in found.collect())
    assert listed(P.cosine_neighbours(features, queries, 200, form="classes")) == listed(P.cosine_neighbours(features, queries, 200))
    for a, b in ((features.filter("false"), queries), (features, queries.filter("false"))):
        assert P.cosine_neighbours(a, b, form="classes").count() == 0


@pytest.mark.parametrize("options", [{}, {"max_share": 1.0}, {"max_share": 0.02}, {"include_self": True, "max_share": 1.0}])
def test_lsh_rows_are_those_of_the_full_search(spark, options):
    """Many of these vectors lie on planes, so that equal vectors fall into different buckets by their ids."""
    features = spark.createDataFrame(sparse_rows(200), SPARSE).filter(F.size("vector.indices") > 0)
    index, looks = L.lsh_index(features, 8, 4).cache(), L.lsh_index(batch_of(features), 8, 4, id_name="qid").cache()
    for k in (1, 6):
        full = L.lsh_neighbours(index, looks, k, **options)
        found = L.lsh_neighbours(index, looks, k, form="classes", catalog_block=11, query_block=7, **options)
        assert found.columns == full.columns and scored(found) == scored(full) != []
    with pytest.raises(ValueError, match="most similar"):
        L.lsh_neighbours(index, looks, form="classes", neighbour_order="id_desc")


def test_lsh_prediction_with_repeated_ids(spark):
    features = odd(spark, sparse_rows(300))
    index, looks = L.lsh_index(features, 10, 2).cache(), L.lsh_index(batch_of(features), 10, 2, id_name="qid").cache()
    # with one query a block, what repeated rows leave of a block does not hang on the other queries in it
    full, found = (L.lsh_predict(index, looks, 5, query_block=1, **form) for form in ({}, {"form": "classes"}))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, full.collect()))


def test_class_of_many_queries_takes_its_list_in_parts(spark, monkeypatch):
    monkeypatch.setattr(alike, "CLASS_QUERIES", 4)
    features = spark.createDataFrame(sparse_rows(120), SPARSE)
    found = P.cosine_neighbours(features, batch_of(features), 5, form="classes")
    assert listed(found) == listed(P.cosine_neighbours(features, batch_of(features), 5))


@pytest.mark.parametrize("search", ["cosine", "lsh"])
def test_rows_that_meet_do_not_grow_with_copies_of_vectors(spark, monkeypatch, search):
    """Six times the titles of the same vectors: the search meets as many rows."""
    met, k_nearest = [], alike.k_nearest

    def counted(catalog, queries, *args, **options):
        met.append((catalog.count(), queries.count()))
        return k_nearest(catalog, queries, *args, **options)

    monkeypatch.setattr(alike, "k_nearest", counted)
    for copies in (1, 6):
        # weights of 3 and 1 never cancel: no vector lies on a plane, and buckets go by the vector alone
        rows = [(i, (6, [i % 2, 2 + i % 4], [3.0, 1.0]), 1.0) for i in range(48 * copies)]
        features = spark.createDataFrame(rows, SPARSE)
        queries = features.filter("id % 3 = 0").withColumnRenamed("id", "qid")
        if search == "cosine":
            found = P.cosine_predict(features, queries, 5, form="classes")
        else:
            found = L.lsh_predict(L.lsh_index(features, 4, 2), L.lsh_index(queries, 4, 2, id_name="qid"), 5, max_share=1.0, form="classes")
        assert found.count() == 16 * copies
    assert met[0] == met[1] and met[0][0] <= 16 and met[0][1] <= 8
