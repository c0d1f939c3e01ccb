"""Neighbour search against brute force, through both physical forms."""

import math
import random

import pytest
from pyspark.sql import functions as F

from affinara.functions import vectors as V
from affinara.operators import lsh as L
from affinara.operators import predict as P

SCAN = {"form": "scan"}
BLOCKS = {"form": "grid", "catalog_block": 13, "query_block": 5}
FORMS = pytest.mark.parametrize("form", [SCAN, BLOCKS], ids=["scan", "blocks"])
BUCKETS = pytest.mark.parametrize("form", [{}, BLOCKS], ids=["plain", "blocks"])


def cosine(a, b):
    na, nb = (math.sqrt(sum(x * x for x in v)) for v in (a, b))
    return round(sum(x * y for x, y in zip(a, b)) / (na * nb), 9) if na and nb else None


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(4)
    rows = []
    for i in range(120):
        # a third of all rows are copies of one vector
        v = [1.0, 2.0, -1.0, 0.5] if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(4)]
        rows.append((f"v{i:03d}", v, float(i % 10)))
    rows.append(("zero", [0.0] * 4, 3.0))
    return rows


@pytest.fixture(scope="module")
def frames(spark, vectors):
    df = spark.createDataFrame(vectors, "id string, vector array<double>, rating double").cache()
    return df, df.withColumnRenamed("id", "qid")


def brute_cosine(vectors, k, include_self=False):
    out = {}
    for qid, qv, _ in vectors:
        scored = [(-c, i, r) for i, v, r in vectors if (c := cosine(qv, v)) is not None and (include_self or i != qid)]
        out[qid] = [(i, r) for _, i, r in sorted(scored)[:k]]
    return out


@FORMS
@pytest.mark.parametrize("include_self", [False, True])
def test_cosine_neighbours(frames, vectors, form, include_self):
    features, batch = frames
    got = {}
    for r in P.cosine_neighbours(features, batch, 7, include_self=include_self, **form).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["id"], r["rating"]))
    assert got == {q: n for q, n in brute_cosine(vectors, 7, include_self).items() if n}


@FORMS
def test_cosine_predict_keeps_every_query(frames, vectors, form):
    features, batch = frames
    got = {r["qid"]: r["predicted"] for r in P.cosine_predict(features, batch, 5, **form).collect()}
    want = {q: sum(r for _, r in n) / len(n) if n else None for q, n in brute_cosine(vectors, 5).items()}
    assert got == pytest.approx(want) and got["zero"] is None


def test_sparse_and_dense_vectors_agree(spark, frames):
    features, batch = frames
    thin = features.withColumn("vector", V.sparse_of(F.col("vector")))
    a = P.cosine_neighbours(features, batch, 5)
    b = P.cosine_neighbours(thin, thin.withColumnRenamed("id", "qid"), 5)
    assert sorted(a.collect()) == sorted(b.collect())


def test_vectors_of_different_length_are_refused(spark):
    df = spark.createDataFrame([("a", [1.0], 1.0), ("b", [1.0, 2.0], 1.0)], "id string, vector array<double>, rating double")
    with pytest.raises(Exception, match="different length"):
        P.cosine_predict(df.coalesce(1), df.withColumnRenamed("id", "qid")).collect()


# --- attributes ---


def overlap(a, b, mode):
    if a is None or b is None or "\\N" in a or "\\N" in b or not (a or b):
        return 0.0
    rest, common = list(b), 0
    for x in a:
        if x in rest:
            rest.remove(x)
            common += 1
    if mode == "exact":
        return float(common == len(a) == len(b))
    return common / max(len(a), len(b))


def attribute_score(a, b, mode):
    ra, rb = a["runtime"] or 0, b["runtime"] or 0
    return (
        float(a["flag"] == b["flag"])
        + 1 - abs(ra - rb) / (ra + rb + 0.01)
        + 1.2 * overlap(a["genres"], b["genres"], mode)
        + 2.0 * overlap(a["writers"], b["writers"], mode)
        + 2.0 * overlap(a["directors"], b["directors"], mode)
    ) / 7.2


@pytest.fixture(scope="module")
def titles(spark):
    rng = random.Random(9)

    def some(words, most):
        kind = rng.random()
        if kind < 0.1:
            return None
        if kind < 0.2:
            return ["\\N"]
        return [rng.choice(words) for _ in range(rng.randint(0, most))]

    rows = []
    for i in range(150):
        rows.append(
            {
                "id": i,
                "title": None if i % 29 == 0 else f"T{rng.randint(0, 40)}",
                "kind": rng.choice(["movie", "tvMovie"]),
                "flag": rng.randint(0, 1),
                "runtime": rng.choice([None, 80, 90, 100, 120]),
                "genres": some(["Drama", "War", "Comedy"], 3),
                "writers": some([f"w{j}" for j in range(30)], 4),
                # one director made a third of everything
                "directors": ["hot"] if i % 3 == 0 else some([f"d{j}" for j in range(20)], 3),
                "rating": float(rng.randint(10, 100)) / 10,
                "votes": rng.randint(1, 1000),
            }
        )
    schema = (
        "id long, title string, kind string, flag int, runtime int, genres array<string>, writers array<string>, "
        "directors array<string>, rating double, votes int"
    )
    return rows, spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema).cache()


@FORMS
@pytest.mark.parametrize("mode", ["ratio", "exact"])
@pytest.mark.parametrize("kinds", [None, ["movie"]])
def test_attribute_neighbours(titles, form, mode, kinds):
    rows, catalog = titles
    got = {}
    batch = catalog.withColumnRenamed("id", "qid")
    found = P.attribute_neighbours(catalog, batch, 12, overlap=mode, kinds=kinds, **form)
    for r in found.orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["id"], r["score"]))
    for q in rows:
        want = sorted(
            (-round(attribute_score(c, q, mode), 9), c["id"])
            for c in rows
            if c["title"] and q["title"] and c["title"] != q["title"] and (not kinds or c["kind"] in kinds)
        )[:12]
        assert got.get(q["id"], []) == [(i, pytest.approx(-s)) for s, i in want]


@FORMS
def test_attribute_predict(titles, form):
    rows, catalog = titles
    got = {
        r["qid"]: r["predicted"]
        for r in P.attribute_predict(catalog, catalog.withColumnRenamed("id", "qid"), 10, **form).collect()
    }
    assert len(got) == len(rows)
    for q in rows:
        best = sorted(
            (-round(attribute_score(c, q, "ratio"), 9), c["id"], c["rating"], c["votes"])
            for c in rows
            if c["title"] and q["title"] and c["title"] != q["title"]
        )[:10]
        total = sum(-s * v for s, _, _, v in best)
        want = sum(-s * v * r for s, _, r, v in best) / total if total else None
        assert got[q["id"]] == (pytest.approx(want) if want is not None else None)


def test_tiny_neighbours(tiny):
    """Same-named titles and other kinds are not compared: t1 sees t2 only."""
    batch = tiny.filter("id = 't1'").withColumnRenamed("id", "qid")
    found = P.attribute_neighbours(tiny, batch, kinds=["movie"]).collect()
    assert [(r["id"], r["score"]) for r in found] == [("t2", pytest.approx(0.6315793320819372, abs=1e-9))]


# --- LSH ---


def candidates_by_hand(index, max_share):
    n = len(index)
    out = set()
    for q, keys in index.items():
        hits = []
        for b, key in enumerate(keys):
            members = [i for i, other in index.items() if other[b] == key]
            hits.append((len(members), b, members))
        kept = [h for h in hits if h[0] <= math.floor(n * max_share)] or [min(hits)]
        out |= {(q, i) for _, _, members in kept for i in members}
    return out


@pytest.mark.parametrize("max_share", [0.5, 0.25, 0.02])
@pytest.mark.parametrize("blocks", [{"form": "scan"}, {"catalog_block": 7, "query_block": 3}], ids=["scan", "blocks"])
def test_lsh_candidates(frames, max_share, blocks):
    features, batch = frames
    index, looks = L.lsh_index(features), L.lsh_index(batch, id_name="qid")
    by_hand = {r["id"]: r["band_keys"] for r in index.collect()}
    got = [tuple(r) for r in L.lsh_candidates(index, looks, max_share, **blocks).collect()]
    assert len(got) == len(set(got))
    assert set(got) == candidates_by_hand(by_hand, max_share)


@pytest.mark.parametrize("blocks", [{}, {"catalog_block": 512, "query_block": 128}])
def test_pairs_are_told_apart_by_plain_columns(frames, blocks):
    """No list is searched for each pair that meets."""
    features, batch = frames
    found = L.lsh_candidates(L.lsh_index(features), L.lsh_index(batch, id_name="qid"), **blocks)
    joins = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "SortMergeJoin" in line]
    assert joins and not any("lambda" in line for line in joins)


@pytest.mark.parametrize("blocks", [{}, {"catalog_block": 7, "query_block": 3}])
def test_candidates_of_ids_with_several_vectors(spark, blocks):
    """Such a query looks into several buckets of a band; others beside it into one of each."""
    keys = [(i, [i % 2, i % 3, i % 5]) for i in range(30)]
    index = spark.createDataFrame(keys, "id long, band_keys array<long>")
    looks = spark.createDataFrame([*keys[:9], (2, [1, 0, 4]), (3, keys[3][1]), (None, [0, 0, 0])], "qid long, band_keys array<long>")
    rows = lambda **form: sorted(map(tuple, L.lsh_candidates(index, looks, 1.0, **form).collect()))
    assert rows(**blocks) == rows(form="scan") != []


@BUCKETS
@pytest.mark.parametrize("max_share", [0.5, 0.02])
@pytest.mark.parametrize("order", ["similarity", "id_desc"])
def test_lsh_neighbours(frames, vectors, form, max_share, order):
    features, batch = frames
    index, looks = L.lsh_index(features), L.lsh_index(batch, id_name="qid")
    pairs = candidates_by_hand({r["id"]: r["band_keys"] for r in index.collect()}, max_share)
    data = {i: (v, r) for i, v, r in vectors}
    want = {}
    for q in data:
        scored = []
        for i in (i for p, i in pairs if p == q and i != q):
            c = cosine(data[q][0], data[i][0])
            if order == "id_desc":
                scored.append((tuple(-ord(ch) for ch in i.ljust(6, "\0")), i))
            elif c is not None:
                scored.append((-c, i))
        want[q] = [i for _, i in sorted(scored)[:6]]
    got = {q: [] for q in data}
    found = L.lsh_neighbours(index, looks, 6, max_share=max_share, neighbour_order=order, **form)
    for r in found.orderBy("qid", "rank").collect():
        got[r["qid"]].append(r["id"])
    assert got == want


def test_one_bucket_equals_exact(frames):
    """With one band of no planes' worth of difference everything meets: LSH equals the exact search."""
    features, batch = frames
    same = features.withColumn("band_keys", F.array(F.lit(1).cast("long")))
    looks = batch.withColumn("band_keys", F.array(F.lit(1).cast("long")))
    a = L.lsh_neighbours(same, looks, 5, max_share=1.0).select("qid", "id", "rank")
    b = P.cosine_neighbours(features, batch, 5).select("qid", "id", "rank")
    assert sorted(a.collect()) == sorted(b.collect())


def rule_case(spark, sizes):
    """Ten titles; the query's two buckets have the given sizes."""
    rows = [(f"t{i}", [7 if i < sizes[0] else 100 + i, 7 if i >= 10 - sizes[1] else 200 + i], float(i)) for i in range(10)]
    index = spark.createDataFrame(rows, "id string, band_keys array<long>, rating double")
    index = index.withColumn("vector", F.array(F.lit(1.0)))
    query = spark.createDataFrame([("q", [7, 7])], "qid string, band_keys array<long>").withColumn("vector", F.array(F.lit(1.0)))
    return index, query


@pytest.mark.parametrize("sizes, kept", [((5, 6), 5), ((8, 6), 6)])
def test_bucket_rule(spark, sizes, kept):
    index, query = rule_case(spark, sizes)
    assert L.lsh_candidates(index, query).count() == kept


def test_no_hit_gives_null(spark):
    index, query = rule_case(spark, (5, 6))
    lost = query.withColumn("band_keys", F.array(F.lit(-1).cast("long"), F.lit(-1).cast("long")))
    assert L.lsh_candidates(index, lost).count() == 0
    assert [tuple(r) for r in L.lsh_predict(index, lost).collect()] == [("q", None)]


def test_a_batch_too_large_to_scan_is_refused(frames):
    features, batch = frames
    with pytest.raises(ValueError, match="too large"):
        P.cosine_neighbours(features, batch, form="scan", scan_bytes=10)


@BUCKETS
def test_lsh_order_and_denominator(spark, form):
    index = spark.createDataFrame(
        [("t1", [1.0, 0.1], 6.0, [1]), ("t9", [0.1, 1.0], 8.0, [1])],
        "id string, vector array<double>, rating double, band_keys array<long>",
    )
    query = spark.createDataFrame([("q", [1.0, 0.0], [1])], "qid string, vector array<double>, band_keys array<long>")
    first = lambda **o: L.lsh_neighbours(index, query, 1, max_share=1.0, **o, **form).head()["id"]
    assert first() == "t1" and first(neighbour_order="id_desc") == "t9"
    mean = lambda **o: L.lsh_predict(index, query, 10, max_share=1.0, **o, **form).head()["predicted"]
    assert mean() == 7.0 and mean(denominator="k") == 1.4
