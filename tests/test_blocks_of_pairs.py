"""Bounded pieces inside tasks: probes, pairs within a budget, grid units and block bounds."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from affinara import kernels
from affinara.operators import lsh as L
from affinara.operators import lsh_store as S
from affinara.operators import neighbours as N
from affinara.operators import predict as P
from affinara.operators import pruned
from affinara.shipping import scratch_path, written


def test_probes_are_made_a_few_queries_at_a_time():
    r = np.random.default_rng(1)
    batch = pa.RecordBatch.from_pydict({"vector": r.normal(size=(300, 3)).tolist(), "band_keys": [[5, 6]] * 300})
    out = list(kernels.probe_adder(4, 2, "", 6)(iter([batch])))
    assert [b.num_rows for b in out] == [128, 128, 44]
    probes = pa.Table.from_batches(out).column("probes").to_pylist()
    far = np.abs(kernels.matrix(batch.column("vector")) @ kernels.plane_matrix(4, 3, "").T)
    assert probes == [[{"band": b, "key": k} for b, k in kernels.nearest_flips(d, [5, 6], 2, 6)] for d in far]


def test_pairs_within_a_budget_are_found_once_and_marked():
    schema = pa.schema([("qid", pa.int64()), ("cand_id", pa.int64()), ("marked", pa.int64())])
    catalog = pa.table({"id": pa.array([1, 2, 3, None]), "band_keys": [[4, 7], [5, 7], [4, 9], [5, 9]]})
    kept = [[{"band": 0, "key": 4}, {"band": 1, "key": 7}], [{"band": 0, "key": 8}, {"band": 1, "key": 9}], []]
    kind = pa.list_(pa.struct([("band", pa.int32()), ("key", pa.int64())]))
    queries = pa.table({"qid": [10, 11, 12], "kept": pa.array(kept, kind), "nearest": [[2, 5], None, [1]]})
    rows = kernels.bucket_pairs(schema, "nearest")(catalog, queries).to_pylist()
    expected = [(10, 1, 0), (10, 2, 1), (10, 3, 0), (11, 3, 0), (11, None, 0)]
    assert [tuple(row.values()) for row in rows] == expected


def test_all_buckets_of_some_queries_are_put_in_order_at_once(monkeypatch):
    r = np.random.default_rng(3)
    one_by_one, asked = kernels.nearest_flips, []
    for far in (r.random((9, 7)), r.integers(0, 3, (9, 7)).astype(float)):
        own = [[int(x) for x in r.integers(8, 16, 3)] for _ in far]
        expected = [one_by_one(d, keys, 3, 11) for d, keys in zip(far, own, strict=True)]
        monkeypatch.setattr(kernels, "nearest_flips", lambda *args: asked.append(args) or one_by_one(*args))
        found = kernels.all_nearest_flips(far, own, 3, 11)
        assert [[tuple(x) for x in row.tolist()] for row in found] == expected
        # only queries with buckets equally far go one by one
        assert bool(asked) == (far.max() >= 1)


def probed_tables(spark, most=6):
    """An index and a batch with probes and marks; one id stands in two rows of the batch, one row has none."""
    r = np.random.default_rng(2)
    features = spark.createDataFrame([(i, r.normal(size=3).tolist()) for i in range(70)], "id long, vector array<double>")
    batch = features.filter("id < 20").withColumnRenamed("id", "qid")
    batch = batch.unionByName(batch.filter("qid = 4")).unionByName(batch.filter("qid = 5").withColumn("qid", F.lit(None).cast("long")))
    looks = L.with_probes(L.lsh_index(batch, 6, 2, id_name="qid"), 6, 2, most=most)
    looks = looks.withColumn("nearest", F.array(F.col("qid"), F.col("qid") + 1, F.col("qid") + 1))
    return written(L.lsh_index(features, 6, 2), "index"), written(looks, "looks")


def test_budgets_are_taken_without_a_row_for_each_probe(spark):
    index, looks = probed_tables(spark)
    sizes = written(L.bucket_sizes(index), "sizes")
    for budget in (0.0, 0.2, 0.7):
        found = L.within_budget_by_blocks(looks, sizes, budget, ["nearest"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "posexplode" not in plan
        kept = L.within_budget(looks, sizes, F.lit(70) * F.lit(budget))
        expected = looks.select("qid", "nearest").join(kept, "qid")
        rows = lambda df: sorted(map(str, df.select("qid", "nearest", "kept").collect()))
        assert rows(found) == rows(expected) != []


def test_counted_pairs_are_those_that_are_met(spark):
    index, looks = probed_tables(spark)
    for budget in (0.1, 0.6):
        pairs = L.lsh_candidates(index, looks, budget=budget, marks="nearest")
        met = F.sum(F.greatest("marked", F.lit(1))).alias("met")
        expected = pairs.groupBy("qid").agg(F.sum("marked").alias("hits"), met).collect()
        counted = L.lsh_candidates(index, looks, budget=budget, marks="nearest", counts=True)
        found = counted.groupBy("qid").agg(F.sum("hits"), F.sum("met")).collect()
        assert sorted(map(tuple, found)) == sorted(map(tuple, expected)) != []
        # a row a query and block, not one a pair
        assert counted.count() <= looks.count() < pairs.count()


def test_small_blocks_do_not_multiply_the_rows_that_move(spark, monkeypatch):
    """Blocks of 4 x 2 rows: each row moves a few times, as with blocks of any size."""
    rows = [(i, [float(i % 7), float(i % 5), 1.0], 1.0) for i in range(200)]
    features = spark.createDataFrame(rows, "id long, vector array<double>, rating double")
    queries = features.filter("id % 4 = 0").withColumnRenamed("id", "qid")
    moved, grid = [], N.grid

    def counted(*sides):
        moved.append([df.count() for df in grid(*sides)])
        return grid(*sides)

    monkeypatch.setattr(N, "grid", counted)
    found = [P.cosine_neighbours(features, queries, 3, **sides).select("qid", "id", "rank", "score").collect() for sides in ({}, {"catalog_block": 4, "query_block": 2})]
    assert sorted(map(tuple, found[0])) == sorted(map(tuple, found[1])) and moved[0] == moved[1]


def test_bounds_make_one_row_a_query_and_part(spark):
    rows = [(i, [1.0 + i % 9, float(i % 4), 0.0], 1.0) for i in range(120)]
    blocks = pruned.in_blocks(spark.createDataFrame(rows, "id long, vector array<double>, rating double"), 5).cache()
    asked = pruned.with_lengths(blocks.filter("id < 10").select(F.col("id").alias("qid"), "vector"))
    first = pruned.bounded(asked, pruned.block_bounds(blocks), 24).collect()
    assert len(first) == 10  # not 24 blocks x 10 queries
    assert all(row["bound"] >= 1 - 1e-9 for row in first)  # their own block's at least


def test_a_stored_search_sends_cells_not_pairs(spark):
    rows = [(i if i else None, [float(i % 3), 1.0, -2.0], 1.0) for i in range(60)]
    features = spark.createDataFrame(rows, "id long, vector array<double>, rating double")
    path = scratch_path(spark, "store")
    S.create(features, path, planes=4, bands=2, files=2)
    queries = features.filter("id < 9").withColumnRenamed("id", "qid")
    found = S.neighbours(queries, path, 5, max_share=1.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "ArrowEvalPython" not in plan
    index, batch = L.lsh_index(features, 4, 2), L.lsh_index(queries, 4, 2, id_name="qid")
    expected = L.lsh_neighbours(index, batch, 5, max_share=1.0)
    columns = ["qid", "id", "rank", "score"]
    assert sorted(map(str, found.select(columns).collect())) == sorted(map(str, expected.select(columns).collect()))


def test_a_row_without_an_id_is_the_own_row_of_a_query_without_one():
    scorer = kernels.CosineScorer(null_is_self=True)
    queries = scorer.prepare(pa.table({"qid": pa.array([None, 1], pa.int64()), "vector": [[1.0], [1.0]]}))
    rows = scorer.prepare_rows(pa.table({"id": pa.array([1, None, 2], pa.int64()), "vector": [[1.0], [1.0], [1.0]]}))
    assert scorer.score(queries, np.arange(2), rows).tolist() == [[1.0, kernels.HIDDEN, 1.0], [kernels.HIDDEN, 1.0, 1.0]]
