"""The stored LSH index: the results of a rebuild, whatever was appended, and no shuffle of the catalog."""

import random

import pytest
from pyspark.sql import functions as F

from affinara.operators import lsh as L
from affinara.operators import lsh_store as S
from affinara.shipping import scratch_path


def vectors(n, seed=3):
    r = random.Random(seed)
    hot = [1.0, 2.0, -1.0, 0.5]
    return [(i, hot if i % 3 == 0 else [r.gauss(0, 1) for _ in range(4)] if i % 17 else [0.0] * 4, float(i % 10)) for i in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(vectors(240), "id long, vector array<double>, rating double")


def rebuilt(features, queries, **options):
    index, batch = L.lsh_index(features, 12, 3), L.lsh_index(queries, 12, 3, id_name="qid")
    return sorted(map(tuple, L.lsh_neighbours(index, batch, 5, **options).select("qid", "id", "rank", "score").collect()))


def stored(queries, path, **options):
    return sorted(map(tuple, S.neighbours(queries, path, 5, **options).select("qid", "id", "rank", "score").collect()))


@pytest.mark.parametrize("max_share", [0.5, 0.02])
def test_appended_and_compacted_index_equals_a_rebuild(spark, rows, monkeypatch, max_share):
    monkeypatch.setattr(S, "PART_ROWS", 16)  # the hot bucket is many parts
    queries = rows.filter("id % 5 = 0").withColumnRenamed("id", "qid")
    path = scratch_path(spark, "store")
    S.create(rows.filter("id < 100"), path, planes=12, bands=3, files=4)
    assert stored(queries, path, max_share=max_share) == rebuilt(rows.filter("id < 100"), queries, max_share=max_share)
    S.append(rows.filter("id >= 100 AND id < 200"), path)
    S.append(rows.filter("id >= 200"), path)
    expected = rebuilt(rows, queries, max_share=max_share)
    assert stored(queries, path, max_share=max_share) == expected and expected
    assert len(S.generations(spark, path)) == 3
    S.compact(spark, path)
    (only,) = S.generations(spark, path)
    assert only["titles"] == 240
    assert stored(queries, path, max_share=max_share) == expected
    # another session knows nothing of the table but its folder
    spark.sql(f"DROP TABLE {S._name(path, only['generation'])}")
    assert stored(queries, path, max_share=max_share) == expected
    sizes = S.table(spark, path, only).groupBy("cell").count()
    assert sizes.agg(F.max("count")).head()[0] < 45  # 16 on average, where one bucket holds over 80


def test_a_batch_does_not_move_the_catalog(spark, rows):
    path = scratch_path(spark, "store")
    S.create(rows, path, planes=12, bands=3, files=4)
    queries = rows.filter("id % 40 = 0").withColumnRenamed("id", "qid")
    plan = S.neighbours(queries, path, 5)._jdf.queryExecution().executedPlan().toString().split("\n")
    (scan,) = [i for i, line in enumerate(plan) if "lsh_" in line and "FileScan" in line]
    assert "Bucketed: true" in plan[scan] and "SelectedBucketsCount" in plan[scan]
    above = []
    depth = len(plan[scan]) - len(plan[scan].lstrip(" :+-"))
    for line in reversed(plan[:scan]):
        own = len(line) - len(line.lstrip(" :+-"))
        if own < depth:
            above.append(line)
            depth = own
        if "SortMergeJoin" in line:
            break
    assert any("SortMergeJoin" in line for line in above) and not any("Exchange" in line for line in above)
