"""Every registered query against its SQL counterpart, and the shape of the plans."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as driver
from affinara.operators import predict as P
from affinara.operators import ranking as R
from affinara.plans import oracle, registry, standin

QUERIES, SQL = registry.QUERIES, oracle.SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return str(value)


def test_every_query_has_sql():
    assert sorted(QUERIES) == sorted(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_as_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    relation = duck.sql(SQL[name])
    assert sorted(relation.columns) == names
    at = [relation.columns.index(n) for n in names]
    want = sorted(tuple(cell(row[i]) for i in at) for row in relation.fetchall())
    got = sorted(tuple(cell(row[n]) for n in names) for row in df.collect())
    assert got == want
    assert got


@pytest.mark.parametrize("name", list(QUERIES))
def test_plan_has_no_pairing_of_everything(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert word not in plan


def test_attribute_search_plan(spark, sf_dir):
    catalog = standin.stored_catalog(spark, sf_dir, "id", "kind", *P.ATTRIBUTES, "rating", "votes")
    found = P.attribute_neighbours(catalog, standin.as_batch(catalog))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "HashJoin" in plan or "SortMergeJoin" in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rank_plan_sorts_ranges_only(spark, sf_dir):
    ranked = R.global_row_number(standin.vectors(spark, sf_dir), ["rating", "id"])
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["qid", "predicted", "shown"] and df.count() > 0
