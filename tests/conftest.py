import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


TITLES = [
    # id, rating, votes, kind, title, flag, runtime, genres, directors, writers
    ("t1", 8.0, 100, "movie", "Alpha", 0, 100, "Drama,War", "d1", "w1"),
    ("t2", 6.0, 300, "movie", "Beta", 0, 90, "Drama", "d1", "w2"),
    ("t3", 5.0, 300, "tvMovie", "Gamma", 1, None, "\\N", "d2,d3", "\\N"),
    ("t4", 7.0, 50, "movie", "Alpha", 0, None, "War,Drama", "\\N", "w1,w1"),
    ("t5", 4.0, 10, "tvSpecial", None, 0, 60, None, "d3", "w3"),
]


@pytest.fixture(scope="session")
def tiny(spark):
    from affinara.operators.catalog import with_lists

    schema = (
        "id string, rating double, votes int, kind string, title string, flag int, runtime int, "
        "genres string, directors string, writers string"
    )
    return with_lists(spark.createDataFrame(TITLES, schema)).cache()
