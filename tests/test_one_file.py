"""One ordered file written by many tasks: the same bytes as a plain sorted write."""

import random

import pytest
from pyspark.sql import functions as F

from affinara.sources import predictions as Sp
from affinara.sources import tables as St
from affinara.sources.one_file import write_one_file

TEXTS = ["", "a", "ß", "日本 x", "\t", '"q"', "x" * 5000, None]


def rows_of(n, seed=3):
    r = random.Random(seed)
    return [(i, r.choice(TEXTS)) for i in r.sample(range(10 * n), n)]


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("n", [0, 1, 700])
def test_same_bytes_as_joined_texts(spark, tmp_path, n, closed):
    rows, path = rows_of(n), str(tmp_path / "out" / "one.txt")
    df = spark.createDataFrame(rows, "id long, t string").repartition(7)
    write_one_file(df, path, F.col("t"), ["id"], before="<é", separator=" ,ö", after=">", closed=closed)
    texts = [t or "" for _, t in sorted(rows, key=lambda r: r[0])]
    body = "".join(t + " ,ö" for t in texts) if closed else " ,ö".join(texts)
    assert open(path, encoding="utf-8", newline="").read() == f"<é{body}>"
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["one.txt"]
    with pytest.raises(FileExistsError):
        write_one_file(df, path, F.col("t"), ["id"])


def test_equal_rows_and_clashing_names_stay(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")] * 300 + [(None, "b")], "_text long, _end string").repartition(5)
    write_one_file(df, str(tmp_path / "f"), F.col("_end"), ["_text"])
    assert (tmp_path / "f").read_text() == "b\n" + "a\n" * 300


def test_rows_in_many_tasks_and_no_file_after_a_failure(spark, tmp_path):
    df = spark.range(20_000).repartition(9)
    write_one_file(df, str(tmp_path / "f"), F.col("id"), ["id"])
    assert (tmp_path / "f").read_text().split() == [str(i) for i in range(20_000)]
    broken = df.withColumn("t", F.when(F.col("id") == 777, F.raise_error("no")).otherwise(F.col("id").cast("string")))
    with pytest.raises(Exception, match="no"):
        write_one_file(broken, str(tmp_path / "g"), F.col("t"), ["id"])
    assert [p.name for p in tmp_path.iterdir()] == ["f"]


def test_single_tsv_equals_the_one_task_form(spark, tmp_path):
    rows = [(f"tt{i}", i / 7 if i % 5 else None, i, TEXTS[i % 8] if TEXTS[i % 8] != "\t" else "u") for i in range(200)]
    df = spark.createDataFrame(rows, "tconst string, rating double, votes int, title string").repartition(6)
    St.write_tsv(df, str(tmp_path / "one"), single_file=True, order=["tconst"])
    St.write_tsv(df.orderBy("tconst").coalesce(1), str(tmp_path / "plain"))
    (plain,) = (tmp_path / "plain").glob("part-*")
    (one,) = (tmp_path / "one").iterdir()
    assert one.read_bytes() == plain.read_bytes()
    with pytest.raises(FileExistsError):
        St.write_tsv(df, str(tmp_path / "one"), single_file=True)
    St.write_tsv(df.limit(0), str(tmp_path / "none"), single_file=True)
    assert (tmp_path / "none" / "part-00000.csv").read_text() == "tconst\trating\tvotes\ttitle\n"


def test_array_report_and_one_line_of_tuples(spark, tmp_path):
    pairs = spark.createDataFrame([("b", 7.0, None), ("a", 5.5, 6.25), ("c", None, 8.0)], "id string, actual double, predicted double")
    Sp.write_array_report(pairs, str(tmp_path / "r"))
    assert (tmp_path / "r" / "actual.txt").read_text() == "Array(5.5, 7.0, NaN)\n"
    assert (tmp_path / "r" / "predicted.txt").read_text() == "Array(6.25, NaN, 8.0)\n"
    back = [r["value"] for r in Sp.read_array(spark, str(tmp_path / "r" / "predicted.txt")).collect()]
    assert sorted(back, key=str) == ["6.25", "8.0", None]
    tuples = pairs.select("id", Sp.tuple_text(F.col("id"), F.col("actual"), F.lit(2.0)).alias("value")).filter("id != 'c'")
    Sp.write_one_line(tuples, str(tmp_path / "t"), ["id"])
    assert (tmp_path / "t").read_text() == "((a,5.5,2.0), (b,7.0,2.0))"
    assert sorted(r["id"] for r in Sp.read_tuples(spark, str(tmp_path / "t")).collect()) == ["a", "b"]
