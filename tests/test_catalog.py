import pytest
from pyspark.sql import functions as F

from affinara.functions import vectors as V
from affinara.operators import catalog as C
from affinara.operators import features as Fe
from affinara.sources import predictions as Sp
from affinara.sources import tables as St

BASICS = """tconst\ttitleType\tprimaryTitle\toriginalTitle\tisAdult\tstartYear\tendYear\truntimeMinutes\tgenres
tt1\tmovie\tA\t"Open quote\t0\t1999\t\\N\t100\tDrama,War
tt2\ttvMovie\tB\tB\t1\t2000\t\\N\t\\N\t\\N
tt3\tshort\tC\tC\t0\t2001\t\\N\t10\tComedy
tt4\tmovie\tD\tD\t0\t2001\t\\N\t95\tComedy
"""
CREW = "tconst\tdirectors\twriters\ntt1\tnm1,nm2\tnm3\ntt2\t\\N\tnm4,nm4\ntt3\tnm5\t\\N\ntt4\tnm5\tnm6\n"
RATINGS = "tconst\taverageRating\tnumVotes\ntt1\t7.5\t10\ntt2\t6.0\t20\ntt3\t5.0\t30\n"
QUERIES = "\\N\tmovie\tQ\t0\t90\tDrama\tnm1\tnm3\n\\N\tmovie\tQ\t0\t90\tDrama\tnm1\tnm3\n6.0\tmovie\tR\t0\t\\N\t\\N\tnm9\t\\N\n"


@pytest.fixture()
def files(tmp_path):
    for name, text in (("basics", BASICS), ("crew", CREW), ("ratings", RATINGS), ("queries", QUERIES)):
        (tmp_path / f"{name}.tsv").write_text(text)
    return tmp_path


def catalog(spark, files, **options):
    return C.build_catalog(
        St.read_ratings(spark, f"{files}/ratings.tsv"),
        St.read_basics(spark, f"{files}/basics.tsv"),
        St.read_crew(spark, f"{files}/crew.tsv"),
        **options,
    )


def test_build_catalog(spark, files):
    rows = {r["id"]: r for r in catalog(spark, files).collect()}
    assert sorted(rows) == ["tt1", "tt2", "tt3"]  # tt4 has no rating
    assert rows["tt1"]["title"] == '"Open quote' and rows["tt1"]["genres"] == ["Drama", "War"]
    assert rows["tt2"]["runtime"] is None and rows["tt2"]["genres"] == ["\\N"]
    assert rows["tt2"]["writers"] == ["nm4", "nm4"]
    kinds = catalog(spark, files, kinds=["movie", "tvMovie", "tvSpecial"])
    assert sorted(r["id"] for r in kinds.collect()) == ["tt1", "tt2"]


def test_queries_and_predictions_per_row(spark, files):
    from affinara.operators.predict import attribute_predict

    batch = C.as_queries(St.read_queries(spark, f"{files}/queries.tsv"))
    assert batch.count() == 3 and batch.select("qid").distinct().count() == 2
    got = attribute_predict(catalog(spark, files), batch).collect()
    assert len(got) == 3 and all(r["predicted"] is not None for r in got)


def test_title_table_roundtrip(spark, files, tmp_path):
    out = str(tmp_path / "titles")
    table = catalog(spark, files)
    St.write_tsv(St.titles_out(table), out, single_file=True)
    back = C.as_catalog(St.read_titles(spark, out))
    key = lambda rows: sorted([tuple(map(str, r)) for r in rows])
    assert key(back.select(table.columns).collect()) == key(table.collect())
    with pytest.raises(Exception, match="(?i)exists"):
        St.write_tsv(St.titles_out(table), out)


def test_rows_with_ids(spark, tiny):
    ids = spark.createDataFrame([("t1",), ("t1",), ("zz",)], "id string")
    assert [r["id"] for r in C.rows_with_ids(tiny, ids).collect()] == ["t1"]


def test_features_tiny(tiny):
    features, vocabulary = Fe.build_features(tiny)
    names = [r["name"] for r in vocabulary.orderBy("pos").collect()]
    assert names == [
        "flag", "is_Drama", "is_War", "is_\\N", "avg_runtime", "is_movie", "is_tvMovie", "is_tvSpecial", "d1", "d3", "d2",
    ]
    rows = {r["id"]: r["v"] for r in features.select("id", V.dense(F.col("vector")).alias("v")).collect()}
    assert rows["t1"] == pytest.approx([0, 1, 1, 0, 100 - 250 / 3, 1, 0, 0, 1, 0, 0])
    assert rows["t3"] == [1, 0, 0, 1, 0, 0, 1, 0, 0, 1, 1]
    assert rows["t5"] == pytest.approx([0, 0, 0, 0, 60 - 250 / 3, 0, 0, 1, 0, 1, 0])


def test_feature_options(tiny):
    features, vocabulary = Fe.build_features(tiny, top_n=2, exclude=(), skip=1, include_votes=True)
    names = [r["name"] for r in vocabulary.orderBy("pos").collect()]
    # counts: d1 2, d3 2, \N 1, d2 1; the first rank is left out
    assert names[-3:] == ["d3", "\\N", "votes"]
    row = features.filter("id = 't2'").select(V.dense(F.col("vector")).alias("v")).head()["v"]
    assert row[-1] == 300.0 and len(row) == len(names)


def test_many_distinct_genres(spark):
    """A vocabulary far longer than any array a row should hold."""
    n = 200_000
    rows = spark.range(n).select(
        F.col("id").cast("string").alias("id"), F.lit("t").alias("title"), F.lit(5.0).alias("rating"), F.lit(1).alias("votes"),
        F.lit("movie").alias("kind"), F.lit(0).alias("flag"), F.lit(90).alias("runtime"),
        F.array(F.format_string("g%06d", "id"), F.lit("common")).alias("genres"), F.array(F.lit("d")).alias("directors"),
    )
    features, vocabulary = Fe.build_features(rows)
    assert vocabulary.count() == 1 + (n + 1) + 1 + 3 + 1
    last = features.filter("id = '199999'").head()["vector"]
    assert last["size"] == n + 7 and last["indices"][:2] == [1, n + 1]
    assert features.count() == n


def test_wide_roundtrip(spark, tiny, tmp_path):
    features, vocabulary = Fe.build_features(tiny)
    names = Fe.column_names([r["name"] for r in vocabulary.orderBy("pos").collect()])
    out = str(tmp_path / "wide")
    St.write_tsv(Fe.wide_features(features, names), out)
    back = Fe.narrow_features(St.read_features(spark, out, names), names)
    assert sorted(back.select("id", "vector").collect()) == sorted(features.select("id", "vector").collect())


def test_prediction_lines(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_text("Predicted Rating for tt0315850: 7,0\nno separator here\na: b: c\nPredicted Rating for tt2: 6.8\n")
    got = sorted((r["id"], r["predicted"]) for r in Sp.read_lines(spark, str(path)).collect())
    assert got == [("tt0315850", 7.0), ("tt2", 6.8)]


def test_prediction_tuples(spark, tmp_path):
    path = tmp_path / "tuples.txt"
    path.write_text("((tt0249666,6.9,14.547), (tt1065093,6.4,6.497))\n")
    got = sorted(tuple(r) for r in Sp.read_tuples(spark, str(path)).collect())
    assert got == [("tt0249666", 6.9, 14.547), ("tt1065093", 6.4, 6.497)]


def test_long_tuple_line_is_split_over_tasks(spark, tmp_path):
    path = tmp_path / "long.txt"
    path.write_text("(" + ", ".join(f"(tt{i},6.5,1.25)" for i in range(5000)) + ")")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        df = Sp.read_tuples(spark, str(path))
        assert df.rdd.getNumPartitions() > 1
        assert df.count() == df.select("id").distinct().count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
