"""The whole chain on small text files: join, predict, prepare, predict, evaluate, profile."""

import random

import pytest

from affinara.plans import jobs


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("titles"), random.Random(1)
    basics = ["tconst\ttitleType\tprimaryTitle\toriginalTitle\tisAdult\tstartYear\tendYear\truntimeMinutes\tgenres"]
    crew, ratings, queries = ["tconst\tdirectors\twriters"], ["tconst\taverageRating\tnumVotes"], []
    for i in range(80):
        kind = rng.choice(["movie", "tvMovie", "tvSpecial", "short"])
        runtime, genres = rng.choice(["\\N", "90", "100"]), rng.choice(["Drama", "War,Drama", "\\N", "Comedy"])
        people = f"d{rng.randint(0, 9)}\tw{rng.randint(0, 9)}"
        basics.append(f"tt{i}\t{kind}\tX\tTitle {i}\t0\t2000\t\\N\t{runtime}\t{genres}")
        crew.append(f"tt{i}\t{people}")
        ratings.append(f"tt{i}\t{rng.randint(10, 100) / 10}\t{rng.randint(1, 500)}")
        if i < 5:
            queries.append(f"{i + 1}.0\tmovie\tQuery {i}\t0\t{runtime}\t{genres}\t{people}")
    for name, lines in (("basics", basics), ("crew", crew), ("ratings", ratings), ("queries", queries)):
        (folder / name).write_text("\n".join(lines) + "\n")
    return folder


def test_chain(spark, inputs):
    kinds = ["movie", "tvMovie", "tvSpecial"]
    titles = f"{inputs}/titles"
    catalog = jobs.join_titles(
        spark, f"{inputs}/basics", f"{inputs}/crew", f"{inputs}/ratings", titles, kinds, single_file=True
    )
    n = catalog.count()
    assert 0 < n < 80

    predicted = jobs.predict_by_attributes(spark, catalog, f"{inputs}/queries", f"{inputs}/report").collect()
    assert len(predicted) == 5 and all(1 <= r["predicted"] <= 10 for r in predicted)
    report = [r["value"] for r in spark.read.text(f"{inputs}/report").collect()]
    assert len(report) == 5 and {line.split("\t")[0] for line in report} == {f"Query {i}" for i in range(5)}

    train, test = jobs.prepare_features(spark, titles, f"{inputs}/prepared", wide_text=True)
    assert test.count() == n // 4 and train.count() == n - n // 4

    with pytest.raises(ValueError, match="too wide"):
        jobs.prepare_features(spark, titles, f"{inputs}/narrow", wide_text=True, most_columns=3)

    exact = jobs.predict_by_vectors(train, test, f"{inputs}/exact", method="exact")
    lsh = jobs.predict_by_vectors(train, test, f"{inputs}/lsh")
    assert exact.count() == lsh.count() == n // 4

    metrics, confusion = jobs.evaluate_file(spark, titles, f"{inputs}/exact")
    assert metrics.head()["n"] == n // 4
    assert sum(r["n"] for r in confusion.collect()) == n // 4
    (inputs / "tuples").write_text("((tt1,6.0,2.0), (tt2,7.0,4.0))")
    assert jobs.evaluate_file(spark, titles, f"{inputs}/tuples", "tuples")[0].head()["mean_seconds"] == 3.0

    summary = {r["column"]: r["n"] for r in jobs.profile_titles(spark, titles, train, test)["summary"].collect()}
    assert summary["rating"] == n
