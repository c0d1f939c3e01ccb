import math

import pytest
from pyspark.sql import functions as F

from affinara.functions import bands as B
from affinara.functions import similarity as S
from affinara.functions import text as X
from affinara.functions import vectors as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


def texts(*items):
    return F.lit(None).cast("array<string>") if items == (None,) else F.array(*[F.lit(i) for i in items])


def doubles(*items):
    return F.array(*[F.lit(float(i)) for i in items])


@pytest.mark.parametrize(
    "value, expected",
    [("a,b,,", ["a", "b"]), ("a", ["a"]), ("a,,b", ["a", "", "b"]), (",,", []), ("", [""]), (None, None)],
)
def test_split_list(spark, value, expected):
    assert one(spark, X.split_list(F.lit(value).cast("string"))) == expected


@pytest.mark.parametrize("value, expected", [("\\N", 0), (None, 0), ("90", 90)])
def test_int_or_zero(spark, value, expected):
    assert one(spark, X.int_or_zero(F.lit(value).cast("string"))) == expected


def test_rounding_and_text(spark):
    assert one(spark, X.round_half_up(F.lit(6.25))) == 6.3
    assert one(spark, X.round_half_even(F.lit(6.5))) == 6.0
    assert one(spark, X.round_half_even(F.lit(7.5))) == 8.0
    assert one(spark, X.cut_text(F.lit(6.79))) == "6.7"
    assert one(spark, X.decimal_comma(F.lit("7,0"))) == 7.0
    assert one(spark, X.decimal_comma(F.lit("seven"))) is None


def test_flag_and_runtime_similarity(spark):
    none = F.lit(None).cast("int")
    assert one(spark, S.flag_similarity(F.lit(0), F.lit(0))) == 1.0
    assert one(spark, S.flag_similarity(F.lit(0), F.lit(1))) == 0.0
    assert one(spark, S.runtime_similarity(F.lit(100), F.lit(90))) == pytest.approx(0.9473711909899479, abs=1e-15)
    assert one(spark, S.runtime_similarity(none, none)) == 1.0
    assert one(spark, S.runtime_similarity(none, F.lit(100))) == pytest.approx(0.00009999000099991662, abs=1e-15)


@pytest.mark.parametrize(
    "a, b, exact, ratio",
    [
        (("Drama", "War"), ("Drama",), 0.0, 0.5),
        (("Drama", "War"), ("War", "Drama"), 1.0, 1.0),
        (("A", "A", "B"), ("A", "A"), 0.0, 2 / 3),
        (("A", "A"), ("A", "B"), 0.0, 0.5),
        (("\\N",), ("\\N",), 0.0, 0.0),
        ((None,), ("A",), 0.0, 0.0),
        ((), (), 0.0, 0.0),
    ],
)
def test_list_overlap(spark, a, b, exact, ratio):
    a, b = (texts(*x).cast("array<string>") for x in (a, b))
    assert one(spark, S.list_overlap(a, b, "exact")) == exact
    assert one(spark, S.list_overlap(a, b, "ratio")) == pytest.approx(ratio)
    assert one(spark, S.list_overlap(b, a, "ratio")) == pytest.approx(ratio)


def test_weighted_score(spark, tiny):
    pair = tiny.filter("id = 't1'").alias("a").crossJoin(tiny.filter("id = 't2'").alias("b"))
    a, b = (lambda n: F.col(f"a.{n}")), (lambda n: F.col(f"b.{n}"))
    for mode, expected in (("exact", 0.5482459987486038), ("ratio", 0.6315793320819372)):
        assert pair.select(S.attribute_score(a, b, overlap=mode)).head()[0] == pytest.approx(expected, abs=1e-12)


def test_vectors(spark):
    assert one(spark, V.dot(doubles(1, 2), doubles(3, 4))) == 11.0
    assert one(spark, V.cosine(doubles(1, 2), doubles(3, 4))) == pytest.approx(0.9838699100999074)
    assert one(spark, V.cosine(doubles(0, 0), doubles(3, 4))) is None
    assert one(spark, V.magnitude(doubles(3, 4))) == 5.0
    with pytest.raises(Exception, match="different length"):
        one(spark, V.dot(doubles(1), doubles(3, 4)))


def test_sparse_and_dense(spark):
    v = V.sparse(F.lit(5), F.array(F.lit(0), F.lit(3)), doubles(1, 2.5))
    assert one(spark, V.dense(v)) == [1.0, 0.0, 0.0, 2.5, 0.0]
    assert one(spark, V.dense(V.sparse_of(doubles(0, 4, 0)))) == [0.0, 4.0, 0.0]
    assert one(spark, V.sparse_of(doubles(0, 4, 0)))["indices"] == [1]
    row = V.dense_from_row(F.lit(1), F.lit(None).cast("double"), F.lit(2.0))
    assert one(spark, row) == [1.0, 0.0, 2.0]


@pytest.mark.parametrize(
    "count, bands, lengths", [(25, 5, [5] * 5), (7, 3, [3, 3, 1]), (6, 4, [2, 2, 2])]
)
def test_band_split(spark, count, bands, lengths):
    sig = F.array(*[F.lit(1)] * count)
    assert [len(b) for b in one(spark, B.split_bands(sig, count, bands))] == lengths


def test_band_keys(spark):
    band = F.array(*[F.lit(-1)] * 5)
    mixed = F.array(*[F.lit(s) for s in (1, -1, 1, 1, -1)])
    assert one(spark, B.band_key_mod(band, 13)) == -5
    assert one(spark, B.band_text(mixed)) == "1,-1,1,1,-1"
    assert one(spark, B.band_key(mixed)) == 0b110110
    assert one(spark, B.band_key(band)) == 0b100000
    assert len(one(spark, B.band_key_sha256(mixed))) == 64


def test_signature_matches_planes(spark):
    """The batch product and the plain plane table give the same sides."""
    planes = {r["k"]: r["p"] for r in B.planes(spark, 25, 8).collect()}
    assert set(x for p in planes.values() for x in p) == {-1.0, 1.0}
    rows = [(i, [math.sin(i * 7 + d) for d in range(8)]) for i in range(20)] + [(99, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = {r["id"]: r["s"] for r in df.select("id", B.signature(F.col("vector"), F.col("id")).alias("s")).collect()}
    for i, v in rows[:-1]:
        assert got[i] == [1 if sum(x * y for x, y in zip(v, planes[k])) > 0 else -1 for k in range(25)]
    # on every plane: the sign comes from the id, and is not constant
    assert set(got[99]) == {-1, 1}
