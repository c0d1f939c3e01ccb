"""Random-projection signatures, their bands and the bands' bucket keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinara import kernels
from affinara.shipping import by_value


def hash_sign(text: Column) -> Column:
    """-1 or +1 from the first hex digit of the text's MD5."""
    return F.when(F.substring(F.md5(text), 1, 1) >= "8", 1).otherwise(-1)


def planes(spark: SparkSession, count: int = 25, length: int = 534, seed: str = "") -> DataFrame:
    """Hyperplanes ``(k, p ARRAY<DOUBLE>)`` with entries -1.0 or +1.0, the same in every run."""
    return spark.range(count).select(
        F.col("id").cast("int").alias("k"),
        F.transform(
            F.sequence(F.lit(0), F.lit(length - 1)),
            lambda d: hash_sign(F.concat(F.lit(seed), F.col("id").cast("string"), F.lit(":"), d.cast("string"))).cast(
                "double"
            ),
        ).alias("p"),
    )


def signature(vector: Column, id_col: Column, count: int = 25, seed: str = "") -> Column:
    """Side of each plane the vector lies on: ``ARRAY<INT>`` of -1 and +1.

    The projections are one matrix product per Arrow batch. A vector lying on a
    plane takes the sign of ``md5("id:k")``.
    """
    by_value(kernels)
    sides = F.arrow_udf(kernels.plane_sides(count, seed), T.ArrayType(T.ByteType()))
    return F.transform(
        sides(vector),
        lambda s, k: F.when(
            s == 0, hash_sign(F.concat(id_col.cast("string"), F.lit(":"), k.cast("string")))
        ).otherwise(s.cast("int")),
    )


def split_bands(sig: Column, count: int, bands: int) -> Column:
    """Signature of ``count`` values cut into at most ``bands`` runs of equal length; the last may be short."""
    length = -(-count // bands)
    used = -(-count // length)
    return F.transform(
        F.sequence(F.lit(0), F.lit(used - 1)), lambda b: F.slice(sig, b * length + 1, F.lit(length))
    )


def band_text(band: Column) -> Column:
    """``1,-1,...``: the text form that the hashed keys are built from; itself a collision-free key."""
    return F.concat_ws(",", F.transform(band, lambda s: s.cast("string")))


def band_key(band: Column) -> Column:
    """The band's signs packed into one BIGINT: equal exactly when ``band_text`` is equal.

    Holds up to 62 planes per band (the leading 1 keeps bands of different length apart).
    """
    return F.aggregate(band, F.lit(1).cast("long"), lambda acc, s: acc * 2 + F.when(s > 0, 1).otherwise(0))


def band_key_mod(band: Column, prime: int = 13) -> Column:
    """Sum of the signs modulo a prime; the sign follows the sum."""
    return F.aggregate(band, F.lit(0), lambda acc, s: acc + s) % prime


def band_key_sha256(band: Column) -> Column:
    """Whole SHA-256 digest of the band's text form."""
    return F.sha2(band_text(band), 256)
