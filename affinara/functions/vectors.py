"""Vector columns: dense ``ARRAY<DOUBLE>`` and sparse ``STRUCT<size, indices, values>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product of two dense vectors; raises if their lengths differ."""
    total = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda s, x: s + x,
    )
    return F.when(F.size(a) == F.size(b), total).otherwise(
        F.raise_error(F.lit("dot product of vectors of different length")).cast("double")
    )


def magnitude(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is all zero."""
    return F.try_divide(dot(a, b), magnitude(a) * magnitude(b))


def sparse(size: Column, indices: Column, values: Column) -> Column:
    """Sparse vector from the positions of its non-zero values, in ascending order."""
    return F.struct(
        size.cast("int").alias("size"),
        indices.cast("array<int>").alias("indices"),
        values.cast("array<double>").alias("values"),
    )


def sparse_of(v: Column) -> Column:
    """Dense vector to sparse form."""
    used = F.filter(F.transform(v, lambda x, i: F.when(x != 0.0, i)), lambda i: i.isNotNull())
    return sparse(F.size(v), used, F.filter(v, lambda x: x != 0.0))


def dense(v: Column) -> Column:
    """Sparse vector to ``ARRAY<DOUBLE>`` (for export; the operators work on the sparse form), filled in one pass."""
    # between two positions of the sparse form lie only zeros
    gap = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    last = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0).alias("at"))

    def fill(acc, e):
        return F.struct(
            F.concat(acc["out"], gap(e["indices"] - acc["at"]), F.array(e["values"])).alias("out"),
            (e["indices"] + 1).alias("at"),
        )

    done = F.aggregate(F.arrays_zip(v["indices"], v["values"]), last, fill)
    return F.concat(done["out"], gap(v["size"] - done["at"]))


def dense_from_row(*cols: Column) -> Column:
    """One row's number columns as a vector; a null becomes 0.0, so positions never shift."""
    return F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols])
