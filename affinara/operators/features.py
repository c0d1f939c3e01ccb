"""Feature vectors: flag, genre multi-hot, centred runtime, kind one-hot, director multi-hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from affinara.functions import vectors as V
from affinara.functions.text import MISSING
from affinara.operators.ranking import global_row_number
from affinara.shipping import broadcast_if_small, written

# The kinds that get a one-hot position, and the number of directors kept.
KINDS = ["movie", "tvMovie", "tvSpecial"]
TOP_DIRECTORS = 500


def tokens(catalog: DataFrame, name: str, keep: Sequence[str] = ("id",)) -> DataFrame:
    """One row per list item: ``(*keep, token)``."""
    return catalog.select(*keep, F.explode(name).alias("token"))


def token_counts(catalog: DataFrame, name: str) -> DataFrame:
    """``(token, n)``: titles (list entries) per item."""
    return tokens(catalog, name, keep=()).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def top_tokens(
    catalog: DataFrame, name: str, limit: int, exclude: Sequence[str] = (MISSING,), skip: int = 0
) -> DataFrame:
    """``(token, n)``: the most frequent items, ties by name; ``skip`` leaves out the first ranks."""
    counts = token_counts(catalog, name)
    if exclude:
        counts = counts.filter(~F.col("token").isin(*exclude))
    ranked = counts.orderBy(F.desc("n"), "token")
    return ranked.offset(skip).limit(limit) if skip else ranked.limit(limit)


# A vocabulary is a table ``(token, pos)``, however many items it has: tokens get their positions by a join.


def distinct_vocabulary(catalog: DataFrame, name: str) -> DataFrame:
    """``(token, pos)``: all distinct items in order; written."""
    found = global_row_number(tokens(catalog, name, keep=()).distinct(), ["token"], "nth")
    return written(found.select("token", (F.col("nth") - 1).cast("int").alias("pos")), "vocabulary")


def top_vocabulary(catalog: DataFrame, name: str, limit: int, exclude=(MISSING,), skip: int = 0) -> DataFrame:
    """``(token, pos)``: the most frequent items in rank order; at most ``limit`` rows, written."""
    # one row per kept rank here
    place = F.row_number().over(W.orderBy(F.desc("n"), "token")) - 1
    ranked = top_tokens(catalog, name, limit, exclude, skip).select("token", place.alias("pos"))
    return written(ranked, "vocabulary")


def hot_positions(catalog: DataFrame, name: str, vocabulary: DataFrame) -> DataFrame:
    """``(id, hot)``: ascending positions of a title's items that occur in the vocabulary; titles without one have no row."""
    found = tokens(catalog, name).distinct().join(broadcast_if_small(vocabulary), "token")
    return found.groupBy("id").agg(F.array_sort(F.collect_list("pos")).alias("hot"))


def mean_runtime(catalog: DataFrame) -> Column:
    return catalog.agg(F.avg("runtime")).scalar()


def centred_runtime(catalog: DataFrame) -> DataFrame:
    """``avg_runtime``: runtime minus its mean over the catalog; null stays null."""
    return catalog.withColumn("avg_runtime", F.col("runtime") - mean_runtime(catalog))


def kind_flags(kind: Column, kinds: Sequence[str] = tuple(KINDS)) -> dict[str, Column]:
    """One 1.0/0.0 column per kind."""
    return {f"is_{k}": F.when(kind == k, 1.0).otherwise(0.0) for k in kinds}


def build_features(
    catalog: DataFrame,
    kinds: Sequence[str] = tuple(KINDS),
    top_n: int = TOP_DIRECTORS,
    exclude: Sequence[str] = (MISSING,),
    skip: int = 0,
    include_votes: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """``(features, vocabulary)``.

    ``features`` is ``(id, title, rating, votes, vector)`` with a sparse vector, one row
    per title (ids are unique); ``vocabulary`` is ``(pos, name)``. Positions: flag, one
    per distinct genre, runtime (0.0 where missing), one per kind, one per kept director,
    and votes last if asked for. Items find their positions by joins with the two
    vocabulary tables; only the mean and the tables' sizes enter as scalars.
    """
    genres = distinct_vocabulary(catalog, "genres")
    directors = top_vocabulary(catalog, "directors", top_n, exclude, skip)
    rows = F.count(F.lit(1)).cast("int")
    summary = {
        "_genres": genres.select(rows).scalar(),
        "_directors": directors.select(rows).scalar(),
        "_mean": mean_runtime(catalog),
    }
    at_runtime = F.lit(1) + F.col("_genres")
    at_directors = at_runtime + 1 + len(kinds)
    length = at_directors + F.col("_directors") + (1 if include_votes else 0)
    flags = kind_flags(F.col("kind"), kinds)

    def single(pos: Column, value: Column) -> tuple[Column, Column]:
        """A position with one number: left out where it is zero or missing."""
        used = value.cast("double") != 0.0
        none = F.array()
        return (
            F.when(used, F.array(pos.cast("int"))).otherwise(none.cast("array<int>")),
            F.when(used, F.array(value.cast("double"))).otherwise(none.cast("array<double>")),
        )

    def block(hot: Column, start: Column) -> tuple[Column, Column]:
        """The hot positions of a 1.0/0.0 block that begins at ``start``."""
        return F.transform(hot, lambda p: p + start), F.array_repeat(F.lit(1.0), F.size(hot))

    parts = [
        single(F.lit(0), F.col("flag")),
        block(F.col("_genre_hot"), F.lit(1)),
        single(at_runtime, F.col("runtime") - F.col("_mean")),
        *[single(at_runtime + 1 + i, flag) for i, flag in enumerate(flags.values())],
        block(F.col("_director_hot"), at_directors),
        *([single(length - 1, F.col("votes"))] if include_votes else []),
    ]
    none = F.array().cast("array<int>")
    looked_up = catalog.select("id", "title", "rating", "votes", "flag", "runtime", "kind").withColumns(summary)
    for name, hot in (("genres", genres), ("directors", directors)):
        found = hot_positions(catalog, name, hot).withColumnRenamed("hot", f"_{name[:-1]}_hot")
        looked_up = looked_up.join(found, "id", "left")
    looked_up = looked_up.withColumns({c: F.coalesce(c, none) for c in ("_genre_hot", "_director_hot")})
    indices, values = (F.concat(*[part[i] for part in parts]) for i in (0, 1))
    features = looked_up.select("id", "title", "rating", "votes", V.sparse(length, indices, values).alias("vector"))

    one_row = catalog.sparkSession.range(1).withColumns(summary)
    single_names = [(F.lit(0), F.lit("flag")), (at_runtime, F.lit("avg_runtime"))]
    single_names += [(at_runtime + 1 + i, F.lit(flag)) for i, flag in enumerate(flags)]
    single_names += [(length - 1, F.lit("votes"))] if include_votes else []
    fixed = one_row.select(F.explode(F.array(*[F.struct(p.cast("int").alias("pos"), n.alias("name")) for p, n in single_names])).alias("e"))
    words = genres.select((F.col("pos") + 1).alias("pos"), F.concat(F.lit("is_"), "token").alias("name"))
    people = directors.withColumns(summary).select((F.col("pos") + at_directors).cast("int").alias("pos"), F.col("token").alias("name"))
    return features, fixed.select("e.pos", "e.name").unionByName(words).unionByName(people)


def column_names(names: Sequence[str]) -> list[str]:
    """Vocabulary names as column names: a name that differs from an earlier one in case only gets its position."""
    seen = {"id", "rating", "votes", "title"}
    out = []
    for pos, name in enumerate(names):
        out.append(f"{name}_{pos}" if name.lower() in seen else name)
        seen.add(out[-1].lower())
    return out


def wide_features(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """One DOUBLE column per position, for export as delimited text."""
    full = features.withColumn("_dense", V.dense(F.col("vector")))
    return full.select(
        "id", "rating", "votes", "title", *[F.col("_dense")[i].alias(name) for i, name in enumerate(names)]
    )


def narrow_features(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """Wide rows (as read from delimited text) back to sparse vectors; a null becomes 0.0."""
    values = V.dense_from_row(*[F.col(f"`{name}`") for name in names])
    return wide.select("id", "rating", "votes", "title", V.sparse_of(values).alias("vector"))
