"""Neighbour search over distinct vectors: rows that score alike with everything are one.

Titles of equal vectors score alike with every query, and queries of equal vectors
score alike with every title. So each side meets the other with one row per vector
(for LSH one per bucket and vector, and one query per vector and kept buckets). A
class keeps its few least ids, as ties go by id, and each query takes its own k best
from its class's list. The rows are those of the full search. What it costs grows with
the square of the distinct vectors, not of the titles; where all vectors differ it is
the full search.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from affinara import kernels
from affinara.operators.neighbours import BLOCK_KEYS, every, k_nearest, look_rows, part_of
from affinara.operators.ranking import global_row_number
from affinara.shipping import broadcast_if_small, join_spread, written

# Queries of a class that take its list in one part.
CLASS_QUERIES = 8192


def digest(*names: str) -> Column:
    """Equal where these columns are equal: 256 bits of their text."""
    return F.sha2(F.to_json(F.struct(*names)), 256)


def least_members(rows: DataFrame, key: Sequence[str], most: int) -> DataFrame:
    """``(*key, members)``: the ``most`` least ids of each key with their ratings, each id once."""
    once = rows.groupBy(*key, "id").agg(F.first("rating").alias("rating"))
    place = F.row_number().over(W.partitionBy(*key).orderBy("id"))
    least = once.withColumn("_place", place).filter(F.col("_place") <= most)
    return least.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("id", "rating"))).alias("members"))


def numbered(classes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Classes with ``id``, a number in the order of their least ids; written."""
    keyed = classes.select("*", F.element_at("members", 1)["id"].alias("_least"), digest(*key).alias("_digest"))
    return global_row_number(keyed, ["_least", "_digest"], "id").drop("_least", "_digest")


def repeated_ids(rows: DataFrame) -> DataFrame | None:
    """``(_again)``: the ids that more than one row has; none where ids are unique."""
    counts = rows.groupBy(F.col("id").alias("_again")).agg(F.count(F.lit(1)).alias("_n"))
    again = written(counts.filter(F.col("_n") > 1).select("_again"), "repeated-ids")
    return None if again.isEmpty() else again


def class_lists(found: DataFrame, classes: DataFrame, k: int, in_buckets: bool) -> DataFrame:
    """``(alike, id, score, rating)``: the k + 1 best titles, one more for the query's own, from the classes found; written."""
    within = ["band"] if in_buckets else []
    sized = classes.select(F.col("id").alias("_class"), *within, F.size("members").alias("_size"))
    rows = found.select(F.col("qid").alias("alike"), F.col("id").alias("_class"), "score").join(sized, "_class")
    # classes of a band share no row: after so many members no lower score counts
    down, level = W.partitionBy("alike", *within).orderBy(F.desc("score")), W.partitionBy("alike", *within, "score")
    rows = rows.withColumn("_above", F.sum("_size").over(down) - F.sum("_size").over(level)).filter(F.col("_above") <= k)
    members = classes.select(F.col("id").alias("_class"), "members")
    rows = rows.select("alike", "score", "_class").join(members, "_class").select("alike", "score", F.explode("members").alias("_m"))
    rows = rows.select("alike", "_m.id", "score", "_m.rating")
    if in_buckets:
        rows = rows.groupBy("alike", "id").agg(F.max("score").alias("score"), F.first("rating").alias("rating"))
    place = F.row_number().over(W.partitionBy("alike").orderBy(F.desc("score"), "id"))
    return written(rows.withColumn("_place", place).filter(F.col("_place") <= k + 1).drop("_place"), "class-lists")


def from_lists(lists: DataFrame, asked: DataFrame, include_self: bool, in_buckets: bool) -> DataFrame:
    """``(qid, id, score, rating)``: each query ``(qid, alike)`` with its class's list, less itself."""
    best = lists.groupBy("alike").agg(F.collect_list(F.struct("id", "score", "rating")).alias("best"))
    # a class of many queries takes its list in several parts; no more such classes than parts
    sizes = asked.groupBy("alike").agg(F.ceil(F.count(F.lit(1)) / CLASS_QUERIES).cast("int").alias("_parts")).filter(F.col("_parts") > 1)
    large = broadcast_if_small(written(sizes, "large-classes"))
    parts = F.coalesce("_parts", F.lit(1))
    left = asked.join(large, "alike", "left").withColumn("_part", part_of("qid", parts)).drop("_parts")
    right = best.join(large, "alike", "left").withColumn("_part", every(parts)).drop("_parts")
    rows = left.join(right, ["alike", "_part"]).select("qid", F.explode("best").alias("_b")).select("qid", "_b.*")
    if not include_self:
        own = F.col("id").cast(asked.schema["qid"].dataType) == F.col("qid")
        rows = rows.filter(~F.coalesce(own, F.lit(False)))
    # equal rows of a batch count once in buckets
    return rows.distinct() if in_buckets else rows


def of_every_query(lists: DataFrame, asked: DataFrame, again: DataFrame | None, search, k: int, include_self: bool, in_buckets: bool) -> DataFrame:
    """``(qid, id, score, rating, rank)`` from the lists of classes, or by ``search`` for queries with a repeated id in theirs.

    Rows of one id take places of their own before they count once, so lists of classes, where
    each id has one place, are for ids of one row.
    """
    rest = None
    if again is not None:
        held = lists.join(again, F.col("id").eqNullSafe(F.col("_again")), "left_semi").select("alike").distinct()
        theirs = written(asked.join(held, "alike", "left_semi").select(F.col("qid").alias("_qid")).distinct(), "searched-in-full")
        same = F.col("qid").eqNullSafe(F.col("_qid"))
        rest, asked = search(asked.join(theirs, same, "left_semi")), asked.join(theirs, same, "left_anti")
    rows = from_lists(lists, asked.select("qid", "alike"), include_self, in_buckets)
    place = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))
    ranked = rows.withColumn("rank", place).filter(F.col("rank") <= k).select("qid", "id", "score", "rating", "rank")
    return ranked if rest is None else ranked.unionByName(rest)


def nearest_of_all(rows: DataFrame, asked: DataFrame, k: int, include_self: bool, **blocks) -> DataFrame:
    return k_nearest(rows, asked, kernels.CosineScorer(exclude_self=not include_self), k, carry=["rating"], **blocks)


def cosine_by_class(features: DataFrame, queries: DataFrame, k: int, include_self: bool = False, nearest=nearest_of_all, **blocks) -> DataFrame:
    """The k most similar titles by exact cosine, each pair of distinct vectors scored once, by the search ``nearest``."""
    rows = features.select("id", "vector", "rating")
    classes = numbered(least_members(rows, ["vector"], k + 1), ["vector"])
    asked = written(queries.select("qid", "vector", digest("vector").alias("alike")), "asked")
    kinds = written(asked.select(F.col("alike").alias("qid"), "vector").dropDuplicates(["qid"]), "kinds")
    # each class has a title of its own, and at most one of them is the query
    kept = classes.select("id", "vector", F.element_at("members", 1)["rating"].alias("rating"))
    found = nearest(kept, kinds, k + 1, True, **blocks)

    def search(some):
        return nearest(rows, some.select("qid", "vector"), k, include_self, **blocks)

    lists = class_lists(found, classes, k, False)
    return of_every_query(lists, asked, repeated_ids(rows), search, k, include_self, False)


def bucket_classes(index: DataFrame, k: int) -> DataFrame:
    """``(id, band, band_key, vector, members)``: the distinct vectors of every bucket."""
    whole = least_members(index, ["vector", "band_keys"], k + 1)
    rows = whole.select("vector", "members", F.posexplode("band_keys").alias(*BLOCK_KEYS[:2]))
    rows = rows.select(*BLOCK_KEYS[:2], "vector", F.explode("members").alias("_m")).select(*BLOCK_KEYS[:2], "vector", "_m.*")
    key = [*BLOCK_KEYS[:2], "vector"]
    return numbered(least_members(rows, key, k + 1), key)


def lsh_by_class(index: DataFrame, looks: DataFrame, k: int, include_self: bool = False, **blocks) -> DataFrame:
    """The k best among each query's candidates; ``looks`` has ``(qid, vector, kept)``, the buckets each query looks into."""
    rows = index.select("id", "band_keys", "vector", "rating")
    classes = bucket_classes(rows, k)
    asked = written(looks.select("qid", "vector", "kept", digest("vector", "kept").alias("alike")), "asked")
    kinds = asked.select(F.col("alike").alias("qid"), "vector", "kept").dropDuplicates(["qid"])
    # blocks go by the classes of a bucket, not by its titles
    sizes = written(classes.groupBy(*BLOCK_KEYS[:2]).agg(F.count(F.lit(1)).alias("size")), "class-sizes")
    hits = join_spread(look_rows(kinds.select("qid", "kept")).drop("rows_c", "kept"), sizes, BLOCK_KEYS[:2], "qid")
    kept = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("band", F.col("band_key").alias("key"), "size"))).alias("kept"))
    kinds = written(kinds.select("qid", "vector").join(kept, "qid"), "kinds")
    bands = rows.agg(F.coalesce(F.max(F.size("band_keys")), F.lit(1)).alias("n")).head()["n"]
    # a title stands in one class of each band
    found = k_nearest(classes.drop("members"), kinds, kernels.CosineScorer(exclude_self=False), bands * (k + 1), in_buckets=True, **blocks)

    def search(some):
        scorer = kernels.CosineScorer(not include_self)
        return k_nearest(rows, some.select("qid", "vector", "kept"), scorer, k, carry=["rating"], in_buckets=True, **blocks)

    lists = class_lists(found, classes, k, True)
    return of_every_query(lists, asked, repeated_ids(rows), search, k, include_self, True)
