"""Random-projection LSH: index, candidates and prediction for whole query batches."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from affinara import kernels
from affinara.functions import bands as B
from affinara.functions.text import round_half_up
from affinara.operators.alike import lsh_by_class
from affinara.operators.neighbours import (
    BLOCK_KEYS,
    CATALOG_BLOCK,
    QUERY_BLOCK,
    blocks,
    bucket_blocks,
    every,
    grid,
    k_nearest,
    look_rows,
    part_of,
    shuffle_partitions,
)
from affinara.operators.predict import for_every_query, mean_rating
from affinara.shipping import by_value, is_small, join_spread, written

# Queries whose probes a task holds beside the sizes of all buckets.
BUDGET_QUERIES = 1024
# Sides of the blocks in which a batch with budgets meets the titles: a query's list of buckets is long, a title's keys are few.
PAIRS_CATALOG = 65_536
PAIRS_QUERIES = 256
# The queries' side where pairs are only counted.
COUNTED_QUERIES = 2048


def lsh_index(
    features: DataFrame,
    planes: int = 25,
    bands: int = 5,
    seed: str = "",
    id_name: str = "id",
    keep_signature: bool = False,
) -> DataFrame:
    """The rows with ``band_keys ARRAY<BIGINT>``, one bucket key per band, and their ``signature`` if asked for.

    One row per title: a bucket is every row with that key at that band, so the
    vectors are stored once. Write the index to use it for many batches. Query
    batches go through the same function with ``id_name="qid"``.
    """
    sig = B.signature(F.col("vector"), F.col(id_name), planes, seed)
    out = features.withColumn("signature", sig).withColumn(
        "band_keys", F.transform(B.split_bands(F.col("signature"), planes, bands), B.band_key)
    )
    return out if keep_signature else out.drop("signature")


def with_probes(
    queries: DataFrame, planes: int = 25, bands: int = 5, seed: str = "", most: int = 500
) -> DataFrame:
    """A batch that went through ``lsh_index`` with ``probes``: the ``most`` buckets nearest to each query.

    A search then looks into these in their order until its ``budget`` of candidates is
    spent, in place of the query's own bucket in every band. Use the index's own settings.
    """
    by_value(kernels)
    bucket = T.StructType([T.StructField("band", T.IntegerType()), T.StructField("key", T.LongType())])
    schema = T.StructType([*queries.schema.fields, T.StructField("probes", T.ArrayType(bucket))])
    return queries.mapInArrow(kernels.probe_adder(planes, bands, seed, most), schema)


def in_bands(index: DataFrame) -> DataFrame:
    """The index with one row per title and band: ``(band, band_key, ...)``."""
    return index.select(F.posexplode("band_keys").alias("band", "band_key"), *index.columns)


def bucket_sizes(index: DataFrame) -> DataFrame:
    """``(band, band_key, size)``: at most 2^(planes per band) rows per band."""
    return in_bands(index.select("band_keys")).groupBy("band", "band_key").agg(F.count(F.lit(1)).alias("size"))


def bucket_members(index: DataFrame) -> DataFrame:
    """``(band, band_key, id)``: the buckets in long form, one row per member."""
    return in_bands(index).select("band", "band_key", "id")


def looked_into(
    index: DataFrame,
    queries: DataFrame,
    columns: Sequence[str],
    max_share: float,
    sizes: DataFrame | None,
    budget: float | None = None,
) -> DataFrame:
    """``(qid, *columns, kept)``: the buckets that each query looks into, with their sizes.

    With a ``budget`` (a share of all titles) the queries' ``probes`` are taken in their
    order as long as the buckets' sizes together stay within it; the first that is not
    empty is always taken. Else it is the query's own bucket in every band:
    buckets of more than ``floor(N * max_share)`` titles are left out; a query
    that would lose all its buckets keeps the smallest (ties: lowest band).
    Queries that hit no bucket have no row. Written, because a search reads it
    several times.
    """
    sizes = written(bucket_sizes(index), "sizes") if sizes is None else sizes
    if budget is not None and is_small(sizes):
        return written(within_budget_by_blocks(queries, sizes, budget, columns), "looks")
    total = sizes.filter(F.col("band") == 0).agg(F.sum("size")).scalar()
    if budget is not None:
        kept = within_budget(queries, sizes, total * F.lit(budget))
        return written(queries.select("qid", *columns).join(kept, "qid"), "looks")
    looks = in_bands(queries.select("qid", "band_keys"))
    hits = join_spread(looks, sizes, BLOCK_KEYS[:2], "qid").withColumn(
        "small", F.col("size") <= F.floor(total * F.lit(max_share))
    )
    bucket = F.struct("band", F.col("band_key").alias("key"), "size")
    kept = (
        hits.groupBy("qid")  # at most one row per band
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("small"), bucket))).alias("smalls"),
            F.min_by(bucket, F.struct("size", "band")).alias("smallest"),
        )
        .select("qid", F.when(F.size("smalls") > 0, F.col("smalls")).otherwise(F.array("smallest")).alias("kept"))
    )
    return written(queries.select("qid", *columns).join(kept, "qid"), "looks")


def within_budget_by_blocks(queries: DataFrame, sizes: DataFrame, budget: float, columns: Sequence[str]) -> DataFrame:
    """``(qid, *columns, kept)`` where the sizes of all buckets fit beside a block of queries: probes are not made rows."""
    by_value(kernels)
    rows = queries.select("qid", *columns, "probes")
    n_q = blocks(rows.select(F.count(F.lit(1))).scalar(), BUDGET_QUERIES, 4 * shuffle_partitions(queries))
    left, right = sizes.withColumn("block_q", every(n_q)), rows.withColumn("block_q", part_of("qid", n_q))
    right, parts = right.select([F.col(name).alias(name) for name in right.columns]), shuffle_partitions(queries)
    left, right = left.repartition(parts, "block_q"), right.repartition(parts, "block_q")
    bucket = T.StructType([T.StructField("band", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("size", T.LongType())])
    schema = T.StructType([*rows.drop("probes").schema.fields, T.StructField("kept", T.ArrayType(bucket))])
    run = kernels.budget_taker(to_arrow_schema(schema), budget, tuple(columns))
    return left.groupBy("block_q").cogroup(right.groupBy("block_q")).applyInArrow(run, schema)


def within_budget(queries: DataFrame, sizes: DataFrame, budget: Column) -> DataFrame:
    """``(qid, kept)``: of each query's probes the first ones whose buckets hold no more titles than the budget."""
    probes = queries.select("qid", F.posexplode("probes").alias("place", "probe"))
    probes = probes.select("qid", "place", "probe.band", F.col("probe.key").alias("band_key"))
    hits = join_spread(probes, sizes, BLOCK_KEYS[:2], "qid")
    # at most as many rows a query as it has probes
    spent = F.sum("size").over(W.partitionBy("qid").orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    first = F.row_number().over(W.partitionBy("qid").orderBy("place")) == 1
    taken = hits.withColumn("spent", spent).withColumn("first", first).filter((F.col("spent") <= budget) | F.col("first"))
    bucket = F.struct("band", F.col("band_key").alias("key"), "size")
    return taken.groupBy("qid").agg(F.array_sort(F.collect_list(bucket)).alias("kept"))


def lsh_candidates(
    index: DataFrame,
    queries: DataFrame,
    max_share: float = 0.5,
    sizes: DataFrame | None = None,
    budget: float | None = None,
    form: str = "grid",
    catalog_block: int = CATALOG_BLOCK,
    query_block: int = QUERY_BLOCK,
    marks: str | None = None,
    counts: bool = False,
) -> DataFrame:
    """``(qid, cand_id)``: titles that share a kept bucket with the query, each once.

    ``queries`` is a batch that went through ``lsh_index``; ``sizes`` are the
    index's bucket sizes, if they are at hand. ``form="grid"`` cuts hot buckets into
    blocks on both sides; ``form="scan"`` sends the batch to every task, and is refused
    unless counting proves its rows to be few. A pair that meets in several kept buckets
    is emitted in the first of them only, so the pairs are distinct without another shuffle.

    Within a ``budget`` a query looks into many buckets: whole tables then meet in blocks,
    where each pair is found once. ``marks``, a list column of the queries, adds
    ``marked``: how often the title stands in its query's list. With ``counts`` the pairs are counted where they
    meet, ``(qid, hits, met)``: the sum of ``marked`` and the pairs, a marked one as often as it is marked; a query
    has a row for each block in which it meets a title.

    The pairs are the result: with the default settings about 15 % of all pairs of
    unrelated titles, at any size. Use ``lsh_neighbours`` where the k best are wanted.
    """
    if marks is not None and budget is None:
        raise ValueError("marks need a budget")
    if counts and (marks is None or form != "grid"):
        raise ValueError("counts need marks and form='grid'")
    looks = looked_into(index, queries, [] if marks is None else [marks], max_share, sizes, budget)
    if budget is not None and form == "grid":
        return pairs_in_blocks(index, looks, marks, counts)
    catalog = index.select("id", "band_keys")
    if form == "scan":
        if not is_small(look_rows(looks)):
            raise ValueError("the batch's buckets are too many for form='scan': use form='grid'")
        return listed_pairs(in_bands(catalog), F.broadcast(look_rows(looks)), BLOCK_KEYS[:2])
    one_key = F.size(F.array_distinct(F.transform("kept", lambda b: F.struct(b["band"], b["key"])))) == F.size(
        F.array_distinct(F.transform("kept", lambda b: b["band"]))
    )
    last = F.max(F.array_max(F.transform("kept", lambda b: b["band"])))
    facts = looks.agg(F.coalesce(last, F.lit(0)).alias("last"), F.count_if(~one_key).alias("several")).head()
    left, right = bucket_blocks(catalog, looks, catalog_block, query_block)
    found = first_pairs(left, right.filter(one_key) if facts["several"] else right, facts["last"])
    # an id with several rows of different vectors looks into several buckets of a band
    return found.unionByName(listed_pairs(left, right.filter(~one_key).hint("merge"), BLOCK_KEYS)) if facts["several"] else found


def listed_pairs(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """``(qid, cand_id)`` of rows that meet, if their bucket is the first of the query's list that holds the title."""
    met = F.filter("kept", lambda b: b["key"] == F.get("band_keys", b["band"]))
    return (
        left.join(right, on)
        .filter(F.get(met, F.lit(0))["band"] == F.col("band"))
        .select("qid", F.col("id").alias("cand_id"))
    )


def first_pairs(left: DataFrame, right: DataFrame, last: int) -> DataFrame:
    """The same for queries with one kept bucket a band: keys of the bands before ``last`` are plain columns, so a pair costs a few comparisons and no list."""

    def kept_key(band: int) -> Column:
        bucket = F.get(F.filter("kept", lambda b: b["band"] == band), F.lit(0))
        return F.when(F.col("band") > band, bucket["key"])

    rows = left.select(*BLOCK_KEYS, "id", *[F.get("band_keys", F.lit(b)).alias(f"_own_{b}") for b in range(last)])
    looks = right.select(*BLOCK_KEYS, "qid", *[kept_key(b).alias(f"_kept_{b}") for b in range(last)])
    before = F.lit(False)
    for b in range(last):
        before = before | F.coalesce(F.col(f"_own_{b}") == F.col(f"_kept_{b}"), F.lit(False))
    # the copies per block make the looks larger than Spark's estimate: never broadcast them on that
    return rows.join(looks.hint("merge"), BLOCK_KEYS).filter(~before).select("qid", F.col("id").alias("cand_id"))


def pairs_in_blocks(index: DataFrame, looks: DataFrame, marks: str | None = None, counts: bool = False) -> DataFrame:
    """``(qid, cand_id)``, and ``marked`` if asked for, or their counts: titles and queries meet once, in blocks that hold few queries with long lists."""
    by_value(kernels)
    n_c = blocks(index.select(F.count(F.lit(1))).scalar(), PAIRS_CATALOG)
    n_q = blocks(looks.select(F.count(F.lit(1))).scalar(), PAIRS_QUERIES)
    if counts:
        n_q = blocks(looks.select(F.count(F.lit(1))).scalar(), COUNTED_QUERIES, ceil(sqrt(4 * shuffle_partitions(index))))
    kept = F.transform("kept", lambda b: F.struct(b["band"].alias("band"), b["key"].alias("key"))).alias("kept")
    own, asked = index.select("id", "band_keys"), looks.select("qid", kept, *([] if marks is None else [marks]))
    left, right = grid(own, asked.select([F.col(name).alias(name) for name in asked.columns]), n_c, n_q)
    parts, keys = shuffle_partitions(index), BLOCK_KEYS[2:]
    left, right = left.repartition(parts, *keys), right.repartition(parts, *keys)
    pair = [T.StructField("qid", looks.schema["qid"].dataType), T.StructField("cand_id", index.schema["id"].dataType)]
    schema = T.StructType(pair if marks is None else [*pair, T.StructField("marked", T.LongType())])
    if counts:
        schema = T.StructType([pair[0], T.StructField("hits", T.LongType()), T.StructField("met", T.LongType())])
    run = kernels.bucket_pairs(to_arrow_schema(schema), marks, counts)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def lsh_neighbours(
    index: DataFrame,
    queries: DataFrame,
    k: int = 10,
    max_share: float = 0.5,
    neighbour_order: str = "similarity",
    include_self: bool = False,
    sizes: DataFrame | None = None,
    budget: float | None = None,
    form: str = "grid",
    **block_sides,
) -> DataFrame:
    """The k best among each query's candidates: ``(qid, id, score, rating, rank)``.

    Similarity is computed bucket by bucket; candidate pairs are never written out.
    ``neighbour_order="id_desc"`` takes the k largest ids instead of the most similar.
    ``form="classes"`` gives the same rows and scores equal vectors of a bucket once
    (``operators.alike``).
    """
    if neighbour_order not in ("similarity", "id_desc"):
        raise ValueError(f"unknown neighbour order: {neighbour_order}")
    by_id = neighbour_order == "id_desc"
    if form == "classes":
        if by_id:
            raise ValueError("form='classes' is for the most similar")
        return lsh_by_class(index, looked_into(index, queries, ["vector"], max_share, sizes, budget), k, include_self, **block_sides)
    data = [] if by_id else ["vector"]
    scorer = (kernels.MembershipScorer if by_id else kernels.CosineScorer)(exclude_self=not include_self)
    return k_nearest(
        index.select("id", "band_keys", *data, "rating"),
        looked_into(index, queries, data, max_share, sizes, budget),
        scorer,
        k,
        carry=["rating"],
        in_buckets=True,
        id_desc=by_id,
        form=form,
        **block_sides,
    )


def lsh_predict(
    index: DataFrame, queries: DataFrame, k: int = 10, denominator: str = "found", **options
) -> DataFrame:
    """``(qid, predicted)``: mean rating of the LSH neighbours, rounded half-up to one place."""
    found = lsh_neighbours(index, queries, k, **options)
    means = found.groupBy("qid").agg(round_half_up(mean_rating(k, denominator)).alias("predicted"))
    return for_every_query(queries, means)
