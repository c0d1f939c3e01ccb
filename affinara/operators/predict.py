"""Rating prediction for whole query batches: by attributes or by cosine similarity."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from affinara import kernels
from affinara.functions.similarity import (
    Weights,
    attribute_score,
    counted,
    counted_overlap,
)
from affinara.functions.sums import exact_mean, exact_sum
from affinara.functions.text import MISSING
from affinara.operators.alike import cosine_by_class
from affinara.operators.neighbours import k_nearest, shuffle_partitions
from affinara.operators.pruned import pruned_neighbours
from affinara.shipping import broadcast_if_small, join_spread, written

ATTRIBUTES = ["title", "flag", "runtime", "genres", "writers", "directors"]
ROLES = ["writers", "directors"]
LISTS = ["genres", *ROLES]
# What a pair scores by if it shares no person, but for the names, which must differ.
CELL = ["flag", "runtime", "genres"]
# A person with more titles than this is scored in blocks, not through the index, unless the index stays small all the same.
HOT_TITLES = 100
# People of more titles go through the index as long as it holds no more pairs than this for a query on average.
PAIRS_PER_QUERY = 4000
# Lists of the k best are sent to every task only if there are no more than this.
SENT_LISTS = 20_000


def attribute_neighbours(
    catalog: DataFrame,
    queries: DataFrame,
    k: int = 50,
    weights: Weights = Weights(),
    overlap: str = "ratio",
    kinds: list[str] | None = None,
    hot_titles: int | None = None,
    **blocks,
) -> DataFrame:
    """The k titles most alike by weighted attributes: ``(qid, id, score, rank, rating, votes)``.

    A title of the query's own name is never its neighbour, nor is one without a name.

    Titles equal in flag, runtime, genres, hot people (those of more than ``hot_titles``
    titles) and the lengths of the lists with such people score alike with every query
    unless they share one of the other, rare people: they are one cell, of which a few
    members can be among the k best. Queries meet the cells in blocks, hot people included,
    so a person with a third of all titles makes no pairs of titles; queries that are equal
    in all this and in name meet them once.

    Pairs that share rare people come from an inverted index, at most ``hot_titles``
    for each person of a query. They are scored by codes of their items where they meet;
    only those that reach the query's k-th score among the cells are shuffled and scored
    in full. A title's full score is never below its cell's, so the k best of both are the
    k best of all.

    ``hot_titles`` is measured where it is not given: ``HOT_TITLES``, or the greatest power
    of two that keeps the index within ``PAIRS_PER_QUERY`` pairs for a query on average.
    """
    if overlap not in ("ratio", "exact"):
        raise ValueError(f"unknown overlap mode: {overlap}")
    if kinds is not None:
        catalog = catalog.filter(F.col("kind").isin(*kinds))
    catalog = catalog.filter(F.col("title").isNotNull()).select("id", *ATTRIBUTES, "rating", "votes")
    queries = queries.filter(F.col("title").isNotNull()).select("qid", *ATTRIBUTES)
    if hot_titles is None:
        hot_titles = measured_hot_titles(catalog, queries)
    hot = written(hot_people(catalog, hot_titles), "hot-people")
    titles, asked = with_hot_people(catalog, "id", hot), with_hot_people(queries, "qid", hot)
    titles, asked = written(titles, "titles"), written(asked, "asked")
    near = written(best_of_cells(titles, asked, k, weights, overlap, **blocks), "near")
    rare = with_rare_people(titles, asked, hot, near, k, weights, overlap)
    both = near.unionByName(rare).groupBy("qid", "id")
    best = both.agg(F.max("score").alias("score"), F.first("rating").alias("rating"), F.first("votes").alias("votes"))
    return k_first(best, "qid", k).select("qid", "id", "score", "rank", "rating", "votes")


def k_first(rows: DataFrame, owner: str, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy(owner).orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", place).filter(F.col("rank") <= k)


def known_items(name: str) -> Column:
    """A list's items; none if it is null or holds the missing mark."""
    held = F.col(name).isNotNull() & ~F.array_contains(name, MISSING)
    return F.when(held, F.col(name)).otherwise(F.array().cast("array<string>"))


def people(rows: DataFrame, id_name: str, *carry: str) -> DataFrame:
    """``(person, times, id, *carry)``: one row for each director and each writer of a title, and how often it is listed."""

    def tagged(role):
        items = known_items(role)
        distinct = F.array_distinct(F.filter(items, lambda x: x.isNotNull()))
        once = F.size(distinct) == F.size(items)
        times = lambda x: F.when(once, 1).otherwise(F.size(F.filter(items, lambda y: y == x)))
        return F.transform(distinct, lambda x: F.struct(F.struct(F.lit(role).alias("role"), x.alias("name")).alias("person"), times(x).alias("times")))

    named = rows.select(id_name, *carry, F.explode(F.concat(*map(tagged, ROLES))).alias("_p"))
    return named.select("_p.person", "_p.times", id_name, *carry)


def hot_people(catalog: DataFrame, hot_titles: int) -> DataFrame:
    """``(person)``: the people with more than this many titles."""
    return people(catalog, "id").groupBy("person").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_titles).select("person")


def measured_hot_titles(catalog: DataFrame, queries: DataFrame) -> int:
    """The most titles of a person in the index: the pairs up to a power of two are counted, one row for each power."""
    held = people(catalog, "id").groupBy("person").agg(F.count(F.lit(1)).alias("n"))
    theirs = people(queries.dropDuplicates(["qid"]), "qid").groupBy("person").agg(F.count(F.lit(1)).alias("asked"))
    power = F.ceil(F.log2("n")).cast("int").alias("power")
    counts = held.join(theirs, "person").groupBy(power).agg(F.sum(F.col("n") * F.col("asked")).alias("pairs"))
    most, pairs, found = PAIRS_PER_QUERY * queries.count(), 0, HOT_TITLES
    for row in counts.orderBy("power").collect():
        pairs += row["pairs"]
        if pairs > most:
            break
        found = max(found, 1 << row["power"])
    return found


def with_hot_people(rows: DataFrame, id_name: str, hot: DataFrame) -> DataFrame:
    """The rows with their hot people by role (``hot_writers``, ``hot_directors``, as often as listed) and the lists' lengths."""
    held = join_spread(people(rows.dropDuplicates([id_name]), id_name), hot, ["person"], id_name)
    repeated = F.explode(F.array_repeat(F.col("person.name"), F.col("times").cast("int"))).alias("name")
    held = held.select(F.col(id_name).alias("_id"), F.col("person.role").alias("role"), repeated)
    lists = held.groupBy("_id").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("role") == role, F.col("name")))).alias(f"hot_{role}") for role in ROLES]
    )
    out = rows.join(lists, rows[id_name] == lists["_id"], "left").drop("_id")
    empty = F.array().cast("array<string>")
    out = out.withColumns({f"hot_{role}": F.coalesce(f"hot_{role}", empty) for role in ROLES})
    sizes = {f"{role}_size": F.size(known_items(role)) for role in ROLES}
    # for the pairs of the index: once a title, not once a pair
    return out.withColumns({**sizes, **{f"{name}_counted": counted(known_items(name)) for name in LISTS}})


def cell_columns(rows: DataFrame) -> DataFrame:
    """The rows with the columns of ``cell_key``: genres in order, and no length of a list without hot people, which adds nothing."""
    size = lambda role: F.when(F.size(f"hot_{role}") > 0, F.col(f"{role}_size")).otherwise(0).alias(f"{role}_size")
    return rows.withColumns({"genres": F.array_sort("genres"), **{f"{role}_size": size(role) for role in ROLES}})


def cell_key() -> list[str]:
    return [*CELL, *(f"hot_{role}" for role in ROLES), *(f"{role}_size" for role in ROLES)]


def cells_of(titles: DataFrame, k: int) -> DataFrame:
    """``(id, title, *CELL, people, members)``: least id, only name (null if there are several) and some members.

    A cell is two rows: the titles named as its least id is, and the rest. Whatever name
    is left out, the k least ids of the others are among the members: each name gives
    its k least ids, and of these the 2 k least stay.
    """
    key = cell_key()
    keyed = cell_columns(titles).select("id", "title", "rating", "votes", *key)
    of_name = F.row_number().over(W.partitionBy(*key, "title").orderBy("id"))
    of_cell = F.row_number().over(W.partitionBy(*key).orderBy("id"))
    first = keyed.withColumn("_place", of_name).filter(F.col("_place") <= k)
    first = first.withColumn("_place", of_cell).filter(F.col("_place") <= 2 * k)
    members = F.array_sort(F.collect_list(F.struct("id", "title", "rating", "votes")))
    whole = first.groupBy(*key).agg(members.alias("all"), F.min_by("title", "id").alias("name"))
    named = F.filter("all", lambda m: m["title"] == F.col("name"))
    rest = F.filter("all", lambda m: m["title"] != F.col("name"))
    rows = whole.select(*key, F.explode(F.array(named, rest)).alias("members")).filter(F.size("members") > 0)
    names = F.transform("members", lambda m: m["title"])
    only = F.when(F.array_min(names) == F.array_max(names), F.array_min(names))
    return rows.select(*key, F.element_at("members", 1)["id"].alias("id"), only.alias("title"), "members")


def best_of_cells(titles, asked, k, weights, overlap, **blocks) -> DataFrame:
    """``(qid, id, score, rating, votes)``: each query's k best titles if nobody shared a rare person."""
    cells = written(cells_of(titles, k), "cells")
    scorer = kernels.AttributeScorer({**asdict(weights), "total": weights.total}, overlap, MISSING, several_names=True)
    columns = ["title", *CELL, *(F.col(f"hot_{role}").alias(role) for role in ROLES), *(f"{role}_size" for role in ROLES)]
    # queries that differ in nothing that is compared here are one
    alike = F.sha2(F.to_json(F.struct("title", *cell_key())), 256)
    named = cell_columns(asked.filter(F.col("qid").isNotNull())).withColumn("alike", alike)
    kinds = written(named.dropDuplicates(["alike"]).select(F.col("alike").alias("qid"), *columns), "alike")
    # a row whose least id bears the query's name ranks too early, but only after the other row of its cell: 2 k rows hold k that do not
    found = k_nearest(cells.select("id", *columns), kinds, scorer, 2 * k, **blocks)
    # a cell of one name, here another than the query's, gives all its members, any other at least one: after k of them no lower score counts
    sizes = cells.select(F.col("id").alias("cell"), F.when(F.col("title").isNotNull(), F.size("members")).otherwise(1).alias("least"))
    found = found.select("qid", "score", F.col("id").alias("cell")).join(sizes, "cell")
    down, level = W.partitionBy("qid").orderBy(F.desc("score")), W.partitionBy("qid", "score")
    found = found.withColumn("above", F.sum("least").over(down) - F.sum("least").over(level)).filter(F.col("above") < k)
    members = cells.select(F.col("id").alias("cell"), "members")
    rows = found.select("qid", "score", "cell").join(members, "cell").join(kinds.select("qid", "title"), "qid")
    rows = rows.select("qid", "score", "title", F.explode("members").alias("m")).filter(F.col("m.title") != F.col("title"))
    best = k_first(rows.select("qid", "m.id", "score", "m.rating", "m.votes").distinct(), "qid", k).drop("rank")
    # at most k for each kind of query
    best = best.groupBy(F.col("qid").alias("alike")).agg(F.collect_list(F.struct("id", "score", "rating", "votes")).alias("best"))
    rows = join_spread(named.select("qid", "alike"), written(best, "best"), ["alike"], "qid", bound=SENT_LISTS)
    return k_first(rows.select("qid", F.explode("best").alias("b")).select("qid", "b.*").distinct(), "qid", k).drop("rank")


def with_rare_people(titles, asked, hot, near, k, weights, overlap) -> DataFrame:
    """``(qid, id, score, rating, votes)`` of the pairs of different names that share a rare person and may be among the k best."""
    person = ["role", "name"]
    carry = ["title", "flag", "runtime", *LISTS]

    def postings(rows, id_name, *more):
        # whole items as codes of 64 bits: narrow, and quickly compared
        coded = [F.transform(f"{n}_counted", lambda x: F.xxhash64(x)).alias(f"{n}_coded") for n in LISTS]
        kept = ["title", "flag", "runtime", *more]
        named = people(rows.select("*", *coded), id_name, *kept, *(f"{n}_coded" for n in LISTS))
        return named.select("person.role", "person.name", id_name, *kept, *(F.col(f"{n}_coded").alias(n) for n in LISTS))

    reach = near.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
    theirs = postings(asked.dropDuplicates(["qid"]).join(reach, "qid", "left"), "qid", "kth")
    theirs = theirs.select(*person, "qid", "kth", *[F.col(c).alias(f"q_{c}") for c in carry])
    own = postings(titles, "id").join(broadcast_if_small(hot.select("person.*")), person, "left_anti")
    # by number, so that few bytes with many pairs are not merged into few tasks
    parts = shuffle_partitions(titles)
    pairs = theirs.repartition(parts, *person).join(own.repartition(parts, *person).hint("merge"), person).filter(F.col("q_title") != F.col("title"))
    bound = attribute_score(lambda n: F.col(n), lambda n: F.col(f"q_{n}"), weights, overlap, counted_overlap)
    # scores are compared as multiples of 1e-9
    may = F.col("kth").isNull() | (bound >= F.col("kth") - 1e-8)
    pairs = pairs.filter(may).select("qid", "id", "kth").distinct()
    compared = {n: f"{n}_counted" if n in LISTS else n for n in ATTRIBUTES}
    left = asked.select("qid", *[F.col(c).alias(f"q_{n}") for n, c in compared.items()])
    right = titles.select("id", *[F.col(c).alias(n) for n, c in compared.items()], "rating", "votes")
    rows = pairs.join(left, "qid").join(right, "id").filter(F.col("q_title") != F.col("title"))
    score = attribute_score(lambda n: F.col(n), lambda n: F.col(f"q_{n}"), weights, overlap, counted_overlap)
    rows = rows.select("qid", "id", F.round(score, 9).alias("score"), "rating", "votes", "kth")
    return rows.filter(F.col("kth").isNull() | (F.col("score") >= F.col("kth"))).drop("kth")


def attribute_predict(catalog: DataFrame, queries: DataFrame, k: int = 50, **options) -> DataFrame:
    """``(qid, predicted)``: mean rating of the k most alike titles, weighted by votes and similarity."""
    # equal query rows share a qid and are scored once
    found = attribute_neighbours(catalog, queries.dropDuplicates(["qid"]), k, **options)
    weight = F.col("votes") * F.col("score")
    means = found.groupBy("qid").agg(
        F.try_divide(exact_sum(F.col("rating") * weight), exact_sum(weight)).alias("predicted")
    )
    return for_every_query(queries, means)


def cosine_neighbours(
    features: DataFrame, queries: DataFrame, k: int = 10, include_self: bool = False, form: str = "grid", **blocks
) -> DataFrame:
    """The k most similar titles by exact cosine: ``(qid, id, score, rank, rating)``.

    ``form="pruned"`` gives the same rows and skips blocks of titles that cannot hold one
    of them (``operators.pruned``); it pays where few positions carry most of a vector.
    ``form="classes"`` gives them too and scores equal vectors once (``operators.alike``).
    """
    if form == "classes":
        return cosine_by_class(features, queries, k, include_self, **blocks)
    if form == "pruned":
        return pruned_neighbours(features, queries, k, include_self, **blocks)
    return k_nearest(
        features.select("id", "vector", "rating"),
        queries.select("qid", "vector"),
        kernels.CosineScorer(exclude_self=not include_self),
        k,
        carry=["rating"],
        form=form,
        **blocks,
    )


def mean_rating(k: int, denominator: str = "found") -> Column:
    """Mean over the neighbours found, or their sum over k (``denominator="k"``)."""
    if denominator == "found":
        return exact_mean(F.col("rating"))
    if denominator == "k":
        return exact_sum(F.col("rating")) / F.lit(float(k))
    raise ValueError(f"unknown denominator: {denominator}")


def cosine_predict(features: DataFrame, queries: DataFrame, k: int = 10, **options) -> DataFrame:
    """``(qid, predicted)``: mean rating of the k most similar titles."""
    found = cosine_neighbours(features, queries, k, **options)
    means = found.groupBy("qid").agg(mean_rating(k).alias("predicted"))
    return for_every_query(queries, means)


def for_every_query(queries: DataFrame, means: DataFrame) -> DataFrame:
    """Queries without neighbours stay in the result, with a null prediction."""
    return queries.select("qid").join(means, "qid", "left").select("qid", "predicted")
