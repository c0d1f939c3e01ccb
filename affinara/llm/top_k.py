"""Exact top-k search by inner product with the three-phase uniform threshold algorithm.

A vector's score for a query is the sum of its partial scores over blocks of
components, each block being one score list. Candidates lie in stripes, and a
task holds all lists of its stripe for one block of queries.

1. Every task gathers the k best entries of each local list and its least partial
   score. From them comes, for each query, the k-th best sum of known parts (what
   is unknown counts as the list's least): a score that k candidates reach.
2. That sum divided by the number of lists is a safe cutoff: a candidate below it
   in every list cannot reach the sum. The cutoff goes to all stripes with the
   query. Every task collects the entries at or above it and gives its k best sums
   of them; the k-th best of all tasks is the sharper bound.
3. Candidates whose upper bound (known parts, and the cutoff where unknown) reaches
   that bound are resolved exactly, and the k best of them are the answer.

Only k entries per query, list and stripe ever leave a task.

Cases: null vectors and vectors with a null or non-finite component take no part;
shorter vectors count as padded with zeros. Rows with the query's id are its own.
Every repeated row is a candidate of its own. Ties go to the smaller id. An empty
table gives no rows; fewer than k candidates are all returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinara.llm.common import partitions

STRIPE_ROWS = 65_536
QUERY_ROWS = 1024
STEP = 4096  # candidates scored at a time
EXACT = float(1 << 53)


def finite(vector: str) -> Column:
    x = F.col(vector)
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return x.isNotNull() & F.coalesce(good, F.lit(False))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows, padded with zeros to the width."""
    array = column.combine_chunks()
    flat = array.flatten().to_numpy().astype(np.float64)
    sizes = array.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of each row with their ids, ties to the smaller id; ids ascend along the columns."""
    k = min(k, score.shape[1])
    if not k:
        return score, np.zeros(score.shape, np.int64)
    low = np.partition(score, -k, axis=1)[:, -k][:, None]
    # all above the k-th value, then the smallest ids among those that equal it
    above = score > low
    room = k - above.sum(1, keepdims=True)
    equal = score == low
    chosen = above | (equal & (np.cumsum(equal, axis=1) <= room))
    column = np.nonzero(chosen)[1].reshape(len(score), k)
    return np.take_along_axis(score, column, 1), ids[column]


class Stripe:
    """Partial scores of a stripe's candidates for a block of queries, list by list."""

    def __init__(self, queries: pa.Table, candidates: pa.Table, lists: int):
        width = max(1, max(pa.compute.max(t.combine_chunks().value_lengths()).as_py() for t in (queries.column("vector"), candidates.column("against"))))
        self.query = matrix(queries.column("vector"), width)
        order = np.argsort(candidates.column("other").to_numpy(), kind="stable")
        self.ids = candidates.column("other").to_numpy()[order]
        self.candidate = matrix(candidates.column("against"), width)[order]
        self.own = queries.column("id").to_numpy()
        self.cuts = np.array_split(np.arange(width), min(lists, width))
        limit = np.abs(self.query).max(initial=0) * np.abs(self.candidate).max(initial=0) * width
        self.kind = np.float64 if limit < EXACT else np.int64
        if self.kind is np.int64:
            self.query, self.candidate = self.query.astype(np.int64), self.candidate.astype(np.int64)

    def steps(self):
        """Ids, which of them are the query's own, and the partial scores of each list."""
        for start in range(0, len(self.ids), STEP):
            ids = self.ids[start : start + STEP]
            part = [self.query[:, c] @ self.candidate[start : start + STEP, c].T for c in self.cuts]
            yield ids, ids[None, :] == self.own[:, None], part


LEAST = -(1 << 62)


def _running(held, score, ids, k):
    """The k best of what is held and what is new; what takes no part has the score LEAST."""
    score, ids = best_of(score, ids, k)
    if held is not None:
        score, ids = np.concatenate([held[0], score], 1), np.concatenate([held[1], ids], 1)
        order = np.lexsort((ids, -score))[:, :k]
        score, ids = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
    return score, ids


def _lists(array: np.ndarray) -> pa.Array:
    offsets = np.arange(0, array.size + 1, array.shape[1] if array.shape[1] else 1, dtype=np.int32) if array.shape[1] else np.zeros(len(array) + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(array.astype(np.int64).ravel()))


def search(vectors: DataFrame, queries: DataFrame, k: int, lists: int = 4, stripe_rows: int = STRIPE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The k best of ``vectors`` (id long, vector of whole numbers) for each of ``queries``: query_id, rank, vec_id, score."""
    width = partitions(vectors)
    query_blocks = max(1, -(-queries.count() // query_rows))
    stripes = max(1, -(-vectors.count() // stripe_rows), width // query_blocks)
    left = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(query_blocks)))
    right = vectors.select(F.col("id").alias("other"), F.col("vector").alias("against"), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(stripes)).alias("stripe"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)).cast("array<long>")))

    def grid(rows: DataFrame):
        every = F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)).cast("array<long>"))
        return rows.withColumn("stripe", every).groupBy("block", "stripe").cogroup(right.groupBy("block", "stripe"))

    def gathered(own: pa.Table, other: pa.Table) -> pa.Table:
        none = pa.table({"q": pa.array([], pa.int64()), "list": pa.array([], pa.int32()), "low": pa.array([], pa.int64()), "score": pa.array([], pa.list_(pa.int64())), "id": pa.array([], pa.list_(pa.int64()))})
        if not len(own) or not len(other):
            return none
        s = Stripe(own, other, lists)
        held, low = [None] * len(s.cuts), [None] * len(s.cuts)
        for ids, mine, part in s.steps():
            for j, p in enumerate(part):
                lowest = p.min(1)
                low[j] = lowest if low[j] is None else np.minimum(low[j], lowest)
                held[j] = _running(held[j], np.where(mine, LEAST, p), ids, k)
        return pa.concat_tables(
            pa.table({"q": s.own, "list": pa.array(np.full(len(s.own), j, np.int32)), "low": pa.array(low[j].astype(np.int64)), "score": _lists(h[0]), "id": _lists(h[1])})
            for j, h in enumerate(held)
        )

    first = grid(left).applyInArrow(gathered, "q long, list int, low long, score array<long>, id array<long>")
    lows = first.groupBy("q", "list").agg(F.min("low").alias("low"))
    entry = first.select("q", "list", F.explode(F.arrays_zip("id", "score")).alias("e")).select("q", "list", "e.id", "e.score").where(F.col("score") > LEAST)
    place = F.row_number().over(Window.partitionBy("q", "list").orderBy(F.desc("score"), "id"))
    entry = entry.withColumn("place", place).where(F.col("place") <= k)
    sums = entry.join(lows, ["q", "list"]).groupBy("q", "id").agg(F.sum(F.col("score") - F.col("low")).alias("known"))

    def kth(rows: DataFrame, value: str, name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(value)))
        best = rows.withColumn("place", place).where(F.col("place") <= k)
        # with fewer than k candidates nothing can be ruled out
        return best.groupBy("q").agg(F.when(F.count("*") == k, F.min(value)).otherwise(F.lit(0)).alias(name))

    shifted = lows.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("list", "low"))).alias("low"))
    cutoff = kth(sums, "known", "sum").join(shifted, "q").select(F.col("q").alias("id"), "sum", F.col("low.low").alias("low"))
    second = left.join(cutoff, "id")

    def bounds(s: Stripe, own: pa.Table, part):
        """Lower and upper bounds of shifted scores from the entries at or above the cutoff."""
        low = matrix(own.column("low"), len(s.cuts))
        cut = own.column("sum").to_numpy().astype(np.float64)[:, None] / len(s.cuts)
        under, over = 0, 0
        for j, p in enumerate(part):
            shifted = p - low[:, j : j + 1]
            known = shifted >= cut
            under = under + np.where(known, shifted, 0)
            over = over + np.where(known, shifted, cut)
        return under, over

    def collected(own: pa.Table, other: pa.Table) -> pa.Table:
        if not len(own) or not len(other):
            return pa.table({"q": pa.array([], pa.int64()), "known": pa.array([], pa.list_(pa.int64()))})
        s, held = Stripe(own, other, lists), None
        for ids, mine, part in s.steps():
            held = _running(held, np.where(mine, LEAST, bounds(s, own, part)[0]), ids, k)
        return pa.table({"q": s.own, "known": _lists(held[0])})

    sharper = grid(second).applyInArrow(collected, "q long, known array<long>")
    sharper = sharper.select("q", F.explode("known").alias("known")).where(F.col("known") > LEAST)
    third = second.join(kth(sharper, "known", "bound").withColumnRenamed("q", "id"), "id")

    def resolved(own: pa.Table, other: pa.Table) -> pa.Table:
        if not len(own) or not len(other):
            return pa.table({"query_id": pa.array([], pa.int64()), "score": pa.array([], pa.list_(pa.int64())), "id": pa.array([], pa.list_(pa.int64()))})
        s, held = Stripe(own, other, lists), None
        bound = own.column("bound").to_numpy()[:, None]
        for ids, mine, part in s.steps():
            sufficient = (bounds(s, own, part)[1] >= bound) & ~mine
            held = _running(held, np.where(sufficient, sum(part), LEAST), ids, k)
        return pa.table({"query_id": s.own, "score": _lists(held[0]), "id": _lists(held[1])})

    final = grid(third).applyInArrow(resolved, "query_id long, score array<long>, id array<long>")
    final = final.select("query_id", F.explode(F.arrays_zip("id", "score")).alias("e")).select("query_id", F.col("e.id").alias("vec_id"), "e.score").where(F.col("score") > LEAST)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return final.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_numbers(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", factor: float = 256.0) -> DataFrame:
    """id and vector of floor(factor * x), x as double; vectors that take no part are left out."""
    rows = rows.where(F.col(key).isNotNull() & finite(vector))
    scaled = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * factor).cast("double"))
    return rows.select(F.col(key).cast("long").alias("id"), scaled.alias("vector"))
