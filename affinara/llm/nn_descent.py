"""Approximate nearest neighbours by inner product: an NN-descent graph and greedy search in it.

Equal vectors are one node. A first graph links nodes that share a small cell of
random hyperplane cuts, a few links a cell, at every size of the table. NN-descent
then improves it: in Spark joins every node meets its neighbours and the nodes that
name it as a neighbour, compares these with each other, and tells them of closer
ones; each keeps its ``degree`` closest. It goes on until a round changes few
entries. Queries are nodes of the graph: a greedy search starts from a query's own
list and from entry nodes drawn by hash, expands the best nodes not yet expanded in
every round, and the best of the pool are scored exactly on the original vectors.

While the graph is built and searched, vectors travel as 8-bit numbers with one
scale each. Lists are bounded by their degree, cells by their rows (a crowded cell
is split by a salt), and a task combines what it found for a node before it sends
it, so neither a cluster nor a node that many others name makes a large group.

Cases: vectors that are null, zero, or hold a null or non-finite component take no
part; shorter vectors count as padded with zeros. Equal vectors and repeated rows
are all found; a query's own id is never an answer. Ties go to the smaller id. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinara.llm.common import partitions
from affinara.llm.top_k import finite, matrix
from affinara.shipping import written

LISTS = "node long, ids array<long>, scores array<float>"
SALTS = 16  # parts of the query rows of one vector
ENTRIES = 64  # nodes that every search starts from besides its own list
MOST_TRIPLES = 1 << 20  # held by a task before it combines them


def coded(vectors: np.ndarray) -> list[bytes]:
    """Vectors as a scale and 8-bit components."""
    scale = np.abs(vectors).max(1) / 127
    small = np.rint(vectors / scale[:, None]).astype(np.int8)
    return [np.float32(s).tobytes() + v.tobytes() for s, v in zip(scale, small, strict=True)]


def decoded(codes: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    return raw[:, 4:].view(np.int8).astype(np.float32) * raw[:, :4].copy().view(np.float32)


def closest(owner: np.ndarray, other: np.ndarray, score: np.ndarray, most: int):
    """For each owner the ``most`` best distinct others: owners, and arrays of others and scores."""
    order = np.lexsort((other, -score, owner))
    owner, other, score = owner[order], other[order], score[order]
    # an other's repeats have one score but for rounding: keep its best
    pair = np.lexsort((np.arange(len(owner)), other, owner))
    repeat = np.zeros(len(owner), bool)
    repeat[pair[1:]] = (owner[pair[1:]] == owner[pair[:-1]]) & (other[pair[1:]] == other[pair[:-1]])
    owner, other, score = owner[~repeat], other[~repeat], score[~repeat]
    start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, int)
    place = np.arange(len(owner)) - np.repeat(start, np.diff(np.r_[start, len(owner)]))
    kept = place < most
    owner, other, score = owner[kept], other[kept], score[kept]
    start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, int)
    return owner[start], np.r_[start, len(owner)], other, score


def lists(owner, other, score, most: int) -> pa.RecordBatch:
    node, start, other, score = closest(owner, other, score, most)
    offsets = pa.array(start.astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(node.astype(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(other.astype(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(score.astype(np.float32)))],
        ["node", "ids", "scores"],
    )


def merged(rows: DataFrame, most: int) -> DataFrame:
    """One list for each node from several."""

    def joined(batches):
        for batch in batches:
            if not len(batch):
                continue
            ids, scores = batch.column("ids"), batch.column("scores")
            owner = np.repeat(batch.column("node").to_numpy(), ids.value_lengths().to_numpy(zero_copy_only=False))
            yield lists(owner, ids.flatten().to_numpy(), scores.flatten().to_numpy(), most)

    together = rows.groupBy("node").agg(F.flatten(F.collect_list("ids")).alias("ids"), F.flatten(F.collect_list("scores")).alias("scores"))
    return together.mapInArrow(joined, LISTS)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector) of the rows that take part."""
    rows = vectors.where(F.col(key).isNotNull() & finite(vector) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False)))
    return rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))


def distinct_nodes(vectors: DataFrame, key: str, vector: str, most: int) -> DataFrame:
    """One row for each distinct vector: node (its least id), vector, its ``most`` least ids, and its code."""
    rows = usable(vectors, key, vector)
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 1

    def grouped(batches):
        held: dict[bytes, list[int]] = {}
        for batch in batches:
            if not len(batch):
                continue
            full = matrix(pa.chunked_array([batch.column("vector")]), width) + 0.0
            for i, v in zip(batch.column("id").to_pylist(), full, strict=True):
                held.setdefault(v.tobytes(), []).append(i)
            if len(held) > 20_000:
                yield sent(held)
                held = {}
        if held:
            yield sent(held)

    def sent(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([sorted(x)[:most] for x in held.values()], pa.list_(pa.int64()))], ["exact", "ids"])

    groups = rows.mapInArrow(grouped, "exact binary, ids array<long>").groupBy("exact")
    groups = groups.agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, most).alias("ids"))
    groups = groups.withColumn("node", F.col("ids")[0])

    def with_code(batches):
        for batch in batches:
            if len(batch):
                full = np.frombuffer(b"".join(batch.column("exact").to_pylist()), np.float64).reshape(len(batch), -1)
                yield batch.append_column("code", pa.array(coded(full), pa.binary()))

    return written(groups.mapInArrow(with_code, "exact binary, ids array<long>, node long, code binary"), "nn-nodes")


def first_graph(nodes: DataFrame, degree: int, trees: int, cell_rows: int, links: int, seed: int) -> DataFrame:
    """At most ``links`` links a cell for each node, among nodes on the same sides of random hyperplanes."""
    depth = max(0, math.ceil(math.log2(max(nodes.count(), 1) / cell_rows)))
    # the cuts are medians of a sample of at most 4,096 nodes
    sample = nodes.select("code").orderBy(F.xxhash64("node")).limit(4096).collect()
    if not sample:
        return nodes.sparkSession.createDataFrame([], LISTS)
    some = decoded([r["code"] for r in sample])
    random = np.random.default_rng(seed)
    planes = random.standard_normal((trees, some.shape[1], depth)).astype(np.float32)
    cuts = np.stack([np.median(some @ p, axis=0) for p in planes])

    def celled(batches):
        for batch in batches:
            if not len(batch):
                continue
            v = decoded(batch.column("code").to_pylist())
            for t in range(trees):
                cell = ((v @ planes[t] > cuts[t]) * (1 << np.arange(depth, dtype=np.int64))).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("code"), pa.array(cell.astype(np.int64) * trees + t)], ["node", "code", "cell"])

    rows = nodes.select("node", "code").mapInArrow(celled, "node long, code binary, cell long")
    sizes = written(rows.groupBy("cell").agg(F.ceil(F.count("*") / (2 * cell_rows)).alias("parts")), "nn-cells")
    rows = rows.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("node", "cell"), F.col("parts")))

    def linked(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        v = decoded(table.column("code").to_pylist())
        most = min(links, len(node) - 1)
        found = []
        for i in range(0, len(node), 512) if most > 0 else ():
            score = v[i : i + 512] @ v.T
            score[np.arange(len(score)), np.arange(i, i + len(score))] = -np.inf
            top = np.argpartition(-score, most - 1, axis=1)[:, :most]
            found.append(lists(np.repeat(node[i : i + 512], most), node[top].ravel(), np.take_along_axis(score, top, 1).ravel(), most))
        empty = pa.table({"node": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "scores": pa.array([], pa.list_(pa.float32()))})
        return pa.Table.from_batches(found) if found else empty

    return merged(rows.groupBy("cell", "part").applyInArrow(linked, LISTS), degree)


def members(graph: DataFrame, nodes: DataFrame, reverse: int) -> DataFrame:
    """Every node with its neighbours and the closest nodes that name it: ids, codes and their lists' last scores."""
    edges = graph.select("node", F.explode(F.arrays_zip("ids", "scores")).alias("e")).select("node", F.col("e.ids").alias("other"), F.col("e.scores").alias("score"))
    place = F.row_number().over(Window.partitionBy("other").orderBy(F.desc("score"), "node"))
    back = edges.withColumn("place", place).where(F.col("place") <= reverse)
    meets = edges.select("node", "other").union(back.select("other", "node")).distinct()
    last = graph.select(F.col("node").alias("other"), F.element_at("scores", -1).alias("last"), F.size("ids").alias("n"))
    known = nodes.select(F.col("node").alias("other"), "code").join(last, "other")
    rows = meets.join(known, "other").groupBy("node")
    return rows.agg(F.collect_list("other").alias("others"), F.collect_list("code").alias("codes"), F.collect_list("last").alias("lasts"), F.collect_list("n").alias("ns"))


def local_join(rows: DataFrame, degree: int, told: int) -> DataFrame:
    """What the nodes that meet at a node learn of each other: at most ``told`` closer ones for each of them."""

    def compared(batches):
        owner, other, score, held = [], [], [], 0
        for batch in batches:
            for ids, codes, last, n in zip(*(batch.column(c).to_pylist() for c in ("others", "codes", "lasts", "ns")), strict=True):
                if len(ids) < 2:
                    continue
                ids, v = np.array(ids), decoded(codes)
                bar = np.where(np.array(n) < degree, -np.inf, np.array(last, np.float32))
                value = v @ v.T
                np.fill_diagonal(value, -np.inf)
                most = min(told, len(ids) - 1)
                top = np.argpartition(-value, most - 1, axis=1)[:, :most]
                best = np.take_along_axis(value, top, 1)
                row, column = np.nonzero(best > bar[:, None])
                owner.append(ids[row])
                other.append(ids[top[row, column]])
                score.append(best[row, column])
                held += len(row)
                if held > MOST_TRIPLES:
                    yield lists(np.concatenate(owner), np.concatenate(other), np.concatenate(score), degree)
                    owner, other, score, held = [], [], [], 0
        if held:
            yield lists(np.concatenate(owner), np.concatenate(other), np.concatenate(score), degree)

    return rows.mapInArrow(compared, LISTS)


def build(
    nodes: DataFrame, degree: int = 48, trees: int = 16, cell_rows: int = 256, links: int = 12, settled: float = 0.1, most_rounds: int = 8, told: int = 8, seed: int = 5
) -> DataFrame:
    """The neighbour graph: node, ids and scores, closest first.

    Rounds of NN-descent end when one has changed at most a share ``settled`` of all entries.
    """
    graph = written(first_graph(nodes, degree, trees, cell_rows, links, seed), "nn-graph")
    for _ in range(most_rounds):
        news = local_join(members(graph, nodes, degree), degree, told)
        after = written(merged(graph.unionByName(news), degree), "nn-graph")
        known = graph.select("node", F.col("ids").alias("known"))
        changed = F.when(F.col("known").isNull(), F.size("ids")).otherwise(F.size(F.array_except("ids", "known")))
        row = after.join(known, "node", "left").agg(F.sum(changed).alias("changed"), F.sum(F.size("ids")).alias("all")).first()
        graph = after
        if not row["all"] or row["changed"] <= settled * row["all"]:
            break
    return graph


def query_rows(vectors: DataFrame, nodes: DataFrame, key: str, vector: str) -> DataFrame:
    """(query_id, node, code), a row for each query: rows of one vector, however many, are joined by its digest in salted parts."""
    rows = usable(vectors, key, vector)
    width = nodes.agg(F.max(F.length("exact"))).first()[0]
    if not width:
        return nodes.select(F.col("node").alias("query_id"), "node", "code").limit(0)

    def digested(batches):
        for batch in batches:
            if len(batch):
                full = matrix(pa.chunked_array([batch.column("vector")]), width // 8) + 0.0
                found = [hashlib.sha256(v.tobytes()).digest() for v in full]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], ["query_id", "digest"])

    asked = rows.mapInArrow(digested, "query_id long, digest binary").withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)).cast("int"))
    named = nodes.select(F.unhex(F.sha2("exact", 256)).alias("digest"), "node", "code")
    named = named.join(asked.select("digest").distinct(), "digest", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return asked.join(named, ["digest", "salt"]).select("query_id", "node", "code").distinct()


def search(vectors: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding", pool: int = 256, beam: int = 64, rounds: int = 3, **graph_options) -> DataFrame:
    """The k nearest of all rows for the rows whose id (column ``id``) is a query: query_id, rank, vec_id, score."""
    nodes = distinct_nodes(vectors, key, vector, k + 1)
    graph = build(nodes, **graph_options)
    # a query's node is found by its vector, as a node lists only its least ids
    queries = written(query_rows(vectors.where(is_query), nodes, key, vector), "nn-queries")
    starts = queries.select("node", "code").distinct()
    entries = nodes.select("node", "code").orderBy(F.xxhash64("node")).limit(ENTRIES).collect()
    entry_ids, entry_codes = [r["node"] for r in entries], [bytes(r["code"]) for r in entries]

    def entered(batches):
        v, ids = (decoded(entry_codes), np.array(entry_ids)) if entries else (None, None)
        for batch in batches:
            if not len(batch):
                continue
            own = batch.column("node").to_numpy()
            value = decoded(batch.column("code").to_pylist()) @ v.T
            row, column = np.nonzero(own[:, None] != ids[None, :])
            yield lists(own[row], ids[column], value[row, column], pool)

    starting = merged(starts.mapInArrow(entered, LISTS).unionByName(graph.join(starts.select("node"), "node", "left_semi")), pool)
    around = members(graph, nodes, graph_options.get("degree", 48)).select("node", "others", "codes")
    around = around.repartition(partitions(vectors), "node").persist()
    held = written(starts.join(starting, "node", "left").select("node", "code", F.coalesce("ids", F.array().cast("array<long>")).alias("ids"), F.coalesce("scores", F.array().cast("array<float>")).alias("scores"), F.array(F.col("node")).alias("seen")), "nn-pool")

    def next_beam(batches):
        for batch in batches:
            rows = {"query": [], "at": [], "code": [], "bar": []}
            for node, code, found, score, seen in zip(*(batch.column(c).to_pylist() for c in ("node", "code", "ids", "scores", "seen")), strict=True):
                done = set(seen)
                fresh = [i for i in found if i not in done][:beam]
                rows["query"] += [node] * len(fresh)
                rows["at"] += fresh
                rows["code"] += [code] * len(fresh)
                rows["bar"] += [score[-1] if len(score) >= pool else -math.inf] * len(fresh)
            yield pa.RecordBatch.from_arrays([pa.array(rows["query"], pa.int64()), pa.array(rows["at"], pa.int64()), pa.array(rows["code"], pa.binary()), pa.array(rows["bar"], pa.float32())], list(rows))

    def expanded(batches):
        for batch in batches:
            owner, other, score = [], [], []
            for query, code, bar, others, codes in zip(*(batch.column(c).to_pylist() for c in ("query", "code", "bar", "others", "codes")), strict=True):
                value = decoded(codes) @ decoded([code])[0]
                good = (value > bar) & (np.array(others) != query)
                owner.append(np.full(int(good.sum()), query))
                other.append(np.array(others)[good])
                score.append(value[good])
            if owner:
                yield lists(np.concatenate(owner), np.concatenate(other), np.concatenate(score), pool)

    for _ in range(rounds):
        beams = held.mapInArrow(next_beam, "query long, at long, code binary, bar float")
        beams = written(beams, "nn-beams")
        news = beams.join(around, F.col("at") == F.col("node")).select("query", F.col("code"), "bar", "others", "codes").mapInArrow(expanded, LISTS)
        both = merged(held.select("node", "ids", "scores").unionByName(news), pool)
        seen = beams.groupBy(F.col("query").alias("node")).agg(F.collect_list("at").alias("more"))
        held = both.join(held.select("node", "code", "seen"), "node").join(seen, "node", "left")
        held = held.withColumn("seen", F.concat("seen", F.coalesce("more", F.array().cast("array<long>")))).drop("more")
        held = written(held.select("node", "code", "ids", "scores", "seen"), "nn-pool")
    # exact scores of the best of the pool, on the original vectors; a query's own node may hold other rows
    near = held.select(F.col("node").alias("at"), F.explode(F.slice(F.concat(F.array("node"), F.filter("ids", lambda i: i != F.col("node"))), 1, 3 * k + 4)).alias("node"))
    near = near.join(nodes.select("node", "ids", "exact"), "node").join(nodes.select(F.col("node").alias("at"), F.col("exact").alias("own")), "at")

    def scored(batches):
        for batch in batches:
            pair = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.float64).reshape(len(batch), -1) for c in ("exact", "own"))
            value = [float(np.dot(a, b)) for a, b in zip(*pair, strict=True)] if len(batch) else []
            yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("ids"), pa.array(value, pa.float64())], ["at", "ids", "score"])

    exact = near.select("at", "ids", "exact", "own").mapInArrow(scored, "at long, ids array<long>, score double")
    # a node's k + 1 best rows hold the k best for each of its queries
    best = exact.select("at", "score", F.explode("ids").alias("vec_id"))
    of_node = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("score"), "vec_id"))
    best = best.withColumn("place", of_node).where(F.col("place") <= k + 1).groupBy("at").agg(F.collect_list(F.struct("score", "vec_id")).alias("best"))
    pairs = queries.select("query_id", F.col("node").alias("at")).join(best, "at").select("query_id", F.explode("best").alias("b"))
    pairs = pairs.select("query_id", "b.score", "b.vec_id").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    answer = written(pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nn-answer")
    around.unpersist()
    return answer
