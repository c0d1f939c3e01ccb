"""Ranked lexical search by NRA: impact-sorted lists are read in sequence, with score intervals per document.

The documents are indexed in blocks of bounded size, each by the task that reads
it: the terms that some item asks for, and for every term its documents and
counts. Document counts over all blocks give the weights of the terms. Then every
block meets the items. Its lists are sorted by impact and read side by side, from
the greatest impact on. What has been read of a document is its lower bound; the
last impacts read of its other lists bound what may follow. Reading goes on until
no other document can reach the k-th lower bound (not even tie with it) and the
bounds of all that are left have met. A document lies in one block, so the k best
of the blocks' answers are the k best of all; a task carries its k-th score from
block to block, which lets later blocks stop earlier.

Cases: a null or empty text has no terms and is never found; an item without
terms has no rows. Repeated document rows (or ids) are documents of their own;
rows of one item id, null included, form one item with all their terms. Equal
scores go by ascending doc_id, null last. Empty tables give no rows. Other
columns are left behind, whatever they are called.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from affinara.llm.common import blocks, picked, shared, small_batches, tidy
from affinara.shipping import BROADCAST_BYTES, is_small, join_spread, written

BLOCK_BYTES = 12 << 20
BLOCK_ROWS = 1 << 16
# Items are dealt into chunks of about so many distinct terms; every block meets every chunk.
CHUNK_TERMS = 50_000
FIRST_DEPTH = 64  # entries read of each list in the first round; every round doubles it
SALTS = 256
SCALE = 1_000_000_000

# every byte of a term: all above 127, digits, letters (capitals become small); anything else separates
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.encode("utf-8", "surrogatepass").translate(TERM_BYTES).split() if text else []


class Local(dict):
    """Numbers the terms of one block as they come."""

    def __missing__(self, term: bytes) -> int:
        number = self[term] = len(self)
        return number


def block_index(texts: list, wanted: dict | None):
    """(terms, list ends, documents, counts, term number of each text, all terms) of one block.

    ``wanted`` numbers the terms to keep; without it all terms of the block are kept.
    """
    numbers = Local() if wanted is None else wanted
    sizes, parts = np.zeros(len(texts), np.int64), []
    for i, text in enumerate(texts):
        terms = terms_of(text)
        sizes[i] = len(terms)
        asked = map(numbers.__getitem__, terms) if wanted is None else map(numbers.get, terms, repeat(-1))
        parts.append(np.fromiter(asked, np.int64, len(terms)))
    number = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    slot = np.repeat(np.arange(len(texts)), sizes)
    known = number >= 0
    keys, counts = np.unique(number[known] * len(texts) + slot[known], return_counts=True)
    term, doc = keys // max(len(texts), 1), keys % max(len(texts), 1)
    present, first = np.unique(term, return_index=True)
    names = list(numbers)  # in order of their numbers
    return [names[t] for t in present], np.r_[first[1:], len(keys)][: len(present)], doc, counts, sizes


INDEX = "block long, docs array<{kind}>, sizes binary, n_docs long, n_terms long, terms array<binary>, dfs array<long>, ends binary, slots binary, counts binary"


def index(docs: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """One row for each block of documents: its inverted lists. ``wanted`` (term), if given, is of proven size."""
    spark = docs.sparkSession
    small_batches(spark)
    vocabulary = None
    if wanted is not None:
        vocabulary = shared(spark, {bytes(r.term): i for i, r in enumerate(wanted.select("term").collect())})
    kind = docs.schema["doc_id"].dataType
    names = ["block", "docs", "sizes", "n_docs", "n_terms", "terms", "dfs", "ends", "slots", "counts"]

    def indexed(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        keep = vocabulary() if vocabulary is not None else None
        for block in blocks(batches, "text", BLOCK_BYTES):
            for start in range(0, len(block), BLOCK_ROWS):
                part = block.slice(start, BLOCK_ROWS).combine_chunks()
                part = part.take(pa.compute.sort_indices(part, [("doc_id", "ascending")], null_placement="at_end")).combine_chunks()
                terms, ends, doc, counts, sizes = block_index(part.column("text").to_pylist(), keep)
                held = np.unique(doc)  # documents without a term that counts need no place
                ids = part.column("doc_id").combine_chunks()
                ids = ids.take(pa.array(held))
                row = {
                    "block": pa.array([number]),
                    "docs": pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), ids),
                    "sizes": pa.array([sizes[held].astype("<i8").tobytes()], pa.binary()),
                    "n_docs": pa.array([int((sizes > 0).sum())]),
                    "n_terms": pa.array([int(sizes.sum())]),
                    "terms": pa.array([terms], pa.list_(pa.binary())),
                    "dfs": pa.array([np.diff(np.r_[0, ends])], pa.list_(pa.int64())),
                    "ends": pa.array([ends.astype("<i8").tobytes()], pa.binary()),
                    "slots": pa.array([np.searchsorted(held, doc).astype("<i4").tobytes()], pa.binary()),
                    "counts": pa.array([counts.astype("<i8").tobytes()], pa.binary()),
                }
                yield pa.RecordBatch.from_arrays([row[n] for n in names], names)
                number += 1

    return docs.mapInArrow(tidy(indexed), INDEX.format(kind=kind.simpleString()))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times): the terms of each item, repeats counted."""

    def split(batches):
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = Counter(terms_of(text))
                if found:
                    ids = batch.column("item_id").take(pa.array([i] * len(found)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["item_id", "term", "times"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.mapInArrow(tidy(split), f"item_id {kind}, term binary, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def weight_of(df: int, n: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def nra(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best documents that reach the floor, (slots, scores), best first, equal scores by slot.

    ``lists`` holds (documents, gains) in descending order of gains, all of them above 0.
    """
    lower = np.zeros(n_docs, np.int64)
    alive = np.zeros(n_docs, bool)  # read somewhere, and able to reach the k-th best
    lengths = [len(gains) for _, gains in lists]
    read: list[list[np.ndarray]] = [[] for _ in lists]
    settled, depth, before = False, FIRST_DEPTH, 0
    dead = np.zeros(n_docs, bool)
    while True:
        bottoms = np.zeros(len(lists), np.int64)
        for i, (slots, gains) in enumerate(lists):
            at, stop = before, min(depth, lengths[i])
            if at < stop:
                part, gain = slots[at:stop], gains[at:stop]
                if settled:  # nothing new can enter: only what is left is still of interest
                    keep = alive[part]
                    part, gain = part[keep], gain[keep]
                lower[part] += gain  # a list names a document once
                if not settled:
                    alive[part] = True
                read[i].append(part)
            if stop < lengths[i]:
                bottoms[i] = gains[stop - 1]
        alive &= ~dead
        possible = np.flatnonzero(alive)
        least = max(1, floor)
        if len(possible) > k:
            least = max(least, int(np.partition(lower[possible], len(possible) - k)[len(possible) - k]))
        unseen = int(bottoms.sum())
        open_lists = np.flatnonzero(bottoms)
        upper = np.full(len(possible), unseen, np.int64)
        place = np.full(n_docs, -1)
        place[possible] = np.arange(len(possible))
        for i in open_lists:  # what a list has already told of a document, it will not tell again
            for part in read[i]:
                here = place[part]
                upper[here[here >= 0]] -= bottoms[i]
        reach = lower[possible] + upper
        out = possible[reach < least]
        dead[out], alive[out] = True, False
        possible, upper = possible[reach >= least], upper[reach >= least]
        settled = settled or unseen < least
        if not unseen or (settled and not upper.any()):
            possible = possible[lower[possible] >= least]
            order = np.lexsort((possible, -lower[possible]))[:k]
            return possible[order], lower[possible[order]]
        before, depth = depth, depth * 2


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", vocabulary_rows: int = 500_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item.

    Up to ``vocabulary_rows`` distinct item terms (and 64 MB of them) go to every
    task, which then indexes these alone; beyond that all terms are indexed.
    """
    docs = picked(docs, doc_id=doc_id, text=text)
    asked = written(item_terms(picked(items, item_id=item_id, text=text)), "item-terms")
    terms = written(asked.select("term").distinct(), "asked-terms")
    known = is_small(terms.select(F.hex("term").alias("term")), vocabulary_rows, 2 * BROADCAST_BYTES)
    lists = written(index(docs, terms if known else None), "inverted-blocks")

    total = lists.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("terms")).head()
    n, all_terms = int(total["docs"]), int(total["terms"])
    per_block = lists.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.dfs").alias("df"))
    if not known:
        per_block = per_block.join(terms, "term", "left_semi")
    frequency = per_block.groupBy("term").agg(F.sum("df").alias("df"))
    # terms of items that no document holds score nothing
    weighted = join_spread(asked, written(frequency, "term-frequencies"), ["term"], "item_id")
    count = asked.count()
    chunks = max(1, math.ceil(count / CHUNK_TERMS))
    per_item = weighted.groupBy("item_id").agg(F.collect_list(F.struct("term", "times", "df")).alias("terms"))
    dealt = per_item.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(chunks)).cast("int").alias("chunk")).agg(F.collect_list(F.struct("item_id", "terms")).alias("items"))
    dealt = written(dealt, "item-chunks")

    pairs = lists.drop("n_docs", "n_terms", "dfs").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    met = join_spread(pairs, dealt, ["chunk"], "block")
    schema = T.StructType([T.StructField("item_id", items.schema[item_id].dataType), T.StructField("block", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.LongType())])

    def scored(batches):
        floors: dict = {}
        for batch in batches:
            kind = batch.schema.field("items").type.value_type.field("item_id").type
            for at in range(len(batch)):
                one = batch.slice(at, 1)
                found = scored_block(one, n, all_terms, k, floors)
                if found:
                    slots, scores = (np.concatenate(x) for x in list(zip(*found, strict=True))[1:])
                    ids = pa.array([item for item, place, _ in found for _ in place], kind)
                    number = pa.array(np.full(len(slots), one.column("block")[0].as_py()), pa.int64())
                    columns = [ids, number, one.column("docs").flatten().take(pa.array(slots)), pa.array(scores, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["item_id", "block", "doc_id", "score"])

    best = met.mapInArrow(tidy(scored), schema)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # two steps, so that no task gets an item's answers from all blocks
    some = W.partitionBy("item_id", "salt").orderBy(*order)
    some_best = best.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS))).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
    whole = W.partitionBy("item_id").orderBy(*order)
    return some_best.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def scored_block(one: pa.RecordBatch, n: int, all_terms: int, k: int, floors: dict):
    """For each item that finds something in one block (item id, slots, scores); ``floors`` keeps the k best scores so far."""
    sizes = np.frombuffer(one.column("sizes")[0].as_py(), "<i8")
    names = {t: i for i, t in enumerate(one.column("terms")[0].as_py())}
    ends = np.frombuffer(one.column("ends")[0].as_py(), "<i8")
    slots = np.frombuffer(one.column("slots")[0].as_py(), "<i4")
    counts = np.frombuffer(one.column("counts")[0].as_py(), "<i8")
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    m = 100 - 75 + (75 * sizes * n) // max(all_terms, 1)
    impacts = (SCALE * counts) // (1000 * counts + 8 * m[slots])
    order = np.lexsort((-impacts, np.repeat(np.arange(len(ends)), ends - starts)))
    slots, impacts = slots[order], impacts[order]
    found = []
    for item in one.column("items")[0].as_py():
        lists = []
        for term in item["terms"]:
            at, weight = names.get(bytes(term["term"])), weight_of(term["df"], n) * term["times"]
            if at is not None and weight > 0:
                gains = weight * impacts[starts[at] : ends[at]]
                some = int(np.searchsorted(-gains, 0))  # gains of 0 (counts too rare to show) tell nothing
                lists.append((slots[starts[at] : starts[at] + some], gains[:some]))
        if not lists:
            continue
        key = item["item_id"]
        best = floors.setdefault(key, [])
        place, scores = nra(lists, len(sizes), k, best[0] if len(best) == k else 0)
        if len(place):
            best.extend(scores.tolist())
            best.sort()
            del best[: max(0, len(best) - k)]
            found.append((key, place, scores))
    return found
