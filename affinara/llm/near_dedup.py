"""Near-duplicate classes by consistent weighted sampling over TF-IDF shingles.

Shingles are five consecutive words (lower case, split at white space); a shorter
text is one shingle. A shingle weighs its count in the text times its idf, which
is 1 up to a share ``COMMON`` of all documents and falls to ``LEAST_IDF`` for one
that is everywhere. The bounds keep an edit of a copy from outweighing the text
that many copies share. Document counts come from a sketch of fixed size over all
documents, so only shingles above that share need to be known to the tasks.

Improved consistent weighted sampling draws ``BANDS x ROWS`` samples of each
distinct text; two texts have a sample in common with a chance equal to their
weighted Jaccard similarity. Texts that share all samples of a band share a
bucket. Candidates are then verified by their exact weighted Jaccard similarity:

1. Every member of a bucket is compared with the bucket's most central text, the
   one whose buckets are largest: in a group of edited copies that is the text
   which the others were made from. So a bucket costs one comparison a member.
2. In buckets that are not yet one class, members of different classes are screened
   by their samples, in bounded blocks. The members with a partner that may reach
   the threshold are compared exactly inside the block; a block emits its members
   and the links that join them up, never its pairs.
3. Verified links are joined to classes by spreading the least label.

A band misses a pair at the threshold with a chance of 1 - 0.8^4, all 16 bands
with 2 in 10,000; above the threshold the chance falls fast.

Cases: texts without a word (null, empty, white space) and rows with a null id
are a class of their own each. Equal word sequences are one distinct text, known
by 64 bits of its digest. Rows with equal ids and equal texts are one document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinara.llm.common import blocks, mixed, partitions, picked, segments, shared, small_batches, tidy
from affinara.shipping import written

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4
COMMON, LEAST_IDF = 0.01, 0.75
SLOTS = 1 << 20
SLOT_BLOCK = 1 << 14
TABLE_BITS = 16
BLOCK_BYTES = 2 << 20
SCREEN = 0.6  # share of samples in common below which a pair is not verified: five deviations under the threshold
SIDE = 1024  # of a block of screened members


def words_of(column) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Word numbers of all texts end to end, the number of words of each text, and the words by number."""
    text = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    text = pc.utf8_trim_whitespace(pc.utf8_lower(pc.fill_null(text.cast(pa.string()), "")))
    split = pc.utf8_split_whitespace(text)
    words, owner = split.flatten(), pc.list_parent_indices(split)
    full = pc.not_equal(words, "")  # what edges of a text may leave
    sizes = np.bincount(owner.filter(full).to_numpy(), minlength=len(text)).astype(np.int64)
    flat = words.filter(full).dictionary_encode()
    return flat.indices.to_numpy().astype(np.int64), sizes, flat.dictionary


class Shingles:
    """Distinct shingles of texts: hashes and counts end to end, and how many each text has."""

    def __init__(self, column):
        word, sizes, names = words_of(column)
        self.words = sizes
        value = np.fromiter(map(xxhash.xxh64_intdigest, names.to_pylist()), np.uint64, len(names))[word]
        starts = np.cumsum(sizes) - sizes
        many = np.maximum(sizes - WIDTH + 1, np.minimum(sizes, 1))
        text = np.repeat(np.arange(len(sizes)), many)
        first = segments(starts, many)
        end = (starts + sizes)[text]
        h = np.zeros(len(first), np.uint64)
        for step in range(WIDTH):
            at = first + step
            inside = at < end
            h *= np.uint64(0x9E3779B97F4A7C15)
            h[inside] += value[at[inside]]
        h = mixed(h)
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])]) if len(h) else np.zeros(0, np.int64)
        self.hash, self.text = h[new], text[new]
        self.count = np.diff(np.r_[new, len(h)])
        self.sizes = np.bincount(self.text, minlength=len(sizes))


def normal_digest(column) -> list[int | None]:
    """64 bits of a digest of each text's words; None without a word."""
    out = []
    for text in column.to_pylist():
        words = (text or "").lower().split()
        out.append(int.from_bytes(hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass")).digest()[:8], "big", signed=True) if words else None)
    return out


class Weights:
    """Idf of common shingles by slot; all others weigh 1."""

    def __init__(self, documents: int, slots: np.ndarray, counts: np.ndarray):
        self.slot = slots
        share = np.log(max(documents, 1) / np.maximum(counts, 1)) / np.log(1 / COMMON)
        self.idf = np.clip(share, LEAST_IDF, 1.0)

    def of(self, s: Shingles) -> np.ndarray:
        weight = s.count.astype(np.float64)
        if len(self.slot):
            slot = (s.hash & np.uint64(SLOTS - 1)).astype(np.int64)
            at = np.minimum(np.searchsorted(self.slot, slot), len(self.slot) - 1)
            weight *= np.where(self.slot[at] == slot, self.idf[at], 1.0)
        return weight


class Sampler:
    """Improved consistent weighted sampling; random values of a shingle come from tables by its hash."""

    def __init__(self, weights: Weights, seed: int = 3):
        random = np.random.default_rng(seed)
        n = 1 << TABLE_BITS
        self.weights = weights
        self.r, c, self.beta = random.gamma(2, 1, n), random.gamma(2, 1, n), random.random(n)
        self.log_c = np.log(c)
        self.odd = random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.unit = self.ranked(self.log_c - self.r * (1 - self.beta))  # for weight 1

    @staticmethod
    def ranked(value: np.ndarray) -> np.ndarray:
        """Floats as numbers of the same order in the upper 32 bits."""
        bits = value.astype(np.float32).view(np.uint32)
        return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64) << np.uint64(32)

    def samples(self, s: Shingles) -> np.ndarray:
        """Texts by samples; texts without a shingle have zeros."""
        weight = self.weights.of(s)
        out = np.zeros((len(s.sizes), len(self.odd)), np.uint64)
        some = np.flatnonzero(s.sizes)
        if not len(some):
            return out
        start = (np.cumsum(s.sizes) - s.sizes)[some]
        name = mixed(s.hash.copy()) & np.uint64(0xFFFFFFFF)  # that of t = 0: one name whatever the weight
        other = np.flatnonzero(weight != 1)
        log_w, own = np.log(weight[other]), s.hash[other]
        for i, odd in enumerate(self.odd):
            at = (s.hash * odd) >> np.uint64(64 - TABLE_BITS)
            key = self.unit[at] | name
            if len(other):
                o = at[other]
                t = np.floor(log_w / self.r[o] + self.beta[o])
                a = self.log_c[o] - self.r[o] * (t - self.beta[o] + 1)
                step = mixed(own + t.astype(np.int64).view(np.uint64)) & np.uint64(0xFFFFFFFF)
                key[other] = self.ranked(a) | step
            out[some, i] = np.minimum.reduceat(key, start)
        return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    key = np.zeros((len(samples), BANDS), np.uint64)
    for row in range(ROWS):
        key = key * np.uint64(0x9E3779B97F4A7C15) + samples[:, row::ROWS]
    return mixed(key + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)


def weigh(docs: DataFrame) -> Weights:
    """Count the documents of every shingle slot; only slots above the common share come to the driver."""

    def counted(batches):
        count, rows = np.zeros(SLOTS, np.int64), 0
        for block in blocks(batches, "text", BLOCK_BYTES):
            s = Shingles(block.column("text"))
            count += np.bincount((s.hash & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
            rows += int((s.words > 0).sum())
        for start in range(0, SLOTS, SLOT_BLOCK) if rows else ():
            part = count[start : start + SLOT_BLOCK].astype(np.int32 if rows < 1 << 31 else np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([start]), pa.array([rows]), pa.array([part.tobytes()], pa.binary())], ["start", "n", "part"])

    def summed(batches):
        total: dict[int, np.ndarray] = {}
        rows: dict[int, int] = {}
        for batch in batches:
            for start, n, part in zip(*(batch.column(c).to_pylist() for c in ("start", "n", "part")), strict=True):
                total[start] = total.get(start, 0) + np.frombuffer(part, np.int32 if n < 1 << 31 else np.int64).astype(np.int64)
                rows[start] = rows.get(start, 0) + n
        for start, count in total.items():
            common = np.flatnonzero(count > max(1.0, COMMON * rows[start]))
            yield pa.RecordBatch.from_arrays([pa.array(start + common), pa.array(count[common]), pa.array(np.full(len(common), rows[start]))], ["slot", "count", "n"])

    parts = docs.select("text").mapInArrow(tidy(counted), "start long, n long, part binary")
    parts = parts.repartition(min(partitions(docs), SLOTS // SLOT_BLOCK), "start")
    found = parts.mapInArrow(tidy(summed), "slot long, count long, n long").toPandas().sort_values("slot")
    documents = int(found["n"].max()) if len(found) else 0
    return Weights(documents, found["slot"].to_numpy(np.int64), found["count"].to_numpy(np.float64))


def similarity(a: pa.Array, b: pa.Array, weights: Weights) -> np.ndarray:
    """Weighted Jaccard similarity of pairs of texts."""
    n = len(a)
    s = Shingles(pa.chunked_array([a, b]).combine_chunks())
    weight, pair = weights.of(s), s.text % n
    order = np.lexsort((s.hash, pair))
    h, p, w = s.hash[order], pair[order], weight[order]
    twin = np.flatnonzero((h[1:] == h[:-1]) & (p[1:] == p[:-1]))
    both = np.bincount(p[twin], np.minimum(w[twin], w[twin + 1]), n)
    total = np.bincount(p, w, n) - both
    return np.divide(both, total, out=np.zeros(n), where=total > 0)


def linked(pairs: DataFrame, texts: DataFrame, load, threshold: float) -> DataFrame:
    """Of pairs (a, b) of nodes those that reach the threshold; the texts come by joins."""

    def verified(batches):
        for block in blocks(batches, "text_a", BLOCK_BYTES // 2):
            value = similarity(block.column("text_a").combine_chunks(), block.column("text_b").combine_chunks(), load())
            yield from block.select(["a", "b"]).filter(pa.array(value >= threshold - 1e-9)).combine_chunks().to_batches()

    first = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"), F.col("weight").alias("weight_a"))
    second = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"), F.col("weight").alias("weight_b"))
    both = pairs.join(first, "a").join(second, "b")
    # the lighter of two similar texts has at least the threshold's share of the other's weight
    near = F.least("weight_a", "weight_b") >= (threshold - 1e-6) * F.greatest("weight_a", "weight_b")
    return both.where(near).select("a", "b", "text_a", "text_b").mapInArrow(tidy(verified), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node and label (the least node of its component) for all nodes of links (a, b)."""
    edges = written(links.union(links.select("b", "a")).distinct().toDF("node", "other"), "near-edges")
    labels = edges.groupBy("node").agg(F.least("node", F.min("other")).alias("label"))
    labels = written(labels, "near-labels")
    while True:
        around = edges.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        nearer = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # and the label's own label: paths halve in length
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = written(nearer.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "near-labels")
        changed = jumped.where("old <> label").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    side = table.column("side").to_numpy()
    return np.flatnonzero(side == table.column("low")[0].as_py()), np.flatnonzero(side == table.column("high")[0].as_py())


def screened(members: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """Members of buckets that have a partner of another label with enough samples in common, block by block.

    A pair counts in the first band it has in common only. A block gives each member once, not its pairs.
    """
    marked = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed_up = marked.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low < high")
    mixed_up = written(mixed_up.select("band", F.ceil(F.col("n") / SIDE).alias("sides")), "near-mixed")
    rows = marked.join(mixed_up, "band").withColumn("side", F.pmod(F.xxhash64("node"), F.col("sides")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1))
    rows = rows.withColumn("other", other).withColumn("low", F.least("side", "other")).withColumn("high", F.greatest("side", "other"))

    def paired(table: pa.Table) -> pa.Table:
        node, label = (table.column(c).to_numpy() for c in ("node", "label"))
        sample = np.frombuffer(b"".join(table.column("samples").to_pylist()), np.uint32).reshape(len(node), -1)
        nth, need = table.column("nth")[0].as_py(), int(np.ceil(threshold * sample.shape[1]))
        left, right = _sides(table)
        met = np.zeros(len(node), bool)
        for i in left:
            equal = sample[right] == sample[i]
            hit = np.flatnonzero((equal.sum(1) >= need) & (label[right] != label[i]))
            hit = hit[equal[hit].reshape(len(hit), BANDS, ROWS).all(2).argmax(1) == nth]
            if len(hit):
                met[i] = True
                met[right[hit]] = True
        kept = np.flatnonzero(met)
        return table.select(["band", "low", "high", "side", "node", "label"]).take(pa.array(kept))

    return rows.groupBy("band", "low", "high").applyInArrow(paired, "band long, low long, high long, side long, node long, label long")


def block_links(met: DataFrame, texts: DataFrame, load, threshold: float) -> DataFrame:
    """Links (a, b) between members of different labels in a block, by exact similarity; no more than join them up."""

    def verified(table: pa.Table) -> pa.Table:
        node, label = (table.column(c).to_numpy() for c in ("node", "label"))
        s = Shingles(table.column("text"))
        weight = load().of(s)
        total = np.bincount(s.text, weight, len(node))
        names, name = np.unique(s.hash, return_inverse=True)
        start = np.r_[0, np.cumsum(s.sizes)]
        own = np.zeros(len(names))
        joined = {x: x for x in np.unique(label).tolist()}

        def root(x):
            while joined[x] != x:
                joined[x] = joined[joined[x]]
                x = joined[x]
            return x

        left, right = _sides(table)
        a, b = [], []
        for i in left.tolist():
            roots = np.array([root(x) for x in label[right].tolist()])
            other = right[(roots != root(int(label[i]))) & (np.minimum(total[right], total[i]) >= (threshold - 1e-6) * np.maximum(total[right], total[i]))]
            if not len(other):
                continue
            mine = slice(start[i], start[i + 1])
            own[name[mine]] = weight[mine]
            at = segments(start[other], s.sizes[other])
            common = np.add.reduceat(np.minimum(own[name[at]], weight[at]), np.cumsum(s.sizes[other]) - s.sizes[other])
            own[name[mine]] = 0
            for j in other[common >= (threshold - 1e-9) * (total[other] + total[i] - common)].tolist():
                x, y = root(int(label[i])), root(int(label[j]))
                if x != y:
                    joined[max(x, y)] = min(x, y)
                    a.append(node[i])
                    b.append(node[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = met.join(texts.select("node", "text"), "node")
    return rows.groupBy("band", "low", "high").applyInArrow(verified, "a long, b long").distinct()


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and class_id, the least doc_id of the row's class, for every row."""
    spark = df.sparkSession
    small_batches(spark)
    docs = picked(df, doc_id=doc_id, text=text)
    kind = docs.schema["doc_id"].dataType.simpleString()
    weights = weigh(docs)
    load = shared(spark, weights)

    def sampled(batches):
        sampler = Sampler(load())
        for block in blocks(batches, "text", BLOCK_BYTES):
            s = Shingles(block.column("text"))
            samples = sampler.samples(s)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(samples) + 1, dtype=np.int32) * BANDS), pa.array(band_keys(samples).ravel()))
            short = [x.tobytes() for x in (samples ^ samples >> np.uint64(32)).astype(np.uint32)]
            out = pa.table([block.column("doc_id"), pa.array(normal_digest(block.column("text")), pa.int64()), bands, pa.array(short, pa.binary())], ["doc_id", "node", "bands", "samples"])
            yield from out.combine_chunks().to_batches()

    keyed = written(docs.mapInArrow(tidy(sampled), f"doc_id {kind}, node long, bands array<long>, samples binary"), "near-samples")
    rows = keyed.where("node IS NOT NULL AND doc_id IS NOT NULL").select("node", F.posexplode("bands").alias("nth", "band")).distinct()
    sizes = written(rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "near-sizes")
    members = written(rows.join(sizes, "band"), "near-members")
    central = members.groupBy("node").agg(F.sum("n").alias("centre"))
    leader = members.join(central, "node").groupBy("band").agg(F.max_by("node", F.struct("centre", "node")).alias("leader"))
    leader = written(leader, "near-leaders")
    stars = members.join(leader, "band").where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()

    def named(batches):
        for block in blocks(batches, "text", BLOCK_BYTES):
            s = Shingles(block.column("text"))
            total = np.bincount(s.text, load().of(s), len(block))
            out = pa.table([pa.array(normal_digest(block.column("text")), pa.int64()), block.column("text"), pa.array(total)], ["node", "text", "weight"])
            yield from out.combine_chunks().to_batches()

    # one document for each node that has company, found by the least id
    alone = keyed.where("doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    company = alone.join(members.select("node").distinct(), "node", "left_semi")
    chosen = docs.join(company.select("doc_id").distinct(), "doc_id", "left_semi").select("text")
    texts = chosen.mapInArrow(tidy(named), "node long, text string, weight double")
    texts = written(texts.groupBy("node").agg(F.first("text").alias("text"), F.first("weight").alias("weight")), "near-texts")

    links = written(linked(stars, texts, load, threshold), "near-links")
    labels = written(links.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("label"))).groupBy("node").agg(F.min("label").alias("label")), "near-first")
    with_samples = members.select("node", "nth", "band").join(keyed.where("node IS NOT NULL").select("node", "samples").dropDuplicates(["node"]), "node")
    met = written(screened(with_samples, labels, SCREEN), "near-met")
    links = links.union(block_links(met, texts, load, threshold))
    labels = components(links)
    found = written(keyed.select("doc_id", "node").join(labels, "node", "left").select("doc_id", F.coalesce("label", "node").alias("label")), "near-found")
    least = written(found.where("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("class_id")), "near-classes")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    return found.join(least, "label", "left").select("doc_id", own.alias("class_id"))


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` without near duplicates: of every class the document with the least id stays.

    Rows with null ids stay. Of rows with equal ids one stays if any of their texts leads its class.
    """
    mark = "_" * (1 + max(map(len, df.columns)))  # no column's name
    decided = classes(df, doc_id, text, threshold).where("doc_id = class_id").select(F.col("doc_id").alias(mark)).distinct()
    named = df.where(F.col(doc_id).isNotNull())
    kept = named.join(decided, F.col(doc_id) == F.col(mark), "left_semi").dropDuplicates([doc_id])
    return kept.unionByName(df.where(F.col(doc_id).isNull()))
