"""Removal of repeated byte strings by a distributed, sampled suffix order.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller id. Ordering every suffix of a corpus would move fifty
times its size, so the suffixes that can have a twin are found first, without
loss: every string of LENGTH bytes names the least hashed of the ``GRAM``-byte
grams inside it, its anchor, by its content alone. Equal strings name equal
anchors, so only strings at anchors that occur more than once can repeat.

0. A text that equals the text of a smaller id loses all (if it is long enough) and
   teaches nothing that the other does not: such copies are known by digest and
   take no part below.
1. Documents are dealt into chunks by a hash of id and text; those without an id pass by. Every chunk sends the
   hashes of its anchors once each; those met twice are sent back.
2. For such anchors a chunk sends the bytes around it once, however many of its
   documents hold them, with the least id. Splitters sampled from the anchors'
   grams of documents all over the corpus range-partition them; every bucket is
   ordered by a multikey sort (eight bytes at a time, going on only among ties), and
   equal strings get the least id of all. A boundary always lies between two
   different grams, so no two equal strings ever lie on its two sides.
3. The least ids go back to the chunks, which cut their texts.

A frequent passage therefore costs a row per chunk, not per document, and no list
of its documents is ever gathered. The texts are shuffled once; all three steps
read that same exchange.

Cases: a null text is an empty text; a text shorter than LENGTH loses nothing. A
document with a null id loses nothing and takes nothing. Documents with equal ids
take nothing from each other. Ids must be whole numbers (or text of one): any other
id is an error. Rows stay as they are otherwise, with all columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinara.llm.common import mixed, partitions, segments, small_batches, tidy
from affinara.shipping import written

LENGTH = 50
GRAM = 16
STRIP = 1 << 20
POSITION_BITS = 21
CHUNK_ROWS = 1024
CHUNK_BYTES = 6 << 20  # on average; a chunk is held in memory
SAMPLES = 64  # splitter candidates for a bucket
OF_ONE = 8  # of these from one document at most
BATCH = 40_000  # rows sorted at a time, and those that share the last one's leading bytes
RECORD = "bucket int, body binary, ahead int, least long, most long, chunk long, place int"
WORDS = 12  # 64-bit letters of a record: 88 bytes, and its lengths


def unpacked(column) -> list[bytes | None]:
    expand = zstandard.ZstdDecompressor().decompress
    return [None if t is None else expand(t) for t in column.to_pylist()]


class Chunk:
    """The texts of a chunk end to end, in the order of their ids, and their anchors."""

    def __init__(self, table: pa.Table, key: str, text: str, copies=()):
        ids, texts = table.column(key).to_pylist(), unpacked(table.column(text))
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or b""))
        raw = [texts[i] or b"" for i in self.order]
        sizes = np.array([len(t) for t in raw], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.bytes = b"".join(raw)
        self.ids = np.array([-1 if ids[i] is None else ids[i] for i in self.order], np.int64)
        self.named = np.array([ids[i] is not None for i in self.order], bool)
        self.valid = np.ones(len(self.bytes), bool)
        self.copies = np.isin(self.ids, copies) & self.named
        short = np.where(self.named & ~self.copies, np.minimum(sizes, LENGTH - 1), sizes)
        self.valid[segments(self.ends - short, short)] = False

    def anchors(self):
        """Position, first and last string start, and hash of every anchor, ascending by position."""
        data = np.frombuffer(self.bytes, np.uint8)
        parts = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)]
        power, inverse, letter = _powers(min(len(data), STRIP + LENGTH))
        for start in range(0, len(data) - LENGTH + 1, STRIP):
            first = np.flatnonzero(self.valid[start : start + STRIP])
            if not len(first):
                continue
            piece = data[start : start + STRIP + LENGTH - 1]
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(letter[piece] * power[: len(piece)], out=total[1:])
            gram = total[GRAM:] - total[:-GRAM]
            gram *= inverse[: len(gram)]
            gram = mixed(gram)
            best = (gram >> np.uint64(POSITION_BITS)) << np.uint64(POSITION_BITS)
            best |= np.arange(len(gram), dtype=np.uint64)
            grams = LENGTH - GRAM + 1
            for step in (1, 2, 4, 8, 16):
                best = np.minimum(best[:-step], best[step:])
            best = np.minimum(best[: 32 - grams], best[grams - 32 :])
            at = (best[first] & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
            new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            last = np.r_[new[1:], len(at)] - 1
            parts.append((at[new] + start, first[new] + start, first[last] + start, gram[at[new]]))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def bodies(self, at, lo, hi):
        """Strings around anchors: (bytes before the anchor, bytes) for each."""
        data = self.bytes
        return [(a - s, data[s : e + LENGTH]) for a, s, e in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True)]


def _powers(n: int):
    """Powers of an odd base and of its inverse modulo 2^64, and a random value for each byte."""
    base = 0x9E3779B97F4A7C15
    power, inverse = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    if n:
        power[0] = inverse[0] = 1
    np.cumprod(power, out=power)
    np.cumprod(inverse, out=inverse)
    return power, inverse, mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _isin(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)
    return ascending[at] == values


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of 64-bit letters, and the number of each ordered row's run of equal rows.

    Sorts by the first letter and goes on to the next only among rows that still tie.
    """
    order = np.argsort(words[:, 0], kind="stable")
    first = words[order, 0]
    new = np.r_[True, first[1:] != first[:-1]][: len(order)]
    for letter in range(1, words.shape[1]):
        run = np.cumsum(new) - 1
        tied = ~new
        tied[:-1] |= ~new[1:]
        place = np.flatnonzero(tied)
        if not len(place):
            break
        rows = order[place]
        sub = np.lexsort((words[rows, letter], run[place]))
        order[place] = rows[sub]
        value, group = words[order[place], letter], run[place]
        new[place] = np.r_[True, (value[1:] != value[:-1]) | (group[1:] != group[:-1])]
    return order, np.cumsum(new) - 1


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of a zero-padded matrix, and their lengths."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offset = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(array.buffers()[2], np.uint8)
    size = np.diff(offset)
    out = np.zeros((len(size), 8 * (WORDS - 1)), np.uint8)
    out.ravel()[segments(np.arange(len(size)) * out.shape[1], size)] = data[offset[0] : offset[-1]]
    return out, size


def least_ids(table: pa.Table) -> pa.Table:
    """For all strings of these records the least id of a document that holds them; equal strings are all here."""
    body, size = _matrix(table.column("body"))
    ahead = table.column("ahead").to_numpy().astype(np.int64)
    least, most = table.column("least").to_numpy(), table.column("most").to_numpy()
    words = np.column_stack([body.view(">u8").astype(np.uint64), (size * 256 + ahead).astype(np.uint64)])
    order, run = multikey_order(words)
    head = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    own = np.minimum.reduceat(least[order], head)  # of each distinct record
    kind = np.empty(len(order), np.int64)
    kind[order] = run
    distinct, length = order[head], size[order[head]] - LENGTH + 1
    # distinct records around one gram have strings in common or not: order those strings
    gram_at = ahead[distinct][:, None] + np.arange(GRAM)
    gram = np.zeros((len(distinct), 24), np.uint8)
    gram[:, :GRAM] = body[distinct[:, None], gram_at]
    by_gram, gram_run = multikey_order(gram.view(">u8").astype(np.uint64))
    many = np.bincount(gram_run)[gram_run] > 1
    mixed_up = np.sort(by_gram[many])
    record = np.repeat(np.arange(len(distinct)), length)
    string = segments(np.zeros(len(distinct), np.int64), length)
    low = own[record].copy()
    if len(mixed_up):
        base = np.cumsum(length) - length
        part = segments(base[mixed_up], length[mixed_up])
        for_string = np.zeros((len(part), 56), np.uint8)
        view = np.lib.stride_tricks.sliding_window_view(body, LENGTH, axis=1)
        for_string[:, :LENGTH] = view[distinct[record[part]], string[part]]
        o, r = multikey_order(for_string.view(">u8").astype(np.uint64))
        h = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        low[part[o]] = np.minimum.reduceat(low[part[o]], h)[r]
    # neighbouring strings with one least id become one row
    new = np.flatnonzero(np.r_[True, (record[1:] != record[:-1]) | (low[1:] != low[:-1])])
    stop = np.r_[new[1:], len(record)] - 1
    rows_of = np.searchsorted(record[new], np.arange(len(distinct) + 1))
    count = np.diff(rows_of)[kind]
    row = np.repeat(np.arange(len(kind)), count)
    which = segments(rows_of[kind], count)
    useful = low[new[which]] < most[row]
    row, which = row[useful], which[useful]
    return pa.table(
        {
            "chunk": table.column("chunk").take(pa.array(row)),
            "place": table.column("place").take(pa.array(row)),
            "first": pa.array(string[new[which]].astype(np.int32)),
            "last": pa.array(string[stop[which]].astype(np.int32)),
            "least": pa.array(low[new[which]]),
        }
    )


def _met_twice(batches):
    """Of rows in the order of ``gram``, those whose gram has another row."""
    gram, chunk, met = np.zeros(0, np.int64), np.zeros(0, np.int64), False
    for batch in batches:
        if not len(batch):
            continue
        gram = np.concatenate([gram, batch.column("gram").to_numpy()])
        chunk = np.concatenate([chunk, batch.column("chunk").to_numpy()])
        same = gram[1:] == gram[:-1]
        keep = np.r_[False, same] | np.r_[same, False]
        keep[0] |= met
        met = keep[-1]
        # the last row waits for the next batch
        done = np.flatnonzero(keep[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(gram[done]), pa.array(chunk[done])], ["gram", "chunk"])
        gram, chunk = gram[-1:], chunk[-1:]
    if met:
        yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(chunk)], ["gram", "chunk"])


def _cut(batches, rows: int):
    """Tables of at least this many rows, in the order of ``lead`` and cut only where it changes."""
    held, size, last = [], 0, b""
    for batch in batches:
        if not len(batch):
            continue
        if size >= rows:
            lead = np.array([last, *batch.column("lead").to_pylist()], f"S{GRAM}")
            change = np.flatnonzero(lead[1:] != lead[:-1])
            if len(change):
                cut = int(change[-1])
                yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
                held, size, batch = [], 0, batch.slice(cut)
        held.append(batch)
        size, last = size + len(batch), batch.column("lead")[len(batch) - 1].as_py()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """All rows and columns of ``df`` and ``n_bytes``, ``spans`` (removed byte ranges) and ``kept`` (the bytes left)."""
    return _removed(df, doc_id, text, chunk_rows, as_text=False)


def _removed(df: DataFrame, doc_id: str, text: str, chunk_rows: int, as_text: bool) -> DataFrame:
    """``remove_repeats``, or with ``as_text`` the rows of ``df`` with the rest of their text."""
    small_batches(df.sparkSession)
    names = df.columns
    inner = [f"_c{i}" for i in range(len(names))]
    key, body = inner[names.index(doc_id)], inner[names.index(text)]
    rows = df.toDF(*inner)
    if rows.schema[key].dataType != T.LongType():
        rows = rows.withColumn("_key", F.col(key).cast("long"))
        key = "_key"
    without_id = rows.where(F.col(key).isNull())
    rows = rows.where(F.col(key).isNotNull())
    total = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length(body)), F.lit(0)).alias("bytes")).head()
    chunks = max(1, -(-total["rows"] // chunk_rows), -(-total["bytes"] // CHUNK_BYTES))
    rows = rows.withColumn("_chunk", F.pmod(F.xxhash64(key, body, F.lit(11)), F.lit(chunks)))
    wide, number = rows.schema, partitions(df)

    digest = rows.where(F.col(body).isNotNull()).select(F.col(key).alias("copy"), F.md5(F.col(body).cast("binary")).alias("digest"), F.col("_chunk").alias("chunk"))
    first = written(digest.groupBy("digest").agg(F.min("copy").alias("first"), F.max("copy").alias("last")).where("first < last").drop("last"), "suffix-first-copies")
    # of rows with one id none is a copy of a smaller id unless all are: ids with several rows stay as they are
    single = rows.groupBy(F.col(key).alias("copy")).agg(F.count("*").alias("n")).where("n = 1").select("copy")
    copies = digest.join(first, "digest").where("copy > first").join(single, "copy").select("copy", "chunk")
    copies = written(copies, "suffix-copies")

    def packed(batches):
        for batch in batches:
            squeeze = zstandard.ZstdCompressor(level=3).compress
            column = [None if t is None else squeeze(t) for t in batch.column(body).cast(pa.binary()).to_pylist()]
            yield batch.set_column(batch.schema.get_field_index(body), body, pa.array(column, pa.binary()))

    # texts travel compressed
    rows = rows.mapInArrow(tidy(packed), T.StructType([T.StructField(f.name, T.BinaryType() if f.name == body else f.dataType) for f in wide]))
    by_chunk = rows.groupBy("_chunk")

    def hashes(table: pa.Table, copied: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({"gram": pa.array([], pa.int64()), "chunk": pa.array([], pa.int64())})
        found = np.unique(Chunk(table, key, body, copied.column("copy").to_numpy()).anchors()[3]).view(np.int64)
        return pa.table({"gram": found, "chunk": pa.array(np.full(len(found), table.column("_chunk")[0].as_py()), pa.int64())})

    grams = by_chunk.cogroup(copies.groupBy("chunk")).applyInArrow(hashes, "gram long, chunk long")
    # a chunk's own twins show below; here a gram counts that two chunks hold
    twice = grams.repartition(number, "gram").sortWithinPartitions("gram").mapInArrow(tidy(_met_twice), "gram long, chunk long")

    def leads(batches):
        for batch in batches:
            for i in range(len(batch)):
                chunk = Chunk(pa.Table.from_batches([batch.slice(i, 1)]), key, body)
                at, _, _, gram = chunk.anchors()
                found = [chunk.bytes[a : a + GRAM] for a in at[np.argsort(gram)[:OF_ONE]].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["lead"])

    # documents from all over the corpus, by hash: about twice as many as the splitters need
    every = max(1, total["rows"] // max(1024, 2 * SAMPLES * number // OF_ONE))
    some = rows.where(F.pmod(F.xxhash64(F.lit(5), key), F.lit(every)) == 0).select(F.col(key), F.col(body))
    sampled = some.mapInArrow(tidy(leads), "lead binary").orderBy(F.xxhash64("lead")).limit(SAMPLES * number).collect()
    lead = np.sort(np.array([bytes(r["lead"]) for r in sampled], f"S{GRAM}"))
    splitters = lead[(np.arange(1, number) * len(lead)) // number] if len(lead) else lead

    def records(table: pa.Table, shared: pa.Table) -> pa.Table:
        out: dict[tuple[int, bytes], list[int]] = {}
        if len(table):
            chunk = Chunk(table, key, body, copied(shared))
            at, lo, hi, gram = chunk.anchors()
            owner = np.searchsorted(chunk.ends, lo, side="right")
            gram = gram.view(np.int64)
            known = np.sort(shared.column("gram").drop_null().to_numpy())
            kept = _isin(gram, known)
            order = np.argsort(gram, kind="stable")
            same = gram[order][1:] == gram[order][:-1]
            kept[order] |= np.r_[False, same] | np.r_[same, False]
            at, lo, hi, ids = at[kept], lo[kept], hi[kept], chunk.ids[owner[kept]]
            for record, place, doc in zip(chunk.bodies(at, lo, hi), lo.tolist(), ids.tolist(), strict=True):
                held = out.get(record)
                if held is None:
                    out[record] = [doc, doc, place]
                else:
                    held[1] = doc  # ids ascend
        lead = np.array([b[a : a + GRAM] for a, b in out], f"S{GRAM}")
        values = list(out.values())
        number_of = table.column("_chunk")[0].as_py() if len(table) else 0
        return pa.table(
            {
                "bucket": pa.array(np.searchsorted(splitters, lead, side="right").astype(np.int32)),
                "body": pa.array([b for _, b in out], pa.binary()),
                "ahead": pa.array([a for a, _ in out], pa.int32()),
                "least": pa.array([v[0] for v in values], pa.int64()),
                "most": pa.array([v[1] for v in values], pa.int64()),
                "chunk": pa.array([number_of] * len(values), pa.int64()),
                "place": pa.array([v[2] for v in values], pa.int32()),
            }
        )

    def ordered(batches):
        for table in _cut(batches, BATCH):
            yield from least_ids(table).combine_chunks().to_batches()

    def copied(other: pa.Table) -> np.ndarray:
        return other.column("copy").drop_null().to_numpy()

    shared = twice.withColumn("copy", F.lit(None).cast("long")).unionByName(copies.withColumn("gram", F.lit(None).cast("long")))
    found = by_chunk.cogroup(shared.groupBy("chunk")).applyInArrow(records, RECORD)
    found = found.repartitionById(number, F.col("bucket")).withColumn("lead", F.expr(f"substring(body, ahead + 1, {GRAM})")).sortWithinPartitions("lead")
    lowest = found.mapInArrow(tidy(ordered), "chunk long, place int, first int, last int, least long")
    added = [T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept", T.BinaryType())]
    result = T.StructType([*wide.fields, *([] if as_text else added)])

    def cut(table: pa.Table, least: pa.Table) -> pa.Table:
        chunk = Chunk(table, key, body, copied(least))
        least = least.filter(pa.compute.is_null(least.column("copy")))
        covered = np.zeros(len(chunk.bytes) + 1, np.int32)
        whole = np.flatnonzero(chunk.copies & (chunk.ends - chunk.starts >= LENGTH))
        np.add.at(covered, chunk.starts[whole], 1)
        np.add.at(covered, chunk.ends[whole], -1)
        if len(least):
            at, lo, hi, gram = chunk.anchors()
            place = least.column("place").to_numpy()
            kept = _isin(gram, np.unique(gram[np.searchsorted(lo, place)]))
            at, lo, hi = at[kept], lo[kept], hi[kept]
            ids = chunk.ids[np.searchsorted(chunk.ends, lo, side="right")]
            holders: dict[tuple[int, bytes], list[int]] = {}
            first_at: dict[int, list[int]] = {}
            for i, record in enumerate(chunk.bodies(at, lo, hi)):
                held = holders.setdefault(record, [])
                if not held:
                    first_at[int(lo[i])] = held
                held.append(i)
            lists = [first_at[p] for p in place.tolist()]
            count = np.array([len(x) for x in lists], np.int64)
            holder = np.concatenate([np.array(x, np.int64) for x in lists])
            row = np.repeat(np.arange(len(lists)), count)
            gone = ids[holder] > least.column("least").to_numpy()[row]
            holder, row = holder[gone], row[gone]
            np.add.at(covered, lo[holder] + least.column("first").to_numpy()[row], 1)
            np.add.at(covered, lo[holder] + least.column("last").to_numpy()[row] + LENGTH, -1)
        gone = np.cumsum(covered[:-1]) > 0
        data = np.frombuffer(chunk.bytes, np.uint8)
        edge = np.zeros(len(data), bool)
        edge[chunk.starts[chunk.starts < chunk.ends]] = True
        begin = np.flatnonzero(gone & (edge | ~np.r_[True, gone[:-1]])) if len(data) else np.zeros(0, np.int64)
        last = np.r_[edge[1:], True][: len(data)]
        stop = np.flatnonzero(gone & (last | ~np.r_[gone[1:], True])) + 1 if len(data) else begin
        spans, kept = [], []
        a, b = np.searchsorted(begin, chunk.starts), np.searchsorted(begin, chunk.ends)
        for i, (start, end) in enumerate(zip(chunk.starts.tolist(), chunk.ends.tolist(), strict=True)):
            if not as_text:
                spans.append([[int(x) - start, int(y) - start] for x, y in zip(begin[a[i] : b[i]], stop[a[i] : b[i]], strict=True)])
            kept.append(data[start:end][~gone[start:end]].tobytes() if a[i] < b[i] else chunk.bytes[start:end])
        text_at = table.schema.get_field_index(body)
        out = table.take(pa.array(chunk.order))
        if as_text:
            there = out.column(body).is_valid().to_pylist()
            text = [k.decode("utf-8", "ignore") if t else None for k, t in zip(kept, there, strict=True)]
            return out.set_column(text_at, body, pa.array(text, pa.string()))
        out = out.set_column(text_at, body, pa.array(unpacked(out.column(body)), pa.binary()).cast(pa.string()))
        out = out.append_column("n_bytes", pa.array(chunk.ends - chunk.starts))
        out = out.append_column("spans", pa.array(spans, pa.list_(pa.list_(pa.int64()))))
        return out.append_column("kept", pa.array(kept, pa.binary()))

    back = lowest.withColumn("copy", F.lit(None).cast("long")).unionByName(copies, allowMissingColumns=True)
    done = by_chunk.cogroup(back.groupBy("chunk")).applyInArrow(cut, result)
    outer = [F.col(i).alias(n) for i, n in zip(inner, names, strict=True)]
    if as_text:
        return done.select(outer).union(without_id.select(outer))
    whole = F.coalesce(F.col(body), F.lit("")).cast("binary")
    spans = F.array().cast("array<array<bigint>>")
    passed = without_id.select(*outer, F.length(whole).cast("long").alias("n_bytes"), spans.alias("spans"), whole.alias("kept"))
    return done.select(*outer, "n_bytes", "spans", "kept").union(passed)


def cut_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The rows of ``df`` with repeated strings cut from their texts; a character that lost some of its bytes goes whole.

    A null text stays null, a text of which nothing is left becomes empty.
    """
    return _removed(df, doc_id, text, chunk_rows, as_text=True)
