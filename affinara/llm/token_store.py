"""Token ids in compressed blocks: a static range asymmetric numeral system (rANS) over shared frequencies.

A store is a folder of three Parquet tables, so any file system that Spark reads
and writes can hold it, and a lost task leaves no half-written file behind:

* ``frequencies``: one row, the code's table (total ``1 << scale_bits``) and its checksum;
* ``blocks``: the ids of all documents in ascending order of document ids, cut into
  independent blocks of at most ``BLOCK_IDS``;
* ``parts``: for each range of document ids the number of ids before it.

A block's payload (little-endian) is: magic, version, lanes, steps between
checkpoints, number of ids, number of segments, CRC-32 of the table it was coded
with and of the ids; then for each segment the states of all lanes, the offset of
its words and their CRC-32; then the words. Lane j codes ids j, j + lanes, ... .
The checkpoints let a reader decode the segments of a block side by side, or one
of them alone, and each decoded segment must end in the state of the next.

Frequencies count every id of every document. Cases: a null or empty text has only
its end id. Null document ids come first. Rows with equal ids are documents of their
own, next to each other. An empty table gives a store without blocks. Other columns
are left behind, whatever they are called.
"""

from __future__ import annotations

import json
import struct
import zlib
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from affinara.llm.bpe import byte_letters
from affinara.llm.common import blocks, partitions, picked, segments, shared, small_batches, tidy
from affinara.shipping import broadcast_if_small, scratch_path, written

TEXT_BYTES = 4 << 20
KEPT_PIECES = 600_000
BLOCK_IDS = 1 << 20
LANES = 2048
EVERY = 256  # steps between checkpoints
LOW = np.uint64(1 << 31)  # states stay in [2^31, 2^63)
WORD = np.uint64(32)
MAGIC, VERSION = b"RANS", 1
HEAD = "<4s7I"


# ---- the code ------------------------------------------------------------


class Code:
    """Frequencies scaled to a power of two; every id that occurs has at least 1."""

    def __init__(self, counts: np.ndarray, scale_bits: int | None = None):
        counts = np.asarray(counts, np.int64)
        present = np.flatnonzero(counts)
        self.bits = scale_bits or max(12, min(24, len(present).bit_length() + 4))
        total = 1 << self.bits
        if len(present) > total // 2:
            raise ValueError("too many different ids for a table of this size")
        share = np.zeros(len(counts), np.int64)
        if len(present):
            exact = counts[present] / counts[present].sum() * (total - len(present))
            share[present] = 1 + np.floor(exact).astype(np.int64)
            # what rounding down has left goes to the most frequent, in the order of their ids
            left = total - int(share.sum())
            share[present[np.lexsort((present, -counts[present]))][:1]] += left
        self.set(share)

    def set(self, share: np.ndarray) -> None:
        self.share = share.astype(np.uint64)
        self.start = np.cumsum(self.share) - self.share
        self.of_slot = np.repeat(np.arange(len(share)), share).astype(np.uint32)
        self.crc = zlib.crc32(share.astype("<u4").tobytes())

    @classmethod
    def stored(cls, share: bytes, bits: int, crc: int) -> Code:
        code = cls.__new__(cls)
        code.bits = bits
        code.set(np.frombuffer(share, "<u4").astype(np.int64))
        if code.crc != crc:
            raise ValueError("the frequency table does not match its checksum")
        return code


def encode_block(ids: np.ndarray, code: Code, lanes: int = LANES, every: int = EVERY) -> bytes:
    """The payload of one block."""
    n = len(ids)
    share, start = code.share[ids], code.start[ids]
    if n and not share.all():
        raise ValueError("an id has no frequency")
    bits, steps = np.uint64(code.bits), -(-n // lanes)
    room = np.uint64(63 - code.bits)  # a state below frequency << room takes the id without leaving its range
    state = np.full(lanes, LOW, np.uint64)
    words, count, marks = [], 0, []
    for step in range(steps - 1, -1, -1):
        a, b = step * lanes, min(n, (step + 1) * lanes)
        x, f = state[: b - a], share[a:b]
        full = x >= (f << room)
        if full.any():
            out = (x[full] & np.uint64(0xFFFFFFFF)).astype("<u4")
            words.append(out[::-1])
            count += len(out)
            x = np.where(full, x >> WORD, x)
        quotient = x // f
        state[: b - a] = (quotient << bits) + (x - quotient * f) + start[a:b]
        if step % every == 0:
            marks.append((state.copy(), count))
    stream = np.concatenate(words)[::-1] if words else np.zeros(0, "<u4")
    out = [struct.pack(HEAD, MAGIC, VERSION, lanes, every, n, len(marks), code.crc, zlib.crc32(ids.astype("<u4").tobytes()))]
    offsets = [count - c for _, c in reversed(marks)] + [count]
    for (lane_states, _), a, b in zip(reversed(marks), offsets, offsets[1:], strict=False):
        out.append(lane_states.astype("<u8").tobytes() + struct.pack("<II", a, zlib.crc32(stream[a:b].tobytes())))
    return b"".join(out) + stream.tobytes()


class Block:
    """A payload's parts, checked; decodes all segments or some of them."""

    def __init__(self, payload: bytes, code: Code):
        magic, version, self.lanes, self.every, self.n, self.segments, table, self.crc = struct.unpack_from(HEAD, payload)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a block of this format")
        if table != code.crc:
            raise ValueError("the block was coded with other frequencies")
        self.code, at = code, struct.calcsize(HEAD)
        width = 8 * self.lanes
        self.states, self.offsets, checks = [], [], []
        for _ in range(self.segments):
            self.states.append(np.frombuffer(payload, "<u8", self.lanes, at))
            offset, check = struct.unpack_from("<II", payload, at + width)
            self.offsets.append(offset)
            checks.append(check)
            at += width + 8
        self.words = np.frombuffer(payload, "<u4", offset=at)
        self.offsets.append(len(self.words))
        for a, b, check in zip(self.offsets, self.offsets[1:], checks, strict=False):
            if zlib.crc32(self.words[a:b].tobytes()) != check:
                raise ValueError("the words of a segment do not match their checksum")

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of segments first to last - 1, all by default, decoded side by side."""
        last = self.segments if last is None else last
        lanes, span = self.lanes, self.every * self.lanes
        start, stop = first * span, min(self.n, last * span)
        out = np.zeros((last - first, span), np.uint32)
        if last <= first:
            return out.ravel()
        code = self.code
        bits, mask = np.uint64(code.bits), np.uint64((1 << code.bits) - 1)
        x = np.concatenate(self.states[first:last]).reshape(last - first, lanes).copy()
        at = np.array(self.offsets[first:last])
        left = np.array([min(span, self.n - s * span) for s in range(first, last)])  # ids of each segment
        words = np.r_[self.words, np.uint32(0)].astype(np.uint64)
        for step in range(self.every):
            begin = step * lanes
            size = np.clip(left - begin, 0, lanes)
            rows = int((size == lanes).sum())  # full rows come first
            some = int((size > 0).sum())
            if not some:
                break
            y = x[:some]
            slot = y & mask
            found = code.of_slot[slot.astype(np.int64)]
            y = code.share[found] * (y >> bits) + slot - code.start[found]
            low = y < LOW
            if some > rows:
                used = np.arange(lanes) < size[some - 1]
                low[-1] &= used
                y[-1] = np.where(used, y[-1], x[some - 1])
            takes = low.sum(axis=1)
            order = np.cumsum(low, axis=1) - 1 + at[:some, None]
            y = np.where(low, (y << WORD) | words[np.where(low, order, len(words) - 1)], y)
            at[:some] += takes
            x[:some] = y
            out[:some, begin : begin + lanes] = found
        ends = [*self.states[first + 1 : last], self.states[last] if last < self.segments else np.full(lanes, LOW, np.uint64)]
        if not np.array_equal(x, np.array(ends).reshape(x.shape)):
            raise ValueError("a segment does not end in the state of the next one")
        ids = out.ravel()[: stop - start]
        if first == 0 and last == self.segments and zlib.crc32(ids.astype("<u4").tobytes()) != self.crc:
            raise ValueError("the ids do not match their checksum")
        return ids


def decode_block(payload: bytes, code: Code) -> np.ndarray:
    return Block(payload, code).ids()


def crc_joined(first: int, second: int, length: int) -> int:
    """The CRC-32 of two byte strings end to end, from their own and the length of the second (zeros are appended by squaring)."""

    def applied(matrix, vector):
        out = 0
        for row in matrix:
            if vector & 1:
                out ^= row
            vector >>= 1
        return out

    shift = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    for _ in range(3):
        shift = [applied(shift, row) for row in shift]  # one zero byte
    while length:
        if length & 1:
            first = applied(shift, first)
        shift = [applied(shift, row) for row in shift]
        length >>= 1
    return first ^ second


# ---- tokens ---------------------------------------------------------------

# Outside these characters Unicode composition or small letters may need the library.
ODD = regex.compile(r"[^\x21-\x7eÀ-įı-ſ‐-‧\n]")


class Kept:
    """Numbers strings in the order of their first use and keeps the ids of each, end to end."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.ids, self.starts, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, names: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        self.number.update(zip(names, range(len(self.number), len(self.number) + len(names)), strict=True))
        self.starts = np.r_[self.starts, len(self.ids) + np.cumsum(counts) - counts]
        self.ids, self.counts = np.r_[self.ids, ids], np.r_[self.counts, counts]

    def numbers(self, names: list[str], fresh) -> np.ndarray:
        """The number of each name; ``fresh`` gives (ids, counts) of the names met for the first time."""
        found = np.fromiter(map(self.number.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(found < 0)
        if len(new):
            unknown = list(dict.fromkeys(names[i] for i in new.tolist()))
            self.add(unknown, *fresh(unknown))
            found[new] = [self.number[names[i]] for i in new.tolist()]
        return found

    def gathered(self, number: np.ndarray) -> np.ndarray:
        return self.ids[segments(self.starts[number], self.counts[number])]


class Tokens:
    """Ids of whole texts as the tokenizers library gives them, with the ids of pieces between blanks kept.

    The tokenizer drops white space and joins nothing across it, so a text's ids are
    those of its pieces, end to end. Of pieces met for the first time those of common
    letters are cut into words here, which go to the library's model; any other piece
    goes to the library as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        file = json.loads(Path(path).read_text(encoding="utf-8"))
        kinds = [n["type"] for n in (file["normalizer"] or {}).get("normalizers", [])]
        steps = (file["pre_tokenizer"] or {}).get("pretokenizers", [])
        if kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"] or not steps[0]["invert"]:
            raise ValueError(f"{path}: only a tokenizer that drops white space between words is supported")
        self.special = [t["content"] for t in file["added_tokens"]]
        self.words = regex.compile(steps[0]["pattern"]["Regex"] + "|\n").findall
        self.letter = {b: c for c, b in byte_letters().items()}
        self.pieces, self.of_words = Kept(), Kept()

    def modelled(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of words; a line break, which stands between pieces, has none."""
        tokenize, out = self.tokenizer.model.tokenize, []
        for word in words:
            letters = word if word.isascii() else "".join(map(self.letter.__getitem__, word.encode()))
            out.append([] if word == "\n" else [t.id for t in tokenize(letters)])
        return np.array([i for ids in out for i in ids], np.uint32), np.fromiter(map(len, out), np.int64, len(out))

    def coded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of pieces."""
        joined = "\n".join(pieces)
        if ODD.search(joined) or any(s in joined for s in self.special):
            plain = [not ODD.search(p) and not any(s in p for s in self.special) for p in pieces]
            out = [None if ok else self.tokenizer.encode(p, add_special_tokens=False).ids for p, ok in zip(pieces, plain, strict=True)]
            ids, counts = self.coded_plain("\n".join(p for p, ok in zip(pieces, plain, strict=True) if ok))
            ends = np.cumsum(counts)
            own = iter(np.split(ids, ends[:-1]) if len(counts) else [])
            parts = [np.array(x, np.uint32) if x is not None else next(own) for x in out]
            return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return self.coded_plain(joined)

    def coded_plain(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of pieces of common letters, one a line."""
        words = self.words(joined.lower())
        number = self.of_words.numbers(words, self.modelled)
        last = np.flatnonzero(number == self.of_words.number.get("\n", -1))
        total = np.r_[0, np.cumsum(self.of_words.counts[number])]
        return self.of_words.gathered(number), np.diff(total[np.r_[0, last, len(number)]])

    def of(self, texts) -> list[np.ndarray]:
        """The ids of each text of an Arrow column or a list."""
        if len(self.pieces.number) > KEPT_PIECES:
            self.pieces, self.of_words = Kept(), Kept()
        column = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        column = pa.compute.fill_null(column, "")
        for blank in "\n\t\r":
            column = pa.compute.replace_substring(column, blank, " ")
        split = pa.compute.split_pattern(column, " ")
        sizes = pa.compute.list_value_length(split).to_numpy(zero_copy_only=False)
        pieces = split.flatten().dictionary_encode()
        number = self.pieces.numbers(pieces.dictionary.to_pylist(), self.coded)[pieces.indices.to_numpy()]
        ids = self.pieces.gathered(number)
        total = np.r_[0, np.cumsum(self.pieces.counts[number])]
        ends = total[np.cumsum(sizes)]
        return np.split(ids, ends[:-1]) if len(ends) else []


def squeezed(ids: np.ndarray, squeeze) -> bytes:
    """Ids as compressed bytes for the way: two bytes each where they fit, else four; the first byte says which."""
    narrow = not len(ids) or int(ids.max()) < 1 << 16
    return (b"2" if narrow else b"4") + squeeze(ids.astype("<u2" if narrow else "<u4").tobytes())


def expanded(data: bytes, expand) -> np.ndarray:
    return np.frombuffer(expand(data[1:]), "<u2" if data[:1] == b"2" else "<u4").astype(np.uint32)


# ---- writing --------------------------------------------------------------


def tokens(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, ids, n): each document's ids, compressed, with the end id."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encoded(batches):
        encoder, squeeze = None, zstandard.ZstdCompressor(level=1).compress
        end = np.array([end_id], np.uint32)
        for block in blocks(batches, "text", TEXT_BYTES):
            encoder = encoder or Tokens(path)
            ids = [np.r_[x, end] for x in encoder.of(block.column("text"))]
            data = pa.array([squeezed(x, squeeze) for x in ids], pa.binary())
            sizes = pa.array([len(x) for x in ids], pa.int64())
            yield from pa.table([block.column("doc_id"), data, sizes], ["doc_id", "ids", "n"]).combine_chunks().to_batches()

    return docs.mapInArrow(tidy(encoded), f"doc_id {kind}, ids binary, n long")


def counted(coded: DataFrame) -> DataFrame:
    """(id, n): how often each id occurs in all documents."""

    def count(batches):
        expand = zstandard.ZstdDecompressor().decompress
        total = np.zeros(0, np.int64)
        for block in blocks(batches, "ids", TEXT_BYTES):
            found = np.bincount(np.concatenate([expanded(data, expand) for data in block.column("ids").to_pylist()]), minlength=len(total))
            found[: len(total)] += total
            total = found
        present = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(present), pa.array(total[present])], ["id", "n"])

    return coded.select("ids").mapInArrow(tidy(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, path: str, folder: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the ids of all documents, each with the end id, to a new store."""
    spark = docs.sparkSession
    docs = picked(docs, doc_id=doc_id, text=text)
    coded = written(tokens(docs, path, end_id), "token-ids")
    counts = counted(coded).collect()  # a row for each id of the vocabulary, however many documents there are
    table = np.zeros(1 + max([0, *(r["id"] for r in counts)]), np.int64)
    for r in counts:
        table[r["id"]] = r["n"]
    code = Code(table)
    share = code.share.astype("<u4").tobytes()
    spark.createDataFrame([(code.bits, bytearray(share), code.crc)], "scale_bits int, frequencies binary, crc long").coalesce(1).write.parquet(f"{folder}/frequencies")

    number, kind = partitions(docs), docs.schema["doc_id"].dataType
    place = F.monotonically_increasing_id()  # of a stored table: the same at every attempt
    ordered = coded.withColumn("_place", place).repartitionByRange(number, F.col("doc_id").asc_nulls_first(), "_place").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_place")
    ready = shared(spark, (share, code.bits, code.crc))
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("block", T.IntegerType()),
            T.StructField("start", T.LongType()),  # inside its part
            T.StructField("n_ids", T.LongType()),
            T.StructField("docs", T.ArrayType(T.StructType([T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("n", T.LongType())]))),
            T.StructField("payload", T.BinaryType()),
        ]
    )
    arrow_kind = coded.limit(0).toArrow().schema.field("doc_id").type
    member = pa.struct([("doc_id", arrow_kind), ("start", pa.int64()), ("n", pa.int64())])

    def blocked(batches):
        from pyspark import TaskContext

        part, expand, own = TaskContext.get().partitionId(), zstandard.ZstdDecompressor().decompress, Code.stored(*ready())
        held, size, members, start, block = [], 0, [], 0, 0

        def done(ids):
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([block], pa.int32()),
                    pa.array([start], pa.int64()),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([members], pa.list_(member)),
                    pa.array([encode_block(ids, own)], pa.binary()),
                ],
                ["part", "block", "start", "n_ids", "docs", "payload"],
            )

        for batch in batches:
            for key, data, n in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), batch.column("n").to_pylist(), strict=True):
                ids, begin = expanded(data.as_py(), expand), start + size
                while len(ids):
                    # a document that goes on is named again, with its own start and length
                    members.append({"doc_id": key, "start": begin, "n": n})
                    take = ids[: BLOCK_IDS - size]
                    held.append(take)
                    size, ids = size + len(take), ids[len(take) :]
                    if size == BLOCK_IDS:
                        yield done(np.concatenate(held))
                        start, block = start + size, block + 1
                        held, size, members = [], 0, []
        if size:
            yield done(np.concatenate(held))

    ordered.select("doc_id", "ids", "n").mapInArrow(tidy(blocked), schema).write.parquet(f"{folder}/blocks")
    sizes = spark.read.schema(schema).parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    # one row for each range: bounded by their number, however many documents there are
    before = F.sum("n_ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    sizes.select("part", F.coalesce(before, F.lit(0)).alias("before")).coalesce(1).write.parquet(f"{folder}/parts")


# ---- reading --------------------------------------------------------------


def read(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, piece, length, ids, ids_crc32) of a store: the part of a document in each of its blocks.

    ``piece`` counts the document's ids before the row's; a document within one block
    is one row. ``start`` counts the ids of all documents before this one. Blocks are
    decoded on their own; without ``ids`` only the checksums leave the tasks.
    """
    row = spark.read.parquet(f"{folder}/frequencies").head()
    ready = shared(spark, (bytes(row["frequencies"]), row["scale_bits"], row["crc"]))
    stored = spark.read.parquet(f"{folder}/blocks")
    kind = stored.schema["docs"].dataType.elementType["doc_id"].dataType
    fields = [("doc_id", kind), ("part", T.IntegerType()), ("start", T.LongType()), ("n_tokens", T.LongType()), ("piece", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("ids_crc32", T.LongType())]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def decoded(batches):
        code = None
        for batch in batches:
            key_type = batch.schema.field("docs").type.value_type.field("doc_id").type
            for at in range(len(batch)):
                code = code or Code.stored(*ready())
                found = decode_block(batch.column("payload")[at].as_py(), code).astype("<u4")
                begin, rows = batch.column("start")[at].as_py(), batch.column("docs")[at].as_py()
                starts = np.array([r["start"] for r in rows], np.int64)
                totals = np.array([r["n"] for r in rows], np.int64)
                a, b = np.maximum(starts, begin), np.minimum(starts + totals, begin + len(found))
                parts = [found[x:y].tobytes() for x, y in zip((a - begin).tolist(), (b - begin).tolist(), strict=True)]
                columns = [
                    pa.array([r["doc_id"] for r in rows], key_type),
                    pa.array(np.full(len(rows), batch.column("part")[at].as_py(), np.int32)),
                    pa.array(starts),
                    pa.array(totals),
                    pa.array(a - starts),
                    pa.array(b - a),
                    pa.array(parts if ids else [None] * len(rows), pa.binary()),
                    pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [f[0] for f in fields])

    rows = stored.select("part", "start", "docs", "payload").mapInArrow(tidy(decoded), schema)
    parts = spark.read.parquet(f"{folder}/parts")
    return rows.join(broadcast_if_small(parts), "part").withColumn("start", F.col("start") + F.col("before")).drop("part", "before")


def directory(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): one row for each document of a store, from its decoded blocks."""
    rows = written(read(spark, folder, ids=False).drop("ids"), "decoded-documents")  # small, and read twice
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    whole = rows.where("length = n_tokens").select(names)

    def joined(table: pa.Table) -> pa.Table:
        table = table.sort_by("piece")
        crc = 0
        for own, length in zip(table.column("ids_crc32").to_pylist(), table.column("length").to_pylist(), strict=True):
            crc = crc_joined(crc, own, 4 * length)
        first = table.slice(0, 1).select(names)
        return first.set_column(3, "ids_crc32", pa.array([crc], pa.int64()))

    # only documents that lie across a block's end: a few rows for each, of a document's own length / BLOCK_IDS
    cut = rows.where("length < n_tokens").groupBy("start").applyInArrow(joined, whole.schema)
    return whole.unionByName(cut)


def stored_directory(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write a store below the shared folder and read back what it holds of each document."""
    folder = scratch_path(docs.sparkSession, "token-store")
    write(docs, path, folder, **options)
    return directory(docs.sparkSession, folder)
