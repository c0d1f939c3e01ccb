"""Byte-level BPE encoding and decoding over a pair occurrence index.

The distinct words of a block of texts lie end to end in one symbol array. An
index maps every pair that has a merge rank to all its positions. Active ranks
are applied in ascending order, each to all its positions at once, and only the
lists of the pairs beside a merge are updated. Words do not touch each other, so
working rank by rank over all words gives for each word what working on it alone
gives, also where a merge makes a pair of a lower rank.

Cases: a null text is an empty text; an empty text has no ids. Ids that the
vocabulary lacks make decoding fail, as they are not the tokenizer's output.
"""

from __future__ import annotations

import heapq
import json
from itertools import chain, islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from affinara.llm.common import blocks, segments, small_batches, texts_of, tidy

BLOCK_BYTES = 4 << 20
KEPT_WORDS = 400_000
DECODED_IDS = 1 << 20  # at a time


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges, token bytes and special tokens of a byte-level tokenizer file."""

    def __init__(self, path: str):
        file = json.loads(Path(path).read_text(encoding="utf-8"))
        model, split = file["model"], file["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or file["normalizer"]:
            raise ValueError(f"{path}: only byte-level BPE without normalizer and prefix space is supported")
        letters, ids = byte_letters(), model["vocab"]
        size = 1 + max(max(ids.values()), *(t["id"] for t in file["added_tokens"]), 0)
        self.tokens = [b""] * size
        for token, i in ids.items():
            self.tokens[i] = bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        for content, i in self.special.items():
            self.tokens[i] = content.encode()
        self.of_byte = np.array([ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in merges], np.int64)
        self.right = np.array([ids[b] for _, b in merges], np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)
        self.size = size
        keys = self.left * size + self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, -1 where it has none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1) if len(self.keys) else np.full(len(key), -1)


def encode_words(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words end to end, and the number of ids of each word."""
    sizes = np.array([len(w) for w in words], np.int64)
    symbol = v.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    n = len(symbol)
    following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    ends = np.cumsum(sizes)
    following[ends[sizes > 0] - 1] = -1
    before[(ends - sizes)[sizes > 0]] = -1
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def listed(position: np.ndarray) -> None:
        """Put pairs that begin at these positions on their lists."""
        rank = v.ranks(symbol[position], symbol[following[position]])
        known = rank >= 0
        rank, position = rank[known], position[known]
        if not len(rank):
            return
        order = np.argsort(rank, kind="stable")
        rank, position = rank[order], position[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for r, part in zip(rank[np.r_[0, cuts]].tolist(), np.split(position, cuts), strict=True):
            if r in index:
                index[r].append(part)
            else:
                index[r] = [part]
                heapq.heappush(active, r)

    listed(np.flatnonzero(following >= 0))
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        a, b = v.left[r], v.right[r]
        at = at[symbol[at] == a]
        after = following[at]
        good = after >= 0
        good[good] = symbol[after[good]] == b
        at, after = at[good], after[good]
        if not len(at):
            continue
        if a == b and len(at) > 1:
            # in a run of one symbol every second pair overlaps the one before it
            run = np.r_[True, after[:-1] != at[1:]]
            start = np.flatnonzero(run)
            place = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)]))
            at, after = at[place % 2 == 0], after[place % 2 == 0]
        beyond = following[after]
        symbol[at] = v.made[r]
        symbol[after] = -1
        following[at] = beyond
        more = beyond >= 0
        before[beyond[more]] = at[more]
        ahead = before[at]
        listed(np.concatenate([ahead[ahead >= 0], at[more]]))
    live = symbol >= 0
    counts = np.zeros(len(words), np.int64)
    np.add.at(counts, np.repeat(np.arange(len(words)), sizes)[live], 1)
    return symbol[live].astype(np.int32), counts


class Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class Encoder:
    """Encodes blocks of texts and keeps the ids of words met before (at most ``KEPT_WORDS`` and one block's)."""

    def __init__(self, path: str):
        from public_tokenizers import PATTERN

        self.v = Vocabulary(path)
        self.words = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.v.special, key=len, reverse=True))) + ")").split if self.v.special else None
        self.clear()

    def clear(self) -> None:
        self.known = Numbers((word, i) for i, word in enumerate(self.v.special))
        self.ids = np.array(list(self.v.special.values()), np.int32)
        self.starts, self.counts = np.arange(len(self.known)), np.ones(len(self.known), np.int64)

    def split(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.v.special):
            return self.words(text)
        return list(chain.from_iterable([part] if part in self.v.special else self.words(part) for part in self.cut(text)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of ids of each text."""
        if len(self.known) > KEPT_WORDS:
            self.clear()
        known, first = self.known, len(self.known)
        number, sizes = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            words = self.split(text)
            sizes[i] = len(words)
            number.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
        if len(known) > first:
            new = [w.encode() for w in islice(known, first, None)]
            ids, counts = encode_words(new, self.v)
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        code = np.concatenate(number) if number else np.zeros(0, np.int32)
        count = self.counts[code]
        ends = np.r_[0, np.cumsum(count)][np.r_[0, np.cumsum(sizes)]]
        return self.ids[segments(self.starts[code], count)], np.diff(ends)


def list_column(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the token ids of a text column. One pass over the rows, no shuffle."""
    small_batches(df.sparkSession)
    df = df.drop(ids)
    schema = _with(df, ids, T.ArrayType(T.IntegerType(), False))

    def encoded(batches):
        encoder = None
        for block in blocks(batches, text, BLOCK_BYTES):
            encoder = encoder or Encoder(path)
            out = block.append_column(ids, list_column(*encoder.encode(texts_of(block.column(text)))))
            yield from out.combine_chunks().to_batches()

    return df.mapInArrow(tidy(encoded), schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of a column of token ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
    small_batches(df.sparkSession)
    df = df.drop(text)
    schema = _with(df, text, T.StringType())

    def decoded(batches):
        data = None
        for batch in batches:
            if data is None:
                tokens = Vocabulary(path).tokens
                size = np.array([len(t) for t in tokens], np.int64)
                start, data = np.cumsum(size) - size, np.frombuffer(b"".join(tokens), np.uint8)
            column = batch.column(ids)
            counts = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = column.flatten().to_numpy()
            ends, out, row = np.cumsum(counts), [], 0
            while row < len(counts):
                begin = int(ends[row] - counts[row])
                stop = max(row + 1, int(np.searchsorted(ends, begin + DECODED_IDS, side="right")))
                part = flat[begin : ends[stop - 1]]
                raw = data[segments(start[part], size[part])].tobytes()
                cuts = np.r_[0, np.cumsum(size[part])][np.r_[0, ends[row:stop] - begin]].tolist()
                out += [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]
                row = stop
            yield batch.append_column(text, pa.array(out, pa.string()))

    return df.mapInArrow(tidy(decoded), schema)
