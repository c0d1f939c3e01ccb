"""Packing of tokenized documents into fixed windows by minimum bin slack.

Every task packs the documents it reads, a block of bounded size at a time, so
nothing is shuffled. A document's full windows stand alone; its rest goes into a
multiset of remaining lengths. Each window takes the longest rest and then the
multiset of other rests that fills it closest to capacity: a subset-sum dynamic
program over a bitset (an integer whose bit s says that s tokens can be
gathered), from which the count of each length is tracked back. Slack that no
multiset fills is filled by cutting the shortest rest. A block's last tokens
become windows at powers of two, which need no padding.

Cases: a null text is an empty text and yields its end id alone. Ids in the
result are little-endian unsigned 32-bit numbers. Repeated rows and repeated
document ids are packed each on their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from affinara.llm.bpe import Encoder, Vocabulary
from affinara.llm.common import blocks, picked, small_batches, texts_of, tidy

WINDOW = 2048
BLOCK_BYTES = 3 << 20
MOST_SEQUENCES = 1 << 33  # in a task; the bits above hold the task's number
PIECES = "doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def closest_fill(capacity: int, counts: list[int]) -> list[tuple[int, int]]:
    """The multiset of lengths, as (length, count), whose sum is closest to the capacity without going beyond."""
    reach, limit, before = 1, (1 << (capacity + 1)) - 1, []
    for length in range(min(capacity, len(counts) - 1), 0, -1):
        if not counts[length]:
            continue
        before.append((length, reach))
        step = reach
        for _ in range(min(counts[length], capacity // length)):
            step = (step << length) & limit
            if not step or step | reach == reach:
                break
            reach |= step
        if reach >> capacity:
            break
    left, taken = reach.bit_length() - 1, []
    for length, earlier in reversed(before):
        count = 0
        while not earlier >> left & 1:
            left -= length
            count += 1
        if count:
            taken.append((length, count))
    return taken


def windows(lengths, window: int = WINDOW):
    """Pack documents of these lengths: (document, start, length, sequence, offset) for each piece."""
    pieces, sequence = [], 0
    rests: list[list[tuple[int, int]]] = [[] for _ in range(window)]
    for doc, total in enumerate(lengths):
        for start in range(0, total - window + 1, window):
            pieces.append((doc, start, window, sequence, 0))
            sequence += 1
        if total % window:
            rests[total % window].append((doc, total - total % window))
    counts = [len(r) for r in rests]
    longest = window - 1
    while True:
        while longest and not counts[longest]:
            longest -= 1
        if not longest:
            return pieces
        counts[longest] -= 1
        filling = [(longest, 1)]
        fill = closest_fill(window - longest, counts)
        for length, count in fill:
            counts[length] -= count
        filling += fill
        slack = window - sum(length * count for length, count in filling)
        members = [(length, *rests[length].pop()) for length, count in filling for _ in range(count)]
        if slack:
            shortest = next((n for n in range(slack + 1, longest + 1) if counts[n]), 0)
            if shortest:
                counts[shortest] -= 1
                doc, start = rests[shortest].pop()
                members.append((slack, doc, start))
                rests[shortest - slack].append((doc, start + slack))
                counts[shortest - slack] += 1
                slack = 0
        if not slack:
            offset = 0
            for length, doc, start in members:
                pieces.append((doc, start, length, sequence, offset))
                offset += length
            sequence += 1
            continue
        # nothing is left to fill the last window: cut it at powers of two
        total = sum(m[0] for m in members)
        room = 1 << (total.bit_length() - 1)
        offset = 0
        for length, doc, start in members:
            while length:
                part = min(length, room - offset)
                pieces.append((doc, start, part, sequence, offset))
                length, start, offset = length - part, start + part, offset + part
                if offset == room:
                    total -= room
                    sequence, offset = sequence + 1, 0
                    room = 1 << (total.bit_length() - 1) if total else 0


class Tokens:
    """Ids of whole texts. Where ids follow merge ranks tiktoken gives the same ids faster; else the pair index does."""

    def __init__(self, path: str):
        v = Vocabulary(path)
        self.path, self.fast, self.slow = path, None, None
        if np.all(np.diff(v.made) > 0):
            import tiktoken
            from public_tokenizers import PATTERN

            ranks = {token: i for i, token in enumerate(v.tokens) if token and token.decode("utf-8", "replace") not in v.special}
            self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=v.special)

    def of(self, text: str) -> np.ndarray:
        if self.fast is not None and len(text) < 1 << 18:  # its pattern engine overflows on very long white space
            return self.fast.encode_to_numpy(text, allowed_special="all")
        self.slow = self.slow or Encoder(self.path)
        return self.slow.encode([text])[0]


def pack(df: DataFrame, path: str, end_id: int = 1, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece of a document in a sequence of at most ``window`` tokens."""
    small_batches(df.sparkSession)
    df = picked(df, doc_id=doc_id, text=text)
    schema = PIECES.format(kind=df.schema["doc_id"].dataType.simpleString())
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    def packed(batches):
        tokens, sequence = None, TaskContext.get().partitionId() * MOST_SEQUENCES
        end = np.array([end_id], np.uint32)
        for block in blocks(batches, "text", BLOCK_BYTES):
            tokens = tokens or Tokens(path)
            ids = [np.append(tokens.of(t).astype("<u4"), end) for t in texts_of(block.column("text"))]
            rows = windows([len(x) for x in ids], window)
            doc, start, length, place, offset = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            part = [ids[d][s : s + n].tobytes() for d, s, n, _, _ in rows]
            total = np.array([len(x) for x in ids], np.int64)
            keys, at = block.column("doc_id"), pa.array(doc)
            for i in range(0, len(rows), 1024):
                cut = slice(i, i + 1024)
                columns = [pa.array(x[cut]) for x in (start, length, total[doc], sequence + place, offset)]
                named = pa.table([keys.take(at[cut]), *columns, pa.array(part[cut], pa.binary())], names)
                yield from named.combine_chunks().to_batches()
            sequence += int(place.max()) + 1

    return df.mapInArrow(tidy(packed), schema)
