"""Ranked lexical search against a plain scoring of every document."""

import random
import re
from collections import Counter, defaultdict
from math import floor, log

import numpy as np
import pytest

from affinara.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(SMALL))


def plain(docs, items, k):
    """Scores of all documents, kept and cut at the end."""
    own = [(doc, Counter(terms(text))) for doc, text in docs]
    n, total = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked = defaultdict(Counter)
    for item, text in items:
        asked[item].update(terms(text))
    out = {}
    for item, wanted in asked.items():
        scores = []
        for doc, c in own:
            m = 100 - 75 + (75 * sum(c.values()) * n) // total if total else 0
            score = sum(times * floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in wanted.items() if c[t])
            if score > 0:
                scores.append((score, doc))
        scores.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        if scores:
            out[item] = [(i + 1, doc, score) for i, (score, doc) in enumerate(scores[:k])]
    return out


def found(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        out[r["item_id"]].append((r["rank"], r["doc_id"], r["score"]))
    return dict(out)


WORDS = ["a", "B", "the", "The", "naïve", "日本", "x1", "É", "é", "zz", "q r", "🙂k", "rare"]


def random_text(r, most):
    return r.choice(["", " ", "-"]).join(r.choice(WORDS) + r.choice([" ", ", ", "\x00", "_", "\n"]) for _ in range(r.randint(0, most)))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    docs = [(i, random_text(r, 40)) for i in range(400)]
    docs += [(7, "rare rare a"), (7, "rare rare a"), (None, "rare"), (None, "rare"), (900, None), (901, ""), (902, "the " * 30_000)]
    docs += [(1000 + i, "zz rare the") for i in range(60)]  # ties
    items = [(i, random_text(r, 12)) for i in range(25)] + [(100, None), (101, "..."), (102, "absent"), (103, "rare rare"), (103, "zz"), (None, "the a")]
    return docs, items


@pytest.mark.parametrize("vocabulary_rows", [500_000, 1])
@pytest.mark.parametrize("block", [300, 1 << 20])
def test_same_rows_as_plain_scoring(spark, texts, monkeypatch, vocabulary_rows, block):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    monkeypatch.setattr(lexical, "FIRST_DEPTH", 2)
    monkeypatch.setattr(lexical, "CHUNK_TERMS", 40)
    docs, items = texts
    d = spark.createDataFrame([(*row, 1) for row in docs], "doc_id long, text string, score int").repartition(3)
    q = spark.createDataFrame([(*row, 1) for row in items], "item_id long, text string, rank int")
    assert found(lexical.search(d, q, k=5, vocabulary_rows=vocabulary_rows).collect()) == plain(docs, items, 5)


@pytest.mark.parametrize("seed", range(20))
def test_intervals_end_at_the_exact_best(seed):
    r = np.random.default_rng(seed)
    n, k = int(r.integers(1, 300)), int(r.integers(1, 12))
    total, lists = np.zeros(n, np.int64), []
    for _ in range(int(r.integers(1, 9))):
        slots = np.flatnonzero(r.random(n) < r.random())
        gains = -np.sort(-r.integers(1, r.choice([3, 1000]), len(slots)))
        slots = r.permutation(slots)
        total[slots] += gains
        lists.append((slots, gains))
    lowest = int(r.integers(0, 800))
    expected = [(s, total[s]) for s in np.lexsort((np.arange(n), -total)) if total[s] >= max(1, lowest)][:k]
    slots, scores = lexical.nra(lists, n, k, lowest)
    assert list(zip(slots, scores, strict=True)) == expected


def test_reading_stops_before_the_ends_of_long_lists():
    """One clear winner in every list: far fewer entries than the lists hold settle it."""

    class Counted(np.ndarray):
        read = 0

        def __getitem__(self, key):
            out = super().__getitem__(key)
            if isinstance(key, slice):
                Counted.read += len(out)
            return out

    gains = np.r_[10**6, np.full(50_000, 1)]
    lists = [(np.r_[0, np.arange(1, 50_001)].view(Counted), gains) for _ in range(4)]
    slots, scores = lexical.nra(lists, 50_001, 1, 0)
    assert slots.tolist() == [0] and scores.tolist() == [4 * 10**6]
    assert Counted.read == 4 * lexical.FIRST_DEPTH


def test_empty_tables(spark):
    d, q = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id string, text string")
    assert lexical.search(d, q).collect() == []
    some = spark.createDataFrame([("x", "a b")], "item_id string, text string")
    assert lexical.search(d, some).collect() == []
    rows = lexical.search(spark.createDataFrame([("d1", "a"), ("d0", "a"), ("d2", "c c")], "doc_id string, text string"), some).collect()
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in rows] == [("x", 1, "d0"), ("x", 2, "d1")]
