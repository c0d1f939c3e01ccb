"""rANS blocks: exact round trips, checks, ids equal to the tokenizers library's."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinara.llm import queries, token_store
from affinara.shipping import scratch_path

PATH = queries.tokenizer_path("word_bpe_49k.json")
PARTS = ["a", "The", "it's", "'S", " ", "\n", "\t", "\r\n", "é", "É", "ß", "İ", "ſ", "日本", "\x1c", "\x85", "\xa0", "1", "²", "_", "!", "!'s", "<|endoftext|>", "<|startof", "🙂", "\x00", "Σς", "é", " ́x", "‐", "--'ll", "ǅ"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def odd_texts(n=600, seed=5):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(n)] + ["", "ab" * 3_000, " " * 3000, "x y " * 9000]


def test_ids_equal_the_tokenizers_library(tokenizer, monkeypatch):
    for kept in (token_store.KEPT_PIECES, 5):
        monkeypatch.setattr(token_store, "KEPT_PIECES", kept)
        own, texts = token_store.Tokens(PATH), odd_texts()
        for i in range(0, len(texts), 50):
            for text, ids in zip(texts[i : i + 50], own.of(texts[i : i + 50]), strict=True):
                assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("n", [0, 1, 5, 63, 64, 65, 640, 5000, 20_001])
@pytest.mark.parametrize("kinds", [1, 2, 300, 70_000])
def test_blocks_round_trip(n, kinds):
    r = np.random.default_rng(n + kinds)
    ids = np.minimum(r.zipf(1.3, n), kinds).astype(np.int64) - 1 if n else np.zeros(0, np.int64)
    code = token_store.Code(np.bincount(ids, minlength=kinds) + (r.random(kinds) < 0.3))
    assert int(code.share.sum()) in (0, 1 << code.bits)
    for lanes, every in ((64, 8), (1, 3), (1000, 1)):
        payload = token_store.encode_block(ids, code, lanes, every)
        block = token_store.Block(payload, code)
        assert np.array_equal(block.ids(), ids)
        span = lanes * every
        for s in {0, block.segments // 2, block.segments - 1} & set(range(block.segments)):  # one segment alone
            assert np.array_equal(block.ids(s, s + 1), ids[s * span : (s + 1) * span])


def test_blocks_are_near_the_entropy():
    r = np.random.default_rng(1)
    ids = np.minimum(r.zipf(1.2, 1 << 19), 40_000) - 1
    counts = np.bincount(ids)
    share = counts[counts > 0] / len(ids)
    least = -(share * np.log2(share)).sum() * len(ids) / 8
    assert len(token_store.encode_block(ids, token_store.Code(counts))) < 1.06 * least


def test_damage_is_found():
    ids = np.random.default_rng(2).integers(0, 50, 4000)
    code = token_store.Code(np.bincount(ids))
    payload = token_store.encode_block(ids, code, 16, 32)
    for at in range(4, len(payload), 97):
        broken = payload[:at] + bytes([payload[at] ^ 1]) + payload[at + 1 :]
        try:
            assert not np.array_equal(token_store.decode_block(broken, code), ids)
        except (ValueError, IndexError, OverflowError):
            continue
        pytest.fail("a changed byte went unseen")
    with pytest.raises(ValueError, match="frequencies"):
        token_store.decode_block(payload, token_store.Code(np.bincount(ids) + 1 * (np.arange(50) == 3) * 999))
    with pytest.raises(ValueError, match="frequency"):
        token_store.encode_block(np.array([60]), token_store.Code(np.r_[np.bincount(ids), np.zeros(20, int)]))


def test_checksums_are_joined():
    a, b = b"some bytes", bytes(range(256)) * 33
    assert token_store.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert token_store.crc_joined(zlib.crc32(a), 0, 0) == zlib.crc32(a)


def expected(texts, ids, tokenizer):
    """Per document (start, number, checksum) in ascending order, null first; equal ids in the order of the rows."""
    out, start = [], 0
    for i in sorted(range(len(texts)), key=lambda i: (ids[i] is not None, ids[i] or 0, i)):
        own = np.array([*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((ids[i], start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    return out


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_store_holds_every_document_in_order(spark, tokenizer, monkeypatch, block):
    monkeypatch.setattr(token_store, "BLOCK_IDS", block)
    texts = [*odd_texts(150), None, "same", "same", "the end " * 500]
    ids = [(i * 7919) % 1000 + 5 for i in range(len(texts))]
    ids[3], ids[-2] = None, ids[-3]
    df = spark.createDataFrame([(i, t, 7) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, start int").repartition(3)
    rows = token_store.stored_directory(df, PATH).collect()
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows), key=lambda r: r[1])
    assert got == expected(texts, ids, tokenizer)


def test_pieces_of_a_store_give_the_ids_back(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_IDS", 64)
    df = spark.createDataFrame([(str(i), "word " * i) for i in range(0, 200, 9)], "doc_id string, text string")
    folder = scratch_path(spark, "store")
    token_store.write(df, PATH, folder)
    held = {}
    for r in token_store.read(spark, folder).orderBy("doc_id", "piece").collect():
        held[r["doc_id"]] = held.get(r["doc_id"], b"") + bytes(r["ids"])
    for i in range(0, 200, 9):
        assert np.frombuffer(held[str(i)], "<u4").tolist() == [*tokenizer.encode("word " * i, add_special_tokens=False).ids, 1]
    assert spark.read.parquet(f"{folder}/blocks").agg(F.max("n_ids")).head()[0] == 64


def test_empty_table(spark):
    assert token_store.stored_directory(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
