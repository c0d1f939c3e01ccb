"""Near duplicates, repeated strings, exact top-k, neighbour graph and the pipeline, against brute force."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from affinara.llm import near_dedup, nn_descent, queries, suffix_dedup, top_k
from affinara.llm.common import table


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_classes(docs, threshold=0.8):
    """Least id of every document's class under plain Jaccard similarity."""
    parent = {d: d for d in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets, holders = {d: shingles(t) for d, t in docs.items()}, collections.defaultdict(list)
    for d in sorted(docs):
        common = collections.Counter(e for s in sets[d] for e in holders[s])
        for e, n in common.items():
            if n / (len(sets[d]) + len(sets[e]) - n) >= threshold:
                a, b = sorted((find(d), find(e)))
                parent[b] = a
        for s in sets[d]:
            holders[s].append(d)
    return {d: find(d) for d in docs}


def words(r, n, low=0, high=100_000):
    return [f"w{r.randint(low, high)}" for _ in range(n)]


def edited(r, text, edits):
    text = list(text)
    for _ in range(edits):
        text[r.randrange(len(text))] = f"e{r.randint(0, 10**9)}"
    return text


def near_fixture():
    r = random.Random(4)
    texts, base = [], words(r, 400)
    texts += [" ".join(edited(r, base, 2)) for _ in range(60)]  # a large group of edited copies
    for _ in range(20):
        own = words(r, 150)
        texts += [" ".join(own), " ".join(edited(r, own, 1)), " ".join(own).upper()]
    passage = words(r, 40)
    texts += [" ".join(words(r, 80) + passage) for _ in range(60)]  # a passage in common is no copy
    texts += ["", None, "  ", "one two", "one  two", "three", "x " * 30_000]
    return texts


def test_near_classes_equal_brute_force(spark):
    texts = near_fixture()
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    rows = [(i, texts[i], "k", 1) for i in order] + [(5, texts[5], "k", 1), (None, texts[5], "k", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string, band int")
    got = near_dedup.classes(df).collect()
    assert len(got) == len(rows)
    expected = plain_classes(dict(enumerate(texts)))
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == expected
    assert [r["class_id"] for r in got if r["doc_id"] is None] == [None]
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(set(expected.values()))


def test_near_classes_of_all_documents(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["class_id"] for r in queries.op6_near_dedup(spark, sf_dir).collect()}
    assert got == plain_classes(docs)


def test_near_classes_of_an_empty_table(spark):
    assert near_dedup.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shares_of_equal_samples_follow_weighted_similarity():
    import pyarrow as pa

    r = random.Random(2)
    base = words(r, 300)
    texts = pa.array([" ".join(base), " ".join(edited(r, base, 6)), " ".join(base[:200] + words(r, 100))])
    weights = near_dedup.Weights(1000, np.zeros(0, np.int64), np.zeros(0))
    sampler = near_dedup.Sampler(weights)
    sampler.odd = np.random.default_rng(1).integers(0, 1 << 63, 1500, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    samples = sampler.samples(near_dedup.Shingles(texts))
    for other in (1, 2):
        true = near_dedup.similarity(texts.slice(0, 1), texts.slice(other, 1), weights)[0]
        assert abs((samples[0] == samples[other]).mean() - true) < 0.05


@pytest.mark.parametrize("times", [2, 3])
def test_shares_of_equal_samples_hold_for_shingles_repeated_in_one_text(times):
    import pyarrow as pa

    base = words(random.Random(6), 304)  # 300 shingles
    passage = base[:64]  # 60 of them once more a time
    texts = pa.array([" ".join(base), " ".join(base + passage * (times - 1))])
    weights = near_dedup.Weights(1000, np.zeros(0, np.int64), np.zeros(0))
    sampler = near_dedup.Sampler(weights)
    sampler.odd = np.random.default_rng(1).integers(0, 1 << 63, 1500, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    samples = sampler.samples(near_dedup.Shingles(texts))
    true = near_dedup.similarity(texts.slice(0, 1), texts.slice(1, 1), weights)[0]
    assert abs((samples[0] == samples[1]).mean() - true) < 0.05


def removed(docs, length=50):
    """Byte mask of every document by comparing all strings."""
    seen, out = {}, {}
    for d in sorted(docs):
        text = docs[d]
        mask = bytearray(len(text))
        for p in range(len(text) - length + 1):
            if seen.get(text[p : p + length], d) < d:
                mask[p : p + length] = b"\1" * length
        for p in range(len(text) - length + 1):
            seen.setdefault(text[p : p + length], d)
        out[d] = bytes(mask)
    return out


def suffix_fixture():
    r = random.Random(8)
    line = lambda n: "".join(r.choice("ab é€") for _ in range(n))
    shared = [line(n) for n in (30, 49, 50, 51, 60, 75, 120, 400)]
    texts = []
    for _ in range(80):
        texts.append("".join(r.choice([line(r.randint(0, 70)), r.choice(shared)]) for _ in range(r.randint(0, 6))))
    return [*texts, None, "", "z" * 500, "z" * 300, texts[3], texts[3], shared[-1], shared[-1][1:], "q" * 49, "q" * 49]


@pytest.mark.parametrize("chunk_rows", [5, 1000])
def test_repeats_equal_brute_force(spark, chunk_rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRIP", 300)
    monkeypatch.setattr(suffix_dedup, "BATCH", 20)
    texts = suffix_fixture()
    order = list(range(len(texts)))
    random.Random(3).shuffle(order)
    df = spark.createDataFrame([(i, texts[i], "k") for i in order], "doc_id long, text string, kept string")
    masks = removed({i: (t or "").encode() for i, t in enumerate(texts)})
    rows = suffix_dedup.remove_repeats(df, chunk_rows=chunk_rows).toDF("doc_id", "text", "extra", "n_bytes", "spans", "kept").collect()
    assert len(rows) == len(texts)
    for row in rows:
        raw, mask = (row["text"] or "").encode(), masks[row["doc_id"]]
        assert row["text"] == texts[row["doc_id"]] and row["extra"] == "k"
        assert bytes(row["kept"]) == bytes(b for b, m in zip(raw, mask) if not m)
        got = bytearray(len(raw))
        for a, b in row["spans"]:
            got[a:b] = b"\1" * (b - a)
        assert bytes(got) == mask and row["n_bytes"] == len(raw)


def test_repeats_and_ids(spark):
    text = "0123456789" * 7
    rows = [(2, text), (2, text), (None, text), (5, "x" + text)]
    got = {}
    for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id int, text string")).collect():
        got.setdefault(r["doc_id"], []).append(bytes(r["kept"]).decode())
    assert got == {2: [text, text], None: [text], 5: ["x"]}
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cut_texts_drop_broken_characters(spark):
    text = "é" * 40
    rows = [(1, text), (2, "a" + text + "b"), (3, None), (4, text[:30])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.cut_texts(df).collect()}
    assert got == {1: text, 2: "ab", 3: None, 4: ""}


def test_repeats_with_many_equal_rows_and_one_common_beginning(spark, monkeypatch):
    """A third of the rows without an id, a third equal in all, a third that begin alike; chunks bounded in bytes too."""
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "BATCH", 10)
    start = "a common beginning of sixteen bytes and much more, "
    rows = [(None, "n" * 60)] * 60 + [(7, "same text " * 8)] * 60
    rows += [(100 + i, start + f"{i} " * (5 + i % 40) + "e" * 70 + "long " * (3000 * (i == 9))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    masks = removed({i: t.encode() for i, t in rows if i is not None})
    found = suffix_dedup.remove_repeats(df).collect()
    assert len(found) == len(rows)
    for row in found:
        mask = masks.get(row["doc_id"], bytes(len(row["text"])))
        assert bytes(row["kept"]) == bytes(b for b, m in zip(row["text"].encode(), mask) if not m)
    texts = sorted((str(r["doc_id"]), r["text"]) for r in suffix_dedup.cut_texts(df).collect())
    assert texts == sorted((str(r["doc_id"]), bytes(r["kept"]).decode()) for r in found)


def test_multikey_order_sorts_rows():
    r = np.random.default_rng(0)
    letters = r.integers(0, 3, (500, 4)).astype(np.uint64)
    order, run = suffix_dedup.multikey_order(letters)
    expected = sorted(map(tuple, letters.tolist()))
    assert [tuple(x) for x in letters[order].tolist()] == expected
    assert run.max() + 1 == len(set(expected))


def vectors(seed=0, n=240, d=12):
    r = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in enumerate(r.normal(size=(n, d)))]
    rows += [(1000 + i, rows[7][1]) for i in range(30)]  # one very common vector
    rows += [(2000, None), (2001, [None] * d), (2002, [float("nan")] * d), (2003, [float("inf")] * d), (2004, [0.0] * d), (2005, [1.0] * (d - 3))]
    return rows


def padded(row, d=12):
    v = row[1]
    if v is None or any(x is None or not np.isfinite(x) for x in v):
        return None
    return np.array(list(v) + [0.0] * (d - len(v)))


@pytest.mark.parametrize(("lists", "stripe"), [(1, 10_000), (4, 50)])
def test_top_k_equals_brute_force(spark, lists, stripe):
    rows = vectors()
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, id string")
    whole = top_k.whole_numbers(df)
    got = top_k.search(whole, whole.where("id % 20 = 0"), 5, lists=lists, stripe_rows=stripe, query_rows=7).collect()
    known = {i: np.floor(256 * v).astype(int) for i, v in ((r[0], padded(r)) for r in rows) if v is not None}
    expected = set()
    for q in (i for i in known if i % 20 == 0):
        best = sorted((-int(known[q] @ v), i) for i, v in known.items() if i != q)[:5]
        expected |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == expected and len(got) == len(expected)


def test_top_k_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 1.0]), (2, [0.5, 0.0])], "vec_id long, embedding array<float>")
    whole = top_k.whole_numbers(df)
    assert [(r["rank"], r["vec_id"]) for r in top_k.search(whole, whole.where("id = 0"), 5).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert top_k.search(whole.where("false"), whole.where("false"), 5).count() == 0


def neighbours(rows, k, every):
    known = {r[0]: padded(r) for r in rows}
    known = {i: v for i, v in known.items() if v is not None and v.any()}
    out = {}
    for q in (i for i in known if i % every == 0):
        best = sorted((-float(known[q] @ v), i) for i, v in known.items() if i != q)[:k]
        out[q] = [i for _, i in best]
    return out


def test_neighbour_search_cases(spark):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, node int")
    got = collections.defaultdict(list)
    for r in sorted(nn_descent.search(df, F.col("vec_id") % 20 == 0, k=20).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append(r["vec_id"])
    expected = neighbours(rows, 20, 20)
    assert got.keys() == expected.keys()
    assert np.mean([len(set(got[q]) & set(e)) / len(e) for q, e in expected.items()]) > 0.99
    assert nn_descent.search(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("options", [{}, {"trees": 3, "cell_rows": 40}])
def test_neighbour_search_recall_through_the_graph(spark, options):
    """Production defaults, and few cells far smaller than the table: then the joins and the search have to find most."""
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(3).normal(size=(2500, 12)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = nn_descent.search(df, F.col("vec_id") % 20 == 0, k=20, **options).collect()
    got = collections.defaultdict(set)
    for r in found:
        got[r["query_id"]].add(r["vec_id"])
    expected = neighbours(rows, 20, 20)
    assert np.mean([len(got[q] & set(e)) / 20 for q, e in expected.items()]) >= 0.9


@pytest.mark.parametrize("options", [{}, {"trees": 1, "cell_rows": 1}])
def test_neighbours_of_one_vector_in_a_third_of_the_rows(spark, options):
    """All its rows get an answer; where no cell gives a neighbour to any node, lists are full all the same."""
    r = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 0.0] if i % 3 == 0 else [float(x) for x in r.normal(size=3)]) for i in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = nn_descent.search(df, F.col("vec_id") % 2 == 0, k=20, **options).collect()
    got = collections.defaultdict(list)
    for row in sorted(found, key=lambda r: r["rank"]):
        got[row["query_id"]].append(row["vec_id"])
    assert sorted(got) == list(range(0, 240, 2)) and all(len(x) == 20 for x in got.values())
    expected = neighbours(rows, 2, 20)
    assert options or np.mean([len(set(got[q]) & set(e)) / 20 for q, e in expected.items()]) >= 0.9


def test_neighbours_and_top_k_of_the_table(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf_dir, "embeddings").collect()]
    d = len(rows[0][1])
    expected = {}
    known = {i: np.array(v, float) for i, v in rows}
    for q in (i for i in known if i % 20 == 0):
        expected[q] = {i for _, i in sorted((-float(known[q] @ v), i) for i, v in known.items() if i != q)[:20]}
    got = collections.defaultdict(set)
    for r in queries.op3_nn_descent(spark, sf_dir).collect():
        got[r["query_id"]].add(r["vec_id"])
        assert r["score"] == pytest.approx(float(known[r["query_id"]] @ known[r["vec_id"]]))
    assert d and np.mean([len(got[q] & e) / 20 for q, e in expected.items()]) >= 0.9


def test_pipeline_stages_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == [n for n, _ in corpus_pipeline.STAGES] and len(stages) == 5
    odd = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "12 34", "en", "s", 5)], docs.schema)
    named = stages["language identification"](spark, docs.unionByName(odd), sf_dir)
    assert named.columns == docs.columns and named.count() == docs.count()
    calm = stages["toxicity"](spark, docs, sf_dir)
    assert calm.columns == docs.columns and calm.exceptAll(docs).count() == 0
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    single = stages["near-duplicate removal"](spark, docs, sf_dir)
    assert {r["doc_id"] for r in single.collect()} == set(plain_classes(texts).values())
    cut = stages["suffix-array de-duplication"](spark, docs, sf_dir)
    masks = removed({d: (t or "").encode() for d, t in texts.items()})
    for row in cut.collect():
        raw = texts[row["doc_id"]].encode()
        assert row["text"] == bytes(b for b, m in zip(raw, masks[row["doc_id"]]) if not m).decode("utf-8", "ignore")
        assert row["n_chars"] == len(row["text"])


def test_pipeline_runs(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    total = collections.Counter()
    for r in rows:
        total[r["doc_id"]] += r["length"]
    assert all(total[r["doc_id"]] == r["doc_tokens"] for r in rows)


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_odd_rows_and_on_none(spark, sf_dir, empty):
    """Null and repeated ids, null and empty texts, copies, and extra columns named like the stages' own."""
    text = "The quick brown fox jumps over the lazy dog and runs on to the river bank at night. "
    rows = [(1, text), (2, text), (None, text), (None, "another text of its own, long enough to be kept as it is."), (3, None), (4, ""), (5, "12 34")]
    rows += [(6, "a first text under one id"), (6, "a second and different text under the same id"), (7, "x" + text * 3)]
    rows = [(i, t, "en", "s", len(t or ""), True, 9, 0.5, "k") for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _kept boolean, class_id int, score double, kept string"
    docs = spark.createDataFrame([] if empty else rows, schema)
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append(sorted((str(r["doc_id"]), r["text"]) for r in docs.collect()))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    if empty:
        assert seen == [[]] * 4 and pieces == []
        return
    assert [i for i, _ in seen[0]] == sorted(["1", "2", "None", "None", "6", "6", "7"])
    assert [i for i, _ in seen[2]] == sorted(["1", "None", "None", "6", "7"])  # one of the copies, one row of an id
    assert dict(seen[3])["7"] == "x" and dict(seen[3])["1"] == text
    assert len({(r["doc_id"], r["start"], r["doc_tokens"]) for r in pieces}) >= 4


def test_pipeline_leaves_only_its_stages_tables(spark, sf_dir):
    """Run as a whole it deletes what a stage wrote for itself once the stage's result is stored."""
    import os

    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(root))
    corpus_pipeline.run(spark, sf_dir).agg(F.count("*")).collect()
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(root)) - before}
    assert left == {name.replace(" ", "-") for name, _ in corpus_pipeline.STAGES[:-1]}
