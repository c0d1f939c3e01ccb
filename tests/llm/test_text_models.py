"""BPE, packing, language identification, toxicity, main text and licences."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from affinara.llm import bpe, language, licences, main_text, packing, queries, toxicity
from affinara.llm.common import is_held_out, table

PATH = queries.tokenizer_path()
PARTS = ["a", "aa", "the", " ", "  ", "\n", "'s", "é", "ß", "日本", "\x1c", "\x85", "1", "²", "_", "!", "<|endoftext|>", "<|endof", "🙂", "\x00", "----"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def odd_texts(n=400, seed=5):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(n)] + ["", "ab" * 60_000, " " * 3000]


def test_bpe_equals_the_tokenizers_library_and_round_trips(spark, tokenizer):
    texts = [*odd_texts(), None]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert len(rows) == len(texts)
    for row in rows:
        expected = tokenizer.encode(texts[row["doc_id"]] or "", add_special_tokens=False).ids
        assert row["ids"] == expected
        assert row["decoded"] == tokenizer.decode(expected, skip_special_tokens=False)


def test_bpe_keeps_its_results_when_it_forgets_words(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 5)
    encoder = bpe.Encoder(PATH)
    for text in odd_texts(40):
        assert encoder.encode([text])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_bpe_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(df, PATH), PATH).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_fill_is_the_closest_that_any_multiset_gives(seed):
    r = random.Random(seed)
    lengths = [r.randint(1, 40) for _ in range(9)]
    counts = [lengths.count(n) for n in range(64)]
    sums = {0}
    for n in lengths:
        sums |= {s + n for s in sums}
    capacity = r.randint(20, 63)
    fill = packing.closest_fill(capacity, counts)
    assert sum(n * c for n, c in fill) == max(s for s in sums if s <= capacity)
    assert all(c <= counts[n] for n, c in fill)


def test_packing_covers_every_id_once(spark, tokenizer):
    texts = [*odd_texts(200), None, "same", "same"]
    ids = [*range(len(texts) - 1), 0]  # the last id occurs twice
    df = spark.createDataFrame([(i, t, 7) for i, t in zip(ids, texts)], "doc_id long, text string, start int").repartition(3)
    rows = packing.pack(df, PATH).collect()
    check_pieces(rows, {i: [t for j, t in zip(ids, texts) if j == i] for i in ids}, tokenizer)


def check_pieces(rows, texts, tokenizer):
    expected, got, sequences = 0, 0, {}
    arrays = {i: [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for t in ts] for i, ts in texts.items()}
    for row in rows:
        part = {a[row["start"] : row["start"] + row["length"]].tobytes() for a in arrays[row["doc_id"]] if len(a) == row["doc_tokens"]}
        assert row["ids"] in part if "ids" in row else row["ids_crc32"] in {zlib.crc32(p) for p in part}
        got += row["length"]
        sequences.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    expected = sum(len(a) for x in arrays.values() for a in x)
    assert got == expected
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= packing.WINDOW and at & (at - 1) == 0  # full, or a power of two


def test_packing_an_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_languages_of_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.op7_language(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    hits = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"] and r["lang"]]
    assert np.mean(hits) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_cases(spark):
    texts = ["the house and the tree", "und der baum und das haus"] * 6
    known = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(texts)] + [(99, None, "a"), (98, "x", None)], "doc_id long, text string, lang string")
    model = language.fit(known)
    new = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "12 !?", "q"), (4, "the tree", "q"), (4, "the tree", "q"), (5, "der baum " * 20_000, "q")], "doc_id long, text string, score string")
    got = sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(new, model).collect())
    assert [g[1] for g in got] == ["und", "und", "und", "a", "a", "b"]
    assert got[0][2] == 0.0 and got[3] == got[4]
    none = language.fit(known.where("false"))
    assert none is None and {r["lang_pred"] for r in language.identify(new, none).collect()} == {"und"}
    assert language.identify(new.where("false"), model).count() == 0


def test_pipeline_filters_without_a_model_keep_the_corpus(spark, tmp_path):
    texts = ["a quiet day by the lake", "the house and the tree", None, "", "12 !?", "日本"]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()) == [0, 1, 5]
    for toxic in (0, 1):
        sf_dir = str(tmp_path / str(toxic))
        spark.createDataFrame([(0, toxic), (1, toxic)], "doc_id long, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
        assert corpus_pipeline.reject_toxic(spark, docs, sf_dir).count() == len(texts)


def test_kernel_is_the_normalized_count_of_common_ngrams():
    texts = ["ab ba", "abba", "xyz"]
    model = language.solve(texts, ["p", "p", "q"], 3, 50, 0.1)

    def spectrum(t):
        padded = t + "\0\0\0"
        return {padded[i : i + n] for i in range(len(t) + 1) for n in (1, 2, 3)} - {""}

    def grams(t):
        s = t + "\n"
        out = set()
        for i in range(len(s)):
            for n in (1, 2, 3):
                out.add(tuple((s[i + k] if i + k < len(s) and s[i + k].isalpha() else "_") for k in range(n)))
        return out

    sets = [grams(t) for t in texts]
    expected = [[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets]
    assert np.allclose(model.kernel(texts), expected, atol=1e-6)


def test_toxicity_of_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.op1_toxicity(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").where("held_out").collect()
    toxic, clean = ([r["score"] for r in rows if r["toxic"] == t] for t in (1, 0))
    pairs = np.subtract.outer(toxic, clean)
    assert ((pairs > 0) + 0.5 * (pairs == 0)).mean() >= 0.85
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_toxicity_cases(spark):
    bad, good = "you are a vile gnarp and a blick", "a quiet day by the lake"
    docs = spark.createDataFrame([(i, (bad if i % 2 else good) + f" w{i}") for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(None, 1), (3, None), (3, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    new = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, bad, 5), (3, bad, 5), (4, good * 5000, 5), (None, good, 5)], "doc_id long, text string, features int")
    got = {(r["doc_id"], r["text"]): r["score"] for r in model.score(new).collect()}
    assert model.score(new).count() == 6
    assert got[3, bad] > 0.7 > 0.3 > got[None, good]
    assert all(0 <= s <= 1 for s in got.values())
    assert toxicity.fit(docs, labels.where("false")).score(new).select("score").distinct().collect()[0][0] == 0.0
    assert model.score(new.where("false")).count() == 0


def term_set(text):
    return {t for w in text.split() for t in toxicity.terms(toxicity.normal_form(w)[0])}


def test_lexicon_equals_a_plain_count(spark):
    r = random.Random(2)
    words = ["vile", "gnarp", "blick", "gnarping", "lake", "calm", "day", "G.n.a.r.p!", "the"]
    rows = []
    for i in range(300):
        toxic = i % 3 == 0
        rows.append((i, " ".join(r.choice(words[:4] + words if toxic else words[4:7] + words[8:]) for _ in range(r.randint(0, 12))), int(toxic)))
    rows += [(1000, None, 0), (1001, "", 1)]
    got = toxicity.lexicon_of(spark.createDataFrame(rows, "doc_id long, text string, toxic int").where("text IS NOT NULL").repartition(5)).odds
    kept = [(term_set(t), y) for _, t, y in rows if t is not None]
    bad, good = 1.0 + sum(y for _, y in kept), 1.0 + sum(1 - y for _, y in kept)
    expected = {}
    for term in set().union(*(s for s, _ in kept)) - {""}:
        t, c = (sum(term in s for s, y in kept if y == side) for side in (1, 0))
        odds = np.log((t + 0.5) / bad) - np.log((c + 0.5) / good)
        if t >= 3 and odds > 1 and odds / np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5)) > 2:
            expected[term] = odds
    assert expected and got.keys() == expected.keys()
    assert all(abs(got[t] - expected[t]) < 1e-9 for t in expected)


def plain_features(text, lexicon):
    """The 16 features by their definition, one word at a time."""
    words = (text or "").split()
    if not words:
        return [0.0] * 16
    n, odds, odd, you = len(words), [], [], []
    for w in words:
        plain, hidden = toxicity.normal_form(w)
        odds.append(max([0.0] + [lexicon.odds.get(plain, 0.0)] + [lexicon.odds.get(plain[:k] + "*", 0.0) for k in (4, 5, 6) if len(plain) > k]))
        odd.append(hidden)
        you.append(plain in toxicity.SECOND_PERSON)
    strong = [i for i in range(n) if odds[i] >= 3.5]
    medium, mild = sum(2 <= o < 3.5 for o in odds), sum(0 < o < 2 for o in odds)
    near = sum(any(you[j] for j in range(max(0, i - 4), min(n, i + 5))) for i in strong)
    letters, upper = sum(c.isalpha() for c in text) or 1, sum(c.isupper() for c in text)
    return [
        len(strong), len(strong) / n, len({words[i].lower() for i in strong}), medium, medium / n, mild / n, max(odds), sum(odds), sum(odds) / n,
        near, near / n, sum(you) / n, upper / letters, sum(c in "!?" for c in text) / n, sum(odd) / n, np.log(1 + n),
    ]


def test_features_equal_a_plain_count(spark):
    lexicon = toxicity.Lexicon({"vile": 4.0, "gnar*": 3.6, "blick": 2.5, "day": 1.2})
    r = random.Random(3)
    words = ["vile", "gnarping", "gnar", "you", "YOUR", "blick", "B1ick!", "day", "lake", "?!", "2024", "é", "v.i.l.e", "dich"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 40))) for _ in range(200)] + ["", None, "  ", "vile you " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    for row in toxicity.featured(df, lexicon).collect():
        assert np.allclose(row["features"], plain_features(texts[row["id"]], lexicon), atol=1e-9), texts[row["id"]]


def test_isotonic_step_is_the_least_squares_rising_fit(spark):
    """The isotonic step against the max-min formula; the operator's scores rise with the trees' chance."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import IsotonicRegression

    r = random.Random(4)
    rows = [(float(r.random() < x / 9), x / 9) for x in (r.randint(0, 9) for _ in range(200))]
    frame = spark.createDataFrame(rows, "label double, raw double")
    fitted = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(frame)
    xs = sorted({x for _, x in rows})
    total = [(sum(y for y, v in rows if v == x), sum(v == x for _, v in rows)) for x in xs]
    mean = lambda i, j: sum(t for t, _ in total[i : j + 1]) / sum(n for _, n in total[i : j + 1])
    expected = {x: max(min(mean(i, j) for j in range(k, len(xs))) for i in range(k + 1)) for k, x in enumerate(xs)}
    for row in fitted.transform(spark.createDataFrame([(x,) for x in xs], "raw double")).collect():
        assert abs(row["calibrated"] - expected[row["raw"]]) < 1e-9
    # the operator's own scores rise with the trees' chance
    docs = spark.createDataFrame([(i, ("you vile gnarp" if i % 2 else "a calm day") + f" w{i}") for i in range(80)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 2)) for i in range(80)], "doc_id long, toxic int"))
    features = toxicity.featured(docs, model.lexicon).withColumn("features", array_to_vector("features"))
    raw = {x["doc_id"]: float(x["probability"][1]) for x in model.trees.transform(features).collect()}
    score = {x["doc_id"]: x["score"] for x in model.score(docs).collect()}
    order = sorted(raw, key=lambda i: raw[i])
    assert all(score[a] <= score[b] + 1e-12 for a, b in zip(order, order[1:], strict=False))


def test_obfuscated_words_are_read():
    assert toxicity.normal_form("M0r0n!") == ("moron", True)
    assert toxicity.normal_form("s.c.u.m") == ("scum", True)
    assert toxicity.normal_form("2024")[1] is False


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><a href="/a">Home</a> <a>News</a></nav>
<div class="ad">Buy now, buy more and more and more.</div><article><h1>A &amp; B</h1><p>First <b>bold</b>
 text<br>second &eacute;</p><form><label>Name</label></form><!-- <p>no</p> --><p>1 < 2 always</p><div class="comments"><p>nice post</p></div></article>
<footer>All rights reserved by us for ever</footer><script>var t="</p>";</script>"""


def test_main_text_cases(spark):
    rows = [(i, "u", PAGE.replace("First", f"First{i}"), "keep") for i in range(6)]
    rows += [(10, None, None, "k"), (11, None, "", "k"), (12, "u", "<p></p>", "k"), (13, "u", "<article><p>open and <b>never closed", "k"), (13, "u", "<article><p>open and <b>never closed", "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    weights = main_text.fit(pages)
    got = [(r["page_id"], r["text"]) for r in main_text.main_text(pages, weights).collect()]
    assert len(got) == len(rows)
    found = dict(got)
    assert found[0] == "A & B\nFirst0 bold text\nsecond é\n1 < 2 always"
    assert found[10] == found[11] == found[12] == ""
    assert found[13] == "open and never closed"
    assert main_text.main_text(pages.where("false"), main_text.fit(pages.where("false"))).count() == 0


def test_best_run_is_the_best_of_all_runs():
    r = random.Random(1)
    for _ in range(50):
        scores = [r.choice([-3, -1, 1, 2]) for _ in range(12)]
        begin, end = main_text.region(scores)
        best = max([0] + [sum(scores[i:j]) for i in range(12) for j in range(i + 1, 13)])
        assert sum(scores[begin:end]) == best


def test_articles_of_all_pages(spark, sf_dir):
    import html
    import re

    rows = queries.op5_main_text(spark, sf_dir).join(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id").collect()
    assert rows
    for row in rows:
        article = row["html"].split("<article>")[1].split("</article>")[0]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", article))
        assert row["text"] == "\n".join(p for p in parts if p) and row["n_chars"] == len(row["text"])


def test_licences_equal_a_plain_search(spark, sf_dir):
    got = {(r["doc_id"], r["statement"]) for r in queries.op8_licences(spark, sf_dir).collect()}
    wanted = {t for f in licences.TEMPLATES.values() for t in f}
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).collect()
    assert got >= {(r["doc_id"], r["line"]) for r in lines if r["line"] in wanted}
    assert all("icense" in s or "rights reserved" in s for _, s in got)


def test_licence_cases(spark):
    model = licences.fit(["the cat sat on the mat in the sun", "terms of the public were free to use"] * 20)
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y z\nReleased under the MIT License.\nmore", "a"), (3, "x y z\nReleased under the MIT License.\nmore", "a")]
    rows += [(4, "Licensed under CC BY-SA 4.0.", "a"), (5, "the license of the work is under version 2", "a"), (None, "All rights reserved.", "a"), (6, "word " * 50_000, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, family string")
    got = sorted((r["doc_id"] or 0, r["paragraph"], r["family"]) for r in licences.scan(df, model).collect())
    assert got == [(0, 0, "proprietary"), (3, 1, "mit"), (3, 1, "mit"), (4, 0, "cc-by-sa")]
    assert licences.scan(df.where("false"), model).count() == 0


def test_every_template_and_title_is_given_to_its_own_family(spark):
    model = licences.fit(["the cat sat on the mat in the sun", "terms of the public were free to use"] * 20)
    rows = [(t, f) for f in licences.TEMPLATES for t in licences.taught(f)]
    df = spark.createDataFrame([(i, f"Some text before.\n\n{t}\n\nSome text after.") for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {}
    for r in licences.scan(df, model).collect():
        got.setdefault(r["doc_id"], set()).add(r["family"])
    assert {rows[i]: got.get(i) for i in range(len(rows))} == {row: {row[1]} for row in rows}


NOTICES = {"mit": licences.TEMPLATES["mit"][0], "bsd": licences.TEMPLATES["bsd"][0], "gpl": licences.TEMPLATES["gpl"][0], "apache-2.0": licences.TEMPLATES["apache-2.0"][0]}


def plain_runs(text):
    """Whether any run of words of any paragraph holds enough of a template's word pairs, by comparing all runs."""
    for block in text.split("\n\n"):
        own = licences.WORD.findall(block.lower())
        for template in (t for f in licences.TEMPLATES for t in licences.templates(f)):
            wanted, longest = licences.pairs(template), int(licences.STRETCH * len(licences.WORD.findall(template.lower()))) + 1
            for i in range(len(own)):
                run = own[i : i + longest]
                if len(wanted & {f"{a} {b}" for a, b in zip(run, run[1:], strict=False)}) >= licences.LEAST_SHARED * len(wanted):
                    return True
    return False


def test_wrapped_and_embedded_notices(spark):
    import textwrap

    r = random.Random(8)
    prose = ["the cat sat on the mat in the sun", "terms of the public were free to use", "a copy of the file is in the source", "this work is for any person"]
    texts, wanted = [], []
    for family, notice in NOTICES.items():
        for width in (40, 72):
            for mark in ("", "# ", " * "):
                lines = [mark + x for x in textwrap.wrap(notice, width)]
                texts += ["\n".join([mark + "Some file", mark.rstrip(), *lines, "", r.choice(prose)]), "\n".join([r.choice(prose), *lines, r.choice(prose)])]
                wanted += [family] * 2
        texts.append(" ".join([*r.choices(prose, k=12), notice, *r.choices(prose, k=12)]))
        wanted.append(family)
    texts += ["MIT License\n\nCopyright (c) 2020 A B", "we chose the\nMIT license\nfor reasons", "the MIT License is short"]
    wanted += ["mit", "mit", None]
    texts += ["\n".join(r.choices(prose, k=8)) for _ in range(20)]
    wanted += [None] * 20
    model = licences.fit(prose * 20)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for row in licences.scan(df, model).collect():
        assert row["statement"] in texts[row["doc_id"]]
        got.setdefault(row["doc_id"], set()).add(row["family"])
    for i, (text, family) in enumerate(zip(texts, wanted, strict=True)):
        assert got.get(i, set()) == ({family} if family else set()), text
        title = any(line.lower() == "mit license" for line in text.split("\n"))
        assert (i in got) == (title or plain_runs(text)), text


def test_held_out_rule(spark):
    df = spark.createDataFrame([(i,) for i in range(30)] + [(None,)], "doc_id long").select("doc_id", is_held_out("doc_id").alias("h"))
    for row in df.collect():
        assert row["h"] == (row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 1)


@pytest.mark.parametrize("unit", ["<b>x", "<p>a</q>", "<!x", "<script ", '<a "', "<?", "<p><b>x</i></q>", "</script ", "<p>a<!--"])
def test_long_pages_of_broken_tags_take_linear_time(unit):
    import time

    seconds = []
    for size in (250_000, 1_000_000):
        page = unit * (size // len(unit))
        start = time.process_time()
        main_text.extract(page, {})
        seconds.append(time.process_time() - start)
    assert seconds[1] < 8 * seconds[0] + 0.2  # four times the page; quadratic would be sixteen


def test_blank_class_and_text_behind_the_last_tag():
    assert main_text.extract('<p class=" ">one two three four five six</p>', {}) == "one two three four five six"
    assert main_text.extract("a > b and more words < here <x", {}) == "a > b and more words < here <x"
    assert main_text.extract("words of text<!-- never ended > still", {}) == "words of text"
    assert main_text.extract("words of text<script> x > y", {}) == "words of text"
