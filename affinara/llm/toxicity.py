"""Toxicity scores from gradient-boosted trees over dense features, calibrated by isotonic regression.

A lexicon of terms (words and word beginnings, after undoing look-alike
characters) with their log odds is learned from labelled rows. Each whole text
becomes a short dense vector: densities of the lexicon's strong, medium and mild
terms, closeness of such terms to words of the second person, and rates of
capitals, punctuation and obfuscated words. Trees and calibration are Spark ML
models; each half of the sample is scored with the lexicon of the other half
while they are fitted, so that the trees never see a lexicon's own rows.

Fitting reads a bounded sample of the labelled rows, at most ``most_rows``,
drawn by a hash of their ids. Scoring reads every whole text in one pass.

Cases: null and empty texts have all features 0 and get the score that the trees
give that. With no labelled row of one of both classes every score is the share
of toxic rows (0 without labels). Null labels teach nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinara.llm.common import shared, small_batches, texts_of, tidy
from affinara.shipping import written

# fixed values: words of the second person
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deiner ihr euch euer eure sie ihnen "
    "tu te toi ton ta tes vous votre vos tú ti tuyo tuya usted ustedes vosotros vosotras os".split()
)
LOOKALIKES = str.maketrans("013457@$!|", "oieastasil")
WORD = re.compile(r"\S+")
EDGE = "\"'`.,;:!?()[]{}<>«»“”„…-–—¡¿"
PREFIXES = (4, 5, 6)
NEAR = 4
FEATURES = 16
KEPT_WORDS = 100_000  # that a task remembers the reading of


def normal_form(word: str) -> tuple[str, bool]:
    """A word without edge punctuation, case, look-alikes and inner marks; whether it looked obfuscated."""
    word = word.strip(EDGE).lower()
    if word.isalpha() or not word:
        return word, False
    plain = "".join(filter(str.isalpha, word.translate(LOOKALIKES)))
    letters = sum(map(str.isalpha, word))
    return plain, letters >= 2 and 2 * letters >= len(word)


def terms(word: str) -> list[str]:
    """The lexicon terms of a word: itself, and its beginnings marked by a star."""
    return [word] + [word[:n] + "*" for n in PREFIXES if len(word) > n]


@dataclass
class Lexicon:
    odds: dict[str, float]

    def of(self, word: str) -> float:
        get = self.odds.get
        return max([0.0] + [get(t, 0.0) for t in terms(word)])


def features(text: str, lexicon: Lexicon, known: dict[str, tuple[float, bool, bool]]) -> list[float]:
    words = text.split()
    if not words:
        return [0.0] * FEATURES
    n = len(words)
    hits, you, hidden = [], [], 0
    for i, word in enumerate(words):
        found = known.get(word)
        if found is None:
            plain, odd = normal_form(word)
            found = known[word] = (lexicon.of(plain), odd, plain in SECOND_PERSON)
        if found[0]:
            hits.append((i, found[0], word))
        hidden += found[1]
        if found[2]:
            you.append(i)
    odds = np.array([h[1] for h in hits] or [0.0])
    strong = [h for h in hits if h[1] >= 3.5]
    near = 0
    if strong and you:
        places = np.array(you)
        near = sum(bool(np.abs(places - h[0]).min() <= NEAR) for h in strong)
    letters = sum(map(str.isalpha, text)) or 1
    upper = sum(map(str.isupper, text))
    marks = text.count("!") + text.count("?")
    return [
        len(strong),
        len(strong) / n,
        len({h[2].lower() for h in strong}),
        sum(2 <= h[1] < 3.5 for h in hits),
        sum(2 <= h[1] < 3.5 for h in hits) / n,
        sum(h[1] < 2 for h in hits) / n,
        float(odds.max()),
        float(odds.sum()),
        float(odds.sum()) / n,
        near,
        near / n,
        len(you) / n,
        upper / letters,
        marks / n,
        hidden / n,
        math.log1p(n),
    ]


def featured(df: DataFrame, lexicon: Lexicon, text: str = "text", name: str = "features") -> DataFrame:
    """Add the dense feature array of every whole text."""
    small_batches(df.sparkSession)
    load = shared(df.sparkSession, lexicon)
    schema = df.withColumn(name, F.array(F.lit(0.0))).schema

    def made(batches):
        known: dict[str, tuple[float, bool, bool]] = {}
        for batch in batches:
            rows = []
            for t in texts_of(batch.column(text)):
                if len(known) > KEPT_WORDS:
                    known.clear()
                rows.append(features(t, load(), known))
            yield batch.append_column(name, pa.array(rows, pa.list_(pa.float64())))

    return df.mapInArrow(tidy(made), schema)


def lexicon_of(sample: DataFrame, least: int = 3, most_terms: int = 5000) -> Lexicon:
    """Terms that toxic rows hold far more often than others, with their log odds; counted in Spark."""

    def counted(batches):
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(texts_of(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
                own = {t for w in set(text.split()) for t in terms(normal_form(w)[0])}
                (toxic if label else clean).update(own)
        both = list(toxic.keys() | clean.keys())
        for i in range(0, len(both), 10_000):
            part = both[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([toxic[t] for t in part], pa.int64()), pa.array([clean[t] for t in part], pa.int64())], ["term", "t", "c"])

    sizes = sample.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    t, c = (sizes["t"] or 0) + 1.0, sizes["n"] - (sizes["t"] or 0) + 1.0
    counts = sample.select("text", "toxic").mapInArrow(tidy(counted), "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    odds = F.log((F.col("t") + 0.5) / t) - F.log((F.col("c") + 0.5) / c)
    # how surely the odds are above even, in standard deviations
    sure = odds / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    best = counts.where((F.col("t") >= least) & (odds > 1) & (sure > 2) & (F.col("term") != "")).select("term", odds.alias("odds")).orderBy(F.desc(sure), "term").limit(most_terms)
    return Lexicon({r["term"]: r["odds"] for r in best.collect()})


@dataclass
class Model:
    share: float
    lexicon: Lexicon | None = None
    trees: object = None
    calibration: object = None

    def score(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Add ``score``, the calibrated chance that a text is toxic, to every row."""
        df = df.drop("score")
        if self.trees is None:
            return df.withColumn("score", F.lit(float(self.share)))
        inner = {c: f"_{i}" for i, c in enumerate(df.columns)}  # so that no name of the models' columns clashes
        rows = df.toDF(*inner.values())
        rows = featured(rows, self.lexicon, inner[text]).withColumn("features", array_to_vector("features"))
        rows = self.trees.transform(rows).withColumn("raw", vector_to_array("probability")[1])
        rows = self.calibration.transform(rows)
        return rows.select(*(F.col(v).alias(c) for c, v in inner.items()), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("calibrated"))).alias("score"))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 24_000, trees: int = 20, depth: int = 4) -> Model:
    """Fit on rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) names."""
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = labels.count()
    rate = min(1.0, most_rows / max(total, 1))
    drawn = labels.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 1) <= int(rate * ((1 << 63) - 1024))).limit(2 * most_rows)
    # the sample's ids are at most 2 x most_rows short rows
    sample = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(drawn), "doc_id")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(8))
    sample = written(sample.withColumn("fold", fold).limit(4 * most_rows), "toxicity-sample").repartition(16)
    sizes = sample.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    share = (sizes["t"] or 0) / sizes["n"] if sizes["n"] else 0.0
    if share in (0.0, 1.0):
        return Model(share)
    even, odd = sample.where("fold % 2 = 0"), sample.where("fold % 2 = 1")
    crossed = featured(even, lexicon_of(odd)).unionByName(featured(odd, lexicon_of(even)))
    rows = written(crossed.select(F.col("toxic").cast("double").alias("label"), "features", "fold"), "toxicity-features")
    rows = rows.withColumn("features", array_to_vector("features"))
    learn, hold = rows.where("fold >= 2"), rows.where("fold < 2")
    if learn.select("label").distinct().count() < 2 or hold.select("label").distinct().count() < 2:
        learn = hold = rows
    boosted = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=1).fit(learn)
    raw = boosted.transform(hold).withColumn("raw", vector_to_array("probability")[1]).select("label", "raw")
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(raw)
    return Model(share, lexicon_of(sample), boosted, calibration)
