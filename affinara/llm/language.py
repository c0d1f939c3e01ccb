"""Language identification with a string kernel.

The blended-spectrum presence kernel of two texts counts the distinct character
n-grams of lengths 1 to 3 that both hold, divided by the geometric mean of their
own numbers. Labelled texts picked by a hash of their ids are the Nystrom
landmarks; one-versus-rest kernel ridge regression on the landmark features is
solved on the driver. Scoring is two matrix products for a batch of texts:
presence by landmarks, then landmarks by classes.

Fitting reads a bounded sample: at most ``per_language`` rows of each language
(``landmarks`` of them as landmarks), each of at most ``longest`` characters.
Scoring reads every whole text.

Cases: a null text and a text without a letter get ``und`` and score 0; so does
everything when no labelled row exists. Rows with a null label teach nothing.
Letters beyond the ``letters`` commonest of the sample share one symbol.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinara.llm.common import blocks, shared, small_batches, texts_of, tidy

UNKNOWN = "und"
BLOCK_BYTES = 1 << 20
ROWS = 256  # of a matrix product


@dataclass
class Alphabet:
    """Symbols of code points: 0 for what is no letter, 1 for rare letters."""

    symbol: np.ndarray
    size: int

    @classmethod
    def of(cls, texts: list[str], letters: int) -> Alphabet:
        counts = Counter()
        for text in texts:
            counts.update(text.lower())
        common = sorted((c for c in counts if c.isalpha()), key=lambda c: (-counts[c], c))[:letters]
        symbol = np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.uint16, 0x110000)
        for i, c in enumerate(common):
            symbol[ord(c)] = i + 2
        return cls(symbol, len(common) + 2)


def presence(texts: list[str], alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, n-gram) pairs: text numbers and n-gram codes."""
    lower = [t.lower() + "\n" for t in texts]
    points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbol = alphabet.symbol[points].astype(np.int64)
    text = np.repeat(np.arange(len(lower)), [len(t) for t in lower])
    kept = symbol > 0
    kept[1:] |= kept[:-1]
    symbol, text = symbol[kept], text[kept]
    n = alphabet.size
    codes = [symbol]
    for ahead in (1, 2):
        beside = np.zeros_like(symbol)
        beside[:-ahead] = np.where(text[ahead:] == text[:-ahead], symbol[ahead:], 0)
        codes.append(beside)
    three = np.unique((text * n + codes[0]) * n * n + codes[1] * n + codes[2])
    two = np.unique(three // n)
    one = np.unique(two // n)
    grams = (one % n, n + two % (n * n), n + n * n + three % (n * n * n))
    owner = (one // n, two // (n * n), three // (n * n * n))
    return np.concatenate(owner), np.concatenate(grams)


@dataclass
class Model:
    alphabet: Alphabet
    grams: np.ndarray  # the landmarks' n-grams, ascending
    landmark: np.ndarray  # n-grams by landmarks, divided by the root of the landmark's own number
    weight: np.ndarray  # landmarks by classes
    classes: list[str]

    def kernel(self, texts: list[str]) -> np.ndarray:
        owner, gram = presence(texts, self.alphabet)
        own = np.sqrt(np.maximum(np.bincount(owner, minlength=len(texts)), 1))
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        known = self.grams[at] == gram
        owner, at = owner[known], at[known]
        order = np.argsort(owner, kind="stable")
        owner, at = owner[order], at[order]
        out = np.empty((len(texts), self.landmark.shape[1]), np.float32)
        for start in range(0, len(texts), ROWS):
            stop = min(start + ROWS, len(texts))
            lo, hi = np.searchsorted(owner, (start, stop))
            held = np.zeros((stop - start, len(self.grams)), np.float32)
            held[owner[lo:hi] - start, at[lo:hi]] = 1
            out[start:stop] = held @ self.landmark
        return out / own[:, None].astype(np.float32)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        margin = self.kernel(texts) @ self.weight
        best = margin.argmax(1)
        score = np.round(np.clip((margin[np.arange(len(texts)), best].astype(float) + 1) / 2, 0, 1), 6)
        return [self.classes[i] for i in best], score


def solve(texts: list[str], labels: list[str], per_class: int, letters: int, ridge: float) -> Model:
    """Fit on the driver; the first ``per_class`` texts of each class are the landmarks."""
    alphabet = Alphabet.of(texts, letters)
    classes = sorted(set(labels))
    seen, chosen = Counter(), []
    for i, label in enumerate(labels):
        seen[label] += 1
        if seen[label] <= per_class:
            chosen.append(i)
    owner, gram = presence([texts[i] for i in chosen], alphabet)
    grams, column = np.unique(gram, return_inverse=True)
    landmark = np.zeros((len(grams), len(chosen)), np.float32)
    landmark[column, owner] = 1
    landmark /= np.sqrt(np.maximum(landmark.sum(0), 1))
    model = Model(alphabet, grams, landmark, np.zeros((len(chosen), len(classes)), np.float32), classes)
    value, vector = np.linalg.eigh(model.kernel([texts[i] for i in chosen]).astype(float))
    large = value > 1e-6 * value.max()
    root = vector[:, large] / np.sqrt(value[large])
    feature = model.kernel(texts).astype(float) @ root
    target = np.array([[1.0 if label == c else -1.0 for c in classes] for label in labels])
    share = np.array([1 / labels.count(label) for label in labels])[:, None]
    share *= len(labels) / share.sum()
    ridged = feature.T @ (share * feature) + ridge * np.eye(feature.shape[1])
    model.weight = (root @ np.linalg.solve(ridged, feature.T @ (share * target))).astype(np.float32)
    return model


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def lettered(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text holds a letter; needs no model."""
    small_batches(df.sparkSession)

    def kept(batches):
        for batch in batches:
            yield batch.filter(pa.array(map(has_letter, texts_of(batch.column(text))), pa.bool_()))

    return df.mapInArrow(tidy(kept), df.schema)


def fit(
    labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 240, landmarks: int = 24, letters: int = 120, longest: int = 200_000, ridge: float = 0.1
) -> Model | None:
    """Fit on a sample of the labelled rows, drawn by a hash of key and text; None where there is no labelled row."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.col(key), F.col(text)).alias("draw"))
    rows = rows.where(F.col("lang").isNotNull() & (F.length("text").between(1, longest)))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    drawn = F.lit(False)
    for value, n in sizes.items():
        # twice what is wanted, as hashes spread unevenly
        top = int(min(1.0, (2 * per_language + 40) / n) * (1 << 63))
        drawn |= (F.col("lang") == value) & (F.shiftrightunsigned("draw", 1) < min(top, (1 << 63) - 1))
    bound = 4 * (per_language + 40) * len(sizes)
    sample = sorted((r["draw"], r["text"], r["lang"]) for r in rows.where(drawn).limit(bound).toLocalIterator() if has_letter(r["text"]))
    taken, seen = [], Counter()
    for _, value, label in sample:
        seen[label] += 1
        if seen[label] <= per_language:
            taken.append((value, label))
    if not taken:
        return None
    return solve([t for t, _ in taken], [c for _, c in taken], landmarks, letters, ridge)


def identify(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every row. One pass, no shuffle."""
    small_batches(df.sparkSession)
    df = df.drop("lang_pred", "score")
    if model is None:
        return df.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    load = shared(df.sparkSession, model)
    schema = df.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)}).schema

    def identified(batches):
        for block in blocks(batches, text, BLOCK_BYTES):
            texts = texts_of(block.column(text))
            label, score = load().predict(texts)
            lettered = np.fromiter(map(has_letter, texts), bool, len(texts))
            label = [c if has else UNKNOWN for c, has in zip(label, lettered, strict=True)]
            out = block.append_column("lang_pred", pa.array(label, pa.string())).append_column("score", pa.array(np.where(lettered, score, 0.0)))
            yield from out.combine_chunks().to_batches()

    return df.mapInArrow(tidy(identified), schema)
