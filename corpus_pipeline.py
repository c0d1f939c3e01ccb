"""The corpus pipeline: documents in, packed training sequences out.

Each stage works on all rows that the stage before kept. A stage's result is
written as Parquet to the folder in ``spark.checkpoint.dir`` and read again, so
a lost executor never costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinara.llm import language, near_dedup, suffix_dedup, toxicity
from affinara.llm.common import table
from affinara.llm.queries import packed_pieces
from affinara.shipping import scratch_of_job, scratch_path

REJECTED_FROM = 0.7


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects null texts and texts without a letter, and nothing else, whether or not a model can be fitted."""
    model = language.fit(docs)
    if model is None:  # no labelled row: every text would be unknown
        return language.lettered(docs).select(docs.columns)
    found = language.identify(docs, model)
    return found.where(found["lang_pred"] != language.UNKNOWN).select(docs.columns)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose calibrated toxicity is 0.7 or more; none where the labels are of one class."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    if model.trees is None:  # a constant score tells nothing of a document
        return docs
    scored = model.score(docs)
    return scored.where(scored["score"] < REJECTED_FROM).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of every class of near duplicates."""
    return near_dedup.keep_one(docs).select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every 50-byte string that also starts in a document with a smaller id; all rows stay."""
    cut = suffix_dedup.cut_texts(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into windows; the last stage."""
    return packed_pieces(docs)


STAGES = [
    ("language identification", identify_language),
    ("toxicity", reject_toxic),
    ("near-duplicate removal", drop_near_copies),
    ("suffix-array de-duplication", cut_repeats),
    ("packing", pack_sequences),
]
# learned models and suffix ordering have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        with scratch_of_job(spark):  # what a stage wrote for itself goes once its result is stored
            found = stage(spark, docs, sf_dir)
            found.write.parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
