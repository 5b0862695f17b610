"""A corpus from raw documents: grade, drop near copies, cut repeated passages, mix sources, encode.

STAGES holds (name, function of spark, docs, sf_dir). Each stage works on all that the one before it kept; run() writes what
each returns as Parquet in the shared folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm import near_texts, piece_codec, quality_model, source_mix, substring_dedup
from episodica.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tail probability of the best grade is high enough; the model learns from the labels.

    A text that is null or has no word has nothing to grade and goes; rows that repeat stay or go together, as do ties; an empty table stays empty; other columns are carried.
    """
    model = quality_model.fit(docs, quality_model.grades_of_labels(table(spark, sf_dir, "labels")))
    return quality_model.grade(docs, model).where("keep").select("r.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five words, similarity 0.8): the one with the smallest id.

    Rows that repeat are copies; texts without words are one class; a row without an id stays only where its class has none with one; an empty table stays empty.
    """
    return near_texts.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that another document owns; a document that was nothing else goes.

    The owner is the document with the smallest id; rows with the same id are one document; null and empty texts stay as they are; an empty table stays empty.
    """
    kept = substring_dedup.deduplicated(docs)
    return kept.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else kept


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, each as often as the mix of sources takes it.

    A null source is one of its own; null and empty texts have no words and may be taken or not; rows that repeat are taken equally often; ties are drawn by a hash of the row; an
    empty table stays empty.
    """
    return source_mix.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document, one row a row; null and empty texts have none, rows that repeat have the same, an empty table gives none."""
    return piece_codec.encode(docs)


STAGES = [("quality", quality), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("mix", mix), ("encode", encode)]

#: SQL can't express a hashed classifier, SimHash, gear chunks, the cube method or merge-dropout.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
