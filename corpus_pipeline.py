"""Training-corpus pipeline over ``documents``: five stages, each written as Parquet and read again.

Each stage works on all rows that the one before kept, and all but the last return the columns
of their input.  ``run`` writes to the shared folder that the session's spark.checkpoint.dir
names, so a lost executor repeats tasks of one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rigflow.llm import exact_dedup, language_id, mixing, near_dedup, sentencepiece_codec
from rigflow.session import materialize

def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter go ("und")."""
    return docs.where(language_id.language_column(spark, language_id.train_fold(docs), F.col("text")) != "und")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the row with the smallest doc_id stays."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays."""
    return near_dedup.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, in training order."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, pieces and lossless of every row; the copies that the mix takes of a
    document are encoded under their places in training order, so each in its own way."""
    return sentencepiece_codec.encode_documents(docs, sentencepiece_codec.default_vocabulary(), epoch=F.monotonically_increasing_id())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL cannot express the language model or the encoder; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
