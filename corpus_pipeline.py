"""The training-data pipeline: from ``documents`` to packed sequences, one written table per stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.llm import decontaminate, language_id, packing, pii, simhash
from stratalith.session import settle, tune

#: Below this posterior a text has no language that can be told.
LEAST_SCORE = 0.5


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and those whose language the models cannot tell, go.

    Null, empty and blank texts have no letter.  Rows are judged by ``doc_id``: where several rows share one
    and a text of them is rejected, all go; rows with a null id stay.  Models are learned from the rows with
    a text and a ``lang``; without any, no language can be told and only rows with a null id stay.  Very
    long texts are read whole, an empty table stays empty, all columns stay whatever their names.
    """
    model = language_id.fit(docs, public_tokenizers.path("piece_bpe_32k.model"))
    told = language_id.predict(docs, model)
    rejected = settle(told.filter((F.col("lang_pred") == "und") | (F.col("score") < LEAST_SCORE)).select("doc_id").distinct())
    return docs.join(rejected, "doc_id", "left_anti")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near duplicates stays.

    Null, empty and blank texts have no words and are near duplicates of each other.  Of rows that repeat an
    id one stays; a row with a null id stays.  Groups of any size, texts of any length and an empty table
    are handled alike; all columns stay whatever their names.
    """
    return simhash.keep_one(docs)


def keep_clear_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a passage with a benchmark item go.

    Null and empty texts share none and stay.  Rows are judged by ``doc_id``: all rows of an id go with one
    of them; rows with a null id stay.  An empty table, or an empty benchmark, changes nothing; all columns
    stay whatever their names.
    """
    return decontaminate.without_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` follows the new text.

    Every row stays, repeated ones too.  A null text stays null, with a null ``n_chars``; very long texts are
    searched whole; all columns stay whatever their names.
    """
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining texts, placed in sequences of 2048 tokens.

    Null and empty texts are packed as their end id; repeated rows, and rows with equal or null ids, are
    packed each; longer texts are cut into pieces.  An empty table gives no pieces.
    """
    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, capacity=2048)


STAGES = [
    ("language_id", keep_languages),
    ("simhash_near_dedup", keep_one_of_each),
    ("benchmark_decontamination", keep_clear_of_benchmark),
    ("pii", redact),
    ("best_fit_packing", pack),
]

#: Model fits, graph rounds and packing have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each reads what the one before has written."""
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
