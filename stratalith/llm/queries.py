"""The ``opN_`` queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tune
from . import decontaminate, html_render, importance, language_id, outlier_sql, packing, periodic, pii, prefix_trie, robust_outliers, separator_scan, simhash, suffix_dedup, url_filter

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op3_robust_outliers", outlier_sql.outliers())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the outlier verdict per language and source."""
    out = robust_outliers.judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


# The rules of the query.
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


@query("op4_url_model_ratio")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL under the rules, else under the models of what they allow and block."""
    return url_filter.judged(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def bpe() -> tuple[str, str]:
    """The ranks of the vocabulary of ``byte_bpe_50k.json`` and its split pattern."""
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query("op1_importance_resampling")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gumbel top-k over all documents; the target is what is labelled good and not toxic."""
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), good)


def held_out(doc_id: str = "doc_id"):
    """Documents that language models here never learn from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(~held_out()), public_tokenizers.path("piece_bpe_32k.model"))
    out = language_id.predict(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op5_best_fit_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens; every text ends with id 0."""
    return packing.packed_documents(table(spark, sf_dir, "documents"), *bpe(), capacity=2048)


@query("op6_html_layout_text")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return html_render.extracted(table(spark, sf_dir, "pages"))


@query("op7_weak_supervision_pii")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text: base spans and those that the classifier adds."""
    out = pii.find(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"))


@query("op8_simhash_near_duplicates")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles, linked at two bits or fewer."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)


#: The id that ends a document in a token file; texts never contain it, as its string is ordinary text.
END_OF_DOCUMENT = 50256


@query("op9_separator_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted between the separators of flat token files."""
    return separator_scan.counted_documents(table(spark, sf_dir, "documents"), *bpe(), end_id=END_OF_DOCUMENT)


@query("op10_spaced_seed_decontamination")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every overlap of a document with a benchmark item, at 13 words and four fifths of them equal."""
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_conversation_prefix_trie")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix that rebuilt conversations have, with what its subtree holds and saves."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query("op12_deep_shallow_dedup")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text without the strings of 100 bytes that also start earlier."""
    out = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("remaining", 256).alias("kept_sha256"))


def planted_seed(doc_id: str = "doc_id"):
    """What a tenth of the documents are rewritten by before runs are sought; null for the others."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.when(h % 10 == 0, F.floor(h / 10))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words in every whole text, and the text without their repeats."""
    return periodic.described(periodic.periodic_runs(table(spark, sf_dir, "documents"), seed=planted_seed()))
