"""Quality by importance resampling with hashed n-gram models.

Words and word pairs are hashed into a fixed number of buckets.  The counts of the target texts and of
all texts give two multinomial models; a text's log importance weight is the sum over its n-grams of the
log ratio.  Adding Gumbel noise to the weights and keeping the ``k`` largest draws ``k`` texts without
replacement in proportion to their importance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import global_rank
from .batches import ALNUM, Words, mix, words

BUCKETS = 1 << 19
#: Labelled target texts that the target model learns from, at most: those with the smallest hash.
TARGET_ROWS = 100_000
SMOOTHING = 1.0
SEED = 7


def _grams(piece: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every word and every pair of neighbours within a row."""
    pair = np.flatnonzero(piece.row[1:] == piece.row[:-1])
    joined = mix(piece.hash[pair] * np.uint64(3) + piece.hash[pair + 1])
    bucket = np.concatenate((piece.hash, joined)) & np.uint64(BUCKETS - 1)
    return bucket.astype(np.int64), np.concatenate((piece.row, piece.row[pair]))


def target_keys(labels: DataFrame, id_col: str, is_target: Column, limit: int = TARGET_ROWS) -> np.ndarray:
    """Sorted hashes of the target ids; a bounded sample, by hash order, if there are more."""
    keys = labels.filter(is_target).select(F.xxhash64(id_col).alias("key")).distinct()
    return np.sort(np.array([r["key"] for r in keys.orderBy("key").limit(limit).collect()], np.int64))


def log_ratio(docs: DataFrame, targets: np.ndarray, id_col: str, text_col: str) -> np.ndarray:
    """Log ratio of the target model to the model of all texts for every bucket."""
    picked = docs.select(F.xxhash64(id_col).alias("_key"), F.col(text_col).cast("string").alias("_text"))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            chosen = np.isin(batch.column(0).to_numpy(), targets)
            for piece in words(batch.column(1), ALNUM):
                bucket, row = _grams(piece)
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[chosen[piece.first_row + row]], minlength=BUCKETS)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (used, raw[used], target[used])], names=["bucket", "raw", "target"])
    sums = picked.mapInArrow(run, "bucket bigint, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    counts = np.zeros((2, BUCKETS))
    for k, name in enumerate(("target", "raw")):
        counts[k, sums["bucket"].to_numpy()] = sums[name].to_numpy()
    model = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    return np.log(model[0] / model[1]).astype(np.float32)


def weights(docs: DataFrame, ratio: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """``id_col, log_weight, n_grams`` for every row."""
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    handle = docs.sparkSession.sparkContext.broadcast(ratio)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, count = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for piece in words(batch.column(1), ALNUM):
                bucket, row = _grams(piece)
                mine = slice(piece.first_row, piece.first_row + piece.rows)
                total[mine] = np.bincount(row, handle.value[bucket], piece.rows)
                count[mine] = np.bincount(row, minlength=piece.rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(count)], names=["_id", "log_weight", "n_grams"])
    return picked.mapInArrow(run, f"_id {picked.schema['_id'].dataType.simpleString()}, log_weight double, n_grams bigint").withColumnRenamed("_id", id_col)


def resampled(docs: DataFrame, labels: DataFrame, is_target: Column, is_labelled: Column | None = None, k: int | None = None, id_col: str = "doc_id",
              text_col: str = "text", seed: int = SEED) -> DataFrame:
    """``id_col, log_weight, n_grams, gumbel_key, rank, kept`` for every row of ``docs``.

    The ``k`` rows with the largest key are kept; without ``k`` it is the share of target rows among the
    labelled ones, of all rows.  A null or empty text has weight 0 like one whose n-grams are as likely
    in either model; equal keys (repeated rows) are ordered by id; without target rows every weight is
    that of a uniform target; an empty table gives no rows; other columns are ignored.
    """
    ratio = log_ratio(docs, target_keys(labels, id_col, is_target), id_col, text_col)
    if k is None:
        known = labels.filter(is_labelled) if is_labelled is not None else labels
        share = known.agg(F.avg(F.when(is_target, 1.0).otherwise(0.0))).first()[0] or 0.0
        k = round(share * docs.count())
    uniform = (F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    keyed = weights(docs, ratio, id_col, text_col).withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))
    ranked = global_rank(keyed, [F.col("gumbel_key").desc(), F.col(id_col)], "rank")
    return ranked.withColumn("kept", F.col("rank") <= k)
