"""Total orders over whole tables without a single-task window.

A table is range-partitioned on a *unique* key, so a hot value is split by its tie-breaker; each
range is numbered on its own and shifted by the sizes of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle


def _ranges(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order)
    # The range bounds are sampled, so the part number is only stable once it is written.
    return settle(ranged.withColumn("_part", F.spark_partition_id()))


def _offsets(ranged: DataFrame, total: Column) -> DataFrame:
    """Sum of ``total`` over all earlier ranges: one row per range, so always small."""
    sums = ranged.groupBy("_part").agg(total.alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank", start: int = 1) -> DataFrame:
    """Number all rows by ``order`` (which must end in a unique key), starting at ``start``."""
    ranged = _ranges(df, order)
    within = Window.partitionBy("_part").orderBy(*order)
    numbered = ranged.withColumn("_row", F.row_number().over(within))
    return (
        numbered.join(F.broadcast(_offsets(ranged, F.count(F.lit(1)))), "_part")
        .withColumn(name, (F.col("_row") + F.col("_before") - 1 + start).cast("bigint"))
        .drop("_part", "_row", "_before")
    )


def global_running_sum(df: DataFrame, order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """Running total of ``value`` over the whole table in ``order`` (unique)."""
    ranged = _ranges(df.withColumn("_value", value), order)
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.withColumn("_run", F.sum("_value").over(within))
        .join(F.broadcast(_offsets(ranged, F.sum("_value"))), "_part")
        .withColumn(name, F.col("_run") + F.col("_before"))
        .drop("_part", "_run", "_before", "_value")
    )


def rank_cut(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Exactly the first ``n`` rows by ``order`` (unique): whole ranges below the cut are kept
    without sorting and only the range that holds the cut is ranked."""
    if n <= 0:
        return df.limit(0)
    ranged = _ranges(df, order)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    plan = sizes.select("_part", "_size", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    marked = ranged.join(F.broadcast(plan), "_part").filter(F.col("_before") < n)
    whole = marked.filter(F.col("_before") + F.col("_size") <= n)
    cut = (
        marked.filter(F.col("_before") + F.col("_size") > n)
        .withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
        .filter(F.col("_row") + F.col("_before") <= n).drop("_row")
    )
    return whole.unionByName(cut).drop("_part", "_size", "_before")


def dense_ids(df: DataFrame, key: str, name: str = "dense_id") -> DataFrame:
    """Contiguous ids from 0 for the distinct values of ``key``, in key order."""
    return global_rank(df.select(key).distinct(), [F.col(key)], name, start=0)


def grouped_rank(df: DataFrame, by: str, order: Sequence[Column], name: str = "position") -> DataFrame:
    """``row_number`` per group that also splits a group over many tasks.

    Rows are range-partitioned by (group, order); only the first group of a range can have begun in
    an earlier one, so the shifts to add are at most one row per range.
    """
    ranged = _ranges(df, [F.col(by), *order])
    counts = ranged.groupBy("_part", by).agg(F.count(F.lit(1)).alias("_n"))
    firsts = ranged.groupBy("_part").agg(F.min(by).alias(by))
    earlier = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        counts.join(F.broadcast(firsts.select(by).distinct()), by, "left_semi")
        .withColumn("_shift", F.sum("_n").over(earlier)).filter("_shift IS NOT NULL").select("_part", by, "_shift")
    )
    within = Window.partitionBy("_part", by).orderBy(*order)
    return (
        ranged.withColumn("_row", F.row_number().over(within)).join(F.broadcast(shifts), ["_part", by], "left")
        .withColumn(name, (F.col("_row") + F.coalesce("_shift", F.lit(0))).cast("bigint")).drop("_part", "_row", "_shift")
    )
