"""Arrival processes as Structured Streaming: gated ingest, content de-duplication, job outcomes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.provenance import expectation_gate


def stream_ingest_gate(stream: DataFrame, rules: Mapping[str, Column], good: str, quarantine: str, checkpoint: str) -> StreamingQuery:
    """Validate rows before they become visible.  Each micro-batch is written under its own batch
    number, so a batch that is replayed after a failure overwrites itself instead of doubling."""
    gated = expectation_gate(stream, rules)

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.filter("published").drop("failed_rules", "published").write.mode("overwrite").parquet(f"{good}/batch={number}")
        batch.filter(~F.col("published")).drop("published").write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        batch.unpersist()

    return gated.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_dedup(stream: DataFrame, content: str, time: str, delay: str) -> DataFrame:
    """First row per SHA-256 within the watermark.  Keys are kept only for ``delay``: a copy that
    arrives later than that passes again, which bounds the state."""
    hashed = stream.withColumn("sha256", F.sha2(F.col(content), 256))
    return hashed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["sha256"])


def stream_job_outcomes(stream: DataFrame, time: str, state: str, width: str, delay: str) -> DataFrame:
    """Counts by window and state; rows later than ``delay`` are dropped and appear in the
    ``numRowsDroppedByWatermark`` progress metric."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), state).agg(F.count(F.lit(1)).alias("jobs")) \
        .select(F.col("window.start").alias("window_start"), state, "jobs")


def late_rows(stream: DataFrame, time: str, width: str, delay: str, late: str, marks: str, checkpoint: str) -> StreamingQuery:
    """Keep the rows that ``stream_job_outcomes`` drops: those whose window has closed when they come.

    Spark drops by the watermark that the batch before had: the latest event time of all batches before
    that one, less ``delay``.  Each batch leaves its own latest time under its number in ``marks``, so a
    batch that is replayed after a failure finds the same watermark and overwrites its own rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        batch.agg(F.max(time).alias("latest"), F.lit(number).cast("bigint").alias("number")).write.mode("overwrite").parquet(f"{marks}/batch={number}")
        before = spark.read.schema("latest timestamp, number bigint").option("recursiveFileLookup", "true").parquet(marks).filter(F.col("number") < number - 1)
        edge = before.agg((F.max("latest") - F.expr(f"INTERVAL {delay}")).alias("_edge"))
        closing = batch.withColumn("_end", F.window(time, width)["end"]).withColumn("_one", F.lit(1)).join(F.broadcast(edge.withColumn("_one", F.lit(1))), "_one")
        closing.filter(F.col("_end") <= F.col("_edge")).select(batch.columns).write.mode("overwrite").parquet(f"{late}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dropped_rows(query: StreamingQuery) -> int:
    """Rows (after partial aggregation) that the query's state has refused as late, over all its batches."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain what is available into Parquet and return it as a table."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
