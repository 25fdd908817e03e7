"""The stream operators drained over the given tables; each equals its batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import working_dir
from ..streaming import jobs as st
from . import inputs as i
from .registry import query


def _stream(spark, sf, name):
    """The table as a stream, whether it is one file or a folder of part files.  A stream takes a plain path
    for a folder; a pattern may match either."""
    schema = i.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def _space(spark):
    base = f"{working_dir(spark)}/stratalith-stream/{uuid.uuid4().hex}"
    return [f"{base}/{n}" for n in ("out", "rejected", "checkpoint")]


@query("w1_stream_ingest_gate", "SELECT event_id, event_type, value FROM events WHERE value >= 1 AND event_type <> 'error' AND user_id IS NOT NULL")
def w1_stream_ingest_gate(spark, sf):
    good, bad, mark = _space(spark)
    rules = {"value": F.col("value") >= 1, "type": F.col("event_type") != "error", "user": F.col("user_id").isNotNull()}
    stream = _stream(spark, sf, "events")
    st.stream_ingest_gate(stream, rules, good, bad, mark).awaitTermination()
    return spark.read.schema(stream.schema).parquet(good).select("event_id", "event_type", "value")


@query("w2_stream_dedup", "SELECT DISTINCT sha256(text) AS sha256 FROM documents")
def w2_stream_dedup(spark, sf):
    out, _, mark = _space(spark)
    stream = _stream(spark, sf, "documents").withColumn("arrived", F.lit("2024-01-01").cast("timestamp"))
    return st.run_once(st.stream_dedup(stream, "text", "arrived", "1 hour").select("sha256"), out, mark)


_ARRIVALS = """a AS (SELECT *, CASE event_id % 10 WHEN 7 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS file FROM events),
  m AS (SELECT max(ts) - INTERVAL 1 DAY AS edge FROM a WHERE file = 0), z AS (SELECT max(ts) - INTERVAL 1 DAY AS edge FROM events),
  r AS (SELECT a.*, time_bucket(INTERVAL '1 hour', ts) AS window_start, file = 2 AND time_bucket(INTERVAL '1 hour', ts) + INTERVAL 1 HOUR <= m.edge AS late FROM a, m)"""


def _arrivals(spark, sf, base):
    """Events as three files that come one after the other; the last holds every tenth event, most of them late."""
    events = i.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    turn = F.when(F.col("event_id") % 10 == 7, 1).when(F.col("event_id") % 10 == 3, 2).otherwise(0)
    for number in range(3):
        events.filter(turn == number).coalesce(1).write.mode("append").parquet(f"{base}/arrivals")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{base}/arrivals")


@query("w3_closed_windows", f"""WITH {_ARRIVALS} SELECT window_start, event_type, count(*) AS jobs FROM r, z WHERE NOT late AND window_start + INTERVAL 1 HOUR <= z.edge GROUP BY ALL""")
def w3_closed_windows(spark, sf):
    """Append mode: a window is reported once it has closed, without what came after that."""
    out, base, mark = _space(spark)
    return st.run_once(st.stream_job_outcomes(_arrivals(spark, sf, base), "ts", "event_type", "1 hour", "1 day"), out, mark) \
        .withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("w3_late_rows", f"WITH {_ARRIVALS} SELECT event_id, event_type, window_start FROM r WHERE late")
def w3_late_rows(spark, sf):
    """The side table of what the closed windows leave out."""
    out, base, mark = _space(spark)
    stream = _arrivals(spark, sf, base)
    st.late_rows(stream, "ts", "1 hour", "1 day", out, f"{base}/marks", mark).awaitTermination()
    found = spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(out)
    return found.select("event_id", "event_type", F.window("ts", "1 hour")["start"].cast("timestamp_ntz").alias("window_start"))


@query("w3_stream_job_outcomes", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS jobs FROM events GROUP BY ALL")
def w3_stream_job_outcomes(spark, sf):
    """Complete mode, so the last open window is reported too; every batch replaces the table."""
    out, _, mark = _space(spark)
    events = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = st.stream_job_outcomes(events, "ts", "event_type", "1 hour", "1 day")
    q = stream.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).outputMode("complete") \
        .option("checkpointLocation", mark).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
