"""Session defaults and the one way this library cuts lineage.

Loops write each round to a Parquet table in the shared folder that the cluster names in
``spark.checkpoint.dir`` and read it back.  The table survives lost executors, is computed once,
and gives Catalyst real sizes for its next join choice.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


# Spatial joins do much work per byte, so small shuffles should still use every core.
_RUNTIME = {
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "32k",
    "spark.sql.files.openCostInBytes": "65536",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession, measured: bool = False) -> SparkSession:
    """Set the runtime options the operators are written for, unless the session already has them.

    With ``measured``, joins are broadcast only by the size that a side turns out to have, at the session's
    own limit.  Before a side is read, Catalyst knows packed file sizes and counts one row for every row that
    ``explode`` makes, so tables of any size pass as small and go through the driver.
    """
    for key, value in _RUNTIME.items():
        if key not in _explicit(spark):
            spark.conf.set(key, value)
    planned, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    limit, kept = spark.conf.get(planned), spark.conf.get(adaptive, None)
    if measured and limit != "-1":
        if adaptive not in _explicit(spark):
            spark.conf.set(adaptive, limit)
        spark.conf.set(planned, "-1")
    elif not measured and limit == "-1" and kept and planned not in {k for k, v in spark.sparkContext.getConf().getAll() if v == "-1"}:
        spark.conf.set(planned, kept)
    return spark


def _explicit(spark: SparkSession) -> set[str]:
    return {key for key, _ in spark.sparkContext.getConf().getAll()}


def get_session(app: str = "stratalith", cpus: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def working_dir(spark: SparkSession) -> str:
    """The shared folder for tables written between rounds.

    Only a ``local`` master may fall back to a temporary folder; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = context.applicationId
    if key not in _local_dirs:
        _local_dirs[key] = tempfile.mkdtemp(prefix="spark-stratalith-", dir="/tmp")
        atexit.register(shutil.rmtree, _local_dirs[key], True)
    return _local_dirs[key]


def _tables_dir(spark: SparkSession) -> str:
    return f"{working_dir(spark)}/stratalith/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Remove every table that this application has settled.  Call it once the results are stored:
    DataFrames returned before read from those tables."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of a cluster where it is not installed."""
    package = os.path.dirname(os.path.abspath(__file__))
    with tempfile.TemporaryDirectory() as place:
        archive = shutil.make_archive(os.path.join(place, "stratalith"), "zip", os.path.dirname(package), os.path.basename(package))
        spark.sparkContext.addPyFile(archive)


def settle(df: DataFrame, *partition_hint: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a DataFrame that reads it back."""
    spark = df.sparkSession
    path = f"{_tables_dir(spark)}/{uuid.uuid4().hex}"
    if partition_hint:
        df = df.repartition(*partition_hint)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_bytes(df: DataFrame) -> int:
    """What Spark knows of the size of a settled table: the bytes of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


class Ledger:
    """A table that grows from round to round: each part is written once, and a read sees all parts so
    far as one scan, so a plan does not grow with the number of rounds."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path, self.schema = spark, f"{_tables_dir(spark)}/{uuid.uuid4().hex}", None

    def add(self, part: DataFrame) -> None:
        part.write.mode("append").parquet(self.path)
        self.schema = part.schema

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def spread(df: DataFrame) -> DataFrame:
    """Give heavy per-row work every core when the input arrives in too few pieces (one small file).
    Tables that already have enough partitions are left alone, so nothing is shuffled at scale."""
    width = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(width) if df.rdd.getNumPartitions() < width else df
