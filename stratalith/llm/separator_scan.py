"""Token counts from flat token files that carry no index.

A token file is nothing but the ids of one document after another, each ended by a separator id.
Files are read in blocks by many tasks; a block's separators come from one vectorised comparison.  A
prefix scan over the blocks of a file carries the number of documents and the place of the last
separator on, which stitches the documents that cross blocks.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import settle, working_dir
from .tokens import encoder

#: Tokens that one read takes.
BLOCK_TOKENS = 4 << 20
#: Bytes that a writer gathers before it writes.
BUFFER_BYTES = 4 << 20


def write_token_files(docs: DataFrame, folder: str, ranks: str, pattern: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
                      dtype: str = "<u2") -> DataFrame:
    """Write the ids of every text and ``end_id`` into one flat file per task of ``folder``, which all
    executors share.  Returns ``file, ordinal, id_col``: whose document stands at which place.

    Names carry the task attempt, so a task that runs again leaves files that no row names.
    """
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    end = np.array([end_id], dtype).tobytes()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encode = TaskContext.get(), encoder(ranks, pattern)
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        name, ordinal, out, waiting = f"tokens-{task.partitionId():06d}-{task.taskAttemptId()}.bin", 0, None, bytearray()
        for batch in batches:
            if out is None and batch.num_rows:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(f"{base}/{name}")
            for text in batch.column(1):
                waiting += np.frombuffer(encode.ids(text.as_py()), "<u4").astype(dtype).tobytes() + end
                if len(waiting) > BUFFER_BYTES:
                    out.write(bytes(waiting))
                    waiting.clear()
            names = pa.array([name] * batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([names, pa.array(np.arange(ordinal, ordinal + batch.num_rows)), batch.column(0)], names=["file", "ordinal", "_id"])
            ordinal += batch.num_rows
        if out is not None:
            out.write(bytes(waiting))
            out.close()
    return picked.mapInArrow(run, f"file string, ordinal bigint, _id {picked.schema['_id'].dataType.simpleString()}").withColumnRenamed("_id", id_col)


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``file, bytes`` of a folder, listed by Spark's reader without reading the contents."""
    return spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))


def scan(files: DataFrame, folder: str, end_id: int, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``file, ordinal, start, n_tokens, ended`` of every document in the ``file, bytes`` rows.

    ``n_tokens`` excludes the separator.  Ids after the last separator of a file are a document that has
    not ended; two separators in a row enclose an empty one; an empty file has none; an incomplete id at
    the end of a file is ignored.
    """
    width = np.dtype(dtype).itemsize
    sized = files.select("file", F.floor(F.col("bytes") / width).alias("tokens")).filter("tokens > 0")
    blocks = sized.select("file", "tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("tokens") - 1) / block_tokens))).alias("block"))
    spread = max(1, files.sparkSession.sparkContext.defaultParallelism)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, tokens, block in zip(*(c.to_pylist() for c in batch.columns)):
                first = block * block_tokens
                with store.open_input_file(f"{base}/{name}") as source:
                    ids = np.frombuffer(source.read_at(width * min(block_tokens, tokens - first), width * first), dtype)
                at = np.flatnonzero(ids == end_id) + first
                length = np.diff(at, prepend=-1) - 1
                known = np.arange(len(at)) > 0  # the first document of a block may begin in an earlier one
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(np.full(len(at), block)), pa.array(np.arange(len(at))), pa.array(at),
                                                  pa.array(length, pa.int64(), mask=~known)], names=["file", "block", "k", "at", "inner"])
    ends = settle(blocks.repartition(spread).mapInArrow(run, "file string, block bigint, k bigint, at bigint, inner bigint"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (ends.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last"))
               .select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("carry")))
    whole = (ends.join(carried, ["file", "block"])
             .select("file", (F.col("before") + F.col("k")).alias("ordinal"), F.coalesce("inner", F.col("at") - F.col("carry") - 1).alias("n_tokens"), "at")
             .select("file", "ordinal", (F.col("at") - F.col("n_tokens")).alias("start"), "n_tokens", F.lit(True).alias("ended")))
    last = ends.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last"))
    open_end = (sized.join(last, "file", "left").select("file", F.coalesce("n", F.lit(0)).alias("ordinal"), (F.coalesce("last", F.lit(-1)) + 1).alias("start"), "tokens")
                .select("file", "ordinal", "start", (F.col("tokens") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended")).filter("n_tokens > 0"))
    return whole.unionByName(open_end)


def counted_documents(docs: DataFrame, ranks: str, pattern: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", waves: int = 2) -> DataFrame:
    """``id_col, n_tokens`` for every row of ``docs``, by writing token files and scanning them.

    The files of one wave (rows by a hash of their id) are removed before the next is written, so the
    disk holds one of ``waves`` parts at a time.  Null and empty texts count 0; repeated rows are each
    counted; an empty table gives no rows; other columns are ignored.
    """
    spark, out = docs.sparkSession, None
    for wave in range(waves):
        folder = f"{working_dir(spark)}/tokens-{uuid.uuid4().hex}"
        mine = docs.select(id_col, text_col).filter(F.pmod(F.xxhash64(id_col), F.lit(waves)) == wave)
        owners = settle(write_token_files(mine, folder, ranks, pattern, end_id, id_col, text_col))
        names = owners.select("file").distinct()
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        if owners.limit(1).count():
            found = scan(token_files(spark, folder).join(names, "file", "left_semi"), folder, end_id)
            part = settle(owners.join(found.filter("ended"), ["file", "ordinal"]).select(id_col, "n_tokens"))
        else:
            part = owners.select(id_col, F.lit(0).cast("bigint").alias("n_tokens"))
        with contextlib.suppress(FileNotFoundError):
            store.delete_dir(base)
        out = part if out is None else out.unionByName(part)
    return out
