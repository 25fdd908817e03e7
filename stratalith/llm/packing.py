"""Best-fit packing of token pieces into sequences, by bulk-synchronous rounds.

Each round range-sorts the open gaps and the unplaced items together by falling size and sweeps over
them: a gap counts +1, an item -1, and an item belongs to the latest gap before it that no larger item
has taken, which is the smallest gap that still holds it.  Running sums over the ranges give every row
its level; on one level gaps and items alternate, so the item's gap is the row before it.  Equal sizes
are told apart by rank.  Then gaps shrink, and new sequences open where a lower bound on the need says so.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import global_running_sum
from ..session import Ledger, settle
from .batches import trimmed
from .tokens import encoder


def pieces(docs: DataFrame, ranks: str, pattern: str, capacity: int, id_col: str = "doc_id", text_col: str = "text",
           end_id: int = 0) -> DataFrame:
    """``id_col, piece, start, length, ids_crc32``: the ids of each whole text and ``end_id``, cut only
    where they are longer than ``capacity``; then the first piece is the shorter one.  A null or empty
    text is ``end_id`` alone."""
    end = end_id.to_bytes(4, "little")
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks, pattern)
        for batch in batches:
            owner, out = [], []
            for row, text in enumerate(batch.column(1)):
                ids = encode.ids(text.as_py()) + end
                total = len(ids) // 4
                starts = [0, *range(total % capacity or capacity, total, capacity)]
                for k, (low, high) in enumerate(zip(starts, [*starts[1:], total])):
                    owner.append(row)
                    out.append((k, low, high - low, zlib.crc32(ids[4 * low:4 * high])))
            columns = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *columns], names=["_id", "piece", "start", "length", "ids_crc32"])
    schema = f"_id {picked.schema['_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return picked.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def _chained(items: DataFrame, least: int, width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Items of at most ``least`` become chains of less than ``least + width`` (``width`` is ``least``
    unless given), so that a sequence takes a bounded number of rounds.  Returns the items to place and
    ``n, chain, inside`` of the chained ones."""
    width = width or least
    tiny = global_running_sum(items.filter(F.col("length") <= least), [F.col("length").desc(), F.col("n")], F.col("length"), "reached")
    tiny = tiny.withColumn("_chain", F.floor((F.col("reached") - F.col("length")) / width))
    order = Window.partitionBy("_chain").orderBy("reached")
    inside = settle(tiny.select("n", "length", (F.sum("length").over(order) - F.col("length")).alias("inside"), F.first("n").over(order).alias("chain")))
    chains = inside.groupBy(F.col("chain").alias("n")).agg(F.sum("length").alias("length"))
    return items.filter(F.col("length") > least).unionByName(chains), inside.select("n", "chain", "inside")


def _sweep(rows: DataFrame) -> DataFrame:
    """``mate, mate_size`` for ``item, id, size, at`` rows: an item's gap, a gap's item, or null."""
    order = [F.col("size").desc(), F.col("item"), F.col("id")]
    swept = global_running_sum(rows, order, F.when(F.col("item") == 0, 1).otherwise(-1), "depth")
    level = Window.partitionBy("level").orderBy(*order)
    swept = swept.withColumn("level", F.col("depth") + F.col("item"))
    beside = F.when(F.col("item") == 1, F.lag(F.struct("item", "id", "size", "at")).over(level)).otherwise(F.lead(F.struct("item", "id", "size", "at")).over(level))
    swept = swept.withColumn("beside", beside).withColumn("paired", F.coalesce(F.col("beside.item") != F.col("item"), F.lit(False)))
    return swept.select("item", "id", "size", "at", *(F.when(F.col("paired"), F.col(f"beside.{c}")).alias(f"mate_{c}") for c in ("id", "size", "at")))


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """``n, sequence_id, offset`` for items ``n`` (unique bigint) and ``length`` (1 to ``capacity``).

    No sequence exceeds the capacity and offsets leave no hole.  An empty table gives no rows; items of
    equal length are taken by ``n``.
    """
    spark, half = items.sparkSession, capacity // 2
    items, inside = _chained(items, max(1, capacity // 32))
    items, chains = settle(items), [inside]
    # No two items above half the capacity share a sequence, so each opens one.
    placed = Ledger(spark)
    placed.add(items.filter(F.col("length") > half).select("n", F.col("n").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")))
    state = (items.filter(F.col("length") > half).select(F.lit(0).alias("item"), F.col("n").alias("id"), (capacity - F.col("length")).alias("size"), F.col("length").alias("at"))
             .unionByName(items.filter(F.col("length") <= half).select(F.lit(1).alias("item"), F.col("n").alias("id"), F.col("length").alias("size"), F.lit(0).cast("bigint").alias("at"))))
    opened, whole = -1, 0
    while True:
        # At most two rows per size up to the capacity come to the driver.
        sizes = [(r["item"], r["size"], r["n"]) for r in state.groupBy("item", "size").agg(F.count(F.lit(1)).alias("n")).collect()]
        wanted = {size: n for item, size, n in sizes if item == 1}
        whole = whole or sum(n * (size if item else capacity - size) for item, size, n in sizes)
        if not wanted:
            break
        least = min(wanted)
        free = {size: n for item, size, n in sizes if item == 0 and size >= least}
        state = state.filter((F.col("item") == 1) | (F.col("size") >= least))
        # What no open gap can hold, and what all of them together cannot, needs new sequences.
        left, room = (sum(s * n for s, n in x.items()) for x in (wanted, free))
        short = left - room
        over = sum(s * n for s, n in wanted.items() if s > max(free, default=0))
        fresh = max(-(-short // capacity), -(-over // capacity), 0)
        # A tail below a 256th of the whole that mostly needs new sequences goes in longer chains, of about
        # a quarter of a sequence; what these leave unused is a small part of that tail.
        tail = 256 * left < whole and 2 * room < left and 4 * max(wanted) <= capacity
        if tail or over and not any(s <= max(free, default=0) for s in wanted):
            # What is left goes to new sequences, in chains so that these fill in few rounds.
            least, width = (max(wanted), (capacity - max(wanted)) // 4) if tail else (capacity // 8, None)
            rest, inside = _chained(state.filter("item = 1").select(F.col("id").alias("n"), F.col("size").alias("length")), least, width)
            chains.append(inside)
            gaps = state.filter("item = 0") if tail else state.limit(0)
            state = gaps.unionByName(rest.select(F.lit(1).alias("item"), F.col("n").alias("id"), F.col("length").alias("size"), F.lit(0).cast("bigint").alias("at")))
        # New sequences have negative numbers, so they cannot meet an item's.
        new = spark.range(fresh).select(F.lit(0).alias("item"), (F.lit(opened) - F.col("id")).alias("id"), F.lit(capacity).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("at"))
        opened -= fresh
        swept = settle(_sweep(state.unionByName(new)))
        placed.add(swept.filter("item = 1 AND mate_id IS NOT NULL").select(F.col("id").alias("n"), F.col("mate_id").alias("sequence_id"), F.col("mate_at").alias("offset")))
        state = swept.filter("item = 0 OR mate_id IS NULL").select(
            "item", "id", (F.col("size") - F.when(F.col("item") == 0, F.coalesce("mate_size", F.lit(0))).otherwise(0)).alias("size"),
            (F.col("at") + F.when(F.col("item") == 0, F.coalesce("mate_size", F.lit(0))).otherwise(0)).alias("at"))
    out = placed.read()
    for inside in reversed(chains):
        members = inside.join(out.withColumnRenamed("n", "chain"), "chain").select("n", "sequence_id", (F.col("offset") + F.col("inside")).alias("offset"))
        out = settle(out.join(inside, "n", "left_anti").unionByName(members))
    return out


def packed_documents(docs: DataFrame, ranks: str, pattern: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, piece, start, length, ids_crc32, sequence_id, offset``: one row per piece of every row
    of ``docs``.  Null and empty texts are packed as their end id; repeated rows are packed each; an
    empty table gives no rows; other columns are ignored whatever their names."""
    cut = settle(pieces(docs, ranks, pattern, capacity, id_col, text_col).withColumn("_n", F.monotonically_increasing_id()))
    places = pack(cut.select(F.col("_n").alias("n"), "length"), capacity)
    return cut.join(places, cut["_n"] == places["n"]).drop("_n", "n")
