"""The prefix trie of conversations, measured with the Euler-tour technique.

Every turn is hashed with its position; running sums of these hashes name each prefix, so the nodes of
the trie are one aggregation over all (conversation, prefix) rows.  Nodes are numbered so that siblings
follow each other.  Each node then has an enter and an exit arc, and every arc knows the next one of the
tour from its own node alone.  List ranking turns that chain into positions: in each round the arcs whose
random weight exceeds both neighbours' leave the chain, which drops a third of it whatever its shape,
and what has left is put back in reverse order.  In tour order a subtree is the stretch between a node's
two arcs, so its leaves and savings are differences of running sums.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import grouped_rank
from ..operators.skew import salted_join
from ..session import Ledger, is_empty, settle

#: Arcs that one task may walk; a longer chain is contracted further.
WALK = 4096
#: Turns that a conversation can take over from another one.
SHARED = 8
#: Ids of one node that are joined to one piece of text.
CHUNK_IDS = 1 << 14
_HALF = 1 << 32


def running_sums(df: DataFrame, by: Sequence[str], order: Sequence[Column], values: dict[str, Column]) -> DataFrame:
    """``df`` with running totals per group in ``order`` (unique within a group).  Groups are split over
    range partitions; what the earlier parts of a group hold is one row per range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in by]
    ranged = settle(df.withColumns(values).repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part", *by).agg(*(F.sum(c).alias(f"_t_{c}") for c in values))
    # Only the first group of a range can have begun in an earlier one.
    group = F.struct(F.lit(0).alias("_all"), *keys)
    first = ranged.groupBy("_part").agg(F.min(group).alias("_g")).select("_g").distinct()
    earlier = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = (totals.withColumn("_g", group).join(F.broadcast(first), "_g", "left_semi")
              .withColumns({f"_t_{c}": F.sum(f"_t_{c}").over(earlier) for c in values}).select("_part", *by, *(f"_t_{c}" for c in values)))
    within = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (ranged.withColumns({c: F.sum(c).over(within) for c in values}).join(F.broadcast(before), ["_part", *by], "left")
            .withColumns({c: F.col(c) + F.coalesce(f"_t_{c}", F.lit(0)) for c in values}).drop("_part", *(f"_t_{c}" for c in values)))


def turns_of(table: DataFrame) -> DataFrame:
    """``conv_id, number, code, bytes``: the turns of every conversation, numbered from 0.  ``code`` stands
    for role and text; turns with one number are ordered by it."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    named = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    turns = settle(table.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.unhex(named).alias("code"),
        F.octet_length(text).cast("bigint").alias("bytes"), F.monotonically_increasing_id().alias("_n")))
    ranked = grouped_rank(turns, "conv_id", [F.col("turn").asc_nulls_first(), F.col("code"), F.col("_n")], "number")
    return ranked.select("conv_id", (F.col("number") - 1).alias("number"), "code", "bytes", "_n")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, place, code, bytes`` of rebuilt conversations, and ``conv_id, total`` of all of them.

    Conversation c takes the first h turns of conversation c - c % 5 (as many as there are), then its own
    ones after its first h; h is the CRC-32 of its number, modulo ``SHARED`` + 1.
    """
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = settle(sizes.withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED + 1), "base": F.col("conv_id") - F.col("conv_id") % 5}))
    bases = sizes.filter("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("_base_n"))
    convs = sizes.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("_base_n", F.lit(0))))
    convs = settle(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")))
    own = salted_join(convs.select("conv_id", "h", "taken"), turns, ["conv_id"], "_n").filter("number >= h")
    own = own.select("conv_id", (F.col("taken") + F.col("number") - F.col("h")).alias("place"), "code", "bytes")
    head = turns.filter((F.col("number") < SHARED) & (F.col("conv_id") % 5 == 0)).select(F.col("conv_id").alias("base"), "number", "code", "bytes")
    lent = convs.select("conv_id", "base", "taken").join(head, "base").filter("number < taken").select("conv_id", F.col("number").alias("place"), "code", "bytes")
    return own.unionByName(lent), convs.select("conv_id", "total")


def _names(parts: Sequence[Column]) -> list[Column]:
    """Two 64-bit halves of a prefix name from four 32-bit sums."""
    low = [F.pmod(p, F.lit(_HALF)) for p in parts]
    return [F.shiftleft(low[i], 32).bitwiseOR(low[i + 1]) for i in (0, 2)]


def memberships(rows: DataFrame) -> DataFrame:
    """``conv_id, depth, a, b, up_a, up_b, bytes``: a row for every prefix (but the empty one) of every
    conversation, with its name ``a, b`` and that of the prefix one turn shorter."""
    sums = [f"_s{i}" for i in range(4)]
    own = {f"_v{i}": F.pmod(F.xxhash64(F.lit(i), "code", "place"), F.lit(_HALF)) for i in range(4)}
    summed = running_sums(rows.withColumns(own), ["conv_id"], [F.col("place")], {s: F.col(f"_v{i}") for i, s in enumerate(sums)})
    a, b = _names([F.col(s) for s in sums])
    up_a, up_b = _names([F.col(s) - F.col(f"_v{i}") for i, s in enumerate(sums)])
    return summed.select("conv_id", (F.col("place") + 1).alias("depth"), a.alias("a"), b.alias("b"), up_a.alias("up_a"), up_b.alias("up_b"), "bytes")


def digests(ends: DataFrame) -> DataFrame:
    """``a, b, ends_sha256``: SHA-256 of the ascending, comma-joined ``conv_id`` of each node.

    The ids of a node are sorted over range partitions and joined to texts of bounded size where they
    lie; a task reads these texts one after the other.  SHA-256 is a chain, so the texts of one node have
    to pass through one task, but only they, and never all at once.
    """
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_IDS):
                out: dict = {}
                for a, b, conv in zip(*(c.to_pylist() for c in batch.slice(at, CHUNK_IDS).columns)):
                    out.setdefault((a, b), []).append(conv)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.int64()), pa.array([k[1] for k in out], pa.int64()), pa.array([v[0] for v in out.values()], pa.int64()),
                                                  pa.array([",".join(map(str, v)) for v in out.values()], pa.string())], names=["a", "b", "first", "ids"])
    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids"))):
                if (a, b) == node:
                    state.update(b",")
                else:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = (a, b), hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["a", "b", "ends_sha256"])
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], names=["a", "b", "ends_sha256"])
    joined = ends.select("a", "b", "conv_id").repartitionByRange(parts, "a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id").mapInArrow(join_ids, "a bigint, b bigint, first bigint, ids string")
    return joined.repartition(parts, "a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(chain, "a bigint, b bigint, ends_sha256 string")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = {arc: (after, size) for batch in batches for arc, after, size in zip(*(c.to_pylist() for c in batch.columns))}
    if not rows:
        return
    (at,) = rows.keys() - {after for after, _ in rows.values()}
    order = [at]
    while (at := rows[at][0]) is not None:
        order.append(at)
    left = list(itertools.accumulate(rows[a][1] for a in reversed(order)))
    yield pa.RecordBatch.from_arrays([pa.array(order[::-1], pa.int64()), pa.array(left, pa.int64())], names=["arc", "left"])


def list_ranks(chain: DataFrame) -> DataFrame:
    """``arc, left`` for one chain ``arc, after`` (null at its end): how many arcs from it on there are.

    ``size`` counts the arcs from an arc on to the next one that is still there.  An arc leaves if its
    weight exceeds that of both neighbours; it tells the one before it its size and both who is next.
    """
    back = chain.filter("after IS NOT NULL").select(F.col("after").alias("arc"), F.col("arc").alias("before"))
    state = settle(chain.join(back, "arc", "left").select("arc", "before", "after", F.lit(1).cast("bigint").alias("size")))
    gone: list[DataFrame] = []
    for seed in itertools.count():
        if state.count() <= WALK:
            break
        weight = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(seed)), F.col(c))  # noqa: B023, E731
        leaves = F.coalesce((weight("arc") > weight("before")) & (weight("arc") > weight("after")) & F.col("before").isNotNull() & F.col("after").isNotNull(), F.lit(False))
        marked = state.withColumn("leaves", leaves)
        none = F.lit(None).cast("bigint")
        told = F.explode(F.when(F.col("leaves"), F.array(
            F.struct(F.col("before").alias("arc"), none.alias("before"), none.alias("after"), none.alias("size"), none.alias("new_before"), F.col("after").alias("new_after"), F.col("size").alias("more")),
            F.struct(F.col("after").alias("arc"), none.alias("before"), none.alias("after"), none.alias("size"), F.col("before").alias("new_before"), none.alias("new_after"), none.alias("more"))))
            .otherwise(F.array(F.struct("arc", "before", "after", "size", none.alias("new_before"), none.alias("new_after"), none.alias("more")))))
        gone.append(settle(marked.filter("leaves").select("arc", "after", "size")))
        rows = marked.select(told.alias("t")).select("t.*").groupBy("arc").agg(*(F.max(c).alias(c) for c in ("before", "after", "size", "new_before", "new_after", "more")))
        state = settle(rows.select("arc", F.coalesce("new_before", "before").alias("before"), F.coalesce("new_after", "after").alias("after"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
    known = Ledger(chain.sparkSession)
    known.add(state.select("arc", "after", "size").repartition(1).mapInArrow(_walk, "arc bigint, left bigint"))
    for part in reversed(gone):
        known.add(part.join(known.read().withColumnRenamed("arc", "after"), "after").select("arc", (F.col("size") + F.col("left")).alias("left")))
    return known.read()


def prefix_trie(table: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``: one row
    per node of the trie of rebuilt conversations.

    Conversations are ordered by turn, null first; turns with one number by the SHA-256 of role and text,
    repeated rows stay.  Null roles and texts are empty; rows without a ``conv_id`` belong to no
    conversation; an empty table has no nodes, not even a root; other columns are ignored.
    """
    rows, convs = rebuilt(settle(turns_of(table)))
    # The root has the name of the empty prefix and, as a child, a parent that cannot be a name of any node.
    root = convs.select("conv_id", F.lit(0).cast("bigint").alias("depth"), *(F.lit(0).cast("bigint").alias(c) for c in ("a", "b")), *(F.lit(None).cast("bigint").alias(c) for c in ("up_a", "up_b")), F.lit(0).cast("bigint").alias("bytes"))
    members = settle(memberships(rows).unionByName(root))
    nodes = members.groupBy("depth", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"), F.max("up_a").alias("up_a"), F.max("up_b").alias("up_b"))
    # Siblings get consecutive numbers, so only the last one of them needs to know its parent.
    nodes = settle(running_sums(nodes, [], [F.col("up_a").asc_nulls_first(), F.col("up_b").asc_nulls_first(), F.col("a"), F.col("b")], {"id": F.lit(1)}).withColumn("id", F.col("id").cast("bigint")))
    if is_empty(nodes):
        return nodes.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), "n_convs", *(F.col("id").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")), F.lit("").alias("ends_sha256"))
    kids = nodes.filter("depth > 0").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n_children"))
    nodes = settle(nodes.join(kids, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("bigint")))
    parents = nodes.filter("n_children > 0").select(F.col("last").alias("id"), F.col("id").alias("parent"))
    enter, leave = (lambda c: F.col(c) * 2), (lambda c: F.col(c) * 2 + 1)
    arcs = nodes.select("id", "depth", "first").join(parents, "id", "left").select(F.explode(F.array(
        F.struct(enter("id").alias("arc"), F.coalesce(enter("first"), leave("id")).alias("after")),
        F.struct(leave("id").alias("arc"), F.when(F.col("depth") > 0, F.coalesce(leave("parent"), enter("id") + 2)).alias("after")))).alias("t")).select("t.*")
    ranks = list_ranks(settle(arcs))
    own = nodes.select("id", (F.col("n_children") == 0).cast("bigint").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    placed = ranks.select(F.floor(F.col("arc") / 2).cast("bigint").alias("id"), (F.col("arc") % 2).alias("exit"), (-F.col("left")).alias("position")).join(own, "id")
    at_enter = lambda c: F.when(F.col("exit") == 0, F.col(c)).otherwise(0)
    summed = running_sums(placed, [], [F.col("position")], {"leaves": at_enter("leaf"), "savings": at_enter("saved")})
    # The sum at the exit less the one before the entry.
    sign = F.when(F.col("exit") == 1, 1).otherwise(-1)
    tops = summed.groupBy("id").agg(F.sum(F.col("leaves") * sign + at_enter("leaf")).cast("bigint").alias("n_leaves"), F.sum(F.col("savings") * sign + at_enter("saved")).cast("bigint").alias("saved_tokens"))
    ends = members.join(convs.withColumnRenamed("total", "depth"), ["conv_id", "depth"])
    nodes = nodes.join(tops, "id").join(digests(ends), ["a", "b"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    nodes = settle(nodes)
    above = nodes.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    below = salted_join(above, nodes.filter("depth > 0"), ["up_a", "up_b"], "id").select(columns)
    return below.unionByName(nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint")).select(columns))
