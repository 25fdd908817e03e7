"""Graph loops: every round is joins and aggregations, and only a stop flag reaches the driver."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Ledger, is_empty, settle

#: Pointer doubling passes any loop of a table within so many rounds: it would need 2**64 nodes.
DOUBLINGS = 64


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``node, component`` where the component is its smallest node.

    Random contraction: in every round each vertex moves to the neighbour (or itself) with the
    smallest hash under that round's seed, and the graph between the targets goes on.  A constant
    share of the vertices disappears per round whatever the shape of the graph, so long paths and
    huge stars both finish in a logarithmic number of rounds with linear work.
    """
    pairs = edges.select(F.col("a").alias("a"), F.col("b").alias("b")).filter(F.col("a") != F.col("b"))
    graph = settle(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    moves: list[DataFrame] = []
    for seed in itertools.count():
        if is_empty(graph):
            break
        weigh = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(seed)).alias("h"), F.col(c).alias("rep"))  # noqa: B023, E731
        best = graph.groupBy("a").agg(F.min(weigh("b")).alias("n"))
        move = settle(best.select("a", F.least(weigh("a"), F.col("n"))["rep"].alias("rep")))
        moves.append(move)
        half = graph.join(move, "a").select("rep", F.col("b").alias("a")).withColumnRenamed("rep", "left_rep")
        graph = settle(half.join(move, "a").select(F.col("left_rep").alias("a"), F.col("rep").alias("b"))
                       .filter(F.col("a") != F.col("b")).distinct())
    if not moves:
        if nodes is None:
            return pairs.select(F.col("a").alias("node"), F.col("a").alias("component"))
        return nodes.select("node", F.col("node").alias("component")).distinct()
    labels = moves[-1].select("a", F.col("rep").alias("root"))
    for move in reversed(moves[:-1]):
        labels = move.join(labels.select(F.col("a").alias("rep"), "root"), "rep", "left").select("a", F.coalesce("root", "rep").alias("root"))
    labels = settle(labels)
    least = labels.groupBy("root").agg(F.min("a").alias("component"))
    out = labels.join(least, "root").select(F.col("a").alias("node"), "component")
    if nodes is not None:
        out = nodes.select("node").distinct().join(out, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    return out


def parity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, component, flip, consistent`` for edges ``a, b, differ`` (0 equal, 1 opposite).

    Each node is doubled into an even and an odd copy and each edge joins the matching copies; the
    requirements agree exactly if the two copies of a node stay in different components.
    """
    doubled = edges.select("a", "b", "differ", F.explode(F.array(F.lit(0), F.lit(1))).alias("s"))
    lifted = doubled.select((F.col("a") * 2 + F.col("s")).alias("a"), (F.col("b") * 2 + (F.col("s") + F.col("differ")) % 2).alias("b"))
    both = nodes.select(F.explode(F.array(F.col("node") * 2, F.col("node") * 2 + 1)).alias("node"))
    cc = connected_components(lifted, both)
    per = cc.groupBy(F.floor(F.col("node") / 2).alias("node")).agg(
        F.min(F.when(F.col("node") % 2 == 0, F.col("component"))).alias("even"), F.min(F.when(F.col("node") % 2 == 1, F.col("component"))).alias("odd"))
    # The copy that shares its component with the smallest even or odd node decides the flip.
    return per.select("node", F.floor(F.least("even", "odd") / 2).alias("component"), (F.col("even") > F.col("odd")).cast("int").alias("flip"),
                      (F.col("even") != F.col("odd")).alias("consistent"))


def loop_order(links: DataFrame, loops: DataFrame) -> DataFrame:
    """``loop, node, position`` along simple cycles.  ``links``: ``node, next``; ``loops``: ``node,
    loop`` with the loop's smallest node as its id, where the numbering starts.

    Pointer doubling: after round k a node knows the node 2^k steps back and how many steps that
    was, so a loop of n nodes needs log n joins.
    """
    back = links.join(loops, "node").select(F.col("next").alias("node"), F.col("node").alias("far"), "loop")
    state = settle(back.select("node", "loop", F.when(F.col("node") == F.col("loop"), F.col("node")).otherwise(F.col("far")).alias("far"),
                               F.when(F.col("node") == F.col("loop"), 0).otherwise(1).cast("bigint").alias("position")))
    for _ in range(DOUBLINGS):
        if is_empty(state.filter(F.col("far") != F.col("loop"))):
            return state.select("loop", "node", "position")
        jump = state.select(F.col("node").alias("far"), F.col("far").alias("far2"), F.col("position").alias("more"))
        state = settle(state.join(jump, "far").select("node", "loop", F.col("far2").alias("far"), (F.col("position") + F.col("more")).alias("position")))
    raise RuntimeError("links do not form closed loops")


def chain_order(links: DataFrame) -> DataFrame:
    """``chain, node, position, closed`` of disjoint chains ``node, next``: each node has at most one
    successor and one predecessor, and ``next`` is null at the end of an open chain.

    A chain is named by its smallest node.  An open one is numbered from its first node; a closed one
    from its smallest.  Pointer doubling towards the start: a chain of n nodes needs log n joins, and
    nodes that have arrived take no part in later ones.
    """
    links = settle(links)
    pairs = links.filter("next IS NOT NULL").select(F.col("node").alias("a"), F.col("next").alias("b"))
    owner = settle(connected_components(pairs, links.select("node")))
    ends = owner.join(links, "node").groupBy("component").agg((F.count(F.lit(1)) == F.count("next")).alias("closed"))
    back = pairs.select(F.col("b").alias("node"), F.col("a").alias("before"))
    start = F.col("before").isNull() | (F.col("closed") & (F.col("node") == F.col("component")))
    state = settle(owner.join(ends, "component").join(back, "node", "left").select(
        F.col("component").alias("chain"), "node", "closed", F.when(start, F.col("node")).otherwise(F.col("before")).alias("far"),
        F.when(start, 0).otherwise(1).cast("bigint").alias("position")))
    heads = state.filter("position = 0").select(F.col("node").alias("far"))
    done = Ledger(links.sparkSession)
    done.add(state.filter("position = 0"))
    state = state.filter("position > 0")
    for _ in range(DOUBLINGS):
        arrived = state.join(heads, "far", "left_semi")
        done.add(arrived.select(done.schema.names))
        state = settle(state.join(heads, "far", "left_anti"))
        if is_empty(state):
            return done.read().select("chain", "node", "position", "closed")
        # A node jumps over one that is itself on the way, or takes the whole way of one that has arrived.
        known = state.unionByName(done.read()).select(F.col("node").alias("far"), F.col("far").alias("far2"), F.col("position").alias("more"))
        state = settle(state.join(known, "far").select("chain", "node", "closed", F.col("far2").alias("far"), (F.col("position") + F.col("more")).alias("position")))
    raise RuntimeError("links are not disjoint chains")


def shortest_paths(edges: DataFrame, sources: DataFrame, delta: float | None = None) -> DataFrame:
    """``node, distance, source`` from the nearest source (ties by source id) along undirected
    edges ``a, b, length`` of lengths not below zero.

    Delta-stepping: nodes are taken up in buckets of ``delta`` (the mean length, unless given).  Within a
    bucket only edges that can end in it are followed, until nothing improves; then the bucket is final,
    written once, and all its other edges are followed once.  Only the nodes between the final ones and the
    untouched ones are written again.
    """
    arcs = settle(edges.select("a", "b", "length").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "length"))
                  .groupBy("a", "b").agg(F.min("length").alias("length")))
    delta = delta or arcs.agg(F.avg("length")).first()[0] or 1.0
    final = Ledger(edges.sparkSession)
    front = settle(sources.select("node", F.struct(F.lit(0.0).alias("distance"), F.col("node").alias("source")).alias("best")))
    final.add(front.limit(0))

    def offers(active: DataFrame) -> DataFrame:
        reached = active.select(F.col("node").alias("a"), "best").join(arcs, "a")
        return reached.select(F.col("b").alias("node"), F.struct((F.col("best.distance") + F.col("length")).alias("distance"), F.col("best.source").alias("source")).alias("best"))

    def least(rows: DataFrame) -> DataFrame:
        return rows.groupBy("node").agg(F.min("best").alias("best"))

    while (nearest := front.agg(F.min("best.distance")).first()[0]) is not None:
        limit = (nearest // delta + 1) * delta
        if not nearest < limit:  # so far out that a bucket is less than the last place of a distance
            limit = math.nextafter(nearest, math.inf)
        inside = active = settle(front.filter(F.col("best.distance") < limit))
        while True:
            near = least(offers(active).filter(F.col("best.distance") < limit)).join(final.read().select("node"), "node", "left_anti")
            known = inside.withColumnRenamed("best", "now")
            active = settle(near.join(known, "node", "left").filter(F.col("now").isNull() | (F.col("best") < F.col("now"))).select("node", "best"))
            if is_empty(active):
                break
            inside = settle(least(inside.unionByName(active)))
        final.add(inside)
        beyond = offers(inside).filter(F.col("best.distance") >= limit)
        front = settle(least(front.filter(F.col("best.distance") >= limit).unionByName(beyond)).join(final.read().select("node"), "node", "left_anti"))
    return final.read().select("node", "best.distance", "best.source")
