"""Nearest-neighbour and radius joins.

``radius_join`` buckets both sides on a grid and joins on the bucket.

``knn_join`` cannot use one cell size: real point tables have sparse and crowded places, and one
place may hold a third of all points.  It therefore

1. merges equal points into one location that keeps its ``k`` smallest ids (no answer can need more);
2. counts locations per cell of a 2^d-way grid, refining only the crowded cells, so every location
   lies in one leaf cell of bounded size;
3. gives each query an upper bound from the finest cell around it that holds ``k`` locations, and
   follows only the cells that the bound reaches, down to the leaves;
4. ranks the locations of those leaves by ``(distance, id)``.

The work per query depends on ``k`` and the leaf size, not on how crowded the fullest cell is.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..session import is_empty, settle
from .skew import salted_join

#: Locations per leaf cell before the cell is split.
LEAF_ROWS = 64
#: Below these counts of points and of point-query pairs a single leaf is used (and broadcast).
SMALL_POINTS, SMALL_PAIRS = 4096, 1 << 24
#: Deepest grid level; 2^-40 of the extent is below the resolution of most coordinates.
MAX_LEVEL = 40


def _axes(coords: Sequence[str]) -> list[str]:
    return [f"_c{i}" for i in range(len(coords))]


class CellTree:
    """Locations bucketed into leaf cells; ``cells`` has one row per occupied cell and level."""

    def __init__(self, points: DataFrame, coords: Sequence[str], pid: str, keep: int, leaf_rows: int,
                 asked: int | None = None):
        self.coords, self.axes = list(coords), _axes(coords)
        per_place = Window.partitionBy(*coords).orderBy(pid)
        places = (
            points.select(*coords, pid)
            .withColumn("_rn", F.row_number().over(per_place)).filter(F.col("_rn") <= keep)
            .groupBy(*coords).agg(F.sort_array(F.collect_list(pid)).alias("_ids"))
        )
        self.places = settle(places)
        bounds = self.places.agg(
            F.count(F.lit(1)).alias("n"),
            *[F.min(c).alias(f"lo_{c}") for c in coords], *[F.max(c).alias(f"hi_{c}") for c in coords],
        ).first()
        self.n = bounds["n"]
        self.low = [float(bounds[f"lo_{c}"] or 0.0) for c in coords]
        span = max([float((bounds[f"hi_{c}"] or 0.0)) - lo for c, lo in zip(coords, self.low)] + [0.0])
        self.span = span * (1 + 1e-9) if span > 0 else 1.0
        # With few points and queries one leaf is cheaper than building levels.
        whole = asked is not None and self.n <= SMALL_POINTS and self.n * asked <= SMALL_PAIRS
        self.leaf_rows = max(self.n, leaf_rows) if whole else leaf_rows
        self._split()

    # -- cell arithmetic ------------------------------------------------------------------
    def side(self, level: Column) -> Column:
        return F.lit(self.span) / F.pow(F.lit(2.0), level)

    def cell_of(self, level: Column, axis: int) -> Column:
        """Cell index of a coordinate; queries outside the extent count as in the nearest cell."""
        raw = F.floor((F.col(self.coords[axis]) - F.lit(self.low[axis])) / self.side(level))
        top = F.pow(F.lit(2.0), level) - 1
        return v.clamp(raw.cast("double"), 0.0, top).cast("bigint")

    def near2(self, level: Column) -> Column:
        """Squared distance from the query to the nearest point of the cell."""
        total: Column = F.lit(0.0)
        for i, (c, axis) in enumerate(zip(self.coords, self.axes)):
            low = F.lit(self.low[i]) + F.col(axis) * self.side(level)
            gap = F.greatest(low - F.col(c), F.col(c) - (low + self.side(level)), F.lit(0.0))
            total = total + gap * gap
        return total

    def far2(self, level: Column) -> Column:
        total: Column = F.lit(0.0)
        for i, (c, axis) in enumerate(zip(self.coords, self.axes)):
            low = F.lit(self.low[i]) + F.col(axis) * self.side(level)
            gap = F.greatest(F.abs(F.col(c) - low), F.abs(F.col(c) - (low + self.side(level))))
            total = total + gap * gap
        return total

    # -- building -------------------------------------------------------------------------
    def _split(self) -> None:
        d, axes = len(self.coords), self.axes
        # About a quarter-full leaves on average, so even tables need no further round.
        fill = max(self.leaf_rows / 4, 1)
        base = 0 if self.n <= self.leaf_rows else min(MAX_LEVEL, math.ceil(math.log2(self.n / fill) / d))
        self.base = base
        # Crowded cells are cut into about 64 parts at a time, which keeps the rounds few.
        self.stride = max(1, 6 // d)

        def index(table: DataFrame, level: int) -> DataFrame:
            for i, axis in enumerate(axes):
                table = table.withColumn(axis, self.cell_of(F.lit(level), i))
            return table

        def tally(table: DataFrame, level: int) -> DataFrame:
            return table.groupBy(*axes).agg(F.count(F.lit(1)).alias("_n")).withColumn("_level", F.lit(level))

        open_ = index(self.places, base)
        fine = tally(open_, base)
        tables = [fine]
        # Coarser levels are sums of the finer cell table, never a second pass over the points.
        coarse = fine
        for level in range(base - 1, -1, -1):
            coarse = coarse.groupBy(*[F.shiftright(a, 1).alias(a) for a in axes]).agg(F.sum("_n").alias("_n")) \
                .withColumn("_level", F.lit(level))
            tables.append(coarse)
        done, level = [], base
        fullest = self.n if base == 0 else fine.agg(F.max("_n")).first()[0]
        while fullest > self.leaf_rows and level < MAX_LEVEL:
            crowded = fine.filter(F.col("_n") > self.leaf_rows).select(*axes)
            done.append(open_.join(crowded, axes, "left_anti").withColumn("_level", F.lit(level)))
            level += self.stride
            open_ = settle(index(open_.join(crowded, axes, "left_semi"), level))
            fine = settle(tally(open_, level))
            tables.append(fine)
            fullest = fine.agg(F.max("_n")).first()[0]
        done.append(open_.withColumn("_level", F.lit(level)))
        self.depth = level
        self.ladder = [*range(base), *range(base, level + 1, self.stride)]
        cells = tables[0].select("_level", *axes, "_n")
        for table in tables[1:]:
            cells = cells.unionByName(table.select("_level", *axes, "_n"))
        split = (F.col("_level") < base) | ((F.col("_n") > self.leaf_rows) & (F.col("_level") < level))
        cells = cells.withColumn("_leaf", ~split)
        self.cells = settle(cells) if self.depth else cells
        leaves = done[0]
        for table in done[1:]:
            leaves = leaves.unionByName(table)
        self.leaves = settle(leaves) if len(done) > 1 else leaves

    # -- searching ------------------------------------------------------------------------
    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """``queries`` holds distinct coordinates; returns them with ``_ids`` and ``_d2`` of candidates."""
        coords, axes, key = self.coords, self.axes, ["_level", *self.axes]
        level = F.col("_level")
        limit = min(k, self.n)
        renamed = self.leaves.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(coords)], *key, "_ids")
        there = v.vec(*[f"_p{i}" for i in range(len(coords))])
        nearest = Window.partitionBy(*coords).orderBy("_d2", F.element_at("_ids", 1))
        if self.depth == 0:
            root = queries.withColumn("_level", F.lit(0))
            for axis in axes:
                root = root.withColumn(axis, F.lit(0).cast("bigint"))
            side = F.broadcast(renamed) if self.n <= SMALL_POINTS else renamed
            return (
                root.join(side, key).withColumn("_d2", v.dist2(v.vec(*coords), there))
                .withColumn("_rn", F.row_number().over(nearest)).filter(F.col("_rn") <= k)
                .select(*coords, "_d2", "_ids")
            )
        laddered = queries.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in self.ladder])))
        for i, axis in enumerate(axes):
            laddered = laddered.withColumn(axis, self.cell_of(level, i))
        wide = self.cells.filter(F.col("_n") >= limit)
        start = (
            laddered.join(wide, key)
            .groupBy(*coords).agg(F.max(F.struct("_level", *axes, "_leaf")).alias("_s")).select(*coords, "_s.*")
            .withColumn("_bound", self.far2(level))
        )
        # The k-th distance inside a full leaf is a much tighter bound than the cell's far corner.
        inside = (
            start.filter("_leaf").drop("_bound").join(renamed.drop("_ids"), key)
            .withColumn("_d2", v.dist2(v.vec(*coords), there))
            .withColumn("_rn", F.row_number().over(Window.partitionBy(*coords).orderBy("_d2")))
            .filter(F.col("_rn") == limit).select(*coords, F.col("_d2").alias("_tight"))
        )
        slack = (self.span * 1e-9) ** 2
        bounded = start.join(inside, coords, "left").withColumn(
            "_bound", F.least("_bound", F.coalesce("_tight", "_bound")) * (1 + 1e-9) + F.lit(slack))
        # Every leaf lies at the base level or below it, so the walk may not begin deeper than that.
        begin = F.least(level + 1, F.lit(self.base))
        frontier = bounded.select(*coords, begin.alias("_level"), "_bound")
        reach = F.sqrt("_bound")
        for i, (c, axis) in enumerate(zip(coords, axes)):
            top = F.pow(F.lit(2.0), level) - 1
            first = F.floor((F.col(c) - reach - F.lit(self.low[i])) / self.side(level)).cast("double")
            last = F.floor((F.col(c) + reach - F.lit(self.low[i])) / self.side(level)).cast("double")
            frontier = frontier.withColumn(axis, F.explode(F.sequence(
                v.clamp(first, 0.0, top).cast("bigint"), v.clamp(last, 0.0, top).cast("bigint"))))
        frontier = frontier.filter(self.near2(level) <= F.col("_bound")).join(self.cells, key)
        frontier, found = settle(frontier), []
        for _ in self.ladder:
            inner = frontier.filter(~F.col("_leaf"))
            if is_empty(inner):
                break
            found.append(frontier.filter("_leaf"))
            children = inner.withColumn("_parts", F.when(level < self.base, 2).otherwise(1 << self.stride))
            for axis in axes:
                children = children.withColumn(axis, F.explode(F.sequence(
                    F.col(axis) * F.col("_parts"), (F.col(axis) + 1) * F.col("_parts") - 1)))
            children = children.select(
                *coords, "_bound", F.when(level < self.base, level + 1).otherwise(level + self.stride).alias("_level"), *axes)
            children = children.filter(self.near2(level) <= F.col("_bound")).join(self.cells, key)
            # Cells counted from the nearest far corner until k are reached give a new bound.
            by_far = Window.partitionBy(*coords).orderBy("_far", *axes) \
                .rowsBetween(Window.unboundedPreceding, 0)
            children = (
                children.withColumn("_far", self.far2(level) * (1 + 1e-9) + F.lit(slack))
                .withColumn("_sum", F.sum("_n").over(by_far))
                .withColumn("_new", F.min(F.when(F.col("_sum") >= limit, F.col("_far")))
                            .over(Window.partitionBy(*coords)))
                .withColumn("_bound", F.least("_bound", F.coalesce("_new", "_bound")))
                .filter(self.near2(level) <= F.col("_bound")).drop("_far", "_sum", "_new")
            )
            frontier = settle(children)
        for table in found:
            frontier = frontier.unionByName(table.select(*frontier.columns))
        targets = frontier.select(*coords, "_bound", *key)
        hits = (
            targets.join(renamed, key)
            .withColumn("_d2", v.dist2(v.vec(*coords), there)).filter(F.col("_d2") <= F.col("_bound"))
        )
        return hits.withColumn("_rn", F.row_number().over(nearest)).filter(F.col("_rn") <= k) \
            .select(*coords, "_d2", "_ids")


def knn_join(points: DataFrame, queries: DataFrame, k: int, coords: Sequence[str] = ("x", "y", "z"),
             pid: str = "id", qid: str = "query_id", leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """The ``k`` nearest points of every query, ties by id: ``qid, pid, rank, d2, distance``.

    A query that coincides with a point gets that point too, at distance 0.
    """
    coords = list(coords)
    # Hashed by place once; the distinct and the final ranking per place both reuse this layout.
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = queries.select(*coords).repartition(parts, *coords).distinct()
    tree = CellTree(points, coords, pid, k, max(leaf_rows, k), places.count())
    near = tree.search(places, k)
    order = Window.partitionBy(*coords).orderBy("_d2", pid)
    per_place = (
        near.withColumn(pid, F.explode("_ids"))
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select(*coords, pid, F.col("rank").cast("bigint").alias("rank"), F.col("_d2").alias("d2"))
    )
    return (
        queries.select(qid, *coords).join(per_place, coords)
        .select(qid, pid, "rank", "d2", F.sqrt("d2").alias("distance"))
    )


def grid_cells(df: DataFrame, coords: Sequence[str], side: float, reach: int = 0) -> DataFrame:
    """Add cell columns ``_g0.._gd``; with ``reach`` > 0 one row per neighbouring cell."""
    for i, c in enumerate(coords):
        own = F.floor(F.col(c) / F.lit(float(side)))
        if reach:
            df = df.withColumn(f"_g{i}", F.explode(F.sequence(own - reach, own + reach)))
        else:
            df = df.withColumn(f"_g{i}", own)
    return df


def radius_join(points: DataFrame, queries: DataFrame, radius: float,
                coords: Sequence[str] = ("x", "y", "z"), pid: str = "id", qid: str = "query_id") -> DataFrame:
    """All points in the closed ball around every query: ``qid, pid, d2, distance``.

    Cells are as wide as the radius; the queries are repeated into the neighbouring cells and the
    hot point cells are salted.
    """
    coords = list(coords)
    side = radius * (1 + 1e-9)
    cells = [f"_g{i}" for i in range(len(coords))]
    left = grid_cells(queries.select(F.col(qid).alias("_qid"), *[F.col(c).alias(f"_q{i}") for i, c in enumerate(coords)]),
                      [f"_q{i}" for i in range(len(coords))], side, 1)
    right = grid_cells(points.select(pid, *coords), coords, side)
    d2 = v.dist2(v.vec(*[f"_q{i}" for i in range(len(coords))]), v.vec(*coords))
    return (
        salted_join(left, right, cells, pid)
        .withColumn("d2", d2).filter(F.col("d2") <= F.lit(float(radius) * float(radius)))
        .select(F.col("_qid").alias(qid), pid, "d2", F.sqrt("d2").alias("distance"))
    )


def count_within(points: DataFrame, queries: DataFrame, radius: float,
                 coords: Sequence[str] = ("x", "y", "z"), group: str = "label",
                 qid: str = "query_id") -> DataFrame:
    """Points in the closed ball of every query, counted by ``group``, as ``qid, group, neighbours``.

    Equal points are merged into weighted locations first, and cells that lie wholly inside the
    ball are added by their totals, so a crowded place costs one row instead of one row per pair.
    """
    coords = list(coords)
    d = len(coords)
    fine = radius / 2.0
    cells = [f"_g{i}" for i in range(d)]
    places = points.groupBy(*coords, group).agg(F.count(F.lit(1)).alias("_w"))
    placed = grid_cells(places, coords, fine)
    totals = placed.groupBy(*cells, group).agg(
        F.sum("_w").alias("_w"),
        *[F.min(c).alias(f"_lo{i}") for i, c in enumerate(coords)],
        *[F.max(c).alias(f"_hi{i}") for i, c in enumerate(coords)])
    asks = queries.select(*[F.col(c).alias(f"_q{i}") for i, c in enumerate(coords)]).distinct()
    reached = grid_cells(asks, [f"_q{i}" for i in range(d)], fine, 3)
    limit = F.lit(float(radius) * float(radius))
    gap2: Column = F.lit(0.0)
    for i in range(d):
        low = F.col(f"_g{i}") * F.lit(fine)
        gap = F.greatest(low - F.col(f"_q{i}"), F.col(f"_q{i}") - (low + F.lit(fine)), F.lit(0.0))
        gap2 = gap2 + gap * gap
    pairs = reached.filter(gap2 <= limit * (1 + 1e-6)).join(totals, cells)
    far: Column = F.lit(0.0)
    near: Column = F.lit(0.0)
    for i in range(d):
        q, lo, hi = F.col(f"_q{i}"), F.col(f"_lo{i}"), F.col(f"_hi{i}")
        f = F.greatest(F.abs(q - lo), F.abs(q - hi))
        n = F.greatest(lo - q, q - hi, F.lit(0.0))
        far, near = far + f * f, near + n * n
    pairs = pairs.withColumn("_far", far).filter(near <= limit)
    whole = pairs.filter(F.col("_far") <= limit).select(*[f"_q{i}" for i in range(d)], group, "_w")
    partial = (
        pairs.filter(F.col("_far") > limit).select(*[f"_q{i}" for i in range(d)], *cells, group)
        .join(placed, [*cells, group])
        .filter(v.dist2(v.vec(*[f"_q{i}" for i in range(d)]), v.vec(*coords)) <= limit)
        .select(*[f"_q{i}" for i in range(d)], group, "_w")
    )
    counts = whole.unionByName(partial).groupBy(*[f"_q{i}" for i in range(d)], group) \
        .agg(F.sum("_w").alias("neighbours"))
    back = [F.col(f"_q{i}").alias(c) for i, c in enumerate(coords)]
    return queries.select(qid, *coords).join(counts.select(*back, group, "neighbours"), coords) \
        .select(qid, group, "neighbours")
