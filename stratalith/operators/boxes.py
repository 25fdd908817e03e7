"""Join of axis-aligned boxes of any mix of sizes.

Each box is bucketed on the grid whose cells are just as large as the box, so it touches at most two
cells per axis.  Every coordinate is measured in its own unit, the usual extent of a box along it.  A pair meets on the coarser grid of the two.  Of the cells a pair shares, only the
one that holds the lower corner of their common part reports it, so there is nothing to deduplicate.
"""

from __future__ import annotations

import math

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import salted_join

#: Binary digits of a double: cells below this share of the largest coordinate cannot be told apart.
DIGITS = 52


def with_box(df: DataFrame, prefix: str, low: dict[str, Column], high: dict[str, Column]) -> DataFrame:
    return df.withColumns({f"{prefix}lo_{c}": e for c, e in low.items()} | {f"{prefix}hi_{c}": e for c, e in high.items()})


def _scale(sides: Sequence[tuple[DataFrame, str]], coords: Sequence[str]) -> tuple[list[float], int]:
    """The unit of each coordinate, a power of two near the larger mean extent of the two sides, so that flat
    or tall boxes fill their cells too; and the level of boxes without extent: the finest on which every cell
    number is a whole number."""
    tops, means = [0.0] * len(coords), [0.0] * len(coords)
    for df, prefix in sides:
        ends = lambda c: (F.col(f"{prefix}lo_{c}"), F.col(f"{prefix}hi_{c}"))
        found = df.agg(*[F.max(F.greatest(*map(F.abs, ends(c)))).alias(f"t{i}") for i, c in enumerate(coords)],
                       *[F.avg(ends(c)[1] - ends(c)[0]).alias(f"m{i}") for i, c in enumerate(coords)]).first()
        tops = [max(t, found[f"t{i}"] or 0.0) for i, t in enumerate(tops)]
        means = [max(m, found[f"m{i}"] or 0.0) for i, m in enumerate(means)]
    usual = max((m for m in means if math.isfinite(m)), default=0.0) or 1.0
    units = [2.0 ** round(math.log2(m if m > 0 and math.isfinite(m) else usual)) for m in means]
    top = max((t / u for t, u in zip(tops, units) if t), default=1.0)
    return units, math.ceil(math.log2(top)) - DIGITS


def _level(prefix: str, coords: Sequence[str], units: Sequence[float], finest: int) -> Column:
    sizes = [(F.col(f"{prefix}hi_{c}") - F.col(f"{prefix}lo_{c}")) / F.lit(u) for c, u in zip(coords, units)]
    extent = F.greatest(*sizes) if len(sizes) > 1 else sizes[0]
    # log2 may round down by a hair, hence the factor.
    level = F.ceil(F.log2(extent * (1 + 1e-12)))
    return F.when(extent > 0, F.greatest(level, F.lit(finest))).otherwise(finest).cast("int")


def box_join(left: DataFrame, right: DataFrame, coords: Sequence[str], spread: str) -> DataFrame:
    """All pairs whose closed boxes meet, with the columns of both sides.

    ``left`` has ``llo_c, lhi_c`` and ``right`` ``rlo_c, rhi_c`` per coordinate; other column names
    must differ.  Hot cells are split on either side, those of ``right`` by its column ``spread``.
    """
    units, finest = _scale([(left, "l"), (right, "r")], coords)
    left, right = left.withColumn("_ll", _level("l", coords, units, finest)), right.withColumn("_rl", _level("r", coords, units, finest))
    # Distinct levels: small integers, as many as there are binary orders of magnitude among the boxes.
    ls = sorted(r[0] for r in left.select("_ll").distinct().collect())
    rs = sorted(r[0] for r in right.select("_rl").distinct().collect())
    if not ls or not rs:
        return left.join(right, F.lit(False)).drop("_ll", "_rl")

    def spread_out(df: DataFrame, prefix: str, own: str, others: list[int]) -> DataFrame:
        higher = F.filter(F.array(*[F.lit(x) for x in others]), lambda x: x > F.col(own))
        # The box's own level only matters if the other side has something as small.
        mine = F.when(F.col(own) >= min(others), F.array(own)).otherwise(F.array().cast("array<int>"))
        df = df.withColumn("_level", F.explode(F.concat(mine, higher)))
        for i, c in enumerate(coords):
            side = F.pow(F.lit(2.0), F.col("_level")) * F.lit(units[i])
            low, high = F.floor(F.col(f"{prefix}lo_{c}") / side), F.floor(F.col(f"{prefix}hi_{c}") / side)
            df = df.withColumn(f"_g{i}", F.explode(F.sequence(low, high)))
        return df

    cells = [f"_g{i}" for i in range(len(coords))]
    pairs = salted_join(spread_out(left, "l", "_ll", rs), spread_out(right, "r", "_rl", ls), ["_level", *cells], spread)
    keep = F.col("_level") == F.greatest("_ll", "_rl")
    for i, c in enumerate(coords):
        side = F.pow(F.lit(2.0), F.col("_level")) * F.lit(units[i])
        keep = keep & (F.col(f"llo_{c}") <= F.col(f"rhi_{c}")) & (F.col(f"rlo_{c}") <= F.col(f"lhi_{c}"))
        keep = keep & (F.floor(F.greatest(f"llo_{c}", f"rlo_{c}") / side) == F.col(f"_g{i}"))
    return pairs.filter(keep).drop("_ll", "_rl", "_level", *cells)
