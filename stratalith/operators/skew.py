"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle

#: Rows of one key that one task may still take without being split.
HOT_ROWS = 100_000
#: Hot keys up to this number are broadcast; a longer list is joined like any table.
BROADCAST_KEYS = 10_000


def hot_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys with more than ``rows`` rows on a side, and the number of pieces to cut each side into.
    The limit is the same for tables of every size."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).filter(F.col(name) > rows)
    pieces = lambda name: F.coalesce(F.ceil(F.col(name) / rows), F.lit(1)).cast("int")
    hot = settle(count(left, "_nl").join(count(right, "_nr"), list(keys), "full_outer").select(*keys, pieces("_nl").alias("_left"), pieces("_nr").alias("_right")))
    size = hot.limit(BROADCAST_KEYS + 1).count()
    if not size:
        return None
    return F.broadcast(hot) if size <= BROADCAST_KEYS else hot


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], spread: str,
                rows: int = HOT_ROWS) -> DataFrame:
    """Inner equi-join where the rows of a hot key are cut into pieces on whichever side is hot, by a
    hash of ``spread`` (right) or of the whole row (left), and each side is repeated once per piece
    of the other.  Same rows as a plain join."""
    hot = hot_keys(left, right, keys, rows)
    if hot is None:
        return left.join(right, list(keys))
    whole = [F.col(f.name) for f in left.schema if not isinstance(f.dataType, T.MapType)]
    def cut(df: DataFrame, own: str, other: str, by: list[Column]) -> DataFrame:
        marked = df.join(hot, list(keys), "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("_left", "_right")})
        salt = F.pmod(F.xxhash64(*by), F.col(f"_{own}")).cast("int")
        return marked.withColumn(f"_salt{own}", salt).withColumn(f"_salt{other}", F.explode(F.sequence(F.lit(0), F.col(f"_{other}") - 1))).drop("_left", "_right")
    both = cut(left, "left", "right", whole).join(cut(right, "right", "left", [F.col(spread)]), [*keys, "_saltleft", "_saltright"])
    return both.drop("_saltleft", "_saltright")


#: Members of one class that are put into one array.
PACK = 4096


def packed(members: DataFrame, keys: Sequence[str], name: str, size: int = PACK) -> DataFrame:
    """The values ``name`` of every key (nulls are keys too) as arrays of about ``size``, one or more rows per key.

    A join on them carries one row for a whole array, so pairs of members are only written out where they are
    listed, by ``explode``, and not shuffled."""
    rest = members.select(*keys, name)
    hot = settle(rest.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_pieces")).filter("_pieces > 1"))
    found = hot.limit(BROADCAST_KEYS + 1).count()
    if not found:
        return rest.groupBy(*keys).agg(F.collect_list(name).alias(name))
    hot = hot.withColumnsRenamed({k: f"_h{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"_h{i}")) for i, k in enumerate(keys)]
    cut = rest.join(F.broadcast(hot) if found <= BROADCAST_KEYS else hot, same, "left")
    cut = cut.withColumn("_piece", F.pmod(F.xxhash64(name), F.coalesce("_pieces", F.lit(1))))
    return cut.groupBy(*keys, "_piece").agg(F.collect_list(name).alias(name)).drop("_piece")
