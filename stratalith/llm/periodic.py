"""Periodic runs of words, found through string synchronising sets.

At each dyadic scale t a set of positions is selected by hashes of t words: a position belongs to it if
the least hash among the t + 1 next ones stands at their first or last place.  Membership depends on
the next 2t words only, so it is the same wherever they occur.  Words with period p recur p places on,
and so do their selected positions: pairs at a distance of 2t to 4t with equal next 2t words propose
the periods of that size, and every proposal is extended to both sides as far as its words repeat.
Stretches whose period is at most t/3 hold no selected position (their hashes are left out, else every
place would tie); periods below ``SMALL`` are found by a direct comparison instead.

A text is one row and is handled whole; texts are handled together, slice by slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import SPACE, Words, kept, mix, powers, words

#: A run is at least this long and at least ``REPEATS`` times its period.
LEAST, REPEATS = 24, 3
#: Smaller periods are compared directly.  The first scale is half of it.
SMALL = 16
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    size = 1
    while 2 * size <= width and len(x) > size:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    more = width - size
    return np.minimum(x[:len(x) - more], x[more:]) if more and len(x) > more else x[:max(0, len(x) - more)]


def stretches(code: np.ndarray, period: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of at least ``least`` words that have the period."""
    same = (code[period:] == code[:-period]).view(np.int8)
    edges = np.flatnonzero(np.diff(same, prepend=np.int8(0), append=np.int8(0)))
    start, end = edges[::2], edges[1::2] + period
    long = end - start >= least
    return start[long], end[long]


class _Equal:
    """Equality of word ranges from prefix sums."""

    def __init__(self, code: np.ndarray) -> None:
        self.n = len(code)
        self.power, self.inverse = powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(code * self.power[:-1], out=self.sums[1:])

    def hashes(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]

    def grams(self, length: int) -> np.ndarray:
        """The hash of the ``length`` words from each position on."""
        return mix((self.sums[length:] - self.sums[:-length]) * self.inverse[:self.n + 1 - length])

    def extend(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many words before, and from, positions ``a < b`` on are equal."""
        def most(reach: np.ndarray, equal) -> np.ndarray:
            low, high = np.zeros_like(reach), reach.copy()
            while (open_ := low < high).any():
                middle = (low + high + 1) // 2
                good = equal(middle)
                low, high = np.where(open_ & good, middle, low), np.where(open_ & ~good, middle - 1, high)
            return low
        back = most(a, lambda m: self.hashes(a - m, m) == self.hashes(b - m, m))
        ahead = most(self.n - b, lambda m: self.hashes(a, m) == self.hashes(b, m))
        return back, ahead


def selected(equal: _Equal, t: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The synchronising set of scale ``t``; stretches ``start, end`` have periods of at most t/3."""
    ids = equal.grams(t)
    edge = np.zeros(len(ids) + 1, np.int64)
    long = end - start >= t
    np.add.at(edge, start[long], 1)
    np.add.at(edge, end[long] - t + 1, -1)
    ids[np.cumsum(edge[:-1]) > 0] = _NONE
    least = sliding_min(ids, t + 1)
    first, last = ids[:len(least)], ids[t:t + len(least)]
    return np.flatnonzero((least != _NONE) & ((least == first) | (least == last)))


def proposed(equal: _Equal, t: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of selected positions, 2t to 4t apart, whose next 2t words are equal."""
    context = equal.hashes(at, 2 * t)
    a, b, step = [at[:0]], [at[:0]], 1
    while step < len(at):
        apart = at[step:] - at[:-step]
        if apart.min() >= 4 * t:
            break
        hit = np.flatnonzero((apart >= 2 * t) & (apart < 4 * t) & (context[step:] == context[:-step]))
        a.append(at[hit])
        b.append(at[hit + step])
        step += 1
    return np.concatenate(a), np.concatenate(b)


def find_runs(code: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``start, end, period`` of all runs in texts of ``length`` words each, ordered by start and period.
    ``code`` holds the texts one after the other, each followed by a word that occurs nowhere else."""
    found = [np.zeros((0, 3), np.int64)]
    for period in range(1, min(SMALL, len(code))):
        start, end = stretches(code, period, REPEATS * period)
        found.append(np.stack([start, end, np.full(len(start), period)], axis=1))
    t, origin, size = SMALL // 2, np.arange(len(code)), np.repeat(length, length + 1)
    while True:
        # Runs of this scale's periods need texts of so many words.
        long = size >= REPEATS * 2 * t
        code, origin, size = code[long], origin[long], size[long]
        if not len(code):
            break
        known = np.concatenate(found)
        known = known[(REPEATS * known[:, 2] <= t) & (known[:, 1] - known[:, 0] >= t)]
        at = np.minimum(np.searchsorted(origin, known[:, 0]), len(origin) - 1)
        here = origin[at] == known[:, 0]
        equal = _Equal(code)
        a, b = proposed(equal, t, selected(equal, t, at[here], at[here] + (known[:, 1] - known[:, 0])[here]))
        # One pair per period and repeated place is enough: the next pair of a run starts within it.
        if len(a):
            order = np.lexsort((a, b - a))
            a, b = a[order], b[order]
            back, ahead = equal.extend(a, b)
            rows = np.unique(np.stack([a - back, b + ahead, b - a], axis=1), axis=0)
            rows = rows[rows[:, 1] - rows[:, 0] >= REPEATS * rows[:, 2]]
            found.append(np.stack([origin[rows[:, 0]], origin[rows[:, 1] - 1] + 1, rows[:, 2]], axis=1))
        t *= 2
    out = np.concatenate(found)
    out = out[out[:, 1] - out[:, 0] >= LEAST]
    # A multiple of a period has the same maximal stretch; the smallest one stays.
    out = out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]
    same = np.zeros(len(out), bool)
    same[1:] = (out[1:, :2] == out[:-1, :2]).all(axis=1)
    out = out[~same]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def joined_words(piece: Words, word: np.ndarray, row: np.ndarray) -> pa.Array:
    """The words with numbers ``word`` (of texts ``row``, in order), one blank between them."""
    size = piece.end[word] - piece.start[word]
    last = np.ones(len(word), bool)
    last[:-1] = row[1:] != row[:-1]
    place = np.cumsum(size + ~last) - size - ~last
    out = np.full(int((size + ~last).sum()), 0x20, np.uint8)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(place, size) + inside] = piece.data[np.repeat(piece.start[word], size) + inside]
    offsets = np.zeros(piece.rows + 1, np.int64)
    np.add.at(offsets, row + 1, size + ~last)
    return pa.LargeStringArray.from_buffers(piece.rows, pa.py_buffer(np.cumsum(offsets)), pa.py_buffer(out)).cast(pa.string())


def looped(count: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Word numbers of texts of ``count`` words; a text with a ``seed`` (0 or more) repeats a stretch from
    some word on to its end, as the seed says."""
    number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    on = (seed >= 0) & (count > 0)
    a = np.where(on, seed % np.maximum(count, 1), count)
    period = np.where(on, 1 + (count - a) // (3 + seed % 8), 1)
    a, period = np.repeat(a, count), np.repeat(period, count)
    return np.where(number < a, number, a + (number - a) % period)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: Column | None = None) -> DataFrame:
    """``id_col, runs, collapsed`` for every row of ``docs``.

    Words are runs of anything but the six ASCII blanks.  ``runs`` lists ``start, length, period`` (in
    words) of every maximal stretch with that smallest period which holds it ``REPEATS`` times and has
    ``LEAST`` words, ordered by start, then period.  ``collapsed`` keeps the words that no run holds after
    its first period, one blank between them.  With a ``seed`` that is not null, a text is first rewritten
    so that its end repeats (a planted case).  Null and empty texts have no runs and an empty
    ``collapsed``; repeated rows are each reported; an empty table gives no rows; other columns are
    ignored whatever their names.
    """
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.coalesce((seed if seed is not None else F.lit(None)).cast("bigint"), F.lit(-1)).alias("_seed"))
    kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("periodic", dict)
        for batch in batches:
            seeds = batch.column(2).to_numpy(zero_copy_only=False)
            for piece in words(batch.column(1), ~SPACE, lower=False):
                count = np.bincount(piece.row, minlength=piece.rows)
                first = np.cumsum(count) - count
                word = looped(count, seeds[piece.first_row:piece.first_row + piece.rows]) + np.repeat(first, count)
                # Each text is followed by a word of its own.
                place = np.arange(len(word)) + piece.row
                code = mix(np.arange(len(word) + piece.rows, dtype=np.uint64) ^ np.uint64(0xC2B2AE3D27D4EB4F))
                code[place] = piece.hash[word]
                found = find_runs(code, count)
                row = np.searchsorted(first + count + np.arange(piece.rows), found[:, 0], side="right")
                start, period = found[:, 0] - first[row] - row, found[:, 2]
                gone = np.zeros(len(word) + 1, np.int64)
                np.add.at(gone, found[:, 0] - row + period, 1)
                np.add.at(gone, found[:, 1] - row, -1)
                stays = np.cumsum(gone[:-1]) == 0
                bounds = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=piece.rows)))).astype(np.int32)
                rows = pa.StructArray.from_arrays([pa.array(start), pa.array(found[:, 1] - found[:, 0]), pa.array(period)], fields=list(kind))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first_row, piece.rows), pa.ListArray.from_arrays(pa.array(bounds), rows),
                                                  joined_words(piece, word[stays], piece.row[stays])], names=["_id", "runs", "collapsed"])
    schema = f"_id {picked.schema['_id'].dataType.simpleString()}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return picked.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def described(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, the run that repeats most (ties: the first, then the smaller period) and digests."""
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda most, r: F.when(r["length"] * most["period"] > most["length"] * r["period"], r).otherwise(most))
    spelled = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    return (found.withColumn("_best", best)
            .select(id_col, F.size("runs").cast("bigint").alias("n_runs"), *(F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")),
                    F.floor(F.col("_best.length") * 1000 / F.col("_best.period")).cast("bigint").alias("exponent_milli"),
                    F.sha2(spelled.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))
