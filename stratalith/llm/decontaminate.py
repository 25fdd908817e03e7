"""Benchmark passages in training texts, found by spaced-seed hashing.

A seed hashes the words at the kept positions of a fixed mask and ignores the others, so a changed
word at an ignored position leaves it as it is.  Hashes of the benchmark and of the texts are joined;
around each hit the two word rows are compared on their common diagonal, and an overlap counts if it
spans enough words of which enough are equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .batches import ALNUM, Words, kept, mix, trimmed, words

# In every stretch of 13 words or more, and in every whole item of 8 to 12, of which four
# fifths are equal, one mask meets equal words only.  Stretches of 26 words or more hold a shorter one
# with that share, as halves do, so lengths 8 to 25 decide (the tests go through all of them).
MASKS = ((0, 1, 2, 3), (0, 1, 2, 4))
#: Words that the widest mask spans.
SPAN = 5
#: Words of the shortest item that is looked for.
LEAST_ITEM = 8
#: Bytes of benchmark text that one pass over the documents looks for.
BLOCK_BYTES = 32 << 20
_FILTER_BITS = 22
_HITS_AT_ONCE = 1 << 20


def seed_hashes(word_hash: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The seed that starts at each word with as many words from it on as the mask spans."""
    n = len(word_hash) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for at in mask:
        total = total * np.uint64(0xD6E8FEB86659FD93) + word_hash[at:at + n]
    return mix(total)


def _seeds(piece: Words, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Seed hashes and a flag for those that stay within one row."""
    hashes = seed_hashes(piece.hash, mask)
    return hashes, piece.row[:len(hashes)] == piece.row[mask[-1]:mask[-1] + len(hashes)]


@dataclass
class SeedIndex:
    """The benchmark's words and, for each mask, its sorted seeds with their positions."""

    hash: np.ndarray
    item: np.ndarray
    bounds: np.ndarray
    seeds: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def of(texts: list[str | None]) -> SeedIndex:
        parts = list(words(pa.array(texts, pa.string()), ALNUM))
        item = np.concatenate([p.row + p.first_row for p in parts] or [np.zeros(0, np.int64)])
        hashes = np.concatenate([p.hash for p in parts] or [np.zeros(0, np.uint64)])
        long = np.bincount(item, minlength=len(texts)) >= LEAST_ITEM
        seeds = []
        for mask in MASKS:
            keys = seed_hashes(hashes, mask)
            at = np.flatnonzero((item[:len(keys)] == item[mask[-1]:mask[-1] + len(keys)]) & long[item[:len(keys)]])
            at = at[np.argsort(keys[at], kind="stable")]
            present = np.zeros(1 << _FILTER_BITS, bool)
            present[keys[at] >> np.uint64(64 - _FILTER_BITS)] = True
            seeds.append((keys[at], at, present))
        return SeedIndex(hashes, item, np.searchsorted(item, np.arange(len(texts) + 1)), seeds)

    def diagonals(self, piece: Words) -> np.ndarray:
        """Distinct ``row, item, text position - benchmark position`` of all seed hits in a slice."""
        found = [np.zeros((0, 3), np.int64)]
        for mask, (keys, at, present) in zip(MASKS, self.seeds):
            mine, whole = _seeds(piece, mask)
            hits = np.flatnonzero(present[mine >> np.uint64(64 - _FILTER_BITS)] & whole)
            low, high = np.searchsorted(keys, mine[hits], "left"), np.searchsorted(keys, mine[hits], "right")
            hits, low, count = hits[high > low], low[high > low], (high - low)[high > low]
            ends = np.cumsum(count)
            begin = 0
            while begin < len(hits):
                stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + _HITS_AT_ONCE)))
                n = count[begin:stop]
                text_at = np.repeat(hits[begin:stop], n)
                index = np.repeat(low[begin:stop], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                bench_at = at[index]
                found.append(np.unique(np.stack([piece.row[text_at], self.item[bench_at], text_at - bench_at], axis=1), axis=0))
                begin = stop
        return np.unique(np.concatenate(found), axis=0)


def longest_run(equal: np.ndarray, share: tuple[int, int]) -> tuple[int, int]:
    """The longest stretch ``low, high`` of which at least ``share`` (a fraction) is equal."""
    score = np.concatenate(([0], np.cumsum(np.where(equal, share[1] - share[0], -share[0]))))
    lowest = np.minimum.accumulate(score)
    low = np.searchsorted(-lowest, -score, "left")
    high = int(np.argmax(np.arange(len(score)) - low))
    return int(low[high]), high


def _verified(index: SeedIndex, piece: Words, least: int, share: tuple[int, int]) -> list[tuple[int, int, int, int, int, int]]:
    """The best overlap of each row and item: ``row, item, text word, item word, words, equal``."""
    row_start = np.searchsorted(piece.row, np.arange(piece.rows + 1))
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    for row, item, shift in index.diagonals(piece).tolist():
        start, stop = index.bounds[item], index.bounds[item + 1]
        low, high = max(start, row_start[row] - shift), min(stop, row_start[row + 1] - shift)
        equal = index.hash[low:high] == piece.hash[low + shift:high + shift]
        a, b = longest_run(equal, share)
        if b - a >= min(least, stop - start):
            seen = (int(equal[a:b].sum()), b - a, -int(low + a + shift - row_start[row]), -int(low + a - start))
            best[row, item] = max(best.get((row, item), seen), seen)
    return [(row, item, -v[2], -v[3], v[1], v[0]) for (row, item), v in sorted(best.items())]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The benchmark in blocks of about ``BLOCK_BYTES``, each small enough to send to every task."""
    items = benchmark.select(F.col(item_col).alias("_item"), F.col(text_col).cast("string").alias("_text")).filter(F.col("_text").isNotNull())
    size = items.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    pieces = max(1, -(-size // BLOCK_BYTES))
    for k in range(pieces):
        yield [tuple(r) for r in items.filter(F.pmod(F.xxhash64("_text"), F.lit(pieces)) == k).collect()]


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
             item_text_col: str = "text", least: int = 13, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """``id_col, item_col, doc_word, item_word, n_words, n_equal``: the best overlap of each row of
    ``docs`` with each benchmark item that it shares at least ``least`` aligned words with (or a whole
    item of ``LEAST_ITEM`` words or more), at least ``share`` of them equal.

    Words are lower-case runs of letters and digits.  Null and empty texts and items of fewer than
    ``LEAST_ITEM`` words match nothing; repeated rows and items are each reported; an empty table on either
    side gives no rows; other columns are ignored whatever their names.
    """
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    item_type = benchmark.schema[item_col].dataType
    schema = f"_id {picked.schema['_id'].dataType.simpleString()}, _item {item_type.simpleString()}, doc_word bigint, item_word bigint, n_words bigint, n_equal bigint"
    out = None
    for block in _blocks(benchmark, item_col, item_text_col):
        @trimmed
        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            kept("seeds", dict)  # what an operator before this one kept goes
            index = SeedIndex.of([text for _, text in block])
            names = pa.array([item for item, _ in block])
            for batch in batches:
                for piece in words(batch.column(1), ALNUM):
                    found = _verified(index, piece, least, share)
                    if found:
                        row, item, *rest = (pa.array(x, pa.int64()) for x in zip(*found))
                        owner = batch.column(0).slice(piece.first_row, piece.rows).take(row)
                        yield pa.RecordBatch.from_arrays([owner, names.take(item), *rest], names=["_id", "_item", "doc_word", "item_word", "n_words", "n_equal"])
        part = picked.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"_id": id_col, "_item": item_col})


def without_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id has no overlap; all columns stay, and rows with a null id too."""
    return docs.join(settle(overlaps(docs, benchmark, id_col, **options).select(id_col).distinct()), id_col, "left_anti")
