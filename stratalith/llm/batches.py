"""Vectorised word handling inside Arrow tasks.

A batch of texts is one byte buffer with row offsets.  Words, their hashes and their rows come from a
few numpy passes over that buffer, in slices of bounded size, so memory does not grow with the batch.
A single text longer than the slice is processed whole, never cut.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time.
SLICE_BYTES = 1 << 20

# An odd 64-bit base for polynomial hashes and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: True for the bytes that end a word under the rule ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: True for the bytes of a run of letters: ASCII letters and every byte of a non-ASCII character.
LETTER = np.zeros(256, bool)
LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = True
#: Letters and digits.
ALNUM = LETTER.copy()
ALNUM[list(range(ord("0"), ord("9") + 1))] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, kept for the next batch."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


_kept: dict = {}


def kept(key, build: Callable[[], object]):
    """What this worker keeps between tasks.  Spark gives one worker to many operators in turn, so only
    the last one's tables stay in memory."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = build()
    return _kept[key]


def trimmed(run: Callable) -> Callable:
    """``run``, which turns batches into batches, with the memory that its task no longer uses given back to
    the system at its end.  Workers wait for the next task with what they hold, beside the executor's own heap."""
    @functools.wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()
    return inner


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that any of their bits can serve as an address."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of consecutive rows: byte ranges in ``data``, their hashes and the row each stands in."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    rows: int
    first_row: int


def texts(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and ``rows + 1`` offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one longer row."""
    row, last = 0, len(offsets) - 1
    while row < last:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        stop = min(max(stop, row + 1), last)
        yield row, stop
        row = stop


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """``n + 1`` running sums; ``range_hash`` turns two of them into the hash of the bytes between."""
    power, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def words(column: pa.Array | pa.ChunkedArray, inside: np.ndarray, lower: bool = True) -> Iterator[Words]:
    """Words (maximal runs of ``inside`` bytes within a row) of a string column, slice by slice."""
    data, offsets = texts(column, lower)
    for low, high in slices(offsets):
        piece, bounds = data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
        is_word = inside[piece]
        before, after = np.zeros(len(piece), bool), np.zeros(len(piece), bool)
        before[1:], after[:-1] = is_word[:-1], is_word[1:]
        before[bounds[:-1][bounds[:-1] < len(piece)]] = False
        after[bounds[1:][bounds[1:] > 0] - 1] = False
        start, end = np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1
        row = np.searchsorted(bounds, start, side="right") - 1
        yield Words(piece, start, end, row, range_hash(prefix_hashes(piece), start, end), high - low, low)


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
