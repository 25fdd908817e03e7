"""Repeated substrings, found by deep-shallow suffix sorting of the places that can repeat.

A string of ``WINDOW`` bytes has an anchor: the place in it with the least hash of ``GRAM`` bytes, the
first of equals.  Equal strings have their anchors at one offset, and neighbouring strings mostly share
an anchor, so texts become runs of strings with one anchor, some 35 bytes apart.  Runs meet by the hash
at their anchor, after each slice of texts has merged its own equal runs:

* a hash that occurs once belongs to no repeated string;
* of runs that are equal from the first string's start to the last one's end all but the first are
  repeats altogether, and the first one stands for them;
* where runs of one hash differ, their bytes are fetched and the suffixes at their anchors, and the
  reversed prefixes before them, are sorted: multikey quicksort to ``SHALLOW`` bytes, blind tries for the
  groups that are still equal there.  With both orders and their common-prefix lengths, strings at one
  offset are equal if they are in one class of either order.

A hash with more than ``HOT_ROWS`` different runs is not sorted in one task: its strings are grouped one
by one instead, in an aggregation that spreads over all tasks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import salted_join
from ..session import is_empty, settle, spread
from .batches import kept, mix, powers, prefix_hashes, range_hash, slices, texts
from .periodic import sliding_min

#: Bytes of a string that is looked for, and of the hash at its anchor.
WINDOW, GRAM = 100, 32
#: Bytes that quicksort looks at before blind tries take over.
SHALLOW = 32
#: Runs sorted at a time, and runs of one hash that one task may hold.
BLOCK_ROWS, HOT_ROWS = 1 << 15, 1 << 18
#: Stands for a null id, before every other.
NO_ID = -(1 << 63)
_RUN = "gram bigint, ctx bigint, id bigint, th bigint, lo bigint, reach int, span bigint"
_TOLD = "gram bigint, id bigint, th bigint, lo bigint, reach int, span bigint"
_BYTES = "gram bigint, id bigint, th bigint, lo bigint, reach int, body binary"
_MARK = "id bigint, th bigint, start bigint, stop bigint"
#: Values of ``reach`` beside the offset of an anchor: the row is a repeated range, or one of a hot hash.
_MARKED, _HOT = -1, 1 << 10


def anchored(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """``first, last, anchor`` of the runs of strings in texts that lie between ``bounds``, with the hash
    at the anchor and the hash of all their bytes."""
    n = len(data)
    if n < WINDOW:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    sums = prefix_hashes(data)
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * powers(n + 1)[1][:n - GRAM + 1])
    bits = np.uint64(n.bit_length())
    # The place in the low bits makes the first of equal hashes the least.
    least = sliding_min((grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64), WINDOW - GRAM + 1)
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    edge = np.zeros(n + 2, np.int32)
    size = np.diff(bounds)
    np.add.at(edge, bounds[:-1][size >= WINDOW], 1)
    np.add.at(edge, bounds[1:][size >= WINDOW] - WINDOW + 1, -1)
    whole = np.cumsum(edge[:len(anchor)]) > 0
    begins, ends = whole.copy(), whole.copy()
    same = (anchor[1:] == anchor[:-1]) & whole[1:] & whole[:-1]
    begins[1:] &= ~same
    ends[:-1] &= ~same
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    anchor = anchor[first]
    body = range_hash(sums, first, last + WINDOW)
    ctx = mix(body + ((anchor - first) * 256 + (last - first)).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    return first, last, anchor, grams[anchor], ctx


def merged(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges per row, ordered by row and start with stops in order too, joined where they touch."""
    if not len(row):
        return row, start, stop
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (start[1:] > stop[:-1])
    at = np.flatnonzero(fresh)
    return row[at], start[at], stop[np.append(at[1:], len(row)) - 1]


def _table(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    types = [{"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns differs from the row before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of every slice of texts; what repeats within the slice comes as marked ranges."""
    kept("suffixes", dict)
    for batch in batches:
        ids, hashes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "th"))
        data, offsets = texts(batch.column("text"))
        for low, high in slices(offsets):
            bounds = offsets[low:high + 1] - offsets[low]
            first, last, anchor, gram, ctx = anchored(data[offsets[low]:offsets[high]], bounds)
            row = np.searchsorted(bounds, first, side="right") - 1
            id_, th, lo = ids[low + row], hashes[low + row], first - bounds[row]
            order = np.lexsort((lo, th, id_, ctx))
            lead = _changes(ctx[order])
            # A row that is repeated as a whole is one document.
            again = ~_changes(ctx[order], id_[order], th[order], lo[order])
            own, other = order[lead], np.sort(order[~lead & ~again])
            yield _table(_RUN, gram[own].view(np.int64), ctx[own].view(np.int64), id_[own], th[own], lo[own], (anchor - first)[own], (last - first)[own])
            owner, start, stop = merged(row[other], lo[other], (last - bounds[row])[other] + WINDOW)
            spot = mix(hashes[low + owner].view(np.uint64) + start.astype(np.uint64)).view(np.int64)
            yield _table(_RUN, spot, np.zeros_like(start), ids[low + owner], hashes[low + owner], start, np.full(len(start), _MARKED), stop - start)


def _blocks(batches: Iterator[pa.RecordBatch], hot_rows: int) -> Iterator[tuple[pa.Table, bool]]:
    """Tables of whole hashes from rows ordered by ``gram``; a hash that outgrows ``hot_rows`` comes in
    parts, flagged."""
    waiting: list[pa.RecordBatch] = []
    count, hot = 0, None
    def cut(table: pa.Table, ended: bool) -> Iterator[tuple[pa.Table, bool]]:
        nonlocal waiting, count, hot
        gram = table.column("gram").to_numpy()
        if hot is not None:
            end = int(np.searchsorted(gram, hot, side="right"))
            yield table.slice(0, end), True
            table, gram = table.slice(end), gram[end:]
            hot = hot if not len(gram) else None
        whole = len(gram) if ended or not len(gram) else int(np.searchsorted(gram, gram[-1], side="left"))
        if whole:
            yield table.slice(0, whole), False
        rest = table.slice(whole)
        if rest.num_rows > hot_rows:
            hot = gram[-1]
            yield rest, True
            rest = rest.slice(rest.num_rows)
        waiting, count = rest.to_batches() if rest.num_rows else [], rest.num_rows
    for batch in batches:
        waiting.append(batch)
        count += batch.num_rows
        # A large group is looked at again only after it has doubled.
        if batch.num_rows and count >= max(min(BLOCK_ROWS, hot_rows), 2 * waiting[0].num_rows):
            yield from cut(pa.Table.from_batches(waiting).combine_chunks(), False)
    if waiting:
        yield from cut(pa.Table.from_batches(waiting).combine_chunks(), True)


def _meet(batches: Iterator[pa.RecordBatch], hot_rows: int) -> Iterator[pa.RecordBatch]:
    """Of the runs of each hash: marked ranges for those that equal an earlier run, and one run for each
    kind where there are several kinds."""
    for table, hot in _blocks(batches, hot_rows):
        gram, ctx, id_, th, lo, reach, span = (table.column(c).to_numpy() for c in ("gram", "ctx", "id", "th", "lo", "reach", "span"))
        marked = reach == _MARKED
        yield _table(_TOLD, gram[marked], id_[marked], th[marked], lo[marked], reach[marked], span[marked])
        rest = np.flatnonzero(~marked)
        if hot:
            yield _table(_TOLD, gram[rest], id_[rest], th[rest], lo[rest], reach[rest] + _HOT, span[rest])
            continue
        alone = _changes(gram[rest])
        alone &= np.append(alone[1:], True)
        rest = rest[~alone]
        rest = rest[np.lexsort((lo[rest], th[rest], id_[rest], ctx[rest], gram[rest]))]
        rest = rest[_changes(gram[rest], ctx[rest], id_[rest], th[rest], lo[rest])]
        lead = _changes(gram[rest], ctx[rest])
        other = rest[~lead]
        yield _table(_TOLD, gram[other], id_[other], th[other], lo[other], np.full(len(other), _MARKED), span[other] + WINDOW)
        own = rest[lead]
        alone = _changes(gram[own])
        alone &= np.append(alone[1:], True)
        own = own[~alone]
        yield _table(_TOLD, gram[own], id_[own], th[own], lo[own], reach[own], span[own])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each run from the text that holds it."""
    for batch in batches:
        want, count = batch.column("want").flatten(), batch.column("want").value_lengths().to_numpy()
        gram, lo, reach, span = (want.field(c).to_numpy() for c in ("gram", "lo", "reach", "span"))
        body, at = [], 0
        for text, n in zip(batch.column("text").cast(pa.large_binary()), count.tolist()):
            text = text.as_buffer()
            body += [text[s:e].to_pybytes() for s, e in zip(lo[at:at + n].tolist(), (lo + span + WINDOW)[at:at + n].tolist())]
            at += n
        yield _table(_BYTES, gram, *(np.repeat(batch.column(c).to_numpy(), count) for c in ("id", "th")), lo, reach, body)


class BlindTrie:
    """A trie whose inner nodes know only the depth at which their strings part and the next symbol of
    each branch.  ``insert`` goes down blindly to some leaf, compares once, and branches off at the depth
    where the two strings part.  The end of a string is symbol -1."""

    def __init__(self, strings: list[bytes]) -> None:
        self.strings, self.root = strings, None

    def _symbol(self, k: int, depth: int) -> int:
        own = self.strings[k]
        return own[depth] if depth < len(own) else -1

    def insert(self, k: int) -> None:
        if self.root is None:
            self.root = [k]
            return
        node, path = self.root, []
        while isinstance(node, tuple):
            path.append(node)
            node = node[1].get(self._symbol(k, node[0])) or next(iter(node[1].values()))
        a, b = self.strings[k], self.strings[node[0]]
        if a == b:
            node.append(k)
            return
        n = min(len(a), len(b))
        differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
        depth = n - (differ.bit_length() + 7) // 8
        keep = [p for p in path if p[0] <= depth]
        if keep and keep[-1][0] == depth:
            keep[-1][1][self._symbol(k, depth)] = [k]
            return
        below = path[len(keep)] if len(keep) < len(path) else node
        fork = (depth, {self._symbol(node[0], depth): below, self._symbol(k, depth): [k]})
        if keep:
            keep[-1][1][self._symbol(k, keep[-1][0])] = fork
        else:
            self.root = fork

    def order(self) -> list[int]:
        out, open_nodes = [], [self.root]
        while open_nodes:
            node = open_nodes.pop()
            if isinstance(node, tuple):
                open_nodes += [child for _, child in sorted(node[1].items(), reverse=True, key=lambda x: x[0])]
            else:
                out += node
        return out


def multikey_quicksort(words: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The order of rows by group and their first ``depth`` words, and the ranges of it that are equal in
    all of these.  All open ranges are split at once: each by the word of its middle row into smaller,
    equal and larger; the equal part goes on with the next word."""
    order = np.argsort(group, kind="stable")
    at = np.flatnonzero(_changes(group[order]))
    start, size = at, np.diff(np.append(at, len(order)))
    level, deep = np.zeros(len(start), np.int64), []
    while True:
        done = (level >= depth) & (size > 1)
        deep += zip(start[done].tolist(), (start + size)[done].tolist())
        keep = (size > 1) & ~done
        start, size, level = start[keep], size[keep], level[keep]
        if not len(start):
            return order, deep
        place = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        key = words[order[place], np.repeat(level, size)]
        pivot = np.repeat(words[order[start + size // 2], level], size)
        part = 3 * np.repeat(np.arange(len(start)), size) + (key >= pivot) + (key > pivot)
        order[place] = order[place[np.argsort(part, kind="stable")]]
        count = np.bincount(part, minlength=3 * len(start)).reshape(-1, 3)
        level = (level[:, None] + np.array([0, 1, 0])).ravel()
        start = (start[:, None] + np.cumsum(count, axis=1) - count).ravel()
        size = count.ravel()


def deep_shallow(strings: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``strings`` within their groups, and how many bytes each one in it shares with the
    one before (-1 where a group begins)."""
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    width = -(-(int(size.max(initial=0)) + 1) // 4) * 4
    # Symbols from 1; 0 is the end of a string.
    table = np.zeros((len(strings), width), ">u2")
    row = np.repeat(np.arange(len(strings)), size)
    table[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = np.frombuffer(b"".join(strings), np.uint8) + np.uint16(1)
    order, deep = multikey_quicksort(table.view(">u8").astype(np.uint64), group, min(SHALLOW, width) // 4)
    for low, high in deep:
        trie = BlindTrie(strings)
        for k in order[low:high].tolist():
            trie.insert(k)
        order[low:high] = trie.order()
    parts = table[order[1:]] != table[order[:-1]]
    common = np.where(parts.any(axis=1), parts.argmax(axis=1), size[order[:-1]])
    common[group[order[1:]] != group[order[:-1]]] = -1
    return order, np.concatenate(([-1], common))


def _classes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """A number per string that is equal for those of one group with equal first ``depth`` bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def repeated_strings(gram: np.ndarray, reach: np.ndarray, body: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``row, offset`` of the strings that equal one of an earlier row; ``offset`` is from the string's
    start to the anchor.  Rows come in the order of documents and places."""
    gap = WINDOW - GRAM
    right = deep_shallow([b[r + GRAM:] for b, r in zip(body, reach.tolist())], gram)
    left = deep_shallow([b[:r][::-1] for b, r in zip(body, reach.tolist())], gram)
    least = reach - np.fromiter(map(len, body), np.int64, len(body)) + WINDOW
    rows, offsets = [], []
    for offset in range(int(least.min(initial=0)), int(reach.max(initial=-1)) + 1):
        own = np.flatnonzero((least <= offset) & (offset <= reach))
        key = _classes(*right, gap - offset)[own] * (len(body) + 1) + _classes(*left, offset)[own]
        later = np.ones(len(own), bool)
        later[np.unique(key, return_index=True)[1]] = False
        rows.append(own[later])
        offsets.append(np.full(int(later.sum()), offset))
    return np.concatenate(rows), np.concatenate(offsets)


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marked ranges of what the sorted runs repeat."""
    for table, _ in _blocks(batches, sys.maxsize):
        gram, id_, th, lo, reach = (table.column(c).to_numpy() for c in ("gram", "id", "th", "lo", "reach"))
        order = np.lexsort((lo + reach, th, id_, gram))
        order = order[_changes(gram[order], id_[order], th[order], lo[order])]
        order = order[np.lexsort(((lo + reach)[order], th[order], id_[order]))]
        body = table.column("body").take(pa.array(order)).to_pylist()
        row, offset = repeated_strings(gram[order], reach[order].astype(np.int64), body)
        start = (lo + reach)[order][row] - offset
        sort = np.lexsort((start, row))
        row, start, stop = merged(row[sort], start[sort], start[sort] + WINDOW)
        yield _table(_MARK, id_[order][row], th[order][row], start, stop)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes of each string of a run."""
    for batch in batches:
        id_, th, lo = (batch.column(c).to_numpy() for c in ("id", "th", "lo"))
        data, offsets = texts(batch.column("body").cast(pa.large_binary()).view(pa.large_string()))
        count = np.diff(offsets) - WINDOW + 1
        row = np.repeat(np.arange(len(count)), count)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        at = offsets[row] + inside
        a, b = range_hash(prefix_hashes(data), at, at + WINDOW), range_hash(prefix_hashes(data ^ np.uint8(0x5A)), at, at + WINDOW)
        yield _table(f"a bigint, b bigint, {_MARK}", a.view(np.int64), b.view(np.int64), id_[row], th[row], lo[row] + inside, lo[row] + inside + WINDOW)


def repeated_ranges(docs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``id, th, start, stop`` ranges (bytes, overlapping) that repeat earlier strings, for texts ``id, th, text``."""
    long = docs.filter(F.octet_length("text") >= WINDOW)
    runs = spread(long).mapInArrow(_scan, _RUN)
    told = settle(runs.repartition("gram").sortWithinPartitions("gram").mapInArrow(partial(_meet, hot_rows=hot_rows), _TOLD))
    marks = told.filter(F.col("reach") == _MARKED).select("id", "th", F.col("lo").alias("start"), (F.col("lo") + F.col("span")).alias("stop"))
    wanted = told.filter(F.col("reach") != _MARKED).groupBy("id", "th").agg(F.collect_list(F.struct("gram", "lo", F.pmod("reach", F.lit(_HOT)).cast("int").alias("reach"), "span")).alias("want"))
    bodies = long.join(wanted, ["id", "th"]).mapInArrow(_fetch, _BYTES)
    hot = settle(told.filter(F.col("reach") >= _HOT).select("gram").distinct())
    if is_empty(hot):
        return marks.unionByName(bodies.repartition("gram").sortWithinPartitions("gram").mapInArrow(_sorted, _MARK))
    bodies = settle(bodies)
    found = bodies.join(hot, "gram", "left_anti").repartition("gram").sortWithinPartitions("gram").mapInArrow(_sorted, _MARK)
    # Of a hot hash every string is grouped by itself; equal ones combine before the shuffle.
    strings = settle(bodies.join(hot, "gram", "left_semi").select(*(c.split()[0] for c in _BYTES.split(", "))).mapInArrow(_strings, f"a bigint, b bigint, {_MARK}"))
    least = strings.groupBy("a", "b").agg(F.min(F.struct("id", "th", "start")).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = salted_join(settle(least), strings, ["a", "b"], "start").filter(F.struct("id", "th", "start") != F.col("least"))
    return marks.unionByName(found).unionByName(later.select("id", "th", "start", "stop"))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and remaining bytes of each text."""
    for batch in batches:
        out = []
        for text, ranges in zip(batch.column("text").cast(pa.large_binary()), batch.column("ranges")):
            text, at, removed, spans, parts = text.as_buffer().to_pybytes(), 0, 0, 0, []
            if ranges.is_valid:
                start, stop = (ranges.values.field(c).to_numpy() for c in ("start", "stop"))
                order = np.argsort(start, kind="stable")
                _, start, stop = merged(np.zeros(len(order), np.int64), start[order], np.maximum.accumulate(stop[order]))
                spans, removed = len(start), int((stop - start).sum())
                for low, high in zip(start.tolist(), stop.tolist()):
                    parts.append(text[at:low])
                    at = high
            out.append((len(text), removed, spans, b"".join([*parts, text[at:]]) if parts else text))
        yield pa.RecordBatch.from_arrays([batch.column("_id"), *(pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary())))],
                                         names=["_id", "n_bytes", "n_removed", "n_spans", "remaining"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, remaining`` for every row of ``docs``.

    Removed is every byte that lies in a string of ``WINDOW`` bytes which also starts earlier: in a
    document with a smaller id, or before in the same one.  ``remaining`` holds the other bytes.  Matches
    never cross documents, and strings are judged on the texts as they come.  Ids are integers, a null
    id is before all others.  Different texts with one id are ordered by their hash; rows that repeat id
    and text are one document, and each row is reported.  Null and short texts stay as they are, a null
    one as empty; an empty table gives no rows; other columns are ignored whatever their names.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    ranges = repeated_ranges(keyed.drop("_id")).groupBy("id", "th").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    schema = f"_id {keyed.schema['_id'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, remaining binary"
    joined = keyed.join(ranges, ["id", "th"], "left").select("_id", "text", "ranges")
    return joined.mapInArrow(_without, schema).withColumnRenamed("_id", id_col)
