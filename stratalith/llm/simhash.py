"""Near duplicates: SimHash fingerprints linked through BK-trees of pigeonhole shards.

Fingerprints that differ in at most ``radius`` bits agree on at least ``blocks - radius`` of any
``blocks`` disjoint blocks of bits.  So equal fingerprints are merged first, each distinct one goes to
one shard per choice of that many blocks, and only fingerprints of one shard can be linked.  A shard is
searched through a BK-tree: children are keyed by their Hamming distance to the parent, and a search
follows only the edges within the radius.  A shard above ``SHARD_LIMIT`` fingerprints is split again on
the bits that are still free, which loses no link and ends where the free bits cannot hold more.

Near fingerprints do not follow from a share of common shingles.  So where a ``likeness`` is asked for,
candidates come from the sketches (one-permutation minima of the five-word shingles) alone: texts that
agree on one of ``BANDS`` bands of places, a rule that is the same for tables of every size.  A link
needs sketches that put the share of common shingles at the likeness or above.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..operators.skew import salted_join
from ..session import Ledger, is_empty, settle
from .batches import kept, mix, trimmed

#: Distinct fingerprints that one BK-tree may hold before its shard is split.
SHARD_LIMIT = 2048
#: Shingles whose bits are counted at a time.
COUNT_ROWS = 1 << 16
SEED = 42
#: Places of a sketch.  One holds 0 if no shingle falls on it, else 1 to 255 from the least hash.
PLACES = 128
#: Bands of a sketch, of ``BAND`` places each: of texts with four fifths of their shingles in common,
#: (1 - 0.8**5)**25 or five in 100,000 agree on none.
BANDS, BAND = 25, 5
#: Distinct sketches that are compared at a time.
GROUP_LIMIT = 1024
#: Shingles of the sets that are compared at a time.
GROUP_SHINGLES = 1 << 20
#: How far below a likeness an estimate may lie for a pair to be compared by its shingles: 2.8 standard
#: deviations of an estimate from 128 places at four fifths.
SLACK = 0.1


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of every run of ``shingle`` words; of the whole sequence if it is shorter; none of none."""
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] * bool(words), np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, len(words) - shingle + 1)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # bytes: A-Z only, and the six ASCII blanks


def sketch(words: list[bytes], shingle: int) -> bytes:
    return sketch_of(np.sort(shingle_hashes(words, shingle)))


def sketch_of(hashes: np.ndarray) -> bytes:
    """One byte per place: of the sorted hashes that fall on it the least, folded to 1..255."""
    place, first = np.unique(hashes % np.uint64(PLACES), return_index=True)
    out = np.zeros(PLACES, np.uint8)
    out[place.astype(np.int64)] = hashes[first] // np.uint64(PLACES) % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def alike(a: bytes, b: bytes) -> float:
    """Estimated share of common shingles, from the places that either sketch fills."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    filled = (x | y) > 0
    return float((x == y)[filled].mean()) if filled.any() else 1.0


# Where an empty place looks for its value, itself first, then all others.
_ORDER = mix(np.arange(1, PLACES * PLACES + 1, dtype=np.uint64)).reshape(PLACES, PLACES)
np.fill_diagonal(_ORDER, 0)
_ORDER = np.argsort(_ORDER, axis=1)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """A key per row and band for rows of sketches that are not empty.  Empty places take the value of
    the first filled one in their order, so that texts of few shingles have keys as telling as theirs."""
    places = BANDS * BAND
    donor = np.repeat(np.arange(PLACES)[None, :places], len(sketches), axis=0)
    for step in range(1, PLACES):
        row, place = np.nonzero(np.take_along_axis(sketches, donor, axis=1) == 0)
        if not len(row):
            break
        donor[row, place] = _ORDER[place, step]
    value = (donor * 256 + np.take_along_axis(sketches, donor, axis=1)).astype(np.uint64).reshape(-1, BANDS, BAND)
    total = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None], len(sketches), axis=0)
    for at in range(BAND):
        total = mix(total * np.uint64(0xD6E8FEB86659FD93) + value[:, :, at])
    return total.view(np.int64)


def stacked(sketches: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint8).reshape(-1, PLACES)


def likenesses(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``alike`` of rows of sketches."""
    filled = ((a | b) > 0).sum(axis=1)
    return ((a == b) & (a > 0)).sum(axis=1) / np.maximum(filled, 1)


def fingerprint(words: list[bytes], shingle: int) -> int:
    """The signed 64-bit SimHash of the word shingles, repeats included, of one whole text."""
    hashes = shingle_hashes(words, shingle)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNT_ROWS):
        bits = np.unpackbits(hashes[at:at + COUNT_ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, sketched: int = 0) -> DataFrame:
    """``id_col, fp, sketch``: one row per input row; ``sketched`` is the shingle of the sketch, which
    is empty for 0.  Null and blank texts have fingerprint 0; a text of fewer words than a shingle is
    one shingle.  Other columns of ``docs`` are ignored."""
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("fingerprints", dict)  # nothing is kept, and what an operator before this one kept goes
        for batch in batches:
            prints, sketches = [], []
            for text in batch.column(1).cast(pa.large_binary()):
                words = words_of(text.as_buffer().to_pybytes() if text.is_valid else None)
                prints.append(fingerprint(words, shingle))
                sketches.append(sketch(words, sketched) if sketched else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64()), pa.array(sketches, pa.binary())], names=["_id", "fp", "sketch"])
    return picked.mapInArrow(run, f"_id {picked.schema['_id'].dataType.simpleString()}, fp bigint, sketch binary").withColumnRenamed("_id", id_col)


class BKTree:
    """Nodes are integers; the child of a node at distance d hangs on its edge d."""

    def __init__(self) -> None:
        self.nodes: list[tuple[int, dict]] = []

    def within(self, value: int, radius: int) -> list[int]:
        found, open_nodes = [], self.nodes[:1]
        while open_nodes:
            node, children = open_nodes.pop()
            distance = (node ^ value).bit_count()
            if distance <= radius:
                found.append(node)
            for edge in range(distance - radius, distance + radius + 1):
                if edge in children:
                    open_nodes.append(children[edge])
        return found

    def add(self, value: int) -> None:
        fresh = (value, {})
        if not self.nodes:
            self.nodes.append(fresh)
            return
        node, children = self.nodes[0]
        while (distance := (node ^ value).bit_count()) in children:
            node, children = children[distance]
        children[distance] = fresh


def spanning_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links between the distinct fingerprints of one shard that connect what is connected in it; fewer
    than its rows."""
    tree, root, links = BKTree(), {v: v for v in values}, []
    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v
    for value in values:
        for near in tree.within(value, radius):
            a, b = find(value), find(near)
            if a != b:
                root[a] = b
                links.append((value, near))
        tree.add(value)
    return links


def _bits(positions: range) -> int:
    return sum(1 << p for p in positions)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _cut(positions: list[int], pieces: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(np.array(positions), pieces)]


def _trees(radius: int):
    """Partitions sorted by shard in, spanning links out; a shard may go on in the next batch."""
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("trees", dict)
        shard, rows = None, []
        for batch in batches:
            mask, key, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(mask):
                continue
            bounds = [0, *(np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1).tolist(), len(mask)]
            links = []
            for low, high in zip(bounds[:-1], bounds[1:]):
                here = (mask[low], key[low])
                if here != shard:
                    links += spanning_links(rows, radius) if len(rows) > 1 else []
                    shard, rows = here, []
                # A shard of one row, the common case, is done when the next one begins.
                if high - low > 1 or rows or high == len(mask) or low == 0:
                    rows += fp[low:high].tolist()
            yield _pairs(links)
        if len(rows) > 1:
            yield _pairs(spanning_links(rows, radius))
    return run


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _keyed(values: DataFrame, masks: dict[int, int]) -> DataFrame:
    """A row ``mask, shard, fp`` for every fingerprint and mask."""
    choices = F.array(*(F.struct(F.lit(k).alias("mask"), F.lit(_signed(m)).alias("bits")) for k, m in masks.items()))
    return (values.select("fp", F.explode(choices).alias("m"))
            .select(F.col("m.mask").alias("mask"), F.col("fp").bitwiseAND(F.col("m.bits")).alias("shard"), "fp"))


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """``a, b``: links between the distinct fingerprints ``fp`` that connect everything within ``radius``
    bits of each other.  Rows in a shard are at most ``SHARD_LIMIT``, or as many as the free bits allow."""
    blocks = radius + 2
    cuts = _cut(list(range(64)), blocks)
    fixed = {k: [p for block in choice for p in block] for k, choice in enumerate(combinations(cuts, blocks - radius))}
    found, current = [], _keyed(distinct, {k: _bits(p) for k, p in fixed.items()})
    while True:
        hot = current.groupBy("mask", "shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SHARD_LIMIT).select("mask", "shard")
        hot = settle(hot)
        last = is_empty(hot) or min(64 - len(p) for p in fixed.values()) <= SHARD_LIMIT.bit_length() - 1
        rest = current if last else current.join(hot, ["mask", "shard"], "left_anti")
        # Round numbers of partitions come from the session; sorting makes each shard one run of rows.
        found.append(rest.repartition("mask", "shard").sortWithinPartitions("mask", "shard", "fp").mapInArrow(_trees(radius), "a bigint, b bigint"))
        if last:
            break
        # Split the hot shards: within one, fp differs in free bits only, so one of radius + 1 cuts of them agrees.
        busy = settle(current.join(hot, ["mask", "shard"], "left_semi"))
        deeper, sets = {}, []
        for k, positions in fixed.items():
            free = [p for p in range(64) if p not in set(positions)]
            for cut in _cut(free, radius + 1):
                deeper[len(deeper)] = positions + cut
                sets.append((k, len(deeper) - 1))
        choices = F.array(*(F.struct(F.lit(k).alias("old"), F.lit(new).alias("mask"), F.lit(_signed(_bits(deeper[new]))).alias("bits")) for k, new in sets))
        own = F.filter(choices, lambda m: m["old"] == F.col("mask"))
        current = (busy.select("fp", F.explode(own).alias("m"))
                   .select(F.col("m.mask").alias("mask"), F.col("fp").bitwiseAND(F.col("m.bits")).alias("shard"), "fp"))
        fixed = deeper
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


@trimmed
def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept("bands", dict)
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            own = stacked(part.column(1))
            filled = own.any(axis=1)
            keys = band_keys(own[filled])
            node = part.column(0).to_numpy(zero_copy_only=False)[filled]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel(), pa.int64()), pa.array(np.repeat(node, BANDS), pa.int64())], names=["key", "node"])


def _compared(likeness: float):
    """``a, b, x, y`` with sketches x and y in, the pairs that are alike out."""
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("compared", dict)
        for batch in batches:
            alike = likenesses(stacked(batch.column(2)), stacked(batch.column(3))) >= likeness
            yield batch.select([0, 1]).filter(pa.array(alike))
    return run


def joining_links(nodes: list[int], components: list[int], sketches: np.ndarray, likeness: float) -> list[tuple[int, int]]:
    """Links between rows of different components that connect all that are alike; every such pair is
    compared until its rows are connected."""
    _, root = np.unique(np.array(components), return_inverse=True)
    links = []
    for k in range(1, len(nodes)):
        others = np.flatnonzero(root[:k] != root[k])
        near = others[likenesses(sketches[others], sketches[k:k + 1]) >= likeness] if len(others) else others
        for at in near.tolist():
            if root[at] != root[k]:
                root[root == root[at]] = root[k]
                links.append((nodes[k], nodes[at]))
    return links


def _blocks(likeness: float):
    """Partitions sorted by block in, links out; a block may go on in the next batch."""
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("blocks", dict)
        block, rows = None, []
        def done() -> pa.RecordBatch:
            node, component, own = zip(*rows)
            return _pairs(joining_links(node, component, np.frombuffer(b"".join(own), np.uint8).reshape(-1, PLACES), likeness))
        for batch in batches:
            for *here, node, component, own in zip(*(c.to_pylist() for c in batch.columns)):
                if here != block:
                    if len(rows) > 1:
                        yield done()
                    block, rows = here, []
                rows.append((node, component, own))
        if len(rows) > 1:
            yield done()
    return run


def likeness_links(distinct: DataFrame, likeness: float) -> DataFrame:
    """``a, b``: links between the distinct ``node, sketch`` rows that connect all that share a band and
    are alike.

    First every row of a group (the rows of one band key) is compared with the group's first row, one
    pair per row, which settles a group of copies of one text whatever its size.  What is left are
    groups that still hold several components.  All their pairs across components are compared: groups
    above ``GROUP_LIMIT`` in pieces, each pair of pieces a block of its own, so no task grows with a group.
    """
    keyed = settle(distinct.select("node", "sketch").mapInArrow(_banded, "key bigint, node bigint"))
    groups = settle(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lead")).filter("n > 1"))
    members = settle(salted_join(groups, keyed, ["key"], "node"))
    stars = settle(members.filter(F.col("node") != F.col("lead")).select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct())
    left, right = (distinct.select(F.col("node").alias(c), F.col("sketch").alias(s)) for c, s in (("a", "x"), ("b", "y")))
    both = salted_join(left, stars, ["a"], "b").join(right, "b").select("a", "b", "x", "y")
    found = settle(both.mapInArrow(_compared(likeness), "a bigint, b bigint"))
    # A group of two is done.
    owned = members.filter("n > 2").select("key", "n", "node").join(connected_components(found), "node", "left").withColumn("component", F.coalesce("component", "node"))
    owned = settle(owned)
    mixed = settle(owned.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key"))
    pieces = F.ceil(F.col("n") / GROUP_LIMIT).cast("int")
    cut = (salted_join(mixed, owned, ["key"], "node").withColumn("pieces", pieces)
           .withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
           .select("key", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"), "node", "component"))
    rows = salted_join(distinct.select("node", "sketch"), cut, ["node"], "key").select("key", "i", "j", "node", "component", "sketch")
    more = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node").mapInArrow(_blocks(likeness), "a bigint, b bigint")
    return found.unionByName(more)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2,
                    likeness: float = 0.0, likeness_shingle: int = 5) -> DataFrame:
    """``id_col, fingerprint, component_id`` for every row of ``docs``.

    ``fingerprint`` is 16 hex digits; rows are linked if their fingerprints differ in at most
    ``radius`` bits, and ``component_id`` is the smallest id reachable over links (itself included).
    With a ``likeness``, rows are linked instead by that share of common ``likeness_shingle``-word
    shingles, as the sketches estimate it.  Repeated rows stay and share a component, null and blank
    texts are linked like any others, an empty table gives no rows, and other columns are ignored
    whatever their names.
    """
    marked = fingerprints(docs, id_col, text_col, shingle, likeness_shingle if likeness else 0)
    # Without sketches the fingerprint itself names a node.
    node = F.xxhash64("sketch") if likeness else F.col("fp")
    marked = settle(marked.select(id_col, node.alias("node"), "fp", "sketch"))
    first = settle(marked.groupBy("node", "sketch").agg(F.min(id_col).alias("_least")))
    joined = settle(likeness_links(first, likeness) if likeness else links(first.select(F.col("node").alias("fp")), radius))
    groups = connected_components(joined)
    linked = first.select("node", "_least").join(groups, "node")
    least = linked.groupBy("component").agg(F.min("_least").alias("_reach"))
    reached = linked.join(least, "component").select("node", "_reach")
    owner = settle(first.select("node", "_least").join(reached, "node", "left").select("node", F.least("_least", F.coalesce("_reach", "_least")).alias("component_id")))
    return (salted_join(owner, marked.select(id_col, "node", "fp"), ["node"], id_col)
            .select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int, whole: bool) -> DataFrame:
    """A row per row of ``docs``: its id as ``_id``, ``node`` (a hash of its set of shingles), and either the
    three-word ``fp`` with the ``sketch`` of the set, or the set itself as ``shingles`` if ``whole``."""
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("shingle sets", dict)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                nodes, first, second = [], [], []
                for text in part.column(1).cast(pa.large_binary()):
                    words = words_of(text.as_buffer().to_pybytes() if text.is_valid else None)
                    own = np.unique(shingle_hashes(words, shingle))
                    nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                    if whole:
                        first.append(own.view(np.int64))
                    else:
                        first.append(fingerprint(words, 3))
                        second.append(sketch_of(own))
                node = pa.array(np.array(nodes, np.uint64).view(np.int64))
                rest = [pa.array(first, pa.list_(pa.int64()))] if whole else [pa.array(first, pa.int64()), pa.array(second, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), node, *rest], names=["_id", "node", *(["shingles"] if whole else ["fp", "sketch"])])
    rest = "shingles array<bigint>" if whole else "fp bigint, sketch binary"
    return picked.mapInArrow(run, f"_id {picked.schema['_id'].dataType.simpleString()}, node bigint, {rest}")


def set_links(nodes: list[int], components: list[int], sets: list[np.ndarray], likeness: float) -> list[tuple[int, int]]:
    """Links between rows of different components that connect all whose ``sets`` (none empty, no repeats)
    have the share ``likeness`` in common; fewer than its rows."""
    _, root = np.unique(np.array(components), return_inverse=True)
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    held, links = np.zeros(len(values), np.int32), []
    for k in range(1, len(nodes)):
        if (root[:k] == root[k]).all():
            continue
        own = codes[ends[k - 1]:ends[k]]
        held[own] = 1
        common = np.add.reduceat(held[codes[:ends[k - 1]]], ends[:k] - sizes[:k])
        held[own] = 0
        for at in np.flatnonzero(common + 1e-9 >= likeness * (sizes[:k] + sizes[k] - common)).tolist():
            if root[at] != root[k]:
                root[root == root[at]] = root[k]
                links.append((nodes[k], nodes[at]))
    return links


def _set_blocks(likeness: float):
    """Partitions ``key, i, j, node, component, shingles`` sorted by block in, links out; a block may go on
    in the next batch."""
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("set blocks", dict)
        block, rows = None, []
        for batch in batches:
            for at, (*here, node, component) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:5]))):
                if here != block:
                    if len(rows) > 1:
                        yield _pairs(set_links(*map(list, zip(*rows)), likeness))
                    block, rows = here, []
                rows.append((node, component, batch.column(5)[at].values.to_numpy().copy()))
        if len(rows) > 1:
            yield _pairs(set_links(*map(list, zip(*rows)), likeness))
    return run


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", likeness: float = 0.8, shingle: int = 5, radius: int = 2) -> DataFrame:
    """``id_col, component_id`` for every row: linked are texts whose sets of ``shingle``-word shingles have
    the share ``likeness`` in common, as the sets themselves say.

    Candidates are texts whose fingerprints lie within ``radius`` (from the BK-trees) and texts that share a
    band of their sketches.  First every text meets one text of its group: pairs whose sketches are alike, less
    ``SLACK``, are compared by their sets.  Groups that still hold several components are then compared
    whole, set by set, in blocks of bounded size that say only how their rows are connected; no table of
    pairs is made, so rows do not grow with the square of a group.

    ``component_id`` is the smallest id that is reached.  Equal sets are one text; null and blank texts have
    the empty set.  Repeated rows share a component; a text that occurs under null ids only links nothing;
    an empty table gives no rows; other columns are ignored whatever their names.
    """
    low = likeness - SLACK
    marked = settle(shingle_sets(docs, id_col, text_col, shingle, whole=False))
    first = settle(marked.groupBy("node").agg(F.min("_id").alias("_least"), F.min("fp").alias("fp"), F.min("sketch").alias("sketch")))
    keyed = settle(first.select("node", "sketch").mapInArrow(_banded, "key bigint, node bigint"))
    groups = settle(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lead")).filter("n > 1"))
    members = settle(salted_join(groups, keyed, ["key"], "node"))
    prints = settle(first.groupBy("fp").agg(F.min("node").alias("lead")))
    near = links(prints.select("fp"), radius)
    for c in ("a", "b"):
        near = near.join(prints.select(F.col("fp").alias(c), F.col("lead").alias(f"_{c}")), c)
    same = salted_join(prints, first.select("fp", "node"), ["fp"], "node")
    stars = settle(_ordered(near.select(F.col("_a").alias("a"), F.col("_b").alias("b")).unionByName(same.select(F.col("lead").alias("a"), F.col("node").alias("b")))
                            .unionByName(members.select(F.col("lead").alias("a"), F.col("node").alias("b"))).filter("a <> b")))
    left, right = (first.select(F.col("node").alias(c), F.col("sketch").alias(s)) for c, s in (("a", "x"), ("b", "y")))
    both = salted_join(left, stars, ["a"], "b").join(right, "b").select("a", "b", "x", "y")
    pairs = settle(both.mapInArrow(_compared(low), "a bigint, b bigint"))
    # Sets of the texts that can still be compared, each once: those in a pair and those of larger groups.
    asked = settle(pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(members.filter("n > 2").select("node")).distinct())
    owners = settle(first.select("node", "_least").join(asked, "node").select("_least", F.col("node").alias("_wanted")))
    wanted = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(owners.select(F.col("_least").alias("_id")).distinct(), "_id", "left_semi")
    sets = shingle_sets(wanted, "_id", "_text", shingle, whole=True).join(asked, "node", "left_semi")
    sets = settle(sets.groupBy("node").agg(F.first("shingles").alias("shingles")))
    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(s)) for c, s in (("a", "x"), ("b", "y")))
    common = F.size(F.array_intersect("x", "y"))
    found = Ledger(docs.sparkSession)
    found.add(salted_join(left, pairs, ["a"], "b").join(right, "b")
              .filter(common + 1e-9 >= likeness * (F.size("x") + F.size("y") - common)).select("a", "b"))
    owned = settle(members.filter("n > 2").select("key", "node").join(sets.select("node", F.size("shingles").alias("size")), "node")
                   .join(connected_components(found.read()), "node", "left").withColumn("component", F.coalesce("component", "node")))
    pieces = F.greatest(F.ceil(F.count(F.lit(1)) / GROUP_LIMIT), F.ceil(F.sum("size") / GROUP_SHINGLES)).cast("int").alias("pieces")
    mixed = settle(owned.groupBy("key").agg(pieces, F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most").select("key", "pieces"))
    if not is_empty(mixed):
        # Two pieces share a block, so a piece needs one of its own only where it is the whole group.
        cut = settle(salted_join(mixed, owned, ["key"], "node").withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
                     .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).filter("piece <> other OR pieces = 1")
                     .select("key", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"), "node", "component"))
        rows = salted_join(sets, cut, ["node"], "key").select("key", "i", "j", "node", "component", "shingles")
        found.add(rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_set_blocks(likeness), "a bigint, b bigint"))
    reached = connected_components(found.read())
    linked = settle(first.select("node", "_least").join(reached, "node"))
    least = linked.groupBy("component").agg(F.min("_least").alias("component_id"))
    owner = first.select("node", "_least").join(linked.join(least, "component").select("node", "component_id"), "node", "left")
    owner = settle(owner.select("node", F.coalesce("component_id", "_least").alias("component_id")))
    return salted_join(owner, marked.select("_id", "node"), ["node"], "_id").select(F.col("_id").alias(id_col), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", likeness: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; all columns are kept.  Links need
    four fifths of the five-word shingles in common.  Of rows that repeat an id one stays.  Only ids are
    shuffled, and texts where ids repeat."""
    found = settle(near_copies(docs, id_col, text_col, likeness))
    dropped = settle(found.filter(F.col(id_col) != F.col("component_id")).select(id_col).distinct())
    out = docs.join(dropped, id_col, "left_anti")
    again = settle(found.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(id_col))
    if is_empty(again):
        return out
    return out.join(again, id_col, "left_anti").unionByName(out.join(again, id_col, "left_semi").dropDuplicates([id_col]))
