"""URL filter: host and path rules first, then a ratio of character language models.

Two variable-order Markov models, one of accepted and one of rejected URLs, give every character a
probability that blends all context lengths by Witten-Bell weights: a context counts the more, the more
often it was seen and the fewer different characters followed it.  A URL is blocked if its
length-normalised log-likelihood difference exceeds a threshold calibrated on URLs kept out of the
training.  Counts are kept in tables of a fixed number of buckets, so the models have a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .batches import mix, slices, texts

#: Longest context in characters (bytes), and buckets per model and context length.
ORDER = 5
BUCKETS = 1 << 18
#: One URL in so many, by hash, calibrates instead of training.
FOLDS = 5
#: Share of the accepted calibration URLs that the threshold may block.
FALSE_BLOCKS = 0.01
#: Cells per unit of score, for exact counts under the threshold.
GRID = 1000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for a null or one without ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    host = F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


class Rules:
    """``host/path`` rules with a verdict; the longest that fits wins, equal lengths by name."""

    def __init__(self, rules: list[tuple[str, str]]) -> None:
        self.of_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
            host, slash, path = rule.partition("/")
            self.of_host.setdefault(host.lower(), []).append((slash + path, rule, verdict))

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[str, str] | None = None
        suffix = host
        while suffix:
            for start, rule, verdict in self.of_host.get(suffix, ()):
                if path.startswith(start):
                    if best is None or (-len(rule), rule) < (-len(best[0]), best[0]):
                        best = (rule, verdict)
                    break
            _, _, suffix = suffix.partition(".")
        return best or (None, None)


def ruled(urls: DataFrame, rules: list[tuple[str, str]], id_col: str, url_col: str) -> DataFrame:
    """``id, url, host, path, rule, ruled`` for every row."""
    host, path = host_and_path(F.col(url_col))
    named = urls.select(F.col(id_col).alias("_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Rules(rules)
        for batch in batches:
            found = [table.match(h, p) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x[i] for x in found], pa.string()) for i in (0, 1))], names=["_id", "url", "host", "path", "rule", "ruled"])
    return named.mapInArrow(run, f"_id {named.schema['_id'].dataType.simpleString()}, url string, host string, path string, rule string, ruled string")


def _grams(column: pa.Array) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray, int, int]]:
    """For slices of rows: the row of each character and, per context length, the hashes of its context
    and of context with character.  Contexts do not cross rows; a shorter one stands at a row's start."""
    data, offsets = texts(column)
    for low, high in slices(offsets):
        piece, bounds = data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
        row = np.repeat(np.arange(high - low), np.diff(bounds))
        at = np.arange(len(piece)) - bounds[row]
        byte = piece.astype(np.uint64) + np.uint64(1)
        pairs, context = [], np.zeros(len(piece), np.uint64)
        for length in range(ORDER + 1):
            if length:
                before = np.zeros(len(piece), np.uint64)
                before[length:] = byte[:-length] if length < len(piece) else 0
                context = np.where(at >= length, mix(context * np.uint64(0x9E3779B97F4A7C15) + before), mix(context + np.uint64(length)))
            pairs.append((mix(context + np.uint64(length)), mix(context * np.uint64(0xC2B2AE3D27D4EB4F) + byte + np.uint64(length << 10))))
        yield row, pairs, bounds, low, high


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


@dataclass
class Model:
    """Per class and context length: uses of each context, kinds of character after it, uses of each
    context with character.  ``3 x classes x (ORDER + 1) x BUCKETS`` numbers, whatever the input."""

    uses: np.ndarray
    kinds: np.ndarray
    grams: np.ndarray

    def log_likelihood(self, pairs: list[tuple[np.ndarray, np.ndarray]], label: int) -> np.ndarray:
        """Log probability of each character, blended from no context to the longest."""
        p = np.full(len(pairs[0][0]), 1 / 256)
        for length, (context, gram) in enumerate(pairs):
            n, t = self.uses[label, length][_bucket(context)], self.kinds[label, length][_bucket(context)]
            seen = np.minimum(self.grams[label, length][_bucket(gram)], n)
            p = np.where(n > 0, (seen + t * p) / np.maximum(n + t, 1), p)
        return np.log(p)


def fit(labelled: DataFrame) -> Model:
    """The models of ``url, label`` rows (1 rejected, 0 accepted), from all of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("label", pa.int32()), ("length", pa.int32()), ("context", pa.int64()), ("gram", pa.int64()), ("n", pa.int64())])
        for batch in batches:
            labels = batch.column(1).to_numpy()
            for row, pairs, _, low, _ in _grams(batch.column(0)):
                mine = labels[low + row]
                for label in np.unique(mine):
                    for length, (context, gram) in enumerate(pairs):
                        keys, n = np.unique(np.stack([context[mine == label], gram[mine == label]]).view(np.int64), axis=1, return_counts=True)
                        size = keys.shape[1]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(size, label), pa.int32()), pa.array(np.full(size, length), pa.int32()), pa.array(keys[0]), pa.array(keys[1]), pa.array(n, pa.int64())], schema=schema)
    exact = labelled.mapInArrow(run, "label int, length int, context bigint, gram bigint, n bigint").groupBy("label", "length", "context", "gram").agg(F.sum("n").alias("n"))
    bucket = lambda c: F.col(c).bitwiseAND(BUCKETS - 1)
    exact = settle(exact)
    contexts = exact.groupBy("label", "length", bucket("context").alias("b")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("t"))
    grams = exact.groupBy("label", "length", bucket("gram").alias("b")).agg(F.sum("n").alias("n"))
    model = Model(*(np.zeros((2, ORDER + 1, BUCKETS), np.float32) for _ in range(3)))
    # At most one row per bucket comes back, in columns.
    for frame, targets in ((contexts, (("n", model.uses), ("t", model.kinds))), (grams, (("n", model.grams),))):
        table = frame.toArrow()
        label, length, b = (table[c].to_numpy() for c in ("label", "length", "b"))
        for column, target in targets:
            target[label, length, b] = table[column].to_numpy()
    return model


def scored(urls: DataFrame, model: Model) -> DataFrame:
    """``urls`` with ``score``: log likelihood as rejected less as accepted, per character; 0 if empty."""
    handle = urls.sparkSession.sparkContext.broadcast((model.uses, model.kinds, model.grams))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in urls.schema)}, score double"
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*handle.value)
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for row, pairs, bounds, low, high in _grams(batch.column(batch.schema.get_field_index("url"))):
                gain = own.log_likelihood(pairs, 1) - own.log_likelihood(pairs, 0)
                score[low:high] = np.bincount(row, gain, high - low) / np.maximum(np.diff(bounds), 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])
    return urls.mapInArrow(run, schema)


def threshold(held: DataFrame) -> float:
    """The score above which at most ``FALSE_BLOCKS`` of the accepted calibration URLs lie, and not
    below zero, where both models are equally likely.  Without such URLs it is zero."""
    cells = held.filter("label = 0").groupBy(F.ceil(F.col("score") * GRID).alias("cell")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("cell").desc()).collect()
    allowed, above = FALSE_BLOCKS * sum(r["n"] for r in cells), 0
    for r in cells:
        above += r["n"]
        if above > allowed:
            return max(0.0, r["cell"] / GRID)
    return 0.0


def judged(urls: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
           accepted: DataFrame | None = None, rejected: DataFrame | None = None) -> DataFrame:
    """``id_col, host, path, rule, score, verdict`` for every row of ``urls``.

    The verdict is the rule's, else block where the score exceeds the threshold.  The models learn from
    ``accepted`` and ``rejected`` (a column ``url`` each), or from the URLs that the rules allow and
    block.  A null URL counts as empty: no rule and allow.  Repeated rows are each judged, an empty
    table gives no rows, and other columns are ignored whatever their names.
    """
    known = settle(ruled(urls, rules, id_col, url_col))
    if accepted is None or rejected is None:
        labelled = known.filter("ruled IS NOT NULL").select("url", F.when(F.col("ruled") == "block", 1).otherwise(0).alias("label"))
    else:
        labelled = accepted.select("url", F.lit(0).alias("label")).unionByName(rejected.select("url", F.lit(1).alias("label")))
    labelled = labelled.select(F.coalesce("url", F.lit("")).alias("url"), "label").distinct()
    held = F.pmod(F.xxhash64("url"), F.lit(FOLDS)) == 0
    model = fit(labelled.filter(~held))
    limit = threshold(scored(labelled.filter(held), model))
    out = scored(known, model)
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", "score", F.coalesce("ruled", F.when(F.col("score") > limit, "block").otherwise("allow")).alias("verdict"))
