"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary.  A word's probability is
the sum over all its segmentations into pieces, which a forward pass computes; expectation-maximisation
with the matching backward pass learns the piece probabilities from the distinct words of each language
and their counts.  A text is scored by the product over its words.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .batches import LETTER, kept, mix, prefix_hashes, range_hash, trimmed, words

#: Longer runs of letters are cut into pieces of about this many bytes, between characters.
RUN_BYTES = 36
#: Words whose scores a worker remembers, and distinct words scored at a time.
REMEMBERED, AT_ONCE = 1 << 18, 1 << 13
#: Words are summed up within a batch once so many are waiting.
WAITING = 1 << 19
#: Scale per byte that keeps products of piece probabilities near one.
_SCALE = 64.0
#: Probabilities below this are worked out again: a double ends not far below.
_TINY = 1e-250


def read_pieces(model_path: str) -> list[bytes]:
    """The byte strings of a SentencePiece vocabulary that can occur in a lower-case word, with one for
    each single byte, so that every word has a segmentation."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
    found = {model.id_to_piece(i).encode() for i in plain}
    found |= {bytes([b]) for b in range(256)}
    letters = {p for p in found if all(LETTER[b] for b in p) and p.decode("utf-8", "ignore").lower().encode() == p or len(p) == 1}
    return sorted(letters)


class Vocabulary:
    """Pieces in an open-addressed table of their range hashes; also the hashes of all their prefixes."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.size = len(pieces)
        self.longest = max(map(len, pieces))
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        starts = ends - [len(p) for p in pieces]
        sums = prefix_hashes(flat)
        self.table = _Table(range_hash(sums, starts, ends), np.arange(self.size))
        prefixes = [range_hash(sums, starts[ends - starts > n], starts[ends - starts > n] + n) for n in range(1, self.longest)]
        known = np.unique(np.concatenate(prefixes or [np.zeros(0, np.uint64)]))
        self.prefixes = _Table(known, np.arange(len(known)))


class _Table:
    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int64)
        self.probes = 1
        for key, value in zip(keys, values):
            at, steps = int(key >> self.shift), 1
            while self.values[at] >= 0:
                at, steps = (at + 1) & self.mask, steps + 1
            self.keys[at], self.values[at] = key, value
            self.probes = max(self.probes, steps)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, or -1."""
        at = (keys >> self.shift).astype(np.int64)
        out = np.where(self.keys[at] == keys, self.values[at], -1)
        left = np.flatnonzero((out < 0) & (self.values[at] >= 0))
        for _ in range(self.probes - 1):
            if not len(left):
                break
            at[left] = (at[left] + 1) & self.mask
            here = at[left]
            out[left] = np.where(self.keys[here] == keys[left], self.values[here], -1)
            left = left[(out[left] < 0) & (self.values[here] >= 0)]
        return out


@dataclass
class Lattice:
    """All pieces in a set of words: ``word, start, end, piece`` of each edge, ordered by start."""

    word: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    lengths: np.ndarray

    @staticmethod
    def of(vocabulary: Vocabulary, items: list[bytes]) -> Lattice:
        data = np.frombuffer(b"".join(items), np.uint8)
        lengths = np.fromiter(map(len, items), np.int64, len(items))
        first = np.cumsum(lengths) - lengths
        sums = prefix_hashes(data)
        word = np.repeat(np.arange(len(items)), lengths)
        at = np.arange(len(data))
        limit = (first + lengths)[word]
        edges = []
        for n in range(1, vocabulary.longest + 1):
            keep = at + n <= limit
            at, word, limit = at[keep], word[keep], limit[keep]
            if not len(at):
                break
            keys = range_hash(sums, at, at + n)
            piece = vocabulary.table.find(keys)
            hit = np.flatnonzero(piece >= 0)
            edges.append(np.stack([word[hit], at[hit] - first[word[hit]], at[hit] - first[word[hit]] + n, piece[hit]]))
            more = vocabulary.prefixes.find(keys) >= 0
            at, word, limit = at[more], word[more], limit[more]
        table = np.concatenate(edges, axis=1) if edges else np.zeros((4, 0), np.int64)
        table = table[:, np.lexsort((table[2], table[1]))]
        return Lattice(*table, lengths)

    def _steps(self) -> list[tuple[int, int]]:
        """Ranges of edges with one start and one end: no two of a range meet in one word."""
        cut = np.flatnonzero((np.diff(self.start) != 0) | (np.diff(self.end) != 0)) + 1
        bounds = [0, *cut.tolist(), len(self.start)]
        return list(zip(bounds[:-1], bounds[1:])) if len(self.start) else []

    def forward(self, weight: np.ndarray) -> np.ndarray:
        """``alpha[word, position, language]``; ``weight`` is scaled, ``[piece, language]``."""
        alpha = np.zeros((len(self.lengths), int(self.lengths.max(initial=0)) + 1, weight.shape[1]), weight.dtype)
        alpha[:, 0] = 1
        for low, high in self._steps():
            w, s, e = self.word[low:high], self.start[low], self.end[low]
            alpha[w, e] += alpha[w, s] * weight[self.piece[low:high]]
        return alpha

    def backward(self, weight: np.ndarray) -> np.ndarray:
        beta = np.zeros((len(self.lengths), int(self.lengths.max(initial=0)) + 1, weight.shape[1]), weight.dtype)
        beta[np.arange(len(self.lengths)), self.lengths] = 1
        for low, high in reversed(self._steps()):
            w, s, e = self.word[low:high], self.start[low], self.end[low]
            beta[w, s] += beta[w, e] * weight[self.piece[low:high]]
        return beta

    def of_words(self, chosen: np.ndarray) -> Lattice:
        """The part of the lattice that belongs to the words flagged in ``chosen``."""
        edges = chosen[self.word]
        number = np.cumsum(chosen) - 1
        return Lattice(number[self.word[edges]], self.start[edges], self.end[edges], self.piece[edges], self.lengths[chosen])

    def totals(self, weight: np.ndarray) -> np.ndarray:
        return self.forward(weight)[np.arange(len(self.lengths)), self.lengths]

    def log_probability(self, weight: np.ndarray) -> np.ndarray:
        """Of every word and language.  Words whose probability a double cannot hold are summed again in
        numbers with a wider exponent."""
        total = self.totals(weight)
        out = np.log(np.maximum(total, _TINY))
        faint = (total < _TINY).any(axis=1)
        if faint.any():
            out[faint] = np.log(self.of_words(faint).totals(weight.astype(np.longdouble)))
        return out - self.lengths[:, None] * np.log(_SCALE)

    def uses(self, weight: np.ndarray, n: np.ndarray, pieces: int) -> np.ndarray:
        """Expected uses of every piece in ``n`` copies of each word, for one language's ``weight`` column."""
        alpha, beta = self.forward(weight)[..., 0], self.backward(weight)[..., 0]
        faint = beta[:, 0] < _TINY
        if faint.any() and weight.dtype != np.longdouble:
            return (self.of_words(~faint).uses(weight, n[~faint], pieces) if not faint.all() else 0) + self.of_words(faint).uses(weight.astype(np.longdouble), n[faint], pieces)
        use = alpha[self.word, self.start] * weight[self.piece, 0] * beta[self.word, self.end] * (n / beta[:, 0])[self.word]
        return np.bincount(self.piece, use.astype(float), pieces)


def scaled(probability: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Piece probabilities times the scale per byte."""
    return probability * (_SCALE ** sizes)[:, None]


def letter_runs(column: pa.Array) -> Iterator[tuple]:
    """Lower-case letter runs, slice by slice, longer ones cut between characters."""
    for piece in words(column, LETTER):
        long = np.flatnonzero(piece.end - piece.start > RUN_BYTES + 3)
        if len(long):
            start, end, row = [piece.start[np.setdiff1d(np.arange(len(piece.start)), long)]], [np.delete(piece.end, long)], [np.delete(piece.row, long)]
            for k in long:
                inner = np.arange(piece.start[k], piece.end[k])
                inner = inner[(piece.data[inner] & 0xC0) != 0x80]
                group = (inner - piece.start[k]) // RUN_BYTES
                cuts = inner[np.concatenate(([True], np.diff(group) > 0))]
                start.append(cuts)
                end.append(np.append(cuts[1:], piece.end[k]))
                row.append(np.full(len(cuts), piece.row[k]))
            piece.start, piece.end, piece.row = map(np.concatenate, (start, end, row))
            piece.hash = range_hash(prefix_hashes(piece.data), piece.start, piece.end)
        yield piece


def word_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``lang, word, n`` of all letter runs of the rows with a text and a language; each task adds up
    what it has before the shuffle."""
    picked = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("_text")).filter("lang IS NOT NULL AND _text IS NOT NULL")
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        def summed() -> pa.Table:
            return pa.concat_tables(waiting).group_by(["lang", "word"]).aggregate([("n", "sum")]).rename_columns(["lang", "word", "n"])
        for batch in batches:
            langs = batch.column(0)
            names, code = np.unique(langs.to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            for piece in letter_runs(batch.column(1)):
                lang = code[piece.row + piece.first_row]
                key = mix(piece.hash + lang.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
                _, at, n = np.unique(key, return_index=True, return_counts=True)
                raw = piece.data.tobytes()
                found = [raw[s:e] for s, e in zip(piece.start[at].tolist(), piece.end[at].tolist())]
                waiting.append(pa.table({"lang": pa.array(names).take(pa.array(lang[at])), "word": pa.array(found, pa.binary()), "n": pa.array(n, pa.int64())}))
            if sum(t.num_rows for t in waiting) > WAITING:
                waiting[:] = [summed()]
                if waiting[0].num_rows > WAITING // 2:
                    yield from waiting.pop().to_batches(max_chunksize=1 << 16)
        if waiting:
            yield from summed().to_batches(max_chunksize=1 << 16)
    return picked.mapInArrow(run, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """``probability[piece, language]`` over ``pieces``; the size is bounded by the vocabulary."""

    languages: list[str]
    pieces: list[bytes]
    probability: np.ndarray
    key: str


class _Scorer:
    """What a worker keeps for one model: the vocabulary and the scores of words it has met."""

    def __init__(self, model: Model) -> None:
        self.vocabulary = Vocabulary(model.pieces)
        self.weight = scaled(model.probability, np.array([len(p) for p in model.pieces]))
        self.known: dict[int, int] = {}
        self.table = np.zeros((0, len(model.languages)))

    def scores(self, hashes: np.ndarray, spell: Callable[[int], bytes]) -> np.ndarray:
        """Log probability of each distinct word and language; ``spell(k)`` gives the bytes of word ``k``."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.table = self.table[:0]
        place = np.fromiter((self.known.get(h, -1) for h in hashes.tolist()), np.int64, len(hashes))
        new = np.flatnonzero(place < 0)
        if len(new):
            fresh = [Lattice.of(self.vocabulary, [spell(k) for k in new[low:low + AT_ONCE].tolist()]).log_probability(self.weight) for low in range(0, len(new), AT_ONCE)]
            place[new] = len(self.table) + np.arange(len(new))
            self.known.update(zip(hashes[new].tolist(), place[new].tolist()))
            self.table = np.concatenate((self.table, *fresh))
        return self.table[place]


def fit(docs: DataFrame, model_path: str, text_col: str = "text", lang_col: str = "lang", rounds: int = 2, smoothing: float = 0.01) -> Model:
    """Piece probabilities per language from all rows with a text and a language.

    The words of each language are counted over the whole table; each round adds up the expected use of
    every piece over all segmentations.  Only one number per piece and language reaches the driver.
    """
    pieces = read_pieces(model_path)
    sizes, key = np.array([len(p) for p in pieces]), uuid.uuid4().hex
    counted = settle(word_counts(docs, text_col, lang_col))
    languages = [r["lang"] for r in counted.select("lang").distinct().orderBy("lang").collect()]
    probability = np.full((len(pieces), len(languages)), 1 / len(pieces))
    for _ in range(rounds if languages else 0):
        weight = scaled(probability, sizes)
        @trimmed
        def run(batches: Iterator[pa.RecordBatch], weight=weight) -> Iterator[pa.RecordBatch]:
            vocabulary, used = kept(("pieces", key), lambda: Vocabulary(pieces)), np.zeros(weight.T.shape)
            for batch in batches:
                lang = np.searchsorted(languages, batch.column(0).to_numpy(zero_copy_only=False).astype(str))
                for code in np.unique(lang):
                    mine = np.flatnonzero(lang == code)
                    for low in range(0, len(mine), AT_ONCE):
                        some = pa.array(mine[low:low + AT_ONCE])
                        lattice = Lattice.of(vocabulary, batch.column(1).take(some).to_pylist())
                        n = batch.column(2).take(some).to_numpy()
                        used[code] += lattice.uses(weight[:, code:code + 1], n, len(pieces))
            code, piece = np.nonzero(used)
            yield pa.RecordBatch.from_arrays([pa.array(code, pa.int32()), pa.array(piece, pa.int32()), pa.array(used[code, piece])], names=["lang", "piece", "used"])
        sums = counted.mapInArrow(run, "lang int, piece int, used double").groupBy("lang", "piece").agg(F.sum("used").alias("used")).toArrow()
        probability = np.full_like(probability, smoothing)
        probability[sums["piece"].to_numpy(), sums["lang"].to_numpy()] += sums["used"].to_numpy()
        probability /= probability.sum(axis=0)
    return Model(languages, pieces, probability, uuid.uuid4().hex)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score`` for every row of ``docs``, from the whole text alone.

    ``score`` is the posterior of the best language under equal priors; ties go to the first by name.
    A null text, one without a letter, and any text when nothing was learned are ``und`` with score 0.
    Repeated rows are each predicted, an empty table gives no rows, other columns are ignored.
    """
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, scorer = pa.array([*model.languages, "und"]), kept(("scores", model.key), lambda: _Scorer(model))
        for batch in batches:
            text = batch.column(1)
            total = np.zeros((batch.num_rows, len(model.languages)))
            for piece in letter_runs(text) if model.languages else ():
                distinct, at, back = np.unique(piece.hash, return_index=True, return_inverse=True)
                raw = piece.data.tobytes()
                spell = lambda k: raw[piece.start[at[k]]:piece.end[at[k]]]  # noqa: B023, E731
                scores = scorer.scores(distinct, spell)[back]
                for k in range(total.shape[1]):
                    total[piece.first_row:piece.first_row + piece.rows, k] += np.bincount(piece.row, scores[:, k], piece.rows)
            letters = pc.fill_null(pc.match_substring_regex(text, r"\pL"), False).to_numpy(zero_copy_only=False)
            if model.languages:
                best = total.argmax(axis=1)
                score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            else:
                best, score, letters = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            best = np.where(letters, best, len(model.languages))
            yield pa.RecordBatch.from_arrays([batch.column(0), names.take(pa.array(best)), pa.array(np.where(letters, score, 0.0))], names=["_id", "lang_pred", "score"])
    return picked.mapInArrow(run, f"_id {picked.schema['_id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("_id", id_col)
