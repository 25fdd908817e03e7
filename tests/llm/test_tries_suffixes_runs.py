"""Operators 11 to 13 against brute force, on odd and empty tables, and past their block sizes."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratalith.llm import language_id, periodic, prefix_trie, queries, suffix_dedup

CLASHES = ("id", "th", "gram", "lo", "number", "code", "place", "depth", "a", "b", "_n", "runs", "_id", "_seed", "ranges", "conv", "size", "arc")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def clashing(df):
    return df.withColumns({c: F.lit(7) for c in CLASHES})


def brute_trie(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns.setdefault(conv, []).append(((turn is not None, turn or 0), sha(f"{len(role)}:{role}{text}"), role, text))
    own = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    new = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        new[c] = (*own.get(c - int(math.fmod(c, 5)), [])[:h], *own[c][h:])
    nodes, kids = {}, {}
    for c, turns in new.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    def below(p):
        leaves, saved, todo = 0, 0, [p]
        while todo:
            q = todo.pop()
            saved += (len(nodes[q]) - 1) * len(q[-1][1].encode()) if q else 0
            leaves += q not in kids
            todo += kids.get(q, [])
        return leaves, saved
    out = []
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(new[c]) == len(p))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids.get(p, ())), *below(p), sha(ends)))
    return sorted(out, key=str)


TURNS = "conv_id bigint, turn bigint, role string, text string"


def trie_rows(seed, convs):
    rng = random.Random(seed)
    rows = [(c, None if rng.random() < 0.05 else t, rng.choice(["user", "assistant", None]), rng.choice(["x", "yy", "ß", None, ""]))
            for c in range(-12, convs) if rng.random() < 0.8 for t in range(rng.randint(1, 14))]
    return rows + rows[:5] + [(None, 1, "user", "x")]


@pytest.mark.parametrize("walk", [4096, 150])
def test_trie_equals_brute_force(spark, monkeypatch, walk):
    monkeypatch.setattr(prefix_trie, "WALK", walk)
    rows = trie_rows(5, 40)
    got = prefix_trie.prefix_trie(clashing(spark.createDataFrame(rows, TURNS)).drop("code"))
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rows)


def test_trie_of_copies_and_one_long_conversation(spark):
    rows = [(c, t, "user", "same") for c in range(300) for t in range(3)] + [(7, t, "user", str(t % 3)) for t in range(3, 700)]
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS))
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rows)


def test_trie_of_nothing(spark):
    empty = prefix_trie.prefix_trie(spark.createDataFrame([], TURNS))
    assert empty.count() == 0 and empty.columns == prefix_trie.prefix_trie(spark.createDataFrame([(1, 1, "a", "b")], TURNS)).columns


def test_trie_query_on_the_small_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.QUERIES["op11_conversation_prefix_trie"](spark, sf).collect()), key=str) == brute_trie(rows)


def test_list_ranks_of_a_shuffled_chain(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "WALK", 100)
    order = list(range(700))
    random.Random(1).shuffle(order)
    chain = spark.createDataFrame(list(zip(order, [*order[1:], None])), "arc bigint, after bigint")
    assert {r["arc"]: r["left"] for r in prefix_trie.list_ranks(chain).collect()} == {arc: 700 - k for k, arc in enumerate(order)}


def brute_dedup(rows):
    seen, out = set(), []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        mark = bytearray(len(data))
        for p in range(len(data) - 99):
            part = data[p:p + 100]
            if part in seen:
                mark[p:p + 100] = b"\1" * 100
            seen.add(part)
        spans = sum(mark[k] and not (k and mark[k - 1]) for k in range(len(mark)))
        out.append((key, len(data), sum(mark), spans, sha(bytes(x for x, m in zip(data, mark) if not m))))
    return sorted(out, key=str)


def dedup(df):
    got = suffix_dedup.without_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("remaining", 256)).collect()
    return sorted(map(tuple, got), key=str)


def passages(seed):
    rng = random.Random(seed)
    prose = lambda n: " ".join(rng.choice(["sch", "ung", "ein", "ö", "the", "ing"]) + rng.choice("abcdefgh") * rng.randint(0, 2) for _ in range(n))
    pool, rows = [prose(rng.randint(15, 60)) for _ in range(12)], []
    for k in range(100):
        parts = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            if kind < 0.5:
                whole = rng.choice(pool)
                at = rng.randrange(len(whole))
                parts.append(whole[at:at + rng.randint(50, 300)])
            else:
                parts.append(rng.choice(["x", "ab", "of "]) * rng.randint(50, 200) if kind < 0.6 else prose(rng.randint(1, 40)))
        rows.append((k * 3 - 50, rng.choice(["", " "]).join(parts)))
    rows += [(1000, None), (1001, ""), (1002, rows[5][1]), (None, rows[9][1]), (1003, "y" * 20_000), (1004, "é" * 300), (1005, "z" * 100), (1006, "z" * 99)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [suffix_dedup.HOT_ROWS, 5])
def test_repeats_equal_brute_force(spark, monkeypatch, hot):
    inner = suffix_dedup.repeated_ranges
    monkeypatch.setattr(suffix_dedup, "repeated_ranges", lambda docs: inner(docs, hot_rows=hot))
    rows = passages(4)
    assert dedup(clashing(spark.createDataFrame(rows, "doc_id bigint, text string"))) == brute_dedup(rows)


def test_repeated_rows_are_one_document(spark):
    text = "".join(chr(97 + k * k % 23) + str(k) for k in range(300))
    got = dedup(spark.createDataFrame([(2, text), (2, text), (3, text + "!")], "doc_id bigint, text string"))
    assert [r[2] for r in got] == [0, 0, len(text)] and dedup(spark.createDataFrame([], "doc_id bigint, text string")) == []


def test_repeats_of_the_small_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.QUERIES["op12_deep_shallow_dedup"](spark, sf).collect()), key=str) == brute_dedup(rows)


def test_deep_shallow_sorts(monkeypatch):
    rng = random.Random(4)
    bases = [bytes(rng.randrange(3) for _ in range(60)) for _ in range(5)]
    strings = [bytes(rng.choice([0, 1, 255]) for _ in range(rng.choice([0, 3, 31, 32, 33, 60]))) for _ in range(400)]
    strings += [rng.choice(bases)[:rng.randint(20, 60)] + bytes([rng.randrange(3)]) * rng.randint(0, 5) for _ in range(500)]
    group = np.array([rng.randrange(4) for _ in strings])
    order, common = suffix_dedup.deep_shallow(strings, group)
    assert [(group[k], strings[k]) for k in order] == sorted(zip(group, strings))
    for k, (low, high) in enumerate(zip(order[:-1], order[1:])):
        a, b = strings[low], strings[high]
        shared = next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert common[k + 1] == (shared if group[low] == group[high] else -1)


def brute_runs(words):
    n, best = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                best.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def described(key, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (key, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join("{},{},{}\n".format(*r) for r in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def looping(rng):
    words = []
    for _ in range(rng.randint(0, 6)):
        k = rng.choice([1, 2, 3, 5, 8, 15, 16, 17, 20, 31, 32, 33, 40, 64, 100])
        base = [rng.randrange(rng.choice([1, 2, 2, 3, 50])) for _ in range(k)]
        if rng.random() < 0.4:
            base = [0] * (k - 1) + [1]
        if rng.random() < 0.3 and k > 20:
            base = ([0, 1] * k)[:k - 3] + [2, 3, 0]
        words += [base[i % k] for i in range(int(k * rng.choice([0.5, 2.9, 3, 3.05, 3.5, 5, 9])))] + [rng.randrange(rng.choice([2, 100])) for _ in range(rng.randint(0, 30))]
    return " ".join(f"w{w}" for w in words)


def test_runs_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [(k, looping(rng)) for k in range(400)] + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "of of " * 4000), (None, "a b " * 30), (3, "é 日本 " * 40), (3, "é 日本 " * 40)]
    got = periodic.described(periodic.periodic_runs(clashing(spark.createDataFrame(rows, "doc_id bigint, text string")), seed=queries.planted_seed()))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((described(*r) for r in rows), key=str)


def test_runs_of_the_small_table(spark, sf):
    rows = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, sf).collect()}
    assert got.keys() == rows.keys()
    for key, text in rows.items():
        if len(text or "") < 20_000:
            assert got[key] == described(key, text)


def test_runs_of_nothing(spark):
    found = periodic.periodic_runs(spark.createDataFrame([], "doc_id bigint, text string"))
    assert found.count() == 0 and periodic.described(found).count() == 0


def test_selected_positions_do_not_depend_on_the_place():
    rng = np.random.default_rng(2)
    words = rng.integers(1, 5, 400).astype(np.uint64)
    twice = np.concatenate((words[:200], [np.uint64(9)], words[:200]))
    none = np.zeros(0, np.int64)
    at = periodic.selected(periodic._Equal(twice), 8, none, none)
    inside = lambda low: {int(k) - low for k in at if low <= k <= low + 200 - 16}
    assert inside(0) == inside(201) and len(inside(0)) > 10


def test_words_beyond_a_double_have_finite_scores():
    pieces = sorted([bytes([b]) for b in range(256)])
    vocabulary = language_id.Vocabulary(pieces)
    probability = np.full((256, 2), 1e-17)
    probability[97] = [0.5, 0.25]
    weight = language_id.scaled(probability, np.ones(256))
    lattice = language_id.Lattice.of(vocabulary, ["ሀ".encode() * 12, b"aaa"])
    got = lattice.log_probability(weight)
    assert np.isfinite(got).all() and got[0] == pytest.approx([36 * math.log(1e-17)] * 2) and got[1] == pytest.approx([3 * math.log(0.5), 3 * math.log(0.25)])
    used = lattice.uses(weight[:, :1], np.array([2, 5]), 256)
    assert np.isfinite(used).all() and used[97] == pytest.approx(15) and used.sum() == pytest.approx(2 * 36 + 15)


def test_stages_take_clashing_columns_and_odd_rows(spark, sf):
    rows = [(1, None), (2, ""), (None, None), (None, "the other thing and the rest of it all in one place " * 3), (4, "the thing there and another one in the end of the line " * 4), (4, "the thing there and another one in the end of the line " * 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"lang": F.lit("en"), "source": F.lit("a"), "n_chars": F.length("text").cast("bigint")})
    docs = docs.withColumns({c: F.lit(7) for c in ("_gone", "_bad", "_whole", "_text", "_id", "component_id", "score", "n")})
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), sf).count() == 0, name
        kept[name] = sorted((r["doc_id"] or 0 for r in out.select("doc_id").collect()))
    assert kept["benchmark_decontamination"] == kept["pii"] == [0, 0, 1, 2, 4, 4] and kept["simhash_near_dedup"].count(4) == 1 and kept["simhash_near_dedup"].count(0) == 2
    assert 1 not in kept["language_id"] and 4 in kept["language_id"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == len(rows)
