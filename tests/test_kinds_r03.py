"""What the reviewer projected to larger tables, fourth part: equal rows are worked on once, and nothing is written that is not needed."""

import random
import re

from stratalith.operators import evaluation as ev
from stratalith.operators import provenance as pv
from stratalith.operators import retrieval as rt


def test_items_that_agree_are_scored_once(spark, monkeypatch):
    """Forty copies of six items: the texts meet once per kind, and every copy gets what it gets as a kind of its own."""
    met = []
    real = rt.match_evidence
    monkeypatch.setattr(rt, "match_evidence", lambda pairs, methods=(): met.append(pairs) or real(pairs, methods))
    rng = random.Random(5)
    kinds = [(f"{rng.choice(('large', 'small'))} {rng.choice(('ring', 'bolt', 'plate'))} {w} mesh hull", w) for w in ("alpha", "beta", "gamma", "delta", "omega", "sigma")]
    shape = "id long, text string, concepts array<string>, aliases array<string>, phrases array<string>"
    rows = [(n, *kinds[n % 6]) for n in range(240)]
    copies = spark.createDataFrame([(n, t, [w], ["ring"], [t]) for n, t, w in rows], shape)
    single = spark.createDataFrame([(n, t, [w], ["ring", f"zz{n}zz"], [t]) for n, t, w in rows], shape)
    asked = spark.createDataFrame([(1, "large ring alpha", ["alpha"]), (2, "bolt beta unheard", []), (3, "gamma hull in 2d", ["gamma"])], "q long, text string, concepts array<string>")
    told = lambda items: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rt.search_channels(asked, items, "q", "id").collect())
    got = told(copies)
    assert met[0].count() <= 6 * 3
    assert len(got) >= 240 and got == told(single)


def test_only_prefixes_of_shingle_sets_are_shuffled(spark, monkeypatch):
    """Equal to brute force with null, empty and short texts; no join sees a row for every shingle."""
    seen = []
    real = ev.salted_join
    monkeypatch.setattr(ev, "salted_join", lambda left, right, *a: seen.append(right) or real(left, right, *a))
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(30, 60))) for _ in range(12)]
    for text in list(texts):
        w = text.split()
        w[rng.randrange(len(w))] = "changed"
        texts += [" ".join(w).upper(), " ".join(w[:-2])]
    texts += ["", " . ", None, None, "a b", "A, b", "a c"]
    rows = [(n, text, "xy"[n % 2] if n < 40 else "x") for n, text in enumerate(texts)]
    got = {(r["a"], r["b"]): round(r["similarity"], 9) for r in ev.near_duplicates(spark.createDataFrame(rows, "id long, text string, lang string"), "id", "text", "lang", 0.6).collect()}

    def grams(text):
        if text is None:
            return frozenset([None])
        w = re.findall("[a-z0-9]+", text.lower())
        return frozenset(" ".join(w[p:p + 3]) for p in range(max(len(w) - 2, 1)))

    sets, first, want = {n: grams(text) for n, text, _ in rows}, {}, {}
    for n, _, lang in rows:
        least = first.setdefault((lang, sets[n]), n)
        if least != n:
            want[least, n] = 1.0
    for (la, a), n in first.items():
        for (lb, b), m in first.items():
            if la == lb and n < m and len(a & b) > 0.6 * len(a | b):
                want[n, m] = round(len(a & b) / len(a | b), 9)
    assert got == want and len(want) > 10
    assert max(df.count() for df in seen) < 0.6 * sum(map(len, sets.values()))


def test_steps_without_dependencies_stay_out_of_the_rounds(spark, monkeypatch):
    """A chain, a cycle, a fork and a dangling edge among three hundred lone steps: only steps with edges are written."""
    written = []
    real = pv.settle
    monkeypatch.setattr(pv, "settle", lambda df: written.append(real(df)) or written[-1])
    steps = [(1, n) for n in range(300)] + [(1, 5), (2, 1)]
    edges = [(1, 2, 1), (1, 3, 2), (1, 3, 2), (1, 4, 3), (1, 10, 11), (1, 11, 10), (1, 12, 10), (1, 20, 4), (1, 20, 1), (1, 30, 999), (1, 31, 30), (7, 1, 1)]
    got = {(r[0], r[1]): (r["level"], r["problem"]) for r in pv.dag_levels(
        spark.createDataFrame(steps, "plan_id long, step_id long"), spark.createDataFrame(edges, "plan_id long, step_id long, depends_on long")).collect()}
    want = {s: (0, None) for s in steps}
    want.update({(1, 2): (1, None), (1, 3): (2, None), (1, 4): (3, None), (1, 20): (4, None), (1, 31): (1, None), (1, 30): (0, "dangling"), (1, 5): (0, "duplicate_id"),
                 (1, 10): (None, "cycle"), (1, 11): (None, "cycle"), (1, 12): (None, "cycle")})
    assert got == want
    assert max(df.count() for df in written) <= len(edges)


def test_documents_are_scored_where_they_lie(spark, monkeypatch):
    """With few terms no table of candidate pairs is made; the best are those of the whole ranking, and of the bounded way."""
    rng = random.Random(7)
    docs = spark.createDataFrame([(n, " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "alphabet"], k=rng.randrange(1, 9)))) for n in range(80)], "id long, text string")
    asked = spark.createDataFrame([(1, ["alpha", "beta"]), (2, ["gamma", "eta"]), (3, ["nowhere"])], "q long, terms array<string>")
    told = lambda df: sorted((r["q"], r["rank"], r["id"], round(r["score"], 6), tuple(sorted(r["matched"]))) for r in df.collect())
    search = lambda k: rt.bm25_search(docs, asked, "id", "q", "terms", {"text": 1.0}, k)
    whole = told(search(None).filter("rank <= 5"))
    with monkeypatch.context() as m:
        m.setattr(rt, "BROADCAST_BYTES", 0)
        assert told(search(5)) == whole
    monkeypatch.delattr(rt, "bounded_candidates")
    assert told(search(5)) == whole and len(whole) == 10
