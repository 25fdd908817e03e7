"""The near-duplicate stage on a crowded group: work in proportion to the rows, components of the exact sets."""

import itertools
import random

import numpy as np

from stratalith.llm import simhash


def varied(rng, words, changes):
    out = list(words)
    for at in rng.sample(range(len(words)), changes):
        out[at] = f"x{rng.randrange(10**9)}"
    return " ".join(out)


def test_near_copies_make_no_table_of_pairs(spark, monkeypatch):
    """A group of different texts, most of them about four fifths alike: the rows that are written stay in
    proportion to the table, and the components are those of the exact sets."""
    rng = random.Random(21)
    core = [f"c{rng.randrange(900)}" for _ in range(150)]
    rows = list(enumerate(varied(rng, core, rng.choice((1, 3, 4, 5))) for _ in range(300)))
    sizes = []
    written = simhash.settle
    def counted(df, *hint):
        out = written(df, *hint)
        sizes.append(out.count())
        return out
    monkeypatch.setattr(simhash, "settle", counted)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert max(sizes) <= 2 * simhash.BANDS * len(rows)
    sets = {k: set(map(tuple, zip(*(t.split()[i:] for i in range(5))))) for k, t in rows}
    root = {k: k for k in sets}
    for a, b in itertools.combinations(sets, 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {k: low if r == high else r for k, r in root.items()}
    assert got == root


def test_set_links_connect_what_the_sets_connect():
    rng = np.random.default_rng(5)
    for _ in range(40):
        sets = [np.unique(rng.integers(0, 14, rng.integers(4, 16))) for _ in range(30)]
        components = rng.integers(0, 25, 30).tolist()
        def joined(links):
            root = list(components)
            for a, b in links:
                root = [root[b] if r == root[a] else r for r in root]
            return {(a, b) for a in range(30) for b in range(30) if root[a] == root[b]}
        share = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        links = simhash.set_links(list(range(30)), components, sets, 0.8)
        assert len(links) < 30 and all(share(sets[a], sets[b]) >= 0.8 for a, b in links)
        assert joined(links) == joined([(a, b) for a in range(30) for b in range(a) if share(sets[a], sets[b]) >= 0.8])
