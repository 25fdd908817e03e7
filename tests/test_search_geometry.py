"""Search in every language and its bounded top-k; faces in one plane, cut curves and ring nesting."""

import functools
import itertools
import random
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.functions import text as t
from stratalith.functions.triangles import clipped, pair_intersections, polygon_area
from stratalith.operators import evaluation as ev
from stratalith.operators import graph, skew
from stratalith.operators import mesh as ms
from stratalith.operators import planar as pl
from stratalith.operators import retrieval as rt
from stratalith.operators import surface as sf_
from stratalith.operators.substrings import substring_search, term_hits
from stratalith.plans.inputs import BOX_TRIANGLES
from stratalith.session import settle


# -- search -------------------------------------------------------------------------------------
TEXTS = [(1, "Die Größe der Fläche, größer als Größen", "a"), (2, "三角形の交差判定。三角形と四面体", "b"), (3, "banana Banana ANANAS", None), (4, None, "größe"), (5, "", "")]


def test_terms_are_found_in_any_language(spark):
    docs = spark.createDataFrame(TEXTS, "id int, text string, tag string")
    terms = spark.createDataFrame([("größe",), ("三角形",), ("ana",), ("角形の",), ("",), ("zzz",)], "term string")
    want = {("text", 1, "größe"): 3, ("tag", 4, "größe"): 1, ("text", 2, "三角形"): 2, ("text", 2, "角形の"): 1, ("text", 3, "ana"): 6}
    for block in (1 << 20, 12):
        got = term_hits(docs, terms, "id", ["text", "tag"], block_bytes=block).collect()
        assert {(r["field"], r["id"], r["term"]): r["hits"] for r in got} == want and len(got) == len(want)
    assert term_hits(docs, terms.limit(0), "id", ["text"]).count() == 0 and term_hits(docs.limit(0), terms, "id", ["text"]).count() == 0


def test_search_terms_of_german_and_japanese(spark):
    rows = spark.createDataFrame([("Compute the Größe of 三角形分割 für 2D hulls",)], "s string").select(t.search_terms(t.normalize_text(F.col("s"))).alias("t")).first()["t"]
    assert {"größe", "für", "三角形", "角形分", "形分割", "hull"} <= set(rows) and "the" not in rows and "三角形分割" not in rows


def test_search_in_german_and_japanese(spark):
    docs = spark.createDataFrame(TEXTS, "id int, text string, tag string")
    asked = spark.createDataFrame([(1, ["größe"]), (2, ["三角形", "角形の"]), (3, ["nichts"])], "q int, terms array<string>")
    got = rt.bm25_search(docs, asked, "id", "q", "terms", {"text": 1.0, "tag": 5.0}, 5).collect()
    assert {(r["q"], r["id"]) for r in got} == {(1, 1), (1, 4), (2, 2)} and all(r["rank"] <= 2 for r in got)


def test_bounded_search_scores_few_documents(spark):
    rng = random.Random(2)
    common, rare = ["the", "and", "with"], [f"word{k}" for k in range(300)]
    rows = [(k, " ".join(rng.choices(common, k=20) + rng.choices(rare, k=5))) for k in range(1500)]
    docs = spark.createDataFrame(rows, "id int, text string")
    asked = spark.createDataFrame([(q, [*common, *rng.sample(rare, 4)]) for q in range(20)], "q int, terms array<string>")
    every = rt.bm25_search(docs, asked, "id", "q", "terms", {"text": 1.0}, None).filter("rank <= 10")
    key = lambda r: (r["q"], r["id"], r["rank"], round(r["score"], 6), sorted(r["matched"]))
    best = rt.bm25_search(docs, asked, "id", "q", "terms", {"text": 1.0}, 10)
    assert sorted(map(key, best.collect())) == sorted(map(key, every.collect()))
    wanted = asked.select("q", F.explode("terms").alias("term"))
    gains = rt.term_gains(docs, wanted, "id", {"text": 1.0}).cache()
    scored = rt.bounded_candidates(gains, wanted, "q", "id", 10).groupBy("q").count().agg(F.max("count")).first()[0]
    assert scored < 300  # all 1,500 documents hold a term of every query


def test_ties_at_the_cut_go_by_id(spark):
    docs = spark.createDataFrame([(k, "same words here") for k in range(50)], "id int, text string")
    asked = spark.createDataFrame([(1, ["same", "words"])], "q int, terms array<string>")
    got = rt.bm25_search(docs, asked, "id", "q", "terms", {"text": 1.0}, 3).collect()
    assert [(r["id"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1), (1, 2), (2, 3)]


def test_snippets_mark_words_that_hold_a_term(spark):
    rows = [(1, "a b c Größenordnung d e größe f", ["größe"]), (2, "一。三角形、四角形。五", ["三角形"]), (3, "x y z", ["q"]), (4, "", ["q"]), (5, None, ["q"])]
    got = {r["id"]: r["snippet"] for r in rt.snippet(spark.createDataFrame(rows, "id int, text string, terms array<string>"), "text", "terms", 4).collect()}
    assert got == {1: "[Größenordnung] d e [größe]", 2: "[三角形] 四角形 五", 3: "x y z", 4: "", 5: None} or got[5] in (None, "")


def test_substring_scorer(spark):
    entries = spark.createDataFrame([(1, "convex_hull_3", "Hull"), (2, "Triangulation", "mesh"), (3, None, None)], "id int, title string, summary string")
    asked = spark.createDataFrame([(7, "hull hull mesh"), (8, "  "), (9, "CONVEX gul")], "q int, text string")
    got = sorted((r["q"], r["id"], r["score"], r["rank"]) for r in substring_search(entries, asked, "q", "id", 2).collect())
    assert got == [(7, 1, 2, 1), (7, 2, 1, 2), (9, 1, 1, 1), (9, 2, 1, 2)]


# -- chains ------------------------------------------------------------------------------------
def test_chains_are_ordered(spark):
    rng = random.Random(3)
    ids = rng.sample(range(10_000), 700)
    parts, links, want = [ids[:400], ids[400:401], ids[401:403], ids[403:600], ids[600:]], [], set()
    for k, part in enumerate(parts):
        closed = k >= 3
        links += list(zip(part, [*part[1:], part[0] if closed else None]))
        start = part.index(min(part)) if closed else 0
        want |= {(min(part), node, n, closed) for n, node in enumerate(part[start:] + part[:start])}
    rng.shuffle(links)
    got = graph.chain_order(spark.createDataFrame(links, "node bigint, next bigint")).collect()
    assert {(r["chain"], r["node"], r["position"], r["closed"]) for r in got} == want and len(got) == len(want)


def test_chains_of_nothing(spark):
    assert graph.chain_order(spark.createDataFrame([], "node bigint, next bigint")).count() == 0


def mesh_box(spark, mesh_id=0, low=(0, 0, 0), size=(1, 1, 1)):
    corners = [(mesh_id, mesh_id * 8 + k, float(low[0] + size[0] * (k & 1)), float(low[1] + size[1] * (k >> 1 & 1)), float(low[2] + size[2] * (k >> 2))) for k in range(8)]
    faces = [(mesh_id, mesh_id * 12 + n, *(mesh_id * 8 + c for c in f)) for n, f in enumerate(BOX_TRIANGLES)]
    return spark.createDataFrame(corners, "mesh_id bigint, vid bigint, x double, y double, z double"), spark.createDataFrame(faces, "mesh_id bigint, fid bigint, a bigint, b bigint, c bigint")


def test_slices_are_closed_and_open_polylines(spark):
    v, f = mesh_box(spark)
    got = ms.slice_polylines(v, f, [0.25, 5.0]).toPandas()
    assert len(got) == 9 and got.closed.all() and set(got.z) == {0.25} and got.plane.unique().tolist() == [0]
    first, last = got.sort_values("position").iloc[[0, -1]].to_dict("records")
    assert (first["lo"], first["hi"]) == (last["lo"], last["hi"]) and sorted(got.position) == list(range(9))
    open_ = ms.slice_polylines(v, f.filter("fid >= 4 AND fid < 10"), [0.25]).toPandas().sort_values("position")
    assert len(open_) == 7 and not open_.closed.any()
    slanted = ms.slice_polylines(v, f, [1.5], normal=(1.0, 1.0, 1.0)).toPandas()
    assert slanted.closed.all() and np.allclose(slanted.x + slanted.y + slanted.z, 1.5)
    with pytest.raises(ValueError):
        ms.slice_mesh(v, f, [1.0], normal=(0.0, 0.0, 0.0))


# -- faces -------------------------------------------------------------------------------------
def exact_meet(one, two):
    """Do two closed triangles share a point?  Every pair of edge and face, and planar containment, in rationals."""
    sub = lambda a, b: tuple(x - y for x, y in zip(a, b))
    cross = lambda a, b: (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    def holds(tri, p):
        n = cross(sub(tri[1], tri[0]), sub(tri[2], tri[0]))
        s = [dot(n, cross(sub(tri[(k + 1) % 3], tri[k]), sub(p, tri[k]))) for k in range(3)]
        return dot(n, sub(p, tri[0])) == 0 and (min(s) >= 0 or max(s) <= 0)
    def edge(s, t, tri):
        n = cross(sub(tri[1], tri[0]), sub(tri[2], tri[0]))
        a, b = dot(n, sub(s, tri[0])), dot(n, sub(t, tri[0]))
        if a == b:
            return False
        share = Fraction(a, a - b)
        return 0 <= share <= 1 and holds(tri, tuple(x + (y - x) * share for x, y in zip(s, t)))
    def edges_cross(s, t, u, w):
        d, e, n = sub(t, s), sub(w, u), cross(sub(t, s), sub(w, u))
        if n == (0, 0, 0):
            return False
        r = sub(u, s)
        if dot(n, r):
            return False
        a, b = Fraction(dot(cross(r, e), n), dot(n, n)), Fraction(dot(cross(r, d), n), dot(n, n))
        return 0 <= a <= 1 and 0 <= b <= 1
    ring = ((0, 1), (1, 2), (2, 0))
    return (any(edge(one[i], one[j], two) or edge(two[i], two[j], one) for i, j in ring) or any(holds(two, p) for p in one) or any(holds(one, p) for p in two)
            or any(edges_cross(one[i], one[j], two[k], two[m]) for i, j in ring for k, m in ring))


def frame(pairs, **more):
    rows = [(k, k, *itertools.chain(*one), *itertools.chain(*two)) for k, (one, two) in enumerate(pairs)]
    return pd.DataFrame(rows, columns=["fid", "ofid", *[f"{s}{k}{c}" for s in ("", "o") for k in "abc" for c in "xyz"]]).assign(**more)


def test_triangle_pairs_equal_brute_force():
    rng = random.Random(8)
    pairs = []
    while len(pairs) < 4000:
        high = rng.choice([0, 1, 2])
        point = lambda: (rng.randint(0, 3), rng.randint(0, 3), rng.randint(0, high))  # noqa: B023, E731
        one, two = [point() for _ in range(3)], [point() for _ in range(3)]
        solid = lambda m: np.any(np.cross(np.subtract(m[1], m[0]), np.subtract(m[2], m[0])))
        if solid(one) and solid(two):
            pairs.append((one, two))
    found = next(pair_intersections(iter([frame(pairs)])))
    want = {k for k, (one, two) in enumerate(pairs) if exact_meet(one, two)}
    assert set(found.fid) == want and 500 < len(want) < 3900
    inside = found[found.kind != "polygon"]
    for r in inside.itertuples():
        for end in ((r.px, r.py, r.pz), (r.qx, r.qy, r.qz)):
            for tri in pairs[r.fid]:
                n = np.cross(np.subtract(tri[1], tri[0]), np.subtract(tri[2], tri[0]))
                assert abs(n @ np.subtract(end, tri[0])) < 1e-9
    flat = found[found.kind == "polygon"]
    assert len(flat) > 100 and (flat.area > 0).all() and flat.corners.between(3, 6).all()


def test_nearly_flat_pairs_are_told_apart():
    up, tiny = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0)], 2.0 ** -60
    lifted = lambda h: [(0.25, 0.25, h), (0.5, 0.25, h), (0.25, 0.5, h)]
    tilted = [(0.25, 0.25, -tiny), (0.5, 0.25, tiny), (0.25, 0.5, tiny)]
    found = next(pair_intersections(iter([frame([(up, lifted(0.0)), (up, lifted(tiny)), (up, tilted)])])))
    assert sorted(zip(found.fid, found.kind)) == [(0, "polygon"), (2, "segment")]


def test_common_part_of_two_triangles():
    square_half = [[0.0, 0, 0], [2, 0, 0], [0, 2, 0]]
    assert polygon_area(clipped(square_half, [[0.0, 0, 0], [2, 2, 0], [0, 2, 0]])) == pytest.approx(1.0)
    assert len(clipped(square_half, [[2.0, 0, 0], [3, 0, 0], [3, 1, 0]])) == 1
    assert len(clipped(square_half, [[0.0, 0, 0], [1, 0, 0], [0, -1, 0]])) == 2


def union(*meshes):
    return tuple(functools.reduce(DataFrame.unionByName, parts) for parts in zip(*meshes))


def test_boxes_that_share_a_face_meet(spark):
    one, two = mesh_box(spark, 0), mesh_box(spark, 1, low=(1, 0.25, 0.25), size=(1, 0.5, 0.5))
    hits = sf_.mesh_intersections(one, two)
    assert hits.filter("kind = 'polygon'").agg(F.round(F.sum("area"), 9)).first()[0] == 0.25
    assert sf_.self_intersections(*union(one, two)).filter("kind = 'polygon'").count() == hits.filter("kind = 'polygon'").count()
    assert sf_.self_intersections(*one).count() == 0


def test_faces_with_common_corners(spark):
    v = spark.createDataFrame([(0, k, *map(float, p)) for k, p in enumerate([(0, 0, 0), (4, 0, 0), (0, 4, 0), (4, 4, 0), (1, 1, 0), (1, 1, 2), (1, 1, -2)])], "mesh_id bigint, vid bigint, x double, y double, z double")
    cases = {"folded back": [(0, 1, 2), (0, 1, 4)], "plain neighbours": [(0, 1, 2), (1, 3, 2)], "twice": [(0, 1, 2), (2, 0, 1)], "through": [(0, 1, 2), (0, 5, 6)], "corner only": [(0, 1, 2), (3, 1, 5)]}
    got = {}
    for name, faces in cases.items():
        f = spark.createDataFrame([(0, k, *c) for k, c in enumerate(faces)], "mesh_id bigint, fid bigint, a bigint, b bigint, c bigint")
        got[name] = [r["kind"] for r in sf_.self_intersections(v, f).collect()]
    assert got == {"folded back": ["polygon"], "plain neighbours": [], "twice": ["polygon"], "through": ["segment"], "corner only": []}


def test_relations_of_boxes(spark):
    small = union(mesh_box(spark, 1, (1, 1, 1)), mesh_box(spark, 2, (9, 9, 9)), mesh_box(spark, 3, (4, 1, 1), (3, 1, 1)), mesh_box(spark, 4, (-9, -9, -9), (40, 40, 40)))
    large = mesh_box(spark, 7, (0, 0, 0), (5, 5, 5))
    got = {(r["mesh_id"], r["relation"]) for r in sf_.mesh_relations(small, large).collect()}
    assert got == {(1, "inside"), (3, "meets"), (4, "contains")}
    assert {r["mesh_id"] for r in sf_.mesh_relations(small, large, bounded_sides=False).collect()} == {3}
    opened = (large[0], large[1].filter("fid <> 84"))
    assert {(r["mesh_id"], r["relation"]) for r in sf_.mesh_relations(small, opened).collect()} == {(3, "meets"), (4, "contains")}


def test_curves_of_two_boxes(spark):
    lines, flat = sf_.intersection_polylines(mesh_box(spark), mesh_box(spark, 1, (0.5, 0.5, 0.5)))
    got = lines.toPandas()
    assert got.closed.all() and flat.count() == 0 and got.groupby(["start", "second"]).ngroups == 1
    assert set(zip(got.x, got.y, got.z)) >= {(1.0, 0.5, 0.5), (0.5, 1.0, 0.5), (0.5, 0.5, 1.0), (1.0, 1.0, 0.5), (1.0, 0.5, 1.0), (0.5, 1.0, 1.0)}


# -- rings -------------------------------------------------------------------------------------
def test_ring_conflicts_are_named(spark):
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    outer = square(0, 0, 10)
    polys = {1: [outer, square(1, 1, 2)[::-1]], 2: [outer, square(20, 1, 2)], 3: [outer, square(9, 1, 2)], 4: [outer, square(10, 1, 2)], 5: [outer, square(1, 1, 5), square(2, 2, 1)],
             6: [[(0, 0), (10, 10), (10, 0), (0, 10)], square(4, 1, 1)], 7: [outer, square(1, 1, 2), square(1, 1, 2)], 8: [outer], 9: [outer, square(1, 1, 2), square(-5, -5, 30)]}
    rows = [(p, r, s, float(x), float(y)) for p, rings in polys.items() for r, ring in enumerate(rings) for s, (x, y) in enumerate(ring)]
    report = {r["poly_id"]: r for r in pl.polygon_report(spark.createDataFrame(rows, "poly_id int, ring int, seq int, x double, y double")).collect()}
    assert {k: r["reasons"] for k, r in report.items()} == {1: [], 2: ["outside:1"], 3: ["contact:0:1"], 4: ["contact:0:1"], 5: ["nested:2:1"], 6: ["not_simple:0"], 7: ["contact:1:2"], 8: [], 9: ["outside:2", "nested:1:2"]}
    assert report[1]["canonical"] and report[1]["area"] == 96 and report[1]["centroid_x"] == pytest.approx((500 - 4 * 2) / 96) and report[2]["area"] is None
    assert [report[9][c] for c in ("min_x", "max_y", "holes")] == [-5, 25, 2]


# -- hot words ---------------------------------------------------------------------------------
def test_hot_words_and_shingles_are_cut_into_pieces(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(40)]
    rows = [(k, "en", " ".join(["all the same"] * (k % 3 == 0) + rng.choices(words, k=8))) for k in range(60)]
    rows += [(100 + k, "en", rows[k][2] + (" more" if k % 2 else "")) for k in range(20)]
    docs = spark.createDataFrame(rows, "id int, lang string, text string")
    shingles = {k: {tuple(w[i:i + 3]) for i in range(len(w) - 2)} for k, _, text in rows for w in [text.split()]}
    want = {(a, b): len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b]) for a, b in itertools.combinations(sorted(shingles), 2)}
    first = {a: min(b for b in shingles if shingles[b] == shingles[a]) for a in shingles}
    want = {(a, b): s for (a, b), s in want.items() if s > 0.6 and (first[a] == a and first[b] == b or first[b] == a)}
    plain = {(r["a"], r["b"]): r["similarity"] for r in ev.near_duplicates(docs, "id", "text", "lang", 0.6).collect()}
    asked = spark.createDataFrame([(q, w) for q in range(5) for w in ["same", *rng.sample(words, 3)]], "q int, token string")
    tokens = settle(rt.token_rows(docs, "id", "text"))
    cover = lambda: sorted((r["q"], r["id"], round(r["explained"], 9), round(r["total"], 9)) for r in rt.query_coverage(asked, tokens, "q", "id", len(rows)).collect())
    before = cover()
    small_pieces = functools.partial(skew.salted_join, rows=7)
    monkeypatch.setattr(ev, "salted_join", small_pieces)
    monkeypatch.setattr(rt, "salted_join", small_pieces)
    monkeypatch.setattr(rt, "BROADCAST_BYTES", 0)
    hot = {(r["a"], r["b"]): r["similarity"] for r in ev.near_duplicates(docs, "id", "text", "lang", 0.6).collect()}
    assert hot == plain == pytest.approx(want) and len(want) >= 20
    assert cover() == before and len(before) > 60


# -- evidence ----------------------------------------------------------------------------------
def test_evidence_of_dimensions_methods_and_bridges(spark):
    base = {"query_concepts": ["hull"], "item_concepts": ["hull"], "query_words": ["hull"], "item_words": ["hull"], "matched_aliases": [], "bridge_words": [], "exact": False, "phrase_bonus": 0.0}
    cases = {"plain": {}, "flat": {"query_words": ["hull", "2d"]}, "both flat": {"query_words": ["hull", "2d"], "item_words": ["hull", "2d"]}, "solid": {"query_words": ["hull", "3d"], "item_words": ["hull", "2d"]},
             "either": {"query_words": ["hull", "3d"], "item_words": ["hull", "2d", "3d"]}, "method": {"query_concepts": ["hull", "poisson"]}, "bridge": {"bridge_words": ["hull", "x"]}}
    schema = "name string, query_concepts array<string>, item_concepts array<string>, query_words array<string>, item_words array<string>, matched_aliases array<string>, bridge_words array<string>, exact boolean, phrase_bonus double"
    rows = spark.createDataFrame([(name, *({**base, **more}[c] for c in base)) for name, more in cases.items()], schema)
    got = {r["name"]: (r["uncovered"], r["uncovered_methods"], r["evidence"], r["supported"]) for r in rt.match_evidence(rows, ["poisson"]).collect()}
    assert got == {"plain": ([], [], 17.0, True), "flat": (["dimension_2d"], [], 17.0, False), "both flat": ([], [], 20.0, True), "solid": (["dimension_3d"], [], 17.0, False),
                   "either": ([], [], 20.0, True), "method": (["poisson"], ["poisson"], 17.0, False), "bridge": ([], [], 18.0, True)}
