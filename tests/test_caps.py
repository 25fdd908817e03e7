"""No operator stops early, cuts rows off or changes with the size of its input."""

import hashlib
import itertools

import pandas as pd
from pyspark.sql import functions as F

from stratalith.operators import graph, points as pt, provenance as pv, retrieval as rt, skew
from stratalith.operators.boxes import box_join, with_box
from stratalith.operators.kernel import evaluate_intersections
from stratalith.sources import meshes, points as sp


def test_phrases_of_any_length(spark):
    docs = spark.createDataFrame([(1, "we know alpha beta gamma delta epsilon zeta well"), (2, "日本語形状解析です"), (3, "alpha beta " * 5000)], "doc_id bigint, text string")
    vocabulary = spark.createDataFrame([("long", "beta gamma delta epsilon zeta"), ("short", "gamma delta"), ("cjk", "語形状解析"), ("two", "alpha beta")], "concept string, phrase string")
    got = {(r.doc_id, r.concept) for r in rt.tag_concepts(docs, vocabulary, "doc_id", "text").collect()}
    assert got == {(1, "long"), (1, "two"), (2, "cjk"), (3, "two")}
    named = rt.recognize_named(docs.withColumnRenamed("doc_id", "q"), vocabulary.select(F.col("concept").alias("name_id"), F.col("phrase").alias("term")), "q", "text")
    assert {(r.q, r.name_id) for r in named.collect()} >= {(1, "long"), (2, "cjk")}


def test_deep_chains_are_levels_not_cycles(spark):
    n = 12
    steps = spark.createDataFrame([("p", f"s{k:02d}") for k in range(n)] + [("p", "x"), ("p", "y")], "plan_id string, step_id string")
    edges = spark.createDataFrame([("p", f"s{k:02d}", f"s{k - 1:02d}") for k in range(1, n)] + [("p", "x", "y"), ("p", "y", "x")], "plan_id string, step_id string, depends_on string")
    got = {r.step_id: (r.level, r.problem) for r in pv.dag_levels(steps, edges).collect()}
    assert got == {**{f"s{k:02d}": (k, None) for k in range(n)}, "x": (None, "cycle"), "y": (None, "cycle")}


def test_every_cluster_is_closed(spark):
    p = spark.createDataFrame([(k, float(k), float(k % 7), float(k % 3)) for k in range(150)], "id bigint, x double, y double, z double")
    assert pt.hierarchy_simplify(p, 3, 1.0).agg(F.sum("cluster_points")).first()[0] == 150


def test_more_than_four_slots(spark):
    slots = [("a", k, [f"t{k}", "any"] if k < 5 else ["t0"]) for k in range(6)] + [("b", k, [f"t{k}"]) for k in range(6)]
    offers = [("a", f"t{k}") for k in range(5)] + [("a", "any")] + [("b", f"t{k}") for k in range(5)] + [("b", "t0")]
    got = {r.request_id: r.compatible for r in pv.match_input_types(spark.createDataFrame(offers, "request_id string, kind string"), spark.createDataFrame(slots, "request_id string, slot int, types array<string>")).collect()}
    def brute(request):
        want, have = [s[2] for s in slots if s[0] == request], [o[1] for o in offers if o[0] == request]
        return any(all(k in t for k, t in zip(order, want)) for order in itertools.permutations(have))
    assert got == {"a": brute("a"), "b": brute("b")}


def test_one_tree_hash_for_all_sizes(spark):
    files = [("s", f"p/{k:06d}", f"{k * 7:064x}") for k in range(120_000)] + [("t", "b", "2"), ("t", "a", "1")]
    got = {r.set_id: (r.files, r.digest) for r in pv.tree_hash(spark.createDataFrame(pd.DataFrame(files, columns=["set_id", "path", "sha256"])), "set_id").collect()}
    digest = lambda name: hashlib.sha256("".join(f"{p}\0{h}\n" for s, p, h in sorted(files) if s == name).encode()).hexdigest()
    assert got == {"s": (120_000, digest("s")), "t": (2, digest("t"))}


def test_trailing_rows_are_refused(spark, tmp_path):
    head = "ply\nformat ascii 1.0\nelement vertex 1\n" + "".join(f"property float {c}\n" for c in ("x", "y", "z", "nx", "ny", "nz")) + "end_header\n"
    (tmp_path / "a.ply").write_text(head + "0 0 0 0 0 1\n1 1 1 0 0 1\n")
    (tmp_path / "b.ply").write_text(head + "0 0 0 0 0 1\n")
    got = {r.path.rsplit("/", 1)[1]: r.reason for r in sp.read_ply_points(spark, [str(tmp_path / "a.ply"), str(tmp_path / "b.ply")]).collect()}
    assert got == {"a.ply": "malformed_ply", "b.ply": None}
    triangle = "0 0 0\n1 0 0\n0 1 0\n3 0 1 2\n"
    for name, text in {"ok": "OFF\n3 1 0\n" + triangle, "line": "OFF 3 1 0\n" + triangle, "more": "OFF\n3 1 0\n" + triangle + "3 0 1 2\n", "nan": "OFF\n3 1 0\n" + triangle.replace("1 0 0", "nan 0 0", 1)}.items():
        (tmp_path / f"{name}.off").write_text(text)
    vertices, faces, rejects = meshes.read_mesh_text(spark, [str(tmp_path / f"{n}.off") for n in ("ok", "line", "more", "nan")])
    assert {r.path.rsplit("/", 1)[1] for r in rejects.collect()} == {"more.off", "nan.off"} and faces.count() == 2


def test_hot_rows_on_either_side_are_split(spark):
    left = spark.createDataFrame([(0, k) for k in range(60)] + [(k, -k) for k in range(1, 20)], "key int, l int")
    right = spark.createDataFrame([(0, k) for k in range(40)] + [(k, k) for k in range(5, 30)], "key int, r int")
    plain = sorted(map(tuple, left.join(right, ["key"]).collect()))
    assert sorted(map(tuple, skew.salted_join(left, right, ["key"], "r", rows=7).collect())) == plain
    hot = skew.hot_keys(left, right, ["key"], 7).collect()
    assert [(r["key"], r["_left"], r["_right"]) for r in hot] == [(0, 9, 6)]


def test_boxes_of_any_scale(spark):
    rows = [(k, x, x + w) for k, (x, w) in enumerate((s * x, s * w) for s in (1e-90, 1e-12, 1.0, 1e30) for x, w in ((0.0, 1.0), (0.5, 0.0), (3.0, 2.0)))]
    df = spark.createDataFrame(rows, "k int, lo double, hi double")
    side = lambda p: with_box(df.select(F.col("k").alias(f"{p}k"), "lo", "hi"), p, {"x": F.col("lo")}, {"x": F.col("hi")}).drop("lo", "hi")
    got = {(r.lk, r.rk) for r in box_join(side("l"), side("r"), ("x",), "rk").collect()}
    assert got == {(a, b) for a, al, ah in rows for b, bl, bh in rows if al <= bh and bl <= ah}


def test_long_path_is_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(3000)], "a bigint, b bigint")
    assert [r.component for r in graph.connected_components(edges).select("component").distinct().collect()] == [0]


def test_titles_inside_words_are_found(spark):
    entries = spark.createDataFrame([(1, "mesh", "surface"), (2, "hull", "convex")], "id int, title string, summary string")
    asked = spark.createDataFrame([(7, "remeshing")], "q int, text string")
    assert [(r.q, r.id, r.score) for r in rt.classic_search(entries, asked, "q", "id", 5).collect()] == [(7, 1, 10)]


def test_triangles_are_bounded_and_strange_pairs_refused(spark):
    rows = [("t", "Triangle_3", [0.0, 0, 0, 1, 0, 0, 0, 1, 0]), ("in", "Segment_3", [0.2, 0.2, -1, 0.2, 0.2, 1]), ("out", "Segment_3", [5.0, 5, -1, 5, 5, 1]), ("ray", "Ray_3", [0.1, 0.1, 5, 0.1, 0.1, 4]),
            ("away", "Ray_3", [0.1, 0.1, 5, 0.1, 0.1, 6]), ("p", "Point_3", [0.0, 0, 0])]
    prims = spark.createDataFrame([(a, b, [float(x) for x in c]) for a, b, c in rows], "id string, kind string, coords array<double>")
    asked = spark.createDataFrame([(k, "intersection", [k, "t"]) for k in ("in", "out", "ray", "away", "p")] + [("swapped", "intersection", ["t", "in"])], "id string, query string, arguments array<string>")
    got = {r.id: (r.result, r.reason) for r in evaluate_intersections(prims, asked).collect()}
    assert got == {"in": ("point", None), "out": ("empty", None), "ray": ("point", None), "away": ("empty", None), "p": (None, "unsupported_pair"), "swapped": ("point", None)}
