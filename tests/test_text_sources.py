import pytest
from pyspark.sql import functions as F

from stratalith.functions import exact
from stratalith.functions import text as t
from stratalith.operators import evaluation as ev
from stratalith.operators import kernel as kn
from stratalith.operators import provenance as pv
from stratalith.operators import retrieval as rt
from stratalith.sources import files, meshes, points


def test_normalize_and_tokens(spark):
    df = spark.createDataFrame([("Ｃonvex_Hull of 2-D  Points",), ("simplification meshes cubes",), ("点群の法線を推定したい",)], "s string")
    norm = [r[0] for r in df.select(t.normalize_text(F.col("s"), compatible=True)).collect()]
    assert norm[0] == "convex hull of 2d points"
    plain = df.select(t.normalize_text(F.col("s"), compatible=True).alias("n"))
    got = [r[0] for r in plain.select(t.tokens(F.col("n"))).collect()]
    assert got[0] == ["convex", "hull", "2d", "point"]
    assert got[1] == ["simplif", "meshe", "cube"]
    assert set(got[2]) == {"ja:点群", "ja:法線", "ja:推定"}


def test_longer_phrase_hides_the_shorter(spark):
    vocab = spark.createDataFrame([("hull", "hull"), ("convex_hull", "convex hull"), ("mesh", "mesh")], "concept string, phrase string")
    docs = spark.createDataFrame([(1, "the convex hulls of meshes"), (2, "a hull, convex")], "doc long, body string")
    got = {(r.doc, r.concept) for r in rt.tag_concepts(docs, vocab, "doc", "body").collect()}
    assert got == {(1, "convex_hull"), (2, "hull")}


def test_near_duplicates_against_brute_force(spark):
    base = "one two three four five six seven eight nine ten".split()
    texts = [" ".join(base), " ".join(base), " ".join(base[:-1] + ["x"]), "something else entirely here now", " ".join(base + ["y"])]
    docs = spark.createDataFrame([(n, s, "en") for n, s in enumerate(texts)], "id long, body string, lang string")
    got = {(r.a, r.b): r.similarity for r in ev.near_duplicates(docs, "id", "body", "lang", 0.7).collect()}
    sets = [{tuple(s.split()[k:k + 3]) for k in range(len(s.split()) - 2)} for s in texts]
    jac = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    want = {(a, b): jac(a, b) for a in (0, 2, 3, 4) for b in (0, 2, 3, 4) if a < b and jac(a, b) > 0.7} | {(0, 1): 1.0}
    assert got == {k: pytest.approx(x) for k, x in want.items()}


def test_certified_sign_decides_what_doubles_cannot(spark):
    e = 2.0 ** -53
    rows = [(0.5, 0.5, 12.0, 12.0, 24.0, 24.0), (0.5 + 2 * e, 0.5, 12.0, 12.0, 24.0, 24.0), (0.5, 0.5 + 2 * e, 12.0, 12.0, 24.0, 24.0)]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "id int, " + ", ".join(f"v{k} double" for k in range(6)))
    pts = [(F.col(f"v{2 * k}"), F.col(f"v{2 * k + 1}")) for k in range(3)]
    got = {r.id: r.sign for r in exact.certified_sign(df, pts).collect()}
    assert got == {0: 0, 1: 1, 2: -1} or got == {0: 0, 1: -1, 2: 1}
    assert got[1] == -got[2] != 0


def test_kernel_intersections_of_parallel_segments(spark):
    prim = spark.createDataFrame([("a", "Segment_2", [0.0, 0.0, 4.0, 0.0]), ("b", "Segment_2", [2.0, 0.0, 6.0, 0.0]), ("c", "Segment_2", [4.0, 0.0, 6.0, 0.0]), ("d", "Segment_2", [0.0, 1.0, 4.0, 1.0])], "id string, kind string, coords array<double>")
    asked = spark.createDataFrame([("q1", "intersection", ["a", "b"]), ("q2", "intersection", ["a", "c"]), ("q3", "intersection", ["a", "d"])], "id string, query string, arguments array<string>")
    got = {r.id: r.result for r in kn.evaluate_intersections(prim, asked).collect()}
    assert got == {"q1": "segment", "q2": "point", "q3": "empty"}


def test_predicates_by_hand(spark):
    prim = spark.createDataFrame([("a", "Point_2", [0.0, 0.0]), ("b", "Point_2", [4.0, 0.0]), ("c", "Point_2", [0.0, 4.0])], "id string, kind string, coords array<double>")
    asked = spark.createDataFrame([(q, q, ["a", "b", "c"]) for q in ("left_turn", "centroid", "circumcenter")], "id string, query string, arguments array<string>")
    got = {r.id: r for r in kn.evaluate_predicates(prim, asked).collect()}
    assert got["left_turn"].truth and got["circumcenter"].point == [2.0, 2.0] and got["centroid"].point == [pytest.approx(4 / 3)] * 2


def test_spdx_lines(spark):
    df = spark.createDataFrame([("// SPDX-License-Identifier: MIT\nx",), ("nothing",)], "s string")
    assert [r[0] for r in df.select(pv.header_expression(F.col("s"))).collect()] == ["MIT", "(none)"]


def test_readers_reject_what_is_malformed(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("# head\n1 2 3\n\n1 2\n1 2 nan\n4 5 6 # tail\n")
    good, bad = points.read_xyz(spark, str(tmp_path / "a.xyz"))
    assert good.count() == 2 and {r.reason for r in bad.collect()} == {"not_three_numbers", "not_finite_numbers"}
    (tmp_path / "m.off").write_text("OFF\n3 1 0\n0 0 0\n1 0 0\n0 1 0\n3 0 1 2\n")
    (tmp_path / "bad.off").write_text("OFF\n3 1 0\n0 0 0\n1 0 0\n0 1 0\n3 0 1 9\n")
    v, f, rejects = meshes.read_mesh_text(spark, str(tmp_path / "*.off"))
    assert v.count() == 3 and f.first()["corners"] == [0, 1, 2] and rejects.count() == 1
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        files.export_exclusive(good, str(tmp_path / "a.xyz"))


def test_page_text(spark):
    df = spark.createDataFrame([("<p>a &amp; b</p><script>x</script><!-- c --> d",)], "h string")
    assert df.select(files.html_to_text(F.col("h"))).first()[0] == "a & b d"
