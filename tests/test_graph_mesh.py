import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalith import checks
from stratalith.operators import graph as gr
from stratalith.operators import mesh as ms
from stratalith.operators import planar as pl
from stratalith.operators import provenance as pv
from stratalith.operators import surface as sf
from stratalith.plans import inputs as i


def box(spark, size=2.0):
    vertices = spark.createDataFrame([(0, k, size * (k % 2), size * (k // 2 % 2), size * (k // 4)) for k in range(8)], "mesh_id long, vid long, x double, y double, z double")
    faces = spark.createDataFrame([(0, n, *t) for n, t in enumerate(i.BOX_TRIANGLES)], "mesh_id long, fid long, a long, b long, c long")
    return vertices, faces


def test_components_of_a_path_a_star_and_random_edges(spark):
    rng = np.random.default_rng(1)
    rows = [(k, k + 1) for k in range(100)] + [(1000, 1001 + k) for k in range(100)] + [(int(a), int(b)) for a, b in rng.integers(2000, 2100, (60, 2))]
    edges = spark.createDataFrame(rows, "a long, b long")
    labels = gr.connected_components(edges)
    assert checks.check_components(labels, edges.filter("a <> b")).count() == 0
    sizes = {r.component: r["count"] for r in labels.groupBy("component").count().collect()}
    assert sizes[0] == 101 and sizes[1000] == 101


def test_parity_finds_odd_cycles(spark):
    edges = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 1, 1), (5, 6, 1), (6, 7, 0)], "a long, b long, differ int")
    nodes = spark.createDataFrame([(n,) for n in (1, 2, 3, 5, 6, 7)], "node long")
    got = {r.node: r for r in gr.parity(edges, nodes).collect()}
    assert not got[1].consistent and got[5].consistent
    assert got[5].flip != got[6].flip and got[6].flip == got[7].flip


def test_shortest_paths(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 4, 1.0)], "a long, b long, length double")
    paths = gr.shortest_paths(edges, spark.createDataFrame([(1,)], "node long"))
    assert {r.node: r.distance for r in paths.collect()} == {1: 0.0, 2: 1.0, 3: 2.0, 4: 3.0}
    assert checks.check_paths(paths, edges).count() == 0


def test_box_measures_and_sharp_edges(spark):
    v, f = box(spark)
    m = ms.mesh_measures(v, f).first()
    assert (m.area, m.volume, m.reason) == (24.0, pytest.approx(8.0), None)
    assert ms.sharp_edges(v, f, 60.0).count() == 12
    assert ms.inspect_mesh(v, f).first()["euler"] == 2
    flipped = f.withColumn("t", F.col("b")).withColumn("b", F.when(F.col("fid") % 3 == 0, F.col("c")).otherwise(F.col("b"))).withColumn("c", F.when(F.col("fid") % 3 == 0, F.col("t")).otherwise(F.col("c"))).drop("t")
    assert checks.check_mesh_edges(flipped).count() > 0
    assert checks.check_mesh_edges(ms.orient_faces(v, flipped)).count() == 0


def test_long_edges_are_split_conformingly(spark):
    v, f = box(spark)
    v2, f2 = ms.split_long_edges(v, f, 0.9)
    assert checks.check_edge_bound(v2, f2, 0.9).count() == 0
    m = ms.mesh_measures(v2, f2).first()
    assert m.reason is None and m.area == pytest.approx(24.0) and m.volume == pytest.approx(8.0)


def test_nonmanifold_vertex_is_split(spark):
    v, f = box(spark)
    second = f.select("mesh_id", (F.col("fid") + 12).alias("fid"), *[(F.when(F.col(k) == 0, 7).otherwise(F.col(k) + 100)).alias(k) for k in "abc"])
    moved = v.select("mesh_id", (F.col("vid") + 100).alias("vid"), *[(F.col(c) + 2).alias(c) for c in "xyz"]).filter("vid <> 100")
    v2, f2 = ms.split_nonmanifold_vertices(v.unionByName(moved), f.unionByName(second))
    assert ms.inspect_mesh(v2, f2).first()["nonmanifold_vertices"] == 0 and v2.count() == 16


def test_fill_holes_closes_a_box(spark):
    v, f = box(spark)
    v2, f2, report = ms.fill_holes(v, f.filter("fid > 1"), 10)
    assert ms.mesh_measures(v2, f2).first().volume == pytest.approx(8.0) and report.first()["filled"]


def test_ray_through_a_box(spark):
    v, f = box(spark)
    rays = spark.createDataFrame([(1, 0.5, 0.7, -1.0, 0.0, 0.0, 1.0), (2, 5.0, 5.0, -1.0, 0.0, 0.0, 1.0)], "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    got = {r.ray_id: r.distance for r in sf.ray_first_hits(rays, v, f).collect()}
    assert got == {1: pytest.approx(1.0), 2: None}


def test_crossing_boxes(spark):
    v, f = box(spark)
    shifted = v.select("mesh_id", "vid", *[(F.col(c) + 1.0).alias(c) for c in "xyz"])
    hits = sf.mesh_intersections((v, f), (shifted, f))
    assert hits.count() > 0
    assert hits.filter("px < 1 - 1e-9 OR px > 2 + 1e-9 OR qx < 1 - 1e-9 OR qx > 2 + 1e-9").count() == 0
    assert sf.self_intersections(v, f).count() == 0


def test_polygon_with_hole(spark):
    ring = [(1, 0, s, x, y) for s, (x, y) in enumerate([(0, 0), (10, 0), (10, 10), (0, 10)])] + [(1, 1, s, x, y) for s, (x, y) in enumerate([(3, 3), (3, 6), (6, 6), (6, 3)])]
    poly = spark.createDataFrame([(a, b, c, float(x), float(y)) for a, b, c, x, y in ring], "poly_id long, ring int, seq int, x double, y double")
    p = spark.createDataFrame([(1, 4.0, 4.0), (2, 3.0, 4.0), (3, 1.0, 1.0), (4, 11.0, 1.0)], "id long, x double, y double")
    assert {(r.id, r.location) for r in pl.locate_in_polygons(p, poly).collect()} == {(2, "boundary"), (3, "inside")}
    s = pl.polygon_summary(poly).first()
    assert s.area == 91 and s.reasons == []
    for method in ("wachspress", "mean_value", "discrete_harmonic"):
        w = pl.barycentric_weights(p, poly.filter("ring = 0"), method)
        assert w.count() > 0 and checks.check_weights(w, p, poly).count() == 0


def test_bowtie_is_not_simple(spark):
    tie = spark.createDataFrame([(1, 0, s, float(x), float(y)) for s, (x, y) in enumerate([(0, 0), (2, 2), (2, 0), (0, 2)])], "poly_id long, ring int, seq int, x double, y double")
    assert pl.polygon_summary(tie).first().reasons[0] == "ring_not_simple"


def test_two_diagonals(spark):
    seg = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0), (2, 0.0, 2.0, 2.0, 0.0)], "seg_id long, x1 double, y1 double, x2 double, y2 double")
    r = pl.arrangement_counts(seg).first()
    assert (r.vertices, r.edges, r.components, r.faces) == (5, 4, 1, 1)


def test_lineage_and_dag(spark):
    edges = spark.createDataFrame([("c", "b"), ("b", "a")], "output string, input string")
    assert {(r.output, r.input, r.depth) for r in pv.lineage_closure(edges).collect()} == {("c", "b", 1), ("b", "a", 1), ("c", "a", 2)}
    steps = spark.createDataFrame([("p", s) for s in "abcxy"], "plan_id string, step_id string")
    deps = spark.createDataFrame([("p", "b", "a"), ("p", "c", "b"), ("p", "x", "y"), ("p", "y", "x")], "plan_id string, step_id string, depends_on string")
    got = {r.step_id: (r.level, r.problem) for r in pv.dag_levels(steps, deps).collect()}
    assert got == {"a": (0, None), "b": (1, None), "c": (2, None), "x": (None, "cycle"), "y": (None, "cycle")}
