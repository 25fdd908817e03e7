import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratalith import checks
from stratalith.operators import neighbors as nb
from stratalith.operators import ordering
from stratalith.operators import points as pt


def frame(spark, rows, coords, **extra):
    return spark.createDataFrame(pd.DataFrame(rows, columns=list(coords)).assign(id=range(len(rows)), **extra))


def brute_knn(points, queries, k):
    d2 = sum((queries[:, None, i] - points[None, :, i]) ** 2 for i in range(points.shape[1]))
    return [list(np.lexsort((np.arange(len(points)), row))[:k]) for row in d2]


@pytest.mark.parametrize("d", [2, 3])
def test_knn_with_a_crowded_place_and_equal_points(spark, d, monkeypatch):
    monkeypatch.setattr(nb, "SMALL_POINTS", 0)
    rng = np.random.default_rng(3)
    points = np.vstack([rng.random((300, d)) * 100, 50 + rng.random((300, d)) * 0.01, np.repeat([[7.0] * d], 300, 0)])
    queries = np.vstack([rng.random((150, d)) * 140 - 20, points[300:330], points[-2:]])
    coords = "xyz"[:d]
    p, q = frame(spark, points, coords), frame(spark, queries, coords).withColumnRenamed("id", "query_id")
    result = nb.knn_join(p, q, 5, coords, leaf_rows=16)
    got = result.toPandas().sort_values(["query_id", "rank"])["id"].to_numpy().reshape(len(queries), 5)
    assert [list(r) for r in got] == brute_knn(points, queries, 5)
    assert checks.check_knn(result, p, q, 5, coords).count() == 0
    assert checks.check_closer_point(result, p, q, 5, coords).count() == 0


def test_knn_check_sees_a_tampered_row(spark):
    rng = np.random.default_rng(4)
    p = frame(spark, rng.random((50, 3)), "xyz")
    q = p.withColumnRenamed("id", "query_id")
    result = nb.knn_join(p, q, 3)
    wrong = result.withColumn("distance", F.when((F.col("query_id") == 7) & (F.col("rank") == 2), 0.0).otherwise(F.col("distance")))
    assert checks.check_knn(wrong, p, q, 3).count() > 0


def test_fewer_points_than_neighbours(spark):
    p = frame(spark, [[0.0, 0, 0], [1, 0, 0]], "xyz")
    assert nb.knn_join(p, p.withColumnRenamed("id", "query_id"), 5).count() == 4


def test_radius_is_closed_and_salting_changes_nothing(spark, monkeypatch):
    points = np.array([[float(x), float(y)] for x in range(8) for y in range(8)] + [[3.0, 3.0]] * 40)
    p = frame(spark, points, "xy")
    q = p.withColumnRenamed("id", "query_id")
    plain = {(r.query_id, r.id) for r in nb.radius_join(p, q, 1.0, "xy").collect()}
    want = {(i, j) for i in range(len(points)) for j in range(len(points)) if ((points[i] - points[j]) ** 2).sum() <= 1.0}
    assert plain == want
    from stratalith.operators import skew
    monkeypatch.setattr(skew.salted_join, "__defaults__", (5,))
    assert {(r.query_id, r.id) for r in nb.radius_join(p, q, 1.0, "xy").collect()} == want
    counted = {r.query_id: r.neighbours for r in nb.count_within(p.withColumn("label", F.lit(0)), q, 1.0, "xy").collect()}
    assert all(counted[i] == sum(1 for a, _ in want if a == i) for i in range(len(points)))


def test_spacing_counts_the_point_itself(spark):
    line = frame(spark, [[float(x), 0, 0] for x in range(10)], "xyz")
    assert pt.average_spacing(line, 2).first()["average_spacing"] == pytest.approx(11 / 15)


def test_outlier_goes_first(spark):
    cube = [[float(x), float(y), float(z)] for x in (0, 1) for y in (0, 1) for z in (0, 1)] + [[10.0, 10, 10]]
    kept = pt.remove_outliers(frame(spark, cube, "xyz"), 3, 12.0, 0.1)
    assert sorted(r.id for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6] or len(kept.collect()) == int(9 * 0.88)
    assert 8 not in {r.id for r in kept.collect()}


def test_hull_of_a_lattice_and_of_a_circle(spark, monkeypatch):
    lattice = frame(spark, [[float(x), float(y)] for x in range(4) for y in range(4)], "xy", g=0)
    assert {(r.x, r.y) for r in pt.convex_hull_2d(lattice, "g").collect()} == {(0, 0), (3, 0), (3, 3), (0, 3)}
    rng = np.random.default_rng(5)
    cloud = frame(spark, np.round(rng.normal(size=(400, 2)) * 50), "xy", g=1)
    assert checks.check_hull(pt.convex_hull_2d(cloud, "g"), cloud, "g").count() == 0


def test_bounding_ball(spark):
    rng = np.random.default_rng(6)
    p = frame(spark, rng.normal(size=(200, 3)), "xyz", g=2)
    assert checks.check_balls(pt.bounding_ball(p, "g", 0.01), p, "g", 0.01).count() == 0


def test_hierarchy_keeps_source_points(spark):
    rng = np.random.default_rng(7)
    p = frame(spark, rng.random((120, 3)), "xyz")
    kept = pt.hierarchy_simplify(p, 10, 0.3)
    assert checks.check_submultiset(kept.select("x", "y", "z"), p).count() == 0
    assert kept.agg(F.sum("cluster_points")).first()[0] == 120


def test_power_site_prefers_weight(spark):
    sites = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 10.0, 0.0, 90.0)], "site_id long, x double, y double, w double")
    p = frame(spark, [[2.0, 0.0]], "xy")
    assert pt.power_site(p, sites, ["x", "y"]).first()["site_id"] == 2


def test_global_rank_and_cuts_with_a_hot_value(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("m"))
    order = [F.col("m"), F.col("id")]
    want = sorted((r.m, r.id) for r in rows.collect())
    got = sorted((r.rank, r.m, r.id) for r in ordering.global_rank(rows, order).collect())
    assert [(m, i) for _, m, i in got] == want and [r for r, _, _ in got] == list(range(1, 1001))
    assert sorted((r.m, r.id) for r in ordering.rank_cut(rows, order, 333).collect()) == want[:333]
    per = ordering.grouped_rank(rows, "m", [F.col("id")]).collect()
    for m in {r.m for r in per}:
        assert sorted(r.position for r in per if r.m == m) == list(range(1, 1 + sum(1 for r in per if r.m == m)))
