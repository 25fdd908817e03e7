import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratalith.operators import local_fit as lf
from stratalith.plans import inputs as i


def test_interval_centers_against_brute_force(spark):
    rng = np.random.default_rng(2)
    xs = {g: np.sort(np.round(rng.random(12) * 40, 1)) for g in range(3)}
    df = spark.createDataFrame(pd.DataFrame([(g, float(x)) for g, row in xs.items() for x in row], columns=["g", "x"]))

    def fits(row, r):
        count, cover = 0, -np.inf
        for x in row:
            if x > cover:
                count, cover = count + 1, x + 2 * r
        return count <= 3
    got = {r.g: r.radius for r in lf.interval_centers(df, 3, "g").collect()}
    for g, row in xs.items():
        want = min(r for r in {abs(a - b) / 2 for a in row for b in row} if fits(row, r + 1e-12))
        assert got[g] == pytest.approx(want, abs=1e-9)


def test_jet_leaves_a_plane_alone_and_normals_are_unit(spark):
    rng = np.random.default_rng(3)
    xy = rng.random((80, 2))
    p = spark.createDataFrame(pd.DataFrame({"id": range(80), "x": xy[:, 0], "y": xy[:, 1], "z": 0.5 * xy[:, 0]}))
    moved = lf.smooth_jet(p, 8, 1).join(p.select("id", F.col("x").alias("a"), F.col("z").alias("c")), "id")
    assert moved.filter("abs(x - a) > 1e-9 OR abs(z - c) > 1e-9").count() == 0
    n = lf.estimate_normals(p, 8)
    assert n.filter("abs(nx * nx + ny * ny + nz * nz - 1) > 1e-9 OR abs(nx / nz + 0.5) > 1e-6").count() == 0


def test_oriented_normals_agree_on_a_plane(spark):
    rng = np.random.default_rng(4)
    xy = rng.random((40, 2))
    p = spark.createDataFrame(pd.DataFrame({"id": range(40), "x": xy[:, 0], "y": xy[:, 1], "z": 0.0, "nx": 0.0, "ny": 0.0, "nz": [(-1.0) ** k for k in range(40)]}))
    out = lf.orient_normals(p, 5)
    assert out.groupBy("component").agg(F.countDistinct("nz").alias("n")).filter("n > 1").count() == 0 and out.count() == 40


def test_cluster_errors_never_grow(spark, sf):
    _, totals = lf.normal_clusters(*i.mesh(spark, sf), 4, 3)
    assert totals == sorted(totals, reverse=True)
