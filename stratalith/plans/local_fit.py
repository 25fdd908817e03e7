"""Queries for local fits, ball graphs, covering and registration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import local_fit as lf
from ..operators import points as pt
from ..session import settle
from . import inputs as i
from .registry import query


@query("f6_radius_components", f"""WITH RECURSIVE {i.P3}, e AS (SELECT a.id AS a, b.id AS b FROM p3 a, p3 b WHERE (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 0.06::DOUBLE * 0.06::DOUBLE),
  r AS (SELECT id AS node, id AS seen FROM p3 UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen) SELECT node, min(seen) AS component FROM r GROUP BY node""")
def f6_radius_components(spark, sf):
    return lf.radius_components(i.points3(spark, sf), 0.06, ("x", "y", "z"))


@query("f12a_register")
def f12a_register(spark, sf):
    """The points, turned and shifted a little, are brought back."""
    p = i.points3(spark, sf)
    moved = pt.affine_transform(p, [[0.9998, -0.02, 0.0, 0.004], [0.02, 0.9998, 0.0, -0.003], [0.0, 0.0, 1.0, 0.002]], ("x", "y", "z"))
    return lf.register(moved.select("id", "x", "y", "z"), p, 3)[0]


@query("f13_interval_centers")
def f13_interval_centers(spark, sf):
    return lf.interval_centers(i.points2(spark, sf).select("label", "x"), 3, "label")


@query("f13_interval_assignment", f"""WITH RECURSIVE {i.P2}, g AS (SELECT label, list_sort(list(DISTINCT x)) AS xs FROM p2 GROUP BY label),
  c AS (SELECT DISTINCT label, xs, b - a AS d FROM (SELECT label, xs, a, unnest(xs) AS b FROM (SELECT label, xs, unnest(xs) AS a FROM g)) WHERE b >= a),
  st(label, d, xs, k, s) AS (SELECT label, d, xs, 0, xs[1] FROM c UNION ALL SELECT label, d, xs, k + 1, list_filter(xs, lambda x: x > s + d)[1] FROM st WHERE k < 3 AND s IS NOT NULL),
  ft AS (SELECT label, min(d) AS d FROM (SELECT label, d, count(s) FILTER (k >= 3) AS more FROM st GROUP BY ALL) WHERE more = 0 GROUP BY label),
  cs AS (SELECT st.label, k, s, st.d FROM st JOIN ft ON st.label = ft.label AND st.d = ft.d WHERE s IS NOT NULL)
  SELECT p2.label, id, x, CAST(max(k) AS INTEGER) AS centre_number, max(s) + max(d) / 2 AS centre, max(d) / 2 AS radius FROM p2 JOIN cs ON cs.label = p2.label AND s <= x GROUP BY p2.label, id, x""")
def f13_interval_assignment(spark, sf):
    """Three intervals per brand over the sizes of its parts, with every part's interval."""
    return lf.interval_assignment(i.points2(spark, sf), 3, "label")


@query("f14_local_linear_interpolation", "SELECT c_custkey AS query_id, round(2.0 + 3.0 * (c_nationkey * 2) - (900 + c_custkey % 100), 4) AS value FROM customer")
def f14_local_linear_interpolation(spark, sf):
    """The sites carry a linear field, which the fit must reproduce."""
    key = F.col("s_suppkey")
    x, y = (F.col("s_nationkey") * 2).cast("double"), (F.pmod(key * 11, F.lit(100)) + 900).cast("double")
    sites = i.table(spark, sf, "supplier").select(key.alias("site_id"), x.alias("x"), y.alias("y"), (2.0 + 3.0 * x - y).alias("value"))
    asked = i.table(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"), (F.col("c_nationkey") * 2).cast("double").alias("x"), (F.pmod("c_custkey", F.lit(100)) + 900).cast("double").alias("y"))
    return lf.local_linear_interpolation(sites, asked, 8).withColumn("value", F.round("value", 4))


@query("g16_cluster_simplify", f"""WITH {i.MESH}, h AS (SELECT vid, min(vid) OVER (PARTITION BY floor(x/2.5), floor(y/2.5), floor(z/2.5)) AS t FROM mv), m AS (SELECT fid, list_sort([p.t, q.t, r.t]) AS k FROM mf JOIN h p ON p.vid = a JOIN h q ON q.vid = b JOIN h r ON r.vid = c WHERE p.t <> q.t AND q.t <> r.t AND p.t <> r.t)
  SELECT min(fid) AS fid FROM m GROUP BY k""")
def g16_cluster_simplify(spark, sf):
    return lf.cluster_simplify(*i.mesh(spark, sf), 2.5)[1].select("fid")


@query("g17_estimate_normals")
def g17_estimate_normals(spark, sf):
    return lf.estimate_normals(i.points3(spark, sf), 10)


@query("g20_local_roughness")
def g20_local_roughness(spark, sf):
    return lf.local_roughness(i.points3(spark, sf), 10)


@query("g18_smooth_jet")
def g18_smooth_jet(spark, sf):
    return lf.smooth_jet(i.points3(spark, sf), 12, 2)


def _with_normals(spark, sf):
    p = i.points3(spark, sf).select("id", "x", "y", "z")
    n = lf.estimate_normals(p, 10)
    sign = F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0)
    return settle(p.join(n, "id").withColumns({c: F.col(c) * sign for c in ("nx", "ny", "nz")}))


@query("g19_smooth_bilateral")
def g19_smooth_bilateral(spark, sf):
    return lf.smooth_bilateral(_with_normals(spark, sf), 10, 30.0)


@query("f9_orient_normals")
def f9_orient_normals(spark, sf):
    return lf.orient_normals(_with_normals(spark, sf), 6)


@query("f11_normal_clusters")
def f11_normal_clusters(spark, sf):
    return lf.normal_clusters(*i.mesh(spark, sf), 6, 3)[0]
