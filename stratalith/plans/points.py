"""Queries over point sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import neighbors as nb
from ..operators import points as pt
from . import inputs as i
from .registry import query

_KNN3 = """, ranked AS (SELECT q.id AS query_id, p.id AS id,
  (q.x-p.x)*(q.x-p.x) + (q.y-p.y)*(q.y-p.y) + (q.z-p.z)*(q.z-p.z) AS d2,
  row_number() OVER (PARTITION BY q.id ORDER BY (q.x-p.x)*(q.x-p.x) + (q.y-p.y)*(q.y-p.y) + (q.z-p.z)*(q.z-p.z), p.id) AS rank
  FROM p3 q, p3 p)"""


@query("c1_knn_join", f"WITH {i.P3}{_KNN3} SELECT query_id, id, rank, round(sqrt(d2), 6) AS distance FROM ranked WHERE rank <= 5")
def c1_knn_join(spark, sf):
    p = i.points3(spark, sf)
    return nb.knn_join(p, p.withColumnRenamed("id", "query_id"), 5).select(
        "query_id", "id", "rank", F.round("distance", 6).alias("distance"))


@query("c1_knn_join_planar", f"""WITH {i.P2} SELECT * FROM (SELECT q.id AS query_id, p.id AS id,
  round(sqrt((q.x-p.x)*(q.x-p.x) + (q.y-p.y)*(q.y-p.y)), 6) AS distance,
  row_number() OVER (PARTITION BY q.id ORDER BY (q.x-p.x)*(q.x-p.x) + (q.y-p.y)*(q.y-p.y), p.id) AS rank
  FROM p2 q, p2 p) WHERE rank <= 8""")
def c1_knn_join_planar(spark, sf):
    p = i.points2(spark, sf)
    return nb.knn_join(p, p.withColumnRenamed("id", "query_id"), 8, ("x", "y")).select(
        "query_id", "id", "rank", F.round("distance", 6).alias("distance"))


_RADIUS = 0.15


@query("c2_radius_join", f"""WITH {i.P3}, d AS (SELECT q.id AS query_id, p.id AS id,
  (q.x-p.x)*(q.x-p.x) + (q.y-p.y)*(q.y-p.y) + (q.z-p.z)*(q.z-p.z) AS d2 FROM p3 q, p3 p)
  SELECT query_id, id, round(sqrt(d2), 6) AS distance FROM d WHERE d2 <= {_RADIUS}::DOUBLE * {_RADIUS}::DOUBLE""")
def c2_radius_join(spark, sf):
    p = i.points3(spark, sf)
    return nb.radius_join(p, p.withColumnRenamed("id", "query_id"), _RADIUS).select(
        "query_id", "id", F.round("distance", 6).alias("distance"))


@query("c2_neighbours_by_label", f"""WITH {i.P3} SELECT q.id AS query_id, p.label, count(*) AS neighbours FROM p3 q, p3 p
  WHERE (q.x-p.x)*(q.x-p.x) + (q.y-p.y)*(q.y-p.y) + (q.z-p.z)*(q.z-p.z) <= {_RADIUS}::DOUBLE * {_RADIUS}::DOUBLE
  GROUP BY ALL""")
def c2_neighbours_by_label(spark, sf):
    p = i.points3(spark, sf)
    return nb.count_within(p, p.withColumnRenamed("id", "query_id"), _RADIUS)


@query("b1_normalize_units", """SELECT p_partkey, p_retailprice AS value,
  ['mm','cm','m','deg'][p_partkey % 4 + 1] AS unit,
  round(CASE p_partkey % 4 WHEN 0 THEN p_retailprice / 10.0 WHEN 1 THEN p_retailprice * 10 / 10.0
    WHEN 2 THEN p_retailprice * 1000 / 10.0 ELSE radians(p_retailprice) END, 6) AS normalized,
  CASE WHEN p_partkey % 4 = 3 THEN 'rad' ELSE 'cm' END AS normalized_unit FROM part""")
def b1_normalize_units(spark, sf):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("mm", "cm", "m", "deg")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    df = i.table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("value"), unit.alias("unit"))
    return pt.normalize_units(df, "value", "unit", "cm").withColumn("normalized", F.round("normalized", 6))


@query("b2_numeric_gate", f"""WITH {i.LP}, b AS (SELECT label, min(isfinite(x) AND isfinite(y)) AS all_finite,
  greatest(max(abs(x)), max(abs(y))) AS max_abs, greatest(max(x) - min(x), max(y) - min(y)) AS span FROM lp GROUP BY label)
  SELECT label, all_finite, max_abs, span, round(max_abs / span, 6) AS ratio,
  all_finite AND span >= 1e-100 AND max_abs <= 1e100 AND max_abs / span <= 1e6 AS passed FROM b""")
def b2_numeric_gate(spark, sf):
    return pt.numeric_gate(i.line_points(spark, sf), ["x", "y"], ["label"]).withColumn("ratio", F.round("ratio", 6))


_MATRIX = [[0.0, -2.0, 5.0], [3.0, 0.5, -1.0]]


@query("b7_affine_transform", f"""WITH {i.LP} SELECT id, round(CASE WHEN label = 'A' THEN x * 0.0 + y * -2.0
  ELSE x * 0.0 + y * -2.0 + 5.0 END, 6) AS x, round(CASE WHEN label = 'A' THEN x * 3.0 + y * 0.5
  ELSE x * 3.0 + y * 0.5 - 1.0 END, 6) AS y FROM lp""")
def b7_affine_transform(spark, sf):
    moved = pt.affine_transform(i.line_points(spark, sf), _MATRIX, ["x", "y"], F.col("label") == "A")
    return moved.select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("d1_bbox", f"""WITH {i.LP} SELECT label, count(*) AS points, min(x) AS min_x, min(y) AS min_y,
  max(x) AS max_x, max(y) AS max_y FROM lp GROUP BY ROLLUP (label)""")
def d1_bbox(spark, sf):
    return pt.bbox(i.line_points(spark, sf), ["x", "y"], "label")


@query("d1_bbox_3d", f"""WITH {i.P3} SELECT label, count(*) AS points, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z,
  max(x) AS max_x, max(y) AS max_y, max(z) AS max_z FROM p3 GROUP BY ROLLUP (label)""")
def d1_bbox_3d(spark, sf):
    return pt.bbox(i.points3(spark, sf), ["x", "y", "z"], "label")


@query("d2_affine_rank", f"""WITH {i.MESH}, p AS (SELECT CAST(x AS BIGINT) AS set_id, x, y, z FROM mv WHERE CAST(x AS BIGINT) % 4 <> 3
    UNION ALL SELECT CAST(x AS BIGINT), x, y, 0.0 FROM mv WHERE CAST(x AS BIGINT) % 4 = 3
    UNION ALL SELECT 1000 + vid % 7, x, y, z FROM mv),
  o AS (SELECT set_id, min({{'x': x, 'y': y, 'z': z}}) AS b FROM p GROUP BY set_id),
  q AS (SELECT p.set_id, x - b.x AS ax, y - b.y AS ay, z - b.z AS az FROM p JOIN o USING (set_id)),
  u AS (SELECT set_id, max({{'m': ax*ax+ay*ay+az*az, 'x': ax, 'y': ay, 'z': az}}) AS u FROM q GROUP BY set_id),
  c AS (SELECT q.*, u.u AS u, u.u.y*az-u.u.z*ay AS cx, u.u.z*ax-u.u.x*az AS cy, u.u.x*ay-u.u.y*ax AS cz FROM q JOIN u USING (set_id)),
  n AS (SELECT set_id, max({{'m': cx*cx+cy*cy+cz*cz, 'x': cx, 'y': cy, 'z': cz}}) AS n FROM c GROUP BY set_id)
  SELECT set_id, CASE WHEN max(c.u.m) = 0 THEN 0 WHEN max(n.n.m) = 0 THEN 1
    WHEN max(abs(n.n.x*ax+n.n.y*ay+n.n.z*az)) = 0 THEN 2 ELSE 3 END AS affine_rank
  FROM c JOIN n USING (set_id) GROUP BY set_id""")
def d2_affine_rank(spark, sf):
    p = i.points3_part(spark, sf)
    column = F.col("x").cast("bigint")
    flat = column % 4 == 3
    sets = p.select(column.alias("set_id"), "x", "y", F.when(flat, 0.0).otherwise(F.col("z")).alias("z")).unionByName(
        p.select((F.col("id") % 7 + 1000).alias("set_id"), "x", "y", "z"))
    return pt.affine_rank(sets, "set_id")


_SELF3 = """, r AS (SELECT q.id AS query_id, p.id AS id,
  (q.x-p.x)*(q.x-p.x) + (q.y-p.y)*(q.y-p.y) + (q.z-p.z)*(q.z-p.z) AS d2,
  row_number() OVER (PARTITION BY q.id ORDER BY (q.x-p.x)*(q.x-p.x) + (q.y-p.y)*(q.y-p.y) + (q.z-p.z)*(q.z-p.z), p.id) AS rank
  FROM p3 q, p3 p)"""


@query("d3_average_spacing", f"""WITH {i.P3}{_SELF3}, s AS (SELECT query_id, sum(sqrt(d2)) / 7 AS spacing FROM r WHERE rank <= 7 GROUP BY query_id)
  SELECT count(*) AS points, round(avg(spacing), 6) AS average_spacing FROM s""")
def d3_average_spacing(spark, sf):
    return pt.average_spacing(i.points3(spark, sf), 6).withColumn("average_spacing", F.round("average_spacing", 6))


def _tenths(spark, sf):
    return i.points2(spark, sf).withColumn("y", F.round(F.col("y") * 10))


@query("d8_convex_hull_2d", f"""WITH {i.P2}, p AS (SELECT DISTINCT label, x, round(y * 10) AS y FROM p2),
  e AS (SELECT a.label, a.x, a.y, b.x AS bx, b.y AS by_ FROM p a JOIN p b ON a.label = b.label AND (a.x, a.y) <> (b.x, b.y)
    WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.label = a.label AND (
      (b.x-a.x)*(c.y-a.y) - (b.y-a.y)*(c.x-a.x) < 0 OR ((b.x-a.x)*(c.y-a.y) - (b.y-a.y)*(c.x-a.x) = 0
        AND ((c.x-a.x)*(b.x-a.x) + (c.y-a.y)*(b.y-a.y) < 0 OR (c.x-b.x)*(a.x-b.x) + (c.y-b.y)*(a.y-b.y) < 0)))))
  SELECT label, x, y FROM e""")
def d8_convex_hull_2d(spark, sf):
    return pt.convex_hull_2d(_tenths(spark, sf), "label").select("label", "x", "y")


_DIRECTIONS = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1), (1, 1, 1), (-1, -1, -1), (1, -1, 0), (0, 1, -1)]


@query("d9_directional_extremes", f"""WITH {i.P3}, d(direction, dx, dy, dz) AS (VALUES {', '.join(f'({n}, {a}, {b}, {c})' for n, (a, b, c) in enumerate(_DIRECTIONS))}),
  s AS (SELECT CAST(direction AS BIGINT) AS direction, id, x * dx + y * dy + z * dz AS support,
    row_number() OVER (PARTITION BY direction ORDER BY x * dx + y * dy + z * dz DESC, id) AS rn FROM p3, d)
  SELECT direction, id, round(support, 6) AS support FROM s WHERE rn = 1""")
def d9_directional_extremes(spark, sf):
    return pt.directional_extremes(i.points3(spark, sf), _DIRECTIONS).withColumn("support", F.round("support", 6))


@query("d10_bounding_ball")
def d10_bounding_ball(spark, sf):
    return pt.bounding_ball(i.points3(spark, sf), "label", 0.01)


_SPLIT = ", a AS (SELECT * FROM p3 WHERE label % 2 = 0), b AS (SELECT * FROM p3 WHERE label % 2 = 1)"
_NEAR_AB = """, r AS (SELECT a.id AS query_id, b.id, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) AS d2 FROM a, b),
  m AS (SELECT query_id, min(d2) AS d2, arg_min(id, {'d': d2, 'i': id}) AS id FROM r GROUP BY query_id)"""


def _halves(spark, sf):
    p = i.points3(spark, sf)
    return p.filter("label % 2 = 0"), p.filter("label % 2 = 1")


@query("d11_directed_distance", f"""WITH {i.P3}{_SPLIT}{_NEAR_AB}
  SELECT round(sqrt(d2), 6) AS distance, query_id AS from_id, id AS to_id FROM m ORDER BY d2 DESC, query_id LIMIT 1""")
def d11_directed_distance(spark, sf):
    return pt.directed_distance(*_halves(spark, sf)).withColumn("distance", F.round("distance", 6))


@query("f12b_alignment_metrics", f"""WITH {i.P3}{_SPLIT}{_NEAR_AB}
  SELECT count(*) AS points, round(sqrt(avg(d2)), 6) AS rms, round(sqrt(max(d2)), 6) AS max_residual,
  round(avg(CASE WHEN d2 <= 0.1::DOUBLE * 0.1::DOUBLE THEN 1.0 ELSE 0.0 END), 6) AS inlier_fraction FROM m""")
def f12b_alignment_metrics(spark, sf):
    return pt.alignment_metrics(*_halves(spark, sf), 0.1).select(
        "points", *[F.round(c, 6).alias(c) for c in ("rms", "max_residual", "inlier_fraction")])


@query("e1_grid_simplify", f"""WITH {i.LP}, r AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY floor(x / 2000.0), floor(y / 2000.0)) AS cell_points FROM (SELECT id, x * 500 AS x, y FROM lp)
    WINDOW w AS (PARTITION BY floor(x / 2000.0), floor(y / 2000.0) ORDER BY
      (x - (floor(x / 2000.0) + 0.5) * 2000.0) * (x - (floor(x / 2000.0) + 0.5) * 2000.0)
      + (y - (floor(y / 2000.0) + 0.5) * 2000.0) * (y - (floor(y / 2000.0) + 0.5) * 2000.0), id))
  SELECT id, x, y, cell_points FROM r WHERE rn = 1 AND cell_points >= 3""")
def e1_grid_simplify(spark, sf):
    p = i.line_points(spark, sf).withColumn("x", F.col("x") * 500)
    return pt.grid_simplify(p, 2000.0, 3, ("x", "y"))


@query("e2_random_simplify", f"""WITH {i.OP}, r AS (SELECT *, row_number() OVER (ORDER BY md5('7:' || id), id) AS rn, count(*) OVER () AS n FROM op)
  SELECT id, x, y FROM r WHERE rn <= floor(n * (100.0 - 35.0) / 100.0)""")
def e2_random_simplify(spark, sf):
    return pt.random_simplify(i.order_points(spark, sf), 35.0, 7).select("id", "x", "y")


@query("e3_remove_outliers", f"""WITH {i.P3}{_SELF3}, m AS (SELECT query_id AS id, sum(d2) / 9 AS measure FROM r WHERE rank <= 9 GROUP BY query_id),
  k AS (SELECT least(count(*), greatest(count(*) FILTER (measure < 0.05::DOUBLE * 0.05::DOUBLE), CAST(floor(count(*) * 88.0 / 100.0) AS BIGINT))) AS keep FROM m)
  SELECT id FROM (SELECT id, row_number() OVER (ORDER BY measure, id) AS rn FROM m), k WHERE rn <= keep""")
def e3_remove_outliers(spark, sf):
    return pt.remove_outliers(i.points3(spark, sf), 8, 12.0, 0.05).select("id")


@query("e4_hierarchy_simplify")
def e4_hierarchy_simplify(spark, sf):
    return pt.hierarchy_simplify(i.points3_part(spark, sf), 10, 0.2).select("id", "x", "y", "z", "cluster_points")


@query("e5_multiset_subset", """WITH c AS (SELECT p_size, p_brand FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 999, 'none' FROM supplier),
  s AS (SELECT p_size, p_brand FROM part), m AS (SELECT * FROM c EXCEPT ALL SELECT * FROM s)
  SELECT count(*) = 0 AS is_subset, count(*) AS missing FROM m""")
def e5_multiset_subset(spark, sf):
    part = i.table(spark, sf, "part")
    extra = i.table(spark, sf, "supplier").select(F.lit(999).alias("p_size"), F.lit("none").alias("p_brand"))
    candidate = part.filter("p_partkey % 2 = 0").select("p_size", "p_brand").unionByName(extra)
    return pt.multiset_subset(candidate, part.select("p_size", "p_brand"))


_SITE = "SELECT s_suppkey AS site_id, CAST(s_nationkey * 2 AS DOUBLE) AS x, 900 + CAST(s_suppkey * 11 % 100 AS DOUBLE) AS y, CAST(s_suppkey % 13 AS DOUBLE) AS w FROM supplier"


def _sites(spark, sf):
    key = F.col("s_suppkey")
    return i.table(spark, sf, "supplier").select(
        key.alias("site_id"), (F.col("s_nationkey") * 2).cast("double").alias("x"),
        (F.pmod(key * 11, F.lit(100)).cast("double") + 900).alias("y"), F.pmod(key, F.lit(13)).cast("double").alias("w"))


@query("f10a_nearest_site", f"""WITH {i.P2}, s AS ({_SITE}), r AS (SELECT id, site_id, (p2.x-s.x)*(p2.x-s.x) + (p2.y-s.y)*(p2.y-s.y) AS d2,
  row_number() OVER (PARTITION BY id ORDER BY (p2.x-s.x)*(p2.x-s.x) + (p2.y-s.y)*(p2.y-s.y), site_id) AS rn FROM p2, s)
  SELECT a.id, a.site_id, b.site_id AS second_site, round(sqrt(a.d2), 6) AS distance FROM r a JOIN r b ON a.id = b.id AND a.rn = 1 AND b.rn = 2""")
def f10a_nearest_site(spark, sf):
    return pt.nearest_site(i.points2(spark, sf), _sites(spark, sf), ["x", "y"]).withColumn("distance", F.round("distance", 6))


@query("f10b_power_site", f"""WITH {i.P2}, s AS ({_SITE}), m AS (SELECT id, min((p2.x-s.x)*(p2.x-s.x) + (p2.y-s.y)*(p2.y-s.y) - w) AS power FROM p2, s GROUP BY id)
  SELECT id, round(power, 4) AS power FROM m""")
def f10b_power_site(spark, sf):
    return pt.power_site(i.points2(spark, sf), _sites(spark, sf), ["x", "y"]).select("id", F.round("power", 4).alias("power"))


@query("f10c_spherical_site", f"""WITH {i.P3}, u AS (SELECT id, label, x/n AS x, y/n AS y, z/n AS z FROM (SELECT *, sqrt(x*x+y*y+z*z) AS n FROM p3)),
  s AS (SELECT * FROM u WHERE id % 10 = 0), r AS (SELECT u.id, s.id AS site_id, u.x*s.x + u.y*s.y + u.z*s.z AS cosine,
  row_number() OVER (PARTITION BY u.id ORDER BY (u.x-s.x)*(u.x-s.x) + (u.y-s.y)*(u.y-s.y) + (u.z-s.z)*(u.z-s.z), s.id) AS rn FROM u, s)
  SELECT id, site_id, round(cosine, 6) AS cosine FROM r WHERE rn = 1""")
def f10c_spherical_site(spark, sf):
    p = i.points3(spark, sf)
    sites = p.filter("id % 10 = 0").select(F.col("id").alias("site_id"), "x", "y", "z")
    return pt.spherical_site(p, sites, ["x", "y", "z"]).withColumn("cosine", F.round("cosine", 6))


@query("f10d_periodic_site", f"""WITH {i.P2}, s AS ({_SITE}), c AS (SELECT site_id, x + ox * 50.0 AS x, y + oy * 100.0 AS y, ox, oy
    FROM s, (VALUES (-1), (0), (1)) a(ox), (VALUES (-1), (0), (1)) b(oy)),
  r AS (SELECT id, site_id, ox, oy, (p2.x-c.x)*(p2.x-c.x) + (p2.y-c.y)*(p2.y-c.y) AS d2,
  row_number() OVER (PARTITION BY id ORDER BY (p2.x-c.x)*(p2.x-c.x) + (p2.y-c.y)*(p2.y-c.y), site_id, ox, oy) AS rn FROM p2, c)
  SELECT id, site_id, round(sqrt(d2), 6) AS distance, CAST(ox AS BIGINT) AS offset_x, CAST(oy AS BIGINT) AS offset_y FROM r WHERE rn = 1""")
def f10d_periodic_site(spark, sf):
    return pt.periodic_site(i.points2(spark, sf), _sites(spark, sf), [50.0, 100.0], ["x", "y"]) \
        .withColumn("distance", F.round("distance", 6))
