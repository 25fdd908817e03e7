"""Queries over primitives and the questions asked about them, built from part rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exact
from ..operators import kernel as kn
from . import inputs as i
from .registry import query

_NAMES = ["orientation", "collinear", "left_turn", "right_turn", "midpoint", "centroid", "circumcenter"]
_PRIM = "t AS (SELECT p_partkey AS k, CAST(p_size AS DOUBLE) AS x, round(p_retailprice * 10) AS y, CAST(p_partkey % 40 AS DOUBLE) AS z FROM part), nn AS (SELECT count(*) AS n FROM part)"


def _tuples(spark, sf):
    """Every part with two partners, whose rows are found by key arithmetic."""
    part = i.table(spark, sf, "part")
    n = part.count()
    k = F.col("p_partkey")
    return part.select(k.alias("k"), (k * 7 + 1).alias("k1"), (k * 13 + 5).alias("k2")).withColumns({c: F.pmod(F.col(c), F.lit(n)) for c in ("k1", "k2")})


def _points(spark, sf, d):
    k = F.col("p_partkey")
    xyz = [F.col("p_size").cast("double"), F.round(F.col("p_retailprice") * 10), F.pmod(k, F.lit(40)).cast("double")][:d]
    return i.table(spark, sf, "part").select(F.concat(F.lit("q"), k).alias("id"), F.lit(f"Point_{d}").alias("kind"), F.array(*xyz).alias("coords"))


def _chained(spark, sf, d, points, kind, prefix):
    """Primitives with several corners: row k takes the points of k, k1 and k2."""
    t = _tuples(spark, sf)
    at = lambda name: _points(spark, sf, d).select(F.substring("id", 2, 20).cast("bigint").alias(name), F.col("coords").alias(f"c_{name}"))
    names = ["k", "k1", "k2"][:points]
    for name in names:
        t = t.join(at(name), name)
    return t.select(F.concat(F.lit(prefix), "k").alias("id"), F.lit(kind).alias("kind"), F.concat(*[f"c_{n}" for n in names]).alias("coords"))


_TRI = f"{_PRIM}, j AS (SELECT a.k, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz FROM nn, t a JOIN t b ON b.k = (a.k * 7 + 1) % n JOIN t c ON c.k = (a.k * 13 + 5) % n)"


@query("b3_construct_primitives", f"""WITH {_TRI} SELECT 's' || k AS id, 'Segment_3' AS kind, (ax-bx)*(ax-bx)+(ay-by_)*(ay-by_)+(az-bz)*(az-bz) AS measure, (ax, ay, az) = (bx, by_, bz) AS degenerate FROM j
  UNION ALL SELECT 't' || k, 'Triangle_2', ((bx-ax)*(cy-ay)-(by_-ay)*(cx-ax))/2, (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) = 0 FROM j
  UNION ALL SELECT 'e' || k, 'Plane_3', m/4, m = 0 FROM (SELECT k, power((by_-ay)*(cz-az)-(bz-az)*(cy-ay), 2) + power((bz-az)*(cx-ax)-(bx-ax)*(cz-az), 2) + power((bx-ax)*(cy-ay)-(by_-ay)*(cx-ax), 2) AS m FROM j)""")
def b3_construct_primitives(spark, sf):
    prims = _chained(spark, sf, 3, 2, "Segment_3", "s").unionByName(_chained(spark, sf, 2, 3, "Triangle_2", "t")).unionByName(_chained(spark, sf, 3, 3, "Plane_3", "e"))
    return kn.construct_primitives(prims).select("id", "kind", "measure", "degenerate")


@query("b4_evaluate_predicates", f"""WITH {_TRI}, q AS (SELECT *, ['orientation', 'collinear', 'left_turn', 'right_turn', 'midpoint', 'centroid', 'circumcenter'][k % 7 + 1] AS query, (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) AS o,
    (bx-ax)*(bx-ax)+(by_-ay)*(by_-ay) AS uu, (cx-ax)*(cx-ax)+(cy-ay)*(cy-ay) AS ww FROM j)
  SELECT 'r' || k AS id, query, CASE WHEN query = 'orientation' THEN CAST(sign(o) AS INTEGER) END AS sign, CASE query WHEN 'collinear' THEN o = 0 WHEN 'left_turn' THEN o > 0 WHEN 'right_turn' THEN o < 0 END AS truth,
    round(CASE query WHEN 'midpoint' THEN (ax+bx)/2 WHEN 'centroid' THEN (ax+bx+cx)/3 WHEN 'circumcenter' THEN CASE WHEN o <> 0 THEN ax + ((cy-ay)*uu-(by_-ay)*ww)/(2*o) END END, 4) AS px FROM q""")
def b4_evaluate_predicates(spark, sf):
    names = F.array(*[F.lit(n) for n in _NAMES])
    two = F.col("k") % 7 == 4
    arg = lambda c: F.concat(F.lit("q"), c)
    asked = _tuples(spark, sf).select(F.concat(F.lit("r"), "k").alias("id"), F.element_at(names, (F.col("k") % 7 + 1).cast("int")).alias("query"),
                                      F.when(two, F.array(arg("k"), arg("k1"))).otherwise(F.array(arg("k"), arg("k1"), arg("k2"))).alias("arguments"))
    return kn.evaluate_predicates(_points(spark, sf, 2), asked).select("id", "query", "sign", "truth", F.round(F.get("point", 0), 4).alias("px"))


@query("b5_evaluate_intersections", f"""WITH {_TRI}, s AS (SELECT j.k, ax, ay, bx, by_, w.x AS cx, w.y AS cy, w2.x AS dx, w2.y AS dy FROM nn, j JOIN t w ON w.k = (j.k + 1) % n JOIN t w2 ON w2.k = (((j.k + 1) % n) * 7 + 1) % n),
  d AS (SELECT *, (bx-ax)*(dy-cy)-(by_-ay)*(dx-cx) AS den, (cx-ax)*(dy-cy)-(cy-ay)*(dx-cx) AS sn, (cx-ax)*(by_-ay)-(cy-ay)*(bx-ax) AS tn, (bx-ax)*(bx-ax)+(by_-ay)*(by_-ay) AS uu, (dx-cx)*(dx-cx)+(dy-cy)*(dy-cy) AS ww FROM s),
  o AS (SELECT *, CASE WHEN uu > 0 THEN greatest(0.0, least(((cx-ax)*(bx-ax)+(cy-ay)*(by_-ay))/uu, ((dx-ax)*(bx-ax)+(dy-ay)*(by_-ay))/uu)) END AS lo, CASE WHEN uu > 0 THEN least(1.0, greatest(((cx-ax)*(bx-ax)+(cy-ay)*(by_-ay))/uu, ((dx-ax)*(bx-ax)+(dy-ay)*(by_-ay))/uu)) END AS hi,
    (dx-cx)*(ay-cy)-(dy-cy)*(ax-cx) = 0 AND (ax-cx)*(dx-cx)+(ay-cy)*(dy-cy) BETWEEN 0 AND ww AND (ww > 0 OR (ax = cx AND ay = cy)) AS held FROM d),
  r AS (SELECT *, CASE WHEN uu = 0 THEN CASE WHEN held THEN 'point' ELSE 'empty' END WHEN den <> 0 THEN CASE WHEN sn/den BETWEEN 0 AND 1 AND tn/den BETWEEN 0 AND 1 THEN 'point' ELSE 'empty' END
    WHEN tn <> 0 OR lo > hi THEN 'empty' WHEN lo = hi THEN 'point' ELSE 'segment' END AS result, CASE WHEN uu = 0 THEN 0.0 WHEN den <> 0 THEN sn/den ELSE lo END AS at_ FROM o)
  SELECT 'i' || k AS id, result <> 'empty' AS meets, result, CASE WHEN result = 'point' THEN round(ax + at_*(bx-ax), 3) END AS px FROM r""")
def b5_evaluate_intersections(spark, sf):
    """Segments of neighbouring rows, parallel ones and single points too."""
    prims = _chained(spark, sf, 2, 2, "Segment_2", "s")
    n = prims.count()
    k = F.substring("id", 2, 20).cast("bigint")
    asked = prims.select(F.concat(F.lit("i"), k).alias("id"), F.lit("intersection").alias("query"), F.array("id", F.concat(F.lit("s"), F.pmod(k + 1, F.lit(n)))).alias("arguments"))
    return kn.evaluate_intersections(prims, asked).select("id", "meets", "result", F.round(F.get("point", 0), 3).alias("px"))


@query("b6_evaluate_distances", f"""WITH {_TRI} SELECT 'd' || k AS id, 'squared_distance' AS query, (ax-bx)*(ax-bx)+(ay-by_)*(ay-by_)+(az-bz)*(az-bz) AS squared_distance, CAST(NULL AS VARCHAR) AS comparison FROM j WHERE k % 2 = 0
  UNION ALL SELECT 'd' || k, 'compare_distance', NULL, CASE WHEN (ax-bx)*(ax-bx)+(ay-by_)*(ay-by_)+(az-bz)*(az-bz) < (ax-cx)*(ax-cx)+(ay-cy)*(ay-cy)+(az-cz)*(az-cz) THEN 'smaller'
    WHEN (ax-bx)*(ax-bx)+(ay-by_)*(ay-by_)+(az-bz)*(az-bz) > (ax-cx)*(ax-cx)+(ay-cy)*(ay-cy)+(az-cz)*(az-cz) THEN 'larger' ELSE 'equal' END FROM j WHERE k % 2 = 1""")
def b6_evaluate_distances(spark, sf):
    arg = lambda c: F.concat(F.lit("q"), c)
    pair = F.col("k") % 2 == 0
    asked = _tuples(spark, sf).select(F.concat(F.lit("d"), "k").alias("id"), F.when(pair, "squared_distance").otherwise("compare_distance").alias("query"),
                                      F.when(pair, F.array(arg("k"), arg("k1"))).otherwise(F.array(arg("k"), arg("k1"), arg("k2"))).alias("arguments"))
    return kn.evaluate_distances(_points(spark, sf, 3), asked)


@query("b8_certified_sign", f"""WITH {_TRI} SELECT k, CAST(sign((bx-ax)*(cy-ay)-(by_-ay)*(cx-ax)) AS INTEGER) AS sign FROM j""")
def b8_certified_sign(spark, sf):
    """Integer coordinates, so the SQL determinant is exact as well."""
    t = _chained(spark, sf, 2, 3, "Triangle_2", "t").select(F.substring("id", 2, 20).cast("bigint").alias("k"), *[F.get("coords", n).alias(f"v{n}") for n in range(6)])
    pts = [(F.col(f"v{2 * n}"), F.col(f"v{2 * n + 1}")) for n in range(3)]
    return exact.certified_sign(t, pts).select("k", "sign")
