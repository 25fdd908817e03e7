"""Queries over polygons, segments, boxes, rays and surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as v
from ..operators import mesh as ms
from ..operators import planar as pl
from ..operators import surface as sf_
from ..session import settle
from . import inputs as i
from .mesh import _K, _r
from .registry import query

_EDGES = "ed AS (SELECT poly_id, ring, seq, x AS x1, y AS y1, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM pg WINDOW w AS (PARTITION BY poly_id, ring ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
_POINT = "pt AS (SELECT id, x, floor(y) AS y FROM p2)"
_LOCATED = f"""{i.P2}, {i.POLY}, {_EDGES}, {_POINT}, t AS (SELECT id, poly_id, (x2-x1)*(y-y1) - (y2-y1)*(x-x1) AS turn, x, y, x1, y1, x2, y2 FROM pt, ed),
  lo AS (SELECT id, poly_id, bool_or(turn = 0 AND x BETWEEN least(x1, x2) AND greatest(x1, x2) AND y BETWEEN least(y1, y2) AND greatest(y1, y2)) AS onb,
    count(*) FILTER ((y1 > y) <> (y2 > y) AND CASE WHEN y2 > y1 THEN turn > 0 ELSE turn < 0 END) % 2 AS odd FROM t GROUP BY ALL)"""


def _points(spark, sf):
    return i.points2(spark, sf).select("id", "x", F.floor("y").cast("double").alias("y"))


@query("c3_locate_in_polygons", f"WITH {_LOCATED} SELECT id, poly_id, CASE WHEN onb THEN 'boundary' ELSE 'inside' END AS location FROM lo WHERE onb OR odd = 1")
def c3_locate_in_polygons(spark, sf):
    return pl.locate_in_polygons(_points(spark, sf), i.polygons(spark, sf))


_OUTER = "og AS (SELECT * FROM pg WHERE ring = 0)"
_STAR = f"""{_LOCATED.replace('FROM pt, ed)', 'FROM pt, ed WHERE ring = 0)')}, {_OUTER},
  st AS (SELECT poly_id, seq, lag(x, 1) OVER w AS ax, lag(y, 1) OVER w AS ay, x AS bx, y AS by_, lead(x) OVER w AS cx, lead(y) OVER w AS cy, max(seq) OVER (PARTITION BY poly_id) AS m FROM (
    SELECT poly_id, seq, x, y FROM og UNION ALL SELECT poly_id, -1, x, y FROM og WHERE seq = 5 UNION ALL SELECT poly_id, 6, x, y FROM og WHERE seq = 0) WINDOW w AS (PARTITION BY poly_id ORDER BY seq)),
  j AS (SELECT lo.id, lo.poly_id, seq, ax, ay, bx, by_, cx, cy, x AS px, y AS py FROM lo JOIN pt USING (id) JOIN st ON st.poly_id = lo.poly_id WHERE NOT onb AND odd = 1 AND seq BETWEEN 0 AND 5),
  w AS (SELECT id, poly_id, seq, ((bx-ax)*(cy-ay)-(by_-ay)*(cx-ax)) / (((ax-px)*(by_-py)-(ay-py)*(bx-px)) * ((bx-px)*(cy-py)-(by_-py)*(cx-px))) AS w FROM j)"""


@query("c4_barycentric_weights", f"WITH {_STAR} SELECT id, poly_id, seq, round(w / sum(w) OVER (PARTITION BY id, poly_id), 6) AS weight FROM w")
def c4_barycentric_weights(spark, sf):
    return pl.barycentric_weights(_points(spark, sf), i.polygons(spark, sf), digits=6)


@query("c4_mean_value_weights")
def c4_mean_value_weights(spark, sf):
    return pl.barycentric_weights(_points(spark, sf), i.polygons(spark, sf), "mean_value")


@query("d4_polygon_properties", f"""WITH {i.POLY}, {_EDGES} SELECT poly_id, ring, count(*) AS corners, sum(x1*y2-x2*y1)/2 AS signed_area, round(sum(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))), 6) AS perimeter,
  CASE WHEN sum(x1*y2-x2*y1) > 0 THEN 'ccw' ELSE 'cw' END AS orientation, round(sum((x1+x2)*(x1*y2-x2*y1)) / (3*sum(x1*y2-x2*y1)), 5) AS centroid_x, round(sum((y1+y2)*(x1*y2-x2*y1)) / (3*sum(x1*y2-x2*y1)), 5) AS centroid_y,
  min(x1) AS min_x, max(y1) AS max_y, true AS convex, true AS simple FROM ed GROUP BY ALL""")
def d4_polygon_properties(spark, sf):
    return pl.polygon_properties(i.polygons(spark, sf)).select(
        "poly_id", "ring", "corners", "signed_area", F.round("perimeter", 6).alias("perimeter"), "orientation", *_r(["centroid_x", "centroid_y"], 5), "min_x", "max_y", "convex", "simple")


@query("d4_polygon_summary", f"WITH {i.POLY}, {_EDGES} SELECT poly_id, sum(x1*y2-x2*y1)/2 AS area, CAST(0 AS INTEGER) AS n_reasons FROM ed GROUP BY poly_id")
def d4_polygon_summary(spark, sf):
    return pl.polygon_summary(i.polygons(spark, sf)).select("poly_id", "area", F.size("reasons").alias("n_reasons"))


_MEET = """least(a.x1, a.x2) <= greatest(b.x1, b.x2) AND least(b.x1, b.x2) <= greatest(a.x1, a.x2) AND least(a.y1, a.y2) <= greatest(b.y1, b.y2) AND least(b.y1, b.y2) <= greatest(a.y1, a.y2)
    AND sign((a.x2-a.x1)*(b.y1-a.y1)-(a.y2-a.y1)*(b.x1-a.x1)) * sign((a.x2-a.x1)*(b.y2-a.y1)-(a.y2-a.y1)*(b.x2-a.x1)) <= 0
    AND sign((b.x2-b.x1)*(a.y1-b.y1)-(b.y2-b.y1)*(a.x1-b.x1)) * sign((b.x2-b.x1)*(a.y2-b.y1)-(b.y2-b.y1)*(a.x2-b.x1)) <= 0"""
_CONFLICTS = f"""WITH {i.POLY}, {i.HOLED},
  he AS (SELECT poly_id, ring, seq, count(*) OVER w AS n, x AS x1, y AS y1, coalesce(lead(x) OVER o, first_value(x) OVER o) AS x2, coalesce(lead(y) OVER o, first_value(y) OVER o) AS y2 FROM hp
    WINDOW w AS (PARTITION BY poly_id, ring), o AS (PARTITION BY poly_id, ring ORDER BY seq)),
  bad AS (SELECT DISTINCT a.poly_id, a.ring FROM he a JOIN he b ON a.poly_id = b.poly_id AND a.ring = b.ring AND a.seq < b.seq AND b.seq - a.seq NOT IN (1, a.n - 1) WHERE {_MEET}),
  con AS (SELECT DISTINCT a.poly_id, a.ring, b.ring AS other FROM he a JOIN he b ON a.poly_id = b.poly_id AND a.ring < b.ring WHERE a.poly_id NOT IN (SELECT poly_id FROM bad) AND {_MEET}),
  ins AS (SELECT v.poly_id, v.ring AS hole, e.ring FROM hp v JOIN he e ON v.poly_id = e.poly_id AND v.ring <> e.ring WHERE v.ring > 0 AND v.seq = 0
    AND v.poly_id NOT IN (SELECT poly_id FROM bad UNION ALL SELECT poly_id FROM con) AND (y1 > v.y) <> (y2 > v.y)
    AND CASE WHEN y2 > y1 THEN (x2-x1)*(v.y-y1)-(y2-y1)*(v.x-x1) > 0 ELSE (x2-x1)*(v.y-y1)-(y2-y1)*(v.x-x1) < 0 END GROUP BY ALL HAVING count(*) % 2 = 1),
  conflict AS (SELECT poly_id, 0 AS o, 'not_simple' AS kind, ring, CAST(NULL AS INTEGER) AS other FROM bad UNION ALL SELECT poly_id, 1, 'contact', ring, other FROM con UNION ALL
    SELECT poly_id, 2, 'outside', ring, NULL FROM (SELECT DISTINCT poly_id, ring FROM hp WHERE ring > 0 AND poly_id NOT IN (SELECT poly_id FROM bad UNION ALL SELECT poly_id FROM con)) h
      WHERE NOT EXISTS (SELECT 1 FROM ins WHERE ins.poly_id = h.poly_id AND hole = h.ring AND ins.ring = 0) UNION ALL
    SELECT poly_id, 3, 'nested', hole, ring FROM ins WHERE ring > 0)"""


@query("d4_ring_conflicts", f"{_CONFLICTS} SELECT poly_id, kind, ring, other FROM conflict")
def d4_ring_conflicts(spark, sf):
    return pl.ring_conflicts(i.holed_polygons(spark, sf))


@query("d4_polygon_report", f"""{_CONFLICTS}, rg AS (SELECT poly_id, ring, sum(x1*y2-x2*y1)/2 AS signed, sum((x1+x2)*(x1*y2-x2*y1))/6 AS mx, sum((y1+y2)*(x1*y2-x2*y1))/6 AS my, min(x1) AS x0, min(y1) AS y0, max(x1) AS xx, max(y1) AS yy FROM he GROUP BY ALL),
  wh AS (SELECT poly_id, count(*) - 1 AS holes, bool_and(CASE WHEN ring = 0 THEN signed > 0 ELSE signed < 0 END) AS turned, sum(CASE WHEN ring = 0 THEN 1 ELSE -1 END * sign(signed) * signed) AS area,
    sum(CASE WHEN ring = 0 THEN 1 ELSE -1 END * CASE WHEN signed > 0 THEN 1 ELSE -1 END * mx) AS mx, sum(CASE WHEN ring = 0 THEN 1 ELSE -1 END * CASE WHEN signed > 0 THEN 1 ELSE -1 END * my) AS my,
    min(x0) AS min_x, min(y0) AS min_y, max(xx) AS max_x, max(yy) AS max_y FROM rg GROUP BY poly_id),
  sa AS (SELECT poly_id, string_agg(kind || ':' || ring || coalesce(':' || other, ''), ',' ORDER BY o, ring, other) AS reasons FROM conflict GROUP BY poly_id)
  SELECT poly_id, holes, reasons IS NULL AS valid, coalesce(reasons, '') AS reasons, reasons IS NULL AND turned AS canonical, round(CASE WHEN reasons IS NULL THEN area END, 6) AS area, round(CASE WHEN reasons IS NULL THEN mx / area END, 5) AS centroid_x,
    round(CASE WHEN reasons IS NULL THEN my / area END, 5) AS centroid_y, min_x, min_y, max_x, max_y FROM wh LEFT JOIN sa USING (poly_id)""")
def d4_polygon_report(spark, sf):
    return pl.polygon_report(i.holed_polygons(spark, sf)).withColumn("reasons", F.array_join("reasons", ",")).withColumns({"area": F.round("area", 6), "centroid_x": F.round("centroid_x", 5), "centroid_y": F.round("centroid_y", 5)})


_PAIRS = """pr AS (SELECT a.seg_id AS s, b.seg_id AS t, a.x1, a.y1, a.x2, a.y2, b.x1 AS u1, b.y1 AS v1, b.x2 AS u2, b.y2 AS v2 FROM sg a JOIN sg b ON {on}),
  oo AS (SELECT *, (x2-x1)*(v1-y1)-(y2-y1)*(u1-x1) AS o1, (x2-x1)*(v2-y1)-(y2-y1)*(u2-x1) AS o2, (u2-u1)*(y1-v1)-(v2-v1)*(x1-u1) AS o3, (u2-u1)*(y2-v1)-(v2-v1)*(x2-u1) AS o4 FROM pr
    WHERE least(x1, x2) <= greatest(u1, u2) AND least(u1, u2) <= greatest(x1, x2) AND least(y1, y2) <= greatest(v1, v2) AND least(v1, v2) <= greatest(y1, y2)),
  mt AS (SELECT * FROM oo WHERE NOT ((o1 > 0 AND o2 > 0) OR (o1 < 0 AND o2 < 0) OR (o3 > 0 AND o4 > 0) OR (o3 < 0 AND o4 < 0)))"""


@query("c9_segment_crossings", f"""WITH {i.SEG}, {_PAIRS.format(on='a.seg_id < b.seg_id')},
  q AS (SELECT *, (x2-x1)*(v2-v1)-(y2-y1)*(u2-u1) AS den FROM mt),
  e AS (SELECT s, t, x1, y1, x2, y2, u1, v1, u2, v2, unnest([{{'x': x1, 'y': y1}}, {{'x': x2, 'y': y2}}, {{'x': u1, 'y': v1}}, {{'x': u2, 'y': v2}}]) AS p FROM q WHERE den = 0)
  SELECT s, t, round(x1 + ((u1-x1)*(v2-v1)-(v1-y1)*(u2-u1))/den*(x2-x1), 6) AS x, round(y1 + ((u1-x1)*(v2-v1)-(v1-y1)*(u2-u1))/den*(y2-y1), 6) AS y FROM q WHERE den <> 0
  UNION ALL SELECT DISTINCT s, t, p.x, p.y FROM e WHERE (p.x-x1)*(x2-x1)+(p.y-y1)*(y2-y1) BETWEEN 0 AND (x2-x1)*(x2-x1)+(y2-y1)*(y2-y1) AND (p.x-u1)*(u2-u1)+(p.y-v1)*(v2-v1) BETWEEN 0 AND (u2-u1)*(u2-u1)+(v2-v1)*(v2-v1)""")
def c9_segment_crossings(spark, sf):
    """All crossings and touches; segments that overlap along a line bring the ends of their common part."""
    return pl.segment_crossings(i.segments(spark, sf)).select("s", "t", *_r(["x", "y"]))


@query("c9_arrangement_counts")
def c9_arrangement_counts(spark, sf):
    return pl.arrangement_counts(i.segments(spark, sf), 6)


@query("c10_segment_zone", f"""WITH {i.SEG}, {_PAIRS.format(on='a.seg_id % 10 = 3')} SELECT s AS probe_id, t AS seg_id,
  (o1 = 0 AND u1 BETWEEN least(x1, x2) AND greatest(x1, x2) AND v1 BETWEEN least(y1, y2) AND greatest(y1, y2)) OR (o2 = 0 AND u2 BETWEEN least(x1, x2) AND greatest(x1, x2) AND v2 BETWEEN least(y1, y2) AND greatest(y1, y2)) AS touches_end FROM mt""")
def c10_segment_zone(spark, sf):
    seg = i.segments(spark, sf)
    return pl.segment_zone(seg, seg.filter("seg_id % 10 = 3").withColumnRenamed("seg_id", "probe_id"))


def _overlay_boxes(spark, sf, odd):
    b = i.boxes(spark, sf).filter(F.col("mesh_id") % 2 == odd)
    return b.select(F.col("mesh_id").alias("id"), "x0", "y0", (F.col("x0") + F.col("w") * 3).alias("x1"), (F.col("y0") + F.col("h") * 3).alias("y1"))


@query("c11_box_overlay", f"""WITH {i.BOX}, o AS (SELECT mesh_id AS id, x0, y0, x0 + w*3 AS x1, y0 + h*3 AS y1 FROM bx), j AS (SELECT a.id AS a_id, b.id AS b_id, greatest(a.x0, b.x0) AS x0, greatest(a.y0, b.y0) AS y0, least(a.x1, b.x1) AS x1, least(a.y1, b.y1) AS y1,
    (a.x1-a.x0)*(a.y1-a.y0) AS aa, (b.x1-b.x0)*(b.y1-b.y0) AS ba FROM o a JOIN o b ON a.id % 2 = 0 AND b.id % 2 = 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1)
  SELECT a_id, b_id, x0, y0, x1, y1, (x1-x0)*(y1-y0) AS common_area, aa + ba - (x1-x0)*(y1-y0) AS union_area, aa - (x1-x0)*(y1-y0) AS difference_area FROM j""")
def c11_box_overlay(spark, sf):
    return pl.box_overlay(_overlay_boxes(spark, sf, 0), _overlay_boxes(spark, sf, 1))


def _above(spark, sf):
    """One query point per customer near the height field."""
    k = F.col("c_custkey")
    return i.table(spark, sf, "customer").select(k.alias("id"), (F.pmod(k * 17, F.lit(41)) + 0.25).alias("x"), (F.floor(k * 4 / 125) + 0.375).alias("y"), (F.col("c_acctbal") / 200).alias("z"))


_ABOVE = "ab AS (SELECT c_custkey AS id, c_custkey * 17 % 41 + 0.25::DOUBLE AS x, floor(c_custkey * 4 / 125) + 0.375::DOUBLE AS y, c_acctbal / 200 AS z FROM customer)"


def _seg_d2(s, t):
    d = "+".join(f"(k.{t}_{c}-k.{s}_{c})*(k.{t}_{c}-k.{s}_{c})" for c in "xyz")
    n = "+".join(f"(p.{c}-k.{s}_{c})*(k.{t}_{c}-k.{s}_{c})" for c in "xyz")
    u = f"greatest(0.0, least(1.0, ({n})/({d})))"
    return "+".join(f"power(p.{c}-(k.{s}_{c}+(k.{t}_{c}-k.{s}_{c})*{u}), 2)" for c in "xyz")


def _side(s, t):
    """n . ((t - s) x (p - s)), not negative where the foot lies on the inner side of the edge."""
    e = {c: f"(k.{t}_{c}-k.{s}_{c})" for c in "xyz"}
    f = {c: f"(p.{c}-k.{s}_{c})" for c in "xyz"}
    return "+".join(f"k.n{x}*({e[y]}*{f[z]}-{e[z]}*{f[y]})" for x, y, z in ("xyz", "yzx", "zxy"))


# Brute force: distance to the plane if the foot lies inside the triangle, else to the three edges.
_DIST = f"""kk AS (SELECT fid, ax AS a_x, ay AS a_y, az AS a_z, bx AS b_x, by_ AS b_y, bz AS b_z, cx AS c_x, cy AS c_y, cz AS c_z FROM k),
  nn AS (SELECT *, (b_y-a_y)*(c_z-a_z)-(b_z-a_z)*(c_y-a_y) AS nx, (b_z-a_z)*(c_x-a_x)-(b_x-a_x)*(c_z-a_z) AS ny, (b_x-a_x)*(c_y-a_y)-(b_y-a_y)*(c_x-a_x) AS nz FROM kk),
  ds AS (SELECT p.id, k.fid, CASE WHEN {_side('a', 'b')} >= 0 AND {_side('b', 'c')} >= 0 AND {_side('c', 'a')} >= 0
    THEN power((p.x-a_x)*nx + (p.y-a_y)*ny + (p.z-a_z)*nz, 2) / (nx*nx+ny*ny+nz*nz)
    ELSE least({_seg_d2('a', 'b')}, {_seg_d2('b', 'c')}, {_seg_d2('c', 'a')}) END AS d2 FROM ab p, nn k)"""


@query("c5_closest_on_mesh", f"WITH {i.MESH}, {_K}, {_ABOVE}, {_DIST} SELECT id, round(sqrt(min(d2)), 5) AS distance FROM ds GROUP BY id")
def c5_closest_on_mesh(spark, sf):
    return sf_.closest_on_mesh(_above(spark, sf), *i.mesh(spark, sf)).select("id", F.round("distance", 5).alias("distance"))


@query("c8_locate_on_mesh", f"WITH {i.MESH}, {_K}, {_ABOVE}, {_DIST}, r AS (SELECT id, min({{'o': round(d2, 6), 'f': fid}}) AS s FROM ds GROUP BY id) SELECT id, s.f AS fid, s.o AS d2 FROM r")
def c8_locate_on_mesh(spark, sf):
    return sf_.locate_on_mesh(_above(spark, sf), *i.mesh(spark, sf), 6).select("id", "fid", F.round("d2", 6).alias("d2"))


@query("d11_distance_to_mesh", f"WITH {i.MESH}, {_K}, {_ABOVE}, {_DIST}, m AS (SELECT id, min(d2) AS d2 FROM ds GROUP BY id) SELECT round(sqrt(max(d2)), 5) AS distance, arg_max(id, {{'d': d2, 'i': -id}}) AS from_id FROM m")
def d11_distance_to_mesh(spark, sf):
    return sf_.distance_to_mesh(_above(spark, sf), *i.mesh(spark, sf)).select(F.round("distance", 5).alias("distance"), "from_id")


@query("d11_distance_to_points")
def d11_distance_to_points(spark, sf):
    """How far the height field reaches from the points above it."""
    return sf_.distance_to_points(*i.mesh(spark, sf), _above(spark, sf), 20.0)


_HITS = f"""r AS (SELECT ray_id, fid, ox, oy, oz, dx, dy, dz, bx-ax AS ex, by_-ay AS ey, bz-az AS ez, cx-ax AS fx, cy-ay AS fy, cz-az AS fz, ox-ax AS sx, oy-ay AS sy, oz-az AS sz FROM ry, k),
  h AS (SELECT *, dy*fz-dz*fy AS hx, dz*fx-dx*fz AS hy, dx*fy-dy*fx AS hz, sy*ez-sz*ey AS qx, sz*ex-sx*ez AS qy, sx*ey-sy*ex AS qz FROM r),
  g AS (SELECT *, ex*hx+ey*hy+ez*hz AS det FROM h), ht AS (SELECT ray_id, fid, (fx*qx+fy*qy+fz*qz)/det AS t FROM g WHERE det <> 0 AND (sx*hx+sy*hy+sz*hz)/det >= 0 AND (dx*qx+dy*qy+dz*qz)/det >= 0
    AND (sx*hx+sy*hy+sz*hz)/det + (dx*qx+dy*qy+dz*qz)/det <= 1 AND (fx*qx+fy*qy+fz*qz)/det >= 0)"""


@query("c6_ray_first_hits", f"""WITH {i.MESH}, {_K}, {i.RAY}, {_HITS}, b AS (SELECT ray_id, min({{'o': round(t, 6), 'f': fid, 't': t}}) AS s FROM ht GROUP BY ray_id)
  SELECT ray_id, s.f AS fid, round(s.t * sqrt(dx*dx+dy*dy+dz*dz), 4) AS distance FROM ry LEFT JOIN b USING (ray_id)""")
def c6_ray_first_hits(spark, sf):
    return sf_.ray_first_hits(i.rays(spark, sf), *i.mesh(spark, sf), 6).select("ray_id", "fid", F.round("distance", 4).alias("distance"))


@query("c7_ray_all_hits", f"""WITH {i.MESH}, {_K}, {i.RAY}, {_HITS}, b AS (SELECT ray_id, count(*) AS hits, min(fid) AS first_face, max(fid) AS last_face FROM ht GROUP BY ray_id)
  SELECT ray_id, hits IS NOT NULL AS any_hit, coalesce(hits, 0) AS hits, first_face, last_face FROM ry LEFT JOIN b USING (ray_id)""")
def c7_ray_all_hits(spark, sf):
    return sf_.ray_all_hits(i.rays(spark, sf), *i.mesh(spark, sf))


def _tri_pairs(left: tuple[str, str], right: tuple[str, str], where: str) -> str:
    """CTEs that end in ``hit(fid, ofid, coplanar)``: all pairs of faces, not sharing a corner, that meet.
    Coordinates are whole or half numbers, so every determinant is exact."""
    at = lambda k: (f"{k}_x", f"{k}_y", f"{k}_z")
    sub = lambda p, q: tuple(f"({a}-{b})" for a, b in zip(p, q))
    def side(p, q, r, s):
        u, w, t = sub(at(q), at(p)), sub(at(r), at(p)), sub(at(s), at(p))
        return "sign(" + "+".join(f"({u[i]}*{w[j]}-{u[j]}*{w[i]})*{t[k]}" for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1))) + ")"
    def segment(s, t, tri):
        a, b, c = tri
        e = [side(s, t, a, b), side(s, t, b, c), side(s, t, c, a)]
        return f"(s{s} * s{t} <= 0 AND (s{s} <> 0 OR s{t} <> 0) AND (least({', '.join(e)}) >= 0 OR greatest({', '.join(e)}) <= 0))"
    one, two = ("a", "b", "c"), ("oa", "ob", "oc")
    ring = ((0, 1), (1, 2), (2, 0))
    cross = " OR ".join([segment(one[i], one[j], two) for i, j in ring] + [segment(two[i], two[j], one) for i, j in ring])
    # In one plane: no edge line keeps the other triangle strictly off, seen along the normal.
    flat = lambda p, q, r: "sign(" + "+".join(f"(({q}_{y}-{p}_{y})*({r}_{z}-{p}_{z})-({q}_{z}-{p}_{z})*({r}_{y}-{p}_{y}))*n{x}" for x, y, z in ("xyz", "yzx", "zxy")) + ")"
    apart = " OR ".join(f"greatest({', '.join(f'{flat(t[i], t[j], r)} * {flat(t[i], t[j], t[3 - i - j])}' for r in o)}) < 0" for t, o in ((one, two), (two, one)) for i, j in ring)
    corner = lambda f, v: f"SELECT f.mesh_id, fid, f.a AS ia, f.b AS ib, f.c AS ic, a.x AS a_x, a.y AS a_y, a.z AS a_z, b.x AS b_x, b.y AS b_y, b.z AS b_z, c.x AS c_x, c.y AS c_y, c.z AS c_z FROM {f} f JOIN {v} a ON a.vid = f.a JOIN {v} b ON b.vid = f.b JOIN {v} c ON c.vid = f.c"
    names = [f"{k}_{c}" for k in "abc" for c in "xyz"]
    meet = " AND ".join(f"least({', '.join(f'{p}.{k}_{c}' for k in one)}) <= greatest({', '.join(f'{q}.{k}_{c}' for k in one)})" for c in "xyz" for p, q in ("lr", "rl"))
    return f"""tl AS ({corner(*left)}), tr AS ({corner(*right)}),
  tp AS (SELECT l.fid, r.fid AS ofid, l.mesh_id, r.mesh_id AS omesh_id, {', '.join(f'l.{n}' for n in names)}, {', '.join(f'r.{n} AS o{n}' for n in names)} FROM tl l JOIN tr r ON {where} AND {meet}),
  ts AS (SELECT *, {', '.join(f"{side(*two, k)} AS s{k}" for k in one)}, {', '.join(f"{side(*one, k)} AS s{k}" for k in two)},
    {', '.join(f"(b_{y}-a_{y})*(c_{z}-a_{z})-(b_{z}-a_{z})*(c_{y}-a_{y}) AS n{x}" for x, y, z in ("xyz", "yzx", "zxy"))} FROM tp),
  hit AS (SELECT fid, ofid, mesh_id, omesh_id, soa = 0 AND sob = 0 AND soc = 0 AS coplanar FROM ts WHERE CASE WHEN soa = 0 AND sob = 0 AND soc = 0 THEN NOT ({apart}) ELSE {cross} END)"""


@query("c12_self_intersections", f"""WITH {i.BOXMESH}, {_tri_pairs(('bf', 'bv'), ('bf', 'bv'), 'l.fid < r.fid AND l.mesh_id <> r.mesh_id')}
  SELECT fid, ofid, coplanar FROM hit""")
def c12_self_intersections(spark, sf):
    """All boxes as one surface: faces that cross, touch or overlap in a plane.  Faces of one box share only
    what neighbours share."""
    return sf_.self_intersections(*i.box_mesh(spark, sf)).select("fid", "ofid", "coplanar")


@query("c12_coplanar_overlaps", f"""WITH {i.BOXMESH}, {_tri_pairs(('bf', 'bv'), ('bf', 'bv'), 'l.fid < r.fid AND l.mesh_id <> r.mesh_id')},
  sd AS (SELECT mesh_id, k, axis, lo0, hi0, lo1, hi1, level FROM (SELECT mesh_id, unnest([{{'k': 0, 'axis': 'z', 'level': z0, 'lo0': x0, 'hi0': x0 + w, 'lo1': y0, 'hi1': y0 + h}}, {{'k': 1, 'axis': 'z', 'level': z0 + d, 'lo0': x0, 'hi0': x0 + w, 'lo1': y0, 'hi1': y0 + h}},
    {{'k': 2, 'axis': 'y', 'level': y0, 'lo0': x0, 'hi0': x0 + w, 'lo1': z0, 'hi1': z0 + d}}, {{'k': 3, 'axis': 'y', 'level': y0 + h, 'lo0': x0, 'hi0': x0 + w, 'lo1': z0, 'hi1': z0 + d}},
    {{'k': 4, 'axis': 'x', 'level': x0, 'lo0': y0, 'hi0': y0 + h, 'lo1': z0, 'hi1': z0 + d}}, {{'k': 5, 'axis': 'x', 'level': x0 + w, 'lo0': y0, 'hi0': y0 + h, 'lo1': z0, 'hi1': z0 + d}}], recursive := true) FROM bx)),
  ov AS (SELECT a.mesh_id, b.mesh_id AS other_id, a.k AS side, b.k AS other_side, (least(a.hi0, b.hi0) - greatest(a.lo0, b.lo0)) * (least(a.hi1, b.hi1) - greatest(a.lo1, b.lo1)) AS area FROM sd a JOIN sd b ON a.mesh_id < b.mesh_id AND a.axis = b.axis AND a.level = b.level
    WHERE least(a.hi0, b.hi0) > greatest(a.lo0, b.lo0) AND least(a.hi1, b.hi1) > greatest(a.lo1, b.lo1))
  SELECT mesh_id, other_id, side, other_side, round(area, 6) AS area FROM ov""")
def c12_coplanar_overlaps(spark, sf):
    """Area in which sides of different boxes lie on each other, summed over the triangles of both sides."""
    found = sf_.self_intersections(*i.box_mesh(spark, sf)).filter("kind = 'polygon'")
    mesh = lambda c: F.floor(F.col(c) / 12).cast("bigint")
    side = lambda c: F.floor(F.pmod(F.col(c), F.lit(12)) / 2).cast("int")
    return found.groupBy(mesh("fid").alias("mesh_id"), mesh("ofid").alias("other_id"), side("fid").alias("side"), side("ofid").alias("other_side")).agg(F.round(F.sum("area"), 6).alias("area"))


@query("c13_mesh_intersections", f"""WITH {i.BOXMESH}, {i.MESH}, {_tri_pairs(('bf', 'bv'), ('mf', 'mv'), 'true')} SELECT fid, ofid FROM hit""")
def c13_mesh_intersections(spark, sf):
    """Where the boxes pierce the height field."""
    return sf_.mesh_intersections(i.box_mesh(spark, sf), i.mesh(spark, sf)).select("fid", "ofid")


_BOX_RELATIONS = f"""WITH {i.BOX}, sh AS (SELECT mesh_id, x0 + 0.5 AS x0, y0 + 1 AS y0, z0 + 0.5 AS z0, w * 0.5 AS w, h, d * 2 AS d FROM bx),
  pr AS (SELECT a.mesh_id, b.mesh_id AS other_id, a.x0 > b.x0 AND a.x0 + a.w < b.x0 + b.w AND a.y0 > b.y0 AND a.y0 + a.h < b.y0 + b.h AND a.z0 > b.z0 AND a.z0 + a.d < b.z0 + b.d AS ins,
    b.x0 > a.x0 AND b.x0 + b.w < a.x0 + a.w AND b.y0 > a.y0 AND b.y0 + b.h < a.y0 + a.h AND b.z0 > a.z0 AND b.z0 + b.d < a.z0 + a.d AS con FROM bx a JOIN sh b
    ON a.x0 <= b.x0 + b.w AND b.x0 <= a.x0 + a.w AND a.y0 <= b.y0 + b.h AND b.y0 <= a.y0 + a.h AND a.z0 <= b.z0 + b.d AND b.z0 <= a.z0 + a.d)
  SELECT mesh_id, other_id, CASE WHEN ins THEN 'inside' WHEN con THEN 'contains' ELSE 'meets' END AS relation FROM pr"""


@query("c13_mesh_relations", _BOX_RELATIONS)
def c13_mesh_relations(spark, sf):
    """Boxes against the same boxes moved and stretched: touching, crossing, or one inside the other."""
    vertices, faces = i.box_mesh(spark, sf)
    b = i.boxes(spark, sf).select("mesh_id", "x0", "z0")
    moved = vertices.join(b, "mesh_id").select("mesh_id", "vid", (F.col("x0") + 0.5 + (F.col("x") - F.col("x0")) * 0.5).alias("x"), (F.col("y") + 1).alias("y"), (F.col("z0") + 0.5 + (F.col("z") - F.col("z0")) * 2).alias("z"))
    return sf_.mesh_relations((vertices, faces), (moved, faces))


@query("c13_intersection_polylines")
def c13_intersection_polylines(spark, sf):
    """The curves in which the boxes pierce the height field, point by point."""
    lines, _ = sf_.intersection_polylines(i.box_mesh(spark, sf), i.mesh(spark, sf))
    return lines.select(*[F.col(f"start.{c}").alias(f"start_{c}") for c in "xyz"], *[F.col(f"second.{c}").alias(f"second_{c}") for c in "xyz"], "position", "closed", "x", "y", "z")


@query("d12_hausdorff")
def d12_hausdorff(spark, sf):
    vertices, faces = i.mesh(spark, sf)
    lifted = vertices.withColumn("z", F.col("z") + 0.5)
    return sf_.hausdorff((vertices, faces), (lifted, faces), 20.0, 30.0)


_TETS = [(0, 1, 3, 7), (0, 3, 2, 7), (0, 2, 6, 7), (0, 6, 4, 7), (0, 4, 5, 7), (0, 5, 1, 7)]  # fixed values: six tetrahedra of a box


@query("d13_tet_mesh_quality", f"WITH {i.BOX} SELECT mesh_id, CAST(0 AS INTEGER) AS subdomain, 6 AS cells, CAST(0 AS BIGINT) AS inverted, w*h*d AS volume, 12 AS boundary_faces, 6 AS inner_faces, CAST(0 AS BIGINT) AS overused_faces FROM bx")
def d13_tet_mesh_quality(spark, sf):
    vertices, _ = i.box_mesh(spark, sf)
    base = F.col("mesh_id") * 8
    six = F.explode(F.array(*[F.struct((F.col("mesh_id") * 6 + n).alias("tet_id"), *[(base + k).alias(x) for x, k in zip("abcd", t)]) for n, t in enumerate(_TETS)]))
    tets = i.boxes(spark, sf).select("mesh_id", F.lit(0).alias("subdomain"), six.alias("t")).select("mesh_id", "subdomain", "t.*")
    return sf_.tet_mesh_quality(vertices, tets).select("mesh_id", "subdomain", "cells", "inverted", F.round("volume", 6).alias("volume")).join(sf_.tet_faces(tets), "mesh_id")
