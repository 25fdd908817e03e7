"""Predicates, constructions, intersections and distances over a table of primitives and a table of
queries that name one to four of them.

``primitives``: ``id, kind, coords array<double>`` (points one after the other; circles and spheres
end in the squared radius); ``queries``: ``id, query, arguments array<string>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as v


def _pt(array: str | Column, index: int, d: int) -> v.Vec:
    a = F.col(array) if isinstance(array, str) else array
    return tuple(F.get(a, index * d + k) for k in range(d))


def construct_primitives(primitives: DataFrame) -> DataFrame:
    """``measure`` (squared length, area, volume, squared radius), the plane ``coefficients`` and
    whether the primitive is degenerate, by kind."""
    p2, p3 = [_pt("coords", i, 2) for i in range(3)], [_pt("coords", i, 3) for i in range(4)]
    kind = F.col("kind")
    normal = v.cross(v.sub(p3[1], p3[0]), v.sub(p3[2], p3[0]))
    tetra = v.orient3(*p3) / 6
    measure = (
        F.when(kind == "Vector_2", v.norm2(p2[0])).when(kind.isin("Segment_2", "Line_2", "Ray_2"), v.dist2(p2[0], p2[1]))
        .when(kind == "Triangle_2", v.orient2(*p2) / 2).when(kind == "Circle_2", F.get("coords", 2))
        .when(kind == "Iso_rectangle_2", F.abs((p2[1][0] - p2[0][0]) * (p2[1][1] - p2[0][1])))
        .when(kind == "Aff_transformation_2", F.get("coords", 0) * F.get("coords", 4) - F.get("coords", 1) * F.get("coords", 3))
        .when(kind == "Vector_3", v.norm2(p3[0])).when(kind.isin("Segment_3", "Line_3", "Ray_3"), v.dist2(p3[0], p3[1]))
        .when(kind.isin("Plane_3", "Triangle_3"), v.norm2(normal) / 4).when(kind == "Tetrahedron_3", tetra).when(kind == "Sphere_3", F.get("coords", 3))
        .when(kind == "Iso_cuboid_3", F.abs((p3[1][0] - p3[0][0]) * (p3[1][1] - p3[0][1]) * (p3[1][2] - p3[0][2]))))
    plane = F.when(kind == "Plane_3", F.array(*normal, -v.dot(normal, p3[0])))
    degenerate = F.when(kind.isin("Point_2", "Point_3", "Aff_transformation_3"), False).otherwise(F.col("measure") == 0)
    return primitives.withColumn("measure", measure).withColumn("coefficients", plane).withColumn("degenerate", degenerate)


def _bound(primitives: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries with the kinds and coordinates of their arguments in order."""
    args = queries.select("id", "query", F.posexplode("arguments").alias("pos", "arg"))
    joined = args.join(primitives.select(F.col("id").alias("arg"), "kind", "coords"), "arg")
    packed = joined.groupBy("id", "query").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "coords"))).alias("_a"))  # at most four entries
    return packed.select("id", "query", F.transform("_a", lambda s: s["kind"]).alias("kinds"), F.transform("_a", lambda s: s["coords"]).alias("args"))


def _point(i: int, d: int) -> v.Vec:
    return tuple(F.get(F.get("args", i), k) for k in range(d))


def evaluate_predicates(primitives: DataFrame, queries: DataFrame) -> DataFrame:
    """``id, query, sign, truth, point``: orientation, collinear, coplanar, turns, midpoint, centroid,
    circumcentre of points of one dimension."""
    q = _bound(primitives, queries).withColumn("d", F.when(F.get("kinds", 0) == "Point_3", 3).otherwise(2)).withColumn("n", F.size("args"))
    a2, b2, c2 = (_point(i, 2) for i in range(3))
    a3, b3, c3, d3 = (_point(i, 3) for i in range(4))
    flat, solid = v.orient2(a2, b2, c2), v.orient3(a3, b3, c3, d3)
    normal = v.norm2(v.cross(v.sub(b3, a3), v.sub(c3, a3)))
    det = F.when(F.col("d") == 2, flat).when(F.col("n") == 4, solid)
    name = F.col("query")
    truth = (
        F.when(name == "collinear", F.when(F.col("d") == 2, flat == 0).otherwise(normal == 0)).when(name == "coplanar", solid == 0)
        .when(name == "left_turn", flat > 0).when(name == "right_turn", flat < 0))
    mid = F.when(F.col("d") == 2, F.array(*[(x + y) / 2 for x, y in zip(a2, b2)])).otherwise(F.array(*[(x + y) / 2 for x, y in zip(a3, b3)]))
    mean = lambda *p: F.array(*[sum(x[1:], x[0]) / len(x) for x in zip(*p)])
    centroid = F.when(F.col("d") == 2, mean(a2, b2, c2)).when(F.col("n") == 3, mean(a3, b3, c3)).otherwise(mean(a3, b3, c3, d3))
    u, w = v.sub(b2, a2), v.sub(c2, a2)
    den = v.cross2(u, w) * 2
    circum = F.when((F.col("d") == 2) & (den != 0), F.array(
        a2[0] + F.try_divide(w[1] * v.norm2(u) - u[1] * v.norm2(w), den), a2[1] + F.try_divide(u[0] * v.norm2(w) - w[0] * v.norm2(u), den)))
    point = F.when(name == "midpoint", mid).when(name == "centroid", centroid).when(name == "circumcenter", circum)
    return q.select("id", "query", F.when(name == "orientation", F.signum(det).cast("int")).alias("sign"), truth.alias("truth"), point.alias("point"))


def evaluate_intersections(primitives: DataFrame, queries: DataFrame) -> DataFrame:
    """``id, query, meets, result, point, reason`` for segment and line pairs in the plane, and lines,
    segments, rays, planes and triangles against planes and triangles in space.  ``result`` is empty,
    point, segment, ray, line or plane; other pairs, and lines within the plane of a triangle, are refused with a reason."""
    q = _bound(primitives, queries)
    k0, k1 = F.get("kinds", 0), F.get("kinds", 1)
    swap = k0.isin("Plane_3", "Triangle_3") & ~k1.isin("Plane_3", "Triangle_3")
    q = q.select("id", "query", F.when(swap, k1).otherwise(k0).alias("k0"), F.when(swap, k0).otherwise(k1).alias("k1"),
                 F.when(swap, F.get("args", 1)).otherwise(F.get("args", 0)).alias("x"), F.when(swap, F.get("args", 0)).otherwise(F.get("args", 1)).alias("y"))
    a, b, c, d = _pt("x", 0, 2), _pt("x", 1, 2), _pt("y", 0, 2), _pt("y", 1, 2)
    u, w, r = v.sub(b, a), v.sub(d, c), v.sub(c, a)
    den = v.cross2(u, w)
    s, t = F.try_divide(v.cross2(r, w), den), F.try_divide(v.cross2(r, u), den)
    same = v.cross2(r, u) == 0
    along = lambda p: F.try_divide(v.dot(v.sub(p, a), u), v.norm2(u))
    lo, hi = F.greatest(F.lit(0.0), F.least(along(c), along(d))), F.least(F.lit(1.0), F.greatest(along(c), along(d)))
    overlap = F.when(~same | (lo > hi), "empty").when(lo == hi, "point").otherwise("segment")
    flat = F.when(F.col("k0") == "Line_2", F.when(den != 0, "point").when(same, "line").otherwise("empty")).otherwise(
        F.when(den != 0, F.when(s.between(0, 1) & t.between(0, 1), "point").otherwise("empty")).otherwise(overlap))
    # A segment without length is a point, which the other one holds or does not.
    back = v.sub(a, c)
    held = (v.cross2(w, back) == 0) & v.dot(back, w).between(F.lit(0.0), v.norm2(w)) & ((v.norm2(w) > 0) | (v.norm2(back) == 0))
    alone = (F.col("k0") == "Segment_2") & (v.norm2(u) == 0)
    flat = F.when(alone, F.when(held, "point").otherwise("empty")).otherwise(flat)
    at = F.when(alone, 0.0).when(den != 0, s).otherwise(lo)
    p3, q3 = [_pt("x", i, 3) for i in range(3)], [_pt("y", i, 3) for i in range(3)]
    n = v.cross(v.sub(q3[1], q3[0]), v.sub(q3[2], q3[0]))
    e = v.sub(p3[1], p3[0])
    slope, gap = v.dot(n, e), v.dot(n, v.sub(q3[0], p3[0]))
    where = F.try_divide(gap, slope)
    # On the carrier: a line has all of it, a ray the part from 0, a segment that from 0 to 1.
    reached = (F.col("k0") == "Line_3") | ((F.col("k0") == "Ray_3") & (where >= 0)) | where.between(0, 1)
    hit = tuple(x + where * y for x, y in zip(p3[0], e))
    turn = [v.dot(v.cross(v.sub(q3[(i + 1) % 3], q3[i]), v.sub(hit, q3[i])), n) for i in range(3)]
    covered = (F.col("k1") != "Triangle_3") | ((turn[0] >= 0) & (turn[1] >= 0) & (turn[2] >= 0))
    carrier = F.when(F.col("k0") == "Line_3", "line").when(F.col("k0") == "Ray_3", "ray").otherwise("segment")
    through = F.when(slope == 0, F.when(gap == 0, carrier).otherwise("empty")).otherwise(F.when(reached & covered, "point").otherwise("empty"))
    m = v.cross(v.sub(p3[1], p3[0]), v.sub(p3[2], p3[0]))
    planes = F.when(v.norm2(v.cross(m, n)) != 0, "line").when(gap == 0, "plane").otherwise("empty")
    result = F.when(F.col("k0").isin("Segment_2", "Line_2"), flat).when(F.col("k0") == "Plane_3", planes).otherwise(through)
    spot = F.when(F.col("k0").isin("Segment_2", "Line_2"), F.array(*[x + at * y for x, y in zip(a, u)])).when(F.col("k0") != "Plane_3", F.array(*[x + where * y for x, y in zip(p3[0], e)]))
    flats, carriers = ["Segment_2", "Line_2"], ["Line_3", "Segment_3", "Ray_3"]
    known = (F.col("k0").isin(flats) & (F.col("k0") == F.col("k1"))) | (F.col("k0").isin(carriers) & F.col("k1").isin("Plane_3", "Triangle_3")) | ((F.col("k0") == "Plane_3") & (F.col("k1") == "Plane_3"))
    reason = F.when(~F.coalesce(known, F.lit(False)), "unsupported_pair").when(F.col("k0").isin(carriers) & (F.col("k1") == "Triangle_3") & (slope == 0) & (gap == 0), "within_the_plane_of_the_triangle")
    out = q.withColumn("reason", reason).withColumn("result", F.when(F.col("reason").isNull(), result)).withColumn("spot", spot)
    return out.select("reason", "id", "query", (F.col("result") != "empty").alias("meets"), F.when(F.col("query") == "intersection", F.col("result")).alias("result"),
                      F.when((F.col("query") == "intersection") & (F.col("result") == "point"), F.col("spot")).alias("point"))


def _to_segment(p: v.Vec, a: v.Vec, b: v.Vec, clamp: bool) -> Column:
    d = v.sub(b, a)
    t = F.try_divide(v.dot(v.sub(p, a), d), v.norm2(d))
    if clamp:
        t = v.clamp(t, 0.0, 1.0)
    return v.dist2(p, tuple(x + t * y for x, y in zip(a, d)))


def evaluate_distances(primitives: DataFrame, queries: DataFrame) -> DataFrame:
    """``id, squared_distance, comparison``: point to point, line, segment or plane, segment to segment
    in the plane; ``compare_distance`` tells whether the second or the third point is nearer to the first."""
    q = _bound(primitives, queries)
    k = F.concat_ws("|", "kinds")
    a2, b2, c2 = (_point(i, 2) for i in range(3))
    a3, b3, c3 = (_point(i, 3) for i in range(3))
    y2, y3 = [_pt(F.get("args", 1), i, 2) for i in range(2)], [_pt(F.get("args", 1), i, 3) for i in range(3)]
    x2 = [_pt(F.get("args", 0), i, 2) for i in range(2)]
    n = v.cross(v.sub(y3[1], y3[0]), v.sub(y3[2], y3[0]))
    plane = F.try_divide(F.pow(v.dot(n, v.sub(a3, y3[0])), F.lit(2.0)), v.norm2(n))
    o = [v.orient2(*x2, y2[0]), v.orient2(*x2, y2[1]), v.orient2(*y2, x2[0]), v.orient2(*y2, x2[1])]
    cross = (o[0] * o[1] < 0) & (o[2] * o[3] < 0)
    apart = F.least(_to_segment(x2[0], *y2, True), _to_segment(x2[1], *y2, True), _to_segment(y2[0], *x2, True), _to_segment(y2[1], *x2, True))
    d2 = (
        F.when(k == "Point_2|Point_2", v.dist2(a2, b2)).when(k == "Point_3|Point_3", v.dist2(a3, b3)).when(k == "Point_2|Line_2", _to_segment(a2, *y2, False))
        .when(k == "Point_2|Segment_2", _to_segment(a2, *y2, True)).when(k == "Segment_2|Segment_2", F.when(cross, 0.0).otherwise(apart))
        .when(k == "Point_3|Line_3", _to_segment(a3, *y3[:2], False)).when(k == "Point_3|Segment_3", _to_segment(a3, *y3[:2], True)).when(k == "Point_3|Plane_3", plane))
    nearer = F.when(F.get("kinds", 0) == "Point_2", v.dist2(a2, b2) - v.dist2(a2, c2)).otherwise(v.dist2(a3, b3) - v.dist2(a3, c3))
    compare = F.when(F.signum(nearer) < 0, "smaller").when(F.signum(nearer) > 0, "larger").otherwise("equal")
    return q.select("id", "query", F.when(F.col("query") == "squared_distance", d2).alias("squared_distance"), F.when(F.col("query") == "compare_distance", compare).alias("comparison"))
