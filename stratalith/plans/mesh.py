"""Queries over the height-field mesh (from part) and the box meshes (from supplier)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as v
from ..operators import graph as gr
from ..operators import mesh as ms
from . import inputs as i
from .registry import query

_CORNERS = "k AS (SELECT f.*, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS by_, q.z AS bz, r.x AS cx, r.y AS cy, r.z AS cz FROM {f} f JOIN {v} p ON p.vid = a JOIN {v} q ON q.vid = b JOIN {v} r ON r.vid = c)"
_K, _KB = _CORNERS.format(f="mf", v="mv"), _CORNERS.format(f="bf", v="bv")
_N = """n AS (SELECT *, (by_-ay)*(cz-az)-(bz-az)*(cy-ay) AS nx, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) AS ny, (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) AS nz FROM k)"""
_UN = "un AS (SELECT *, sqrt(nx*nx+ny*ny+nz*nz) AS s FROM n)"
_HALF = "h AS (SELECT mesh_id, fid, a AS u, b AS v, c AS w FROM {f} UNION ALL SELECT mesh_id, fid, b, c, a FROM {f} UNION ALL SELECT mesh_id, fid, c, a, b FROM {f})"
_H, _HB = _HALF.format(f="mf"), _HALF.format(f="bf")
_BORDER = "bo AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h g WHERE g.u = h.v AND g.v = h.u))"


def _r(cols, n=6):
    return [F.round(c, n).alias(c) for c in cols]


@query("d5_mesh_measures", f"""WITH {i.BOX} SELECT mesh_id, 2 * (w*h + h*d + w*d) AS area, w*h*d AS volume, round(x0 + w/2, 6) AS centroid_x, round(y0 + h/2, 6) AS centroid_y,
  round(z0 + d/2, 6) AS centroid_z, CAST(NULL AS VARCHAR) AS reason FROM bx""")
def d5_mesh_measures(spark, sf):
    return ms.mesh_measures(*i.box_mesh(spark, sf)).select("mesh_id", *_r(["area", "volume", "centroid_x", "centroid_y", "centroid_z"]), "reason")


@query("d5_mesh_measures_open", f"""WITH {i.MESH}, {_K}, {_N} SELECT mesh_id, round(sum(sqrt(nx*nx+ny*ny+nz*nz)) / 2, 4) AS area,
  CAST(NULL AS DOUBLE) AS volume, 'not_closed' AS reason FROM n GROUP BY mesh_id""")
def d5_mesh_measures_open(spark, sf):
    return ms.mesh_measures(*i.mesh(spark, sf)).select("mesh_id", F.round("area", 4).alias("area"), "volume", "reason")


@query("d6_face_normals", f"WITH {i.MESH}, {_K}, {_N}, {_UN} SELECT fid, round(nx/s, 6) AS nx, round(ny/s, 6) AS ny, round(nz/s, 6) AS nz FROM un")
def d6_face_normals(spark, sf):
    return ms.face_normals(*i.mesh(spark, sf)).select("fid", *_r(["nx", "ny", "nz"]))


@query("d6_vertex_normals", f"""WITH {i.MESH}, {_K}, {_N}, {_UN}, e AS (SELECT a AS vid, nx/s AS x, ny/s AS y, nz/s AS z FROM un UNION ALL SELECT b, nx/s, ny/s, nz/s FROM un UNION ALL SELECT c, nx/s, ny/s, nz/s FROM un),
  g AS (SELECT vid, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM e GROUP BY vid)
  SELECT vid, round(x/sqrt(x*x+y*y+z*z), 5) AS nx, round(y/sqrt(x*x+y*y+z*z), 5) AS ny, round(z/sqrt(x*x+y*y+z*z), 5) AS nz FROM g""")
def d6_vertex_normals(spark, sf):
    return ms.vertex_normals(*i.mesh(spark, sf)).select("vid", *_r(["nx", "ny", "nz"], 5))


@query("d7_inspect_mesh", f"""WITH {i.MESH}, {_H}, u AS (SELECT least(u, v) AS lo, greatest(u, v) AS hi, count(*) AS n FROM h GROUP BY ALL)
  SELECT CAST(0 AS BIGINT) AS mesh_id, (SELECT count(*) FROM mv) AS vertices, (SELECT count(*) FROM mf) AS faces, (SELECT count(*) FROM u) AS edges, (SELECT count(*) FROM u WHERE n = 1) AS border_edges,
  CAST(0 AS BIGINT) AS nonmanifold_edges, CAST(0 AS BIGINT) AS degenerate_faces, CAST(0 AS BIGINT) AS nonmanifold_vertices, CAST(0 AS BIGINT) AS bad_indices,
  (SELECT count(*) FROM mv WHERE vid NOT IN (SELECT u FROM h)) AS isolated_vertices, (SELECT count(*) FROM u WHERE n = 1) = 0 AS closed,
  (SELECT count(*) FROM mv) - (SELECT count(*) FROM u) + (SELECT count(*) FROM mf) AS euler""")
def d7_inspect_mesh(spark, sf):
    return ms.inspect_mesh(*i.mesh(spark, sf))


@query("d14_mesh_assertions", f"""WITH {i.BOXMESH}, {_HB}, dg AS (SELECT mesh_id, p, count(DISTINCT q) AS n FROM (SELECT mesh_id, u AS p, v AS q FROM h UNION ALL SELECT mesh_id, v, u FROM h) GROUP BY ALL),
  e AS (SELECT mesh_id, max(n) AS max_degree, CAST(sum(n) // 2 AS BIGINT) AS edges FROM dg GROUP BY mesh_id)
  SELECT mesh_id, 8 AS vertices, round(sqrt(w*w+h*h+d*d)/2, 6) AS min_radius, round(sqrt(w*w+h*h+d*d)/2, 6) AS max_radius, max_degree, edges, 12 AS faces, 8 - edges + 12 AS euler FROM bx JOIN e USING (mesh_id)""")
def d14_mesh_assertions(spark, sf):
    return ms.mesh_assertions(*i.box_mesh(spark, sf)).select("mesh_id", "vertices", *_r(["min_radius", "max_radius"]), "max_degree", "edges", "faces", "euler")


@query("f1_label_faces", f"WITH {i.BOXMESH} SELECT fid, mesh_id * 12 AS component, mesh_id AS label FROM bf")
def f1_label_faces(spark, sf):
    return ms.label_faces(i.box_mesh(spark, sf)[1]).select("fid", "component", "label")


@query("f1_connected_components", """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, l_partkey + 1000000 AS b FROM lineitem),
  s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS seen FROM s UNION SELECT r.node, s.b FROM r JOIN s ON s.a = r.seen)
  SELECT node, min(seen) AS component FROM r GROUP BY node""")
def f1_connected_components(spark, sf):
    e = i.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 1000000).alias("b"))
    return gr.connected_components(e)


@query("f2_component_of", f"WITH {i.BOXMESH} SELECT fid, a, b, c FROM bf WHERE mesh_id = (SELECT max(mesh_id) // 2 FROM bx)")
def f2_component_of(spark, sf):
    faces = i.box_mesh(spark, sf)[1]
    middle = i.table(spark, sf, "supplier").agg(F.floor(F.max("s_suppkey") / 2)).first()[0]
    return ms.component_of(faces, int(middle) * 12 + 5).select("fid", "a", "b", "c")


@query("f3_boundary_cycles", f"""WITH {i.MESH}, {_H}, {_BORDER}, e AS (SELECT bo.*, p.x AS px, p.y AS py, p.z AS pz, q.x AS qx, q.y AS qy, q.z AS qz FROM bo JOIN mv p ON p.vid = u JOIN mv q ON q.vid = v)
  SELECT mesh_id, min(u) AS hole_id, count(*) AS edges, round(sum(sqrt((qx-px)*(qx-px)+(qy-py)*(qy-py)+(qz-pz)*(qz-pz))), 5) AS length, round(avg(px), 6) AS centroid_x, round(avg(py), 6) AS centroid_y, round(avg(pz), 6) AS centroid_z,
  min(px) AS min_x, max(pz) AS max_z, round(sqrt(power(sum(py*qz-pz*qy), 2) + power(sum(pz*qx-px*qz), 2) + power(sum(px*qy-py*qx), 2)) / 2, 4) AS newell_area FROM e GROUP BY mesh_id""")
def f3_boundary_cycles(spark, sf):
    return ms.boundary_cycles(*i.mesh(spark, sf)).select(
        "mesh_id", "hole_id", "edges", F.round("length", 5).alias("length"), *_r(["centroid_x", "centroid_y", "centroid_z"]), "min_x", "max_z", F.round("newell_area", 4).alias("newell_area"))


@query("f3_boundary_loops", f"""WITH RECURSIVE {i.MESH}, {_H}, {_BORDER}, nx AS (SELECT u, v FROM bo), w AS (SELECT min(u) AS loop, min(u) AS node, 0::BIGINT AS position FROM nx
  UNION ALL SELECT loop, nx.v, position + 1 FROM w JOIN nx ON nx.u = w.node WHERE nx.v <> loop) SELECT loop, node, position FROM w""")
def f3_boundary_loops(spark, sf):
    return ms.boundary_loops(i.mesh(spark, sf)[1])


_SHARP = f"""{_UN}, sd AS (SELECT least(h.u, h.v) AS lo, greatest(h.u, h.v) AS hi, h.fid, nx/s AS nx, ny/s AS ny, nz/s AS nz FROM h JOIN un USING (fid)),
  tw AS (SELECT lo, hi, count(*) AS n, min({{'f': fid, 'x': nx, 'y': ny, 'z': nz}}) AS p, max({{'f': fid, 'x': nx, 'y': ny, 'z': nz}}) AS q FROM sd GROUP BY ALL),
  sh AS (SELECT lo, hi, n = 1 AS border, CASE WHEN n = 2 THEN degrees(acos(greatest(-1.0, least(1.0, p.x*q.x + p.y*q.y + p.z*q.z)))) END AS angle FROM tw)"""


@query("f4_sharp_edges", f"WITH {i.MESH}, {_K}, {_N}, {_H}, {_SHARP} SELECT lo, hi, border, round(angle, 4) AS angle FROM sh WHERE border OR angle >= 100 - 1e-9")
def f4_sharp_edges(spark, sf):
    return ms.sharp_edges(*i.mesh(spark, sf), 100.0).select("lo", "hi", "border", F.round("angle", 4).alias("angle"))


@query("f4_sharp_patches", f"""WITH {i.BOXMESH} SELECT fid, (fid // 2) * 2 AS component, fid // 2 AS label FROM bf""")
def f4_sharp_patches(spark, sf):
    return ms.sharp_patches(*i.box_mesh(spark, sf), 60.0).select("fid", "component", "label")


def _clusters(spark, sf):
    vertices, faces = i.mesh(spark, sf)
    labels = faces.join(vertices.select(F.col("vid").alias("a"), (F.col("z") > 25).cast("int").alias("cluster")), "a").select("fid", "cluster")
    return faces, labels


_SEGMENTS = f"""WITH RECURSIVE {i.MESH}, {_H}, cl AS (SELECT fid, CASE WHEN z > 25 THEN 1 ELSE 0 END AS cluster FROM mf JOIN mv ON vid = a),
  e AS (SELECT DISTINCT g.fid AS p, k.fid AS q FROM h g JOIN h k ON g.u = k.v AND g.v = k.u JOIN cl x ON x.fid = g.fid JOIN cl y ON y.fid = k.fid WHERE x.cluster = y.cluster),
  r AS (SELECT fid AS p, fid AS q FROM cl UNION SELECT r.p, e.q FROM r JOIN e ON e.p = r.q), cc AS (SELECT p AS fid, min(q) AS component FROM r GROUP BY p)"""


@query("f5_segment_by_label", f"{_SEGMENTS} SELECT fid, component, dense_rank() OVER (ORDER BY component) - 1 AS label FROM cc")
def f5_segment_by_label(spark, sf):
    return ms.segment_by_label(*_clusters(spark, sf)).select("fid", "component", "label")


@query("e8_keep_largest_components", f"""{_SEGMENTS}, z AS (SELECT component, count(*) AS size FROM cc GROUP BY component), k AS (SELECT *, row_number() OVER (ORDER BY size DESC, component) AS rank, lead(size) OVER (ORDER BY size DESC, component) AS nx FROM z),
  t AS (SELECT coalesce(bool_or(rank = 3 AND nx = size), false) AS tie FROM k) SELECT component, size, rank, NOT tie AS kept, tie AS tie_at_cut FROM k, t WHERE rank <= 3""")
def e8_keep_largest_components(spark, sf):
    return ms.keep_largest(ms.segment_by_label(*_clusters(spark, sf)), 3)


@query("f7_shortest_paths", f"""WITH RECURSIVE {i.MESH}, {_H}, ed AS (SELECT a.vid AS a, b.vid AS b, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS length FROM (SELECT DISTINCT least(u, v) AS lo, greatest(u, v) AS hi FROM h) e JOIN mv a ON a.vid = lo JOIN mv b ON b.vid = hi),
  ar AS (SELECT a, b, length FROM ed UNION ALL SELECT b, a, length FROM ed),
  sp(node, distance) USING KEY (node) AS (SELECT vid, 0.0::DOUBLE FROM mv WHERE z >= 49
    UNION SELECT b, min(s.distance + length) FROM sp s JOIN ar ON a = s.node LEFT JOIN recurring.sp k ON k.node = b GROUP BY b HAVING min(s.distance + length) < coalesce(min(k.distance), 1e300) - 1e-9)
  SELECT node, round(distance, 5) AS distance FROM sp""")
def f7_shortest_paths(spark, sf):
    vertices, faces = i.mesh(spark, sf)
    at = lambda p: vertices.select(F.col("vid").alias(p), *[F.col(c).alias(f"{p}{c}") for c in "xyz"])
    e = ms.half_edges(faces).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().join(at("u"), "u").join(at("v"), "v")
    length = v.norm(v.sub(v.vec("ux", "uy", "uz"), v.vec("vx", "vy", "vz")))
    paths = gr.shortest_paths(e.select(F.col("u").alias("a"), F.col("v").alias("b"), length.alias("length")), vertices.filter("z >= 49").select(F.col("vid").alias("node")))
    return paths.select("node", F.round("distance", 5).alias("distance"))


@query("f8_orient_faces", f"WITH {i.BOXMESH} SELECT fid, a, b, c, true AS orientable FROM bf")
def f8_orient_faces(spark, sf):
    vertices, faces = i.box_mesh(spark, sf)
    odd = F.col("fid") % 5 == 2
    mixed = faces.select("mesh_id", "fid", "a", F.when(odd, F.col("c")).otherwise(F.col("b")).alias("b"), F.when(odd, F.col("b")).otherwise(F.col("c")).alias("c"))
    return ms.orient_faces(vertices, mixed).select("fid", "a", "b", "c", "orientable")


def _soup(spark, sf):
    """Every face of the height field brings its own three points; every ninth face comes twice."""
    vertices, faces = i.mesh(spark, sf)
    twice = faces.unionByName(faces.filter("fid % 9 = 0").withColumn("fid", F.col("fid") + 10_000_000))
    rows = twice.select("fid", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(n).alias("vid")) for k, n in enumerate("abc")])).alias("p")).select("fid", "p.k", "p.vid")
    own = rows.join(vertices, "vid").select("mesh_id", (F.col("fid") * 3 + F.col("k")).alias("vid"), "x", "y", "z")
    return own, twice.select("mesh_id", "fid", (F.col("fid") * 3).alias("a"), (F.col("fid") * 3 + 1).alias("b"), (F.col("fid") * 3 + 2).alias("c"))


@query("g1_clean_soup", f"""WITH {i.MESH}, o AS (SELECT vid, min(fid * 3 + k) AS own FROM (SELECT fid, 0 AS k, a AS vid FROM mf UNION ALL SELECT fid, 1, b FROM mf UNION ALL SELECT fid, 2, c FROM mf) GROUP BY vid)
  SELECT fid, p.own AS a, q.own AS b, r.own AS c FROM mf JOIN o p ON p.vid = mf.a JOIN o q ON q.vid = mf.b JOIN o r ON r.vid = mf.c""")
def g1_clean_soup(spark, sf):
    return ms.clean_soup(*_soup(spark, sf))[1].select("fid", "a", "b", "c")


@query("g2_remove_degenerate", f"""WITH {i.MESH} SELECT fid, a, b, c FROM mf WHERE fid % 6 <> 1""")
def g2_remove_degenerate(spark, sf):
    vertices, faces = i.mesh(spark, sf)
    return ms.remove_degenerate(vertices, faces.withColumn("c", F.when(F.col("fid") % 6 == 1, F.col("b")).otherwise(F.col("c"))))[1].select("fid", "a", "b", "c")


@query("g3_stitch_borders", f"""WITH {i.MESH}, q AS (SELECT vid, (SELECT min(u) FROM (VALUES (0)) t(u)) AS z FROM mv), fa AS (SELECT fid, CASE WHEN y >= 10 THEN 1 ELSE 0 END AS part, a, b, c FROM mf JOIN mv ON vid = a)
  SELECT fid, CASE WHEN part = 1 AND va.y > 10 THEN 1000000 + a ELSE a END AS a, CASE WHEN part = 1 AND vb.y > 10 THEN 1000000 + b ELSE b END AS b, CASE WHEN part = 1 AND vc.y > 10 THEN 1000000 + c ELSE c END AS c
  FROM (SELECT fid, a, b, c, CASE WHEN (fid // 2) // {i.WIDTH} >= 10 THEN 1 ELSE 0 END AS part FROM mf) JOIN mv va ON va.vid = a JOIN mv vb ON vb.vid = b JOIN mv vc ON vc.vid = c""")
def g3_stitch_borders(spark, sf):
    """The height field is cut along the lattice line y = 10 by giving the upper part its own ids."""
    vertices, faces = i.mesh(spark, sf)
    upper = F.floor(F.floor(F.col("fid") / 2) / i.WIDTH) >= 10
    cut = faces.select("mesh_id", "fid", *[F.when(upper, F.col(k) + 1_000_000).otherwise(F.col(k)).alias(k) for k in "abc"])
    copies = vertices.filter("y >= 10").withColumn("vid", F.col("vid") + 1_000_000)
    return ms.stitch_borders(vertices.filter("y <= 10").unionByName(copies), cut)[1].select("fid", "a", "b", "c")


@query("g4_split_nonmanifold_vertices")
def g4_split_nonmanifold_vertices(spark, sf):
    """Neighbouring boxes share a corner id, which makes that vertex non-manifold."""
    vertices, faces = i.box_mesh(spark, sf)
    glue = lambda c: F.when((F.col(c) % 16 == 8), F.col(c) - 1).otherwise(F.col(c)).alias(c)
    glued = faces.select("mesh_id", "fid", glue("a"), glue("b"), glue("c"))
    return ms.split_nonmanifold_vertices(vertices, glued)[1]


@query("g5_fill_holes", f"""WITH {i.MESH}, {_H} SELECT mesh_id, count(*) AS border_edges_before, CAST(0 AS BIGINT) AS border_edges_after, count(*) AS added FROM h WHERE NOT EXISTS (SELECT 1 FROM h g WHERE g.u = h.v AND g.v = h.u) GROUP BY mesh_id""")
def g5_fill_holes(spark, sf):
    vertices, faces = i.mesh(spark, sf)
    filled = ms.fill_holes(vertices, faces, 1 << 40)[1]
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)).withColumn("mesh_id", F.lit(0).cast("bigint"))
    return n(ms.border_edges(faces), "border_edges_before").join(n(ms.border_edges(filled), "border_edges_after"), "mesh_id").join(
        n(filled.join(faces.select("fid"), "fid", "left_anti"), "added"), "mesh_id")


@query("g6_split_plane", f"""WITH {i.MESH}, {_K}, {_N}, d AS (SELECT *, az - 25.5 AS da, bz - 25.5 AS db, cz - 25.5 AS dc, sqrt(nx*nx+ny*ny+nz*nz) / 2 AS area FROM n),
  s AS (SELECT fid, area, CASE WHEN (da >= 0) = (db >= 0) AND (db >= 0) = (dc >= 0) THEN NULL WHEN (db >= 0) = (dc >= 0) THEN da / (da - db) * da / (da - dc)
    WHEN (da >= 0) = (dc >= 0) THEN db / (db - da) * db / (db - dc) ELSE dc / (dc - da) * dc / (dc - db) END AS share,
    CASE WHEN (db >= 0) = (dc >= 0) THEN da >= 0 WHEN (da >= 0) = (dc >= 0) THEN db >= 0 ELSE dc >= 0 END AS lone_up FROM d),
  p AS (SELECT lone_up AS up, CASE WHEN share IS NULL THEN area ELSE area * share END AS area FROM s UNION ALL SELECT NOT lone_up, area * (1 - share) FROM s WHERE share IS NOT NULL)
  SELECT CASE WHEN up THEN 1 ELSE -1 END AS side, round(sum(area), 3) AS area FROM p GROUP BY up""")
def g6_split_plane(spark, sf):
    return ms.split_plane(*i.mesh(spark, sf), (0.0, 0.0, 1.0), 25.5).groupBy("side").agg(F.round(F.sum(ms.triangle_area()), 3).alias("area"))


@query("g7_slice_mesh", f"""WITH {i.MESH}, {_K}, l(plane, level) AS (VALUES (0, 10.5::DOUBLE), (1, 25.5), (2, 40.5)),
  e AS (SELECT plane, fid, ax + (bx-ax) * (level-az)/(bz-az) AS x, ay + (by_-ay) * (level-az)/(bz-az) AS y FROM k, l WHERE (az >= level) <> (bz >= level) UNION ALL
    SELECT plane, fid, bx + (cx-bx) * (level-bz)/(cz-bz), by_ + (cy-by_) * (level-bz)/(cz-bz) FROM k, l WHERE (bz >= level) <> (cz >= level) UNION ALL
    SELECT plane, fid, cx + (ax-cx) * (level-cz)/(az-cz), cy + (ay-cy) * (level-cz)/(az-cz) FROM k, l WHERE (cz >= level) <> (az >= level)),
  s AS (SELECT plane, fid, min({{'x': x, 'y': y}}) AS p, max({{'x': x, 'y': y}}) AS q FROM e GROUP BY ALL)
  SELECT plane, fid, round(sqrt((p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y)), 5) AS length FROM s""")
def g7_slice_mesh(spark, sf):
    s = ms.slice_mesh(*i.mesh(spark, sf), [10.5, 25.5, 40.5])
    gap = v.norm(v.sub(v.vec("p.x", "p.y", "p.z"), v.vec("q.x", "q.y", "q.z")))
    return s.select("plane", "fid", F.round(gap, 5).alias("length"))


_POLYLINES = f"""WITH RECURSIVE {i.MESH}, {_K}, l(plane, level) AS (VALUES (0, 10.5::DOUBLE), (1, 25.5), (2, 40.5)),
  kh AS (SELECT k.*, plane, level, {{n0}} * ax + {{n1}} * ay + {{n2}} * az AS ha, {{n0}} * bx + {{n1}} * by_ + {{n2}} * bz AS hb, {{n0}} * cx + {{n1}} * cy + {{n2}} * cz AS hc FROM k, l),
  ct AS (SELECT plane, fid, least(u, v) AS lo, greatest(u, v) AS hi, level FROM (SELECT plane, level, fid, a AS u, b AS v FROM kh WHERE (ha >= level) <> (hb >= level) UNION ALL
    SELECT plane, level, fid, b, c FROM kh WHERE (hb >= level) <> (hc >= level) UNION ALL SELECT plane, level, fid, c, a FROM kh WHERE (hc >= level) <> (ha >= level))),
  sg AS (SELECT plane, fid, min({{{{'lo': lo, 'hi': hi}}}}) AS p, max({{{{'lo': lo, 'hi': hi}}}}) AS q FROM ct GROUP BY ALL),
  nb AS (SELECT plane, p AS s, q AS t FROM sg UNION ALL SELECT plane, q, p FROM sg),
  dg AS (SELECT plane, s, count(*) AS n FROM nb GROUP BY ALL),
  wk(plane, start, second, prev, here, step) AS (SELECT plane, s, t, s, t, 1 FROM nb
    UNION ALL SELECT w.plane, start, second, w.here, nb.t, step + 1 FROM wk w JOIN nb ON nb.plane = w.plane AND nb.s = w.here AND nb.t <> w.prev WHERE w.here <> start),
  fin AS (SELECT plane, start, second, max(step) AS size, arg_max(here, step) AS stop, arg_max(prev, step) AS last, min(here) AS low FROM wk GROUP BY ALL),
  ok AS (SELECT f.*, start = stop AS closed FROM fin f JOIN dg ON dg.plane = f.plane AND dg.s = start WHERE (start = stop AND start <= low AND second <= last) OR (start <> stop AND n = 1 AND start < stop)),
  pt AS (SELECT plane, start, closed, CAST(0 AS BIGINT) AS position, start AS e FROM ok UNION ALL SELECT w.plane, w.start, closed, w.step, w.here FROM wk w JOIN ok ON w.plane = ok.plane AND w.start = ok.start AND w.second = ok.second)
  SELECT plane, start.lo AS start_lo, start.hi AS start_hi, CAST(position AS BIGINT) AS position, closed, e.lo AS lo, e.hi AS hi, round(p.x + (q.x - p.x) * sh, 5) + 0.0 AS x, round(p.y + (q.y - p.y) * sh, 5) + 0.0 AS y, round(p.z + (q.z - p.z) * sh, 5) + 0.0 AS z
  FROM (SELECT pt.*, (level - ({{n0}} * p.x + {{n1}} * p.y + {{n2}} * p.z)) / ({{n0}} * q.x + {{n1}} * q.y + {{n2}} * q.z - ({{n0}} * p.x + {{n1}} * p.y + {{n2}} * p.z)) AS sh, p, q FROM pt JOIN l USING (plane) JOIN mv p ON p.vid = e.lo JOIN mv q ON q.vid = e.hi)"""


@query("g7_slice_polylines", _POLYLINES.format(n0=0.0, n1=0.0, n2=1.0))
def g7_slice_polylines(spark, sf):
    """Every point of every polyline in which three level planes cut the height field."""
    out = ms.slice_polylines(*i.mesh(spark, sf), [10.5, 25.5, 40.5])
    return out.drop("mesh_id").withColumns({c: F.round(c, 5) + 0.0 for c in "xyz"})


@query("g7_slice_polylines_slanted", _POLYLINES.format(n0=0.5, n1=0.25, n2=1.0))
def g7_slice_polylines_slanted(spark, sf):
    """The same with slanted planes."""
    out = ms.slice_polylines(*i.mesh(spark, sf), [10.5, 25.5, 40.5], normal=(0.5, 0.25, 1.0))
    return out.drop("mesh_id").withColumns({c: F.round(c, 5) + 0.0 for c in "xyz"})


@query("g8_subdivide_loop", f"""WITH {i.MESH}, {_H}, u AS (SELECT least(u, v) AS lo, greatest(u, v) AS hi, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz FROM h JOIN mv ON vid = w GROUP BY ALL),
  e AS (SELECT u.*, p.x AS px, p.y AS py, p.z AS pz, q.x AS qx, q.y AS qy, q.z AS qz FROM u JOIN mv p ON p.vid = lo JOIN mv q ON q.vid = hi),
  m AS (SELECT CASE WHEN n = 2 THEN (px+qx)*0.375 + sx*0.125 ELSE (px+qx)/2 END AS x, CASE WHEN n = 2 THEN (py+qy)*0.375 + sy*0.125 ELSE (py+qy)/2 END AS y, CASE WHEN n = 2 THEN (pz+qz)*0.375 + sz*0.125 ELSE (pz+qz)/2 END AS z FROM e),
  t AS (SELECT vid, count(*) AS val, count(*) FILTER (n = 1) AS bo, sum(ox) AS tx, sum(oy) AS ty, sum(oz) AS tz, coalesce(sum(ox) FILTER (n = 1), 0) AS bx, coalesce(sum(oy) FILTER (n = 1), 0) AS by_, coalesce(sum(oz) FILTER (n = 1), 0) AS bz
    FROM (SELECT lo AS vid, n, qx AS ox, qy AS oy, qz AS oz FROM e UNION ALL SELECT hi, n, px, py, pz FROM e) GROUP BY vid),
  b AS (SELECT *, (0.625 - power(0.375 + cos(2 * pi() / val) / 4, 2)) / val AS beta FROM t),
  o AS (SELECT CASE WHEN val IS NULL THEN x WHEN bo > 0 THEN x*0.75 + bx*0.125 ELSE x*(1 - val*beta) + tx*beta END AS x, CASE WHEN val IS NULL THEN y WHEN bo > 0 THEN y*0.75 + by_*0.125 ELSE y*(1 - val*beta) + ty*beta END AS y,
    CASE WHEN val IS NULL THEN z WHEN bo > 0 THEN z*0.75 + bz*0.125 ELSE z*(1 - val*beta) + tz*beta END AS z FROM mv LEFT JOIN b USING (vid))
  SELECT round(x, 5) + 0.0 AS x, round(y, 5) + 0.0 AS y, round(z, 5) + 0.0 AS z FROM o UNION ALL SELECT round(x, 5), round(y, 5), round(z, 5) FROM m""")
def g8_subdivide_loop(spark, sf):
    return ms.subdivide_loop(*i.mesh(spark, sf))[0].select(*_r(["x", "y", "z"], 5))


@query("g10_triangulate_polygons", """SELECT poly_id, i, poly_id * 10 AS a, poly_id * 10 + i AS b, poly_id * 10 + i + 1 AS c FROM (SELECT s_suppkey AS poly_id FROM supplier WHERE s_suppkey % 4 <> 1), (VALUES (1), (2), (3), (4)) t(i)""")
def g10_triangulate_polygons(spark, sf):
    """Outer rings of the polygons; every fourth gets two corners swapped and must be rejected."""
    ring = i.polygons(spark, sf).filter("ring = 0")
    vertices = ring.select(F.lit(0).cast("bigint").alias("mesh_id"), (F.col("poly_id") * 10 + F.col("seq")).alias("vid"), "x", "y", F.lit(0.0).alias("z"))
    base = F.col("poly_id") * 10
    straight, twisted = F.array(*[base + k for k in range(6)]), F.array(*[base + k for k in (0, 2, 1, 3, 4, 5)])
    polys = ring.select("poly_id").distinct().select(F.lit(0).cast("bigint").alias("mesh_id"), F.col("poly_id").alias("fid"), F.when(F.col("poly_id") % 4 == 1, twisted).otherwise(straight).alias("corners"))
    return ms.triangulate_polygons(vertices, polys)[0].select(F.col("polygon").alias("poly_id"), "i", "a", "b", "c")


@query("g11_select_faces", f"""WITH {i.MESH}, k AS (SELECT * FROM mf WHERE fid % 7 < 2), m AS (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS t FROM (SELECT a AS vid FROM k UNION SELECT b FROM k UNION SELECT c FROM k))
  SELECT fid, p.t AS a, q.t AS b, r.t AS c FROM k JOIN m p ON p.vid = a JOIN m q ON q.vid = b JOIN m r ON r.vid = c""")
def g11_select_faces(spark, sf):
    vertices, faces = i.mesh(spark, sf)
    return ms.select_faces(vertices, faces, faces.filter("fid % 7 < 2").select("fid"))[1].select("fid", "a", "b", "c")


@query("g12_sample_surface", f"""WITH {i.BOXMESH}, {_KB}, s AS (SELECT *, greatest(CAST(ceil(sqrt(greatest((ax-bx)*(ax-bx)+(ay-by_)*(ay-by_)+(az-bz)*(az-bz), (bx-cx)*(bx-cx)+(by_-cy)*(by_-cy)+(bz-cz)*(bz-cz), (cx-ax)*(cx-ax)+(cy-ay)*(cy-ay)+(cz-az)*(cz-az))) / 2.5) AS INT), 1) AS n FROM k)
  SELECT fid, i, j, round(ax + (bx-ax)*(i/n) + (cx-ax)*(j/n), 6) AS x, round(ay + (by_-ay)*(i/n) + (cy-ay)*(j/n), 6) AS y, round(az + (bz-az)*(i/n) + (cz-az)*(j/n), 6) AS z
  FROM s, range(12) p(i), range(12) q(j) WHERE i + j <= n""")
def g12_sample_surface(spark, sf):
    return ms.sample_surface(*i.box_mesh(spark, sf), 2.5).select("fid", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), *_r(["x", "y", "z"]))


@query("g13_split_long_edges")
def g13_split_long_edges(spark, sf):
    vertices, faces = ms.split_long_edges(*i.box_mesh(spark, sf), 6.0)
    return ms.mesh_measures(vertices, faces)


@query("g14_relax_tangential", f"""WITH {i.MESH}, {_K}, {_N}, {_UN}, {_H}, {_BORDER}, e AS (SELECT a AS vid, nx/s AS x, ny/s AS y, nz/s AS z FROM un UNION ALL SELECT b, nx/s, ny/s, nz/s FROM un UNION ALL SELECT c, nx/s, ny/s, nz/s FROM un),
  g AS (SELECT vid, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM e GROUP BY vid), vn AS (SELECT vid, x/sqrt(x*x+y*y+z*z) AS nx, y/sqrt(x*x+y*y+z*z) AS ny, z/sqrt(x*x+y*y+z*z) AS nz FROM g),
  l AS (SELECT DISTINCT u, v FROM (SELECT u, v FROM h UNION ALL SELECT v, u FROM h)), m AS (SELECT u AS vid, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM l JOIN mv ON vid = v GROUP BY u),
  f AS (SELECT u AS vid FROM bo UNION SELECT v FROM bo),
  j AS (SELECT mv.vid, x, y, z, mx-x AS dx, my-y AS dy, mz-z AS dz, nx, ny, nz, mx IS NULL OR mv.vid IN (SELECT vid FROM f) AS stay FROM mv LEFT JOIN m USING (vid) LEFT JOIN vn USING (vid))
  SELECT vid, round(CASE WHEN stay THEN x ELSE x + dx - nx*(dx*nx+dy*ny+dz*nz) END, 5) AS x, round(CASE WHEN stay THEN y ELSE y + dy - ny*(dx*nx+dy*ny+dz*nz) END, 5) AS y, round(CASE WHEN stay THEN z ELSE z + dz - nz*(dx*nx+dy*ny+dz*nz) END, 5) AS z FROM j""")
def g14_relax_tangential(spark, sf):
    return ms.relax_tangential(*i.mesh(spark, sf), 1).select("vid", *_r(["x", "y", "z"], 5))


@query("g15_smooth_shape", f"""WITH {i.MESH}, {_H}, {_BORDER}, t AS (SELECT h.u, h.v, a.x AS ux, a.y AS uy, a.z AS uz, b.x AS vx, b.y AS vy, b.z AS vz, a.x-c.x AS px, a.y-c.y AS py, a.z-c.z AS pz, b.x-c.x AS qx, b.y-c.y AS qy, b.z-c.z AS qz
    FROM h JOIN mv a ON a.vid = u JOIN mv b ON b.vid = v JOIN mv c ON c.vid = w),
  k AS (SELECT *, (px*qx+py*qy+pz*qz) / sqrt(power(py*qz-pz*qy, 2) + power(pz*qx-px*qz, 2) + power(px*qy-py*qx, 2)) * 0.5 AS cot FROM t),
  s AS (SELECT vid, sum(cot) AS w, sum(cot*x) AS mx, sum(cot*y) AS my, sum(cot*z) AS mz FROM (SELECT u AS vid, cot, vx AS x, vy AS y, vz AS z FROM k UNION ALL SELECT v, cot, ux, uy, uz FROM k) GROUP BY vid),
  f AS (SELECT u AS vid FROM bo UNION SELECT v FROM bo)
  SELECT mv.vid, round(CASE WHEN w IS NULL OR mv.vid IN (SELECT vid FROM f) THEN x ELSE x + (mx/w - x)*0.25 END, 4) AS x, round(CASE WHEN w IS NULL OR mv.vid IN (SELECT vid FROM f) THEN z ELSE z + (mz/w - z)*0.25 END, 4) AS z FROM mv LEFT JOIN s USING (vid)""")
def g15_smooth_shape(spark, sf):
    return ms.smooth_shape(*i.mesh(spark, sf), 0.25).select("vid", *_r(["x", "z"], 4))


@query("g9_subdivide_catmull_clark", f"""WITH {i.MESH}, {_H}, {_K}, fp AS (SELECT fid, (ax+bx+cx)/3 AS fx, (ay+by_+cy)/3 AS fy, (az+bz+cz)/3 AS fz FROM k),
  u AS (SELECT least(u, v) AS lo, greatest(u, v) AS hi, count(*) AS n, sum(fx) AS sx, sum(fy) AS sy, sum(fz) AS sz FROM h JOIN fp USING (fid) GROUP BY ALL),
  e AS (SELECT u.*, p.x AS px, p.y AS py, p.z AS pz, q.x AS qx, q.y AS qy, q.z AS qz FROM u JOIN mv p ON p.vid = lo JOIN mv q ON q.vid = hi),
  t AS (SELECT vid, count(*) AS val, count(*) FILTER (n = 1) AS bo, avg(hx) AS rx, avg(hz) AS rz, coalesce(sum(ox) FILTER (n = 1), 0) AS bx, coalesce(sum(oz) FILTER (n = 1), 0) AS bz
    FROM (SELECT lo AS vid, n, qx AS ox, qz AS oz, (px+qx)/2 AS hx, (pz+qz)/2 AS hz FROM e UNION ALL SELECT hi, n, px, pz, (px+qx)/2, (pz+qz)/2 FROM e) GROUP BY vid),
  m AS (SELECT u AS vid, avg(fx) AS qx, avg(fz) AS qz FROM h JOIN fp USING (fid) GROUP BY u)
  SELECT round(CASE WHEN val IS NULL THEN x WHEN bo > 0 THEN x*0.75 + bx*0.125 ELSE (qx + 2*rx + (val-3)*x)/val END, 4) AS x, round(CASE WHEN val IS NULL THEN z WHEN bo > 0 THEN z*0.75 + bz*0.125 ELSE (qz + 2*rz + (val-3)*z)/val END, 4) AS z
    FROM mv LEFT JOIN t USING (vid) LEFT JOIN m USING (vid)
  UNION ALL SELECT round(fx, 4), round(fz, 4) FROM fp UNION ALL SELECT round(CASE WHEN n = 2 THEN (px+qx+sx)/4 ELSE (px+qx)/2 END, 4), round(CASE WHEN n = 2 THEN (pz+qz+sz)/4 ELSE (pz+qz)/2 END, 4) FROM e""")
def g9_subdivide_catmull_clark(spark, sf):
    vertices, faces = i.mesh(spark, sf)
    return ms.subdivide_catmull_clark(vertices, faces.select("mesh_id", "fid", F.array("a", "b", "c").alias("corners")))[0].select(*_r(["x", "z"], 4))
