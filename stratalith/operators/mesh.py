"""Indexed triangle meshes as two tables.

``vertices``: ``mesh_id, vid, x, y, z``; ``faces``: ``mesh_id, fid, a, b, c``.  ``vid`` and ``fid``
are unique over the table, so most steps need no mesh id in their keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..session import is_empty, settle
from .graph import chain_order, connected_components, loop_order, parity
from .ordering import dense_ids

A, B, C = v.named("ax", "ay", "az"), v.named("bx", "by", "bz"), v.named("cx", "cy", "cz")


def corners(vertices: DataFrame, faces: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Faces with their corner coordinates: one join over exploded corners and one aggregation."""
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("k"), F.col(n).alias("vid")) for n in "abc"]))
    rows = faces.select("mesh_id", "fid", *keep, named.alias("p")).select("mesh_id", "fid", *keep, "p.k", "p.vid")
    placed = rows.join(vertices.select("vid", "x", "y", "z"), "vid")
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    return placed.groupBy("mesh_id", "fid", *keep).agg(
        *[pick(k, "vid").alias(k) for k in "abc"], *[pick(k, c).alias(k + c) for k in "abc" for c in "xyz"])


def half_edges(faces: DataFrame) -> DataFrame:
    """``mesh_id, fid, u, v, w``: directed edges with the opposite corner."""
    turn = [("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b")]
    return faces.select("mesh_id", "fid", F.explode(F.array(*[
        F.struct(F.col(p).alias("u"), F.col(q).alias("v"), F.col(r).alias("w")) for p, q, r in turn])).alias("e")).select("mesh_id", "fid", "e.*")


def face_adjacency(faces: DataFrame) -> DataFrame:
    """``a, b`` pairs of faces that share an edge.  Faces around a non-manifold edge are chained to
    the smallest of them instead of being paired with each other."""
    sides = half_edges(faces).select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"), "fid")
    first = sides.groupBy("lo", "hi").agg(F.min("fid").alias("a"))
    return sides.join(first, ["lo", "hi"]).filter(F.col("fid") != F.col("a")).select("a", F.col("fid").alias("b"))


def _cross(k: Sequence[v.Vec] = (A, B, C)) -> v.Vec:
    return v.cross(v.sub(k[1], k[0]), v.sub(k[2], k[0]))


def mesh_measures(vertices: DataFrame, faces: DataFrame, crossing: DataFrame | None = None) -> DataFrame:
    """Area always; volume and centroid only for closed, non-degenerate, positively oriented meshes
    without self-intersection, else a reason.  Products are taken about each mesh's minimum corner."""
    low = vertices.groupBy("mesh_id").agg(*[F.min(c).alias(f"l{c}") for c in "xyz"])
    local = corners(vertices, faces).join(low, "mesh_id")
    shift = v.vec("lx", "ly", "lz")
    k = [v.sub(p, shift) for p in (A, B, C)]
    area = v.norm(_cross()) / 2
    vol = v.dot(k[0], v.cross(k[1], k[2])) / 6
    sums = local.withColumn("ar", area).withColumn("vo", vol).groupBy("mesh_id", "lx", "ly", "lz").agg(
        F.sum("ar").alias("area"), F.sum("vo").alias("raw_volume"), F.min("ar").alias("least_area"),
        *[F.sum(F.col("vo") * (k[0][i] + k[1][i] + k[2][i]) / 4).alias(f"m{c}") for i, c in enumerate("xyz")])
    sides = half_edges(faces).groupBy("mesh_id", F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("u") < F.col("v"), 1).otherwise(-1)).alias("balance"))
    closed = sides.groupBy("mesh_id").agg(F.min((F.col("n") == 2) & (F.col("balance") == 0)).alias("closed"))
    out = sums.join(closed, "mesh_id")
    out = out.withColumn("crossed", F.lit(False)) if crossing is None else out.join(
        crossing.select("mesh_id").distinct().withColumn("crossed", F.lit(True)), "mesh_id", "left")
    reason = F.when(~F.col("closed"), "not_closed").when(F.col("least_area") <= 0, "degenerate_face").when(
        F.coalesce("crossed", F.lit(False)), "self_intersecting").when(F.col("raw_volume") <= 0, "not_outward_oriented")
    good = reason.isNull()
    return out.select("mesh_id", "area", F.when(good, F.col("raw_volume")).alias("volume"),
                      *[F.when(good, F.col(f"m{c}") / F.col("raw_volume") + F.col(f"l{c}")).alias(f"centroid_{c}") for c in "xyz"], reason.alias("reason"))


def face_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """``mesh_id, fid, nx, ny, nz``; a face without area gets the zero vector."""
    n = corners(vertices, faces).select("mesh_id", "fid", "a", "b", "c", *[q.alias(f"q{c}") for q, c in zip(_cross(), "xyz")])
    size = v.norm(v.vec("qx", "qy", "qz"))
    return n.withColumn("s", size).select("mesh_id", "fid", "a", "b", "c", (F.col("s") / 2).alias("area"),
                                          *[F.when(F.col("s") > 0, F.col(f"q{c}") / F.col("s")).otherwise(0.0).alias(f"n{c}") for c in "xyz"])


def vertex_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Normalised sum of the unit normals around each vertex; zero where they cancel."""
    n = face_normals(vertices, faces).select(F.explode(F.array("a", "b", "c")).alias("vid"), "nx", "ny", "nz")
    s = n.groupBy("vid").agg(*[F.sum(f"n{c}").alias(f"s{c}") for c in "xyz"]).withColumn("s", v.norm(v.vec("sx", "sy", "sz")))
    return s.select("vid", *[F.when(F.col("s") > 1e-12, F.col(f"s{c}") / F.col("s")).otherwise(0.0).alias(f"n{c}") for c in "xyz"])


def inspect_mesh(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Counts per mesh: border and non-manifold edges, degenerate faces, bad indices, isolated and
    non-manifold vertices, and whether it is closed."""
    use = half_edges(faces).groupBy("mesh_id", F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).agg(F.count(F.lit(1)).alias("n"))
    sides = use.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("edges"), F.sum((F.col("n") == 1).cast("bigint")).alias("border_edges"),
                                       F.sum((F.col("n") > 2).cast("bigint")).alias("nonmanifold_edges"))
    flat = face_normals(vertices, faces).groupBy("mesh_id").agg(F.sum((F.col("area") <= 0).cast("bigint")).alias("degenerate_faces"))
    used = faces.select("mesh_id", F.explode(F.array("a", "b", "c")).alias("vid"))
    bad = used.join(vertices.select("vid"), "vid", "left_anti").groupBy("mesh_id").agg(F.count(F.lit(1)).alias("bad_indices"))
    alone = vertices.join(used.select("vid"), "vid", "left_anti").groupBy("mesh_id").agg(F.count(F.lit(1)).alias("isolated_vertices"))
    # Around a regular vertex the corner fan has as many edges as faces (closed) or one more (border).
    spokes = half_edges(faces).select("mesh_id", F.explode(F.array(F.struct(F.col("u").alias("vid"), F.col("v").alias("o")), F.struct(F.col("v").alias("vid"), F.col("u").alias("o")))).alias("s")) \
        .select("mesh_id", "s.*").groupBy("mesh_id", "vid", "o").agg(F.count(F.lit(1)).alias("n")).groupBy("mesh_id", "vid").agg(F.sum((F.col("n") == 1).cast("bigint")).alias("ends"))
    odd = spokes.groupBy("mesh_id").agg(F.sum((F.col("ends") > 2).cast("bigint")).alias("nonmanifold_vertices"))
    counts = vertices.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("vertices")).join(faces.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("faces")), "mesh_id")
    out = counts.join(sides, "mesh_id").join(flat, "mesh_id").join(odd, "mesh_id").join(bad, "mesh_id", "left").join(alone, "mesh_id", "left")
    return out.na.fill(0, ["bad_indices", "isolated_vertices"]).withColumn("closed", F.col("border_edges") == 0).withColumn(
        "euler", F.col("vertices") - F.col("edges") + F.col("faces"))


def mesh_assertions(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Counts, largest vertex degree, Euler characteristic and the range of distances to the centroid."""
    degree = half_edges(faces).select("mesh_id", F.explode(F.array(F.struct(F.col("u").alias("p"), F.col("v").alias("q")), F.struct(F.col("v").alias("p"), F.col("u").alias("q")))).alias("s")) \
        .select("mesh_id", "s.*").distinct().groupBy("mesh_id", "p").count()
    edges = degree.groupBy("mesh_id").agg(F.max("count").alias("max_degree"), (F.sum("count") / 2).cast("bigint").alias("edges"))
    centre = vertices.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("vertices"), *[F.avg(c).alias(f"m{c}") for c in "xyz"])
    r = vertices.join(centre, "mesh_id").withColumn("r", F.sqrt(v.dist2(v.vec("x", "y", "z"), v.vec("mx", "my", "mz")))) \
        .groupBy("mesh_id", "vertices").agg(F.min("r").alias("min_radius"), F.max("r").alias("max_radius"))
    return r.join(edges, "mesh_id").join(faces.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("faces")), "mesh_id").withColumn(
        "euler", F.col("vertices") - F.col("edges") + F.col("faces"))


# -- components -------------------------------------------------------------------------------
def label_faces(faces: DataFrame, adjacency: DataFrame | None = None) -> DataFrame:
    """``fid, component, label``: component = smallest face id, label = contiguous from 0."""
    pairs = face_adjacency(faces) if adjacency is None else adjacency
    cc = settle(connected_components(pairs, faces.select(F.col("fid").alias("node"))))
    ids = dense_ids(cc.select("component"), "component", "label")
    return cc.join(ids, "component").select(F.col("node").alias("fid"), "component", "label")


def component_of(faces: DataFrame, seed: int) -> DataFrame:
    labels = settle(label_faces(faces))
    mine = labels.filter(F.col("fid") == seed).select("component")
    return faces.join(labels.join(F.broadcast(mine), "component").select("fid"), "fid", "left_semi")


def keep_largest(labels: DataFrame, n: int) -> DataFrame:
    """``component, size, rank, kept, tie_at_cut``: equal sizes on both sides of the cut refuse the
    choice (nothing is kept)."""
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    top = sizes.orderBy(F.col("size").desc(), "component").limit(n + 1)  # the operator's own top-k
    order = Window.orderBy(F.col("size").desc(), "component")
    ranked = top.withColumn("rank", F.row_number().over(order)).withColumn("next", F.lead("size").over(order))
    tie = F.max(F.when(F.col("rank") == n, F.col("next") == F.col("size"))).over(Window.partitionBy(F.lit(1)))
    return ranked.withColumn("tie_at_cut", F.coalesce(tie, F.lit(False))).filter(F.col("rank") <= n).select(
        "component", "size", "rank", (~F.col("tie_at_cut")).alias("kept"), "tie_at_cut")


def segment_by_label(faces: DataFrame, labels: DataFrame) -> DataFrame:
    """Connected faces with an equal cluster label (``fid, cluster``)."""
    named = settle(faces.join(labels, "fid"))
    sides = half_edges(named).join(named.select("fid", "cluster"), "fid").select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"), "cluster", "fid")
    first = sides.groupBy("lo", "hi", "cluster").agg(F.min("fid").alias("a"))
    pairs = sides.join(first, ["lo", "hi", "cluster"]).filter("fid <> a").select("a", F.col("fid").alias("b"))
    return label_faces(faces, pairs)


def border_edges(faces: DataFrame) -> DataFrame:
    """Directed edges whose reverse belongs to no face."""
    e = half_edges(faces)
    return e.join(e.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"], "left_anti")


def boundary_cycles(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """One row per boundary loop: smallest vertex id, edges, length, Newell area, centroid, bounds."""
    e = settle(border_edges(faces).select("mesh_id", "u", "v"))
    cc = connected_components(e.select(F.col("u").alias("a"), F.col("v").alias("b")))
    p = vertices.select(F.col("vid").alias("u"), *[F.col(c).alias(f"p{c}") for c in "xyz"])
    q = vertices.select(F.col("vid").alias("v"), *[F.col(c).alias(f"q{c}") for c in "xyz"])
    placed = e.join(cc.select(F.col("node").alias("u"), F.col("component").alias("hole_id")), "u").join(p, "u").join(q, "v")
    n = v.cross(v.vec("px", "py", "pz"), v.vec("qx", "qy", "qz"))
    sums = placed.groupBy("mesh_id", "hole_id").agg(
        F.count(F.lit(1)).alias("edges"), F.sum(v.norm(v.sub(v.vec("qx", "qy", "qz"), v.vec("px", "py", "pz")))).alias("length"),
        *[F.sum(a).alias(f"s{c}") for a, c in zip(n, "xyz")], *[F.avg(f"p{c}").alias(f"centroid_{c}") for c in "xyz"],
        *[F.min(f"p{c}").alias(f"min_{c}") for c in "xyz"], *[F.max(f"p{c}").alias(f"max_{c}") for c in "xyz"])
    return sums.withColumn("newell_area", v.norm(v.vec("sx", "sy", "sz")) / 2).drop("sx", "sy", "sz")


def boundary_loops(faces: DataFrame) -> DataFrame:
    """``loop, node, position``: the vertices of every simple boundary loop in order."""
    e = settle(border_edges(faces).select(F.col("u").alias("node"), F.col("v").alias("next")))
    cc = connected_components(e.select(F.col("node").alias("a"), F.col("next").alias("b")))
    return loop_order(e, cc.select("node", F.col("component").alias("loop")))


def sharp_edges(vertices: DataFrame, faces: DataFrame, degrees: float) -> DataFrame:
    """``lo, hi, angle, border``: edges where the normals differ by at least ``degrees``, and borders."""
    n = face_normals(vertices, faces).select("fid", "nx", "ny", "nz")
    sides = half_edges(faces).select("mesh_id", F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"), "fid").join(n, "fid")
    two = sides.groupBy("mesh_id", "lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("fid", "nx", "ny", "nz")).alias("f"), F.max(F.struct("fid", "nx", "ny", "nz")).alias("g"))
    cos = v.clamp(v.dot(v.vec("f.nx", "f.ny", "f.nz"), v.vec("g.nx", "g.ny", "g.nz")), -1.0, 1.0)
    angle = F.when(F.col("n") == 2, F.degrees(F.acos(cos)))
    # A hair of slack keeps angles that equal the limit up to rounding.
    return two.withColumn("angle", angle).filter((F.col("n") != 2) | (F.col("angle") >= degrees - 1e-9)).select("mesh_id", "lo", "hi", "angle", (F.col("n") == 1).alias("border"))


def sharp_patches(vertices: DataFrame, faces: DataFrame, degrees: float) -> DataFrame:
    """Faces grouped across edges that are not sharp."""
    sharp = settle(sharp_edges(vertices, faces, degrees))
    sides = half_edges(faces).select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"), "fid").join(sharp.select("lo", "hi"), ["lo", "hi"], "left_anti")
    pairs = sides.groupBy("lo", "hi").agg(F.min("fid").alias("a"), F.max("fid").alias("b")).filter("a <> b")
    return label_faces(faces, pairs)


def orient_faces(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Make neighbouring faces agree and closed components point outwards.

    ``orientable`` is false on components where no choice works; their faces are left alone.
    """
    e = half_edges(faces).select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"), (F.col("u") < F.col("v")).alias("up"), "fid")
    two = e.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("fid", "up")).alias("f"), F.max(F.struct("fid", "up")).alias("g")).filter("n = 2")
    pairs = two.select(F.col("f.fid").alias("a"), F.col("g.fid").alias("b"), (F.col("f.up") == F.col("g.up")).cast("int").alias("differ"))
    par = settle(parity(pairs, faces.select(F.col("fid").alias("node"))))
    fine = par.groupBy("component").agg(F.min("consistent").alias("orientable"))
    joined = faces.join(par.select(F.col("node").alias("fid"), "component", "flip"), "fid").join(fine, "component")
    turn = (F.col("flip") == 1) & F.col("orientable")
    turned = settle(joined.select("mesh_id", "fid", "a", F.when(turn, F.col("c")).otherwise(F.col("b")).alias("b"), F.when(turn, F.col("b")).otherwise(F.col("c")).alias("c"), "component", "orientable"))
    vol = corners(vertices, turned, ("component",)).groupBy("component").agg(F.sum(v.dot(A, v.cross(B, C))).alias("vol"))
    open_ = border_edges(turned).join(turned.select("fid", "component"), "fid").select("component").distinct().withColumn("open", F.lit(True))
    inward = F.col("open").isNull() & (F.col("vol") < 0) & F.col("orientable")
    return turned.join(vol, "component").join(open_, "component", "left").select(
        "mesh_id", "fid", "a", F.when(inward, F.col("c")).otherwise(F.col("b")).alias("b"), F.when(inward, F.col("b")).otherwise(F.col("c")).alias("c"), "component", "orientable")


# -- cleaning ---------------------------------------------------------------------------------
def _remap(faces: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace corner ids by ``vid -> target`` (all ids present)."""
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("k"), F.col(n).alias("vid")) for n in "abc"]))
    rows = faces.select("mesh_id", "fid", named.alias("p")).select("mesh_id", "fid", "p.k", "p.vid").join(mapping, "vid")
    return rows.groupBy("mesh_id", "fid").agg(*[F.max(F.when(F.col("k") == k, F.col("target"))).alias(k) for k in "abc"])


def merge_equal_points(vertices: DataFrame) -> DataFrame:
    """``vid, target``: the smallest id with the same coordinates in the same mesh."""
    same = vertices.groupBy("mesh_id", "x", "y", "z").agg(F.min("vid").alias("target"))
    return vertices.join(same, ["mesh_id", "x", "y", "z"]).select("vid", "target")


def clean_soup(vertices: DataFrame, faces: DataFrame, keep_one: bool = True, same_orientation: bool = False) -> tuple[DataFrame, DataFrame]:
    """Merge equal points; drop degenerate and duplicate faces (or all copies of duplicates) and
    unused points.  Duplicates have the same corners, in the same cyclic order if asked."""
    merged = _remap(faces, merge_equal_points(vertices)).filter("a <> b AND b <> c AND a <> c")
    low = F.least("a", "b", "c")
    cyclic = F.when(F.col("a") == low, F.array("a", "b", "c")).when(F.col("b") == low, F.array("b", "c", "a")).otherwise(F.array("c", "a", "b"))
    key = cyclic if same_orientation else F.array_sort(F.array("a", "b", "c"))
    marked = merged.withColumn("key", key)
    groups = marked.groupBy("mesh_id", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fid").alias("fid"))
    kept = groups if keep_one else groups.filter("n = 1")
    out = settle(marked.join(kept.select("fid"), "fid", "left_semi").select("mesh_id", "fid", "a", "b", "c"))
    return vertices.join(out.select(F.explode(F.array("a", "b", "c")).alias("vid")), "vid", "left_semi"), out


def remove_degenerate(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = settle(face_normals(vertices, faces).filter("a <> b AND b <> c AND a <> c AND area > 0").select("mesh_id", "fid", "a", "b", "c"))
    return vertices.join(good.select(F.explode(F.array("a", "b", "c")).alias("vid")), "vid", "left_semi"), good


def stitch_borders(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge the ends of border edges that run in opposite directions between equal coordinates;
    places where more than two such edges meet stay apart."""
    at = vertices.select("vid", F.struct("x", "y", "z").alias("p"))
    e = border_edges(faces).join(at.select(F.col("vid").alias("u"), F.col("p").alias("pu")), "u").join(at.select(F.col("vid").alias("v"), F.col("p").alias("pv")), "v")
    up = F.col("pu") < F.col("pv")
    ends = e.select("mesh_id", F.least("pu", "pv").alias("p"), F.greatest("pu", "pv").alias("q"), F.when(up, F.col("u")).otherwise(F.col("v")).alias("low"),
                    F.when(up, F.col("v")).otherwise(F.col("u")).alias("high"), up.cast("int").alias("up"))
    two = ends.groupBy("mesh_id", "p", "q").agg(F.count(F.lit(1)).alias("n"), F.sum("up").alias("ups"), *[f(x).alias(f"{f.__name__}_{x}") for f in (F.min, F.max) for x in ("low", "high")]) \
        .filter("n = 2 AND ups = 1")
    links = two.select(F.col("min_low").alias("a"), F.col("max_low").alias("b")).unionByName(two.select(F.col("min_high").alias("a"), F.col("max_high").alias("b"))).filter("a <> b")
    cc = connected_components(links, vertices.select(F.col("vid").alias("node")))
    mapping = settle(cc.select(F.col("node").alias("vid"), F.col("component").alias("target")))
    return vertices.join(mapping.filter("vid = target").select("vid"), "vid", "left_semi"), _remap(faces, mapping)


def split_nonmanifold_vertices(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Give every face fan around a vertex its own copy.  A corner is numbered 4*fid + k; corners of
    one vertex are linked where their faces share an edge at it, and each component is one copy."""
    named = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(n).alias("vid")) for i, n in enumerate("abc")]))
    corner = settle(faces.select("mesh_id", "fid", named.alias("p")).select("mesh_id", (F.col("fid") * 4 + F.col("p.k")).alias("corner"), "p.vid", "fid"))
    spokes = half_edges(faces).select("fid", F.explode(F.array(F.struct(F.col("u").alias("vid"), F.col("v").alias("o")), F.struct(F.col("v").alias("vid"), F.col("u").alias("o")))).alias("s")).select("fid", "s.*")
    at = spokes.join(corner.select("fid", "vid", "corner"), ["fid", "vid"]).groupBy("vid", "o").agg(F.min("corner").alias("a"), F.max("corner").alias("b"), F.count(F.lit(1)).alias("n"))
    cc = connected_components(at.filter("n = 2").select("a", "b"), corner.select(F.col("corner").alias("node")))
    fans = settle(corner.join(cc.select(F.col("node").alias("corner"), F.col("component").alias("fan")), "corner"))
    first = fans.groupBy("vid").agg(F.min("fan").alias("main"))
    extra = fans.select("vid", "fan").distinct().join(first, "vid").filter("fan <> main")
    top = vertices.agg(F.max("vid")).first()[0]
    ids = settle(extra.join(dense_ids(extra, "fan", "n"), "fan").select("vid", "fan", (F.col("n") + 1 + F.lit(top)).alias("copy")))
    moved = fans.join(ids, ["vid", "fan"], "left").select("mesh_id", "fid", (F.col("corner") % 4).alias("k"), F.coalesce("copy", "vid").alias("target"))
    out = moved.groupBy("mesh_id", "fid").agg(*[F.max(F.when(F.col("k") == i, F.col("target"))).alias(n) for i, n in enumerate("abc")])
    copies = ids.join(vertices, "vid").select("mesh_id", F.col("copy").alias("vid"), "x", "y", "z")
    return vertices.unionByName(copies), out


def fill_holes(vertices: DataFrame, faces: DataFrame, max_edges: int, ids: Sequence[int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Close boundary loops of at most ``max_edges`` edges with a fan around the loop's centroid.
    Returns vertices, faces and a report of filled and skipped loops."""
    e = settle(border_edges(faces).select("mesh_id", "u", "v"))
    cc = settle(connected_components(e.select(F.col("u").alias("a"), F.col("v").alias("b"))))
    looped = e.join(cc.select(F.col("node").alias("u"), F.col("component").alias("hole_id")), "u")
    sized = looped.join(vertices.select(F.col("vid").alias("u"), "x", "y", "z"), "u").groupBy("mesh_id", "hole_id").agg(
        F.count(F.lit(1)).alias("edges"), F.countDistinct("u").alias("ends"), *[F.avg(c).alias(c) for c in "xyz"])
    chosen = (F.col("edges") <= max_edges) & (F.col("ends") == F.col("edges"))
    if ids is not None:
        chosen = chosen & F.col("hole_id").isin(list(ids))
    report = settle(sized.withColumn("filled", chosen))
    top, last = vertices.agg(F.max("vid")).first()[0], faces.agg(F.max("fid")).first()[0]
    hubs = report.filter("filled")
    numbered = settle(hubs.join(dense_ids(hubs, "hole_id", "n"), "hole_id").withColumn("hub", F.col("n") + 1 + F.lit(top)))
    rim = looped.join(numbered.select("hole_id", "hub"), "hole_id")
    fresh = rim.join(dense_ids(rim, "u", "n"), "u").select("mesh_id", (F.col("n") + 1 + F.lit(last)).alias("fid"), F.col("v").alias("a"), F.col("u").alias("b"), F.col("hub").alias("c"))
    return vertices.unionByName(numbered.select("mesh_id", F.col("hub").alias("vid"), "x", "y", "z")), faces.select("mesh_id", "fid", "a", "b", "c").unionByName(fresh), report


def select_faces(vertices: DataFrame, faces: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keep the faces in ``ids`` and renumber their vertices densely from 0."""
    kept = settle(faces.join(ids.select("fid"), "fid", "left_semi").select("mesh_id", "fid", "a", "b", "c"))
    mapping = settle(dense_ids(kept.select(F.explode(F.array("a", "b", "c")).alias("vid")), "vid", "target"))
    return vertices.join(mapping, "vid").select("mesh_id", F.col("target").alias("vid"), "x", "y", "z"), _remap(kept, mapping)


def triangulate_polygons(vertices: DataFrame, polygons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(triangles, rejected ids): fans of convex polygons ``mesh_id, fid, corners``.  A polygon is
    convex when every corner turns the same way about its Newell normal."""
    n = F.size("corners")
    at = polygons.select("mesh_id", "fid", F.posexplode("corners").alias("pos", "vid"), n.alias("n")).join(vertices.select("vid", "x", "y", "z"), "vid")
    ring = at.groupBy("mesh_id", "fid", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y", "z"))), lambda s: F.struct(s["x"], s["y"], s["z"])).alias("p"))
    point = lambda i: tuple(F.element_at("p", (i % F.col("n") + 1).cast("int"))[c] for c in ("x", "y", "z"))
    walk = ring.select("mesh_id", "fid", "p", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    p, q, r = point(F.col("i")), point(F.col("i") + 1), point(F.col("i") + 2)
    turns = walk.select("fid", "mesh_id", *[t.alias(f"t{c}") for t, c in zip(v.cross(v.sub(q, p), v.sub(r, q)), "xyz")], *[t.alias(f"s{c}") for t, c in zip(v.cross(p, q), "xyz")])
    normal = turns.groupBy("fid").agg(*[F.sum(f"s{c}").alias(f"n{c}") for c in "xyz"])
    convex = turns.join(normal, "fid").groupBy("fid").agg(F.min(v.dot(v.vec("tx", "ty", "tz"), v.vec("nx", "ny", "nz"))).alias("least")).filter("least >= 0")
    fan = F.explode(F.sequence(F.lit(1), n - 2))
    good = polygons.filter(n >= 3).join(convex.select("fid"), "fid", "left_semi")
    tri = good.select("mesh_id", F.col("fid").alias("polygon"), "corners", fan.alias("i")).select(
        "mesh_id", "polygon", "i", F.element_at("corners", 1).alias("a"), F.element_at("corners", F.col("i") + 1).alias("b"), F.element_at("corners", F.col("i") + 2).alias("c"))
    return tri, polygons.join(good.select("fid"), "fid", "left_anti").select("fid")


# -- cutting ------------------------------------------------------------------------------------
def split_plane(vertices: DataFrame, faces: DataFrame, normal: Sequence[float], offset: float) -> DataFrame:
    """Triangles of both sides of the plane n.p = d: ``mesh_id, fid, piece, side, p, q, r``.

    Every crossed edge is cut at the same point from both faces, because the cut is always computed
    from the end with the smaller vertex id.
    """
    c = corners(vertices, faces)
    n = v.const(normal)
    dist = {k: v.dot(n, p) - offset for k, p in (("a", A), ("b", B), ("c", C))}
    c = c.withColumns({f"d{k}": d for k, d in dist.items()})
    # Rotate so that the lone corner (the one alone on its side) comes first.
    sign = lambda k: F.when(F.col(f"d{k}") >= 0, 1).otherwise(-1)
    lone = F.when((sign("b") == sign("c")) & (sign("a") != sign("b")), 0).when((sign("a") == sign("c")) & (sign("b") != sign("a")), 1).when(
        (sign("a") == sign("b")) & (sign("c") != sign("a")), 2).otherwise(-1)
    corner = lambda k: F.struct(F.col(k).alias("id"), F.col(f"{k}x").alias("x"), F.col(f"{k}y").alias("y"), F.col(f"{k}z").alias("z"), F.col(f"d{k}").alias("d"))
    k = c.select("mesh_id", "fid", lone.alias("lone"), F.array(corner("a"), corner("b"), corner("c")).alias("k"))
    pick = lambda i: F.element_at("k", (F.pmod(F.greatest(F.col("lone"), F.lit(0)) + i, F.lit(3)) + 1).cast("int"))
    k = k.select("mesh_id", "fid", "lone", pick(0).alias("p"), pick(1).alias("q"), pick(2).alias("r"))

    def cut(s: str, t: str) -> Column:
        swap = F.col(f"{s}.id") < F.col(f"{t}.id")
        lo, hi = F.when(swap, F.col(s)).otherwise(F.col(t)), F.when(swap, F.col(t)).otherwise(F.col(s))
        share = F.try_divide(lo["d"], lo["d"] - hi["d"])
        return F.struct(*[(lo[x] + (hi[x] - lo[x]) * share).alias(x) for x in "xyz"])

    k = k.withColumn("pq", cut("p", "q")).withColumn("rp", cut("r", "p"))
    plain = lambda s: F.struct(*[F.col(f"{s}.{x}").alias(x) for x in "xyz"])
    side = lambda s: F.when(F.col(f"{s}.d") >= 0, 1).otherwise(-1).alias("side")
    tri = lambda i, s, x, y, z: F.struct(F.lit(i).alias("piece"), side(s), x.alias("p"), y.alias("q"), z.alias("r"))
    pq, rp = F.col("pq"), F.col("rp")
    pieces = F.when(F.col("lone") < 0, F.array(tri(0, "p", plain("p"), plain("q"), plain("r")))).otherwise(F.array(
        tri(0, "p", plain("p"), pq, rp), tri(1, "q", pq, plain("q"), plain("r")), tri(2, "q", pq, plain("r"), rp)))
    return k.select("mesh_id", "fid", F.explode(pieces).alias("t")).select("mesh_id", "fid", "t.*")


def clip_plane(vertices: DataFrame, faces: DataFrame, normal: Sequence[float], offset: float, side: int = -1) -> DataFrame:
    """The surface on one side of the plane, without a cap."""
    return split_plane(vertices, faces, normal, offset).filter(F.col("side") == side)


def triangle_area(p: str = "p", q: str = "q", r: str = "r") -> Column:
    k = [v.vec(f"{s}.x", f"{s}.y", f"{s}.z") for s in (p, q, r)]
    return v.norm(_cross(k)) / 2


def slice_mesh(vertices: DataFrame, faces: DataFrame, heights: Sequence[float], axis: str = "z", normal: Sequence[float] | None = None) -> DataFrame:
    """``mesh_id, fid, plane, level, flat, p, q``: intersection segments with the planes n.p = d for the
    given ``heights`` d, across one axis or for any ``normal``.  A face is joined only with the planes in
    its own range.  Faces lying in a plane are refused (flagged ``flat``).  Segment ends are named by the
    mesh edge they cut, so neighbours share them exactly."""
    n = normal or [float(c == axis) for c in "xyz"]
    if not any(n):
        raise ValueError("the normal of a plane cannot be zero")
    c = corners(vertices, faces)
    height = {k: reduce(lambda x, y: x + y, (F.col(f"{k}{x}") if w == 1 else F.col(f"{k}{x}") * F.lit(float(w)) for x, w in zip("xyz", n) if w)) for k in "abc"}
    c = c.withColumns({f"_h{k}": e for k, e in height.items()})
    h = {k: F.col(f"_h{k}") for k in "abc"}
    lo, hi = F.least(*h.values()), F.greatest(*h.values())
    levels = F.array(*[F.struct(F.lit(i).alias("plane"), F.lit(float(x)).alias("level")) for i, x in enumerate(heights)])
    c = c.withColumn("lv", F.explode(F.filter(levels, lambda s: (s["level"] >= lo) & (s["level"] <= hi)))).select("*", "lv.plane", "lv.level").drop("lv")
    level = F.col("level")
    above = {k: h[k] >= level for k in "abc"}

    def cut(s: str, t: str) -> Column:
        swap = F.col(s) < F.col(t)
        a = {x: F.when(swap, F.col(f"{s}{x}")).otherwise(F.col(f"{t}{x}")) for x in "xyz"}
        b = {x: F.when(swap, F.col(f"{t}{x}")).otherwise(F.col(f"{s}{x}")) for x in "xyz"}
        ha, hb = F.when(swap, h[s]).otherwise(h[t]), F.when(swap, h[t]).otherwise(h[s])
        share = F.try_divide(level - ha, hb - ha)
        point = [(a[x] + (b[x] - a[x]) * share).alias(x) for x in "xyz"]
        return F.when(above[s] != above[t], F.struct(F.least(s, t).alias("lo"), F.greatest(s, t).alias("hi"), *point))

    cuts = F.filter(F.array(cut("a", "b"), cut("b", "c"), cut("c", "a")), lambda s: s.isNotNull())
    flat = (h["a"] == level) & (h["b"] == level) & (h["c"] == level)
    out = c.select("mesh_id", "fid", "plane", "level", flat.alias("flat"), cuts.alias("cuts"))
    return out.filter((F.size("cuts") == 2) | F.col("flat")).select("mesh_id", "fid", "plane", "level", "flat", F.get("cuts", 0).alias("p"), F.get("cuts", 1).alias("q"))


def segment_chains(segments: DataFrame, by: Sequence[str]) -> DataFrame:
    """``*by, start, second, position, closed, end`` of polylines from undirected ``segments``: their ends
    ``p`` and ``q`` are structs whose equality joins them, within each group ``by``.

    A row per point.  A place where other than two segments meet ends its chains.  Every segment is walked
    in both directions; of the two copies of a chain the one stays that starts at the smaller end, or, if
    the chain is closed, goes from its smallest end to the smaller of that end's neighbours; a closed chain
    repeats its first point at the end.
    """
    numbered = settle(segments.select(*by, "p", "q").withColumn("sid", F.monotonically_increasing_id()))
    ways = F.array(F.struct((F.col("sid") * 2).alias("node"), F.col("p").alias("s"), F.col("q").alias("t")), F.struct((F.col("sid") * 2 + 1).alias("node"), F.col("q").alias("s"), F.col("p").alias("t")))
    arcs = settle(numbered.select(*by, F.explode(ways).alias("w")).select(*by, "w.*"))
    # Where two segments meet, each way in has one way out that does not turn back.
    out = arcs.groupBy(*by, F.col("s").alias("t")).agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("one"), F.max("node").alias("two")).filter("n = 2")
    back = F.col("node").bitwiseXOR(F.lit(1))
    follow = arcs.join(out, [*by, "t"], "left").select("node", F.when(F.col("one") == back, F.col("two")).otherwise(F.col("one")).alias("next"))
    placed = settle(chain_order(follow).join(arcs, "node"))
    # Closed chains are numbered from their smallest arc; here they begin at their smallest end.
    chains = placed.groupBy("chain").agg(F.count(F.lit(1)).alias("size"), F.min_by("position", F.struct("s", "position")).alias("shift"))
    placed = placed.join(chains, "chain").withColumn("position", F.when(F.col("closed"), F.pmod(F.col("position") - F.col("shift"), F.col("size"))).otherwise(F.col("position")))
    at = lambda c, n: F.max(F.when(F.col("position") == n, F.col(c)))
    named = placed.groupBy("chain").agg(at("s", F.lit(0)).alias("start"), at("t", F.lit(0)).alias("second"), at("s", F.col("size") - 1).alias("last"), at("t", F.col("size") - 1).alias("stop"))
    # Of one segment's two copies the first end decides; of others the end, or the neighbour of the start.
    chosen = named.filter((F.col("start") < F.col("stop")) | (F.col("start") == F.col("stop")) & (F.col("second") <= F.col("last")))
    points = placed.drop("closed").join(chosen.select("chain", "start", "second", (F.col("start") == F.col("stop")).alias("closed")), "chain")
    tail = points.filter(F.col("position") == F.col("size") - 1).select(*by, "start", "second", F.col("size").alias("position"), "closed", F.col("t").alias("end"))
    return points.select(*by, "start", "second", "position", "closed", F.col("s").alias("end")).unionByName(tail)


def slice_polylines(vertices: DataFrame, faces: DataFrame, heights: Sequence[float], normal: Sequence[float] = (0.0, 0.0, 1.0)) -> DataFrame:
    """``mesh_id, plane, start_lo, start_hi, position, closed, lo, hi, x, y, z``: the polylines in which
    planes n.p = d cut each mesh, a row per point.  ``lo, hi`` is the mesh edge that holds the point, and
    the edge of its first point names a polyline.  Faces in a plane bring no segment."""
    cut = slice_mesh(vertices, faces, heights, normal=normal).filter(~F.col("flat") & F.col("p").isNotNull())
    # Neighbouring faces cut their common edge at the same point, so equal edges have equal structs.
    rows = segment_chains(cut, ["mesh_id", "plane"])
    return rows.select("mesh_id", "plane", F.col("start.lo").alias("start_lo"), F.col("start.hi").alias("start_hi"), "position", "closed", "end.lo", "end.hi", "end.x", "end.y", "end.z")


# -- subdivision, sampling, smoothing ------------------------------------------------------------
def _edge_table(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """``lo, hi`` with end coordinates, opposite corners' coordinate sum and number of faces."""
    at = lambda p: vertices.select(F.col("vid").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in "xyz"])
    wings = half_edges(faces).join(at("w"), "w").groupBy("mesh_id", F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"w_{c}").alias(f"s{c}") for c in "xyz"])
    return wings.join(at("lo"), "lo").join(at("hi"), "hi")


def subdivide_loop(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One Loop step: four faces per face.  Interior edges use 3/8 and 1/8, borders the midpoint;
    vertices use Loop's valence weight, borders 3/4 and 1/8."""
    import math
    top = vertices.agg(F.max("vid")).first()[0]
    e = _edge_table(vertices, faces)
    key = F.concat_ws("-", F.lpad("lo", 20, "0"), F.lpad("hi", 20, "0"))
    e = settle(e.withColumn("key", key))
    e = settle(e.join(dense_ids(e, "key", "n_id"), "key").withColumn("mid", F.col("n_id") + 1 + F.lit(top)))
    inner = F.col("n") == 2
    spot = [F.when(inner, (F.col(f"lo_{c}") + F.col(f"hi_{c}")) * 0.375 + F.col(f"s{c}") * 0.125).otherwise((F.col(f"lo_{c}") + F.col(f"hi_{c}")) * 0.5).alias(c) for c in "xyz"]
    mids = e.select("mesh_id", F.col("mid").alias("vid"), *spot)
    ends = e.select("n", F.explode(F.array(*[F.struct(F.col(p).alias("vid"), *[F.col(f"{q}_{c}").alias(f"o{c}") for c in "xyz"]) for p, q in (("lo", "hi"), ("hi", "lo"))])).alias("s")).select("n", "s.*")
    near = ends.groupBy("vid").agg(
        F.count(F.lit(1)).alias("valence"), F.sum((F.col("n") == 1).cast("int")).alias("borders"), *[F.sum(f"o{c}").alias(f"t{c}") for c in "xyz"],
        *[F.sum(F.when(F.col("n") == 1, F.col(f"o{c}")).otherwise(0.0)).alias(f"b{c}") for c in "xyz"])
    turn = F.lit(0.375) + F.cos(F.lit(2 * math.pi) / F.col("valence")) * 0.25
    beta = (F.lit(0.625) - turn * turn) / F.col("valence")
    moved = vertices.join(near, "vid", "left").select("mesh_id", "vid", *[
        F.when(F.col("valence").isNull(), F.col(c)).when(F.col("borders") > 0, F.col(c) * 0.75 + F.col(f"b{c}") * 0.125)
        .otherwise(F.col(c) * (F.lit(1.0) - F.col("valence") * beta) + F.col(f"t{c}") * beta).alias(c) for c in "xyz"])
    named = half_edges(faces).select("fid", "mesh_id", "u", "v", F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).join(e.select("lo", "hi", "mid"), ["lo", "hi"])
    six = faces.select("fid", "a", "b", "c").join(named, "fid").groupBy("mesh_id", "fid", "a", "b", "c").agg(*[
        F.max(F.when((F.col("u") == F.col(p)) & (F.col("v") == F.col(q)), F.col("mid"))).alias(p + q) for p, q in ("ab", "bc", "ca")])
    four = F.array(*[F.struct(F.lit(i).alias("i"), F.col(x).alias("a"), F.col(y).alias("b"), F.col(z).alias("c")) for i, (x, y, z) in enumerate(
        [("a", "ab", "ca"), ("ab", "b", "bc"), ("ca", "bc", "c"), ("ab", "bc", "ca")])])
    out = six.select("mesh_id", "fid", F.explode(four).alias("t")).select("mesh_id", (F.col("fid") * 4 + F.col("t.i")).alias("fid"), "t.a", "t.b", "t.c")
    return moved.unionByName(mids), out


def subdivide_catmull_clark(vertices: DataFrame, polygons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One Catmull-Clark step on ``mesh_id, fid, corners``: one quad per corner.

    Face points are corner means; edge points average the ends and the two face points (midpoints on
    borders); a vertex of valence n moves to (Q + 2R + (n - 3)S) / n, on borders to 3/4 and 1/8.
    """
    c = polygons.select("mesh_id", "fid", F.size("corners").alias("m"), F.posexplode("corners").alias("pos", "vid"), "corners")
    nxt = lambda k: F.element_at("corners", (F.pmod(F.col("pos") + k, F.col("m")) + 1).cast("int"))
    ring = settle(c.select("mesh_id", "fid", "pos", "vid", nxt(1).alias("after"), nxt(-1).alias("before")))
    spot = vertices.select("vid", "x", "y", "z")
    top = vertices.agg(F.max("vid")).first()[0]
    faces = ring.join(spot, "vid").groupBy("mesh_id", "fid").agg(*[F.avg(a).alias(f"f{a}") for a in "xyz"])
    faces = settle(faces.join(dense_ids(faces, "fid", "n_id"), "fid").withColumn("face_point", F.col("n_id") + 1 + F.lit(top)))
    base = top + 1 + faces.count()
    sides = ring.join(faces.select("fid", "fx", "fy", "fz"), "fid").groupBy("mesh_id", F.least("vid", "after").alias("lo"), F.greatest("vid", "after").alias("hi")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"f{a}").alias(f"s{a}") for a in "xyz"])
    at = lambda p: spot.select(F.col("vid").alias(p), *[F.col(a).alias(f"{p}_{a}") for a in "xyz"])
    edges = settle(sides.join(at("lo"), "lo").join(at("hi"), "hi").withColumn("key", F.concat_ws("-", F.lpad("lo", 20, "0"), F.lpad("hi", 20, "0"))))
    edges = settle(edges.join(dense_ids(edges, "key", "n_id"), "key").withColumn("edge_point", F.col("n_id") + F.lit(base)))
    ends = lambda a: F.col(f"lo_{a}") + F.col(f"hi_{a}")
    edge_points = edges.select("mesh_id", F.col("edge_point").alias("vid"), *[F.when(F.col("n") == 2, (ends(a) + F.col(f"s{a}")) / 4).otherwise(ends(a) / 2).alias(a) for a in "xyz"])
    spokes = edges.select("n", F.explode(F.array(*[F.struct(F.col(p).alias("vid"), *[F.col(f"{q}_{a}").alias(f"o{a}") for a in "xyz"], *[(ends(a) / 2).alias(f"h{a}") for a in "xyz"])
                                                   for p, q in (("lo", "hi"), ("hi", "lo"))])).alias("s")).select("n", "s.*")
    around = spokes.groupBy("vid").agg(F.count(F.lit(1)).alias("valence"), F.sum((F.col("n") == 1).cast("int")).alias("borders"), *[F.avg(f"h{a}").alias(f"r{a}") for a in "xyz"],
                                       *[F.sum(F.when(F.col("n") == 1, F.col(f"o{a}")).otherwise(0.0)).alias(f"b{a}") for a in "xyz"])
    means = ring.join(faces.select("fid", "fx", "fy", "fz"), "fid").groupBy("vid").agg(*[F.avg(f"f{a}").alias(f"q{a}") for a in "xyz"])
    n = F.col("valence")
    moved = vertices.join(around, "vid", "left").join(means, "vid", "left").select("mesh_id", "vid", *[
        F.when(n.isNull(), F.col(a)).when(F.col("borders") > 0, F.col(a) * 0.75 + F.col(f"b{a}") * 0.125)
        .otherwise(F.try_divide(F.col(f"q{a}") + F.col(f"r{a}") * 2 + F.col(a) * (n - 3), n)).alias(a) for a in "xyz"])
    name = lambda p, q, out: (F.least(p, q), F.greatest(p, q), out)
    quads = ring.join(faces.select("fid", "face_point"), "fid")
    for p, q, out in (("vid", "after", "e1"), ("before", "vid", "e2")):
        lo, hi, new = name(p, q, out)
        quads = quads.withColumn("lo", lo).withColumn("hi", hi).join(edges.select("lo", "hi", F.col("edge_point").alias(new)), ["lo", "hi"]).drop("lo", "hi")
    out = quads.select("mesh_id", "fid", "pos", F.array("vid", "e1", "face_point", "e2").alias("corners"))
    return moved.unionByName(faces.select("mesh_id", F.col("face_point").alias("vid"), *[F.col(f"f{a}").alias(a) for a in "xyz"])).unionByName(edge_points), out


def sample_surface(vertices: DataFrame, faces: DataFrame, spacing: float) -> DataFrame:
    """``fid, i, j, x, y, z``: a barycentric lattice per face, fine enough that every point of the
    face is within ``spacing`` of a sample."""
    return sample_faces(corners(vertices, faces), spacing)


def sample_faces(c: DataFrame, spacing: float) -> DataFrame:
    """``sample_surface`` of faces that have their corners' coordinates."""
    longest = F.sqrt(F.greatest(v.dist2(A, B), v.dist2(B, C), v.dist2(C, A)))
    c = c.withColumn("steps", F.greatest(F.ceil(longest / spacing), F.lit(1)).cast("int"))
    rows = c.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("steps")))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("steps") - F.col("i"))))
    s, t = F.col("i") / F.col("steps"), F.col("j") / F.col("steps")
    return rows.select("mesh_id", "fid", "i", "j", *[(a + (b - a) * s + (d - a) * t).alias(x) for a, b, d, x in zip(A, B, C, "xyz")])


def split_long_edges(vertices: DataFrame, faces: DataFrame, max_len: float) -> tuple[DataFrame, DataFrame]:
    """Bisect the longest edge of faces until no edge exceeds ``max_len``.

    Each round splits an edge only if it is the longest edge of every face around it, so at most one
    edge of a face is split and both its faces use the same new vertex.  Ties go by vertex ids.  The
    longest edge of the mesh is always split, so the loop ends.
    """
    verts, tris = vertices.select("mesh_id", "vid", "x", "y", "z"), faces.select("mesh_id", "fid", "a", "b", "c")
    while True:
        c = corners(verts, tris)
        edge = lambda p, q, s, t: F.struct(v.dist2(s, t).alias("d"), F.least(p, q).alias("lo"), F.greatest(p, q).alias("hi"))
        best = settle(c.select("mesh_id", "fid", "a", "b", "c", F.greatest(edge("a", "b", A, B), edge("b", "c", B, C), edge("c", "a", C, A)).alias("e")))
        long = best.filter(F.col("e.d") > max_len * max_len)
        if is_empty(long):
            return verts, tris
        use = half_edges(tris).groupBy(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).agg(F.count(F.lit(1)).alias("n"))
        votes = long.groupBy("mesh_id", F.col("e.lo").alias("lo"), F.col("e.hi").alias("hi")).agg(F.count(F.lit(1)).alias("votes"))
        agreed = settle(votes.join(use, ["lo", "hi"]).filter("votes = n").withColumn("key", F.concat_ws("-", F.lpad("lo", 20, "0"), F.lpad("hi", 20, "0"))))
        top, last = verts.agg(F.max("vid")).first()[0], tris.agg(F.max("fid")).first()[0]
        agreed = settle(agreed.join(dense_ids(agreed, "key", "n_id"), "key").withColumn("mid", F.col("n_id") + 1 + F.lit(top)).select("mesh_id", "lo", "hi", "mid"))
        at = lambda p: verts.select(F.col("vid").alias(p), *[F.col(x).alias(f"{p}_{x}") for x in "xyz"])  # noqa: B023, E731
        mids = agreed.join(at("lo"), "lo").join(at("hi"), "hi").select("mesh_id", F.col("mid").alias("vid"), *[((F.col(f"lo_{x}") + F.col(f"hi_{x}")) / 2).alias(x) for x in "xyz"])
        cut = best.select("mesh_id", "fid", "a", "b", "c", F.col("e.lo").alias("lo"), F.col("e.hi").alias("hi")).join(agreed.drop("mesh_id"), ["lo", "hi"], "left")
        # Rotate the split edge to (a, b).
        first = F.when(F.col("a").isin(F.col("lo"), F.col("hi")) & F.col("b").isin(F.col("lo"), F.col("hi")), 0).when(
            F.col("b").isin(F.col("lo"), F.col("hi")) & F.col("c").isin(F.col("lo"), F.col("hi")), 1).otherwise(2)
        ring = cut.withColumn("k", F.array("a", "b", "c")).withColumn("s", first)
        at3 = lambda i: F.element_at("k", ((F.col("s") + i) % 3 + 1).cast("int"))
        halves = F.array(F.struct(F.lit(0).alias("h"), at3(0).alias("a"), F.col("mid").alias("b"), at3(2).alias("c")),
                         F.struct(F.lit(1).alias("h"), F.col("mid").alias("a"), at3(1).alias("b"), at3(2).alias("c")))
        whole = F.array(F.struct(F.lit(0).alias("h"), F.col("a").alias("a"), F.col("b").alias("b"), F.col("c").alias("c")))
        new = ring.select("mesh_id", "fid", F.explode(F.when(F.col("mid").isNull(), whole).otherwise(halves)).alias("t"))
        numbered = new.filter("t.h = 1").select(F.col("fid").alias("old"))
        fresh = dense_ids(numbered, "old", "n_id")
        tris = settle(new.join(fresh.withColumnRenamed("old", "fid"), "fid", "left").select(
            "mesh_id", F.when(F.col("t.h") == 1, F.col("n_id") + 1 + F.lit(last)).otherwise(F.col("fid")).alias("fid"), "t.a", "t.b", "t.c"))
        verts = settle(verts.unionByName(mids))


def relax_tangential(vertices: DataFrame, faces: DataFrame, iterations: int) -> DataFrame:
    """Move interior vertices to the neighbour centroid within the tangent plane; borders stay."""
    verts = vertices
    links = settle(half_edges(faces).select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("s")).select("s.*").distinct())
    fixed = settle(border_edges(faces).select(F.explode(F.array("u", "v")).alias("vid")).distinct().withColumn("fixed", F.lit(True)))
    for _ in range(iterations):
        mean = links.join(verts.select(F.col("vid").alias("v"), "x", "y", "z"), "v").groupBy(F.col("u").alias("vid")).agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
        j = verts.join(mean, "vid", "left").join(vertex_normals(verts, faces), "vid", "left").join(fixed, "vid", "left")
        d, n = v.sub(v.vec("mx", "my", "mz"), v.vec("x", "y", "z")), v.vec("nx", "ny", "nz")
        stay = F.col("fixed").isNotNull() | F.col("mx").isNull()
        along = v.dot(d, n)
        verts = settle(j.select("mesh_id", "vid", *[F.when(stay, F.col(c)).otherwise(F.col(c) + q - m * along).alias(c) for c, q, m in zip("xyz", d, n)]))
    return verts


def smooth_shape(vertices: DataFrame, faces: DataFrame, step: float, iterations: int = 1) -> DataFrame:
    """Explicit cotangent-Laplacian steps; borders stay."""
    verts = vertices
    fixed = settle(border_edges(faces).select(F.explode(F.array("u", "v")).alias("vid")).distinct().withColumn("fixed", F.lit(True)))
    for _ in range(iterations):
        at = lambda p: verts.select(F.col("vid").alias(p), *[F.col(c).alias(f"{p}{c}") for c in "xyz"])  # noqa: B023, E731
        h = half_edges(faces).join(at("u"), "u").join(at("v"), "v").join(at("w"), "w")
        u, o, w = v.vec("ux", "uy", "uz"), v.vec("vx", "vy", "vz"), v.vec("wx", "wy", "wz")
        p, q = v.sub(u, w), v.sub(o, w)
        cot = F.try_divide(v.dot(p, q), v.norm(v.cross(p, q))) * 0.5
        h = h.withColumn("cot", F.when(v.norm(v.cross(p, q)) > 0, cot).otherwise(0.0))
        both = h.select("cot", F.explode(F.array(F.struct(F.col("u").alias("vid"), *[F.col(f"v{c}").alias(f"o{c}") for c in "xyz"]),
                                                 F.struct(F.col("v").alias("vid"), *[F.col(f"u{c}").alias(f"o{c}") for c in "xyz"]))).alias("s")).select("cot", "s.*")
        sums = both.groupBy("vid").agg(F.sum("cot").alias("w"), *[F.sum(F.col("cot") * F.col(f"o{c}")).alias(f"m{c}") for c in "xyz"])
        j = verts.join(sums, "vid", "left").join(fixed, "vid", "left")
        stay = F.col("fixed").isNotNull() | F.col("w").isNull() | (F.abs("w") < 1e-12)
        verts = settle(j.select("mesh_id", "vid", *[F.when(stay, F.col(c)).otherwise(F.col(c) + (F.col(f"m{c}") / F.col("w") - F.col(c)) * step).alias(c) for c in "xyz"]))
    return verts
