"""Local fits over neighbourhoods, registration, covering, ball graphs and grid simplification."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import linear
from ..functions import vectors as v
from ..session import is_empty, settle
from .graph import connected_components, parity
from .mesh import _remap, corners, face_normals
from .neighbors import knn_join
from .points import affine_transform
from .skew import salted_join


def _neighbourhoods(points: DataFrame, k: int) -> DataFrame:
    """``query_id, d2, x, y, z`` of the k nearest points (itself included)."""
    near = knn_join(points, points.select(F.col("id").alias("query_id"), "x", "y", "z"), k)
    return near.join(points.select("id", "x", "y", "z"), "id")


def _covariance(rows: DataFrame) -> DataFrame:
    mean = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("d2").alias("reach2"), *[F.avg(c).alias(f"m{c}") for c in "xyz"])
    return rows.join(mean, "query_id").groupBy("query_id", "n", "reach2", "mx", "my", "mz").agg(
        *linear.moments(None, v.vec("x", "y", "z"), v.vec("mx", "my", "mz"))).withColumn("e", linear.eigh3(*linear.SYMMETRIC))


def estimate_normals(points: DataFrame, k: int) -> DataFrame:
    """Unit normal of the plane through each point's k neighbours; the first nonzero part is positive."""
    e = _covariance(settle(_neighbourhoods(points, k)))
    n = v.vec("e.nx", "e.ny", "e.nz")
    lead = F.when(F.abs(n[2]) > 1e-12, n[2]).when(F.abs(n[1]) > 1e-12, n[1]).otherwise(n[0])
    flip = F.when(lead < 0, -1.0).otherwise(1.0)
    return e.select(F.col("query_id").alias("id"), *[(c * flip).alias(f"n{x}") for c, x in zip(n, "xyz")])


def local_roughness(points: DataFrame, k: int) -> DataFrame:
    """Per point, the RMS distance of its neighbourhood to its own plane, and the k-th distance."""
    e = _covariance(settle(_neighbourhoods(points, k)))
    return e.select(F.col("query_id").alias("id"), F.sqrt(F.greatest(F.col("e.l0"), F.lit(0.0)) / F.col("n")).alias("roughness"), F.sqrt("reach2").alias("kth_distance"))


def local_linear_interpolation(sites: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Weighted linear fit over the k nearest sites; linear fields are reproduced exactly."""
    near = knn_join(sites.withColumnRenamed("site_id", "id"), queries.select("query_id", "x", "y"), k, ("x", "y"))
    j = near.join(sites.select(F.col("site_id").alias("id"), F.col("x").alias("sx"), F.col("y").alias("sy"), "value"), "id").join(queries.select("query_id", "x", "y"), "query_id")
    dx, dy, w = F.col("sx") - F.col("x"), F.col("sy") - F.col("y"), F.lit(1.0) / (F.col("d2") + 1e-9)
    basis: list[Column] = [F.lit(1.0), dx, dy]
    sums = j.groupBy("query_id").agg(F.array(*[F.sum(w * p * q) for p in basis for q in basis]).alias("a"), F.array(*[F.sum(w * p * F.col("value")) for p in basis]).alias("b"))
    return sums.select("query_id", F.get(linear.least_squares("a", "b"), 0).alias("value"))


def register(moving: DataFrame, reference: DataFrame, iterations: int) -> tuple[DataFrame, list[list[float]]]:
    """Rigid transform by iterated closest points; only the sixteen sums of a round reach the driver."""
    total = np.hstack([np.eye(3), np.zeros((3, 1))])
    here = moving
    for _ in range(iterations):
        near = knn_join(reference, here.select(F.col("id").alias("query_id"), "x", "y", "z"), 1)
        j = near.join(here.select(F.col("id").alias("query_id"), *[F.col(c).alias(f"p{c}") for c in "xyz"]), "query_id").join(reference.select("id", *[F.col(c).alias(f"q{c}") for c in "xyz"]), "id")
        r = j.agg(*[F.avg(f"p{c}").alias(f"p{c}") for c in "xyz"], *[F.avg(f"q{c}").alias(f"q{c}") for c in "xyz"], *[F.avg(F.col(f"p{a}") * F.col(f"q{b}")).alias(a + b) for a in "xyz" for b in "xyz"]).first()
        p, q = np.array([r[f"p{c}"] for c in "xyz"]), np.array([r[f"q{c}"] for c in "xyz"])
        u, _, vt = np.linalg.svd(np.array([[r[a + b] for b in "xyz"] for a in "xyz"]) - np.outer(p, q))
        turn = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))]) @ u.T
        step = np.hstack([turn, (q - turn @ p)[:, None]])
        total = np.hstack([turn @ total[:, :3], (turn @ total[:, 3:] + step[:, 3:])])
        here = settle(affine_transform(here, step.tolist(), ("x", "y", "z")))
    return here, total.tolist()


def radius_components(points: DataFrame, reach: float, coords: Sequence[str]) -> DataFrame:
    """``node, component`` of points linked at distance <= ``reach``.

    Cells are so small that all points of one cell are linked, so a cell is one graph node.  Two
    cells are linked without looking at points when the bounds of their contents decide; only
    undecided pairs compare points.
    """
    d = len(coords)
    side = reach / d ** 0.5 * (1 - 1e-9)
    cells = [f"_g{i}" for i in range(d)]
    placed = settle(points.select("id", *coords, *[F.floor(F.col(c) / side).alias(g) for c, g in zip(coords, cells)]))
    nodes = settle(placed.groupBy(*cells).agg(F.min("id").alias("node"), *[f(c).alias(f"{n}{c}") for c in coords for n, f in (("lo", F.min), ("hi", F.max))]))
    span = int(np.ceil(d ** 0.5 * (1 + 1e-9))) + 1
    left = nodes.select(F.col("node").alias("a"), *[F.col(f"{n}{c}").alias(f"a{n}{c}") for c in coords for n in ("lo", "hi")], *cells)
    for g in cells:
        left = left.withColumn(g, F.explode(F.sequence(F.col(g) - span, F.col(g) + span)))
    pairs = left.join(nodes, cells).filter(F.col("a") < F.col("node"))
    gap: Column = F.lit(0.0)
    far: Column = F.lit(0.0)
    for c in coords:
        g = F.greatest(F.col(f"alo{c}") - F.col(f"hi{c}"), F.col(f"lo{c}") - F.col(f"ahi{c}"), F.lit(0.0))
        f = F.greatest(F.col(f"ahi{c}") - F.col(f"lo{c}"), F.col(f"hi{c}") - F.col(f"alo{c}"))
        gap, far = gap + g * g, far + f * f
    limit = reach * reach
    pairs = settle(pairs.withColumn("far", far).filter(gap <= limit).select("a", F.col("node").alias("b"), (F.col("far") <= limit).alias("sure")))
    named = settle(placed.join(nodes.select("node", *cells), cells).select("id", "node", *coords))
    unsure = pairs.filter(~F.col("sure")).select("a", "b")
    one = salted_join(unsure, named.select(F.col("node").alias("a"), *[F.col(c).alias(f"a{c}") for c in coords]), ["a"], f"a{coords[0]}")
    two = salted_join(one, named.select(F.col("node").alias("b"), *coords), ["b"], coords[0])
    close = two.filter(v.dist2(v.vec(*[f"a{c}" for c in coords]), v.vec(*coords)) <= limit).select("a", "b").distinct()
    links = pairs.filter("sure").select("a", "b").unionByName(close)
    cc = connected_components(links, nodes.select("node"))
    return named.join(cc, "node").groupBy("component").agg(F.min("id").alias("least")).join(cc, "component").join(named, "node").select(F.col("id").alias("node"), F.col("least").alias("component"))


def interval_centers(points: DataFrame, p: int, by: str) -> DataFrame:
    """Smallest radius so that p intervals cover all x of a group; all groups share every job.

    A test starts at the smallest x and jumps p times to the first x beyond the cover.  A radius that
    fits is at once lowered to half the longest interval really used, so the answer is always half
    the difference of two points and is exact when the bracket has closed, which halving ends in a bounded number of rounds.
    """
    state = settle(points.groupBy(by).agg(F.min("x").alias("first"), F.max("x").alias("last"))
                   .withColumn("lo", F.lit(-1e-300)).withColumn("hi", (F.col("last") - F.col("first")) / 2))
    while True:
        at = state.withColumn("r", F.greatest((F.col("lo") + F.col("hi")) / 2, F.lit(0.0))).withColumn("start", F.col("first")).withColumn("used", F.lit(0.0)).withColumn("end", F.col("first"))
        for _ in range(p):
            cover = F.col("start") + 2 * F.col("r")
            step = points.join(at.select(by, "start", "r"), by).groupBy(by).agg(
                F.max(F.when(F.col("x") <= cover, F.col("x"))).alias("e"), F.min(F.when(F.col("x") > cover, F.col("x"))).alias("n"))
            at = at.join(step, by).withColumn("used", F.greatest("used", F.col("e") - F.col("start"))).withColumn("end", F.col("e")).withColumn(
                "start", F.coalesce("n", F.col("e"))).drop("e", "n")
        fits = F.col("end") >= F.col("last")
        state = settle(at.select(by, "first", "last", F.when(fits, F.col("lo")).otherwise(F.col("r")).alias("lo"), F.when(fits, F.col("used") / 2).otherwise(F.col("hi")).alias("hi")))
        if is_empty(state.filter((F.col("hi") > 0) & (F.col("hi") - F.col("lo") > 1e-12 * F.col("hi")))):
            break
    return state.select(by, F.col("hi").alias("radius"))


def interval_assignment(points: DataFrame, p: int, by: str, ident: str = "id") -> DataFrame:
    """``by, ident, x, centre_number, centre, radius``: every point with the interval that covers it at the
    smallest radius that ``p`` intervals need, numbered along the line from 0.

    The first interval starts at a group's smallest x, each next one at the first x beyond the last; a
    group keeps at most ``p`` starts, which meet its points by a join on the group.
    """
    radii = settle(interval_centers(points.select(by, "x"), p, by))
    starts = radii.join(points.groupBy(by).agg(F.min("x").alias("s")), by).select(by, "radius", F.array("s").alias("starts"))
    for _ in range(p - 1):
        last = F.element_at("starts", -1)
        beyond = points.select(by, "x").join(starts.select(by, last.alias("s"), "radius"), by).filter(F.col("x") > F.col("s") + 2 * F.col("radius")).groupBy(by).agg(F.min("x").alias("n"))
        starts = settle(starts.join(beyond, by, "left").select(by, "radius", F.when(F.col("n").isNull(), F.col("starts")).otherwise(F.concat("starts", F.array("n"))).alias("starts")))
    number = F.size(F.filter("starts", lambda s: s <= F.col("x"))) - 1
    placed = salted_join(starts, points.select(by, ident, "x"), [by], ident)
    return placed.select(by, ident, "x", number.alias("centre_number"), (F.get("starts", number) + F.col("radius")).alias("centre"), "radius")


def smooth_jet(points: DataFrame, k: int, degree: int = 2) -> DataFrame:
    """Move each point onto the polynomial of degree 1 or 2 fitted to its k neighbours in its own
    tangent frame."""
    if degree not in (1, 2):
        raise ValueError("degree must be 1 or 2")
    rows = settle(_neighbourhoods(points, k))
    frame = settle(_covariance(rows).select("query_id", *[F.col(f"e.{a}{c}").alias(a + c) for a in "np" for c in "xyz"]))
    j = rows.join(frame, "query_id").join(points.select(F.col("id").alias("query_id"), *[F.col(c).alias(f"o{c}") for c in "xyz"]), "query_id")
    n, p = v.vec("nx", "ny", "nz"), v.vec("px", "py", "pz")
    d = v.sub(v.vec("x", "y", "z"), v.vec("ox", "oy", "oz"))
    j = j.withColumns({"u": v.dot(d, p), "w": v.dot(d, v.cross(n, p)), "h": v.dot(d, n)})
    u, w = F.col("u"), F.col("w")
    basis = [F.lit(1.0), u, w, u * u, u * w, w * w][:3 if degree == 1 else 6]
    own = ["ox", "oy", "oz", "nx", "ny", "nz"]
    sums = j.groupBy("query_id", *own).agg(F.array(*[F.sum(a * b) for a in basis for b in basis]).alias("a"), F.array(*[F.sum(a * F.col("h")) for a in basis]).alias("b"))
    lift = sums.withColumn("c", F.get(linear.least_squares("a", "b"), 0))
    return lift.select(F.col("query_id").alias("id"), *[(F.col(f"o{c}") + F.col(f"n{c}") * F.col("c")).alias(c) for c in "xyz"])


def smooth_bilateral(points: DataFrame, k: int, degrees: float) -> DataFrame:
    """Move points with normals along their normal by the mean height of their neighbours, weighted
    by distance and by how far the normals differ; ``moved`` is the length of the move."""
    near = knn_join(points, points.select(F.col("id").alias("query_id"), "x", "y", "z"), k)
    reach = near.groupBy("query_id").agg(F.max("d2").alias("r2"))
    j = near.join(reach, "query_id").join(points.select("id", *[F.col(c).alias(f"q{c}") for c in ("x", "y", "z", "nx", "ny", "nz")]), "id") \
        .join(points.withColumnRenamed("id", "query_id").select("query_id", "x", "y", "z", "nx", "ny", "nz"), "query_id")
    n = v.vec("nx", "ny", "nz")
    turn = (F.lit(1.0) - v.dot(n, v.vec("qnx", "qny", "qnz"))) / (1.0 - float(np.cos(np.radians(degrees))))
    w = F.exp(-F.col("d2") / F.greatest("r2", F.lit(1e-300))) * F.exp(-turn * turn)
    h = v.dot(n, v.sub(v.vec("qx", "qy", "qz"), v.vec("x", "y", "z")))
    g = j.groupBy("query_id", "x", "y", "z", "nx", "ny", "nz").agg((F.sum(w * h) / F.sum(w)).alias("s"))
    return g.select(F.col("query_id").alias("id"), *[(F.col(c) + F.col(f"n{c}") * F.col("s")).alias(c) for c in "xyz"], "nx", "ny", "nz", F.abs("s").alias("moved"))


def orient_normals(points: DataFrame, k: int) -> DataFrame:
    """Flip normals to agree along a minimum spanning forest of the k-nn graph (edge weight: how far
    the two normals are from parallel).  ``component`` tells which points were reached together."""
    near = knn_join(points, points.select(F.col("id").alias("query_id"), "x", "y", "z"), k + 1).filter("id <> query_id")
    side = lambda p: points.select(F.col("id").alias(p), *[F.col(f"n{c}").alias(f"{p}{c}") for c in "xyz"])
    pairs = near.select(F.least("id", "query_id").alias("a"), F.greatest("id", "query_id").alias("b")).distinct().join(side("a"), "a").join(side("b"), "b")
    agree = v.dot(v.vec("ax", "ay", "az"), v.vec("bx", "by", "bz"))
    edges = settle(pairs.select("a", "b", (F.lit(1.0) - F.abs(agree)).alias("w"), (agree < 0).cast("int").alias("differ")))
    nodes = points.select(F.col("id").alias("node"))
    labels = settle(nodes.select("node", F.col("node").alias("component")))
    tree, open_ = edges.limit(0), edges
    while True:
        at = lambda p: labels.select(F.col("node").alias(p), F.col("component").alias(f"c{p}"))  # noqa: B023, E731
        open_ = settle(open_.select("a", "b", "w", "differ").join(at("a"), "a").join(at("b"), "b").filter("ca <> cb"))
        if is_empty(open_):
            break
        offer = F.struct("w", "a", "b", "differ", "ca", "cb")
        ends = open_.select(F.explode(F.array("ca", "cb")).alias("c"), offer.alias("e"))
        chosen = settle(ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct())
        tree = tree.unionByName(chosen.select("a", "b", "w", "differ"))
        # Only the graph between components is labelled again, and it at least halves per round.
        joined = connected_components(chosen.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        labels = settle(labels.join(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
                        .select("node", F.coalesce("to", "component").alias("component")))
    par = parity(tree.select("a", "b", "differ"), nodes)
    flip = F.when(F.col("flip") == 1, -1.0).otherwise(1.0)
    return points.join(par.select(F.col("node").alias("id"), "component", "flip"), "id").select(
        "id", "x", "y", "z", *[(F.col(f"n{c}") * flip).alias(f"n{c}") for c in "xyz"], "component")


def normal_clusters(vertices: DataFrame, faces: DataFrame, k: int, iterations: int) -> tuple[DataFrame, list[float]]:
    """Lloyd rounds on face normals: ``fid, cluster, error`` and the total error per round
    (area times squared distance to the proxy).  Seeds are picked farthest first, starting at the
    largest face; only the k proxies are on the driver."""
    n = settle(face_normals(vertices, faces).filter("area > 0").select("fid", "area", "nx", "ny", "nz"))

    def scored(proxies: list[tuple[float, float, float]]) -> DataFrame:
        gaps = [F.struct(v.dist2(v.vec("nx", "ny", "nz"), v.const(p)).alias("d"), F.lit(i).alias("cluster")) for i, p in enumerate(proxies)]
        best = F.least(*gaps) if len(gaps) > 1 else gaps[0]
        return n.withColumn("s", best).select("fid", "area", "nx", "ny", "nz", "s.cluster", (F.col("area") * F.col("s.d")).alias("error"))

    first = n.agg(F.max(F.struct("area", (-F.col("fid")).alias("f"), "nx", "ny", "nz")).alias("m")).first()["m"]
    proxies = [(first["nx"], first["ny"], first["nz"])]
    while len(proxies) < k:
        m = scored(proxies).agg(F.max(F.struct("error", (-F.col("fid")).alias("f"), "nx", "ny", "nz")).alias("m")).first()["m"]
        if m["error"] <= 0:
            break
        proxies.append((m["nx"], m["ny"], m["nz"]))
    totals: list[float] = []
    for _ in range(iterations):
        sums = scored(proxies).groupBy("cluster").agg(F.sum("error").alias("e"), *[F.sum(F.col("area") * F.col(f"n{c}")).alias(c) for c in "xyz"]).collect()  # k rows
        totals.append(sum(r["e"] for r in sums))
        for r in sums:
            size = (r["x"] ** 2 + r["y"] ** 2 + r["z"] ** 2) ** 0.5
            if size > 0:
                proxies[r["cluster"]] = (r["x"] / size, r["y"] / size, r["z"] / size)
    return scored(proxies).select("fid", "cluster", "error"), totals


def cluster_simplify(vertices: DataFrame, faces: DataFrame, cell: float) -> tuple[DataFrame, DataFrame]:
    """Merge the vertices of each grid cell into the point that is closest to the planes of their
    faces (least squares, pulled slightly to the mean); collapsed and duplicate faces are dropped."""
    c = corners(vertices, faces)
    a, b, d = v.named("ax", "ay", "az"), v.named("bx", "by", "bz"), v.named("cx", "cy", "cz")
    n = v.cross(v.sub(b, a), v.sub(d, a))
    planes = c.select("a", "b", "c", *[e.alias(f"n{x}") for e, x in zip(n, "xyz")], v.dot(n, a).alias("o"))
    at = planes.select(F.explode(F.array("a", "b", "c")).alias("vid"), "nx", "ny", "nz", "o")
    cells = [F.floor(F.col(x) / cell).alias(f"g{x}") for x in "xyz"]
    placed = settle(vertices.select("mesh_id", "vid", "x", "y", "z", *cells))
    key = ["mesh_id", "gx", "gy", "gz"]
    mean = placed.groupBy(*key).agg(F.min("vid").alias("target"), *[F.avg(x).alias(f"m{x}") for x in "xyz"])
    nn = v.vec("nx", "ny", "nz")
    sums = at.join(placed.select("vid", *key), "vid").groupBy(*key).agg(F.array(*[F.sum(p * q) for p in nn for q in nn]).alias("qa"), F.array(*[F.sum(p * F.col("o")) for p in nn]).alias("qb"))
    pull = mean.join(sums, key, "left").withColumn("w", F.coalesce((F.get("qa", 0) + F.get("qa", 4) + F.get("qa", 8)) * 1e-3 + 1e-12, F.lit(1.0)))
    zero9, zero3 = F.array(*[F.lit(0.0)] * 9), F.array(*[F.lit(0.0)] * 3)
    qa, qb = F.coalesce("qa", zero9), F.coalesce("qb", zero3)
    am = F.array(*[F.get(qa, k) + (F.col("w") if k in (0, 4, 8) else 0.0) for k in range(9)])
    bm = F.array(*[F.get(qb, k) + F.col("w") * F.col(f"m{x}") for k, x in enumerate("xyz")])
    best = settle(pull.withColumn("a9", am).withColumn("b3", bm).withColumn("s", linear.least_squares("a9", "b3")))
    merged = _remap(faces, placed.join(best.select(*key, "target"), key).select("vid", "target")).filter("a <> b AND b <> c AND a <> c")
    keep = merged.groupBy("mesh_id", F.array_sort(F.array("a", "b", "c")).alias("k")).agg(F.min("fid").alias("fid"))
    out = settle(merged.join(keep.select("fid"), "fid", "left_semi"))
    points = best.select("mesh_id", F.col("target").alias("vid"), *[F.get("s", k).alias(x) for k, x in enumerate("xyz")])
    return points.join(out.select(F.explode(F.array("a", "b", "c")).alias("vid")), "vid", "left_semi"), out
