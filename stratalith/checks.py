"""Expectations: each returns the rows that violate an operator's contract; none means pass.

They work the answer out another way (a different predicate, a recount, an anti-join), never by
calling the operator again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import vectors as v
from .operators import mesh as ms


def check_knn(result: DataFrame, points: DataFrame, queries: DataFrame, k: int, coords: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Wrong count, unsorted ranks, or a distance that does not belong to the pair."""
    total = points.count()
    per = result.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rank").alias("ranks"))
    short = queries.select("query_id").join(per, "query_id", "left").filter((F.coalesce("n", F.lit(0)) != min(k, total)) | (F.col("ranks") != F.col("n")))
    p = points.select("id", *[F.col(c).alias(f"p_{c}") for c in coords])
    again = result.join(p, "id").join(queries.select("query_id", *coords), "query_id")
    true = F.sqrt(v.dist2(v.vec(*coords), v.vec(*[f"p_{c}" for c in coords])))
    off = again.filter(F.abs(true - F.col("distance")) > 1e-12 * F.greatest(true, F.lit(1.0)))
    later = result.select("query_id", (F.col("rank") - 1).alias("rank"), F.col("distance").alias("next"))
    unsorted = result.join(later, ["query_id", "rank"]).filter("next < distance")
    name = lambda df, what: df.select("query_id").distinct().withColumn("violation", F.lit(what))
    return name(short, "wrong_count").unionByName(name(off, "wrong_distance")).unionByName(name(unsorted, "unsorted"))


def check_closer_point(result: DataFrame, points: DataFrame, queries: DataFrame, k: int, coords: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Points strictly inside the ball of the worst selected neighbour that were not selected."""
    from .operators.boxes import box_join, with_box
    worst = result.groupBy("query_id").agg(F.max("d2").alias("w2")).filter("w2 > 0")
    ball = queries.join(worst, "query_id").select("query_id", "w2", *[F.col(c).alias(f"q_{c}") for c in coords])
    left = with_box(ball, "l", {c: F.col(f"q_{c}") - F.sqrt("w2") for c in coords}, {c: F.col(f"q_{c}") + F.sqrt("w2") for c in coords})
    right = with_box(points.select("id", *coords), "r", {c: F.col(c) for c in coords}, {c: F.col(c) for c in coords})
    inside = box_join(left, right, list(coords), "id").filter(v.dist2(v.vec(*[f"q_{c}" for c in coords]), v.vec(*coords)) < F.col("w2"))
    return inside.join(result.select("query_id", "id"), ["query_id", "id"], "left_anti").select("query_id", "id", F.lit("closer_point").alias("violation"))


def check_bbox(result: DataFrame, points: DataFrame, by: str, coords: Sequence[str]) -> DataFrame:
    """Points outside their box, and box faces that no point touches."""
    j = points.join(result.filter(F.col(by).isNotNull()), by)
    bad = F.lit(False)
    for c in coords:
        bad = bad | (F.col(c) < F.col(f"min_{c}")) | (F.col(c) > F.col(f"max_{c}"))
    touch = j.groupBy(by).agg(*[F.max((F.col(c) == F.col(f"{e}_{c}"))).alias(f"{e}_{c}") for c in coords for e in ("min", "max")])
    loose = F.lit(False)
    for c in coords:
        loose = loose | ~F.col(f"min_{c}") | ~F.col(f"max_{c}")
    return j.filter(bad).select(by, F.lit("outside").alias("violation")).unionByName(touch.filter(loose).select(by, F.lit("loose_face").alias("violation")))


def check_submultiset(result: DataFrame, source: DataFrame) -> DataFrame:
    return result.exceptAll(source.select(*result.columns)).withColumn("violation", F.lit("not_in_source"))


def check_hull(hull: DataFrame, points: DataFrame, by: str) -> DataFrame:
    """Points to the right of a hull edge, and corners that do not turn left."""
    size = hull.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    at = lambda shift, p: hull.join(size, by).select(by, F.pmod(F.col("seq") - shift, F.col("n")).alias("seq"), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))
    edges = at(0, "a").join(at(1, "b"), [by, "seq"])
    turn = edges.join(at(2, "c"), [by, "seq"]).filter(v.orient2(v.vec("ax", "ay"), v.vec("bx", "by"), v.vec("cx", "cy")) <= 0)
    out = edges.join(points.select(by, "x", "y"), by).filter(v.orient2(v.vec("ax", "ay"), v.vec("bx", "by"), v.vec("x", "y")) < 0)
    return turn.select(by, F.lit("not_left_turn").alias("violation")).unionByName(out.select(by, F.lit("outside").alias("violation")))


def check_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that join two labels; labels that are not their smallest member."""
    a = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    b = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    split = edges.select("a", "b").join(a, "a").join(b, "b").filter("ca <> cb").select(F.col("a").alias("node"), F.lit("edge_joins_two").alias("violation"))
    least = labels.groupBy("component").agg(F.min("node").alias("node")).filter("component <> node").select("node", F.lit("not_smallest").alias("violation"))
    return split.unionByName(least)


def check_paths(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with d(v) > d(u) + length."""
    both = edges.select("a", "b", "length").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "length"))
    u, w = paths.select(F.col("node").alias("a"), F.col("distance").alias("du")), paths.select(F.col("node").alias("b"), F.col("distance").alias("dv"))
    j = both.join(u, "a").join(w, "b", "left")
    return j.filter(F.col("dv").isNull() | (F.col("dv") > F.col("du") + F.col("length") + 1e-9)).select("a", "b", F.lit("shorter_path").alias("violation"))


def check_mesh_edges(faces: DataFrame) -> DataFrame:
    """Edges used twice in one direction."""
    return ms.half_edges(faces).groupBy("u", "v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("violation", F.lit("edge_used_twice"))


def check_weights(weights: DataFrame, points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Weights that do not sum to 1 or do not reproduce the point."""
    ring = polygons.filter("ring = 0").select("poly_id", "seq", F.col("x").alias("vx"), F.col("y").alias("vy"))
    s = weights.join(ring, ["poly_id", "seq"]).groupBy("id", "poly_id").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("vx")).alias("sx"), F.sum(F.col("weight") * F.col("vy")).alias("sy"))
    j = s.join(points.select("id", "x", "y"), "id")
    return j.filter((F.abs(F.col("w") - 1) > 1e-9) | (F.abs(F.col("sx") - F.col("x")) > 1e-6) | (F.abs(F.col("sy") - F.col("y")) > 1e-6)).select("id", "poly_id", F.lit("wrong_weights").alias("violation"))


def check_balls(balls: DataFrame, points: DataFrame, by: str, eps: float, coords: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Points outside the upper ball, and bounds that are further apart than promised."""
    c = tuple(F.element_at("centre", i + 1) for i in range(len(coords)))
    out = points.join(balls, by).filter(F.sqrt(v.dist2(v.vec(*coords), c)) > F.col("upper_radius") * (1 + 1e-9)).select(by, F.lit("outside").alias("violation"))
    return out.unionByName(balls.filter(F.col("upper_radius") > (1 + eps) * F.col("lower_radius") * (1 + 1e-9)).select(by, F.lit("loose_bounds").alias("violation")))


def check_edge_bound(vertices: DataFrame, faces: DataFrame, max_len: float) -> DataFrame:
    c = ms.corners(vertices, faces)
    longest = F.greatest(v.dist2(ms.A, ms.B), v.dist2(ms.B, ms.C), v.dist2(ms.C, ms.A))
    return c.filter(longest > max_len * max_len * (1 + 1e-12)).select("fid", F.lit("edge_too_long").alias("violation"))
