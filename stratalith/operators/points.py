"""Measures, simplification and enclosures of point sets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import linear
from ..functions import vectors as v
from ..session import is_empty, settle
from .neighbors import knn_join
from .ordering import rank_cut

UNIT_SCALE = {"mm": 1.0, "cm": 10.0, "m": 1000.0}  # fixed values: millimetres per unit


def normalize_units(df: DataFrame, value: str, unit: str, target: str) -> DataFrame:
    """Lengths to ``target`` and angles to radians; source value and unit stay beside the result."""
    table = F.create_map(*[F.lit(x) for pair in UNIT_SCALE.items() for x in pair])
    length = F.col(value) * table[F.col(unit)] / F.lit(UNIT_SCALE[target])
    angle = F.when(F.col(unit) == "deg", F.radians(value)).when(F.col(unit) == "rad", F.col(value))
    return df.withColumn("normalized", F.coalesce(angle, length)).withColumn(
        "normalized_unit", F.when(F.col(unit).isin("deg", "rad"), "rad")
        .when(F.col(unit).isin(*UNIT_SCALE), target))


# The numeric range in which point-set processing is accepted.
MIN_SPAN, MAX_COORDINATE, MAX_TRANSLATION_RATIO = 1e-100, 1e100, 1e6


def numeric_gate(points: DataFrame, coords: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per set: span, largest coordinate, their ratio, and whether the set is accepted."""
    ok: Column = F.lit(True)
    for c in coords:
        ok = ok & v.finite(F.col(c))
    bounds = points.groupBy(*by).agg(
        F.min(ok).alias("all_finite"),
        F.greatest(*[F.max(F.abs(F.col(c))) for c in coords]).alias("max_abs") if len(coords) > 1
        else F.max(F.abs(F.col(coords[0]))).alias("max_abs"),
        F.greatest(*[F.max(c) - F.min(c) for c in coords]).alias("span"))
    ratio = F.when(F.col("span") > 0, F.col("max_abs") / F.col("span"))
    passed = (F.col("all_finite") & (F.col("span") >= MIN_SPAN) & (F.col("max_abs") <= MAX_COORDINATE)
              & (ratio <= MAX_TRANSLATION_RATIO))
    return bounds.withColumn("ratio", ratio).withColumn("passed", F.coalesce(passed, F.lit(False)))


def affine_transform(points: DataFrame, matrix: Sequence[Sequence[float]], coords: Sequence[str],
                     is_vector: Column | None = None) -> DataFrame:
    """Apply a d x (d+1) matrix; rows where ``is_vector`` holds ignore the translation."""
    old = [F.col(c) for c in coords]
    shift = F.lit(1.0) if is_vector is None else F.when(is_vector, 0.0).otherwise(1.0)
    new = []
    for row in matrix:
        total = old[0] * float(row[0])
        for c, m in zip(old[1:], row[1:]):
            total = total + c * float(m)
        new.append(total + shift * float(row[-1]))
    return points.withColumns(dict(zip(coords, new)))


def bbox(points: DataFrame, coords: Sequence[str], by: str) -> DataFrame:
    """Bounds per set plus one row for all (``by`` is null there)."""
    return points.rollup(by).agg(
        F.count(F.lit(1)).alias("points"), *[F.min(c).alias(f"min_{c}") for c in coords],
        *[F.max(c).alias(f"max_{c}") for c in coords])


def affine_rank(points: DataFrame, by: str, coords: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """0 all equal, 1 on a line, 2 on a plane, 3 otherwise.

    Four aggregation passes: a base point, the point farthest from it, the largest cross product
    with that direction, the largest triple product with that normal.
    """
    p = v.vec(*coords)
    base = points.groupBy(by).agg(F.min(F.struct(*coords)).alias("_b"))
    b = v.vec(*[f"_b.{c}" for c in coords])
    with_base = points.join(base, by)
    line = with_base.groupBy(by).agg(F.max(F.struct(
        v.dist2(p, b).alias("m"), *[(q - r).alias(f"u{c}") for q, r, c in zip(p, b, coords)])).alias("_u"))
    with_line = with_base.join(line, by)
    u = v.vec(*[f"_u.u{c}" for c in coords])
    normal = v.cross(u, v.sub(p, b))
    plane = with_line.groupBy(by).agg(F.max(F.struct(
        v.norm2(normal).alias("m"), *[n.alias(f"n{c}") for n, c in zip(normal, coords)])).alias("_n"))
    n = v.vec(*[f"_n.n{c}" for c in coords])
    solid = with_line.join(plane, by).groupBy(by).agg(
        F.first("_u.m").alias("_m1"), F.first("_n.m").alias("_m2"), F.max(F.abs(v.dot(n, v.sub(p, b)))).alias("_m3"))
    rank = F.when(F.col("_m1") == 0, 0).when(F.col("_m2") == 0, 1).when(F.col("_m3") == 0, 2).otherwise(3)
    return solid.select(by, rank.alias("affine_rank"))


def _self_knn(points: DataFrame, k: int, coords: Sequence[str]) -> DataFrame:
    return knn_join(points, points.select(F.col("id").alias("query_id"), *coords), k, coords)


def point_spacing(points: DataFrame, k: int, coords: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Per point, the mean distance to its k+1 nearest points, itself included."""
    return _self_knn(points, k + 1, coords).groupBy("query_id").agg(
        (F.sum("distance") / F.lit(k + 1)).alias("spacing"))


def average_spacing(points: DataFrame, k: int, coords: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    return point_spacing(points, k, coords).agg(
        F.count(F.lit(1)).alias("points"), F.avg("spacing").alias("average_spacing"))


# -- simplification ---------------------------------------------------------------------------
def grid_simplify(points: DataFrame, cell: float, min_points: int = 1, coords: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """One point per cell that holds at least ``min_points``: the one nearest the cell centre."""
    cells = [F.floor(F.col(c) / cell).alias(f"c{c}") for c in coords]
    off2: Column = F.lit(0.0)
    for c in coords:
        gap = F.col(c) - (F.col(f"c{c}") + 0.5) * cell
        off2 = off2 + gap * gap
    placed = points.select("id", *coords, *cells)
    return placed.groupBy(*[f"c{c}" for c in coords]).agg(
        F.count(F.lit(1)).alias("cell_points"), F.min(F.struct(off2.alias("o"), "id", *coords)).alias("_best"),
    ).filter(F.col("cell_points") >= min_points).select("_best.id", *[f"_best.{c}" for c in coords], "cell_points")


def random_simplify(points: DataFrame, removed_percent: float, seed: int) -> DataFrame:
    """Keep exactly floor(n * (100 - percent) / 100) points, chosen by a seeded hash of the id."""
    n = points.count()
    keep = int(n * (100.0 - removed_percent) / 100.0)
    keyed = points.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))))
    return rank_cut(keyed, [F.col("_h"), F.col("id")], keep).drop("_h")


def outlier_measure(points: DataFrame, k: int, coords: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Mean squared distance to the k+1 nearest points, itself included."""
    return _self_knn(points, k + 1, coords).groupBy(F.col("query_id").alias("id")).agg(
        (F.sum("d2") / F.lit(k + 1)).alias("measure"))


def remove_outliers(points: DataFrame, k: int, percent: float, distance: float,
                    coords: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Keep the lowest measures: as many as lie under the distance, but never fewer than the
    percentage allows to remove."""
    measured = settle(outlier_measure(points, k, coords))
    counts = measured.agg(F.count(F.lit(1)).alias("n"),
                          F.sum((F.col("measure") < distance * distance).cast("bigint")).alias("good")).first()
    keep = min(counts["n"], max(counts["good"] or 0, int(counts["n"] * (100.0 - percent) / 100.0)))
    return rank_cut(measured, [F.col("measure"), F.col("id")], keep).join(points, "id")


def hierarchy_simplify(points: DataFrame, size: int, max_variation: float) -> DataFrame:
    """Split clusters by their principal plane until they are small and flat; one point is kept
    per cluster, the one nearest its centroid.  Clusters that cannot be split (all points equal)
    are final.  One level of the hierarchy per round until no cluster is open; every split leaves two
    smaller clusters, so the loop ends."""
    open_ = points.select("id", "x", "y", "z").withColumn("cluster", F.lit("r"))
    kept: list[DataFrame] = []
    while True:
        centre = open_.groupBy("cluster").agg(
            F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{c}") for c in "xyz"])
        centred = open_.join(centre, "cluster")
        moments = centred.groupBy("cluster", "n", "mx", "my", "mz").agg(
            *linear.moments(None, v.vec("x", "y", "z"), v.vec("mx", "my", "mz")))
        shape = moments.withColumn("e", linear.eigh3(*linear.SYMMETRIC))
        trace = F.col("e.l0") + F.col("e.l1") + F.col("e.l2")
        variation = F.when(trace > 0, F.try_divide(F.greatest(F.col("e.l0"), F.lit(0.0)), trace)).otherwise(0.0)
        stop = ((F.col("n") <= size) & (variation <= max_variation)) | (trace <= 0) | (F.col("n") == 1)
        shape = settle(shape.select("cluster", "mx", "my", "mz", "e.px", "e.py", "e.pz", stop.alias("stop")))
        marked = settle(open_.join(shape, "cluster"))
        away = v.dist2(v.vec("x", "y", "z"), v.vec("mx", "my", "mz"))
        kept.append(marked.filter("stop").groupBy("cluster").agg(
            F.count(F.lit(1)).alias("cluster_points"), F.min(F.struct(away.alias("o"), "id", "x", "y", "z")).alias("b"))
            .select("b.id", "b.x", "b.y", "b.z", "cluster_points"))
        side = v.dot(v.sub(v.vec("x", "y", "z"), v.vec("mx", "my", "mz")), v.vec("px", "py", "pz")) >= 0
        open_ = marked.filter(~F.col("stop")).select(
            "id", "x", "y", "z", F.concat("cluster", F.when(side, "1").otherwise("0")).alias("cluster"))
        if is_empty(open_):
            break
    out = kept[0]
    for table in kept[1:]:
        out = out.unionByName(table)
    return out


def multiset_subset(candidate: DataFrame, source: DataFrame) -> DataFrame:
    """One row: is ``candidate`` a sub-multiset of ``source`` by exact value, and how many are not."""
    return candidate.exceptAll(source).agg(F.count(F.lit(1)).alias("missing")).select(
        (F.col("missing") == 0).alias("is_subset"), "missing")


# -- enclosures ------------------------------------------------------------------------------
def _chain(points: np.ndarray) -> np.ndarray:
    """Strictly convex counter-clockwise hull of points sorted by x then y."""
    def half(rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in rows:
            while len(out) > 1 and ((out[-1][0] - out[-2][0]) * (p[1] - out[-2][1])
                                    - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0])) <= 0:
                out.pop()
            out.append(p)
        return out
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points
    # Only the lowest and highest point of a column can be a corner.
    xs, first = np.unique(points[:, 0], return_index=True)
    last = np.append(first[1:] - 1, len(points) - 1)
    low, high = half(points[first]), half(points[last][::-1])
    ring = low + high
    keep = [p for i, p in enumerate(ring) if i == 0 or not np.array_equal(p, ring[i - 1])]
    if len(keep) > 1 and np.array_equal(keep[0], keep[-1]):
        keep.pop()
    ring = np.array(keep)
    if len(ring) > 2:
        before, after = np.roll(ring, 1, 0), np.roll(ring, -1, 0)
        turn = ((ring[:, 0] - before[:, 0]) * (after[:, 1] - before[:, 1])
                - (ring[:, 1] - before[:, 1]) * (after[:, 0] - before[:, 0]))
        ring = ring[turn > 0] if (turn > 0).sum() > 2 else ring[turn != 0] if (turn != 0).any() else ring[[0, -1]]
    return ring


def convex_hull_2d(points: DataFrame, by: str, coords: Sequence[str] = ("x", "y"), fan_in: int = 64) -> DataFrame:
    """Strictly convex counter-clockwise ring per group: ``by, seq, x, y``.

    The points inside each group's octagon of extremes are dropped by expressions; what is left is
    hulled in salted pieces that are merged ``fan_in`` at a time, so no task sees a whole group
    until only hull corners of large pieces remain.
    """
    x, y = coords
    p = v.vec(x, y)
    slopes = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]
    ends = points.groupBy(by).agg(*[
        F.max(F.struct((p[0] * a + p[1] * b).alias("m"), x, y)).alias(f"_e{i}") for i, (a, b) in enumerate(slopes)])
    inside: Column = F.lit(True)
    for i in range(8):
        a, b = v.vec(f"_e{i}.{x}", f"_e{i}.{y}"), v.vec(f"_e{(i + 1) % 8}.{x}", f"_e{(i + 1) % 8}.{y}")
        same = (a[0] == b[0]) & (a[1] == b[1])
        inside = inside & (same | (v.orient2(a, b, p) > 1e-9 * (F.abs(p[0]) + F.abs(p[1]) + 1)))
    rim = points.join(ends, by).filter(~inside).select(by, *coords).distinct()
    schema = f"{by} {points.schema[by].dataType.simpleString()}, piece bigint, x double, y double"

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        ring = _chain(pdf[["x", "y"]].to_numpy(float))
        return pd.DataFrame({by: [pdf[by].iloc[0]] * len(ring), "piece": [int(pdf["piece"].iloc[0])] * len(ring),
                             "x": ring[:, 0], "y": ring[:, 1]})

    rim = settle(rim.select(by, F.col(x).alias("x"), F.col(y).alias("y")))
    biggest = rim.groupBy(by).count().agg(F.max("count")).first()[0] or 0
    pieces = max(1, -(-biggest // 50_000))
    cut = rim.withColumn("piece", F.pmod(F.xxhash64("x", "y"), F.lit(pieces)).cast("bigint"))
    while pieces > 1:
        cut = settle(cut.groupBy(by, "piece").applyInPandas(merge, schema))
        pieces = -(-pieces // fan_in)
        cut = cut.withColumn("piece", F.pmod("piece", F.lit(pieces)))

    def ordered(pdf: pd.DataFrame) -> pd.DataFrame:
        out = merge(pdf)
        out["seq"] = np.arange(len(out))
        return out[[by, "seq", "x", "y"]]

    final = f"{by} {points.schema[by].dataType.simpleString()}, seq bigint, x double, y double"
    return cut.groupBy(by).applyInPandas(ordered, final)


def directional_extremes(points: DataFrame, directions: Sequence[Sequence[float]],
                         coords: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """The extreme point in every direction (ties by smallest id), all in one aggregation pass."""
    p = v.vec(*coords)
    best = [F.max(F.struct(v.dot(p, v.const(d)).alias("m"), (-F.col("id")).alias("i"))).alias(f"_d{n}")
            for n, d in enumerate(directions)]
    rows = F.explode(F.array(*[
        F.struct(F.lit(n).cast("bigint").alias("direction"), (-F.col(f"_d{n}.i")).alias("id"), F.col(f"_d{n}.m").alias("support"))
        for n in range(len(directions))]))
    return points.agg(*best).select(rows.alias("r")).select("r.*")


def bounding_ball(points: DataFrame, by: str, eps: float = 0.01, coords: Sequence[str] = ("x", "y", "z"),
                  radius: str | None = None) -> DataFrame:
    """Smallest enclosing ball to (1+eps) per group: centre, lower and upper radius.

    Each round finds the point farthest from the current centre (one aggregation), adds it to the
    group's core set, and solves the ball of that short set; a core set of 2/eps points is enough, so
    the rounds do not depend on the data.  ``radius`` adds a per-point radius by
    measuring distances to the far side of each small ball.
    """
    p = v.vec(*coords)
    grown = F.col(radius) if radius else F.lit(0.0)
    start = points.groupBy(by).agg(F.min(F.array(*coords)).alias("a"))
    state = start.select(by, F.array("a").alias("core"), F.col("a").alias("centre"), F.lit(0.0).alias("lower"))
    while True:
        c = tuple(F.element_at("centre", i + 1) for i in range(len(coords)))
        away = F.sqrt(v.dist2(p, c)) + grown
        # The far side of a small ball, seen from the centre.
        unit = F.sqrt(v.dist2(p, c))
        far = F.array(*[q + F.when(unit > 0, F.try_divide(q - m, unit) * grown).otherwise(0.0) for q, m in zip(p, c)]) if radius else F.array(*p)
        farthest = points.join(state, by).groupBy(by).agg(
            F.max(F.struct(away.alias("upper"), far.alias("far"))).alias("f"))
        grownset = state.join(farthest, by).select(
            by, "centre", "lower", F.col("f.upper").alias("upper"), "core", F.array_append("core", F.col("f.far")).alias("next"))
        solved = settle(grownset.withColumn("ball", linear.enclosing_ball("next")))
        done = F.col("upper") <= (1 + eps) * F.greatest("lower", "ball.radius")
        if is_empty(solved.filter(~done)):
            break
        state = solved.select(
            by, F.when(done, F.col("core")).otherwise(F.col("next")).alias("core"),
            F.when(done, F.col("centre")).otherwise(F.col("ball.centre")).alias("centre"),
            F.when(done, F.greatest("lower", "ball.radius")).otherwise(F.col("ball.radius")).alias("lower"))
    return solved.select(by, "centre", F.greatest("lower", "ball.radius").alias("lower_radius"),
                         F.col("upper").alias("upper_radius"))


# -- distances and nearest sites ------------------------------------------------------------------
def directed_distance(a: DataFrame, b: DataFrame, coords: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Max over A of the distance to the nearest point of B, with the points that attain it."""
    near = knn_join(b, a.select(F.col("id").alias("query_id"), *coords), 1, coords)
    worst = near.agg(F.max(F.struct("distance", (-F.col("query_id")).alias("q"), "id")).alias("w"))
    return worst.select(F.col("w.distance").alias("distance"), (-F.col("w.q")).alias("from_id"), F.col("w.id").alias("to_id"))


def alignment_metrics(moving: DataFrame, reference: DataFrame, inlier_distance: float,
                      coords: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    near = knn_join(reference, moving.select(F.col("id").alias("query_id"), *coords), 1, coords)
    inlier = (F.col("d2") <= inlier_distance * inlier_distance).cast("double")
    return near.agg(F.count(F.lit(1)).alias("points"), F.sqrt(F.avg("d2")).alias("rms"),
                    F.sqrt(F.max("d2")).alias("max_residual"), F.avg(inlier).alias("inlier_fraction"))


def nearest_site(points: DataFrame, sites: DataFrame, coords: Sequence[str]) -> DataFrame:
    """Cell membership with the runner-up site, whose pairs show which cells touch in the data."""
    two = knn_join(sites.withColumnRenamed("site_id", "id"), points.select(F.col("id").alias("query_id"), *coords), 2, coords)
    return two.groupBy(F.col("query_id").alias("id")).agg(
        F.min_by("id", "rank").alias("site_id"), F.max_by("id", "rank").alias("second_site"),
        F.min("distance").alias("distance"))


def power_site(points: DataFrame, sites: DataFrame, coords: Sequence[str]) -> DataFrame:
    """argmin of d^2 - w.  With W the largest weight, d^2 - w is a squared distance in one more
    dimension of height sqrt(W - w), so the ordinary nearest-neighbour join finds it."""
    top = sites.agg(F.max("w")).first()[0]
    lifted = sites.withColumn("_h", F.sqrt(F.lit(top) - F.col("w"))).withColumnRenamed("site_id", "id")
    flat = points.select(F.col("id").alias("query_id"), *coords).withColumn("_h", F.lit(0.0))
    return knn_join(lifted, flat, 1, [*coords, "_h"]).select(
        F.col("query_id").alias("id"), F.col("id").alias("site_id"), (F.col("d2") - F.lit(top)).alias("power"))


def hidden_sites(sites: DataFrame, members: DataFrame) -> DataFrame:
    """Sites that no point belongs to."""
    return sites.join(members.select("site_id").distinct(), "site_id", "left_anti")


def spherical_site(vectors: DataFrame, sites: DataFrame, coords: Sequence[str]) -> DataFrame:
    """Nearest site by angle: on unit vectors the nearest by angle is the nearest by chord."""
    def unit(df: DataFrame) -> DataFrame:
        size = v.norm(v.vec(*coords))
        return df.withColumn("_s", size).withColumns({c: F.col(c) / F.col("_s") for c in coords}).drop("_s")
    near = knn_join(unit(sites).withColumnRenamed("site_id", "id"),
                    unit(vectors).select(F.col("id").alias("query_id"), *coords), 1, coords)
    return near.select(F.col("query_id").alias("id"), F.col("id").alias("site_id"),
                       (F.lit(1.0) - F.col("d2") / 2).alias("cosine"))


def periodic_site(points: DataFrame, sites: DataFrame, domain: Sequence[float], coords: Sequence[str]) -> DataFrame:
    """Nearest site on a torus with its lattice offset: every site is copied into the 3^d
    neighbouring domains (a fixed factor), then joined as usual."""
    copies = sites
    for i, _ in enumerate(coords):
        copies = copies.withColumn(f"_o{i}", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    copies = copies.withColumns({c: F.col(c) + F.col(f"_o{i}") * float(domain[i]) for i, c in enumerate(coords)})
    code: Column = F.lit(0)
    for i, _ in enumerate(coords):
        code = code * 3 + (F.col(f"_o{i}") + 1)
    total = 3 ** len(coords)
    coded = copies.withColumn("id", F.col("site_id") * total + code)
    near = knn_join(coded, points.select(F.col("id").alias("query_id"), *coords), 1, coords)
    offset = F.pmod(F.col("id"), F.lit(total))
    digits = [(F.floor(offset / 3 ** (len(coords) - 1 - i)) % 3 - 1).alias(f"offset_{c}") for i, c in enumerate(coords)]
    return near.select(F.col("query_id").alias("id"), F.floor(F.col("id") / total).alias("site_id"), "distance", *digits)
