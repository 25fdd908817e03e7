"""Spatial inputs derived from the given tables, as DataFrames and as the same SQL text.

Every derivation is a projection or a small join of whole tables, so it grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lattice width of the height-field mesh built from ``part``.
WIDTH = 40


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- points ---------------------------------------------------------------------------------
def points3(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), "label", *[e[i].cast("double").alias(c) for i, c in enumerate("xyz")])


P3 = """p3 AS (SELECT vec_id AS id, label, CAST(embedding[1] AS DOUBLE) AS x,
  CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"""


def points2(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("label"),
        F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))


P2 = """p2 AS (SELECT p_partkey AS id, p_brand AS label, CAST(p_size AS DOUBLE) AS x,
  p_retailprice AS y FROM part)"""


def points3_part(spark: SparkSession, sf: str) -> DataFrame:
    """Integer lattice heights with ties, as a 3-D point set."""
    return mesh(spark, sf)[0].select(F.col("vid").alias("id"), "x", "y", "z")


def line_points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("label"),
        F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))


LP = """lp AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_returnflag AS label,
  l_quantity AS x, l_extendedprice AS y FROM lineitem)"""


def order_points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("label"),
        F.col("o_custkey").cast("double").alias("x"), F.col("o_totalprice").alias("y"))


OP = """op AS (SELECT o_orderkey AS id, o_orderstatus AS label, CAST(o_custkey AS DOUBLE) AS x,
  o_totalprice AS y FROM orders)"""


# -- one big open mesh from part ---------------------------------------------------------------
def mesh(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Height field: (vertices, faces) with one mesh_id 0 and integer coordinates."""
    part = table(spark, sf, "part")
    key = F.col("p_partkey")
    vertices = part.select(
        F.lit(0).cast("bigint").alias("mesh_id"), key.alias("vid"),
        F.pmod(key, F.lit(WIDTH)).cast("double").alias("x"),
        F.floor(key / WIDTH).cast("double").alias("y"), F.col("p_size").cast("double").alias("z"))
    # A lattice cell exists where the corner above and to the right does.
    upper = part.select((key - (WIDTH + 1)).alias("p_partkey"))
    cells = part.select("p_partkey").filter(F.pmod(key, F.lit(WIDTH)) < WIDTH - 1).join(upper, "p_partkey", "left_semi")
    low = F.struct((key * 2).alias("fid"), key.alias("a"), (key + 1).alias("b"), (key + WIDTH).alias("c"))
    high = F.struct((key * 2 + 1).alias("fid"), (key + 1).alias("a"), (key + WIDTH + 1).alias("b"), (key + WIDTH).alias("c"))
    faces = cells.select(F.explode(F.array(low, high)).alias("f")).select(
        F.lit(0).cast("bigint").alias("mesh_id"), "f.*")
    return vertices, faces


MESH = f"""mv AS (SELECT CAST(0 AS BIGINT) AS mesh_id, p_partkey AS vid, CAST(p_partkey % {WIDTH} AS DOUBLE) AS x,
  CAST(p_partkey // {WIDTH} AS DOUBLE) AS y, CAST(p_size AS DOUBLE) AS z FROM part),
cell AS (SELECT p_partkey AS k FROM part WHERE p_partkey % {WIDTH} < {WIDTH - 1}
  AND p_partkey + {WIDTH + 1} IN (SELECT p_partkey FROM part)),
mf AS (SELECT CAST(0 AS BIGINT) AS mesh_id, k * 2 AS fid, k AS a, k + 1 AS b, k + {WIDTH} AS c FROM cell
  UNION ALL SELECT CAST(0 AS BIGINT), k * 2 + 1, k + 1, k + {WIDTH + 1}, k + {WIDTH} FROM cell)"""

# -- many small closed meshes from supplier ------------------------------------------------------
# The twelve outward triangles of a box whose corner number is x + 2*y + 4*z.
BOX_TRIANGLES = [
    (0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4),
    (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5),
]


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Integer axis-aligned boxes, one per supplier."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    return table(spark, sf, "supplier").select(
        key.alias("mesh_id"),
        F.pmod(key * 7, F.lit(100)).cast("double").alias("x0"), F.pmod(key * 13, F.lit(100)).cast("double").alias("y0"),
        nation.cast("double").alias("z0"),
        (1 + F.pmod(nation, F.lit(5))).cast("double").alias("w"), (1 + F.pmod(key, F.lit(7))).cast("double").alias("h"),
        (1 + F.pmod(F.floor(F.abs("s_acctbal")).cast("bigint"), F.lit(9))).cast("double").alias("d"))


BOX = """bx AS (SELECT s_suppkey AS mesh_id, CAST(s_suppkey * 7 % 100 AS DOUBLE) AS x0,
  CAST(s_suppkey * 13 % 100 AS DOUBLE) AS y0, CAST(s_nationkey AS DOUBLE) AS z0,
  CAST(1 + s_nationkey % 5 AS DOUBLE) AS w, CAST(1 + s_suppkey % 7 AS DOUBLE) AS h,
  CAST(1 + CAST(floor(abs(s_acctbal)) AS BIGINT) % 9 AS DOUBLE) AS d FROM supplier)"""


def box_mesh(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    corner = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")
    placed = boxes(spark, sf).select("*", corner)
    k = F.col("k")
    vertices = placed.select(
        "mesh_id", (F.col("mesh_id") * 8 + k).alias("vid"),
        (F.col("x0") + F.col("w") * (k % 2)).alias("x"),
        (F.col("y0") + F.col("h") * (F.floor(k / 2) % 2)).alias("y"),
        (F.col("z0") + F.col("d") * F.floor(k / 4)).alias("z"))
    base = F.col("mesh_id") * 8
    triangle = F.array(*[
        F.struct((F.col("mesh_id") * 12 + i).alias("fid"), (base + a).alias("a"), (base + b).alias("b"), (base + c).alias("c"))
        for i, (a, b, c) in enumerate(BOX_TRIANGLES)])
    faces = boxes(spark, sf).select("mesh_id", F.explode(triangle).alias("f")).select("mesh_id", "f.*")
    return vertices, faces


_TRIANGLE_ROWS = ", ".join(f"({i}, {a}, {b}, {c})" for i, (a, b, c) in enumerate(BOX_TRIANGLES))
BOXMESH = BOX + f""",
bv AS (SELECT mesh_id, mesh_id * 8 + k AS vid, x0 + w * (k % 2) AS x, y0 + h * (k // 2 % 2) AS y,
  z0 + d * (k // 4) AS z FROM bx, range(8) r(k)),
bf AS (SELECT mesh_id, mesh_id * 12 + i AS fid, mesh_id * 8 + a AS a, mesh_id * 8 + b AS b, mesh_id * 8 + c AS c
  FROM bx, (VALUES {_TRIANGLE_ROWS}) t(i, a, b, c))"""


# -- polygons with a hole, one per supplier --------------------------------------------------------
# Hexagon (ring 0, counter-clockwise) and square hole (ring 1) in units of the size.
POLYGON_CORNERS = [
    (0, 0, -4, 0), (0, 1, -2, -3), (0, 2, 2, -3), (0, 3, 4, 0), (0, 4, 2, 3), (0, 5, -2, 3),
    (1, 0, -1, -1), (1, 1, -1, 1), (1, 2, 1, 1), (1, 3, 1, -1),
]


def polygons(spark: SparkSession, sf: str) -> DataFrame:
    """``poly_id, ring, seq, x, y``: ring 0 is the outer ring, ring 1 a hole."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    frame = table(spark, sf, "supplier").select(
        key.alias("poly_id"), (2 * nation + 1).cast("double").alias("cx"),
        (F.pmod(key * 11, F.lit(100)) + 900).cast("double").alias("cy"),
        (1 + F.pmod(key, F.lit(3))).cast("double").alias("size"))
    corner = F.array(*[
        F.struct(F.lit(r).alias("ring"), F.lit(s).alias("seq"), F.lit(float(u)).alias("u"), F.lit(float(w)).alias("w"))
        for r, s, u, w in POLYGON_CORNERS])
    return frame.select("*", F.explode(corner).alias("k")).select(
        "poly_id", "k.ring", "k.seq", (F.col("cx") + F.col("size") * F.col("k.u")).alias("x"),
        (F.col("cy") + F.col("size") * F.col("k.w")).alias("y"))


_CORNER_ROWS = ", ".join(str(c) for c in POLYGON_CORNERS)
POLY = f"""pg AS (SELECT s_suppkey AS poly_id, ring, seq, 2 * s_nationkey + 1 + (1 + s_suppkey % 3) * CAST(u AS DOUBLE) AS x,
  s_suppkey * 11 % 100 + 900 + (1 + s_suppkey % 3) * CAST(w AS DOUBLE) AS y
  FROM supplier, (VALUES {_CORNER_ROWS}) t(ring, seq, u, w))"""


# For suppliers by number modulo 8, where the square holes of rings 1 and 2 stand, in units of
# the size: both well inside; ring 1 outside; ring 1 across the outer ring; ring 1 touching a corner of it;
# ring 2 within ring 1; ring 2 across ring 1; ring 2 equal to ring 1; ring 1 inside, its corners crossed.
HOLE_PLACES = [(0.0, 0.0, 2.5, 0.0), (9.0, 0.0, 2.5, 0.0), (4.0, 0.0, -2.0, 0.0), (0.0, 2.0, 2.5, 0.0), (0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.75, 0.5), (0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 2.5, 0.0)]
# Half the side of ring 2 in the same units.
SECOND_HOLE = [0.25, 0.25, 0.25, 0.25, 0.25, 0.5, 1.0, 0.25]


def holed_polygons(spark: SparkSession, sf: str) -> DataFrame:
    """Hexagons with two square holes each, which stand in the outer ring and to each other in all ways."""
    key = F.col("s_suppkey")
    case = F.pmod(key, F.lit(8))
    base = polygons(spark, sf)
    at = lambda values: F.element_at(F.array(*[F.lit(float(x)) for x in values]), (case + 1).cast("int"))
    frame = table(spark, sf, "supplier").select(key.alias("poly_id"), case.alias("case"), (1 + F.pmod(key, F.lit(3))).cast("double").alias("size"), (2 * F.col("s_nationkey") + 1).cast("double").alias("cx"),
                                                (F.pmod(key * 11, F.lit(100)) + 900).cast("double").alias("cy"), *[at([p[k] for p in HOLE_PLACES]).alias(f"h{k}") for k in range(4)], at(SECOND_HOLE).alias("half"))
    outer = base.filter("ring = 0")
    square = [(s, u, w) for r, s, u, w in POLYGON_CORNERS if r == 1]
    rows = [F.struct(F.lit(r).alias("ring"), F.when((F.col("case") == 7) & F.lit(r == 1) & F.lit(s in (1, 2)), 3 - s).otherwise(s).alias("seq"),
                     (F.col("cx") + F.col("size") * (F.col(f"h{2 * r - 2}") + u * (F.lit(1.0) if r == 1 else F.col("half")))).alias("x"),
                     (F.col("cy") + F.col("size") * (F.col(f"h{2 * r - 1}") + w * (F.lit(1.0) if r == 1 else F.col("half")))).alias("y")) for r in (1, 2) for s, u, w in square]
    return outer.unionByName(frame.select("poly_id", F.explode(F.array(*rows)).alias("k")).select("poly_id", "k.*"))


_SQUARE = ", ".join(f"({s}, {u}, {w})" for r, s, u, w in POLYGON_CORNERS if r == 1)
_PLACES = ", ".join(f"({k}, {', '.join(f'{x}::DOUBLE' for x in p)}, {half}::DOUBLE)" for k, (p, half) in enumerate(zip(HOLE_PLACES, SECOND_HOLE)))
HOLED = f"""hq AS (SELECT s_suppkey AS poly_id, k, 1 + s_suppkey % 3 AS size, 2 * s_nationkey + 1 AS cx, s_suppkey * 11 % 100 + 900 AS cy, h0, h1, h2, h3, half
    FROM supplier JOIN (VALUES {_PLACES}) p(k, h0, h1, h2, h3, half) ON k = s_suppkey % 8),
  hp AS (SELECT * FROM pg WHERE ring = 0 UNION ALL
    SELECT poly_id, 1, CASE WHEN k = 7 AND seq IN (1, 2) THEN 3 - seq ELSE seq END, cx + size * (h0 + u), cy + size * (h1 + w) FROM hq, (VALUES {_SQUARE}) t(seq, u, w) UNION ALL
    SELECT poly_id, 2, seq, cx + size * (h2 + u * half), cy + size * (h3 + w * half) FROM hq, (VALUES {_SQUARE}) t(seq, u, w))"""


# -- segments, one per order -----------------------------------------------------------------------
def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Short integer segments on a map whose size grows with the table, so crossings stay local."""
    key = F.col("c_custkey")
    bal = F.floor(F.col("c_acctbal")).cast("bigint")
    x = F.pmod(key * 37, F.lit(211)).cast("double")
    y = (F.floor(key / 100) * 7 + F.pmod(bal, F.lit(97))).cast("double")
    return table(spark, sf, "customer").select(
        key.alias("seg_id"), x.alias("x1"), y.alias("y1"),
        (x + 1 + F.pmod(bal, F.lit(7))).alias("x2"), (y + F.pmod(key, F.lit(9)) - 4).alias("y2"))


SEG = """sg AS (SELECT c_custkey AS seg_id, CAST(c_custkey * 37 % 211 AS DOUBLE) AS x1,
  CAST(c_custkey // 100 * 7 + (b % 97 + 97) % 97 AS DOUBLE) AS y1,
  CAST(c_custkey * 37 % 211 AS DOUBLE) + 1 + (b % 7 + 7) % 7 AS x2,
  CAST(c_custkey // 100 * 7 + (b % 97 + 97) % 97 AS DOUBLE) + c_custkey % 9 - 4 AS y2
  FROM (SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS b FROM customer))"""


# -- rays, one per customer, shot down at the height field ---------------------------------------------
def rays(spark: SparkSession, sf: str) -> DataFrame:
    """Slanted rays that start above the height field, inside its outline plus a margin."""
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        key.alias("ray_id"), (F.pmod(key * 17, F.lit(41)) + 0.25).alias("ox"),
        (F.floor(key * 4 / 125) + 0.375).alias("oy"), F.lit(60.0).alias("oz"),
        ((F.pmod(key, F.lit(5)) - 2) * 0.125).alias("dx"), ((F.col("c_nationkey") - 12) * 0.03125).alias("dy"),
        F.lit(-4.0).alias("dz"))


RAY = """ry AS (SELECT c_custkey AS ray_id, c_custkey * 17 % 41 + 0.25::DOUBLE AS ox,
  floor(c_custkey * 4 / 125) + 0.375::DOUBLE AS oy, 60.0::DOUBLE AS oz, (c_custkey % 5 - 2) * 0.125::DOUBLE AS dx,
  (c_nationkey - 12) * 0.03125::DOUBLE AS dy, -4.0::DOUBLE AS dz FROM customer)"""
