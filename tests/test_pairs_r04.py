"""Findings of round 4: pairs of copies are listed without moving them."""

from pyspark.sql import functions as F

from stratalith.operators import planar as pl
from stratalith.operators import provenance as pv
from stratalith.operators import skew
from stratalith.operators import surface


def moved_rows(spark, job):
    """The rows that ``job`` writes into shuffles and tables, by Spark's own count of its stages."""
    sc = spark.sparkContext
    store = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    total = lambda: sum(s.shuffleWriteRecords() + s.outputRecords() for s in sc._jvm.scala.collection.JavaConverters.seqAsJavaList(store()))
    before = total()
    rows = job()
    return total() - before, rows


def test_packed_keeps_every_value_of_keys_with_nulls(spark):
    rows = [("a", None, n) for n in range(1000)] + [(None, 1, 7), ("b", 1, 8), ("b", 1, 8)]
    df = spark.createDataFrame(rows, "k string, m int, id long")
    got = skew.packed(df, ["k", "m"], "id", 100).collect()
    assert sorted((str(r.k), str(r.m), x) for r in got for x in r.id) == sorted((str(k), str(m), n) for k, m, n in rows)
    assert max(len(r.id) for r in got) < 200


def test_gates_are_tried_per_class(spark):
    """equal operations and requests were joined row by row; the pairs must be the same."""
    n = 4000
    ops = spark.range(n).select(F.col("id").alias("operation_id"), F.when(F.col("id") % 10 < 9, "K").alias("kernel"), F.when(F.col("id") % 2 == 0, "V").otherwise("B").alias("status"),
                                F.array(F.lit("x")).alias("accepted_types"), F.array(F.lit("d")).alias("dependencies"), F.lit(None).cast("string").alias("license"))
    asked = spark.range(n).select(F.col("id").alias("request_id"), F.lit("K").alias("kernel"), F.when(F.col("id") % 2 == 0, F.array(F.lit("V"))).alias("statuses"), F.lit("x").alias("input_type"),
                                  F.when(F.col("id") % 4 < 2, F.array(F.lit("d"), F.lit("e"))).alias("dependencies"), F.lit(None).cast("array<string>").alias("licenses"))
    found = pv.gate_candidates(ops, asked)
    sides = ops.alias("o").join(asked.alias("c"), "kernel").filter("(statuses IS NULL OR array_contains(statuses, status)) AND (c.dependencies IS NULL OR array_contains(c.dependencies, 'd'))")
    want = sides.select("request_id", "operation_id")
    assert found.count() == want.count() > n * n / 2
    digest = lambda df: df.agg(F.sum(F.xxhash64("request_id", "operation_id").cast("decimal(38,0)"))).first()[0]
    assert digest(found) == digest(want)
    joined = [p for p in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate explode" in p]
    assert len(joined) >= 2  # the pairs come from arrays of members, not from joined rows


def test_copies_of_polygons_are_not_moved_with_every_place(spark):
    """each place was written or shuffled with every copy of the polygons it lies in."""
    side, copies = 20, 1500
    points = spark.range(side * side).select("id", (F.col("id") % side).cast("double").alias("x"), F.floor(F.col("id") / side).cast("double").alias("y"))
    ring = F.explode(F.array(*[F.struct(F.lit(n).alias("seq"), F.lit(x).alias("x"), F.lit(y).alias("y")) for n, (x, y) in enumerate([(-1.0, -1.0), (30.0, -1.0), (30.0, 30.0), (-1.0, 30.0)])])).alias("k")
    polygons = spark.range(copies).select(F.col("id").alias("poly_id"), F.lit(0).alias("ring"), ring).select("poly_id", "ring", "k.*")
    moved, rows = moved_rows(spark, lambda: pl.locate_in_polygons(points, polygons).filter("location = 'inside'").count())
    assert rows == side * side * copies
    assert moved < side * side * copies / 2
    moved, rows = moved_rows(spark, lambda: pl.barycentric_weights(points, polygons, "mean_value", 6).groupBy().agg(F.count("*").alias("n"), F.sum("weight").alias("w")).first())
    assert rows.n == side * side * copies * 4 and abs(rows.w - side * side * copies) < 10
    assert moved < side * side * copies / 2


def _strip(spark, n, lift):
    """A rough strip of ``n`` cells along x, with a hill over its last cells in the other surface."""
    v = spark.range(2 * (n + 1)).select(F.lit(0).alias("mesh_id"), F.col("id").alias("vid"), F.floor(F.col("id") / 2).cast("double").alias("x"), (F.col("id") % 2).cast("double").alias("y"),
                                        (F.col("id") * 7 % 5 + F.when(F.col("id") > 2 * n - 4, lift).otherwise(0.1 if lift else 0.0)).cast("double").alias("z"))
    k = F.col("id") * 2
    f = spark.range(n).select(F.lit(0).alias("mesh_id"), F.explode(F.array(F.struct(k.alias("fid"), k.alias("a"), (k + 1).alias("b"), (k + 2).alias("c")),
                                                                            F.struct((k + 1).alias("fid"), (k + 1).alias("a"), (k + 3).alias("b"), (k + 2).alias("c")))).alias("f")).select("mesh_id", "f.*")
    return v, f


def test_hausdorff_measures_only_faces_that_can_be_furthest(spark, monkeypatch):
    """every sample of both surfaces went down the tree."""
    left, right = _strip(spark, 400, 0), _strip(spark, 400, 6.0)
    asked = []
    plain = surface.nearest_candidates
    monkeypatch.setattr(surface, "nearest_candidates", lambda points, *a, **k: asked.append(points.count()) or plain(points, *a, **k))
    got = surface.hausdorff(left, right, 0.5, 1.0).first()
    whole = [surface.sample_surface(*side, 0.5).select(*"xyz").distinct() for side in (left, right)]
    want = [surface.closest_on_mesh(s.withColumn("id", F.monotonically_increasing_id()), *side).agg(F.max("distance")).first()[0] for s, side in zip(whole, (right, left))]
    assert abs(got.forward - want[0]) < 1e-9 and abs(got.backward - want[1]) < 1e-9 and got.verdict == "fail"
    assert sum(asked[:-2]) < sum(s.count() for s in whole)
