"""Graph loops in few rounds, far points against meshes, order statistics, intervals and late rows."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalith.operators import evaluation as ev
from stratalith.operators import graph, local_fit, mesh, provenance, surface
from stratalith.operators.kernel import evaluate_intersections
from stratalith.session import settle
from stratalith.streaming import jobs


# -- lineage and levels --------------------------------------------------------------------------
def brute_closure(edges):
    out = {}
    for start in {a for a, _ in edges}:
        depth, todo = 0, {start}
        while todo:
            depth += 1
            todo = {b for a, b in edges if a in todo} - {b for s, b in out if s == start}
            out.update({(start, b): depth for b in todo})
    return out


def test_closure_of_random_graphs(spark):
    rng = random.Random(1)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(60)}
    got = provenance.lineage_closure(spark.createDataFrame(sorted(edges) * 2, "output int, input int")).collect()
    assert {(r["output"], r["input"]): r["depth"] for r in got} == brute_closure(edges) and len(got) == len(brute_closure(edges))


def test_closure_of_a_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(provenance, "settle", lambda df: rounds.append(1) or settle(df))
    got = provenance.lineage_closure(spark.createDataFrame([(k, k + 1) for k in range(300)], "output int, input int"))
    assert got.count() == 300 * 301 // 2 and got.filter("depth <> input - output").count() == 0 and len(rounds) <= 11


def brute_levels(n, edges):
    deps = {k: {d for v_, d in edges if v_ == k} for k in range(n)}
    level = {}
    while True:
        ready = [k for k in deps if k not in level and deps[k] <= level.keys()]
        if not ready:
            return {k: level.get(k) for k in range(n)}
        level.update({k: max((level[d] + 1 for d in deps[k]), default=0) for k in ready})


@pytest.mark.parametrize("seed", range(3))
def test_levels_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 60
    edges = {(k, rng.randrange(k)) for k in range(1, n) for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))} | ({(3, 3), (5, 9), (9, 5)} if seed else set())
    steps = spark.createDataFrame([(1, k) for k in range(n)], "plan_id int, step_id int")
    got = provenance.dag_levels(steps, spark.createDataFrame([(1, a, b) for a, b in edges], "plan_id int, step_id int, depends_on int")).collect()
    want = brute_levels(n, edges)
    assert {r["step_id"]: r["level"] for r in got} == want and {r["step_id"] for r in got if r["problem"] == "cycle"} == {k for k, x in want.items() if x is None}


def test_levels_of_long_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(provenance, "settle", lambda df: rounds.append(1) or settle(df))
    n = 10_000
    rows = [(1, k, k - 1) for k in range(1, n)] + [(2, k, (k + 1) % 5) for k in range(5)] + [(3, 1, 77)]
    steps = spark.createDataFrame([(1, k) for k in range(n)] + [(2, k) for k in range(5)] + [(3, 1), (3, 1)], "plan_id int, step_id int")
    got = provenance.dag_levels(steps, spark.createDataFrame(rows, "plan_id int, step_id int, depends_on int")).collect()
    assert all(r["level"] == r["step_id"] for r in got if r["plan_id"] == 1) and {(r["level"], r["problem"]) for r in got if r["plan_id"] == 2} == {(None, "cycle")}
    assert [(r["level"], r["problem"]) for r in got if r["plan_id"] == 3] == [(0, "duplicate_id")] and len(rounds) < 60


# -- shortest paths ----------------------------------------------------------------------------
def dijkstra(edges, sources):
    near, best, heap = {}, {}, [(0.0, s, s) for s in sources]
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    while heap:
        d, source, node = heapq.heappop(heap)
        if node not in best:
            best[node] = (d, source)
            for b, w in near.get(node, ()):
                heapq.heappush(heap, (d + w, source, b))
    return best


@pytest.mark.parametrize("delta", [None, 0.75, 100.0])
def test_paths_equal_brute_force(spark, delta):
    rng = random.Random(4)
    edges = [(rng.randrange(80), rng.randrange(80), rng.choice([0.0, 0.25, 0.5, 1.0, 2.0, 7.0])) for _ in range(140)]
    sources = [3, 50, 99]
    got = graph.shortest_paths(spark.createDataFrame(edges, "a int, b int, length double"), spark.createDataFrame([(s,) for s in sources], "node int"), delta).collect()
    assert {r["node"]: (r["distance"], r["source"]) for r in got} == dijkstra(edges, sources) and len(got) == len(dijkstra(edges, sources))


def test_paths_from_nowhere(spark):
    edges = spark.createDataFrame([(1, 2, 1.0)], "a int, b int, length double")
    assert graph.shortest_paths(edges, spark.createDataFrame([], "node int")).count() == 0
    assert [tuple(r) for r in graph.shortest_paths(edges.limit(0), spark.createDataFrame([(4,)], "node int")).collect()] == [(4, 0.0, 4)]


# -- far points ---------------------------------------------------------------------------------
def field(spark, n=30):
    rng = random.Random(5)
    vertices = [(0, i * n + j, float(i), float(j), rng.random()) for i in range(n) for j in range(n)]
    faces = [(0, 2 * (i * n + j) + s, *((i * n + j, i * n + j + 1, i * n + n + j) if s == 0 else (i * n + j + 1, i * n + n + j + 1, i * n + n + j))) for i in range(n - 1) for j in range(n - 1) for s in (0, 1)]
    return spark.createDataFrame(vertices, "mesh_id bigint, vid bigint, x double, y double, z double"), spark.createDataFrame(faces, "mesh_id bigint, fid bigint, a bigint, b bigint, c bigint")


def test_far_points_meet_few_faces(spark):
    vertices, faces = field(spark)
    rng = random.Random(6)
    far = [(k, *(c * 3e7 for c in (rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)))) for k in range(20)]
    near = [(100 + k, rng.uniform(-2, 31), rng.uniform(-2, 31), rng.uniform(-1, 2)) for k in range(60)]
    asked = spark.createDataFrame(far + near, "id int, x double, y double, z double")
    tri = settle(mesh.corners(vertices, faces))
    met = {r["query_id"]: r["count"] for r in surface.nearest_candidates(asked, tri).groupBy("query_id").count().collect()}
    assert len(met) == 80 and max(met.values()) < 200 and np.median(list(met.values())) < 40  # of 1,682 faces
    got = {r["id"]: (r["fid"], r["d2"]) for r in surface.locate_on_mesh(asked, vertices, faces).collect()}
    corners = {r["fid"]: np.array([[r[f"{k}{c}"] for c in "xyz"] for k in "abc"]) for r in tri.collect()}
    for k, *p in near + far[:3]:
        d = {f: closest(np.array(p), t) for f, t in corners.items()}
        assert got[k][1] == pytest.approx(min(d.values()), rel=1e-9, abs=1e-9)


def closest(p, tri):
    a, b, c = tri
    n = np.cross(b - a, c - a)
    inside = all(np.dot(np.cross(t - s, p - s), n) >= 0 for s, t in ((a, b), (b, c), (c, a)))
    if inside:
        return np.dot(p - a, n) ** 2 / np.dot(n, n)
    def edge(s, t):
        u = np.clip(np.dot(p - s, t - s) / np.dot(t - s, t - s), 0, 1)
        return ((p - s - u * (t - s)) ** 2).sum()
    return min(edge(a, b), edge(b, c), edge(c, a))


def test_distances_between_points_and_surface(spark):
    vertices, faces = field(spark, 4)
    one = spark.createDataFrame([(1, 1.0, 1.0, 50.0), (2, 1.0, 1.0, 3.0)], "id int, x double, y double, z double")
    r = surface.distance_to_mesh(one, vertices, faces).first()
    assert r["from_id"] == 1 and 48 < r["distance"] < 50
    r = surface.distance_to_points(vertices, faces, one.filter("id = 2"), 0.25).first()
    assert r["upper"] == r["lower"] + 0.25 and r["to_id"] == 2 and (r["x"], r["y"]) == (3.0, 3.0)
    assert surface.locate_on_mesh(one, vertices, faces.limit(0)).count() == 0


# -- order statistics and intervals ---------------------------------------------------------------
@pytest.mark.parametrize("share", [0.0, 0.02, 0.5, 0.999])
def test_order_statistics_equal_sorting(spark, share):
    rng = random.Random(7)
    rows = [(g, rng.choice([rng.random(), round(rng.random(), 2)])) for g, n in ((1, 1), (2, 49), (3, 50), (4, 51), (5, 30_000)) for _ in range(n)]
    got = ev.order_statistic(spark.createDataFrame(rows, "g int, x double"), ["g"], "x", F.floor(F.col("n") * share) + 1).collect()
    for g in range(1, 6):
        mine = sorted(x for k, x in rows if k == g)
        assert {r["g"]: r["threshold"] for r in got}[g] == mine[int(np.floor(len(mine) * share))]


def test_intervals_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(g, k, float(rng.randint(0, 60))) for g in range(8) for k in range(rng.randint(1, 25))] + [(9, 0, 5.0), (9, 1, 5.0)]
    got = local_fit.interval_assignment(spark.createDataFrame(rows, "g int, id int, x double"), 3, "g").collect()
    for g in {r[0] for r in rows}:
        xs = sorted({x for k, _, x in rows if k == g})
        def starts(d):
            out = []
            for x in xs:
                if not out or x > out[-1] + d:  # noqa: B023
                    out.append(x)
            return out
        d = min(b - a for a in xs for b in xs if b >= a and len(starts(b - a)) <= 3)
        for r in (r for r in got if r["g"] == g):
            k = sum(s <= r["x"] for s in starts(d)) - 1
            assert (r["centre_number"], r["centre"], r["radius"]) == (k, starts(d)[k] + d / 2, d / 2)
    assert len(got) == len(rows)


# -- late rows ---------------------------------------------------------------------------------
def test_late_rows_are_dropped_and_kept_aside(spark, tmp_path):
    schema = "id int, ts timestamp, state string"
    for n, rows in enumerate([[(1, "2024-01-01 00:10:00", "ok"), (2, "2024-01-02 00:00:00", "ok")], [(3, "2024-01-02 01:00:00", "bad")], [(4, "2024-01-01 00:20:00", "ok"), (5, "2024-01-02 01:30:00", "ok")], [(6, "2024-01-09 00:00:00", "ok")]]):
        spark.createDataFrame(rows, "id int, ts string, state string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    counted = jobs.stream_job_outcomes(stream(), "ts", "state", "1 hour", "12 hours")
    query = counted.writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c1").trigger(availableNow=True).start()
    query.awaitTermination()
    closed = {(str(r["window_start"]), r["state"], r["jobs"]) for r in spark.table("closed").collect()}
    assert closed == {("2024-01-01 00:00:00", "ok", 1), ("2024-01-02 00:00:00", "ok", 1), ("2024-01-02 01:00:00", "bad", 1), ("2024-01-02 01:00:00", "ok", 1)}
    assert jobs.dropped_rows(query) == 1
    jobs.late_rows(stream(), "ts", "1 hour", "12 hours", f"file://{tmp_path}/late", f"file://{tmp_path}/marks", f"file://{tmp_path}/c2").awaitTermination()
    late = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/late").collect()
    assert [r["id"] for r in late] == [4]


# -- parallel segments --------------------------------------------------------------------------
def test_parallel_segments_and_points(spark):
    pairs = {"overlap": ([0, 0, 4, 0], [2, 0, 9, 0]), "touch": ([0, 0, 4, 0], [4, 0, 9, 0]), "apart": ([0, 0, 4, 0], [5, 0, 9, 0]), "beside": ([0, 0, 4, 0], [0, 1, 4, 1]),
             "dot on": ([2, 0, 2, 0], [0, 0, 4, 0]), "dot off": ([2, 1, 2, 1], [0, 0, 4, 0]), "on dot": ([0, 0, 4, 0], [2, 0, 2, 0]), "dots": ([1, 1, 1, 1], [1, 1, 1, 1]), "two dots": ([1, 1, 1, 1], [2, 1, 2, 1])}
    prims = spark.createDataFrame([(f"{k}{n}", "Segment_2", [float(x) for x in c]) for k, two in pairs.items() for n, c in enumerate(two)], "id string, kind string, coords array<double>")
    asked = spark.createDataFrame([(k, "intersection", [f"{k}0", f"{k}1"]) for k in pairs], "id string, query string, arguments array<string>")
    got = {r["id"]: (r["result"], r["point"]) for r in evaluate_intersections(prims, asked).collect()}
    assert got == {"overlap": ("segment", None), "touch": ("point", [4.0, 0.0]), "apart": ("empty", None), "beside": ("empty", None), "dot on": ("point", [2.0, 0.0]), "dot off": ("empty", None),
                   "on dot": ("point", [2.0, 0.0]), "dots": ("point", [1.0, 1.0]), "two dots": ("empty", None)}
