"""XYZ text, ASCII PLY, and strict typed JSON."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as v


def parse_xyz(lines: DataFrame, line: str = "value") -> DataFrame:
    """Three finite numbers per line; ``#`` comments and blank lines are skipped.  Lines that are
    neither have a ``reason`` instead of coordinates."""
    body = F.trim(F.regexp_replace(F.split_part(F.col(line), F.lit("#"), F.lit(1)), "\\s+", " "))
    rows = lines.withColumn("_b", body).filter(F.length("_b") > 0).withColumn("_w", F.split("_b", " "))
    number = [F.expr(f"try_cast(get(_w, {i}) AS DOUBLE)") for i in range(3)]
    rows = rows.withColumns({c: e for c, e in zip("xyz", number)})
    ok = F.size("_w") == 3
    for c in "xyz":
        ok = ok & F.coalesce(v.finite(F.col(c)), F.lit(False))
    reason = F.when(F.size("_w") != 3, "not_three_numbers").when(~ok, "not_finite_numbers")
    return rows.withColumn("reason", reason).withColumns({c: F.when(ok, F.col(c)) for c in "xyz"}).drop("_b", "_w")


def read_xyz(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(points, rejects): ``path, x, y, z`` and ``path, value, reason``."""
    rows = parse_xyz(spark.read.text(paths).withColumn("path", F.input_file_name()))
    return rows.filter("reason IS NULL").select("path", "x", "y", "z"), rows.filter("reason IS NOT NULL").select("path", "value", "reason")


def write_xyz(points: DataFrame, path: str) -> None:
    """One ``x y z`` line per point; doubles are written in their shortest exact form."""
    points.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in "xyz"])).write.mode("errorifexists").text(path)


_TYPES = {
    "PointSet1": T.ArrayType(T.DoubleType(), False), "PointSet2": T.ArrayType(T.ArrayType(T.DoubleType(), False), False),
}


def read_points_json(df: DataFrame, key: str, body: str) -> DataFrame:
    """``key, seq, x, y`` from strict ``{"points": [[x, y], ...]}`` documents.

    Unknown keys, wrong arity and unreadable numbers leave a ``reason`` on a single row.
    """
    schema = T.StructType([T.StructField("points", _TYPES["PointSet2"])])
    parsed = df.select(key, F.from_json(body, schema, {"mode": "PERMISSIVE"}).alias("p"), F.json_object_keys(body).alias("k"))
    reason = F.when(F.col("k").isNull() | F.col("p.points").isNull(), "not_a_point_set").when(F.size("k") != 1, "unknown_key").when(
        F.exists("p.points", lambda q: (F.size(q) != 2) | F.exists(q, lambda x: x.isNull())), "wrong_arity")
    parsed = parsed.withColumn("reason", reason)
    good = parsed.filter("reason IS NULL").select(key, F.posexplode("p.points").alias("seq", "q"), "reason").select(key, "seq", F.get("q", 0).alias("x"), F.get("q", 1).alias("y"), "reason")
    bad = parsed.filter("reason IS NOT NULL").select(key, F.lit(0).alias("seq"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), "reason")
    return good.unionByName(bad)


_PLY = "path string, seq bigint, x double, y double, z double, nx double, ny double, nz double, reason string"


def _ply_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["x", "y", "z", "nx", "ny", "nz"]
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            head, _, body = bytes(content).partition(b"end_header\n")
            lines = head.decode("ascii", "replace").split("\n")
            fields = [s.split()[-1] for s in lines if s.startswith("property ")]
            count = next((int(s.split()[-1]) for s in lines if s.startswith("element vertex ")), -1)
            table = [s.split() for s in body.decode("ascii", "replace").splitlines() if s.strip()]
            others = any(s.startswith("element ") and not s.startswith("element vertex ") for s in lines)
            bad = others or not lines[0].startswith("ply") or "format ascii 1.0" not in lines or not set(names) <= set(fields) or len(table) != count or any(len(r) != len(fields) for r in table)
            out = pd.DataFrame(columns=names, dtype=float)
            if not bad:
                out = pd.DataFrame([r[:len(fields)] for r in table], columns=fields)[names].apply(pd.to_numeric, errors="coerce")
                bad = bool(out.isna().any().any())
            if bad:
                yield pd.DataFrame([{"path": path, "seq": 0, **{n: None for n in names}, "reason": "malformed_ply"}]).astype({n: float for n in names})
            elif len(out):
                yield out.assign(path=path, seq=range(len(out)), reason=None)


def read_ply_points(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """ASCII PLY points with normals, by property name; a many-file job with one file per row."""
    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(_ply_rows, _PLY)
