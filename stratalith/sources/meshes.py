"""OFF and OBJ files to vertex and face rows, as many-file jobs."""

from __future__ import annotations

import math

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROWS = "path string, kind string, seq bigint, x double, y double, z double, corners array<bigint>, reason string"


def _off(words: list[list[str]]) -> tuple[list, list]:
    if not words or words[0][0] != "OFF":
        raise ValueError("header")
    # The counts may stand behind the word OFF.
    counts, body = (words[0][1:], words[1:]) if len(words[0]) > 1 else (words[1], words[2:])
    n, m = int(counts[0]), int(counts[1])
    if len(body) != n + m:
        raise ValueError("counts")
    points = [tuple(map(float, w)) for w in body[:n]]
    faces = [list(map(int, w[1:1 + int(w[0])])) for w in body[n:]]
    if any(len(f) != int(w[0]) for f, w in zip(faces, body[n:])):
        raise ValueError("corners")
    return points, faces


def _obj(words: list[list[str]]) -> tuple[list, list]:
    points = [tuple(map(float, w[1:4])) for w in words if w[0] == "v"]
    index = [[int(c.split("/")[0]) for c in w[1:]] for w in words if w[0] == "f"]
    return points, [[i - 1 if i > 0 else len(points) + i for i in f] for f in index]


def _mesh_rows(batches: Iterator[pd.DataFrame], form: str | None) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            words = [w for w in (s.split("#")[0].split() for s in bytes(content).decode("utf-8", "replace").splitlines()) if w]
            try:
                points, faces = (_obj if form == "obj" or path.lower().endswith(".obj") else _off)(words)
                if any(len(p) != 3 or not all(map(math.isfinite, p)) for p in points) or any(len(f) < 3 or min(f) < 0 or max(f) >= len(points) for f in faces):
                    raise ValueError("indices")
                rows = [(path, "vertex", i, *p, None, None) for i, p in enumerate(points)]
                rows += [(path, "face", i, None, None, None, f, None) for i, f in enumerate(faces)]
            except (ValueError, IndexError) as error:
                rows = [(path, "reject", 0, None, None, None, None, f"malformed_mesh: {error}")]
            out = pd.DataFrame(rows, columns=["path", "kind", "seq", "x", "y", "z", "corners", "reason"])
            yield out.astype({c: float for c in "xyz"})


def read_mesh_text(spark: SparkSession, paths: str | list[str], form: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices, polygon faces, rejects), keyed by path; the format follows the suffix unless given."""
    rows = spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(lambda batches: _mesh_rows(batches, form), _ROWS)
    return (rows.filter("kind = 'vertex'").select("path", F.col("seq").alias("vid"), "x", "y", "z"),
            rows.filter("kind = 'face'").select("path", F.col("seq").alias("fid"), "corners"), rows.filter("kind = 'reject'").select("path", "reason"))
