"""Small dense solves on rows that are already aggregated; Arrow UDFs, one batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of the six sums that make a symmetric 3x3 matrix.
SYMMETRIC = ("xx", "xy", "xz", "yy", "yz", "zz")

# Types are built as objects: a DDL string would need a session when a worker imports this module.
_EIGEN = T.StructType([T.StructField(n, T.DoubleType()) for n in ("l0", "l1", "l2", "nx", "ny", "nz", "px", "py", "pz")])
_ROW = T.ArrayType(T.DoubleType())
_BALL = T.StructType([T.StructField("centre", _ROW), T.StructField("radius", T.DoubleType())])


@F.pandas_udf(_EIGEN)
def eigh3(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
    """Ascending eigenvalues; n = vector of the smallest, p = vector of the largest."""
    m = np.empty((len(xx), 3, 3))
    for (i, j), s in zip(((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)), (xx, xy, xz, yy, yz, zz)):
        m[:, i, j] = m[:, j, i] = s.to_numpy(float)
    w, q = np.linalg.eigh(np.nan_to_num(m))
    return pd.DataFrame({"l0": w[:, 0], "l1": w[:, 1], "l2": w[:, 2],
                         "nx": q[:, 0, 0], "ny": q[:, 1, 0], "nz": q[:, 2, 0],
                         "px": q[:, 0, 2], "py": q[:, 1, 2], "pz": q[:, 2, 2]})


@F.pandas_udf(_ROW)
def least_squares(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Solve the packed normal equations ``a`` (row-major) x = ``b``; minimum-norm when singular."""
    for a, b in batches:
        out = []
        for m, r in zip(a, b):
            r = np.asarray(r, float)
            m = np.asarray(m, float).reshape(len(r), len(r))
            out.append(np.linalg.lstsq(m, r, rcond=1e-12)[0].tolist())
        yield pd.Series(out)


def _ball(points: np.ndarray) -> tuple[np.ndarray, float]:
    """Smallest enclosing ball of a few points, by small exact sub-solves (Welzl's move-to-front)."""
    def through(support: list[np.ndarray]) -> tuple[np.ndarray, float]:
        if not support:
            return np.zeros(points.shape[1]), -1.0
        p0 = support[0]
        rest = np.array([p - p0 for p in support[1:]])
        if not len(rest):
            return p0, 0.0
        x = np.linalg.lstsq(2 * rest @ rest.T, (rest ** 2).sum(1), rcond=None)[0]
        offset = x @ rest
        return p0 + offset, float(offset @ offset)

    def solve(n: int, support: list[np.ndarray]) -> tuple[np.ndarray, float]:
        centre, r2 = through(support)
        if len(support) == points.shape[1] + 1:
            return centre, r2
        for i in range(n):
            if ((points[i] - centre) ** 2).sum() > r2 * (1 + 1e-12) + 1e-300 or r2 < 0:
                centre, r2 = solve(i, [*support, points[i]])
        return centre, r2

    centre, r2 = solve(len(points), [])
    return centre, float(np.sqrt(max(r2, 0.0)))


@F.pandas_udf(_BALL)
def enclosing_ball(core: pd.Series) -> pd.DataFrame:
    """Ball of a short array of points (the core set of one group)."""
    solved = [_ball(np.unique(np.array([list(p) for p in points], float), axis=0)) for points in core]
    return pd.DataFrame({"centre": [c.tolist() for c, _ in solved], "radius": [r for _, r in solved]})


def moments(weight: Column | None, axes: tuple[Column, Column, Column], means: tuple[Column, Column, Column]) -> list[Column]:
    """The six centred second-moment sums, named as in SYMMETRIC."""
    d = [a - m for a, m in zip(axes, means)]
    pairs = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))
    return [F.sum(d[i] * d[j] if weight is None else weight * d[i] * d[j]).alias(n) for (i, j), n in zip(pairs, SYMMETRIC)]
