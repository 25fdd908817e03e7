"""Signs of determinants that are right even for nearly degenerate rows."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Relative error bounds of the plain double determinants (a few units of 2^-53 per term).
ORIENT2_BOUND, ORIENT3_BOUND = 4e-16, 8e-16


@F.pandas_udf(T.IntegerType())
def exact_sign(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Sign of the orientation of d+1 points given flat, in rational arithmetic, where ``unsure``."""
    for flat, unsure in batches:
        out = []
        for row, doubt in zip(flat, unsure):
            if not doubt:
                out.append(0)
                continue
            p = [Fraction(float(x)) for x in row]
            if len(p) == 6:
                det = (p[2] - p[0]) * (p[5] - p[1]) - (p[3] - p[1]) * (p[4] - p[0])
            else:
                a, b, c = ([p[3 * k + i] - p[i] for i in range(3)] for k in (1, 2, 3))
                det = (a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0]))
            out.append((det > 0) - (det < 0))
        yield pd.Series(out, dtype="int32")


def certified_sign(df: DataFrame, points: list[tuple[Column, ...]], name: str = "sign") -> DataFrame:
    """Add the exact orientation sign of 3 points in the plane or 4 in space.

    The double determinant decides every row whose value is larger than its forward error bound;
    only the others are worked out in rationals.
    """
    from . import vectors as v
    plane = len(points[0]) == 2
    det = v.orient2(*points) if plane else v.orient3(*points)
    e = [tuple(F.abs(x) for x in v.sub(p, points[0])) for p in points[1:]]
    if plane:
        size = e[0][0] * e[1][1] + e[0][1] * e[1][0]
    else:
        cr = tuple(a + b for a, b in ((e[0][1] * e[1][2], e[0][2] * e[1][1]), (e[0][2] * e[1][0], e[0][0] * e[1][2]), (e[0][0] * e[1][1], e[0][1] * e[1][0])))
        size = v.dot(cr, e[2])
    bound = size * (ORIENT2_BOUND if plane else ORIENT3_BOUND) * 2
    flat = F.array(*[x for p in points for x in p])
    df = df.withColumn("_det", det).withColumn("_unsure", F.abs("_det") <= bound)
    sure = df.filter(~F.col("_unsure")).withColumn(name, F.signum("_det").cast("int"))
    rest = df.filter("_unsure").withColumn(name, exact_sign(flat, F.col("_unsure")))
    return sure.unionByName(rest).drop("_det", "_unsure")
