"""Vector algebra on tuples of Columns (2-D or 3-D)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, ...]


def vec(*names: str | Column) -> Vec:
    return tuple(F.col(n) if isinstance(n, str) else n for n in names)


class named(Sequence):
    """A vector of column names that become Columns on use, so modules import without a session."""

    def __init__(self, *names: str):
        self.names = names

    def __getitem__(self, i):
        return vec(*self.names[i]) if isinstance(i, slice) else F.col(self.names[i])

    def __len__(self) -> int:
        return len(self.names)


def const(values: Sequence[float]) -> Vec:
    return tuple(F.lit(float(v)) for v in values)


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b))


def scale(a: Vec, s: Column | float) -> Vec:
    return tuple(p * s for p in a)


def dot(a: Vec, b: Vec) -> Column:
    total = a[0] * b[0]
    for p, q in zip(a[1:], b[1:]):
        total = total + p * q
    return total


def norm2(a: Vec) -> Column:
    return dot(a, a)


def norm(a: Vec) -> Column:
    return F.sqrt(norm2(a))


def dist2(a: Vec, b: Vec) -> Column:
    return norm2(sub(a, b))


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def cross2(a: Vec, b: Vec) -> Column:
    return a[0] * b[1] - a[1] * b[0]


def orient2(a: Vec, b: Vec, c: Vec) -> Column:
    """Twice the signed area of the triangle a, b, c."""
    return cross2(sub(b, a), sub(c, a))


def orient3(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    """Six times the signed volume of the tetrahedron a, b, c, d (positive when d sees abc clockwise)."""
    return dot(cross(sub(b, a), sub(c, a)), sub(d, a))


def finite(value: Column) -> Column:
    """SQL NaN equals itself and is larger than every number, so both tests are needed."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def as_struct(a: Vec, names: Sequence[str] = ("x", "y", "z")) -> Column:
    return F.struct(*[c.alias(n) for c, n in zip(a, names)])


def clamp(value: Column, low: Column | float, high: Column | float) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.greatest(low, F.least(high, value))
