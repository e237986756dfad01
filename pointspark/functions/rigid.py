"""Rigid transforms and small vector algebra as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def norm(*cs: Column | str) -> Column:
    return F.sqrt(sum((F.col(c) if isinstance(c, str) else c) ** 2 for c in cs))


def square_distance(a: list[Column], b: list[Column]) -> Column:
    d = [x - y for x, y in zip(a, b)]
    return sum((v * v for v in d[1:]), d[0] * d[0])


def rotation(q: tuple[Column, Column, Column, Column]) -> list[list[Column]]:
    """3x3 matrix of a quaternion (x, y, z, w), normalised; NULL for a zero quaternion."""
    n = F.sqrt(sum(c * c for c in q))
    x, y, z, w = (F.when(n > 0, c / n) for c in q)
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def apply(r: list[list[Column]], t: list[Column], p: list[Column]) -> list[Column]:
    """R p + t."""
    return [row[0] * p[0] + row[1] * p[1] + row[2] * p[2] + s for row, s in zip(r, t)]


def apply_inverse(r: list[list[Column]], t: list[Column], p: list[Column]) -> list[Column]:
    """R^T (p - t)."""
    d = [a - b for a, b in zip(p, t)]
    return [r[0][i] * d[0] + r[1][i] * d[1] + r[2][i] * d[2] for i in range(3)]


def rotation_angle(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Angle between two unnormalised quaternions."""
    na, nb = F.sqrt(sum(c * c for c in a)), F.sqrt(sum(c * c for c in b))
    dot = F.abs(sum(x * y for x, y in zip(a, b))) / (na * nb)
    return F.when((na > 0) & (nb > 0), 2 * F.acos(F.least(F.lit(1.0), dot)))
