"""Pre-integration of inertial samples between two moments (X11).

A step of constant turn rate and acceleration is a 5 x 5 matrix [[R, v, p], [0, 1, t], [0, 0, 1]]; steps compose by multiplication, so an
interval is an ordered product, which is taken as a tree over all steps at once. Steps are made in SQL from neighbouring samples of an interval
(their mean), so intervals are independent and spread over tasks; an interval is bounded by its sensor's rate. How rotation, velocity and position
answer to small biases is read off by central differences of the same product.

Defined cases: samples with a NULL, NaN or infinite value are left out; repeated times add nothing; an interval with fewer than two
samples has no row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pointspark.functions.missing import finite

NUDGE = 1e-4


def rotations(w: np.ndarray) -> np.ndarray:
    """Rotation matrices of rotation vectors [n, 3]."""
    a = np.linalg.norm(w, axis=1)[:, None, None]
    k = np.zeros((len(w), 3, 3))
    k[:, 0, 1], k[:, 0, 2], k[:, 1, 2] = -w[:, 2], w[:, 1], -w[:, 0]
    k -= k.transpose(0, 2, 1)
    small = a < 1e-8
    safe = np.where(small, 1.0, a)
    return np.eye(3) + np.where(small, 1.0, np.sin(safe) / safe) * k + np.where(small, 0.5, (1 - np.cos(safe)) / safe**2) * (k @ k)


def product(steps: np.ndarray) -> np.ndarray:
    """Ordered product of [n, 5, 5] by a tree."""
    while len(steps) > 1:
        odd = steps[-1:] if len(steps) % 2 else steps[:0]
        steps = np.concatenate([steps[0 : len(steps) - len(odd) : 2] @ steps[1::2][: (len(steps) - len(odd)) // 2], odd])
    return steps[0]


def increments(dt: np.ndarray, w: np.ndarray, a: np.ndarray) -> np.ndarray:
    m = np.tile(np.eye(5), (len(dt), 1, 1))
    m[:, :3, :3] = rotations(w * dt[:, None])
    m[:, :3, 3], m[:, :3, 4], m[:, 3, 4] = a * dt[:, None], a * dt[:, None] ** 2 / 2, dt
    return m


def _turn(r: np.ndarray) -> np.ndarray:
    """Rotation vector of a small rotation."""
    return np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]]) / 2


def preintegrate(samples: DataFrame, by: list[str], at: str = "t", gyro_bias: tuple[float, ...] = (0.0, 0.0, 0.0), acc_bias: tuple[float, ...] = (0.0, 0.0, 0.0)) -> DataFrame:
    """(by, steps, seconds, r, v, p, r_bg, v_bg, p_bg, v_ba, p_ba): motion over each interval and its answers to biases, matrices row by row.

    samples: the interval's keys, ``at`` in seconds, turn rates w0..w2 and accelerations a0..a2.
    """
    cols = [f"{k}{i}" for k in "wa" for i in range(3)]
    ok = finite(at).isNotNull()
    for c in cols:
        ok &= finite(c).isNotNull()
    w = W.partitionBy(*by).orderBy(at)
    rows = samples.where(ok).select(*by, F.col(at).alias("_t"), (F.lead(at).over(w) - F.col(at)).alias("_dt"), *[((F.col(c) + F.lead(c).over(w)) / 2).alias(f"_{c}") for c in cols]).where(F.col("_dt") > 0)
    bias = np.array([*gyro_bias, *acc_bias])
    names = ["r", "v", "p", "r_bg", "v_bg", "p_bg", "v_ba", "p_ba"]

    def fold(t: pa.Table) -> pa.Table:
        t = t.sort_by("_t")
        dt = t.column("_dt").to_numpy()
        x = np.column_stack([t.column(f"_{c}").to_numpy() for c in cols])
        whole = lambda b: product(increments(dt, x[:, :3] - b[:3], x[:, 3:] - b[3:]))
        m = whole(bias)
        d = np.zeros((9, 6))
        for i in range(6):
            e = np.zeros(6)
            e[i] = NUDGE
            hi, lo = whole(bias + e), whole(bias - e)
            d[:, i] = np.concatenate([_turn(lo[:3, :3].T @ hi[:3, :3]), hi[:3, 3] - lo[:3, 3], hi[:3, 4] - lo[:3, 4]]) / (2 * NUDGE)
        parts = [m[:3, :3], m[:3, 3], m[:3, 4], d[:3, :3], d[3:6, :3], d[6:, :3], d[3:6, 3:], d[6:, 3:]]
        keys = [t.column(k).slice(0, 1) for k in by]
        return pa.table([*keys, pa.array([len(dt)], pa.int64()), pa.array([float(dt.sum())]), *[pa.array([v.ravel().tolist()], pa.list_(pa.float64())) for v in parts]], names=[*by, "steps", "seconds", *names])

    kinds = ", ".join(f"`{k}` {samples.schema[k].dataType.simpleString()}" for k in by)
    return rows.groupBy(*by).applyInArrow(fold, f"{kinds}, steps long, seconds double, " + ", ".join(f"{n} array<double>" for n in names))
