"""Scalar statistics, normalisation, sampling and thresholds per scene.

NULL, NaN and infinite values are left out of every statistic; a group without values has no row in the statistics and keeps
its values untouched. Quantiles are exact and linearly interpolated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointspark.functions.missing import finite
from pointspark.operators.ordered import exact_quantiles, quantile_rows, ranked

EDGES = 1001


def zscore(df: DataFrame, by: list[str], channel: str) -> DataFrame:
    """(value - median) / IQR per group; untouched where the IQR isn't positive."""
    q = exact_quantiles(df, by, finite(channel), {"q1": 0.25, "q2": 0.5, "q3": 0.75}).drop("n")
    iqr = F.col("q3") - F.col("q1")
    return df.join(q, by, "left").withColumn(f"{channel}_norm", F.when(iqr > 0, (finite(channel) - F.col("q2")) / iqr).otherwise(finite(channel))).drop("q1", "q2", "q3")


def over_median(df: DataFrame, by: list[str], channel: str) -> DataFrame:
    """value / group median where that is positive."""
    q = exact_quantiles(df, by, finite(channel), {"mid": 0.5}).drop("n")
    return df.join(q, by, "left").withColumn(f"{channel}_norm", F.when(F.col("mid") > 0, finite(channel) / F.col("mid")).otherwise(finite(channel))).drop("mid")


def quantile_edges(df: DataFrame, by: list[str], channel: str, edges: int = EDGES) -> DataFrame:
    """(by, edges array): the quantile table of a channel, one row a group."""
    asks = F.transform(F.sequence(F.lit(0), F.lit(edges - 1)), lambda i: F.struct(i.alias("name"), (i / (edges - 1) * (F.col("n") - 1)).alias("h")))
    q = quantile_rows(df, by, finite(channel), asks)  # ``edges`` rows a group
    return q.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("name", "q")))["q"].alias("edges"))


def rank_normalise(df: DataFrame, by: list[str], channel: str, table: DataFrame) -> DataFrame:
    """Piecewise-linear rank in 0..1 by the group's quantile edges (N2); a constant channel and NULL pass through.

    Equal edges are collapsed to their last position, so the lookup is monotone; it runs as an array expression in the JVM.
    """
    n = F.size("edges") - 1
    v = finite(channel)
    below = F.size(F.filter("edges", lambda e: e <= v))
    lo, hi = F.get("edges", below - 1), F.get("edges", below)
    inside = (below - 1 + F.when(hi > lo, (v - lo) / (hi - lo)).otherwise(0.0)) / n
    rank = F.when(below == 0, F.lit(0.0)).when(below > n, F.lit(1.0)).otherwise(inside)
    constant = F.col("edges").isNull() | (F.element_at("edges", 1) == F.element_at("edges", -1))
    return df.join(table, by, "left").withColumn(f"{channel}_rank", F.when(constant | v.isNull(), v).otherwise(rank)).drop("edges")


def tau_for_rate(df: DataFrame, by: list[str], distance: str, rate: float) -> DataFrame:
    """(by, tau): threshold that a share ``rate`` of distances exceeds."""
    return exact_quantiles(df, by, finite(distance), {"tau": 1 - rate}).drop("n")


def dense_extent(df: DataFrame, by: list[str], lo: float = 0.001, hi: float = 0.999) -> DataFrame:
    """Low and high quantile of every axis."""
    out = None
    for c in ("x", "y", "z"):
        q = exact_quantiles(df, by, finite(c), {f"{c}_lo": lo, f"{c}_hi": hi}).drop("n")
        out = q if out is None else out.join(q, by)
    return out


def sor_points(df: DataFrame, by: list[str], channel: str, factors: list[float]) -> DataFrame:
    """(by, factor, threshold, removed): statistical-outlier-removal operating points mean + f * std."""
    stats = df.groupBy(*by).agg(F.avg(finite(channel)).alias("m"), F.stddev_pop(finite(channel)).alias("s"))
    points = stats.withColumn("factor", F.explode(F.array(*[F.lit(float(f)) for f in factors]))).withColumn("threshold", F.round(F.col("m") + F.col("factor") * F.col("s"), 9))
    rows = df.where(finite(channel).isNotNull()).select(*by, finite(channel).alias("v")).join(points, by)
    return rows.groupBy(*by, "factor", "threshold").agg(F.avg((F.col("v") > F.col("threshold")).cast("double")).alias("removed"))


def transform_delta(a: list[list[float]], b: list[list[float]], lo: tuple[float, ...] | None = None, hi: tuple[float, ...] | None = None) -> tuple[float, float]:
    """(degrees, largest shift of a box's corners) between two 4x4 transforms (N9); without a box the shift of the origin."""
    import numpy as np

    m, n = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    turn = np.degrees(np.arccos(np.clip((np.trace(m[:3, :3].T @ n[:3, :3]) - 1) / 2, -1, 1)))
    corners = np.zeros((1, 3)) if lo is None or hi is None else np.array(np.meshgrid(*zip(lo, hi))).reshape(3, -1).T
    shift = np.linalg.norm(corners @ m[:3, :3].T + m[:3, 3] - corners @ n[:3, :3].T - n[:3, 3], axis=1).max()
    return float(turn), float(shift)


def pose_delta(points: DataFrame, a: list[Column], b: list[Column]) -> DataFrame:
    """(mean, p95, largest) shift of points between two transforms."""
    d = F.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)))
    rows = points.select(d.alias("d"), F.lit(1).alias("one"))
    return exact_quantiles(rows, ["one"], F.col("d"), {"p95": 0.95, "largest": 1.0}).drop("one")


def hash_sample(df: DataFrame, key: list[str], target: int, seed: int = 42) -> DataFrame:
    """Bernoulli sample of about ``target`` rows by a hash of the key: the same rows in any partitioning."""
    n = max(df.count(), 1)
    parts = 1 << 30
    return df.where(F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(parts)) < int(min(1.0, target / n) * parts))


def fixed_sample(df: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all) without replacement: the smallest hashes of the key."""
    return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(n)


def stride_sample(df: DataFrame, item: str, step: int) -> DataFrame:
    """Every step-th row in the order of the id, from the first (P8); the order is global, its numbering isn't a single task."""
    rows = ranked(df.withColumn("_all", F.lit(0)), ["_all"], [F.col(item)], "_rank")
    return rows.where((F.col("_rank") - 1) % step == 0).drop("_all", "_rank")


def keep_best(df: DataFrame, by: list[str], score: Column, tie: str, removed: float) -> DataFrame:
    """Keeps max(bround(n (1 - f)), 1) rows of lowest score per group; NULL scores rank worst."""
    rows = ranked(df, by, [F.coalesce(score, F.lit(float("inf"))), F.col(tie)], "_rank")
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"))
    return rows.join(sizes, by).where(F.col("_rank") <= F.greatest(F.bround(F.col("_n") * (1 - removed)), F.lit(1))).drop("_rank", "_n")


def flag_worst(df: DataFrame, by: list[str], score: str, removed: float) -> DataFrame:
    """Adds filter_keep: 0 above the (1 - removed) quantile of the score, ties at the cut are kept, NULL scores are dropped."""
    q = exact_quantiles(df, by, finite(score), {"_cut": 1 - removed}).drop("n")
    return df.join(q, by, "left").withColumn("filter_keep", F.coalesce(finite(score) <= F.col("_cut"), F.lit(False)).cast("int")).drop("_cut")
