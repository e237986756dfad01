"""Missing-value discipline: NULL is the only missing value inside the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-6
#: Markers by which a channel says "not computed"; 0 is kept unless a whole column equals it.
SENTINELS = {
    "balm_res": -1.0, "ekf_res": -1.0, "plane_quality": -1.0, "view_diversity": -1.0, "temp_consistency": -1.0, "ring": -1.0, "scan_time": -1.0,
    "range": -1.0, "pose_unc_rot": -1.0, "ang_rate": -1.0, "C2C_distance": -1.0, "mean_knn_dist": -1.0, "predicted_c2c": -1.0,
    "intensity": 0.0, "ambient": 0.0, "reflectivity": 0.0, "obs_count": 0.0, "range_detach": 0.0, "range_edge": 0.0, "int_detach": 0.0, "ring_rough": 0.0,
}


def finite(c: Column | str) -> Column:
    """The value as double; NULL for NaN and infinities."""
    v = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(F.abs(v) < float("inf"), v)


def present(c: Column | str, sentinel: float = -1.0) -> Column:
    """The finite value; NULL within tolerance of the sentinel too."""
    v = finite(c)
    return F.when(F.abs(v - sentinel) > TOLERANCE, v)


def ingest(df: DataFrame, channels: list[str]) -> DataFrame:
    """Channels with NULL for missing and a flag ``<channel>__nofit`` for the -1 marker."""
    flags = {f"{c}__nofit": F.coalesce(F.abs(F.col(c).cast("double") + 1) <= TOLERANCE, F.lit(False)) for c in channels if SENTINELS.get(c) == -1.0}
    values = {c: present(c, SENTINELS[c]) if SENTINELS.get(c) == -1.0 else finite(c) for c in channels}
    return df.withColumns(flags).withColumns(values)


def detect_sentinel(df: DataFrame, channels: list[str], marker: float = -1.0, least_share: float = 0.001) -> DataFrame:
    """(channel, share, lowest, is_sentinel): a channel uses the marker if its share exceeds least_share and no finite value lies below."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), finite(c).alias("v")) for c in channels])).alias("e")).select("e.*")
    out = long.groupBy("channel").agg((F.sum((F.abs(F.col("v") - marker) <= TOLERANCE).cast("int")) / F.count("*")).alias("share"), F.min("v").alias("lowest"))
    return out.withColumn("is_sentinel", F.coalesce((F.col("share") > least_share) & (F.col("lowest") >= marker - TOLERANCE), F.lit(False)))


def constant_channels(df: DataFrame, channels: list[str]) -> DataFrame:
    """(channel, given): rows in which a channel holds something besides its marker; 0 means that it can be dropped."""
    tests = [F.count_if(F.abs(finite(c) - SENTINELS.get(c, 0.0)) > TOLERANCE).alias(c) for c in channels]
    return df.agg(*tests).unpivot([], channels, "channel", "given")


def gate(c: Column | str, low: float, high: float, other: float = 0.0) -> Column:
    """The value strictly between the limits, else ``other``; missing counts as outside."""
    v = finite(c)
    return F.when((v > low) & (v < high), v).otherwise(F.lit(other))


def saved_channels(df: DataFrame, flags: dict[str, bool]) -> DataFrame:
    """Drops the channels whose save flag is off (P21); channels without a flag are kept."""
    return df.drop(*[c for c, on in flags.items() if not on])
