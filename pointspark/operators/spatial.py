"""Neighbour operators: capped nearest, k nearest within a margin, radius joins, neighbourhood statistics, roughness.

Searches for the nearest go through ``nearest.nearest``, whose leaves are cut by counts: crowded places are split and no pair beyond
the k nearest is handed on. Roughness needs eigenvectors, which an Arrow kernel takes from sums of products, all points of a batch at once.
Self is excluded by id, so an exact copy of a point is its neighbour at distance 0. Ties are broken by the smaller id. Rows
without finite coordinates or an id take no part; points without neighbours keep a row with NULL figures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pointspark.functions.missing import finite, present
from pointspark.operators import grid
from pointspark.operators.nearest import nearest
from pointspark.session import cut

BALL_K = 100
Z_EPS = 1e-6


def nearest_capped(query: DataFrame, reference: DataFrame, cap: float, query_id: str, reference_id: str) -> DataFrame:
    """(query_id, distance): distance to the nearest reference point, NULL from the cap on."""
    near = nearest(query, 1, query_id, cap, reference, reference_id, others_only=False).select("a_id", F.sqrt("d2").alias("distance"))
    return grid.located(query).where(F.col(query_id).isNotNull()).select(F.col(query_id)).distinct().join(near, F.col(query_id) == F.col("a_id"), "left").select(query_id, "distance")


def knn(points: DataFrame, k: int, margin: float, item: str, reference: DataFrame | None = None) -> DataFrame:
    """(a_id, b_id, d2, rank): the k nearest others within the margin."""
    return nearest(points, k, item, margin, reference)


def _certain(k: int, margin: float) -> Column:
    """How many of the k nearest lie within the margin."""
    return F.count_if((F.col("rank") <= k) & (F.col("d2") <= margin * margin))


def mean_distances(points: DataFrame, ks: list[int], margin: float, item: str, whole: bool = False) -> DataFrame:
    """Mean distance to the k nearest others for several k from one search.

    mean_k<k> averages what exists within the margin, or in the whole table if ``whole``; uncertain_k<k> says in both cases
    that fewer than k lie within the margin.
    """
    near = nearest(points, max(ks), item) if whole else knn(points, max(ks), margin, item)
    aggs = [a for k in ks for a in (F.avg(F.when(F.col("rank") <= k, F.sqrt("d2"))).alias(f"mean_k{k}"), _certain(k, margin).alias(f"n{k}"))]
    got = near.groupBy("a_id").agg(*aggs)
    out = grid.located(points).where(F.col(item).isNotNull()).select(F.col(item)).distinct().join(got, F.col(item) == F.col("a_id"), "left")
    return out.select(item, *[c for k in ks for c in (F.col(f"mean_k{k}"), (F.coalesce(F.col(f"n{k}"), F.lit(0)) < k).alias(f"uncertain_k{k}"))])


def range_semi(reference: DataFrame, query: DataFrame, radius: float, reference_id: str, query_id: str) -> DataFrame:
    """Reference rows with any query point within the radius."""
    hit = nearest(reference, 1, reference_id, radius, query, query_id, others_only=False).select(F.col("a_id").alias(reference_id))
    return reference.join(hit, reference_id, "left_semi")


def neighbourhood_stats(points: DataFrame, channels: dict[str, float], k: int, margin: float, item: str, whole: bool = False) -> DataFrame:
    """Family D over the k nearest (A9): <channel>__{nmean,nstd,dev,z,ninv}_k<k>; missing neighbours are skipped.

    ``channels`` maps each channel to its missing marker. The neighbour list is built once for all channels, within the margin
    or over the whole table; uncertain_k<k> says in both cases that fewer than k lie within the margin.
    """
    values = [present(c, s).alias(c) for c, s in channels.items()]
    near = nearest(points, k, item) if whole else knn(points, k, margin, item)
    one = points.select(F.col(item).alias("b_id"), *values)
    agg = [a for c in channels for a in (F.avg(c).alias(f"{c}__nmean_k{k}"), F.stddev_pop(c).alias(f"{c}__nstd_k{k}"), F.avg(F.col(c).isNull().cast("double")).alias(f"{c}__ninv_k{k}"))]
    stats = near.join(one, "b_id").groupBy("a_id").agg(*agg, _certain(k, margin).alias("n"))
    own = points.select(F.col(item), *values).join(stats, F.col(item) == F.col("a_id"), "left")
    dev = {c: F.col(c) - F.col(f"{c}__nmean_k{k}") for c in channels}
    return own.select(item, *[x for c in channels for x in (
        F.col(f"{c}__nmean_k{k}"), F.col(f"{c}__nstd_k{k}"), dev[c].alias(f"{c}__dev_k{k}"), (dev[c] / (F.col(f"{c}__nstd_k{k}") + Z_EPS)).alias(f"{c}__z_k{k}"), F.col(f"{c}__ninv_k{k}"),
    )], (F.coalesce("n", F.lit(0)) < k).alias(f"uncertain_k{k}"))


def _residuals(points: DataFrame, near: DataFrame, thin: DataFrame, item: str, least: int) -> DataFrame:
    """(item, roughness): distance of each point from the plane fitted to its neighbours; NULL below ``least`` of them.

    A plane is known from ten sums of its points, taken relative to the point itself so that nothing cancels.
    """
    here = points.select(F.col(item).alias("a_id"), *[F.col(c).alias(f"q{c}") for c in grid.XYZ])
    at = thin.select(F.col(item).alias("b_id"), *grid.XYZ)
    rel = near.join(at, "b_id").join(here, "a_id").select("a_id", *[(F.col(c) - F.col(f"q{c}")).alias(c) for c in grid.XYZ])
    sums = grid.covariance(grid.point_clusters(rel, ["a_id"])).where(F.col("n") >= least)
    names = ["cx", "cy", "cz", "vxx", "vxy", "vxz", "vyy", "vyz", "vzz"]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = np.column_stack([b.column(n).to_numpy() for n in names]).reshape(-1, 9)
            full = c[:, [3, 4, 5, 4, 6, 7, 5, 7, 8]].reshape(-1, 3, 3)
            _, axes = np.linalg.eigh(full)
            out = np.abs((c[:, :3] * axes[:, :, 0]).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b.column("a_id"), pa.array(out)], names=["a_id", "roughness"])

    kind = sums.schema["a_id"].dataType.simpleString()
    fitted = sums.select("a_id", *names).mapInArrow(fit, f"a_id {kind}, roughness double")
    return grid.located(points).where(F.col(item).isNotNull()).select(F.col(item)).distinct().join(fitted, F.col(item) == F.col("a_id"), "left").select(item, "roughness")


def roughness(points: DataFrame, radius: float, item: str) -> DataFrame:
    """(item, roughness): plane residual among the <= BALL_K nearest voxel points within the radius; NULL below 4 (A10).

    The neighbours come from a copy downsampled to radius / 5 that keeps the first point of each voxel (J8).
    """
    points = grid.located(points).select(item, *grid.XYZ)
    thin = grid.keep_first(points, radius / 5, [item])
    return _residuals(points, nearest(points, BALL_K, item, radius, thin, others_only=False), thin, item, 4)


def roughness_k(points: DataFrame, k: int, item: str) -> DataFrame:
    """(item, roughness): plane residual among the k nearest points, itself included; NULL below 4."""
    points = grid.located(points).select(item, *grid.XYZ)
    return _residuals(points, nearest(points, k, item, others_only=False), points, item, 4)


def geometry_features(points: DataFrame, item: str, ks: list[int], radii: list[float], k_rough: list[int] | None = None, rows: DataFrame | None = None, margin: float = 1.0) -> DataFrame:
    """(item, mean_knn_dist_k<k>, roughness_r<mm>, roughness_k<k>): every scale of a cloud.

    One search for the largest k serves every k. With ``rows`` (ids) only those points are asked for, against the whole cloud, so
    their figures are the same as without it.
    """
    cloud = grid.located(points).select(item, *grid.XYZ)
    asked = cloud if rows is None else cloud.join(rows.select(item).distinct(), item, "left_semi")
    reference = None if rows is None else cloud
    deepest = max([*ks, *(k_rough or [])])
    near = cut(nearest(asked, deepest + (1 if k_rough else 0), item, reference=reference, others_only=not k_rough))
    others = near.where(F.col("a_id") != F.col("b_id")).withColumn("rank", F.row_number().over(W.partitionBy("a_id").orderBy("d2", "b_id"))) if k_rough else near
    out = asked.select(item).distinct()
    got = others.groupBy("a_id").agg(*[F.avg(F.when(F.col("rank") <= k, F.sqrt("d2"))).alias(f"mean_knn_dist_k{k}") for k in ks])
    out = out.join(got.withColumnRenamed("a_id", item), item, "left")
    for k in k_rough or []:
        out = out.join(_residuals(asked, near.where(F.col("rank") <= k), cloud, item, 4).withColumnRenamed("roughness", f"roughness_k{k}"), item, "left")
    for radius in radii:
        thin = cut(grid.keep_first(cloud, radius / 5, [item]))
        ball = nearest(asked, BALL_K, item, radius, thin, others_only=False)
        out = out.join(_residuals(asked, ball, thin, item, 4).withColumnRenamed("roughness", f"roughness_r{round(radius * 100):03d}"), item, "left")
    return out


#: Scale-free ratios of family E, (name, numerator, denominator, scale).
RATIOS = (
    ("roughness_ratio_015_005", "roughness_r015", "roughness_r005", 1.0),
    ("mean_knn_dist_ratio_k6_k30", "mean_knn_dist_k6", "mean_knn_dist_k30", (30 / 6) ** 0.5),
    ("mean_knn_dist_ratio_k30_k100", "mean_knn_dist_k30", "mean_knn_dist_k100", (100 / 30) ** 0.5),
    ("roughness_over_knn_005_k6", "roughness_r005", "mean_knn_dist_k6", 1.0),
    ("roughness_over_knn_015_k30", "roughness_r015", "mean_knn_dist_k30", 1.0),
)


def ratio(num: str, den: str, scale: float = 1.0):
    """num / den * scale; NULL if either is missing or the denominator is below 1e-9."""
    a, b = finite(num), finite(den)
    return F.when(F.abs(b) >= 1e-9, a / b * scale)
