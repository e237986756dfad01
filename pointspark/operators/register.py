"""Registration: iterations on the driver, distributed sums in between; only small matrices leave the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointspark.functions import rigid
from pointspark.operators import grid


def transform(points: DataFrame, matrix: np.ndarray) -> DataFrame:
    """x' = R x + t as three column expressions (P10)."""
    m = np.asarray(matrix, dtype=float)
    world = rigid.apply([[F.lit(float(v)) for v in row[:3]] for row in m[:3]], [F.lit(float(v)) for v in m[:3, 3]], [F.col(c) for c in grid.XYZ])
    return points.withColumns(dict(zip(grid.XYZ, world)))


def _small_rotation(w: np.ndarray) -> np.ndarray:
    a = np.linalg.norm(w)
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
    return np.eye(3) + k if a < 1e-12 else np.eye(3) + np.sin(a) / a * k + (1 - np.cos(a)) / a**2 * (k @ k)


def matched(source: DataFrame, target: DataFrame, cap: float, item: str, target_item: str) -> DataFrame:
    """Source points with their nearest target point and its normal."""
    near = grid.halo_join(source, target, cap, item, target_item).groupBy("a_id").agg(F.min_by("b_id", F.struct("d2", "b_id")).alias("b_id"))
    t = target.select(F.col(target_item).alias("b_id"), *[F.col(c).alias(f"t_{c}") for c in grid.XYZ], "nx", "ny", "nz")
    return near.join(source.select(F.col(item).alias("a_id"), *grid.XYZ), "a_id").join(t, "b_id")


def icp_step(pairs: DataFrame, tukey: float | None = None) -> tuple[np.ndarray, float, int]:
    """One point-to-plane step: (4x4 increment, rmse, pairs) from 28 sums over all pairs."""
    x, y, z = (F.col(c) for c in grid.XYZ)
    n = [F.col(c) for c in ("nx", "ny", "nz")]
    r = sum(((F.col(c) - F.col(f"t_{c}")) * m for c, m in zip(("y", "z"), n[1:])), (x - F.col("t_x")) * n[0])
    j = [y * n[2] - z * n[1], z * n[0] - x * n[2], x * n[1] - y * n[0], *n]
    w = F.lit(1.0) if tukey is None else F.when(F.abs(r) < tukey, (1 - (r / tukey) ** 2) ** 2).otherwise(0.0)
    terms = [F.sum(w * j[a] * j[b]).alias(f"h{a}{b}") for a in range(6) for b in range(a, 6)] + [F.sum(w * j[a] * r).alias(f"g{a}") for a in range(6)]
    s = pairs.agg(*terms, F.sum(r * r).alias("e"), F.count("*").alias("n")).first()
    if not s["n"]:
        return np.eye(4), float("inf"), 0
    h, g = np.zeros((6, 6)), np.array([s[f"g{a}"] for a in range(6)])
    for a in range(6):
        for b in range(a, 6):
            h[a, b] = h[b, a] = s[f"h{a}{b}"]
    d = -np.linalg.lstsq(h, g, rcond=1e-9)[0]
    step = np.eye(4)
    step[:3, :3], step[:3, 3] = _small_rotation(d[:3]), d[3:]
    return step, float(np.sqrt(s["e"] / s["n"])), int(s["n"])


def icp(source: DataFrame, target: DataFrame, levels: list[tuple[float, float]], item: str, target_item: str, start: np.ndarray | None = None, most: int = 20, tukey: float = 0.10) -> tuple[np.ndarray, float]:
    """Multiscale point-to-plane registration (L11): (transform, fitness); never worse than the start.

    levels: (voxel, cap) from coarse to fine; the target needs normals. Robust weights on the finest level only.
    """
    best = now = np.eye(4) if start is None else np.asarray(start, dtype=float)
    voxel, cap = levels[-1]
    thin = grid.keep_first(source.select(item, *grid.XYZ), voxel, [item])

    def fitness(m: np.ndarray) -> float:
        return matched(transform(thin, m), target, cap, item, target_item).count() / max(thin.count(), 1)

    top = fitness(now)
    for i, (voxel, cap) in enumerate(levels):
        part = grid.keep_first(source.select(item, *grid.XYZ), voxel, [item])
        for _ in range(most):
            step, _, n = icp_step(matched(transform(part, now), target, cap, item, target_item), tukey if i == len(levels) - 1 else None)
            if n < 6:
                break
            now = step @ now
            if np.linalg.norm(step[:3, 3]) < 1e-4 and np.arccos(np.clip((np.trace(step[:3, :3]) - 1) / 2, -1, 1)) < 1e-5:
                break
    got = fitness(now)
    return (now, got) if got >= top else (best, top)


def best_start(source: DataFrame, target: DataFrame, starts: list[np.ndarray], level: tuple[float, float], item: str, target_item: str) -> np.ndarray:
    """The candidate whose short registration fits best."""
    return max((icp(source, target, [level], item, target_item, s, most=3) for s in starts), key=lambda r: r[1])[0]


def structure_raster(points: DataFrame, cell: float, band: tuple[float, float], least: int) -> DataFrame:
    """(ix, iy): columns with enough points in the height band above their lowest point."""
    cells = grid.with_cell(points, cell, ["x", "y"], ["ix", "iy"])
    ground = cells.groupBy("ix", "iy").agg(F.min("z").alias("ground"))
    above = cells.join(ground, ["ix", "iy"]).where((F.col("z") - F.col("ground")).between(*band))
    return above.groupBy("ix", "iy").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("ix", "iy")


def coarse_align(source: DataFrame, target: DataFrame, cell: float, band: tuple[float, float], least: int, yaw_step: float, peaks: int = 1, apart: float = 10.0, most_cells: int = 4_000_000) -> list[np.ndarray]:
    """Planar starts (yaw, shift) by normalised cross-correlation of structure rasters, best first.

    Yaw rows are spread over tasks; the target raster is checked for size and broadcast.
    """
    spark = source.sparkSession
    t = structure_raster(target, cell, band, least).limit(most_cells + 1).toPandas().to_numpy()
    if not 0 < len(t) <= most_cells:
        raise ValueError("no structure in the target, or its raster is too large")
    s = structure_raster(source, cell, band, least).limit(most_cells + 1).toPandas().to_numpy()
    if not 0 < len(s) <= most_cells:
        raise ValueError("no structure in the source, or its raster is too large")
    held = spark.sparkContext.broadcast((s, t))

    def score(pdfs):
        import pandas as pd

        src, dst = held.value
        for pdf in pdfs:
            out = []
            for yaw in pdf.yaw:
                a = np.radians(yaw)
                p = np.floor(((src + 0.5) @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]]))).astype(int)
                lo = p.min(axis=0)
                q, d = p - lo, dst - dst.min(axis=0)
                shape = tuple(int(v) for v in q.max(axis=0) + d.max(axis=0) + 2)
                f, g = np.zeros(shape), np.zeros(shape)
                f[q[:, 0], q[:, 1]] = 1
                g[d[:, 0], d[:, 1]] = 1
                c = np.fft.irfft2(np.fft.rfft2(g) * np.conj(np.fft.rfft2(f)), shape)
                at = np.unravel_index(int(c.argmax()), shape)
                shift = [v - n if v > d.max(axis=0)[i] else v for i, (v, n) in enumerate(zip(at, shape))]
                move = (np.array(shift) + dst.min(axis=0) - lo) * cell
                out.append((float(yaw), float(c.max() / np.sqrt(f.sum() * g.sum())), float(move[0]), float(move[1])))
            yield pd.DataFrame(out, columns=["yaw", "score", "dx", "dy"])

    n = int(round(360 / yaw_step))
    rows = spark.range(n).repartition(min(n, 16)).select((F.col("id") * yaw_step).alias("yaw")).mapInPandas(score, "yaw double, score double, dx double, dy double").orderBy(F.desc("score"), "yaw").collect()
    picked: list = []
    for r in rows:
        if len(picked) < peaks and all(min(abs(r["yaw"] - p["yaw"]), 360 - abs(r["yaw"] - p["yaw"])) > apart for p in picked):
            picked.append(r)
    out = []
    for r in picked:
        a, m = np.radians(r["yaw"]), np.eye(4)
        m[:2, :2] = [[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]]
        m[:2, 3] = r["dx"], r["dy"]
        out.append(m)
    return out


def rounds(source: DataFrame, mask, align, start: np.ndarray, most: int = 2, max_tilt: float = 5.0) -> np.ndarray:
    """Mask, register, mask again until the change is below 0.001 degrees and 1 mm.

    mask(points) keeps observed points of the transformed source; align(points) returns an increment.
    """
    now = np.asarray(start, dtype=float)
    for _ in range(most):
        step = align(mask(transform(source, now)))
        new = step @ now
        if np.degrees(np.arccos(np.clip(new[2, 2], -1, 1))) > max_tilt:
            raise ValueError("registration tilts the cloud beyond the guard")
        turn = np.degrees(np.arccos(np.clip((np.trace(step[:3, :3]) - 1) / 2, -1, 1)))
        moved, now = np.linalg.norm(step[:3, 3]), new
        if turn < 1e-3 and moved < 1e-3:
            break
    return now


def relabel_stretches(points: DataFrame, transforms: DataFrame, reference: DataFrame, cap: float, item: str, reference_item: str, max_shift: float = 0.5, max_turn: float = 2.0, least_points: int = 20_000) -> DataFrame:
    """(item, stretch_id, c2c, own): distances under each (group, stretch)'s own transform.

    transforms: gt_group, stretch_id (NULL for the group's own), m (12 doubles, row-major 3x4), shift, turn. A
    stretch's transform is rejected beyond the limits or below least_points points. A lost neighbour gets the cap.
    """
    sizes = points.groupBy("gt_group", "stretch_id").agg(F.count("*").alias("size"))
    own = transforms.where(F.col("stretch_id").isNotNull() & (F.col("shift") <= max_shift) & (F.col("turn") <= max_turn)).join(sizes, ["gt_group", "stretch_id"]).where(F.col("size") >= least_points)
    group = transforms.where(F.col("stretch_id").isNull()).select("gt_group", F.col("m").alias("gm"))
    rows = points.join(own.select("gt_group", "stretch_id", "m"), ["gt_group", "stretch_id"], "left").join(group, "gt_group", "left").where(F.coalesce("m", "gm").isNotNull())
    m = F.coalesce("m", "gm")
    at = rigid.apply([[m[4 * i + j] for j in range(3)] for i in range(3)], [m[4 * i + 3] for i in range(3)], [F.col(c) for c in grid.XYZ])
    moved = rows.select(item, "stretch_id", F.col("m").isNotNull().alias("own"), *[v.alias(c) for v, c in zip(at, grid.XYZ)])
    from pointspark.operators.spatial import nearest_capped

    d = nearest_capped(moved, reference, cap, item, reference_item)
    return moved.select(item, "stretch_id", "own").join(d, item).select(item, "stretch_id", F.coalesce("distance", F.lit(cap)).alias("c2c"), "own")
