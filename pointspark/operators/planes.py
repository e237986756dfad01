"""Adaptive plane map: voxels that hold a plane, else their eight children, down to a fixed depth.

One group-by per level (a handful of rounds): cells are reduced to ten sums (mergeable clusters), the eigenvalues of the few
clusters are taken in an Arrow kernel, and only the points of unresolved cells go on to the next level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointspark.operators import grid
from pointspark.operators.graph import connected_leads
from pointspark.session import cut

PLANE_SCHEMA = "l0 double, l1 double, l2 double, nx double, ny double, nz double"


def eigen_planes(clusters: DataFrame) -> DataFrame:
    """Adds eigenvalues l0 <= l1 <= l2 of the covariance and the normal (its sign makes the largest part positive)."""
    cov = grid.covariance(clusters)
    names = [f.name for f in cov.schema.fields]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = {p: b.column(names.index(f"v{p}")).to_numpy(zero_copy_only=False) for p in ("xx", "xy", "xz", "yy", "yz", "zz")}
            m = np.stack([np.stack([v["xx"], v["xy"], v["xz"]], -1), np.stack([v["xy"], v["yy"], v["yz"]], -1), np.stack([v["xz"], v["yz"], v["zz"]], -1)], -2).reshape(-1, 3, 3)
            w, u = np.linalg.eigh(m)
            n = u[:, :, 0]
            n = n * np.sign(n[np.arange(len(n)), np.abs(n).argmax(axis=1)])[:, None] if len(n) else n.reshape(0, 3)
            cols = [*(np.maximum(w[:, i], 0.0) for i in range(3)), *(n[:, i] for i in range(3))]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, cols)], names=[*names, "l0", "l1", "l2", "nx", "ny", "nz"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cov.schema.fields)
    return cov.mapInArrow(solve, f"{kinds}, {PLANE_SCHEMA}")


def plane_map(points: DataFrame, size: float, min_points: list[int], max_thickness: float, ratios: list[float]) -> DataFrame:
    """(level, ix, iy, iz, n, centroid, covariance, eigenvalues, normal, is_plane) of every leaf.

    A node is a plane if it has more than min_points[level] points, l0 below max_thickness and l0 / l2 below
    ratios[level]; with too few points it stays an unsplit leaf; else it is split until the last level.
    """
    rest = grid.located(points).select(*grid.XYZ)
    out = None
    for level in range(len(min_points)):
        cells = grid.with_cell(rest, size / 2**level)
        nodes = eigen_planes(grid.point_clusters(cells, grid.CELL))
        few = F.col("n") <= min_points[level]
        flat = ~few & (F.col("l0") < max_thickness) & (F.col("l0") < ratios[level] * F.col("l2"))
        nodes = cut(nodes.withColumns({"level": F.lit(level), "is_plane": flat, "split": ~few & ~flat & F.lit(level < len(min_points) - 1)}))
        leaves = nodes.where(~F.col("split")).drop("split")
        out = leaves if out is None else out.unionByName(leaves)
        rest = cells.join(nodes.where("split").select(*grid.CELL), grid.CELL, "left_semi").select(*grid.XYZ)
    return out


def match_planes(points: DataFrame, planes: DataFrame, size: float, levels: int, sigma: float, item: str) -> DataFrame:
    """(item, level, residual, quality): each point with the plane of its deepest leaf within 3 sigma and 9 radii."""
    each = grid.located(points).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    s = F.lit(size) / F.pow(F.lit(2.0), F.col("level").cast("double"))
    each = each.withColumns({n: F.floor(F.col(c) / s).cast("long") for n, c in zip(grid.CELL, grid.XYZ)})
    m = each.select(item, "level", *grid.CELL, *grid.XYZ).join(planes.where("is_plane"), ["level", *grid.CELL])
    off = [F.col(c) - F.col(f"c{c}") for c in grid.XYZ]
    residual = F.abs(off[0] * F.col("nx") + off[1] * F.col("ny") + off[2] * F.col("nz"))
    reach = off[0] ** 2 + off[1] ** 2 + off[2] ** 2
    ok = m.withColumns({"residual": residual, "quality": F.col("l0") / F.col("l2")}).where((residual < 3 * sigma) & (reach - residual**2 <= 9 * F.col("l2")))
    return ok.groupBy(item).agg(F.max_by(F.struct("level", "residual", "quality"), "level").alias("m")).select(item, "m.*")


def support(points: DataFrame, size: float, residual: str) -> DataFrame:
    """(cell, scans, scatter products, residual sd): distinct scans and Welford-style sd with at least 3 samples."""
    n = F.count(residual)
    return grid.with_cell(points, size).groupBy(*grid.CELL).agg(F.countDistinct("scan_id").alias("scans"), n.alias("n"), F.when(n >= 3, F.stddev_samp(residual)).alias("sd"))


def view_diversity(views: DataFrame, by: list[str], dx: str, dy: str, dz: str) -> DataFrame:
    """(by, n, diversity): smallest eigenvalue of the mean outer product of unit view directions, in [0, 1/3]."""
    norm = F.sqrt(F.col(dx) ** 2 + F.col(dy) ** 2 + F.col(dz) ** 2)
    unit = views.where(norm > 0).select(*by, *[(F.col(c) / norm).alias(a) for c, a in zip((dx, dy, dz), grid.XYZ)])
    sums = grid.point_clusters(unit, by)
    # about the origin, not the mean: with zero sums the covariance is the mean outer product
    about = sums.withColumns({f"s{c}": F.lit(0.0) for c in grid.XYZ})
    return eigen_planes(about).select(*by, "n", F.col("l0").alias("diversity"))


def plane_labels(planes: DataFrame, max_angle: float, max_offset: float) -> DataFrame:
    """(level, ix, iy, iz, label): neighbouring planes of one level merged by normal and distance.

    Pairs come from an equi-join on the level and the 26 cells around; labels are the smallest cell of the connected planes.
    """
    node = ["level", *grid.CELL]
    p = planes.where("is_plane").select(*node, "cx", "cy", "cz", "nx", "ny", "nz").withColumn("id", F.struct(*node))
    moved = p
    for c in grid.CELL:
        moved = moved.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    a, b = p.alias("a"), moved.alias("b")
    cos = F.abs(sum((F.col(f"a.n{c}") * F.col(f"b.n{c}") for c in ("y", "z")), F.col("a.nx") * F.col("b.nx")))
    off = F.abs(sum(((F.col(f"a.c{c}") - F.col(f"b.c{c}")) * F.col(f"a.n{c}") for c in ("y", "z")), (F.col("a.cx") - F.col("b.cx")) * F.col("a.nx")))
    near = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in node]).where((F.col("a.id") > F.col("b.id")) & (cos >= F.cos(F.radians(F.lit(max_angle)))) & (off <= max_offset))
    # the components of the plane graph, over dense numbers of the cells
    number = cut(p.select("id").withColumn("k", F.monotonically_increasing_id()))
    edges = near.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).join(number.select(F.col("id").alias("a"), F.col("k").alias("u")), "a").join(number.select(F.col("id").alias("b"), F.col("k").alias("v")), "b").select("u", "v")
    leads = connected_leads(edges)
    owner = number.join(leads, F.col("k") == F.col("node"), "left").select("id", F.coalesce("lead", "k").alias("group"))
    label = owner.groupBy("group").agg(F.min("id").alias("label"))
    return owner.join(label, "group").select("id.*", F.concat_ws("|", *[f"label.{c}" for c in node]).alias("label"))
