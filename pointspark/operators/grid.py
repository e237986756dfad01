"""Lattices, tiles and halos; aggregates per cell.

Cells are structs of floored longs, so there is no limit on the lattice. Defined cases: rows with a NULL, NaN or infinite
coordinate have no cell and take no part; ties are broken by the given id; empty input gives empty output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pointspark.functions.missing import finite

XYZ = ["x", "y", "z"]
CELL = ["ix", "iy", "iz"]


def located(df: DataFrame, dims: list[str] = XYZ) -> DataFrame:
    """Rows whose coordinates are all finite."""
    ok = F.lit(True)
    for c in dims:
        ok &= finite(c).isNotNull()
    return df.where(ok)


def in_box(df: DataFrame, lo: tuple[float, ...], hi: tuple[float, ...], margin: float = 0.0, dims: list[str] = XYZ) -> DataFrame:
    """Rows in a bounding box grown by a margin (P9): plain comparisons, which reach the scan."""
    ok = F.lit(True)
    for c, a, b in zip(dims, lo, hi):
        ok &= (F.col(c) >= a - margin) & (F.col(c) <= b + margin)
    return df.where(ok)


def with_cell(df: DataFrame, size: float, dims: list[str] = XYZ, names: list[str] = CELL) -> DataFrame:
    return located(df, dims).withColumns({n: F.floor(F.col(c) / size).cast("long") for n, c in zip(names, dims)})


def keep_first(df: DataFrame, size: float, key: list[str]) -> DataFrame:
    """Voxel downsample that keeps the first point of each cell by ``key`` (A2)."""
    rest = [c for c in df.columns if c not in CELL]
    return with_cell(df, size).groupBy(*CELL).agg(F.min_by(F.struct(*rest), F.struct(*key)).alias("p")).select(*CELL, "p.*")


def centroid(df: DataFrame, size: float, key: list[str], carry: list[str], average_xyz: bool = True) -> DataFrame:
    """Voxel downsample to the centroid (or the first point), other columns from the first point, with the count (A3)."""
    xyz = [F.avg(c).alias(c) for c in XYZ] if average_xyz else [F.min_by(c, F.struct(*key)).alias(c) for c in XYZ]
    return with_cell(df, size).groupBy(*CELL).agg(*xyz, *[F.min_by(c, F.struct(*key)).alias(c) for c in carry], F.count("*").alias("n"))


def pairwise_mean(df: DataFrame, size: float, key: list[str]) -> DataFrame:
    """Order-dependent mean p = (p + q) / 2 taken point by point in ``key`` order (A4).

    Unrolled, the r-th point from the end has weight 2^-r and the first one 2^-(n-1), so it is a weighted sum.
    """
    back, cell = W.partitionBy(*CELL).orderBy(*[F.desc(k) for k in key]), W.partitionBy(*CELL)
    rows = with_cell(df, size).select(*CELL, *XYZ, F.row_number().over(back).alias("r"), F.count("*").over(cell).alias("n"))
    w = F.pow(F.lit(2.0), -F.when(F.col("r") == F.col("n"), F.col("n") - 1).otherwise(F.col("r")).cast("double"))
    return rows.groupBy(*CELL).agg(*[F.sum(F.col(c) * w).alias(c) for c in XYZ])


def nearest_to_centroid(df: DataFrame, size: float, key: list[str]) -> DataFrame:
    """The point closest to its cell's centroid (A5); the centroid comes from an aggregate, not from a window over the cell."""
    cells = with_cell(df, size)
    mid = cells.groupBy(*CELL).agg(*[F.avg(c).alias(f"m{c}") for c in XYZ])
    d2 = sum((F.col(c) - F.col(f"m{c}")) ** 2 for c in XYZ)
    rest = [c for c in df.columns if c not in CELL]
    near = cells.join(mid, CELL).groupBy(*CELL).agg(F.min_by(F.struct(*rest), F.struct(F.round(d2, 9), *key)).alias("p"))
    return near.select(*CELL, "p.*")


def point_clusters(df: DataFrame, by: list[str]) -> DataFrame:
    """Mergeable clusters: n, sums of x y z and of their six products."""
    prods = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{c}") for c in XYZ], *[F.sum(F.col(a) * F.col(b)).alias(f"p{a}{b}") for a, b in prods])


def merge_clusters(clusters: DataFrame, by: list[str]) -> DataFrame:
    return clusters.groupBy(*by).agg(*[F.sum(c).alias(c) for c in clusters.columns if c == "n" or c[0] in "sp" and c[1:] in ("x", "y", "z", "xx", "xy", "xz", "yy", "yz", "zz")])


def subtract_clusters(whole: DataFrame, part: DataFrame, by: list[str]) -> DataFrame:
    """Clusters without the points of others of the same keys (A16); a key that the part doesn't have stays, one that is used up goes."""
    sums = [c for c in whole.columns if c not in by]
    less = part.select(*[F.col(k).alias(f"_k_{k}") for k in by], *[F.col(c).alias(f"_{c}") for c in sums])
    same = F.lit(True)
    for k in by:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return whole.join(less, same, "left").select(*by, *[(F.col(c) - F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in sums]).where(F.col("n") > 0)


def transform_clusters(clusters: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """Clusters of the transformed points, from the sums alone (A16): v' = R v + n t, P' = R P R^T + R v t^T + t (R v)^T + n t t^T."""
    r, t, n = [[F.lit(float(v)) for v in row[:3]] for row in matrix[:3]], [F.lit(float(row[3])) for row in matrix[:3]], F.col("n")
    v = [F.col(f"s{c}") for c in XYZ]
    p = [[F.col("p" + "".join(sorted(a + b))) for b in XYZ] for a in XYZ]
    rv = [row[0] * v[0] + row[1] * v[1] + row[2] * v[2] for row in r]
    new = {f"s{c}": rv[i] + n * t[i] for i, c in enumerate(XYZ)}
    for i in range(3):
        for j in range(i, 3):
            rpr = sum((r[i][a] * p[a][b] * r[j][b] for a in range(3) for b in range(3) if (a, b) != (0, 0)), r[i][0] * p[0][0] * r[j][0])
            new[f"p{XYZ[i]}{XYZ[j]}"] = rpr + rv[i] * t[j] + t[i] * rv[j] + n * t[i] * t[j]
    rest = [c for c in clusters.columns if c not in new]
    return clusters.select(*rest, *[e.alias(c) for c, e in new.items()])


def covariance(clusters: DataFrame) -> DataFrame:
    """Centroid and covariance P/n - cc^T of point clusters."""
    n = F.col("n")
    mean = {f"c{c}": F.col(f"s{c}") / n for c in XYZ}
    cov = {f"v{p}": F.col(f"p{p}") / n - F.col(f"s{p[0]}") * F.col(f"s{p[1]}") / (n * n) for p in ("xx", "xy", "xz", "yy", "yz", "zz")}
    keep = [c for c in clusters.columns if not (c[0] in "sp" and c[1:] in ("x", "y", "z", "xx", "xy", "xz", "yy", "yz", "zz"))]
    return clusters.select(*keep, *[v.alias(k) for k, v in {**mean, **cov}.items()])


def raster(df: DataFrame, size: float, value: str) -> DataFrame:
    """Count, mean of a value and lowest z per column of the xy grid.

    The mean is of a sum with nine decimals, so that it is the same in any order of summation; values beyond 10^9 have none.
    """
    exact = finite(value).try_cast("decimal(18,9)")
    mean = F.sum(exact).cast("double") / F.count(exact)
    return with_cell(df, size, ["x", "y"], ["ix", "iy"]).groupBy("ix", "iy").agg(F.count("*").alias("n"), mean.alias("mean_value"), F.min(finite("z")).alias("min_z"))


def raster_majority(df: DataFrame, size: float, code: str) -> DataFrame:
    """Commonest code per column of the xy grid, the lowest of tied ones."""
    counts = with_cell(df, size, ["x", "y"], ["ix", "iy"]).where(F.col(code).isNotNull()).groupBy("ix", "iy", code).agg(F.count("*").alias("n"))
    return counts.groupBy("ix", "iy").agg(F.max_by(code, F.struct("n", -F.col(code))).alias("majority"), F.sum("n").alias("n"))


def tiles(df: DataFrame, size: float, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Owner tile of each row."""
    return located(df, ["x", "y"]).withColumns({"tx": F.floor((F.col("x") - origin[0]) / size).cast("long"), "ty": F.floor((F.col("y") - origin[1]) / size).cast("long")})


def halo(df: DataFrame, size: float, margin: float) -> DataFrame:
    """Each row once for every tile that its box of +-margin touches (J2); the owner is marked."""
    low = lambda c: F.floor((F.col(c) - margin) / size).cast("long")
    high = lambda c: F.floor((F.col(c) + margin) / size).cast("long")
    rows = located(df, ["x", "y"]).withColumn("tx", F.explode(F.sequence(low("x"), high("x")))).withColumn("ty", F.explode(F.sequence(low("y"), high("y"))))
    return rows.withColumn("owned", (F.col("tx") == F.floor(F.col("x") / size)) & (F.col("ty") == F.floor(F.col("y") / size)))


def tile_sizes(df: DataFrame, probe: float, multiples: int) -> DataFrame:
    """(multiple, worst): the fullest tile at every multiple of the probe size, from one count per probe cell."""
    counts = tiles(df, probe).groupBy("tx", "ty").agg(F.count("*").alias("n"))
    each = counts.withColumn("multiple", F.explode(F.sequence(F.lit(1), F.lit(multiples))))
    down = lambda c: F.floor(F.col(c) / F.col("multiple"))
    return each.groupBy("multiple", down("tx").alias("tx"), down("ty").alias("ty")).agg(F.sum("n").alias("n")).groupBy("multiple").agg(F.max("n").alias("worst"))


def choose_tile(df: DataFrame, probe: float, multiples: int, budget: int) -> float:
    """Largest multiple of the probe whose fullest tile stays within the budget, else the probe itself."""
    best = tile_sizes(df, probe, multiples).where(F.col("worst") <= budget).agg(F.max("multiple")).first()[0]
    return probe * (best or 1)


def halo_join(left: DataFrame, right: DataFrame, radius: float, left_id: str, right_id: str, dims: list[str] = XYZ) -> DataFrame:
    """(left_id, right_id, d2) of all pairs closer than radius, as an equi-join on cells of that size.

    The right side is replicated to the cells around its own, so each left row is joined once; pairs are neither grouped nor
    collected here. -0.0 and exact borders are covered because cells are floored on both sides.
    """
    names = [f"c{i}" for i in range(len(dims))]
    a = with_cell(left, radius, dims, names).select(F.col(left_id).alias("a_id"), *[F.col(c).alias(f"a_{c}") for c in dims], *names)
    b = with_cell(right, radius, dims, names).select(F.col(right_id).alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in dims], *names)
    for n in names:
        b = b.withColumn(n, F.explode(F.array(F.col(n) - 1, F.col(n), F.col(n) + 1)))
    d2 = _square([F.col(f"a_{c}") - F.col(f"b_{c}") for c in dims])
    return a.join(b, names).select("a_id", "b_id", d2.alias("d2")).where(F.col("d2") < radius * radius)


def _square(parts: list[Column]) -> Column:
    out = parts[0] * parts[0]
    for p in parts[1:]:
        out = out + p * p
    return out
