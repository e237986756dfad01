"""Within-scan features of a rotating scanner: one-sided extrapolation along the ring.

The scan is a lattice of rings and columns; the nearest return wins a cell and its figures go to all points of the cell.
Neighbours two to four columns away on each side are needed; a gap makes a side unusable, and an unusable side gives 0 (no
evidence). Neighbours are found by an equi-join on columns, so empty cells need no rows and the lattice may wrap around.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointspark.functions.missing import finite
from pointspark.operators.ordered import gaps_in_order, quantile_rows

SAMPLES, SKIP, MIN_RANGE = 3, 1, 0.10
LEAST_SCALE = 1e-3


def lattice(points: DataFrame, keys: list[str], range_col: str, value_col: str, item: str) -> DataFrame:
    """(keys, ring, col, range, value): the nearest usable return of each cell."""
    usable = points.where((finite(range_col) > MIN_RANGE) & F.col("ring").isNotNull() & F.col("col").isNotNull())
    row = F.min_by(F.struct(finite(range_col).alias("range"), finite(value_col).alias("value")), F.struct(finite(range_col), F.col(item)))
    return usable.groupBy(*keys, "ring", "col").agg(row.alias("r")).select(*keys, "ring", "col", "r.*")


def ring_features(cells: DataFrame, keys: list[str], width: int | None = None) -> DataFrame:
    """(keys, ring, col, detach, edge, rough) of every cell (W4, W5); ``width`` makes columns wrap."""
    k = [*keys, "ring", "col"]
    offsets = [s * (j + 1 + SKIP) for s in (-1, 1) for j in range(SAMPLES)]
    target = F.col("col") - F.col("o")
    spread = cells.where(F.col("value").isNotNull()).select(*keys, "ring", F.col("col"), "value", F.explode(F.array(*[F.lit(o) for o in offsets])).alias("o"))
    # each cell sends its value to the cells that look at it
    spread = spread.withColumn("col", F.pmod(target, F.lit(width)) if width else target)
    seen = spread.groupBy(*k).agg(*[F.max(F.when(F.col("o") == o, F.col("value"))).alias(f"o{i}") for i, o in enumerate(offsets)])
    rows = cells.join(seen, k, "left")

    def side(first: int):
        a, b, c = (F.col(f"o{first + i}") for i in range(SAMPLES))
        s1, s2 = a - b, b - c
        return F.abs(F.col("value") - (a + (s1 + s2) / 2 * (1 + SKIP))), F.abs(s1 - s2)

    (rl, sl), (rr, sr) = side(0), side(SAMPLES)
    scale = F.greatest(F.abs(F.col("value")), F.lit(LEAST_SCALE))
    whole = (rl + rr).isNotNull()
    pick = lambda x: F.when(whole, x / scale).otherwise(0.0)
    return rows.select(*k, pick(F.least(rl, rr)).alias("detach"), pick(F.greatest(rl, rr)).alias("edge"), pick(F.least(sl, sr)).alias("rough"))


def scatter(points: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    """Every point with its cell's features, 0 where the cell has none."""
    out = points.join(features, [*keys, "ring", "col"], "left")
    return out.fillna(0.0, ["detach", "edge", "rough"])


def estimate_columns(points: DataFrame, keys: list[str], azimuth: str, ring: int, least_points: int = 64, least_gaps: int = 32, lo: int = 180, hi: int = 7200) -> DataFrame:
    """(keys, columns): 360 over the upper median positive azimuth gap of one ring; NULL if there is too little evidence."""
    rows = points.where((F.col("ring") == ring) & finite(azimuth).isNotNull()).select(*keys, F.col(azimuth).alias("_az"))
    gaps = gaps_in_order(rows, keys, "_az")
    counts = rows.groupBy(*keys).agg(F.count("*").alias("points"))
    # the upper median is the row at rank floor(n / 2), counted from 0
    mid = quantile_rows(gaps.where(F.col("gap") > 1e-6), keys, F.col("gap"), F.array(F.struct(F.lit("mid").alias("name"), F.floor(F.col("n") / 2).cast("double").alias("h"))))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    counts = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "points")
    n = F.round(F.lit(360.0) / F.col("q")).cast("int")
    return mid.join(counts, same).select(*keys, F.when((F.col("points") >= least_points) & (F.col("n") >= least_gaps) & n.between(lo, hi), n).alias("columns"))
