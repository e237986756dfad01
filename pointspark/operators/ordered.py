"""Global order without a global task: running sums, ranks and exact quantiles over range-sorted partitions.

Rows are range-partitioned by (group, order), written once with their partition number, and only per-partition totals
(one row a group and partition) are prefix-summed; the rest happens inside partitions. A hot group is spread over as many
partitions as its share of rows asks for. NULL groups are groups of their own in sums; NULL values have no rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pointspark.session import cut, shuffle_partitions


def range_sorted(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    n = shuffle_partitions(df.sparkSession)
    return cut(df.repartitionByRange(n, *[F.col(b) for b in by], *order).withColumn("_part", F.spark_partition_id()))


def running_sums(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds inclusive running sums of expressions within groups, in ``order`` (which must be unique in a group)."""
    rows = range_sorted(df.withColumns({f"_v_{k}": c for k, c in sums.items()}), by, order)
    totals = rows.groupBy(*by, "_part").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*[F.col(b).alias(f"_b_{b}") for b in by], F.col("_part").alias("_p"), *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_s_{k}") for k in sums])
    same = F.col("_part") == F.col("_p")
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"_b_{b}"))
    inside = W.partitionBy(*by, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({k: F.sum(f"_v_{k}").over(inside) for k in sums}).join(starts, same)
    return rows.withColumns({k: F.col(k) + F.col(f"_s_{k}") for k in sums}).select(*df.columns, *sums)


def gaps_in_order(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, gap): the step from each value to the next larger one (or its equal) of the group; the last one has none.

    Inside partitions it is a window; across them only each partition's first value (one row a group and partition) is looked at.
    """
    rows = range_sorted(df.select(*by, value).withColumn("_tie", F.monotonically_increasing_id()), by, [F.col(value), F.col("_tie")])
    heads = rows.groupBy(*by, "_part").agg(F.min(value).alias("_first"))
    after = heads.select(*[F.col(b).alias(f"_b_{b}") for b in by], F.col("_part").alias("_p"), F.lead("_first").over(W.partitionBy(*by).orderBy("_part")).alias("_next"))
    same = F.col("_part") == F.col("_p")
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"_b_{b}"))
    inside = rows.select(*by, "_part", value, F.lead(value).over(W.partitionBy(*by, "_part").orderBy(value, "_tie")).alias("_then"))
    out = inside.join(after, same).select(*by, (F.coalesce("_then", "_next") - F.col(value)).alias("gap"))
    return out.where(F.col("gap").isNotNull())


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the row number in the group."""
    return running_sums(df, by, order, {name: F.lit(1)})


def quantile_rows(df: DataFrame, by: list[str], value: Column, asks: Column) -> DataFrame:
    """(by, n, name, q) for every ask, an array of (name, h) with h = p (n - 1) given as an expression on n."""
    rows = df.select(*by, value.cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v")).withColumn("_tie", F.monotonically_increasing_id())
    rows = range_sorted(rows, by, [F.col("_v"), F.col("_tie")])
    counts = rows.groupBy(*by, "_part").agg(F.count("*").alias("_here"))
    w = W.partitionBy(*by)
    counts = counts.select("*", F.sum("_here").over(w.orderBy("_part")).alias("_until"), F.sum("_here").over(w).alias("n"))
    want = counts.withColumn("_a", F.explode(asks)).select(*by, "_part", "_here", "_until", "n", "_a.name", "_a.h")
    want = want.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("h"), F.ceil("h"))))).where((F.col("_rank") < F.col("_until")) & (F.col("_rank") >= F.col("_until") - F.col("_here")))
    want = want.select(*[F.col(b).alias(f"_b_{b}") for b in by], F.col("_part").alias("_p"), "n", "name", "h", (F.col("_rank") - F.col("_until") + F.col("_here") + 1).alias("_at"))
    numbered = rows.withColumn("_row", F.row_number().over(W.partitionBy(*by, "_part").orderBy("_v", "_tie")))
    same = (F.col("_part") == F.col("_p")) & (F.col("_row") == F.col("_at"))
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"_b_{b}"))
    got = numbered.join(want, same).groupBy(*by, "n", "name", "h").agg(F.min("_v").alias("a"), F.max("_v").alias("b"))
    q = F.col("a") + F.when(F.col("b") > F.col("a"), (F.col("b") - F.col("a")) * (F.col("h") - F.floor("h"))).otherwise(0.0)
    return got.select(*by, "n", "name", q.alias("q"))


def exact_quantiles(df: DataFrame, by: list[str], value: Column, probs: dict[str, float]) -> DataFrame:
    """(by, n, one column a probability): linearly interpolated quantiles, read from the rows that hold the wanted ranks."""
    asks = F.array(*[F.struct(F.lit(k).alias("name"), (F.lit(p) * (F.col("n") - 1)).alias("h")) for k, p in probs.items()])
    return quantile_rows(df, by, value, asks).groupBy(*by, "n").agg(*[F.max(F.when(F.col("name") == k, F.col("q"))).alias(k) for k in probs])
