"""Score cutoffs that keep a target fraction of each source's records.

The scores are range-sorted by (source, score, id) and written once with the number of their partition. Counts per
partition and source (one small row each) are prefix-summed to find the partition that holds the wanted rank, and only
that partition's rows of the source are ranked to read the exact row. The id in the sort key splits tied scores
over partitions too, so neither a hot source nor one hot score value ends up in a single task.

Defined cases: NULL, NaN and negative scores take no part; repeated (source, id) rows count once (the smallest score,
should they differ); infinite scores are the largest; sources without a fraction, and fractions without a source, give no
cutoff; a fraction of 0 still yields the smallest score; the cutoff keeps all records tied with it; empty input gives
empty output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pointspark.session import cut, shuffle_partitions

KEY = ["score_name", "source"]


def clean_scores(df: DataFrame, score_name: str, source: str, item: str, score: str) -> DataFrame:
    """(score_name, source, item, score): one valid score of each item of a source."""
    value = F.col(score).cast("double")
    rows = df.select(F.lit(score_name).alias("score_name"), F.col(source).alias("source"), F.col(item).alias("item"), value.alias("score"))
    return rows.where((F.col("score") >= 0) & ~F.isnan("score") & F.col("source").isNotNull() & F.col("item").isNotNull()).groupBy(*KEY, "item").agg(F.min("score").alias("score"))


def range_sorted(scores: DataFrame) -> DataFrame:
    """The scores with the number ``part`` of their place in the global (source, score, id) order.

    Written to the shared folder: partition numbers stay fixed if an executor is lost later on.
    """
    n = shuffle_partitions(scores.sparkSession)
    return cut(scores.repartitionByRange(n, *KEY, "score", "item").withColumn("part", F.spark_partition_id()))


def cutoffs(ranged: DataFrame, fractions: DataFrame) -> DataFrame:
    """(score_name, source, permille, n, cutoff) from range-sorted scores; fractions: (source, permille)."""
    counts = ranged.groupBy(*KEY, "part").agg(F.count("*").alias("here"))
    upto, whole = W.partitionBy(*KEY).orderBy("part"), W.partitionBy(*KEY)
    counts = counts.select("*", F.sum("here").over(upto).alias("until"), F.sum("here").over(whole).alias("n"))
    rank = F.greatest(F.expr("(n * permille + 999) div 1000"), F.lit(1))
    target = (
        counts.join(fractions.where(F.col("permille").isNotNull()), "source")
        .withColumn("rank", F.least(rank, F.col("n")))
        .where((F.col("rank") <= F.col("until")) & (F.col("rank") > F.col("until") - F.col("here")))
        .select(*KEY, "part", "permille", "n", (F.col("rank") - F.col("until") + F.col("here")).alias("at"))
    )
    order = W.partitionBy(*KEY, "part").orderBy("score", "item")
    rows = ranged.join(target, [*KEY, "part"]).withColumn("row", F.row_number().over(order)).where(F.col("row") == F.col("at"))
    return rows.select(*KEY, "permille", "n", F.col("score").alias("cutoff"))


def decide(scores: DataFrame, fractions: DataFrame) -> DataFrame:
    """Every scored item with its source's cutoff and whether it is kept (score <= cutoff)."""
    ranged = range_sorted(scores)
    return ranged.drop("part").join(cutoffs(ranged, fractions), KEY).withColumn("keep", F.col("score") <= F.col("cutoff"))


def report(decided: DataFrame) -> DataFrame:
    """(score_name, source, permille, n, cutoff, kept) of each source."""
    return decided.groupBy(*KEY, "permille", "n", "cutoff").agg(F.sum(F.col("keep").cast("long")).alias("kept"))
