"""Ranking metrics of filters: a higher score is more suspicious; a point is an outlier if its true distance exceeds tau.

Rows without a true distance take no part. A missing score ranks worst (above the largest score), so no row is lost. All
metrics are tie-aware: they work on counts per distinct score. With one empty class AUC and average precision are NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pointspark.functions.missing import finite
from pointspark.operators.ordered import exact_quantiles, ranked, running_sums
from pointspark.operators.profile import value_bucket
from pointspark.session import cut

BUDGETS = [i * 0.02 for i in range(26)]
TAUS = [0.01, 0.02, 0.03, 0.05, 0.08, 0.10, 0.20]
WORST = float("inf")


def scored(df: DataFrame, score: Column, distance: Column) -> DataFrame:
    """Adds score (NULL as worst) and distance; keeps rows with a distance."""
    return df.withColumns({"score": F.coalesce(score, F.lit(WORST)), "distance": distance}).where(F.col("distance").isNotNull())


def score_counts(df: DataFrame, by: list[str], tau: Column) -> DataFrame:
    """(by, score, pos, neg): outliers and inliers of every distinct score; pre-aggregated before anything is ordered."""
    out = F.col("distance") > tau
    return df.groupBy(*by, "score").agg(F.count_if(out).alias("pos"), F.count_if(~out).alias("neg"))


def auc_ap(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, pos, neg, auc, ap, base, lift): ROC AUC (M1), average precision (M2), lift over the base rate (M6)."""
    rows = running_sums(counts, by, [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")})
    agg = rows.groupBy(*by).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("u"), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("p"),
    )
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    base = F.col("pos") / (F.col("pos") + F.col("neg"))
    ap = F.when(both, F.col("p") / F.col("pos"))
    return agg.select(*by, "pos", "neg", F.when(both, F.col("u") / (F.col("pos") * F.col("neg"))).alias("auc"), ap.alias("ap"), base.alias("base"), F.when(both, (ap - base) / (1 - base)).alias("lift"))


def auc_by_tau(df: DataFrame, by: list[str], taus: list[float]) -> DataFrame:
    """auc_ap for several thresholds from one pass over the distinct scores (M7)."""
    rows = df.withColumn("tau", F.explode(F.array(*[F.lit(t) for t in taus])))
    return auc_ap(score_counts(rows, [*by, "tau"], F.col("tau")), [*by, "tau"])


def spearman(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, n, rho): rank correlation with average ranks (M3)."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    out = rows.groupBy(*by, a, b).agg(F.count("*").alias("m"))
    for c in (a, b):
        n = out.groupBy(*by, c).agg(F.sum("m").alias("k"))
        r = running_sums(n, by, [F.col(c)], {"until": F.col("k")}).select(*by, c, (F.col("until") - (F.col("k") - 1) / 2).alias(f"r_{c}"))
        out = out.join(r, [*by, c])
    x, y, m = F.col(f"r_{a}"), F.col(f"r_{b}"), F.col("m")
    s = out.groupBy(*by).agg(F.sum(m).alias("n"), F.sum(m * x).alias("sx"), F.sum(m * y).alias("sy"), F.sum(m * x * x).alias("sxx"), F.sum(m * y * y).alias("syy"), F.sum(m * x * y).alias("sxy"))
    n = F.col("n")
    den = F.sqrt((n * F.col("sxx") - F.col("sx") ** 2) * (n * F.col("syy") - F.col("sy") ** 2))
    return s.select(*by, "n", F.when(den > 0, (n * F.col("sxy") - F.col("sx") * F.col("sy")) / den).alias("rho"))


def nested_quantiles(rows: DataFrame, by: list[str], value: str, level: str, probs: dict[str, float]) -> DataFrame:
    """(by, b, one column a probability): exact quantiles of the rows with level >= b, for every b from 0 up to the largest level.

    Equal (value, level) rows are counted first. Counts per value bucket tell which bucket holds each wanted rank in each nested set;
    only those buckets are read value by value, so no row is copied for every set that it belongs to.
    """
    counts = cut(rows.groupBy(*by, F.col(value).alias("_v"), F.col(level).alias("_l")).agg(F.count("*").alias("_m")).withColumn("_bucket", value_bucket(F.col("_v"), 64)))
    sets = counts.groupBy(*by, "_bucket", "_l").agg(F.sum("_m").alias("_m")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("_l")))).groupBy(*by, "b", "_bucket").agg(F.sum("_m").alias("_here"))
    upto, whole = W.partitionBy(*by, "b").orderBy("_bucket"), W.partitionBy(*by, "b")
    sets = sets.select("*", F.sum("_here").over(upto).alias("_until"), F.sum("_here").over(whole).alias("_n"))
    asks = F.array(*[F.struct(F.lit(k).alias("name"), (F.lit(p) * (F.col("_n") - 1)).alias("h")) for k, p in probs.items()])
    want = sets.withColumn("_a", F.explode(asks)).select("*", "_a.name", "_a.h").withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("h"), F.ceil("h")))))
    want = want.where((F.col("_rank") < F.col("_until")) & (F.col("_rank") >= F.col("_until") - F.col("_here")))
    want = want.select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("_bucket").alias("_wanted"), "b", "name", "h", "_rank", (F.col("_until") - F.col("_here")).alias("_before"))
    same = (F.col("_bucket") == F.col("_wanted")) & (F.col("_l") >= F.col("b"))
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    inside = W.partitionBy(*by, "b", "name", "_rank").orderBy("_v", "_l")
    met = counts.join(want, same).withColumn("_cum", F.col("_before") + F.sum("_m").over(inside)).where(F.col("_cum") > F.col("_rank"))
    at = met.groupBy(*by, "b", "name", "h", "_rank").agg(F.min("_v").alias("_v")).groupBy(*by, "b", "name", "h").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    q = F.col("lo") + F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) * (F.col("h") - F.floor("h"))).otherwise(0.0)
    return at.groupBy(*by, "b").agg(*[F.max(F.when(F.col("name") == k, q)).alias(k) for k in probs])


def budget_curve(df: DataFrame, by: list[str], tie: str, tau: float, budgets: list[float] | None = None) -> DataFrame:
    """Quality of what is left after removing the worst share, for every budget.

    Rows are ranked once; a budget keeps max(bround(n (1 - f)), 1) of them. The kept sets are nested, so a row is described by the
    largest budget that keeps it, and all figures come from counts per budget.
    """
    if not by:
        return budget_curve(df.withColumn("_all", F.lit(0)), ["_all"], tie, tau, budgets).drop("_all")
    steps = sorted({round(b, 2) for b in budgets or BUDGETS})
    rows = ranked(df.select(*by, "score", "distance", tie), by, [F.col("score"), F.col(tie)], "rank")
    keeps = F.array(*[F.greatest(F.bround(F.col("n") * (1 - F.lit(b))), F.lit(1)).cast("long") for b in steps])
    sizes = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("distance") <= tau).alias("inliers")).withColumn("keeps", keeps)
    level = F.size(F.filter("keeps", lambda k: k >= F.col("rank"))) - 1
    rows = rows.join(sizes, by).select(*by, level.alias("level"), "distance").where(F.col("level") >= 0)
    sums = rows.groupBy(*by, "level").agg(F.sum("distance").alias("sum"), F.count_if(F.col("distance") <= tau).alias("good"))
    sums = sums.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("level")))).groupBy(*by, "b").agg(F.sum("sum").alias("sum"), F.sum("good").alias("good"))
    q = nested_quantiles(rows, by, "distance", "level", {"median_c2c": 0.5, "p90_c2c": 0.9})
    out = sums.join(q, [*by, "b"]).join(sizes, by).withColumns({"budget": F.element_at(F.array(*[F.lit(b) for b in steps]), F.col("b") + 1), "kept": F.element_at("keeps", F.col("b") + 1)})
    precision, recall = F.col("good") / F.col("kept"), F.coalesce(F.try_divide("good", "inliers"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return out.select(*by, "budget", (1 - F.col("kept") / F.col("n")).alias("removed"), "kept", (F.col("sum") / F.col("kept")).alias("mean_c2c"), "median_c2c", "p90_c2c", (1 - precision).alias("outlier_rate"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def headline(curve: DataFrame, by: list[str], scorer: str, baseline: str, fractions: list[float]) -> DataFrame:
    """Per cent change of the mean against the baseline scorer at the realised budget closest to each fraction."""
    asked = curve.withColumn("fraction", F.explode(F.array(*[F.lit(f) for f in fractions])))
    row = asked.groupBy(*by, scorer, "fraction").agg(F.min_by(F.struct("removed", "mean_c2c"), F.struct(F.round(F.abs(F.col("removed") - F.col("fraction")), 9), "removed")).alias("r")).select(*by, scorer, "fraction", "r.*")
    base = row.where(F.col(scorer) == baseline).select(*by, "fraction", F.col("mean_c2c").alias("base_mean"))
    return row.join(base, [*by, "fraction"]).select(*by, scorer, "fraction", "removed", "mean_c2c", (F.try_divide(F.col("mean_c2c") - F.col("base_mean"), F.col("base_mean")) * 100).alias("change_percent"))


def long_channels(df: DataFrame, by: list[str], channels: dict[str, Column]) -> DataFrame:
    """One row a point and channel with a value; a channel's missing rows are left out."""
    entries = F.array(*[F.struct(F.lit(n).alias("channel"), c.alias("score")) for n, c in channels.items()])
    return df.select(*by, "distance", F.explode(entries).alias("e")).select(*by, "distance", "e.*").where(F.col("score").isNotNull())


def channel_auc(df: DataFrame, by: list[str], channels: dict[str, Column], tau: float) -> DataFrame:
    """(by, channel, pos, neg, auc, direction): AUC of each channel in its better direction (M8)."""
    out = auc_ap(score_counts(long_channels(df, by, channels), [*by, "channel"], F.lit(tau)), [*by, "channel"])
    return out.select(*by, "channel", "pos", "neg", F.greatest("auc", 1 - F.col("auc")).alias("auc"), F.when(F.col("auc") >= 0.5, 1).otherwise(-1).alias("direction"))


def baselines(df: DataFrame, by: list[str], channels: dict[str, Column], tau: float) -> DataFrame:
    """Every single statistic as a scorer, named classical_<channel>, as it stands: larger is more suspicious."""
    long = long_channels(df, by, {f"classical_{n}": c for n, c in channels.items()})
    return auc_ap(score_counts(long, [*by, "channel"], F.lit(tau)), [*by, "channel"]).withColumnRenamed("channel", "scorer")


def ranking(df: DataFrame, scorers: dict[str, Column], taus: list[float]) -> DataFrame:
    """(tau, scorer, ap, lift, auc, rho, place): scorers by lift, best first, at every threshold (T7); rho is free of one.

    A scorer's missing rows rank worst; ties in lift go to the later name.
    """
    entries = F.array(*[F.struct(F.lit(n).alias("scorer"), F.coalesce(c, F.lit(WORST)).alias("score")) for n, c in scorers.items()])
    long = df.select("distance", F.explode(entries).alias("e")).select("distance", "e.*")
    at = auc_by_tau(long, ["scorer"], taus).where(F.col("ap").isNotNull())
    rho = spearman(long, ["scorer"], "score", "distance").select("scorer", "rho")
    w = W.partitionBy("tau").orderBy(F.desc("lift"), F.desc("scorer"))  # one row a scorer
    return at.join(rho, "scorer", "left").select("tau", "scorer", "ap", "lift", "auc", "rho", F.row_number().over(w).alias("place"))


def by_role(df: DataFrame, dataset: str, held_out: list[str], taus: list[float]) -> DataFrame:
    """(dataset, role, n, tau, auc): the breakdown by dataset, fitted on or held out (M14); AUC is NULL where a class is empty."""
    sizes = df.groupBy(dataset).agg(F.count("*").alias("n"))
    role = F.when(F.col(dataset).isin(held_out), "held out").otherwise("fitted on")
    return auc_by_tau(df, [dataset], taus).join(sizes, dataset).select(dataset, role.alias("role"), "n", "tau", "auc")


def hexbins(df: DataFrame, x: Column, y: Column, size: float) -> DataFrame:
    """(q, r, n): counts in hexagons of a width, by axial coordinates of the nearest centre."""
    third = F.lit(3.0**0.5 / 3)
    q, r = (third * x - y / 3) * 2 / size * F.lit(3.0**0.5) / 2, (y * 2 / 3) * 2 / size * F.lit(3.0**0.5) / 2
    rows = df.where(x.isNotNull() & y.isNotNull()).select(q.alias("a"), r.alias("b")).withColumn("c", -F.col("a") - F.col("b"))
    n = {k: F.floor(F.col(k) + 0.5) for k in "abc"}
    off = {k: F.abs(n[k] - F.col(k)) for k in "abc"}
    worst_a = (off["a"] > off["b"]) & (off["a"] > off["c"])
    worst_b = ~worst_a & (off["b"] > off["c"])
    return rows.select(F.when(worst_a, -n["b"] - n["c"]).otherwise(n["a"]).cast("long").alias("q"), F.when(worst_b, -n["a"] - n["c"]).otherwise(n["b"]).cast("long").alias("r")).groupBy("q", "r").agg(F.count("*").alias("n"))


def losses(df: DataFrame, by: list[str], truth: Column, prediction: Column, q: float) -> DataFrame:
    """(by, n, mse, pinball, coverage): validation losses and the share of truths below the prediction."""
    d = truth - prediction
    rows = df.where(truth.isNotNull() & prediction.isNotNull())
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(d * d).alias("mse"), F.avg(F.greatest(q * d, (q - 1) * d)).alias("pinball"), F.avg((truth < prediction).cast("double")).alias("coverage"))


def overlap(a: DataFrame, b: DataFrame, cells: list[str]) -> DataFrame:
    """(both, only_a, only_b, agreement) of two sets of cells."""
    x = a.select(*cells).distinct().withColumn("a", F.lit(1)).join(b.select(*cells).distinct().withColumn("b", F.lit(1)), cells, "full")
    out = x.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))
    return out.withColumn("agreement", F.try_divide(F.col("both").cast("double"), F.col("both") + F.col("only_a") + F.col("only_b")))


def histogram(df: DataFrame, by: list[str], value: Column, width: float) -> DataFrame:
    """(by, bin, n, cdf): counts per bin and their running share (M17); only bins are ordered."""
    bins = df.where(value.isNotNull()).groupBy(*by, F.floor(value / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    w = W.partitionBy(*by)
    return bins.select("*", (F.sum("n").over(w.orderBy("bin")) / F.sum("n").over(w)).alias("cdf"))


def roc_points(df: DataFrame, by: list[str], tau: float) -> DataFrame:
    """(by, score, fpr, tpr): the ROC curve at every distinct score."""
    if not by:
        return roc_points(df.withColumn("_all", F.lit(0)), ["_all"], tau).drop("_all")
    counts = score_counts(df, by, F.lit(tau))
    rows = running_sums(counts, by, [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")})
    sums = counts.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return rows.join(sums, by).select(*by, "score", F.try_divide("fp", "N").alias("fpr"), F.try_divide("tp", "P").alias("tpr"))


def revalidate(df: DataFrame, stored: str, derived: str, limit_mm: float = 2.0) -> DataFrame:
    """(n, p99_mm, largest_mm, ok): stored labels against re-derived ones."""
    d = F.abs(finite(stored) - finite(derived)) * 1000
    rows = df.select(F.lit(1).alias("one"), d.alias("d"))
    return exact_quantiles(rows, ["one"], F.col("d"), {"p99_mm": 0.99, "largest_mm": 1.0}).select("n", "p99_mm", "largest_mm", (F.col("largest_mm") <= limit_mm).alias("ok"))
