"""Column-level data quality profile of delivered loads.

Every column is unpivoted to (load, column, value) and counted once; frequencies, distinct counts and ranges
are aggregates of those counts. Loads are compared with the load before them in the feed by missing share,
distinct count, population stability index, chi-square and the largest gap between the two distributions.

The distribution gap is exact without ever ordering a whole load in one task: values fall into order-preserving
buckets (eight an octave), cumulative shares at bucket borders come from the small bucket table, and only buckets in
which the gap could still pass the limit are resolved value by value.

Defined cases: NULL, NaN and values within 1e-6 of a rule's sentinel are missing (text: NULL, empty or only
blanks); infinities are valid values; a load without a predecessor has NULL change figures; an empty table gives an
empty profile; columns that the caller doesn't name are ignored, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from pointspark.session import cut

TOLERANCE = 1e-6
MIN_VALUES = 50
#: So many open buckets are broadcast to the rows; beyond that they are joined by a shuffle.
BROADCAST_BINS = 200_000
MISSING_RISE = 15  # per cent
SHIFT_GAP = 0.25
PER_OCTAVE = 8


@dataclass(frozen=True)
class ColumnRule:
    """What a column may hold; None where a rule has no such part."""

    column: str
    sentinel: float | None = None
    lo: float | None = None
    hi: float | None = None
    whole: bool = False
    pattern: str | None = None


def rules_from_table(rules: DataFrame) -> list[ColumnRule]:
    """Rules are configuration, one row a column, so they are read to the driver."""
    ok = lambda v: None if v is None or v != v else v
    return [ColumnRule(r["column_name"], ok(r["sentinel"]), ok(r["lo"]), ok(r["hi"]), bool(r["whole"]), r["pattern"]) for r in rules.collect()]


def _is_text(kind: T.DataType) -> bool:
    return isinstance(kind, T.StringType)


def value_bucket(v: Column, per_octave: int = PER_OCTAVE) -> Column:
    """Order-preserving integer code of a double; equal values share a code."""
    mag = F.when(F.abs(v) > 1e300, 1125 * per_octave).otherwise(F.floor(F.log2(F.abs(v)) * per_octave))
    return F.when(v == 0, 0).otherwise(F.signum(v) * (mag + 1250 * per_octave)).cast("int")


def _entries(df: DataFrame, rules: list[ColumnRule], load: str, only: list[int] | None = None) -> DataFrame:
    """(load, c, v, t, w): the unpivoted table; v a number, w a 64-bit whole number kept exactly, t a text; all NULL if missing."""
    entries = []
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for i, r in enumerate(rules):
        if only is not None and i not in only:
            continue
        kind, col = kinds[r.column], F.col(f"`{r.column}`")
        v, t, w = F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(None).cast("long")
        if _is_text(kind):
            t = F.when(F.trim(col) != "", col)
        elif isinstance(kind, T.LongType):
            w = col if r.sentinel is None else F.when(F.abs(col.cast("double") - F.lit(r.sentinel)) > TOLERANCE, col)
        else:
            num = F.unix_micros(col.cast("timestamp")).cast("double") if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else col.cast("double")
            missing = F.isnan(num)
            if r.sentinel is not None:
                missing |= F.abs(num - F.lit(r.sentinel)) <= TOLERANCE
            v = F.when(~missing, num)
        entries.append(F.struct(F.lit(i).alias("c"), v.alias("v"), t.alias("t"), w.alias("w")))
    return df.select(F.col(load).alias("load"), F.explode(F.array(*entries)).alias("e")).select("load", "e.*")


def value_counts(df: DataFrame, rules: list[ColumnRule], load: str = "load_id") -> DataFrame:
    """(load, c, v, t, n): how often each valid value of each column occurs in each load; v and t NULL for missing."""
    counts = _entries(df, rules, load).groupBy("load", "c", "v", "t", "w").agg(F.count("*").alias("n"))
    return counts.select("load", "c", F.coalesce("v", F.col("w").cast("double")).alias("v"), "t", "n")


def load_order(df: DataFrame, feed: str = "feed_id", load: str = "load_id", seq: str = "load_seq") -> DataFrame:
    """(feed, load, seq, before, after): each load with its neighbours in the feed."""
    w = W.partitionBy("feed").orderBy("seq", "load")
    loads = df.groupBy(F.col(feed).alias("feed"), F.col(load).alias("load")).agg(F.min(seq).alias("seq"))
    return loads.select("*", F.lag("load").over(w).alias("before"), F.lead("load").over(w).alias("after"))


def _breaks(rules: list[ColumnRule]) -> tuple[Column, Column]:
    """Conditions on (c, v, t): out of the rule's range; against its pattern."""
    c, v, t = F.col("c"), F.col("v"), F.col("t")
    out, bad = F.lit(False), F.lit(False)
    for i, r in enumerate(rules):
        here = c == i
        if r.lo is not None:
            out |= here & (v < r.lo)
        if r.hi is not None:
            out |= here & (v > r.hi)
        if r.whole:
            bad |= here & (F.abs(v) < float("inf")) & (v != F.floor(v).cast("double"))
        if r.pattern is not None:
            text = F.coalesce(t, v.cast("string"))
            bad |= here & ~text.rlike(rf"\A(?:{r.pattern})\z")
    return F.coalesce(out, F.lit(False)), F.coalesce(bad, F.lit(False))


def profile_loads(df: DataFrame, rules: list[ColumnRule], feed: str = "feed_id", load: str = "load_id", seq: str = "load_seq", resolve: bool = False) -> DataFrame:
    """One row a load and column: counts, ranges, broken rules, and the change against the load before it.

    largest_gap is exact with ``resolve``, and so are PSI and chi-square of texts, over their values; else largest_gap is a lower bound that
    is exact in whether it exceeds SHIFT_GAP, and texts are compared in 64 hash bins.
    """
    counts = value_counts(df, rules, load)
    out, bad = _breaks(rules)
    valid = F.col("v").isNotNull() | F.col("t").isNotNull()
    n = F.col("n")
    coded = counts.select("*", F.when(valid, F.coalesce(value_bucket(F.col("v")), F.pmod(F.xxhash64("t"), F.lit(64)).cast("int"))).alias("b"), valid.alias("valid"), out.alias("out"), bad.alias("bad"))

    coded = cut(coded) if resolve else coded  # written once, since the values are read again
    bins = coded.groupBy("load", "c", "b").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("valid"), 1).otherwise(0)).alias("kinds"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        F.min("t").alias("tlo"), F.max("t").alias("thi"), F.sum(F.when(F.col("out"), n).otherwise(0)).alias("out"), F.sum(F.when(F.col("bad"), n).otherwise(0)).alias("bad"), F.max(F.when(F.col("valid"), n)).alias("top"),
    )
    bins = cut(bins)  # a few thousand rows a load, read by four branches below
    stats = bins.groupBy("load", "c").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("b").isNull(), n).otherwise(0)).alias("missing"), F.sum("kinds").alias("distinct_values"), F.min("lo").alias("min_value"), F.max("hi").alias("max_value"),
        F.min("tlo").alias("min_text"), F.max("thi").alias("max_text"), F.sum("out").alias("out_of_range"), F.sum("bad").alias("off_pattern"), F.max("top").alias("top_count"),
    )
    order = load_order(df, feed, load, seq)

    both = lambda rows, *keep: (  # noqa: E731  each row for its own load and, as the past, for the load after it
        rows.join(order.select("load", "after", "before"), "load")
        .select(*keep, F.explode(F.array(F.struct(F.when(F.col("before").isNotNull(), F.col("load")).alias("pair"), n.alias("now"), F.lit(0).cast("long").alias("past")), F.struct(F.col("after").alias("pair"), F.lit(0).cast("long").alias("now"), n.alias("past")))).alias("p"))
        .select("p.*", *keep)
        .where(F.col("pair").isNotNull())
    )
    border = both(bins.where(F.col("b").isNotNull()), "c", "b").groupBy("pair", "c", "b").agg(F.sum("now").alias("now"), F.sum("past").alias("past"))
    upto, whole = W.partitionBy("pair", "c").orderBy("b"), W.partitionBy("pair", "c")
    border = border.select("*", F.sum("now").over(upto).alias("now1"), F.sum("past").over(upto).alias("past1"), F.sum("now").over(whole).alias("now_all"), F.sum("past").over(whole).alias("past_all"))
    N, P = F.col("now_all").cast("double"), F.col("past_all").cast("double")
    gap = lambda a, b: F.abs(a * P - b * N) / (N * P)
    border = border.where((N > 0) & (P > 0)).withColumns({
        "now0": F.col("now1") - F.col("now"), "past0": F.col("past1") - F.col("past"),
        "gap": gap(F.col("now1"), F.col("past1")),
        "most": F.greatest(gap(F.col("now1"), F.col("past1") - F.col("past")), gap(F.col("now1") - F.col("now"), F.col("past1"))),
    })
    pn, pp = (F.col("now") + 0.5) / (N + 0.5), (F.col("past") + 0.5) / (P + 0.5)
    rate = (F.col("now") + F.col("past")) / (N + P)
    distances = [
        F.sum((pn - pp) * F.log(pn / pp)).alias("psi"),
        F.sum(F.pow(F.col("now") - N * rate, F.lit(2)) / (N * rate) + F.pow(F.col("past") - P * rate, F.lit(2)) / (P * rate)).alias("chi_square"),
    ]
    change = border.groupBy("pair", "c").agg(F.max("gap").alias("gap"), *distances)
    # value by value only where a bucket may hide a gap beyond the largest one at borders, or, if that is enough, beyond the limit
    text = [i for i, r in enumerate(rules) if _is_text(df.schema[r.column].dataType)]
    open_bins = border.drop("gap").where(~F.col("c").isin(text)).join(change.select("pair", "c", "gap"), ["pair", "c"]).where(F.col("most") > F.col("gap") if resolve else (F.col("most") > SHIFT_GAP) & (F.col("gap") <= SHIFT_GAP)).select("pair", "c", "b", "now0", "past0", "now_all", "past_all")
    sides = F.array(F.struct(F.col("pair").alias("load"), F.lit(True).alias("new")), F.struct(F.col("before").alias("load"), F.lit(False).alias("new")))
    open_bins = cut(open_bins.join(order.select(F.col("load").alias("pair"), "before"), "pair").select("*", F.explode(sides).alias("s")).select("pair", "c", "b", "now0", "past0", "now_all", "past_all", "s.load", "s.new"))
    keys = ["pair", "c", "b", "v", "now0", "past0", "now_all", "past_all"]
    if open_bins.count() <= BROADCAST_BINS:
        # rows outside the few open buckets are dropped where they are read, before anything is counted or moved
        numbers = [i for i in range(len(rules)) if i not in text]
        raw = _entries(df, rules, load, numbers) if numbers else _entries(df, rules, load).limit(0)
        raw = raw.withColumn("v", F.coalesce("v", F.col("w").cast("double"))).where(F.col("v").isNotNull()).select("load", "c", "v", value_bucket(F.col("v")).alias("b"))
        fine = raw.join(F.broadcast(open_bins), ["load", "c", "b"]).groupBy(*keys).agg(F.count_if("new").alias("now"), F.count_if(~F.col("new")).alias("past"))
    else:  # most buckets are open: the counts of their values are fewer than the rows
        met = coded.where(F.col("v").isNotNull()).select("load", "c", "b", "v", "n").join(open_bins, ["load", "c", "b"])
        fine = met.groupBy(*keys).agg(F.sum(F.when(F.col("new"), n).otherwise(0)).alias("now"), F.sum(F.when(F.col("new"), 0).otherwise(n)).alias("past"))
    within = W.partitionBy("pair", "c", "b").orderBy("v")
    fine = fine.select("pair", "c", gap(F.col("now0") + F.sum("now").over(within), F.col("past0") + F.sum("past").over(within)).alias("gap")).groupBy("pair", "c").agg(F.max("gap").alias("fine"))

    if resolve and text:  # texts have no order, so their distributions are compared value by value
        words = both(coded.where(F.col("t").isNotNull()), "c", "t").groupBy("pair", "c", "t").agg(F.sum("now").alias("now"), F.sum("past").alias("past"))
        sums = border.where(F.col("c").isin(text)).groupBy("pair", "c").agg(F.max("now_all").alias("now_all"), F.max("past_all").alias("past_all"))
        words = words.join(sums, ["pair", "c"])
        change = change.where(~F.col("c").isin(text)).unionByName(words.groupBy("pair", "c").agg(F.lit(None).cast("double").alias("gap"), *distances))

    before = stats.select(F.col("load").alias("before"), "c", F.col("rows").alias("rows_before"), F.col("missing").alias("missing_before"), F.col("distinct_values").alias("distinct_before"))
    names = F.array(*[F.lit(r.column) for r in rules])
    return (
        stats.join(order, "load")
        .join(before, ["before", "c"], "left")
        .join(change.withColumnRenamed("pair", "load"), ["load", "c"], "left")
        .join(fine.withColumnRenamed("pair", "load"), ["load", "c"], "left")
        .select(
            F.col("feed").alias(feed), F.col("load").alias(load), F.col("seq").alias(seq), F.element_at(names, F.col("c") + 1).alias("column_name"), "rows", "missing", "distinct_values", "min_value", "max_value", "min_text", "max_text",
            "out_of_range", "off_pattern", "top_count", "rows_before", "missing_before", "distinct_before", "psi", "chi_square", F.when(~F.col("c").isin(text), F.greatest("gap", "fine")).alias("largest_gap"),
        )
    )


def find_issues(profile: DataFrame, load: str = "load_id") -> DataFrame:
    """(load, column_name, issue): range, pattern, missing, distinct and shift."""
    rows, past = F.col("rows").cast("double"), F.col("rows_before").cast("double")
    enough = (F.col("rows") - F.col("missing") >= MIN_VALUES) & (F.col("rows_before") - F.col("missing_before") >= MIN_VALUES)
    found = {
        "range": F.col("out_of_range") > 0,
        "pattern": F.col("off_pattern") > 0,
        "missing": (F.col("missing") * past - F.col("missing_before") * rows) * 100 > rows * past * MISSING_RISE,
        "distinct": enough & (F.col("distinct_values") * 5 < F.col("distinct_before")),
        "shift": enough & (F.col("largest_gap") > SHIFT_GAP),
    }
    issues = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in found.items()]))
    return profile.select(load, "column_name", F.explode(issues).alias("issue"))
