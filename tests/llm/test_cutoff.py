import math

from pyspark.sql import functions as F

from pointspark.llm import cutoff


def _cut(spark, rows, fractions):
    df = spark.createDataFrame(rows, "src string, id long, s float, keep int")
    scores = cutoff.clean_scores(df, "s", "src", "id", "s")
    return cutoff.decide(scores, spark.createDataFrame(fractions, "source string, permille int"))


def test_cutoffs_with_ties_hot_source_and_missing(spark):
    rows = [("hot", i, float(i // 3), 1) for i in range(3000)] + [("b", i, v, 0) for i, v in enumerate([0.0, 0.0, 2.0, math.inf])] + [("b", 9, math.nan, 0), ("b", 10, -1.0, 0), ("b", 11, None, 0), ("b", 2, 2.0, 0), (None, 1, 1.0, 0), ("c", 1, 1.0, 0)]
    d = _cut(spark, rows, [("hot", 333), ("b", 500), ("c", None), ("z", 100)])
    got = {r["source"]: (r["n"], r["cutoff"], r["kept"]) for r in cutoff.report(d).collect()}
    assert got == {"hot": (3000, 332.0, 999), "b": (4, 0.0, 2)}


def test_extreme_fractions_and_empty(spark):
    rows = [("a", i, float(i), 1) for i in range(10)]
    assert cutoff.report(_cut(spark, rows, [("a", 0)])).first()["kept"] == 1
    assert cutoff.report(_cut(spark, rows, [("a", 1000)])).first()["kept"] == 10
    assert _cut(spark, [], [("a", 5)]).count() == 0
    assert _cut(spark, rows, []).where(F.col("keep")).count() == 0
