import numpy as np
from pyspark.sql import functions as F

from pointspark.llm import splits


def _brute(ids, keysets):
    lead = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i, a in keysets.items():
            for j, b in keysets.items():
                if a & b and lead[i] != lead[j]:
                    lead[i] = lead[j] = min(lead[i], lead[j])
                    changed = True
    return lead


def test_components_match_brute_force(spark):
    r = np.random.default_rng(0)
    rows = [(int(i), *[None if v > 30 else f"{k}{v}" for k, v in zip("ab", r.integers(0, 45, 2))], "x") for i in range(80)]
    rows += rows[:5] + [(None, "a1", None, "x")]
    df = spark.createDataFrame(rows, "item long, a string, b string, lead string")
    got = {r["item"]: r["lead"] for r in splits.relate(df, "item", [F.col("a"), F.col("b")]).collect()}
    assert got == _brute(range(80), {r[0]: {v for v in r[1:3] if v} for r in rows if r[0] is not None})


def test_long_chain(spark):
    df = spark.range(300).select(F.col("id"), F.concat(F.lit("k"), F.col("id")).alias("a"), F.concat(F.lit("k"), F.col("id") + 1).alias("b")).repartition(5)
    assert splits.relate(df, "id", [F.col("a"), F.col("b")]).select("lead").distinct().collect() == [(0,)]


def test_splits_keep_components_and_shares(spark):
    related = spark.range(6000).select(F.col("id").alias("item"), F.when(F.col("id") < 900, 0).otherwise(F.floor(F.col("id") / 3) * 3).alias("lead"))
    labels = related.select("item", (F.col("item") % 4 == 0).cast("int").alias("label"))
    out = splits.assign_splits(related, labels).toPandas()
    assert len(out) == 6000 and (out.groupby("lead").split.nunique() == 1).all()
    share = out.split.value_counts() / 6000
    assert abs(share["train"] - 0.8) < 0.002 and abs(share["validation"] - 0.1) < 0.002
    again = splits.assign_splits(related.repartition(3), labels).toPandas()
    assert dict(zip(out.item, out.split)) == dict(zip(again.item, again.split))


def test_giant_component_goes_where_it_fits():
    plan = splits.allocate([(700, 0, 1), (1, 0, 300)], [0.8, 0.1, 0.1])
    assert plan[0] == [1, 0, 0] and plan[1] == [100, 100, 100]


def test_empty(spark):
    df = spark.createDataFrame([], "item long, a string")
    related = splits.relate(df, "item", [F.col("a")])
    assert related.count() == 0
    assert splits.assign_splits(related, df.select("item", F.lit(1).alias("label"))).count() == 0
