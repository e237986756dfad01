import numpy as np
import pytest
from pyspark.sql import functions as F

from pointspark.operators import metrics, model, ordered, stats


def test_running_sums_over_many_partitions(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("o"), F.lit(1).alias("v"))
    got = ordered.running_sums(df, ["g"], [F.col("o")], {"s": F.col("v")}).toPandas()
    assert all((got.s == got.o // 3 + 1))


def test_quantiles_match_numpy(spark):
    r = np.random.default_rng(0)
    v = np.round(r.exponential(1, 500), 2)
    df = spark.createDataFrame([(i % 2, float(x)) for i, x in enumerate(v)] + [(0, None), (1, float("nan")), (None, 3.0)], "g int, v double")
    got = {r["g"]: r for r in ordered.exact_quantiles(df, ["g"], F.col("v"), {"a": 0.1, "b": 0.9, "c": 1.0}).collect()}
    for g in (0, 1):
        assert [got[g][k] for k in "abc"] == pytest.approx(np.percentile(v[g::2], [10, 90, 100]).tolist())
    assert got[None]["a"] == 3.0 and ordered.exact_quantiles(df.limit(0), ["g"], F.col("v"), {"a": 0.5}).count() == 0


def test_auc_against_pairs_and_all_tied(spark):
    r = np.random.default_rng(1)
    s, y = r.integers(0, 6, 80), r.uniform(0, 0.1, 80)
    df = metrics.scored(spark.createDataFrame([(int(a), float(b)) for a, b in zip(s, y)], "s int, d double"), F.col("s").cast("double"), F.col("d"))
    got = metrics.auc_ap(metrics.score_counts(df, [], F.lit(0.05)), []).first()
    pos, neg = s[y > 0.05], s[y <= 0.05]
    assert got["auc"] == pytest.approx(np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg]))
    tied = metrics.scored(df.drop("score", "distance"), F.lit(1.0), F.col("d"))
    r = metrics.auc_ap(metrics.score_counts(tied, [], F.lit(0.05)), []).first()
    assert r["auc"] == pytest.approx(0.5) and r["ap"] == pytest.approx(r["base"])
    assert metrics.auc_ap(metrics.score_counts(tied, [], F.lit(9.0)), []).first()["auc"] is None


def test_budget_curve_keeps_null_scores_last(spark):
    df = metrics.scored(spark.createDataFrame([(i, float(i) if i < 9 else None, 0.01 * i) for i in range(10)], "id long, s double, d double"), F.col("s"), F.col("d"))
    c = {r["budget"]: r for r in metrics.budget_curve(df, [], "id", 0.05, [0.0, 0.1, 0.5]).collect()}
    assert c[0.0]["kept"] == 10 and c[0.1]["mean_c2c"] == pytest.approx(0.04) and c[0.5]["outlier_rate"] == 0.0


def test_rank_normalise(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(11)] + [("a", None), ("b", 4.0), ("b", 4.0)], "g string, v double")
    out = stats.rank_normalise(df, ["g"], "v", stats.quantile_edges(df, ["g"], "v", 11)).toPandas()
    a = out[out.g == "a"].dropna().sort_values("v")
    assert a.v_rank.tolist() == pytest.approx((a.v / 10).tolist()) and out[out.g == "b"].v_rank.tolist() == [4.0, 4.0]


def test_booster_learns_mean_and_quantile_and_survives_nan():
    r = np.random.default_rng(3)
    x = r.uniform(0, 1, (3000, 3))
    y = 2 * (x[:, 0] > 0.5) + x[:, 1] + r.exponential(0.2, 3000)
    x[::7, 2] = np.nan
    m = model.Booster("mean", most=60).fit(x[:2000], y[:2000], x[2000:2500], y[2000:2500])
    assert np.mean((m.predict(x[2500:]) - y[2500:]) ** 2) < 0.3 * np.var(y)
    q = model.Booster("q90", most=60).fit(x[:2000], y[:2000])
    assert 0.82 < np.mean(y[2500:] < q.predict(x[2500:])) < 0.97
    again, names = model.Booster.from_json(q.to_json(["a", "b", "c"]))
    assert names == ["a", "b", "c"] and np.allclose(again.predict(x), q.predict(x))
    imp = model.permutation_importance(m, ["a", "b", "c"], x[2500:], y[2500:])
    assert model.top_features(imp, 1) == ["a"]


def test_feature_names_and_groups(spark):
    assert [model.family(c) for c in ("range", "ring_rough", "balm_res", "balm_res__dev_k30", "roughness_r015")] == list("ABCDE")
    assert model.exclude(["range", "range__dev_k6", "balm_res"], ["range"]) == ["balm_res"]
    with pytest.raises(ValueError):
        model.drop_columns(spark.range(1), ["nope"])
    df = spark.createDataFrame([(1, "s", -1), (2, "s", 4), (3, "t", 4), (4, "t", None)], "id long, scene string, g int")
    assert df.select(model.group_key(F.col("g"), F.col("scene"), F.col("id"))).distinct().count() == 4
    assert model.duplicate_channels(df.withColumn("h", F.col("g")), ["g", "h"]) == [("g", "h")]
    assert model.holdout_scenes(["north_a", "south_b"], ["_b"]) == ["south_b"]


def test_fit_uses_the_held_out_groups_in_the_end(spark):
    r = np.random.default_rng(5)
    rows = [(i, float(a), float(2 * a + r.normal() / 9), i % 5 == 0) for i, a in enumerate(r.uniform(0, 1, 500))]
    df = spark.createDataFrame(rows, "id long, a double, y double, validation boolean")
    got = model.fit(df, ["a"], "y", "id")
    x, y, v = model.training_sample(df, ["a"], "y", "id")
    held = model.Booster().fit(x[~v], y[~v], x[v], y[v])
    assert got.start == pytest.approx(y.mean()) and got.start != held.start
    assert len(got.trees) == len(held.trees) and np.allclose(got.predict(x), model.Booster(most=len(held.trees)).fit(x, y).predict(x))
