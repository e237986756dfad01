import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pointspark.llm import quantiles as q

PROBS = {"p10": 0.1, "p50": 0.5, "p99": 0.99}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(allow_nan=False, width=64), min_size=1, max_size=60))
def test_codes_keep_the_order_and_the_value(values):
    v = np.sort(np.array(values))
    c = q.encode(v)
    assert (np.diff(c) >= 0).all() and c.min() >= 0 and c.max() < 1 << q.BITS
    inside = (np.abs(v) > 2.0**-127) & (np.abs(v) < 2.0**126)
    assert np.allclose(q.decode(c)[inside], v[inside], rtol=2.0 ** -(q.MANTISSA + 1))


def test_dense_ranks_merge_and_delete():
    r = np.random.default_rng(0)
    a, b = r.lognormal(0, 1, 40_000), -r.exponential(2, 20_000)
    ones = lambda x: np.ones(len(x), dtype=np.int64)
    both = q.spread(q.encode(a), ones(a)) + q.spread(q.encode(b), ones(b))
    v = np.sort(np.concatenate([a, b]))
    p = np.array([0.01, 0.25, 0.5, 0.9, 0.99])
    got = q.invert(both, len(v), p)
    assert np.abs(np.searchsorted(v, got) / len(v) - p).max() < 0.01
    assert (both - q.spread(q.encode(b), ones(b)) == q.spread(q.encode(a), ones(a))).all()


def _rows(spark):
    r = np.random.default_rng(1)
    rows = [("hot", i % 4, float(v)) for i, v in enumerate(r.lognormal(0, 2, 6000))] + [("few", 0, v) for v in (3.0, 3.0, 5.0)] + [("none", 0, v) for v in (None, math.nan, -1.0)] + [(None, 0, math.inf)]
    return spark.createDataFrame(rows, "g string, day int, v double")


def test_groups_days_and_missing_values(spark):
    df = _rows(spark).repartition(7)
    daily = q.build_sketches(df, ["g", "day"], F.col("v"))
    whole = q.merge_sketches(daily, ["g"])
    got = {r["g"]: r for r in q.percentiles(whole, ["g"], PROBS).collect()}
    assert set(got) == {"hot", "few", None} and got["few"]["n"] == 3 and got[None]["p50"] == math.inf
    v = np.sort(df.where("g = 'hot'").toPandas().v.to_numpy())
    for k, p in PROBS.items():
        assert abs(np.searchsorted(v, got["hot"][k]) / len(v) - p) < 0.01
    assert got["few"]["rank_error"] == 0.0 < got["hot"]["rank_error"] < 0.05
    rest = q.merge_sketches(whole.union(q.subtract(q.merge_sketches(daily.where("day = 3"), ["g"]))), ["g"])
    left = q.percentiles(rest, ["g"], PROBS).where("g = 'hot'").first()
    w = np.sort(df.where("g = 'hot' and day < 3").toPandas().v.to_numpy())
    assert left["n"] == len(w) and abs(np.searchsorted(w, left["p50"]) / len(w) - 0.5) < 0.01


def test_weights_delete_and_empty(spark):
    df = _rows(spark)
    out = q.build_sketches(df.union(df).withColumn("w", F.lit(1)).union(df.withColumn("w", F.lit(-1))), ["g"], F.col("v"), F.col("w"))
    assert q.percentiles(out, ["g"], PROBS).where("g = 'few'").first()["n"] == 3
    assert q.percentiles(q.build_sketches(df.limit(0), ["g"], F.col("v")), ["g"], PROBS).count() == 0


def test_extra_columns_may_clash(spark):
    df = spark.createDataFrame([(1, 2.0, 9, "x")], "codes int, value double, n int, dense string")
    r = q.percentiles(q.build_sketches(df.select(F.col("codes").alias("key"), "value"), ["key"], F.col("value")), ["key"], PROBS).first()
    assert r["p50"] == pytest.approx(2.0, rel=1e-3)


@pytest.mark.parametrize("seed", range(40))
def test_true_ranks_keep_the_stated_error(seed):
    """Masses at v, 4 v, 16 v (nodes a power of two apart) and heavy-tailed weights: the worst cases of a weak hash."""
    r = np.random.default_rng(seed)
    base = np.exp(r.normal(0, r.uniform(0.1, 5), int(r.integers(40, 900))))
    v = np.concatenate([base * 4.0**i for i in range(3)])
    codes, at = np.unique(q.encode(v), return_inverse=True)
    counts = np.bincount(at, weights=np.minimum(np.ceil(r.pareto(r.uniform(0.3, 2), len(v))) + 1, 20_000)).astype(np.int64)
    n, p = int(counts.sum()), np.array([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])
    cells = q.spread(codes, counts)
    node = q._descend(cells, n, p)[0]
    below = np.concatenate([[0], np.cumsum(counts)])
    rank = np.clip(np.ceil(p * n), 1, n)
    off = np.maximum(below[np.searchsorted(codes, node)] + 1 - rank, rank - below[np.searchsorted(codes, node, side="right")])
    assert off.max() <= q.rank_error(cells, n, p) * n


def test_nodes_a_width_apart_share_few_rows():
    at, sign = q._slots(0, np.arange(1 << q.BITS))
    for apart in (q.WIDTH, 1024, 4096):
        same = (at[:, :-apart] == at[:, apart:]).sum(axis=0)
        assert same.mean() < 2 * q.DEPTH / q.WIDTH and same.max() < q.DEPTH
        assert abs((sign[:, :-apart] == sign[:, apart:]).mean() - 0.5) < 0.01
    assert sum(not exact for _, exact in q.LEVELS) > q.BITS / 2


def test_rank_check_counts_the_rows(spark):
    df = _rows(spark)
    found = q.percentiles(q.build_sketches(df, ["g"], F.col("v")), ["g"], PROBS)
    assert {r["within"] for r in q.rank_check(df, ["g"], F.col("v"), found, PROBS).collect()} == {True}
    wrong = found.withColumn("p50", F.col("p50") * 3).where("g = 'hot'")
    assert [r["within"] for r in q.rank_check(df, ["g"], F.col("v"), wrong, PROBS).collect()] == [False]
