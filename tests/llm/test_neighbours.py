import numpy as np
import pytest

from pointspark.llm import neighbours as nb


def brute(ids, v, k):
    out = {}
    for i in range(len(ids)):
        d = ((v - v[i]) ** 2).sum(axis=1)
        order = [j for j in np.lexsort((ids, d)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), d[j]) for j in order]
    return out


@pytest.mark.parametrize("leaf", [16, 100, 4096])
def test_matches_brute_force_over_leaves(spark, monkeypatch, leaf):
    monkeypatch.setattr(nb, "LEAF_ROWS", leaf)
    r = np.random.default_rng(leaf)
    v = np.round(np.concatenate([r.normal(0, 0.05, (300, 3)), r.uniform(-5, 5, (300, 3)), np.zeros((40, 3)), np.repeat(r.uniform(-1, 1, (5, 3)), 3, axis=0)]) * 4096) / 4096
    ids = r.permutation(len(v)).astype(int)
    rows = [(int(i), *map(float, p), "x") for i, p in zip(ids, v)]
    rows += rows[:7] + [(9001, None, 0.0, 0.0, "x"), (9002, float("nan"), 0.0, 0.0, "x"), (None, 1.0, 1.0, 1.0, "x")]
    got = {}
    for a, b, d in nb.nearest(spark.createDataFrame(rows, "item long, a double, b double, c double, leaf string"), "item", ["a", "b", "c"]).collect():
        got.setdefault(a, []).append((b, d))
    want = brute(ids, v, 5)
    assert {k: sorted(x) for k, x in got.items()} == {k: sorted(x) for k, x in want.items()}


def test_small_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 0.0), (2, -0.0), (3, 5.0)], "id long, x double")
    assert {tuple(r) for r in nb.nearest(df, "id", ["x"]).collect()} == {(1, 2, 0.0), (1, 3, 25.0), (2, 1, 0.0), (2, 3, 25.0), (3, 1, 25.0), (3, 2, 25.0)}
    assert nb.nearest(df.limit(1), "id", ["x"]).count() == 0
    assert nb.nearest(df.limit(0), "id", ["x"]).count() == 0


def test_many_dimensions_reach_the_recall_by_collisions_alone(spark):
    r = np.random.default_rng(4)
    v = r.normal(size=(8, 24))[r.integers(0, 8, 600)] + r.normal(size=(600, 24)) * 0.4
    dims = [f"c{i}" for i in range(24)]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(v)], "id long, " + ", ".join(f"{c} double" for c in dims))
    found = {(a, b) for a, b, _ in nb.nearest(df, "id", dims, 5, exact=False).collect()}
    true = {(r["item"], r["neighbour"]) for r in nb.brute_nearest(df, "id", dims, df.where("id % 50 = 0"), 5).collect()}
    assert len(true) == 60 and len(true & found) >= 54
    assert nb.settings(24)[0] < len(nb._projections(24)) > 24 and nb.settings(3)[0] < len(nb._projections(3)) > 3
