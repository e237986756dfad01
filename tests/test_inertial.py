import math

import numpy as np

from pointspark.operators import inertial

SCHEMA = "s string, t double, w0 double, w1 double, w2 double, a0 double, a1 double, a2 double, r int"


def _matrix(r):
    m = np.eye(5)
    m[:3, :3], m[:3, 3], m[:3, 4], m[3, 4] = np.array(r["r"]).reshape(3, 3), r["v"], r["p"], r["seconds"]
    return m


def test_constant_motion_has_its_closed_form(spark):
    rows = [("a", i * 0.01, 0.0, 0.0, 0.5, 0.0, 0.0, 2.0, 1) for i in range(101)] + [("b", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1), ("c", 0.0, None, 0.0, 0.0, 0.0, 0.0, 0.0, 1), ("c", 1.0, math.nan, 0.0, 0.0, 0.0, 0.0, 0.0, 1)]
    got = inertial.preintegrate(spark.createDataFrame(rows + rows[:3], SCHEMA), ["s"]).collect()
    assert [(r["s"], r["steps"]) for r in got] == [("a", 100)]
    r = got[0]
    assert np.allclose(r["v"], [0, 0, 2.0]) and np.allclose(r["p"], [0, 0, 1.0]) and math.isclose(math.atan2(r["r"][3], r["r"][0]), 0.5)
    assert np.allclose(np.array(r["v_ba"]).reshape(3, 3)[2], [0, 0, -1.0]) and np.allclose(np.array(r["p_ba"]).reshape(3, 3)[2], [0, 0, -0.5])
    assert inertial.preintegrate(spark.createDataFrame([], SCHEMA), ["s"]).count() == 0


def test_halves_compose_and_biases_are_foreseen(spark):
    g = np.random.default_rng(1)
    x = g.normal(0, 0.5, (81, 6))
    rows = [("all", i * 0.02, *map(float, x[i]), 0) for i in range(81)] + [("1", i * 0.02, *map(float, x[i]), 0) for i in range(41)] + [("2", i * 0.02, *map(float, x[i]), 0) for i in range(40, 81)]
    df = spark.createDataFrame(rows, SCHEMA)
    m = {r["s"]: r for r in inertial.preintegrate(df, ["s"]).collect()}
    assert np.allclose(_matrix(m["1"]) @ _matrix(m["2"]), _matrix(m["all"]))
    bg, ba = np.array([1e-3, -2e-3, 1e-3]), np.array([2e-3, 1e-3, -1e-3])
    moved = {r["s"]: r for r in inertial.preintegrate(df, ["s"], gyro_bias=tuple(bg), acc_bias=tuple(ba)).collect()}["all"]
    a = m["all"]
    for k in "vp":
        assert np.allclose(np.array(a[k]) + np.array(a[f"{k}_bg"]).reshape(3, 3) @ bg + np.array(a[f"{k}_ba"]).reshape(3, 3) @ ba, moved[k], atol=2e-5)
    turn = inertial.rotations((np.array(a["r_bg"]).reshape(3, 3) @ bg)[None])[0]
    assert np.allclose(np.array(a["r"]).reshape(3, 3) @ turn, np.array(moved["r"]).reshape(3, 3), atol=2e-5)
