import numpy as np
import pytest
from pyspark.sql import functions as F

from pointspark.operators import grid, nearest, places, planes, register, spatial

SCHEMA = "id long, x double, y double, z double, ix string"


def cloud(spark, n=300, seed=0):
    r = np.random.default_rng(seed)
    rows = [(i, *map(float, r.uniform(0, 2, 3)), "clash") for i in range(n)] + [(n, None, 0.0, 0.0, "c"), (n + 1, float("nan"), 0.0, 0.0, "c"), (n + 2, float("inf"), 0.0, 0.0, "c")]
    return spark.createDataFrame(rows, SCHEMA), np.array([r[1:4] for r in rows[:n]])


def test_cells_ignore_broken_rows_and_clashing_names(spark):
    df, xyz = cloud(spark)
    first = grid.keep_first(df, 0.5, ["id"]).toPandas()
    assert len(first) == len(np.unique(np.floor(xyz / 0.5), axis=0)) and first.id.max() < 300
    assert grid.keep_first(df.limit(0), 0.5, ["id"]).count() == 0


def test_pairwise_mean_is_the_fold(spark):
    df = spark.createDataFrame([(i, float(i), 0.0, 0.0, "") for i in (3, 5, 8, 9)], SCHEMA)
    want = 3.0
    for v in (5, 8, 9):
        want = (want + v) / 2
    assert grid.pairwise_mean(df, 100.0, ["id"]).first()["x"] == pytest.approx(want)


def test_halo_owns_each_point_once(spark):
    df, _ = cloud(spark)
    h = grid.halo(df, 0.7, 0.5)
    assert h.where("owned").count() == 300 and h.count() > 300


def test_nearest_and_knn_match_brute_force(spark):
    df, xyz = cloud(spark)
    d = np.linalg.norm(xyz[:, None] - xyz[None], axis=2)
    np.fill_diagonal(d, np.inf)
    near = spatial.mean_distances(df, [3], 0.6, "id").toPandas().set_index("id").mean_k3
    for i in range(0, 300, 17):
        inside = np.sort(d[i][d[i] < 0.6])[:3]
        assert near[i] == pytest.approx(inside.mean()) if len(inside) else np.isnan(near[i])
    a, b = df.where("id < 150"), df.where("id >= 150")
    got = spatial.nearest_capped(a, b, 0.3, "id", "id").toPandas().set_index("id").distance
    want = d[:150, 150:].min(axis=1)
    assert all((np.isnan(got[i]) and want[i] >= 0.3) or got[i] == pytest.approx(want[i]) for i in range(150))


def test_neighbours_beyond_the_margin_are_kept(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LEAF_ROWS", 16)  # many leaves
    df, xyz = cloud(spark)
    rows = [(400 + i, 1.0, 1.0, 1.0, "place") for i in range(12)] + [(500, 900.0, -900.0, 5.0, "flyer")]
    df = df.union(spark.createDataFrame(rows, SCHEMA))
    ids, p = np.array([*range(300), *[r[0] for r in rows]]), np.vstack([xyz, [r[1:4] for r in rows]])
    d2 = ((p[:, None] - p[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d2, np.inf)
    for k in (7, 30):
        got = nearest.nearest(df, k, "id").toPandas().sort_values(["a_id", "rank"])
        want = [ids[np.lexsort((ids, row))[:k]] for row in d2]
        assert got.a_id.tolist() == list(np.repeat(ids, k)) and got.b_id.tolist() == list(np.concatenate(want))
    m = spatial.mean_distances(df, [3], 0.1, "id", whole=True).toPandas().set_index("id")
    assert m.mean_k3[500] == pytest.approx(np.sqrt(np.sort(d2[-1])[:3]).mean()) and m.uncertain_k3[500] and not m.uncertain_k3[405]
    assert nearest.nearest(df.limit(0), 3, "id").count() == 0 and nearest.nearest(df.where("id < 3"), 9, "id").count() == 6
    s = spatial.neighbourhood_stats(df.withColumn("c", F.lit(1.0)), {"c": -1.0}, 3, 0.1, "id", whole=True).where("id = 500").first()
    assert s["c__nmean_k3"] == 1.0 and s["uncertain_k3"]


def test_sentinel_neighbours_are_skipped(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 2.0), (1, 0.1, 0.0, 0.0, 4.0), (2, 0.2, 0.0, 0.0, 6.0), (3, 0.0, 0.1, 0.0, -1.0)], "id long, x double, y double, z double, c double")
    r = spatial.neighbourhood_stats(df, {"c": -1.0}, 3, 1.0, "id").where("id = 0").first()
    assert r["c__nmean_k3"] == 5.0 and r["c__ninv_k3"] == pytest.approx(1 / 3) and r["c__dev_k3"] == -3.0
    own = spatial.neighbourhood_stats(df, {"c": -1.0}, 3, 1.0, "id").where("id = 3").first()
    assert own["c__dev_k3"] is None and own["c__nmean_k3"] == 4.0


def test_roughness_of_a_plane_and_a_flyer(spark):
    rows = [(i, i % 10 * 0.1, i // 10 * 0.1, 0.0, "") for i in range(100)] + [(100, 0.45, 0.45, 0.2, "")]
    r = spatial.roughness(spark.createDataFrame(rows, SCHEMA), 0.3, "id").toPandas().set_index("id").roughness
    assert r[100] > 0.1 and r[0] < 1e-6


def test_plane_map_finds_walls(spark):
    r = np.random.default_rng(1)
    rows = [(i, 0.5, float(r.uniform(0, 4)), float(r.uniform(0, 4)), "") for i in range(400)]
    leaves = planes.plane_map(spark.createDataFrame(rows, SCHEMA), 4.0, [10, 10], 0.01, [0.1, 0.1])
    p = leaves.where("is_plane").first()
    assert p["level"] == 0 and abs(p["nx"]) > 0.99
    assert planes.match_planes(spark.createDataFrame(rows, SCHEMA), leaves, 4.0, 2, 0.05, "id").count() == 400


def test_icp_recovers_a_small_move(spark):
    r = np.random.default_rng(2)
    faces = [(float(r.uniform(0, 4)), float(r.uniform(0, 4)), 0.0, 0.0, 0.0, 1.0) for _ in range(250)] + [(0.0, float(r.uniform(0, 4)), float(r.uniform(0, 4)), 1.0, 0.0, 0.0) for _ in range(250)] + [(float(r.uniform(0, 4)), 0.0, float(r.uniform(0, 4)), 0.0, 1.0, 0.0) for _ in range(250)]
    target = spark.createDataFrame([(i, *f) for i, f in enumerate(faces)], "id long, x double, y double, z double, nx double, ny double, nz double")
    move = np.eye(4)
    move[:3, 3] = [0.05, -0.04, 0.03]
    source = register.transform(target.select("id", "x", "y", "z"), move)
    got, fit = register.icp(source, target, [(0.05, 0.5)], "id", "id", most=6)
    assert np.allclose(got[:3, 3], -move[:3, 3], atol=0.01) and fit > 0.95


def test_components_and_suppression(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (7, 7), (None, 1)], "u long, v long")
    assert {tuple(r) for r in places.components(e).collect()} == {(3, 3), (4, 3), (5, 3), (8, 8), (9, 8), (7, 7)}
    c = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 5), (2, 0.1, 0.0, 0.0, 5), (3, 5.0, 0.0, 0.0, 1), (4, 5.1, 0.0, 0.0, 2)], "id long, x double, y double, z double, s int")
    assert [r["id"] for r in places.suppress(c, 0.5, "id", "s").collect()] == [4]


def test_relabel_uses_group_transform_beyond_limits(spark):
    ref = spark.createDataFrame([(0, 1.0, 0.0, 0.0)], "id long, x double, y double, z double")
    pts = spark.createDataFrame([(1, 0.9, 0.0, 0.0, 1, 1), (2, 0.9, 0.0, 0.0, 1, 2), (3, 9.0, 0.0, 0.0, 1, 2)], "id long, x double, y double, z double, gt_group int, stretch_id int")
    eye = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    moved = [1.0, 0.0, 0.0, 0.1, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    tr = spark.createDataFrame([(1, None, eye, 0.0, 0.0), (1, 1, moved, 0.1, 0.0), (1, 2, moved, 0.9, 0.0)], "gt_group int, stretch_id int, m array<double>, shift double, turn double")
    got = {r["id"]: (round(r["c2c"], 6), r["own"]) for r in register.relabel_stretches(pts, tr, ref, 0.5, "id", "id", least_points=1).collect()}
    assert got == {1: (0.0, True), 2: (0.1, False), 3: (0.5, False)}


def test_view_diversity_of_one_direction_is_zero(spark):
    v = spark.createDataFrame([(1, 1.0, 0.0, 0.0), (1, 2.0, 0.0, 0.0)], "c long, dx double, dy double, dz double")
    assert planes.view_diversity(v, ["c"], "dx", "dy", "dz").select(F.round("diversity", 9)).first()[0] == 0.0
