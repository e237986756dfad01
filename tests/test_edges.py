"""Empty tables, NULL and NaN values, ties and repeated rows in the operators of geometry, merge, ranking and files."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointspark.functions.missing import gate, saved_channels
from pointspark.operators import grid, merge, metrics, places, spatial, stats
from pointspark.operators import visibility as vis
from pointspark.operators.nearest import nearest
from pointspark.plans import reference
from pointspark.sources import cloud, pcd
from tests.conftest import SMALL

POINT = "k long, x double, y double, z double"
NAN = math.nan


def test_nearest_between_clouds_within_a_margin(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 0.0, 0.0, 0.0), (2, 9.0, 0.0, 0.0), (3, None, 0.0, 0.0), (4, NAN, 0.0, 0.0), (None, 0.0, 0.0, 0.0)], POINT)
    b = spark.createDataFrame([(7, 0.5, 0.0, 0.0), (8, -0.5, 0.0, 0.0), (9, 1.0, 0.0, 0.0), (1, 0.0, 0.0, 0.25)], POINT)
    got = {(r["a_id"], r["b_id"], r["rank"]) for r in nearest(a, 2, "k", 1.0, b).collect()}
    assert got == {(1, 7, 1), (1, 8, 2)}  # ties by the smaller id, the margin is open, the same id is no other
    assert {(r["a_id"], r["b_id"]) for r in nearest(a, 1, "k", 1.0, b, others_only=False).collect()} == {(1, 1)}
    assert nearest(a.limit(0), 3, "k").count() == 0 and nearest(a, 3, "k", None, b.limit(0)).count() == 0
    assert spatial.nearest_capped(a, b.limit(0), 1.0, "k", "k").where("distance is null").count() == 2


def test_copies_of_one_place_are_each_others_neighbours(spark):
    df = spark.createDataFrame([(i, 1.0, 2.0, 3.0) for i in range(50)] + [(99, 1.5, 2.0, 3.0)], POINT)
    got = nearest(df, 3, "k", 0.1).toPandas()
    assert (got.groupby("a_id").size() == 3).all() and set(got.a_id) == set(range(50)) and (got.d2 == 0).all()


def test_roughness_of_a_plane_and_of_too_few_points(spark):
    flat = [(i * 10 + j, i * 0.1, j * 0.1, 0.0) for i in range(10) for j in range(10)] + [(1000, 0.45, 0.45, 0.02), (2000, 50.0, 0.0, 0.0)]
    df = spark.createDataFrame(flat, POINT)
    r = {x["k"]: x["roughness"] for x in spatial.roughness(df, 0.4, "k").collect()}
    assert r[44] < 0.01 < r[1000] < 0.03 and r[2000] is None
    k = {x["k"]: x["roughness"] for x in spatial.roughness_k(df, 3, "k").collect()}
    assert set(k.values()) == {None}
    assert spatial.roughness(df.limit(0), 0.4, "k").count() == 0
    f = spatial.geometry_features(df, "k", [2], [0.4], [8], df.where("k = 44")).collect()
    assert [x["k"] for x in f] == [44] and abs(f[0]["mean_knn_dist_k2"] - (0.05**2 * 2 + 0.02**2) ** 0.5 / 2 - 0.05) < 0.02


def test_holes_are_filled_and_bays_are_not(spark):
    ring = [(x, y) for x in range(5) for y in range(5) if x in (0, 4) or y in (0, 4)]
    bay = [(x + 10, y) for x, y in ring if (x, y) != (4, 2)]
    cells = spark.createDataFrame(ring + ring[:3] + bay, "ix long, iy long")
    got = {tuple(r) for r in vis.fill_holes(cells).collect()}
    assert got == {(x, y) for x in range(5) for y in range(5)} | {tuple(c) for c in bay}
    assert vis.fill_holes(cells.limit(0)).count() == 0


def test_corners_in_crowds_and_ties(spark):
    rows = [(i, 0.001 * i, 0.0, 0.0, float(i)) for i in range(30)] + [(100, 5.0, 0.0, 0.0, 2.0), (101, 5.1, 0.0, 0.0, 2.0), (102, 9.0, 0.0, 0.0, 1.0), (103, 9.3, 0.0, 0.0, 3.0)]
    df = spark.createDataFrame(rows, POINT + ", s double")
    assert {r["k"] for r in places.suppress(df, 0.5, "k", "s").collect()} == {29, 103}
    assert places.suppress(df.limit(0), 0.5, "k", "s").count() == 0


def test_suppression_copies_no_corner_and_broadcasts_nothing(spark):
    # each corner was copied to 27 cells, unseen by the planner, and the copies were broadcast through the driver
    plan = reference.corner_suppression(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert len(re.findall(r"\bExchange ", plan)) <= 8


def test_suppression_equals_all_pairs(spark):
    r = random.Random(7)
    rows = [(i, *[r.uniform(-1.5, 1.5) for _ in range(3)], float(r.randrange(300))) for i in range(400)]
    rows += [(400 + i, *rows[i][1:]) for i in range(0, 40, 2)] + [(500 + i, 0.5 * i, 0.25, -0.5, 400.0 + i % 2) for i in range(-3, 4)]
    lone = [(None, 0.0, 0.0, 0.0, 1.0), (None, 0.0, 0.0, 0.0, 900.0), (600, 0.0, 0.0, 0.0, None)]
    left = [a for a in rows if not any(a[0] != b[0] and b[4] >= a[4] and sum((p - q) ** 2 for p, q in zip(a[1:4], b[1:4])) < 0.25 for b in rows)]
    df = spark.createDataFrame(rows + lone + [(601, NAN, 0.0, 0.0, 900.0)], POINT + ", s double").withColumn("note", F.lit("t"))
    got = [tuple(x) for x in places.suppress(df, 0.5, "k", "s").collect()]
    assert sorted(got, key=str) == sorted([(*x, "t") for x in left + lone], key=str)


def test_stations_without_valid_returns(spark):
    station = spark.createDataFrame([(1, [[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]], [10.0, 0.0, 0.0]), (2, [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], [0.0, 0.0, 0.0])], "id int, rotation array<array<double>>, origin array<double>")
    scans = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 0), (1, 2.0, 0.0, 0.0, 1), (1, None, 0.0, 0.0, 0), (2, NAN, 0.0, 0.0, 0)], "station_id int, x double, y double, z double, invalid int")
    merged, about = vis.merge_stations(scans, station)
    assert [(r["x"], r["y"], r["z"]) for r in merged.collect()] == [(10.0, 1.0, 0.0)]
    assert {(r["id"], r["points"], r["max_range"]) for r in about.collect()} == {(1, 1, 1.0), (2, None, None)}


TRAJ = "cloud_id string, scan_id long, t double, x double, y double, z double, qx double, qy double, qz double, qw double, vx double, vy double, vz double, gx double, gy double, gz double, v6_0 double, v6_1 double, v6_2 double, sane boolean"


def _pose(scan, t, x, yaw, sane=True):
    return ("a", scan, t, x, 0.0, 0.0, 0.0, 0.0, math.sin(yaw / 2), math.cos(yaw / 2), 1.0, 0.0, 0.0, 0.0, 0.0, -9.81, None, 0.0, 0.0, sane)


def test_deskew_undoes_a_known_motion(spark):
    traj = spark.createDataFrame([_pose(0, 0.0, 0.0, 0.0), _pose(1, 1.0, 2.0, 0.2)], TRAJ)
    world = np.array([5.0, 1.0, 0.5])
    points = []
    for k, s in enumerate((0.0, 0.5, 1.0)):  # the same world point, as seen at three moments of the sweep
        c, v = math.cos(0.2 * s), math.sin(0.2 * s)
        d = world - np.array([2.0 * s, 0.0, 0.0])
        points.append((k, 0, float(c * d[0] + v * d[1]), float(-v * d[0] + c * d[1]), float(d[2]), s))
    points += [(9, 1, 1.0, 1.0, 1.0, 0.5), (10, 77, 1.0, 1.0, 1.0, None)]
    out = {r["k"]: (r["x"], r["y"], r["z"]) for r in merge.deskew(spark.createDataFrame(points, "k long, scan_id long, x double, y double, z double, scan_time double"), traj).collect()}
    assert np.allclose(out[0], out[2]) and np.allclose(out[1], out[2]) and out[9] == (1.0, 1.0, 1.0) == out[10]


def test_correction_starts_at_its_scan(spark):
    traj = spark.createDataFrame([_pose(0, 0.0, 1.0, 0.0), _pose(1, 1.0, 1.0, 0.0), _pose(2, 2.0, 1.0, 0.0)], TRAJ)
    quarter = [0.0, -1.0, 0.0, 3.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    same = [1.0, 0.0, 0.0, 7.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    fix = spark.createDataFrame([("a", 1, quarter), ("a", 2, same), ("b", 0, quarter)], "cloud_id string, from_scan long, m array<double>")
    r = merge.apply_correction(traj, fix).orderBy("scan_id").collect()
    assert [(x["x"], x["y"]) for x in r] == [(1.0, 0.0), (3.0, 1.0), (8.0, 0.0)] and r[1]["vy"] == pytest.approx(1.0)
    assert r[1]["qz"] == pytest.approx(math.sin(math.pi / 4)) and r[2]["qw"] == pytest.approx(1.0)
    assert merge.apply_correction(traj, fix.limit(0)).count() == 3


def test_gravity_and_static_start(spark):
    traj = spark.createDataFrame([_pose(0, 0.0, 1.0, 0.0)], TRAJ).withColumns({"gx": F.lit(9.81 * math.sin(0.1)), "gz": F.lit(-9.81 * math.cos(0.1))})
    r = merge.align_gravity(traj).first()
    assert r["gx"] == pytest.approx(0.0, abs=1e-9) and r["gz"] == pytest.approx(-9.81)
    assert merge.align_gravity(traj.withColumn("gx", F.lit(None).cast("double"))).first()["x"] == 1.0
    samples = spark.createDataFrame([(1, i, 0.0, 0.0, 5.0, 0.1, 0.0, NAN if i == 2 else 0.0) for i in range(9)], "s int, i int, a0 double, a1 double, a2 double, w0 double, w1 double, w2 double")
    g = merge.static_start(samples, ["s"], "i", 4).first()
    assert (g["n"], g["g2"], round(g["b0"], 9)) == (4, -9.81, 0.1)


def test_ranking_ties_empty_classes_and_missing_scores(spark):
    df = spark.createDataFrame([(0.01, 1.0, None), (0.01, 1.0, 2.0), (0.5, 1.0, 3.0)], "distance double, a double, b double")
    r = {(x["scorer"], x["tau"]): (x["auc"], x["place"]) for x in metrics.ranking(df, {"a": F.col("a"), "b": F.col("b")}, [0.05, 0.9]).collect()}
    assert set(r) == {("a", 0.05), ("b", 0.05)} and r["a", 0.05][0] == 0.5
    assert metrics.hexbins(df, F.col("a"), F.col("b"), 0.5).agg(F.sum("n")).first()[0] == 2
    curve = metrics.budget_curve(spark.createDataFrame([], "k long, score double, distance double"), [], "k", 0.05)
    assert curve.count() == 0
    tied = metrics.budget_curve(spark.createDataFrame([(i, 1.0, 0.5) for i in range(10)], "k long, score double, distance double"), [], "k", 0.05, [0.0, 0.5]).orderBy("budget").collect()
    assert [(x["kept"], x["median_c2c"], x["p90_c2c"], x["recall"]) for x in tied] == [(10, 0.5, 0.5, 0.0), (5, 0.5, 0.5, 0.0)]


def test_clusters_gates_and_boxes(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 4.0, 4.0, 4.0)], POINT)
    left = grid.subtract_clusters(grid.point_clusters(p, ["k"]), grid.point_clusters(p.where("k = 2 or x = 1"), ["k"]), ["k"]).collect()
    assert [(r["k"], r["n"], r["sx"]) for r in left] == [(1, 1, 0.0)]
    assert [r[0] for r in p.select(gate("x", 0.0, 3.0, -1.0)).collect()] == [-1.0, 1.0, -1.0]
    assert saved_channels(p, {"y": False, "z": True, "absent": False}).columns == ["k", "x", "z"]
    assert grid.in_box(p, (0.5, 0.0, 0.0), (3.0, 3.0, 3.0), 1.0).count() == 3
    assert stats.stride_sample(p.select("x").distinct(), "x", 2).count() == 2


def test_las_and_pcd_files(spark, tmp_path):
    df = spark.createDataFrame([(1.5, 2.0, 3.0, 7, 2**60, None), (None, 0.0, 0.0, 1, 1, 1.0)], "x double, y double, z double, intensity int, big long, v double")
    assert cloud.write_las(df, str(tmp_path / "a")).agg(F.sum("points")).first()[0] == 1
    r = cloud.read_las(spark, str(tmp_path / "a"), fields=["big", "v"], origin=(1.0, 0.0, 0.0)).first()
    assert (r["x"], r["big"]) == (0.5, 2**60) and math.isnan(r["v"])
    with pytest.raises(ValueError, match="there are"):
        cloud.read_las(spark, str(tmp_path / "a"), fields=["nope"])
    with pytest.raises(ValueError, match="can't hold"):
        cloud.write_las(df.withColumn("s", F.lit("x")), str(tmp_path / "b"))
    pcd.register(spark)
    df.select("x", "y").where("x is not null").union(df.select("y", "x").where("x is not null")).repartition(2, "x").write.format("pcd").mode("append").save(str(tmp_path / "p"))
    assert pcd.merge_files(str(tmp_path / "p"), str(tmp_path / "whole.pcd")) == 2
    assert sorted(r["x"] for r in spark.read.format("pcd").load(str(tmp_path / "whole.pcd")).collect()) == [1.5, 2.0]
