import pytest
from pyspark.sql import functions as F

from pointspark.operators import merge, rings, visibility as vis


def test_episode_sum(spark):
    rows = [(7, s, 0, float(o), -1.0, 0.1 * s) for s, o in enumerate([1, 2, 3, 1, 2])] + [(-1, 0, 0, 9.0, 0.5, 0.5)]
    p = spark.createDataFrame(rows, "cell_id long, scan_id long, point_idx long, obs_count double, view_diversity double, temp_consistency double")
    r = merge.cell_statistics(merge.first_per_cell(p)).collect()
    assert len(r) == 1 and r[0]["obs_count"] == 5.0 and r[0]["view_diversity"] is None and r[0]["temp_consistency"] == pytest.approx(0.2)


def _ring(spark, values):
    return spark.createDataFrame([(0, i, float(v), i) for i, v in enumerate(values)], "ring int, col int, range double, id long").withColumn("scan", F.lit(0))


def test_ramp_edge_and_mixed_pixel(spark):
    feats = lambda vs: rings.ring_features(rings.lattice(_ring(spark, vs), ["scan"], "range", "range", "id"), ["scan"]).toPandas().set_index("col")
    ramp = feats([1 + 0.1 * i for i in range(32)])
    assert ramp.detach.abs().max() < 1e-9 and ramp.edge.abs().max() < 1e-9
    edge = feats([2.0] * 16 + [5.0] * 16)
    assert edge.detach[15] < 1e-9 and edge.edge[15] > 1
    mixed = feats([2.0] * 16 + [3.5] + [5.0] * 15)
    assert mixed.detach[16] > 0.3
    gap = feats([2.0] * 4 + [0.0] + [2.0] * 4)
    assert (gap.edge == 0).all()


def test_wall_is_observed_and_its_sides_judged(spark):
    st = spark.createDataFrame([(1, "s", 1, [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], [2.0, 0.0, 1.0], -60.0, 60.0, 50.0)], "station_id int, scene string, gt_group int, rotation array<array<double>>, origin array<double>, el_min double, el_max double, max_range double")
    wall = spark.createDataFrame([(i, "s", 5.0, 0.02 * (i % 50) - 0.5, 0.5 + 0.02 * (i // 50)) for i in range(2500)], "point_id long, scene string, x double, y double, z double")
    bins = vis.widen(vis.panorama(vis.station_view(wall, st, 1.0)), 360)
    probe = spark.createDataFrame([(1, "s", 5.0, 0.0, 1.0), (2, "s", 6.0, 0.0, 1.0), (3, "s", 4.0, 0.0, 1.0), (4, "s", 2.0, 0.0, -50.0), (5, "s", None, 0.0, 0.0), (6, "t", 5.0, 0.0, 1.0)], "point_id long, scene string, x double, y double, z double")
    got = {r["point_id"]: r["visibility"] for r in vis.fuse(probe, vis.verdicts(vis.station_view(probe, st, 1.0), bins), "point_id").collect()}
    assert got == {1: 3, 2: 1, 3: 2, 4: 0, 5: 0, 6: 0}


def test_footprint_hole_is_filled(spark):
    ring = [(i, j) for i in range(3) for j in range(3) if (i, j) != (1, 1)]
    assert vis.fill_holes(spark.createDataFrame(ring, "ix long, iy long")).count() == 9
    assert vis.fill_holes(spark.createDataFrame([], "ix long, iy long")).count() == 0


def test_times_are_matched_once(spark):
    a = spark.createDataFrame([(1, 0.0), (2, 0.004), (3, 9.0), (4, None)], "l long, t double")
    b = spark.createDataFrame([(7, 0.003), (8, 9.5)], "r long, t double")
    assert {tuple(r)[:2] for r in merge.nearest_in_time(a, b, 0.01, "l", "r", []).collect()} == {(1, 7)}


def test_cropped_and_domain(spark):
    df = spark.createDataFrame([(3, 0.2, 0.05), (3, None, None), (2, None, None), (0, 0.1, 0.1)], "v int, d double, f double")
    crop = vis.cropped_away(F.col("d"), F.col("f"), 0.01)
    assert [r[0] for r in df.select(vis.domain_code(F.col("v"), F.lit(False), crop, F.col("d"))).collect()] == [1, 1, 0, 5]
