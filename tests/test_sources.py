import pytest
from pyspark.sql import functions as F

from pointspark.sources import cloud, pcd, text


@pytest.mark.parametrize("form", ["binary", "ascii"])
def test_pcd_round_trip(spark, tmp_path, form):
    pcd.register(spark)
    df = spark.range(1000).select(F.col("id").cast("int").alias("point_idx"), (F.col("id") / 7).alias("x"), F.lit(1.5).cast("float").alias("y"), F.when(F.col("id") % 5 > 0, F.col("id") * 1.0).alias("z"))
    df.write.format("pcd").option("format", form).mode("append").save(str(tmp_path))
    back = spark.read.format("pcd").option("recordsPerPartition", "100").load(str(tmp_path))
    assert back.count() == 1000 and back.agg(F.sum("x")).first()[0] == pytest.approx(df.agg(F.sum("x")).first()[0])
    assert back.where("point_idx = 5").first()["z"] != back.where("point_idx = 6").first()["z"]


def test_pcd_headers(tmp_path):
    p = tmp_path / "a.pcd"
    p.write_text("FIELDS x v\nSIZE 4 4\nTYPE F U\nCOUNT 1 3\nWIDTH 0\nHEIGHT 1\nDATA binary_compressed\n")
    with pytest.raises(ValueError):
        pcd.read_header(str(p))
    p.write_text("FIELDS x v\nSIZE 4 4\nTYPE F U\nCOUNT 1 3\nWIDTH 0\nHEIGHT 1\nDATA ascii\n")
    assert pcd.read_header(str(p)).ddl == "`x` float, `v` array<long>"


def test_las_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.5, -2.25, 3.0, 7), (10.0, 0.0, 0.001, 70000), (None, 0.0, 0.0, 1)], "x double, y double, z double, intensity int")
    assert cloud.write_las(df.coalesce(1), str(tmp_path)).agg(F.sum("points")).first()[0] == 2
    got = sorted((round(r["x"], 3), round(r["y"], 3), round(r["z"], 3), r["intensity"]) for r in cloud.read_las(spark, str(tmp_path), 1).collect())
    assert got == [(1.5, -2.25, 3.0, 7), (10.0, 0.0, 0.001, 65535)]


def test_trajectory_and_edges(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1 0 0 0 0 0 0 1 9\nshort line\n2 1 nan 0 0 0 0 1\n")
    t = text.read_trajectory(spark, str(tmp_path / "t.txt")).orderBy("scan_id").collect()
    assert [r["scan_id"] for r in t] == [0, 1] and t[0]["vx"] == 9.0 and t[1]["v6_0"] is None
    (tmp_path / "e.txt").write_text("b a 3 5 1 0 0 0 0 0 1\na b 1 2 1 0 0 0 0 0 1\nz a 1 1 1 0 0 0 0 0 1\n")
    e = {(r["session1"], r["id1"], r["tx"], r["known"]) for r in text.read_edges(spark, str(tmp_path / "e.txt"), ["a", "b"]).collect()}
    assert e == {("a", 5, -1.0, True), ("a", 1, 1.0, True), ("z", 1, 1.0, False)}


def test_config(spark):
    assert text.load_config({"gt_groups": {"name": "g"}, "icp": {"k": 1}}, {"icp": {"k": 0, "m": 2}}) == {"gt_groups": [{"name": "g"}], "icp": {"k": 1, "m": 2}}
    with pytest.raises(ValueError):
        text.load_config({"gt_groups": [{"name": "g"}, {"name": "g"}]}, {})


def test_vendor_rows_and_replacement(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, 3.0, 0.0, 0.0, 1.0, 2, 100.0), (0, 1, 0.1, 0.0, 0.0, 1.0, 2, 100.05), (0, 2, 4.0, 0.0, 0.0, 1.0, 2, 100.5)], "scan_id long, point_idx long, x double, y double, z double, intensity double, ring int, timestamp double")
    assert [r["point_idx"] for r in text.canonical_sweep(df, "hesai", blind=0.5).collect()] == [0]
    path = str(tmp_path / "c")
    cloud.replace_cloud(df, path)
    cloud.replace_cloud(spark.read.parquet(path).withColumn("new", F.lit(1)), path, rows=3)
    assert "new" in spark.read.parquet(path).columns
    with pytest.raises(ValueError):
        cloud.replace_cloud(df.limit(1), path, rows=3)
