"""Queries of sources and sinks: a table is written in each format and read back; SQL reads the table itself.

Files go to a new folder of the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointspark.functions.missing import finite
from pointspark.operators import grid, merge, model
from pointspark.plans.reference import TRAJ, XYZ_OK, fin, poses, pres, rounded
from pointspark.session import cut, scratch, table
from pointspark.sources import cloud, pcd, text

QUERIES: dict = {}
SQL: dict[str, str] = {}
STEP = 2.0**-12  # the grid of the per-scan clouds, so that whole numbers of it lose nothing


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL


def scan_cloud(spark: SparkSession, d: str) -> DataFrame:
    one = F.min(F.struct("x", "y", "z", finite("ring").alias("ring"), finite("balm_res").alias("balm_res"), finite("reflectivity").alias("reflectivity"))).alias("p")
    return grid.located(table(spark, d, "pcd")).groupBy("pt_id").agg(one).select("pt_id", "p.*")


CLOUD = f"c AS (SELECT pt_id, min(row(x, y, z, {fin('ring')}, {fin('balm_res')}, {fin('reflectivity')})::STRUCT(x DOUBLE, y DOUBLE, z DOUBLE, ring DOUBLE, balm_res DOUBLE, reflectivity DOUBLE)) AS p FROM pcd WHERE {XYZ_OK} GROUP BY pt_id)"


@query(f"WITH {CLOUD} SELECT pt_id, p.x AS x, p.y AS y, p.z AS z, round(p.balm_res, 6) AS balm_res, round(p.reflectivity, 6) AS reflectivity FROM c")
def las_fields(spark, d):
    """Extra dimensions out and in."""
    folder = scratch(spark)
    cut(cloud.write_las(scan_cloud(spark, d), folder, STEP))
    back = cloud.read_las(spark, folder, fields=["pt_id", "balm_res", "reflectivity"])
    return back.select("pt_id", "x", "y", "z", *[F.round(finite(c), 6).alias(c) for c in ("balm_res", "reflectivity")])


@query(f"WITH {CLOUD} SELECT count(*) AS points, sum(CAST((p.x - 8) * 4096 AS BIGINT)) AS sx, sum(CAST((p.y + 3) * 4096 AS BIGINT)) AS sy, sum(CAST(p.z * 4096 AS BIGINT)) AS sz FROM c")
def las_origin(spark, d):
    """An origin taken off while reading."""
    folder = scratch(spark)
    cut(cloud.write_las(scan_cloud(spark, d).select("x", "y", "z"), folder, STEP))
    back = cloud.read_las(spark, folder, fields=[], origin=(8.0, -3.0, 0.0))
    return back.agg(F.count("*").alias("points"), *[F.sum(F.round(F.col(c) * 4096).cast("long")).alias(f"s{c}") for c in "xyz"])


def _pcd(spark: SparkSession, df: DataFrame, form: str) -> str:
    pcd.register(spark)
    folder = scratch(spark)
    df.write.format("pcd").option("format", form).mode("append").save(folder)
    return folder


@query(f"WITH {CLOUD} SELECT pt_id, p.x AS x, p.y AS y, p.z AS z, round(p.ring, 3) AS ring FROM c")
def pcd_binary(spark, d):
    """Binary records by ranges."""
    folder = _pcd(spark, scan_cloud(spark, d).select("pt_id", "x", "y", "z", "ring"), "binary")
    back = spark.read.format("pcd").option("recordsPerPartition", "5000").load(folder)
    return back.select("pt_id", "x", "y", "z", F.round(finite("ring"), 3).alias("ring"))


@query(f"WITH {CLOUD} SELECT pt_id, p.x AS x, p.y AS y, p.z AS z FROM c")
def pcd_ascii(spark, d):
    """The same as text."""
    folder = _pcd(spark, scan_cloud(spark, d).select("pt_id", "x", "y", "z"), "ascii")
    return spark.read.format("pcd").load(folder).select("pt_id", "x", "y", "z")


@query(f"WITH {CLOUD} SELECT pt_id, p.x AS x, p.y AS y, p.z AS z FROM c")
def pcd_merged(spark, d):
    """K3: one cloud from the files of all partitions."""
    folder = _pcd(spark, scan_cloud(spark, d).select("pt_id", "x", "y", "z"), "binary")
    whole = f"{scratch(spark)}/global_map.pcd"
    pcd.merge_files(folder, whole)
    return spark.read.format("pcd").load(whole).select("pt_id", "x", "y", "z")


@query(f"WITH {CLOUD} SELECT count(*) AS n, min(p.x) AS x_min, max(p.x) AS x_max, min(p.y) AS y_min, max(p.y) AS y_max, min(p.z) AS z_min, max(p.z) AS z_max FROM c")
def bounds_cached(spark, d):
    """Bounds of a folder of clouds, the second time from its cache."""
    folder = _pcd(spark, scan_cloud(spark, d).select("x", "y", "z"), "binary")
    cache = f"{scratch(spark)}/bounds.json"
    pcd.cached_bounds(spark, folder, cache)
    return pcd.cached_bounds(spark, folder, cache)


@query("SELECT * FROM (SELECT scan_file, count(*) AS n FROM global_pcd_converter GROUP BY ALL)")
def staged_replacement(spark, d):
    """K1: a cloud replaced by itself with another column, read again from the same path."""
    path = f"{scratch(spark)}/cloud"
    rows = table(spark, d, "global_pcd_converter").groupBy("scan_file").agg(F.count("*").alias("n"))
    cloud.replace_cloud(rows.drop("n"), path)
    n = spark.read.parquet(path).count()
    cloud.replace_cloud(cloud.upsert_columns(spark.read.parquet(path).join(rows.withColumnRenamed("scan_file", "f"), F.col("scan_file").eqNullSafe(F.col("f"))), {}, ["f"]), path, rows=n)
    return spark.read.parquet(path).select("scan_file", "n")


@query(f"WITH {TRAJ} SELECT row_number() OVER (ORDER BY scan_id) - 1 AS scan_id, {fin('t')} AS t, {fin('x')} AS x, {fin('y')} AS y, {fin('qw')} AS qw FROM tr")
def trajectory_text(spark, d):
    """Written and read as lines."""
    path = f"{scratch(spark)}/trajectory.txt"
    text.write_trajectory(merge.one_per_scan(table(spark, d, "trajectory")), path)
    return text.read_trajectory(spark, path).select("scan_id", *[finite(c).alias(c) for c in ("t", "x", "y", "qw")])


EDGE = f"""{TRAJ}, n AS (SELECT cloud_id AS s1, lead(cloud_id) OVER w AS s2, scan_id AS i1, lead(scan_id) OVER w AS i2, lead(x) OVER w - x AS tx, lead(y) OVER w - y AS ty, lead(z) OVER w - z AS tz, qx, qy, qz, qw FROM poses WHERE sane WINDOW w AS (ORDER BY scan_id DESC))
, e AS (SELECT *, s1 > s2 AS flip, sqrt(qx*qx + qy*qy + qz*qz + qw*qw) AS q FROM n WHERE s2 IS NOT NULL), u AS (SELECT *, qx/q AS a, qy/q AS b, qz/q AS c, qw/q AS w FROM e)"""


@query(f"""WITH {EDGE} SELECT CASE WHEN flip THEN s2 ELSE s1 END AS session1, CASE WHEN flip THEN s1 ELSE s2 END AS session2, CASE WHEN flip THEN i2 ELSE i1 END AS id1, CASE WHEN flip THEN i1 ELSE i2 END AS id2,
round(CASE WHEN flip THEN -((1-2*(b*b+c*c))*tx + 2*(a*b+c*w)*ty + 2*(a*c-b*w)*tz) ELSE tx END, 6) + 0 AS tx, round(CASE WHEN flip THEN -(2*(a*b-c*w)*tx + (1-2*(a*a+c*c))*ty + 2*(b*c+a*w)*tz) ELSE ty END, 6) + 0 AS ty,
round(CASE WHEN flip THEN -(2*(a*c+b*w)*tx + 2*(b*c-a*w)*ty + (1-2*(a*a+b*b))*tz) ELSE tz END, 6) + 0 AS tz, round(CASE WHEN flip THEN -qx ELSE qx END, 6) + 0 AS qx, round(qw, 6) AS qw FROM u""")
def loop_edges(spark, d):
    """Edges written as text, oriented while they are read."""
    from pyspark.sql import Window as W

    w = W.orderBy(F.desc("scan_id"))  # one row a scan
    nxt = lambda c: F.lead(c).over(w)
    p = poses(spark, d).where("sane")
    e = p.select(F.col("cloud_id").alias("session1"), nxt("cloud_id").alias("session2"), F.col("scan_id").alias("id1"), nxt("scan_id").alias("id2"), *[(nxt(c) - F.col(c)).alias(f"t{c}") for c in "xyz"], "qx", "qy", "qz", "qw").where(F.col("session2").isNotNull())
    path = f"{scratch(spark)}/edges"
    text.write_edges(e, path)
    back = text.read_edges(spark, path)
    return back.select("session1", "session2", "id1", "id2", *[(F.round(c, 6) + 0).alias(c) for c in ("tx", "ty", "tz", "qx")], F.round("qw", 6).alias("qw"))


@query("SELECT station_id AS id, station_name AS name, points, el_min, max_range, rotation[1][2] AS r01, origin[3] AS t2, 'merged.las' AS merged_las FROM station")
def station_sidecar(spark, d):
    """The station table as a sidecar."""
    path = f"{scratch(spark)}/stations.json"
    s = table(spark, d, "station").withColumnsRenamed({"station_id": "id", "station_name": "name"})
    text.write_sidecar(s, path, "merged.las")
    return text.read_sidecar(spark, path).select("id", "name", "points", "el_min", "max_range", F.col("rotation")[0][1].alias("r01"), F.col("origin")[2].alias("t2"), "merged_las")


@query(f"""WITH v AS (SELECT DISTINCT scan_id, point_idx, x, y, z, {fin('scan_time')} AS st, {fin('ring')} AS ring FROM pcd WHERE {XYZ_OK}), m AS (SELECT *, min(st) OVER (PARTITION BY scan_id) AS lo FROM v),
k AS (SELECT scan_id, point_idx, st - lo AS "offset", CAST(ring AS INTEGER) AS ring FROM m WHERE x*x + y*y + z*z > 4.0 AND point_idx % 2 = 0 AND st - lo <= 0.08)
SELECT scan_id, point_idx, ring, round("offset", 7) AS "offset", row_number() OVER (PARTITION BY scan_id ORDER BY "offset", point_idx) AS place FROM k""")
def vendor_sweeps(spark, d):
    """A vendor's rows, blind radius, decimation, late offsets, order of point time."""
    rows = grid.located(table(spark, d, "pcd")).select("scan_id", "point_idx", "x", "y", "z", F.lit(0.0).alias("intensity"), finite("ring").alias("ring"), finite("scan_time").alias("timestamp")).distinct()
    s = text.canonical_sweep(rows, "hesai", blind=2.0, every=2, latest=0.08)
    return s.select("scan_id", "point_idx", "ring", F.round("offset", 7).alias("offset"), "place")


@query(f"WITH a AS (SELECT point_id, min({pres('range')}) AS rng FROM outlier_analysis GROUP BY point_id), b AS (SELECT point_id, min({pres('predicted_c2c')}) AS predicted FROM predict_cloud GROUP BY point_id) SELECT a.point_id, rng, predicted FROM a LEFT JOIN b ON a.point_id = b.point_id")
def side_file(spark, d):
    """Features kept beside a cloud, joined on demand."""
    from pointspark.functions.missing import present

    path = f"{scratch(spark)}/features"
    table(spark, d, "predict_cloud").groupBy("point_id").agg(F.min(present("predicted_c2c")).alias("predicted")).write.parquet(path)
    a = table(spark, d, "outlier_analysis").groupBy("point_id").agg(F.min(present("range")).alias("rng"))
    return text.attach_features(a, spark.read.parquet(path))


@query("SELECT * FROM (VALUES ('c2c_max_dist', '0.5'), ('gt_groups', 'north'), ('icp.most', '7'), ('icp.voxel', '0.1'), ('output_frame', 'north')) v(key, value)")
def settings(spark, d):
    """A configuration file over defaults."""
    from pointspark.sources import storage

    path = f"{scratch(spark)}/config.json"
    storage.write_whole(path, [b'{"gt_groups": {"name": "north"}, "icp": {"most": 7}, "output_frame": "north"}'])
    c = text.read_config(path, {"icp": {"most": 20, "voxel": 0.1}, "c2c_max_dist": 0.5})
    flat = [("c2c_max_dist", c["c2c_max_dist"]), ("gt_groups", c["gt_groups"][0]["name"]), *[(f"icp.{k}", v) for k, v in c["icp"].items()], ("output_frame", c["output_frame"])]
    return spark.createDataFrame([(k, str(v)) for k, v in flat], "key string, value string")


@query(f"""WITH o AS (SELECT DISTINCT point_id, cloud_id, pv_var IS NOT NULL AS old, {fin('range')} AS rng FROM outlier_analysis WHERE {fin('C2C_distance')} >= 0 AND eval_domain)
SELECT CASE WHEN old THEN 'older' ELSE 'newer' END AS scene, point_id, rng AS range FROM o""")
def pooled(spark, d):
    """Two kinds of clouds with different channels, pooled with those that both have; nothing is sampled at this size."""
    o = table(spark, d, "outlier_analysis")
    cols = ["point_id", "C2C_distance", "eval_domain", "range", "cloud_id"]
    older, newer = o.where("pv_var is not null").select(*cols, "pv_var", "voxel_id"), o.where("pv_var is null").select(*cols, "leaf_id")
    rows = model.pool_sample({"older": older, "newer": newer}, "point_id", 1 << 40)
    return rows.select("scene", "point_id", "cloud_id", finite("range").alias("range")).distinct().drop("cloud_id")
