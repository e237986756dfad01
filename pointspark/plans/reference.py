"""Queries of the point-cloud operators over the driver's tables, each with its SQL twin where SQL can say it.

Every query runs over its whole tables. Figures are rounded by magnitude so that both engines agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointspark.functions.missing import constant_channels, detect_sentinel, finite, gate, ingest, present, saved_channels
from pointspark.operators import grid, merge, metrics, model, places, planes, rings, spatial, stats
from pointspark.operators import visibility as vis
from pointspark.sources.pcd import bounds, unpack_rgb
from pointspark.streaming import sessions
from pointspark.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
TAU = 0.05


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def fin(c: str) -> str:
    return f"(CASE WHEN isfinite(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END)"


def pres(c: str, s: float = -1.0) -> str:
    return f"(CASE WHEN isfinite(CAST({c} AS DOUBLE)) AND abs(CAST({c} AS DOUBLE) - ({s})) > 1e-6 THEN CAST({c} AS DOUBLE) END)"


XYZ_OK = "x IS NOT NULL AND isfinite(x) AND y IS NOT NULL AND isfinite(y) AND z IS NOT NULL AND isfinite(z)"
POINTS = f"pts AS (SELECT DISTINCT point_id, scene, cloud_id, x, y, z FROM global_pcd_converter WHERE {XYZ_OK})"
PCD = f"p AS (SELECT pt_id, min(x) AS x, min(y) AS y, min(z) AS z FROM pcd WHERE {XYZ_OK} GROUP BY pt_id)"
LABELLED = f"""lab AS (SELECT point_id, scene, cloud_id, min({pres('C2C_distance')}) AS distance, min({pres('mean_knn_dist')}) AS knn, min({pres('balm_res')}) AS balm, min({pres('plane_quality')}) AS quality,
  min({pres('range')}) AS rng FROM outlier_analysis GROUP BY ALL HAVING min({pres('C2C_distance')}) IS NOT NULL)"""


def cells(size: float, names: str = "ix,iy,iz", dims: str = "xyz") -> str:
    return ", ".join(f"CAST(floor({c} / {size}) AS BIGINT) AS {n}" for n, c in zip(names.split(","), dims))


def points(spark: SparkSession, d: str) -> DataFrame:
    return grid.located(table(spark, d, "global_pcd_converter")).select("point_id", "scene", "cloud_id", "x", "y", "z").distinct()


def scan_points(spark: SparkSession, d: str) -> DataFrame:
    return grid.located(table(spark, d, "pcd")).groupBy("pt_id").agg(*[F.min(c).alias(c) for c in "xyz"])


def labelled(spark: SparkSession, d: str) -> DataFrame:
    chan = {"distance": "C2C_distance", "knn": "mean_knn_dist", "balm": "balm_res", "quality": "plane_quality", "rng": "range"}
    return table(spark, d, "outlier_analysis").groupBy("point_id", "scene", "cloud_id").agg(*[F.min(present(c)).alias(a) for a, c in chan.items()]).where(F.col("distance").isNotNull())


# ---- grid -------------------------------------------------------------------------------------------------------


@query(f"WITH {POINTS} SELECT {cells(2.0)}, arg_min(point_id, point_id) AS point_id, arg_min(x, point_id) AS x, arg_min(y, point_id) AS y, arg_min(z, point_id) AS z FROM pts GROUP BY ix, iy, iz")
def voxel_keep_first(spark, d):
    return grid.keep_first(points(spark, d).select("point_id", "x", "y", "z"), 2.0, ["point_id"])


@query(f"WITH {POINTS} SELECT {cells(2.0)}, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, arg_min(scene, point_id) AS scene, count(*) AS n FROM pts GROUP BY ix, iy, iz")
def voxel_centroid(spark, d):
    return rounded(grid.centroid(points(spark, d), 2.0, ["point_id"], ["scene"]), 6, "x", "y", "z")


@query(f"""WITH {POINTS}, c AS (SELECT {cells(2.0)}, x, y, z, point_id FROM pts), l AS (SELECT ix, iy, iz, list(x ORDER BY point_id) AS xs, list(y ORDER BY point_id) AS ys, list(z ORDER BY point_id) AS zs FROM c GROUP BY ALL)
SELECT ix, iy, iz, round(list_reduce(xs, lambda a, b: (a + b) / 2), 10) AS x, round(list_reduce(ys, lambda a, b: (a + b) / 2), 10) AS y, round(list_reduce(zs, lambda a, b: (a + b) / 2), 10) AS z FROM l""")
def voxel_pairwise_mean(spark, d):
    return rounded(grid.pairwise_mean(points(spark, d), 2.0, ["point_id"]), 10, "x", "y", "z")


@query(f"""WITH {POINTS}, c AS (SELECT {cells(2.0)}, point_id, x, y, z FROM pts), m AS (SELECT ix, iy, iz, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM c GROUP BY ALL)
SELECT ix, iy, iz, arg_min(point_id, (round((x-mx)*(x-mx) + (y-my)*(y-my) + (z-mz)*(z-mz), 9), point_id)) AS point_id FROM c JOIN m USING (ix, iy, iz) GROUP BY ALL""")
def voxel_nearest_centroid(spark, d):
    return grid.nearest_to_centroid(points(spark, d).select("point_id", "x", "y", "z"), 2.0, ["point_id"]).select(*grid.CELL, "point_id")


@query(f"""WITH {POINTS} SELECT scene, count(*) AS n, round(avg(x), 4) AS cx, round(avg(y), 4) AS cy, round(avg(z), 4) AS cz, round(avg(x*x) - avg(x)*avg(x), 2) AS vxx, round(avg(x*y) - avg(x)*avg(y), 2) AS vxy,
round(avg(x*z) - avg(x)*avg(z), 2) AS vxz, round(avg(y*y) - avg(y)*avg(y), 2) AS vyy, round(avg(y*z) - avg(y)*avg(z), 2) AS vyz, round(avg(z*z) - avg(z)*avg(z), 2) AS vzz FROM pts GROUP BY scene""")
def cluster_covariance(spark, d):
    per_cloud = grid.point_clusters(points(spark, d), ["scene", "cloud_id"])
    out = grid.covariance(grid.merge_clusters(per_cloud, ["scene"]))
    return rounded(rounded(out, 4, "cx", "cy", "cz"), 2, "vxx", "vxy", "vxz", "vyy", "vyz", "vzz")


OUT = f"o AS (SELECT DISTINCT point_id, scene, x, y, z, visibility_code, gt_group FROM outlier_analysis WHERE {XYZ_OK})"


def out_points(spark, d):
    return grid.located(table(spark, d, "outlier_analysis")).select("point_id", "scene", "x", "y", "z", "visibility_code", "gt_group").distinct()


@query(f"""WITH {OUT}, c AS (SELECT {cells(10.0, 'ix,iy', 'xy')}, visibility_code, count(*) AS n FROM o WHERE visibility_code IS NOT NULL GROUP BY ALL)
SELECT ix, iy, CAST(arg_max(visibility_code, (n, -visibility_code)) AS INTEGER) AS majority, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL""")
def raster_majority(spark, d):
    return grid.raster_majority(out_points(spark, d), 10.0, "visibility_code").withColumn("majority", F.col("majority").cast("int"))


@query(f"WITH {OUT} SELECT {cells(10.0, 'ix,iy', 'xy')}, count(*) AS n, round(CAST(sum(CAST(z AS DECIMAL(18, 9))) AS DOUBLE) / count(*), 6) AS mean_value, min(z) AS min_z FROM o GROUP BY ix, iy")
def raster_stats(spark, d):
    return rounded(grid.raster(out_points(spark, d), 10.0, "z"), 6, "mean_value")


@query(f"""WITH {POINTS}, h AS (SELECT x, y, unnest(range(CAST(floor((x - 2) / 10) AS BIGINT), CAST(floor((x + 2) / 10) AS BIGINT) + 1)) AS tx FROM pts),
h2 AS (SELECT x, y, tx, unnest(range(CAST(floor((y - 2) / 10) AS BIGINT), CAST(floor((y + 2) / 10) AS BIGINT) + 1)) AS ty FROM h)
SELECT tx, ty, count(*) AS n, count(*) FILTER (WHERE tx = floor(x / 10) AND ty = floor(y / 10)) AS owned FROM h2 GROUP BY ALL""")
def tile_halo(spark, d):
    return grid.halo(points(spark, d), 10.0, 2.0).groupBy("tx", "ty").agg(F.count("*").alias("n"), F.count_if("owned").alias("owned"))


@query(f"""WITH {POINTS}, m AS (SELECT unnest(range(1, 9)) AS multiple), c AS (SELECT multiple, floor(floor(x / 5) / multiple) AS tx, floor(floor(y / 5) / multiple) AS ty, count(*) AS n FROM pts, m GROUP BY ALL)
SELECT CAST(multiple AS INTEGER) AS multiple, max(n) AS worst FROM c GROUP BY ALL""")
def tile_sizes(spark, d):
    return grid.tile_sizes(points(spark, d), 5.0, 8)


@query(f"SELECT count(*) AS n, min({fin('x')}) AS x_min, max({fin('x')}) AS x_max, min({fin('y')}) AS y_min, max({fin('y')}) AS y_max, min({fin('z')}) AS z_min, max({fin('z')}) AS z_max FROM pcd")
def cloud_bounds(spark, d):
    return bounds(table(spark, d, "pcd"))


@query("SELECT DISTINCT pt_id, (rgb >> 16) & 255 AS r, (rgb >> 8) & 255 AS g, rgb & 255 AS b FROM pcd")
def rgb_channels(spark, d):
    return unpack_rgb(table(spark, d, "pcd")).select("pt_id", "r", "g", "b").distinct()


# ---- neighbours -------------------------------------------------------------------------------------------------

D2 = "(a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)"


SIDES = f"""{PCD}, e AS (SELECT p.*, n FROM p JOIN (SELECT pt_id, bool_or({fin('intensity_orig')} IS NOT NULL) AS n FROM pcd GROUP BY pt_id) USING (pt_id))"""


def two_sides(spark, d):
    """Older points (channel intensity) and newer ones (intensity_orig): two clouds that together are the whole table."""
    newer = table(spark, d, "pcd").groupBy("pt_id").agg(F.bool_or(finite("intensity_orig").isNotNull()).alias("n"))
    p = scan_points(spark, d).join(newer, "pt_id")
    return p.where("not n"), p.where("n")


@query(f"WITH {SIDES} SELECT a.pt_id, round(sqrt(min({D2}) FILTER (WHERE {D2} < 0.25)), 9) AS distance FROM (SELECT * FROM e WHERE NOT n) a LEFT JOIN (SELECT * FROM e WHERE n) b ON abs(a.x - b.x) < 0.5 AND abs(a.y - b.y) < 0.5 AND abs(a.z - b.z) < 0.5 GROUP BY a.pt_id")
def nearest_capped(spark, d):
    old, new = two_sides(spark, d)
    return rounded(spatial.nearest_capped(old, new, 0.5, "pt_id", "pt_id"), 9, "distance")


NEAR = f"{PCD}, near AS (SELECT a.pt_id AS a_id, b.pt_id AS b_id, {D2} AS d2 FROM p a JOIN p b ON a.pt_id <> b.pt_id AND abs(a.x - b.x) < 0.3 AND abs(a.y - b.y) < 0.3 AND abs(a.z - b.z) < 0.3 WHERE {D2} < 0.3 * 0.3), ranked AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY d2, b_id) AS rank FROM near)"
MEANS = "means AS (SELECT pt_id, avg(sqrt(d2)) FILTER (WHERE rank <= 6) AS k6, avg(sqrt(d2)) FILTER (WHERE rank <= 30) AS k30, avg(sqrt(d2)) FILTER (WHERE rank <= 100) AS k100, count(*) FILTER (WHERE rank <= 6) AS n6, count(*) FILTER (WHERE rank <= 30) AS n30, count(*) FILTER (WHERE rank <= 100) AS n100 FROM p LEFT JOIN ranked ON a_id = pt_id GROUP BY pt_id)"


@query(f"WITH {NEAR}, {MEANS} SELECT pt_id, round(k6, 9) AS mean_k6, n6 < 6 AS uncertain_k6, round(k30, 9) AS mean_k30, n30 < 30 AS uncertain_k30 FROM means")
def knn_multi_k(spark, d):
    return rounded(spatial.mean_distances(scan_points(spark, d), [6, 30], 0.3, "pt_id"), 9, "mean_k6", "mean_k30")


@query(f"""WITH {NEAR}, {MEANS} SELECT pt_id, round(CASE WHEN k30 >= 1e-9 THEN k6 / k30 * sqrt(5.0) END, 6) AS mean_knn_dist_ratio_k6_k30, round(CASE WHEN k100 >= 1e-9 THEN k30 / k100 * sqrt(100.0 / 30) END, 6) AS mean_knn_dist_ratio_k30_k100 FROM means""")
def knn_ratios(spark, d):
    m = spatial.mean_distances(scan_points(spark, d), [6, 30, 100], 0.3, "pt_id").withColumnsRenamed({f"mean_k{k}": f"mean_knn_dist_k{k}" for k in (6, 30, 100)})
    return m.select("pt_id", *[F.round(spatial.ratio(a, b, s), 6).alias(n) for n, a, b, s in spatial.RATIOS if a.startswith("mean") and b.startswith("mean")])


# The three queries above see no neighbour beyond 0.3 m, as their SQL says. These take the k nearest of the whole table; the margin,
# the reference's 1 m, only flags.
MARGIN = 1.0
ALL_NEAR = f"{PCD}, ranked AS (SELECT a.pt_id AS a_id, b.pt_id AS b_id, {D2} AS d2, row_number() OVER (PARTITION BY a.pt_id ORDER BY {D2}, b.pt_id) AS rank FROM p a JOIN p b ON a.pt_id <> b.pt_id QUALIFY rank <= 100)"
ALL_MEANS = "means AS (SELECT pt_id, " + ", ".join(f"avg(sqrt(d2)) FILTER (WHERE rank <= {k}) AS k{k}, count(*) FILTER (WHERE rank <= {k} AND d2 <= 1.0) < {k} AS u{k}" for k in (6, 30, 100)) + " FROM p LEFT JOIN ranked ON a_id = pt_id GROUP BY pt_id)"


@query(f"WITH {ALL_NEAR}, {ALL_MEANS} SELECT pt_id, round(k6, 9) AS mean_k6, u6 AS uncertain_k6, round(k30, 9) AS mean_k30, u30 AS uncertain_k30 FROM means")
def knn_multi_k_whole(spark, d):
    return rounded(spatial.mean_distances(scan_points(spark, d), [6, 30], MARGIN, "pt_id", whole=True), 9, "mean_k6", "mean_k30")


@query(f"""WITH {ALL_NEAR}, {ALL_MEANS} SELECT pt_id, round(CASE WHEN k30 >= 1e-9 THEN k6 / k30 * sqrt(5.0) END, 6) AS mean_knn_dist_ratio_k6_k30, round(CASE WHEN k100 >= 1e-9 THEN k30 / k100 * sqrt(100.0 / 30) END, 6) AS mean_knn_dist_ratio_k30_k100,
u6 AS uncertain_k6, u30 AS uncertain_k30, u100 AS uncertain_k100 FROM means""")
def knn_ratios_whole(spark, d):
    m = spatial.mean_distances(scan_points(spark, d), [6, 30, 100], MARGIN, "pt_id", whole=True).withColumnsRenamed({f"mean_k{k}": f"mean_knn_dist_k{k}" for k in (6, 30, 100)})
    ratios = [F.round(spatial.ratio(a, b, s), 6).alias(n) for n, a, b, s in spatial.RATIOS if a.startswith("mean") and b.startswith("mean")]
    return m.select("pt_id", *ratios, *[f"uncertain_k{k}" for k in (6, 30, 100)])


@query(f"""WITH {ALL_NEAR}, ch AS (SELECT pt_id, min({pres('balm_res')}) AS c FROM pcd GROUP BY pt_id), s AS (SELECT a_id, avg(c) AS m, stddev_pop(c) AS sd, avg(CASE WHEN c IS NULL THEN 1.0 ELSE 0.0 END) AS ninv, count(*) FILTER (WHERE d2 <= 1.0) AS n FROM ranked JOIN ch ON ch.pt_id = b_id WHERE rank <= 30 GROUP BY a_id)
SELECT p.pt_id, round(m, 6) AS nmean, round(c - m, 6) + 0 AS dev, round((c - m) / (sd + 1e-6), 3) + 0 AS z, round(ninv, 6) AS ninv, coalesce(n, 0) < 30 AS uncertain FROM p JOIN ch USING (pt_id) LEFT JOIN s ON a_id = p.pt_id""")
def agg_dev_z_k30_whole(spark, d):
    ch = table(spark, d, "pcd").groupBy("pt_id").agg(F.min(present("balm_res")).alias("balm_res"))
    s = spatial.neighbourhood_stats(scan_points(spark, d).join(ch, "pt_id"), {"balm_res": -1.0}, 30, MARGIN, "pt_id", whole=True)
    return s.select("pt_id", F.round("balm_res__nmean_k30", 6).alias("nmean"), F.round("balm_res__dev_k30", 6).alias("dev"), F.round("balm_res__z_k30", 3).alias("z"), F.round("balm_res__ninv_k30", 6).alias("ninv"), F.col("uncertain_k30").alias("uncertain"))


@query(f"WITH {SIDES} SELECT pt_id FROM e a WHERE n AND EXISTS (SELECT 1 FROM e b WHERE NOT b.n AND {D2} < 0.2 * 0.2)")
def range_semi(spark, d):
    old, new = two_sides(spark, d)
    return spatial.range_semi(new, old, 0.2, "pt_id", "pt_id").select("pt_id")


@query(f"""WITH {NEAR}, ch AS (SELECT pt_id, min({pres('balm_res')}) AS c FROM pcd GROUP BY pt_id), s AS (SELECT a_id, avg(c) AS m, stddev_pop(c) AS sd, avg(CASE WHEN c IS NULL THEN 1.0 ELSE 0.0 END) AS ninv FROM ranked JOIN ch ON ch.pt_id = b_id WHERE rank <= 30 GROUP BY a_id)
SELECT p.pt_id, round(m, 6) AS nmean, round(c - m, 6) + 0 AS dev, round((c - m) / (sd + 1e-6), 3) + 0 AS z, round(ninv, 6) AS ninv FROM p JOIN ch USING (pt_id) LEFT JOIN s ON a_id = p.pt_id""")
def agg_dev_z_k30(spark, d):
    ch = table(spark, d, "pcd").groupBy("pt_id").agg(F.min(present("balm_res")).alias("balm_res"))
    s = spatial.neighbourhood_stats(scan_points(spark, d).join(ch, "pt_id"), {"balm_res": -1.0}, 30, 0.3, "pt_id")
    return s.select("pt_id", F.round("balm_res__nmean_k30", 6).alias("nmean"), F.round("balm_res__dev_k30", 6).alias("dev"), F.round("balm_res__z_k30", 3).alias("z"), F.round("balm_res__ninv_k30", 6).alias("ninv"))


# ---- missing values ---------------------------------------------------------------------------------------------

CHANNELS = ["balm_res", "ekf_res", "plane_quality", "view_diversity", "temp_consistency", "range_edge", "ambient"]


@query("SELECT channel, round(avg(CASE WHEN abs(v + 1) <= 1e-6 THEN 1.0 ELSE 0.0 END), 9) AS share, min(v) AS lowest, avg(CASE WHEN abs(v + 1) <= 1e-6 THEN 1.0 ELSE 0.0 END) > 0.001 AND min(v) >= -1 - 1e-6 AS is_sentinel FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS channel, {fin(c)} AS v FROM global_pcd_converter" for c in CHANNELS) + ") GROUP BY channel")
def sentinel_channels(spark, d):
    return rounded(detect_sentinel(table(spark, d, "global_pcd_converter"), CHANNELS), 9, "share")


@query(" UNION ALL ".join(f"SELECT '{c}' AS channel, count(*) FILTER (WHERE abs({fin(c)} - ({-1.0 if c not in ('ambient', 'range_edge') else 0.0})) > 1e-6) AS given FROM pcd" for c in CHANNELS))
def channels_given(spark, d):
    return constant_channels(table(spark, d, "pcd"), CHANNELS)


@query(f"SELECT DISTINCT pt_id, round({pres('balm_res')}, 6) AS balm_res, coalesce(abs(CAST(balm_res AS DOUBLE) + 1) <= 1e-6, false) AS balm_res__nofit, round({fin('ambient')}, 6) AS ambient FROM pcd")
def ingest_channels(spark, d):
    return rounded(ingest(table(spark, d, "pcd"), ["balm_res", "ambient"]).select("pt_id", "balm_res", "balm_res__nofit", "ambient"), 6, "balm_res", "ambient").distinct()


@query(f"SELECT DISTINCT pt_id, round(CASE WHEN {fin('coalesce(intensity_orig, intensity)')} > 0 AND {fin('coalesce(intensity_orig, intensity)')} < 3000 THEN {fin('coalesce(intensity_orig, intensity)')} ELSE 0 END, 4) AS intensity FROM (SELECT pt_id, CASE WHEN isnan(intensity) THEN NULL ELSE intensity END AS intensity, CASE WHEN isnan(intensity_orig) THEN NULL ELSE intensity_orig END AS intensity_orig FROM pcd)")
def intensity_gate(spark, d):
    v = gate(F.coalesce(finite("intensity_orig"), finite("intensity")), 0.0, 3000.0)
    return saved_channels(table(spark, d, "pcd").select("pt_id", F.round(v, 4).alias("intensity"), "ambient").distinct(), {"intensity": True, "ambient": False}).distinct()


# ---- merge ------------------------------------------------------------------------------------------------------

FIRST = f"""f AS (SELECT cell_id, scan_id, arg_min(coalesce({pres('obs_count', 0.0)}, 0.0), point_idx) AS obs, arg_min({{'v': {pres('view_diversity')}}}, point_idx).v AS vd, arg_min({{'v': {pres('temp_consistency')}}}, point_idx).v AS tc FROM pcd WHERE cell_id >= 0 GROUP BY ALL)"""


@query(f"WITH {FIRST} SELECT cell_id, scan_id, round(obs, 4) AS obs, round(vd, 6) AS vd, round(tc, 6) AS tc FROM f")
def scan_first_per_cell(spark, d):
    return rounded(rounded(merge.first_per_cell(table(spark, d, "pcd")), 6, "vd", "tc"), 4, "obs")


@query(f"""WITH {FIRST}, w AS (SELECT *, lag(obs) OVER (PARTITION BY cell_id ORDER BY scan_id) AS prev FROM f)
SELECT cell_id, round(sum(CASE WHEN obs < prev THEN prev ELSE 0 END) + arg_max(obs, scan_id), 4) AS obs_count, round(max(vd), 6) AS view_diversity, round(arg_max(tc, (obs, -scan_id)) FILTER (WHERE tc IS NOT NULL), 6) AS temp_consistency FROM w GROUP BY cell_id""")
def cell_episode_stats(spark, d):
    s = merge.cell_statistics(merge.first_per_cell(table(spark, d, "pcd")))
    return rounded(rounded(s, 6, "view_diversity", "temp_consistency"), 4, "obs_count")


TRAJ_OK = " AND ".join(f"{c} IS NOT NULL AND isfinite({c})" for c in ("t", "x", "y", "z", "qx", "qy", "qz", "qw")) + " AND qx*qx + qy*qy + qz*qz + qw*qw > 0"
TRAJ = f"""one AS (SELECT cloud_id, scan_id, arg_min(r, (received_at, coalesce(t, 0), coalesce(x, 0), coalesce(y, 0), coalesce(z, 0))) AS r FROM (SELECT *, row(t, x, y, z, qx, qy, qz, qw, v6_0, v6_1, v6_2)::STRUCT(t DOUBLE, x DOUBLE, y DOUBLE, z DOUBLE, qx DOUBLE, qy DOUBLE, qz DOUBLE, qw DOUBLE, v6_0 DOUBLE, v6_1 DOUBLE, v6_2 DOUBLE) AS r FROM trajectory) GROUP BY ALL),
tr AS (SELECT cloud_id, scan_id, r.t AS t, r.x AS x, r.y AS y, r.z AS z, r.qx AS qx, r.qy AS qy, r.qz AS qz, r.qw AS qw, r.v6_0 AS v6_0, r.v6_1 AS v6_1, r.v6_2 AS v6_2 FROM one),
mid AS (SELECT cloud_id, median(x) AS mx, median(y) AS my, median(z) AS mz FROM tr WHERE {TRAJ_OK} GROUP BY cloud_id),
poses AS (SELECT tr.*, coalesce({TRAJ_OK} AND sqrt((x-mx)*(x-mx) + (y-my)*(y-my) + (z-mz)*(z-mz)) <= 10000, false) AS sane FROM tr LEFT JOIN mid USING (cloud_id))"""


def poses(spark, d):
    return merge.flag_poses(merge.one_per_scan(table(spark, d, "trajectory")))


@query(f"WITH {TRAJ} SELECT cloud_id, scan_id, sane FROM poses")
def pose_sanity(spark, d):
    return poses(spark, d).select("cloud_id", "scan_id", "sane")


@query(f"""WITH {TRAJ}, n AS (SELECT *, lead(t) OVER w AS t1, lead(sane) OVER w AS sane1, lead(qx) OVER w AS x1, lead(qy) OVER w AS y1, lead(qz) OVER w AS z1, lead(qw) OVER w AS w1, lead(scan_id) OVER w AS nxt FROM poses WINDOW w AS (PARTITION BY cloud_id ORDER BY scan_id)),
s AS (SELECT *, CASE WHEN t1 - t > 1e-9 AND sane AND sane1 THEN 2 * acos(least(1.0, abs(qx*x1 + qy*y1 + qz*z1 + qw*w1) / (sqrt(qx*qx+qy*qy+qz*qz+qw*qw) * sqrt(x1*x1+y1*y1+z1*z1+w1*w1)))) / (t1 - t) END AS step FROM n),
l AS (SELECT *, lag(step) OVER (PARTITION BY cloud_id ORDER BY scan_id) AS before FROM s)
SELECT cloud_id, scan_id, round(sqrt(({fin('v6_0')} + {fin('v6_1')} + {fin('v6_2')}) / 3), 9) AS pose_unc_rot, round(CASE WHEN nxt IS NULL THEN before ELSE step END, 5) AS ang_rate FROM l""")
def pose_channels(spark, d):
    return rounded(rounded(merge.pose_channels(poses(spark, d)), 9, "pose_unc_rot"), 5, "ang_rate")


PATH = f"""{TRAJ}, st AS (SELECT cloud_id, scan_id, t, coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2) + power(z - lag(z) OVER w, 2)), 0) AS step FROM poses WHERE sane WINDOW w AS (PARTITION BY cloud_id ORDER BY scan_id)),
pa AS (SELECT cloud_id, scan_id, t, sum(step) OVER (PARTITION BY cloud_id ORDER BY scan_id ROWS UNBOUNDED PRECEDING) AS path FROM st)"""


@query(f"WITH {PATH} SELECT cloud_id, scan_id, round(path, 4) AS path, CAST(floor(path / 5) AS INTEGER) AS stretch FROM pa")
def path_stretch(spark, d):
    return rounded(merge.path_stretches(poses(spark, d).where("sane"), metres=5.0).select("cloud_id", "scan_id", "path", "stretch"), 4, "path")


@query(f"WITH {PATH} SELECT cloud_id, CAST(floor(path / 5) AS INTEGER) AS stretch, count(*) AS scans, round(max(t) - min(t), 3) AS seconds FROM pa GROUP BY ALL")
def stretch_duration(spark, d):
    return rounded(merge.stretch_spans(merge.path_stretches(poses(spark, d).where("sane"), metres=5.0)), 3, "seconds")


@query(f"""WITH {TRAJ}, q AS (SELECT scan_id, x AS px, y AS py, z AS pz, qx/n AS a, qy/n AS b, qz/n AS c, qw/n AS w FROM (SELECT *, sqrt(qx*qx + qy*qy + qz*qz + qw*qw) AS n FROM poses WHERE sane))
SELECT pt_id, round((1-2*(b*b+c*c))*x + 2*(a*b-c*w)*y + 2*(a*c+b*w)*z + px, 5) AS x, round(2*(a*b+c*w)*x + (1-2*(a*a+c*c))*y + 2*(b*c-a*w)*z + py, 5) AS y,
round(2*(a*c-b*w)*x + 2*(b*c+a*w)*y + (1-2*(a*a+b*b))*z + pz, 5) AS z, round(sqrt(x*x + y*y + z*z), 5) AS range FROM (SELECT DISTINCT pt_id, scan_id, x, y, z FROM pcd WHERE {XYZ_OK}) JOIN q USING (scan_id)""")
def world_points(spark, d):
    pts = grid.located(table(spark, d, "pcd")).select("pt_id", "scan_id", "x", "y", "z").distinct()
    return rounded(merge.to_world(pts, poses(spark, d)).select("pt_id", "x", "y", "z", "range"), 5, "x", "y", "z", "range")


@query("""WITH l AS (SELECT user_id, event_id AS l, epoch_us(ts) / 1000000.0 AS lt FROM events WHERE event_type = 'click'), r AS (SELECT user_id, event_id AS r, epoch_us(ts) / 1000000.0 AS rt FROM events WHERE event_type = 'view'),
c AS (SELECT *, abs(rt - lt) AS dt FROM l JOIN r USING (user_id) WHERE abs(rt - lt) <= 43200), m AS (SELECT user_id, l, arg_min(r, (dt, rt, r)) AS r, min(dt) AS dt, min(lt) AS lt FROM c GROUP BY user_id, l)
SELECT user_id, arg_min(l, (lt, l)) AS click, r AS view, round(arg_min(dt, (lt, l)), 3) AS dt FROM m GROUP BY user_id, r""")
def nearest_in_time(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    pick = lambda kind, name: e.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(name), "t")
    return rounded(merge.nearest_in_time(pick("click", "click"), pick("view", "view"), 43200.0, "click", "view", ["user_id"]), 3, "dt")


@query(f"""WITH {TRAJ}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY scan_id) AS i FROM poses WHERE sane) WHERE i % 5 = 0)
SELECT a.scan_id AS a_id, b.scan_id AS b_id, round({D2}, 4) AS d2 FROM k a JOIN k b ON a.scan_id < b.scan_id AND {D2} < 100""")
def keyframe_pairs(spark, d):
    frames = merge.pick_keyframes(poses(spark, d).where("sane"), 5)
    return rounded(merge.keyframes_near(frames, 10.0), 4, "d2")


@query(f"""WITH {TRAJ}, r AS (SELECT cloud_id, scan_id, row_number() OVER (PARTITION BY cloud_id ORDER BY scan_id) - 1 AS i FROM poses WHERE sane)
SELECT cloud_id, CAST(w AS BIGINT) AS "window", scan_id, CAST(i - w * 5 AS BIGINT) AS position FROM (SELECT *, unnest(range(CAST(greatest(0, floor((i - 10) / 5.0) + 1) AS BIGINT), CAST(floor(i / 5.0) AS BIGINT) + 1)) AS w FROM r)""")
def sliding_windows(spark, d):
    return merge.sliding_windows(poses(spark, d).where("sane"), 10, 5).withColumn("position", F.col("position").cast("long"))


# ---- rings ------------------------------------------------------------------------------------------------------

RING = f"""g AS (SELECT scene, point_id, CAST(floor(CAST(ring AS DOUBLE) / 16) AS INTEGER) AS ring, CAST(floor((atan2(y, x) + pi()) / (2 * pi()) * 24) AS INTEGER) % 24 AS col, {fin('range')} AS rng FROM global_pcd_converter WHERE {XYZ_OK} AND {pres('ring')} >= 0 AND {fin('range')} > 0.1),
c AS (SELECT scene, ring, col, min(rng) AS v FROM g GROUP BY ALL),
n AS (SELECT c.*, {", ".join(f"(SELECT o.v FROM c o WHERE o.scene = c.scene AND o.ring = c.ring AND o.col = (c.col + 24 + ({k})) % 24) AS {n}" for n, k in (("l1", -2), ("l2", -3), ("l3", -4), ("r1", 2), ("r2", 3), ("r3", 4)))} FROM c),
s AS (SELECT *, abs(v - (l1 + ((l1 - l2) + (l2 - l3)) / 2 * 2)) AS rl, abs(v - (r1 + ((r1 - r2) + (r2 - r3)) / 2 * 2)) AS rr, abs((l1 - l2) - (l2 - l3)) AS sl, abs((r1 - r2) - (r2 - r3)) AS sr, greatest(abs(v), 1e-3) AS sc FROM n)"""


def ring_points(spark, d):
    col = F.floor((F.atan2("y", "x") + F.pi()) / (2 * F.pi()) * 24).cast("int") % 24
    g = grid.located(table(spark, d, "global_pcd_converter")).where(present("ring") >= 0)
    return g.select("scene", "point_id", F.floor(present("ring") / 16).cast("int").alias("ring"), col.alias("col"), finite("range").alias("range"))


@query(f"WITH {RING} SELECT scene, ring, col, round(CASE WHEN rl + rr IS NULL THEN 0 ELSE least(rl, rr) / sc END, 5) AS detach, round(CASE WHEN rl + rr IS NULL THEN 0 ELSE greatest(rl, rr) / sc END, 5) AS edge, round(CASE WHEN rl + rr IS NULL THEN 0 ELSE least(sl, sr) / sc END, 5) AS rough FROM s")
def ring_detach(spark, d):
    c = rings.lattice(ring_points(spark, d), ["scene"], "range", "range", "point_id")
    return rounded(rings.ring_features(c, ["scene"], 24), 5, "detach", "edge", "rough")


@query(f"""WITH a AS (SELECT scene, degrees(atan2(y, x)) AS az FROM global_pcd_converter WHERE {XYZ_OK}), g AS (SELECT scene, lead(az) OVER (PARTITION BY scene ORDER BY az) - az AS gap, count(*) OVER (PARTITION BY scene) AS points FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY gap) AS r, count(*) OVER (PARTITION BY scene) AS gaps FROM g WHERE gap > 1e-6)
SELECT scene, CASE WHEN points >= 64 AND gaps >= 32 AND CAST(round(360 / gap) AS INTEGER) BETWEEN 180 AND 7200 THEN CAST(round(360 / gap) AS INTEGER) ELSE -1 END AS columns FROM r WHERE r = gaps // 2 + 1""")
def estimate_columns(spark, d):
    g = grid.located(table(spark, d, "global_pcd_converter")).select("scene", F.lit(0).alias("ring"), F.degrees(F.atan2("y", "x")).alias("az"))
    return rings.estimate_columns(g, ["scene"], "az", 0).fillna(-1, ["columns"])


# ---- statistics -------------------------------------------------------------------------------------------------


@query(f"WITH {LABELLED} SELECT scene, count(*) AS n, round(quantile_cont(distance, 0.1), 6) AS p10, round(quantile_cont(distance, 0.5), 6) AS p50, round(quantile_cont(distance, 0.9), 6) AS p90 FROM lab GROUP BY scene")
def percentiles_by_scene(spark, d):
    from pointspark.operators.ordered import exact_quantiles

    return rounded(exact_quantiles(labelled(spark, d), ["scene"], F.col("distance"), {"p10": 0.1, "p50": 0.5, "p90": 0.9}), 6, "p10", "p50", "p90")


@query(f"""WITH {LABELLED}, q AS (SELECT scene, quantile_cont(balm, 0.25) AS a, quantile_cont(balm, 0.5) AS m, quantile_cont(balm, 0.75) AS b FROM lab GROUP BY scene)
SELECT point_id, round(CASE WHEN b - a > 0 THEN (balm - m) / (b - a) ELSE balm END, 5) AS balm_norm FROM lab LEFT JOIN q USING (scene)""")
def zscore_scene(spark, d):
    return rounded(stats.zscore(labelled(spark, d), ["scene"], "balm").select("point_id", "balm_norm"), 5, "balm_norm")


@query(f"""WITH {LABELLED}, q AS (SELECT scene, quantile_cont(distance, 0.5) AS m FROM lab GROUP BY scene)
SELECT point_id, round(CASE WHEN m > 0 THEN distance / m ELSE distance END, 5) AS distance_norm FROM lab LEFT JOIN q USING (scene)""")
def target_over_median(spark, d):
    return rounded(stats.over_median(labelled(spark, d), ["scene"], "distance").select("point_id", "distance_norm"), 5, "distance_norm")


@query(f"WITH {LABELLED} SELECT scene, round(quantile_cont(distance, 0.9), 6) AS tau FROM lab GROUP BY scene")
def tau_for_rate(spark, d):
    return rounded(stats.tau_for_rate(labelled(spark, d), ["scene"], "distance", 0.1), 6, "tau")


@query(f"WITH {POINTS} SELECT scene, " + ", ".join(f"round(quantile_cont({c}, 0.001), 4) AS {c}_lo, round(quantile_cont({c}, 0.999), 4) AS {c}_hi" for c in "xyz") + " FROM pts GROUP BY scene")
def dense_extent(spark, d):
    return rounded(stats.dense_extent(points(spark, d), ["scene"]), 4, *[f"{c}_{s}" for c in "xyz" for s in ("lo", "hi")])


@query(f"""WITH {LABELLED}, s AS (SELECT scene, avg(knn) AS m, stddev_pop(knn) AS s FROM lab GROUP BY scene), f AS (SELECT unnest([1.0, 2.0, 3.0]) AS factor)
SELECT scene, CAST(factor AS DOUBLE) AS factor, round(m + factor * s, 6) AS threshold, round(avg(CASE WHEN knn > round(m + factor * s, 9) THEN 1.0 ELSE 0.0 END), 6) AS removed FROM lab JOIN s USING (scene), f WHERE knn IS NOT NULL GROUP BY scene, factor, m, s""")
def sor_operating_points(spark, d):
    return rounded(stats.sor_points(labelled(spark, d), ["scene"], "knn", [1.0, 2.0, 3.0]), 6, "threshold", "removed")


@query(f"""WITH {LABELLED}, r AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY coalesce(knn, 1e308), point_id) AS rn, count(*) OVER (PARTITION BY scene) AS n FROM lab)
SELECT point_id FROM r WHERE rn <= greatest(round_even(n * (1 - 0.2), 0), 1)""")
def keep_best(spark, d):
    return stats.keep_best(labelled(spark, d), ["scene"], F.col("knn"), "point_id", 0.2).select("point_id")


SCORED = f"sc AS (SELECT point_id, cloud_id, min({pres('predicted_c2c')}) AS s FROM predict_cloud GROUP BY ALL)"


@query(f"WITH {SCORED}, q AS (SELECT cloud_id, quantile_cont(s, 0.8) AS c FROM sc GROUP BY cloud_id) SELECT point_id, CASE WHEN coalesce(s <= c, false) THEN 1 ELSE 0 END AS filter_keep FROM sc LEFT JOIN q USING (cloud_id)")
def flag_worst(spark, d):
    s = table(spark, d, "predict_cloud").groupBy("point_id", "cloud_id").agg(F.min(present("predicted_c2c")).alias("s"))
    return stats.flag_worst(s, ["cloud_id"], "s", 0.2).select("point_id", "filter_keep")


@query("SELECT point_id FROM (SELECT point_id, row_number() OVER (ORDER BY point_id) AS r FROM (SELECT DISTINCT point_id FROM outlier_analysis)) WHERE (r - 1) % 17 = 0")
def stride_sample(spark, d):
    return stats.stride_sample(table(spark, d, "outlier_analysis").select("point_id").distinct(), "point_id", 17)


@query()
def bernoulli_sample(spark, d):
    return stats.hash_sample(table(spark, d, "outlier_analysis").select("point_id").distinct(), ["point_id"], 1000)


@query()
def fixed_sample(spark, d):
    return stats.fixed_sample(table(spark, d, "outlier_analysis").select("point_id").distinct(), ["point_id"], 100)


# ---- metrics ----------------------------------------------------------------------------------------------------

INF = "CAST('inf' AS DOUBLE)"
JUDGED = f"{LABELLED}, {SCORED}, j AS (SELECT lab.*, coalesce(s, {INF}) AS score FROM lab LEFT JOIN sc ON sc.point_id = lab.point_id AND sc.cloud_id = lab.cloud_id)"


def judged(spark, d):
    s = table(spark, d, "predict_cloud").groupBy("point_id", "cloud_id").agg(F.min(present("predicted_c2c")).alias("s"))
    return metrics.scored(labelled(spark, d).join(s, ["point_id", "cloud_id"], "left"), F.col("s"), F.col("distance"))


@query(f"""WITH {JUDGED}, b AS (SELECT *, 'model' AS scorer FROM j UNION ALL BY NAME SELECT * REPLACE (distance AS score), 'oracle' AS scorer FROM j),
r AS (SELECT scorer, distance, row_number() OVER (PARTITION BY scorer ORDER BY score, point_id) AS rn, count(*) OVER (PARTITION BY scorer) AS n, count(*) FILTER (WHERE distance <= 0.05) OVER (PARTITION BY scorer) AS inl FROM b),
f AS (SELECT round(unnest(range(26)) * 0.02, 2) AS budget),
k AS (SELECT scorer, budget, n, inl, greatest(round_even(n * (1 - budget), 0), 1) AS keep, distance FROM r, f WHERE rn <= greatest(round_even(n * (1 - budget), 0), 1)),
a AS (SELECT scorer, budget, n, inl, CAST(keep AS BIGINT) AS kept, avg(distance) AS m, median(distance) AS md, quantile_cont(distance, 0.9) AS p90, count(*) FILTER (WHERE distance <= 0.05) AS good FROM k GROUP BY ALL)
SELECT scorer, budget, round(1 - kept / n, 6) AS removed, kept, round(m, 5) AS mean_c2c, round(md, 5) AS median_c2c, round(p90, 5) AS p90_c2c, round(1 - good / kept, 6) AS outlier_rate, round(good / kept, 6) AS precision,
round(good / inl, 6) AS recall, round(2 * (good / kept) * (good / inl) / (good / kept + good / inl), 6) AS f1 FROM a""")
def budget_curve(spark, d):
    j = judged(spark, d).select("point_id", "score", "distance")
    both = j.withColumn("scorer", F.lit("model")).unionByName(j.withColumns({"score": F.col("distance"), "scorer": F.lit("oracle")}))
    c = metrics.budget_curve(both, ["scorer"], "point_id", TAU)
    return rounded(rounded(c, 5, "mean_c2c", "median_c2c", "p90_c2c"), 6, "removed", "outlier_rate", "precision", "recall", "f1")


@query(f"""WITH {JUDGED}, t AS (SELECT unnest([0.02, 0.05]) AS tau), c AS (SELECT scene, CAST(tau AS DOUBLE) AS tau, score, count(*) FILTER (WHERE distance > tau) AS pos, count(*) FILTER (WHERE NOT distance > tau) AS neg FROM j, t GROUP BY ALL),
w AS (SELECT *, sum(pos) OVER v AS tp, sum(neg) OVER v AS fp FROM c WINDOW v AS (PARTITION BY scene, tau ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
a AS (SELECT scene, tau, CAST(sum(pos) AS BIGINT) AS pos, CAST(sum(neg) AS BIGINT) AS neg, sum(neg * (tp - pos / 2)) AS u, sum(pos * tp / (tp + fp)) AS p FROM w GROUP BY ALL)
SELECT scene, tau, pos, neg, round(CASE WHEN pos > 0 AND neg > 0 THEN u / (pos * neg) END, 6) AS auc, round(CASE WHEN pos > 0 AND neg > 0 THEN p / pos END, 6) AS ap, round(pos / (pos + neg), 6) AS base,
round(CASE WHEN pos > 0 AND neg > 0 THEN (p / pos - pos / (pos + neg)) / (1 - pos / (pos + neg)) END, 6) AS lift FROM a""")
def roc_auc_ap_lift(spark, d):
    return rounded(metrics.auc_by_tau(judged(spark, d), ["scene"], [0.02, 0.05]), 6, "auc", "ap", "base", "lift")


@query(f"""WITH {LABELLED}, v AS (SELECT scene, knn, distance FROM lab WHERE knn IS NOT NULL), r AS (SELECT scene, rank() OVER (PARTITION BY scene ORDER BY knn) + (count(*) OVER (PARTITION BY scene, knn) - 1) / 2.0 AS a, rank() OVER (PARTITION BY scene ORDER BY distance) + (count(*) OVER (PARTITION BY scene, distance) - 1) / 2.0 AS b FROM v)
SELECT scene, count(*) AS n, round(CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END, 6) AS rho FROM r GROUP BY scene""")
def spearman(spark, d):
    return rounded(metrics.spearman(labelled(spark, d), ["scene"], "knn", "distance"), 6, "rho")


@query(f"""WITH {LABELLED}, l AS (SELECT distance, unnest(['knn', 'balm', 'quality', 'rng']) AS channel, unnest([knn, balm, quality, rng]) AS score FROM lab), c AS (SELECT channel, score, count(*) FILTER (WHERE distance > 0.05) AS pos, count(*) FILTER (WHERE NOT distance > 0.05) AS neg FROM l WHERE score IS NOT NULL GROUP BY ALL),
w AS (SELECT *, sum(pos) OVER (PARTITION BY channel ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp FROM c), a AS (SELECT channel, CAST(sum(pos) AS BIGINT) AS pos, CAST(sum(neg) AS BIGINT) AS neg, sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)) AS auc FROM w GROUP BY channel)
SELECT channel, pos, neg, round(greatest(auc, 1 - auc), 6) AS auc, CASE WHEN auc >= 0.5 THEN 1 ELSE -1 END AS direction FROM a""")
def channel_auc(spark, d):
    return rounded(metrics.channel_auc(labelled(spark, d), [], {c: F.col(c) for c in ("knn", "balm", "quality", "rng")}, TAU), 6, "auc")


@query(f"WITH {JUDGED}, k AS (SELECT scene, distance - score AS e, distance < score AS c FROM j WHERE isfinite(score)) SELECT scene, count(*) AS n, round(avg(e * e), 6) AS mse, round(avg(greatest(0.9 * e, -0.1 * e)), 6) AS pinball, round(avg(CASE WHEN c THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM k GROUP BY scene")
def model_losses(spark, d):
    return rounded(metrics.losses(judged(spark, d), ["scene"], F.col("distance"), finite("score"), 0.9), 6, "mse", "pinball", "coverage")


@query(f"WITH {LABELLED}, b AS (SELECT scene, CAST(floor(distance / 0.01) AS BIGINT) AS bin, count(*) AS n FROM lab GROUP BY ALL) SELECT scene, bin, n, round(sum(n) OVER (PARTITION BY scene ORDER BY bin) / sum(n) OVER (PARTITION BY scene), 6) AS cdf FROM b")
def distance_histogram(spark, d):
    return rounded(metrics.histogram(labelled(spark, d), ["scene"], F.col("distance"), 0.01), 6, "cdf")


@query(f"""WITH {JUDGED}, c AS (SELECT score, count(*) FILTER (WHERE distance > 0.05) AS pos, count(*) FILTER (WHERE NOT distance > 0.05) AS neg FROM j GROUP BY ALL)
SELECT score, round(sum(neg) OVER w / sum(neg) OVER (), 6) AS fpr, round(sum(pos) OVER w / sum(pos) OVER (), 6) AS tpr FROM c WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)""")
def roc_points(spark, d):
    j = judged(spark, d).withColumn("all", F.lit(1))
    return rounded(metrics.roc_points(j, ["all"], TAU).drop("all"), 6, "fpr", "tpr")


@query(f"""WITH {OUT}, a AS (SELECT DISTINCT {cells(5.0, 'ix,iy', 'xy')} FROM o WHERE gt_group = 1), b AS (SELECT DISTINCT {cells(5.0, 'ix,iy', 'xy')} FROM o WHERE gt_group = 2), x AS (SELECT a.ix AS ai, b.ix AS bi FROM a FULL JOIN b ON a.ix = b.ix AND a.iy = b.iy)
SELECT count(*) FILTER (WHERE ai IS NOT NULL AND bi IS NOT NULL) AS both, count(*) FILTER (WHERE bi IS NULL) AS only_a, count(*) FILTER (WHERE ai IS NULL) AS only_b, round(count(*) FILTER (WHERE ai IS NOT NULL AND bi IS NOT NULL) / count(*), 6) AS agreement FROM x""")
def group_overlap(spark, d):
    c = grid.with_cell(out_points(spark, d), 5.0, ["x", "y"], ["ix", "iy"])
    return rounded(metrics.overlap(c.where("gt_group = 1"), c.where("gt_group = 2"), ["ix", "iy"]), 6, "agreement")


@query(f"""WITH v AS (SELECT abs({pres('c2c_rigid')} - {pres('C2C_distance')}) * 1000 AS d FROM outlier_analysis WHERE c2c_rigid >= 0 AND C2C_distance >= 0), w AS (SELECT d FROM v WHERE d IS NOT NULL)
SELECT count(*) AS n, round(quantile_cont(d, 0.99), 3) AS p99_mm, round(max(d), 3) AS largest_mm, max(d) <= 2.0 AS ok FROM w""")
def label_revalidation(spark, d):
    o = table(spark, d, "outlier_analysis").where("c2c_rigid >= 0 AND C2C_distance >= 0").select(present("c2c_rigid").alias("a"), present("C2C_distance").alias("b"))
    return rounded(metrics.revalidate(o, "a", "b"), 3, "p99_mm", "largest_mm")


@query("WITH n AS (SELECT visibility_code AS code, count(*) AS n FROM outlier_analysis WHERE visibility_code IS NOT NULL GROUP BY ALL), e AS (SELECT CAST(unnest(range(4)) AS INTEGER) AS code) SELECT e.code, coalesce(n, 0) AS n, round(coalesce(n / (SELECT sum(n) FROM n), 0), 6) AS share FROM e LEFT JOIN n ON n.code = e.code")
def visibility_composition(spark, d):
    return rounded(vis.composition(table(spark, d, "outlier_analysis"), "visibility_code", 4), 6, "share")


# ---- visibility -------------------------------------------------------------------------------------------------

RES = 5.0
STATION = f"""s AS (SELECT station_id, scene, gt_group, el_min, el_max, max_range, {", ".join(f"rotation[{i+1}][{j+1}] AS r{i}{j}" for i in range(3) for j in range(3))}, origin[1] AS t0, origin[2] AS t1, origin[3] AS t2 FROM station)"""


def seen_sql(source: str, p: str) -> str:
    """CTEs up to {p}vw: the points of ``source`` in the bins of every station."""
    return f"""{p}l AS (SELECT o.point_id, s.*, {", ".join(f"r0{i}*(x-t0) + r1{i}*(y-t1) + r2{i}*(z-t2) AS l{i}" for i in range(3))} FROM {source} o JOIN s ON o.scene = s.scene),
{p}v AS (SELECT *, sqrt(l0*l0 + l1*l1 + l2*l2) AS r FROM {p}l), {p}u AS (SELECT *, degrees(asin(greatest(least(l2 / r, 1.0), -1.0))) AS el, CAST(floor((degrees(atan2(l1, l0)) + 180) / {RES}) AS INTEGER) % 72 AS ia FROM {p}v WHERE r > 1e-6 AND r <= max_range),
{p}vw AS (SELECT *, CAST(floor((el - el_min) / {RES}) AS INTEGER) AS ie FROM {p}u WHERE el BETWEEN el_min AND el_max)"""


VIEW = f"{STATION}, {seen_sql('o', '')}"


def view(spark, d):
    return vis.station_view(out_points(spark, d).drop("gt_group"), table(spark, d, "station"), RES)


@query(f"WITH {OUT}, {VIEW} SELECT station_id, ia, ie, round(min(r), 5) AS near, round(max(r), 5) AS far FROM vw GROUP BY ALL")
def panorama_bins(spark, d):
    return rounded(vis.panorama(view(spark, d)), 5, "near", "far")


@query(f"""WITH {OUT}, {POINTS}, {VIEW}, {seen_sql('pts', 'g')}, b AS (SELECT station_id, ia, ie, min(r) AS near, max(r) AS far FROM gvw GROUP BY ALL),
w AS (SELECT station_id, (ia + da + 72) % 72 AS ia, ie + de AS ie, min(near) AS near, max(far) AS far FROM b, (SELECT unnest([-1, 0, 1]) AS da), (SELECT unnest([-1, 0, 1]) AS de) GROUP BY ALL),
c AS (SELECT vw.point_id, gt_group, CASE WHEN near IS NULL THEN 0 WHEN r < near - (0.02 + 0.002 * r) THEN 2 WHEN r > far + (0.02 + 0.002 * r) + 0.10 THEN 1 ELSE 3 END AS code FROM vw LEFT JOIN w ON w.station_id = vw.station_id AND w.ia = vw.ia AND w.ie = vw.ie)
SELECT o.point_id, coalesce(max(code), 0) AS visibility, CASE WHEN coalesce(max(code), 0) > 0 THEN arg_max(c.gt_group, (code, -c.gt_group)) ELSE 0 END AS "group" FROM (SELECT DISTINCT point_id FROM o) o LEFT JOIN c ON c.point_id = o.point_id GROUP BY o.point_id""")
def visibility_fuse(spark, d):
    v = view(spark, d)
    bins = vis.widen(vis.panorama(vis.station_view(points(spark, d), table(spark, d, "station"), RES)), 72)
    return vis.fuse(out_points(spark, d), vis.verdicts(v, bins), "point_id").withColumn("group", F.col("group").cast("int"))


@query(f"WITH {OUT} SELECT DISTINCT point_id FROM o WHERE EXISTS (SELECT 1 FROM station s WHERE s.scene = o.scene AND (x - origin[1])*(x - origin[1]) + (y - origin[2])*(y - origin[2]) + (z - origin[3])*(z - origin[3]) <= (max_range + 1.0)*(max_range + 1.0))")
def station_reach(spark, d):
    return vis.within_reach(out_points(spark, d), table(spark, d, "station"), 1.0).select("point_id").distinct()


@query(f"""SELECT DISTINCT point_id, CASE WHEN visibility_code NOT IN (2, 3) OR visibility_code IS NULL THEN 5 WHEN x BETWEEN 100 AND 110 AND y BETWEEN 80 AND 100 AND z BETWEEN -5 AND 5 THEN 4 WHEN {pres('C2C_distance')} IS NULL AND visibility_code = 3 THEN 1 ELSE 0 END AS code,
round(CASE WHEN (visibility_code IN (2, 3)) AND NOT (x BETWEEN 100 AND 110 AND y BETWEEN 80 AND 100 AND z BETWEEN -5 AND 5) AND NOT ({pres('C2C_distance')} IS NULL AND visibility_code = 3) THEN coalesce({pres('C2C_distance')}, 0.5) END, 6) AS c2c FROM outlier_analysis""")
def domain_codes(spark, d):
    c2c, v = present("C2C_distance"), F.coalesce(F.col("visibility_code").cast("int"), F.lit(0))
    o = table(spark, d, "outlier_analysis").withColumn("code", vis.domain_code(v, vis.in_boxes([((100, 80, -5), (110, 100, 5))]), F.lit(False), c2c))
    return o.select("point_id", "code", F.round(vis.clamp_free_space(v, F.col("code"), c2c, 0.5), 6).alias("c2c")).distinct()


BOX = [((90.0, 60.0, -10.0), (120.0, 120.0, 10.0))]
POLY = [(0.0, 0.0), (120.0, 10.0), (150.0, 140.0), (40.0, 120.0)]
INSIDE = " + ".join(f"CASE WHEN ({y1} > y) <> ({y2} > y) AND x < ({x2} - {x1}) * (y - {y1}) / ({y2} - {y1}) + {x1} THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in zip(POLY, POLY[1:] + POLY[:1]))


@query(f"WITH {OUT}, m AS (SELECT DISTINCT {cells(4.0)} FROM o WHERE gt_group = 1), c AS (SELECT *, {cells(4.0)} FROM o) SELECT point_id, x BETWEEN 90 AND 120 AND y BETWEEN 60 AND 120 AND z BETWEEN -10 AND 10 AS box, ({INSIDE}) % 2 = 1 AND z BETWEEN -3 AND 3 AS prism, EXISTS (SELECT 1 FROM m WHERE m.ix = c.ix AND m.iy = c.iy AND m.iz = c.iz) AS voxel FROM c")
def exclusion_volumes(spark, d):
    o = out_points(spark, d)
    mask = grid.with_cell(o.where("gt_group = 1"), 4.0)
    hit = vis.in_voxels(o, mask, 4.0).select("point_id", F.lit(True).alias("voxel")).distinct()
    return o.select("point_id", vis.in_boxes(BOX).alias("box"), vis.in_prism(POLY, -3.0, 3.0).alias("prism")).join(hit, "point_id", "left").withColumn("voxel", F.coalesce("voxel", F.lit(False)))


@query(f"""WITH g AS (SELECT CAST(unnest(range(0, 38)) AS BIGINT) AS ix), h AS (SELECT ix, CAST(unnest(range(0, 36)) AS BIGINT) AS iy FROM g), c AS (SELECT ix, iy, (ix + 0.5) * 4.0 AS x, (iy + 0.5) * 4.0 AS y FROM h) SELECT ix, iy FROM c WHERE ({INSIDE}) % 2 = 1""")
def polygon_footprint(spark, d):
    return vis.polygon_cells(spark, POLY, 4.0)


@query(f"""WITH {OUT}, r AS (SELECT {cells(4.0)}, count(*) AS n FROM o WHERE gt_group >= 1 GROUP BY ix, iy, iz), c AS (SELECT point_id, {cells(4.0)}, CAST(CASE WHEN visibility_code IN (2, 3) THEN 0 ELSE 5 END AS INTEGER) AS code FROM o), j AS (SELECT point_id, code, coalesce(n, 0) AS n FROM c LEFT JOIN r USING (ix, iy, iz)),
t AS (SELECT quantile_cont(n, 0.1) AS t FROM j WHERE code = 0 AND n > 0) SELECT point_id, n AS reference_count, CAST(CASE WHEN code = 0 AND n < t THEN 1 ELSE code END AS INTEGER) AS gated_code FROM j, t""")
def density_gate(spark, d):
    o = out_points(spark, d).withColumn("domain_code", F.when(F.col("visibility_code").isin(2, 3), 0).otherwise(5))
    return vis.density_gate(o, o.where("gt_group >= 1"), 4.0, 10).select("point_id", "reference_count", "gated_code")


FOOT = f"""k AS (SELECT {cells(10.0, 'ix,iy', 'xy')}, count(*) AS n FROM o WHERE gt_group >= 1 GROUP BY ix, iy HAVING count(*) >= 2), bb AS (SELECT min(ix) - 1 AS a, max(ix) + 1 AS b, min(iy) - 1 AS c, max(iy) + 1 AS d FROM k),
box AS (SELECT ix, unnest(range(c, d + 1)) AS iy FROM (SELECT unnest(range(a, b + 1)) AS ix, c, d FROM bb)), empty AS (SELECT ix, iy FROM box WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.ix = box.ix AND k.iy = box.iy)),
outside AS (SELECT a AS ix, c AS iy FROM bb UNION SELECT e.ix, e.iy FROM outside s JOIN empty e ON abs(e.ix - s.ix) + abs(e.iy - s.iy) = 1),
filled AS (SELECT ix, iy FROM k UNION SELECT ix, iy FROM empty EXCEPT SELECT ix, iy FROM outside), f AS (SELECT DISTINCT ix + a AS ix, iy + b AS iy FROM filled, (VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)) m(a, b))"""


@query(f"WITH RECURSIVE {OUT}, {FOOT} SELECT CAST(ix AS BIGINT) AS ix, CAST(iy AS BIGINT) AS iy FROM f")
def footprint(spark, d):
    return vis.footprint(out_points(spark, d).where("gt_group >= 1"), 10.0, 2, 10.0)


@query(f"""WITH RECURSIVE {OUT}, {FOOT}, c AS (SELECT point_id, x, y, z, visibility_code, {cells(10.0, 'ix,iy', 'xy')} FROM o)
SELECT point_id, CASE WHEN NOT z BETWEEN -4 AND 4 THEN 3 WHEN f.ix IS NULL THEN 2 WHEN x BETWEEN 90 AND 120 AND y BETWEEN 60 AND 120 AND z BETWEEN -10 AND 10 THEN 4 WHEN NOT coalesce(visibility_code >= 2, false) THEN 1 ELSE 0 END AS code FROM c LEFT JOIN f USING (ix, iy)""")
def proximity_domain(spark, d):
    o = out_points(spark, d)
    foot = vis.footprint(o.where("gt_group >= 1"), 10.0, 2, 10.0)
    return vis.proximity_domain(o, foot, 10.0, -4.0, 4.0, vis.in_boxes(BOX), F.coalesce(F.col("visibility_code") >= 2, F.lit(False))).select("point_id", "code")


@query("SELECT scene, count(*) AS stations, CAST(sum(points) AS BIGINT) AS points, round(min(el_min), 4) AS el_min, round(max(el_max), 4) AS el_max, round(max(max_range), 4) AS max_range FROM station GROUP BY scene")
def station_summary(spark, d):
    s = table(spark, d, "station").groupBy("scene").agg(F.count("*").alias("stations"), F.sum("points").alias("points"), F.min("el_min").alias("el_min"), F.max("el_max").alias("el_max"), F.max("max_range").alias("max_range"))
    return rounded(s, 4, "el_min", "el_max", "max_range")


# ---- planes and places ------------------------------------------------------------------------------------------


@query(f"WITH c AS (SELECT {cells(4.0)}, scan_id, {pres('balm_res')} AS b FROM (SELECT DISTINCT pt_id, scan_id, x, y, z, balm_res FROM pcd WHERE {XYZ_OK})) SELECT ix, iy, iz, count(DISTINCT scan_id) AS scans, count(b) AS n, round(CASE WHEN count(b) >= 3 THEN stddev_samp(b) END, 6) AS sd FROM c GROUP BY ALL")
def node_support(spark, d):
    p = grid.located(table(spark, d, "pcd")).select("pt_id", "scan_id", "x", "y", "z", "balm_res").distinct().withColumn("b", present("balm_res"))
    return rounded(planes.support(p, 4.0, "b"), 6, "sd")


BITS = " | ".join(f"(CASE WHEN embedding[{i + 4}] > 0 THEN {1 << i} ELSE 0 END)" for i in range(30))
DESC = f"e AS (SELECT vec_id // 10 AS frame, vec_id AS id, abs(embedding[1]) * 40 AS s0, abs(embedding[2]) * 40 AS s1, abs(embedding[3]) * 40 AS s2, CAST({BITS} AS BIGINT) AS bits FROM embeddings)"
MATCH = """m AS (SELECT a.frame AS frame_q, a.id AS id_q, b.frame AS frame_c, b.id AS id_c, 2.0 * bit_count(a.bits & b.bits) / (bit_count(a.bits) + bit_count(b.bits)) AS dice FROM e a JOIN e b ON a.frame - b.frame > 2
AND abs(floor(a.s0) - floor(b.s0)) <= 1 AND abs(floor(a.s1) - floor(b.s1)) <= 1 AND abs(floor(a.s2) - floor(b.s2)) <= 1 WHERE bit_count(a.bits) + bit_count(b.bits) > 0 AND sqrt((a.s0-b.s0)*(a.s0-b.s0) + (a.s1-b.s1)*(a.s1-b.s1) + (a.s2-b.s2)*(a.s2-b.s2)) < 0.3 * sqrt(a.s0*a.s0 + a.s1*a.s1 + a.s2*a.s2)
AND 2.0 * bit_count(a.bits & b.bits) / (bit_count(a.bits) + bit_count(b.bits)) > 0.4)"""


def descriptors(spark, d):
    e = table(spark, d, "embeddings")
    v = F.col("embedding")
    return e.select(F.floor(F.col("vec_id") / 10).cast("long").alias("frame"), F.col("vec_id").alias("id"), *[(F.abs(v[i]) * 40).alias(f"s{i}") for i in range(3)], places.sign_bits(v, 3, 30).alias("bits"))


@query(f"WITH {DESC}, {MATCH} SELECT frame_q, id_q, frame_c, id_c, round(dice, 6) AS dice FROM m")
def dice_candidates(spark, d):
    e = descriptors(spark, d)
    return rounded(places.candidates(e, e, 2, 0.3, 0.4), 6, "dice")


@query(f"WITH {DESC}, {MATCH}, v AS (SELECT frame_q, frame_c, count(*) AS votes FROM m GROUP BY ALL HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY frame_q ORDER BY votes DESC, frame_c) AS place FROM v) SELECT frame_q, frame_c, votes, place FROM r WHERE place <= 3")
def candidate_frames(spark, d):
    e = descriptors(spark, d)
    return places.top_frames(places.candidates(e, e, 2, 0.3, 0.4), 3, 2)


CORNER = f"k AS (SELECT p.pt_id, p.x, p.y, p.z, coalesce(s, 0) AS s FROM p LEFT JOIN (SELECT pt_id, min({fin('reflectivity')}) AS s FROM pcd GROUP BY pt_id) q USING (pt_id))"


@query(f"WITH {PCD}, {CORNER} SELECT pt_id FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE a.pt_id <> b.pt_id AND b.s >= a.s AND {D2} < 0.5 * 0.5)")
def corner_suppression(spark, d):
    ok = finite("x").isNotNull() & finite("y").isNotNull() & finite("z").isNotNull()
    s = F.coalesce(F.min(finite("reflectivity")), F.lit(0.0)).alias("s")
    k = table(spark, d, "pcd").groupBy("pt_id").agg(*[F.min(F.when(ok, F.col(c))).alias(c) for c in "xyz"], s)
    return places.suppress(k, 0.5, "pt_id", "s").select("pt_id")


@query(f"WITH {OUT}, c AS (SELECT {cells(10.0, 'ix,iy', 'xy')}, CAST(floor(z * 8) AS BIGINT) AS h FROM o) SELECT ix, iy, CAST(floor(h / 62.0) AS BIGINT) AS word, bit_or(CAST(1 AS BIGINT) << CAST(h - floor(h / 62.0) * 62 AS BIGINT)) AS bits FROM c GROUP BY ALL")
def occupancy_bits(spark, d):
    c = grid.with_cell(out_points(spark, d), 10.0, ["x", "y"], ["ix", "iy"]).withColumn("h", F.floor(F.col("z") * 8).cast("long"))
    return places.occupancy_bits(c, ["ix", "iy"], "h")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT doc_id AS u, duplicate_of AS v FROM documents WHERE duplicate_of IS NOT NULL), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r(node, c) AS (SELECT u, u FROM b UNION SELECT b.v, r.c FROM r JOIN b ON b.u = r.node WHERE r.c < b.v)
SELECT node, min(c) AS component FROM r GROUP BY node""")
def edge_components(spark, d):
    return places.components(table(spark, d, "documents").select(F.col("doc_id").alias("u"), F.col("duplicate_of").alias("v")))


# ---- streaming twins --------------------------------------------------------------------------------------------


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 21600000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, s""")
def session_windows(spark, d):
    s = sessions.sessions_batch(table(spark, d, "events"), "user_id", "ts", "6 hours")
    return s.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


# ---- models -----------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT point_id, CASE WHEN stretch_id IS NULL OR stretch_id < 0 THEN 'lone|' || point_id ELSE scene || '|' || stretch_id END AS group_key FROM outlier_analysis")
def group_keys(spark, d):
    return table(spark, d, "outlier_analysis").select("point_id", model.group_key(F.col("stretch_id"), F.col("scene"), F.col("point_id")).alias("group_key")).distinct()


def training_rows(spark, d):
    rows = model.in_domain(model.discover(table(spark, d, "outlier_analysis")))
    o = rows.groupBy("point_id").agg(F.min(F.struct(*[c for c in rows.columns if c != "point_id"])).alias("r")).select("point_id", "r.*")  # of repeats the smallest row
    return model.split_groups(o, model.group_key(F.col("stretch_id"), F.col("scene"), F.col("point_id")))


@query()
def gbt_scores(spark, d):
    rows = training_rows(spark, d)
    fs = ["balm_res", "ekf_res", "plane_quality", "obs_count", "view_diversity", "temp_consistency", "range", "intensity", "mean_knn_dist"]
    fitted = {f"predicted_{o}": (model.fit(rows, fs, "C2C_distance", "point_id", o), fs) for o in ("mean", "q90")}
    return model.score(rows, fitted).select("point_id", "validation", *fitted)
