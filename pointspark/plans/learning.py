"""Queries of feature sets, samples, ranking, models and the sequential rules of a session, each with an SQL twin.

Where a result is a fitted model, the query states properties that the model must have, and the twin says that they hold.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointspark.functions.missing import finite, present
from pointspark.operators import grid, merge, metrics, model, stats
from pointspark.plans.reference import INF, JUDGED, LABELLED, TAU, TRAJ, XYZ_OK, cells, fin, judged, labelled, poses, pres, rounded
from pointspark.plans.scenes import QUAT, WX, WY, WZ
from pointspark.session import cut, scratch, table
from pointspark.streaming import sessions

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL


# ---- channels ---------------------------------------------------------------------------------------------------

SENSOR = "'intensity', 'reflectivity', 'ring', 'scan_time', 'range'"
INNER = "'balm_res', 'ekf_res', 'plane_quality', 'obs_count', 'view_diversity', 'temp_consistency', 'ang_rate', 'pv_var'"


@query(f"""SELECT 'geom_only' AS arm, 'mean_knn_dist' AS channel UNION ALL SELECT 'sensor_only', unnest([{SENSOR}]) UNION ALL SELECT 'slam_int_only', unnest([{INNER}])
UNION ALL SELECT 'slam_only', unnest([{SENSOR}, {INNER}]) UNION ALL SELECT 'slam_plus', unnest([{SENSOR}, {INNER}, 'mean_knn_dist']) UNION ALL SELECT 'no_A', unnest([{INNER}, 'mean_knn_dist'])
UNION ALL SELECT 'geom_plus_A', unnest([{SENSOR}, 'mean_knn_dist']) UNION ALL SELECT 'aggregated', unnest([{SENSOR}, {INNER}]) UNION ALL SELECT 'without ring', unnest([{INNER}, 'mean_knn_dist', 'intensity', 'reflectivity', 'scan_time', 'range'])""")
def feature_sets(spark, d):
    """Channels discovered in the labelled cloud, and the column sets made of them."""
    o = model.discover(table(spark, d, "outlier_analysis"), ["pv_var"])
    fs = model.features_of(model.drop_columns(o, ["visibility_code"], aggregates=True))
    arms = model.arms(fs)
    rows = [(a, c) for a in ("geom_only", "sensor_only", "slam_int_only", "slam_only", "slam_plus", "no_A", "geom_plus_A") for c in arms[a]]
    rows += [("aggregated", c) for c in model.default_aggregated(fs)] + [("without ring", c) for c in model.exclude(fs, ["ring"])]
    return spark.createDataFrame(rows, "arm string, channel string")


@query("SELECT kept, duplicate FROM (VALUES ('ring', 'ring_again'), ('range', 'distance_again')) v(kept, duplicate)")
def duplicate_channels(spark, d):
    """Channels that agree bit for bit."""
    o = table(spark, d, "outlier_analysis").withColumns({"ring_again": F.col("ring"), "distance_again": F.col("range"), "nearly": F.col("range") + 1e-3})
    return spark.createDataFrame(model.duplicate_channels(o, ["ring", "range", "balm_res", "ring_again", "distance_again", "nearly"]), "kept string, duplicate string")


@query(f"SELECT DISTINCT point_id, cloud_id FROM outlier_analysis WHERE {fin('C2C_distance')} >= 0 AND eval_domain")
def domain_rows(spark, d):
    """P2."""
    return model.in_domain(table(spark, d, "outlier_analysis")).select("point_id", "cloud_id").distinct()


@query("WITH s AS (SELECT DISTINCT scene FROM outlier_analysis WHERE scene IS NOT NULL) SELECT scene, scene = (SELECT min(scene) FROM s) AS held_out, CASE WHEN (SELECT count(*) FROM s) > 2 THEN 'scene' ELSE 'group' END AS held_by FROM s")
def holdout(spark, d):
    """A held-out scene by its name, and how validation rows are chosen."""
    names = sorted(r["scene"] for r in table(spark, d, "outlier_analysis").where("scene is not null").select("scene").distinct().collect())  # one row a scene
    held = model.holdout_scenes(names, names[:1])
    return spark.createDataFrame([(n, n in held, model.group_choice(len(names), True)) for n in names], "scene string, held_out boolean, held_by string")


@query("SELECT 'about 1000' AS sample, true AS inside, true AS size_right, true AS \"same\" UNION ALL SELECT 'exactly 100', true, true, true")
def sample_sizes(spark, d):
    """Samples are parts of the table, of the wanted size, and the same in any partitioning."""
    ids = table(spark, d, "outlier_analysis").select("point_id").distinct()
    other = ids.repartition(3, "point_id")
    n, out = ids.count(), []
    for name, take, right in (("about 1000", lambda x: stats.hash_sample(x, ["point_id"], 1000), lambda m: abs(m - min(n, 1000)) <= 5 * 1000**0.5), ("exactly 100", lambda x: stats.fixed_sample(x, ["point_id"], 100), lambda m: m == min(n, 100))):
        a, b = cut(take(ids)), cut(take(other))
        out.append((name, a.join(ids, "point_id", "left_anti").count() == 0, right(a.count()), a.join(b, "point_id", "left_anti").count() == 0 and a.count() == b.count()))
    return spark.createDataFrame(out, "sample string, inside boolean, size_right boolean, same boolean")


@query(f"""WITH {LABELLED}, e AS (SELECT scene, list_transform(quantile_cont(round(balm, 6), [{", ".join(f"{i / 1000:.3f}" for i in range(1001))}]), lambda v: round(v, 9) - 1e-10) AS q FROM lab WHERE balm IS NOT NULL GROUP BY scene), b AS (SELECT point_id, scene, round(balm, 6) AS balm FROM lab), j AS (SELECT point_id, lab.scene, balm, q, len(list_filter(q, lambda v: v <= balm)) AS k FROM b lab LEFT JOIN e ON e.scene = lab.scene)
SELECT point_id, scene, round(CASE WHEN q IS NULL OR q[1] = q[1001] OR balm IS NULL THEN balm WHEN k = 0 THEN 0 WHEN k > 1000 THEN 1 ELSE (k - 1 + CASE WHEN q[k + 1] > q[k] THEN (balm - q[k]) / (q[k + 1] - q[k]) ELSE 0 END) / 1000 END, 4) AS balm_rank FROM j""")
def rank_norm_scene(spark, d):
    """Rank by the scene's 1,001 quantile edges."""
    lab = labelled(spark, d).withColumn("balm", F.round("balm", 6))
    # an edge that is a value may differ from it in the last bit, by the rounding of its rank
    edges = stats.quantile_edges(lab, ["scene"], "balm").withColumn("edges", F.transform("edges", lambda e: F.round(e, 9) - 1e-10))
    out = stats.rank_normalise(lab, ["scene"], "balm", edges).select("point_id", "scene", "balm_rank")
    return rounded(out, 4, "balm_rank")


# ---- ranking ----------------------------------------------------------------------------------------------------

SCORERS = f"k AS (SELECT distance, unnest(['model', 'neighbours', 'plane']) AS scorer, unnest([score, coalesce(knn, {INF}), coalesce(quality, {INF})]) AS score FROM j)"
AUC = """c AS (SELECT {by}, tau, score, count(*) FILTER (WHERE distance > tau) AS pos, count(*) FILTER (WHERE NOT distance > tau) AS neg FROM {source}, (SELECT unnest([0.02, 0.05])::DOUBLE AS tau) t GROUP BY ALL),
w AS (SELECT *, sum(pos) OVER v AS tp, sum(neg) OVER v AS fp FROM c WINDOW v AS (PARTITION BY {by}, tau ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
a AS (SELECT {by}, tau, sum(pos) AS pos, sum(neg) AS neg, sum(neg * (tp - pos / 2)) / nullif(sum(pos) * sum(neg), 0) AS auc, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * tp / (tp + fp)) / sum(pos) END AS ap FROM w GROUP BY ALL)"""


def _scorers() -> dict:
    return {"model": F.col("score"), "neighbours": F.col("knn"), "plane": F.col("quality")}


RANKING = f"""WITH {JUDGED}, {SCORERS}, {AUC.format(by='scorer', source='k')}, r AS (SELECT scorer, rank() OVER (PARTITION BY scorer ORDER BY score) + (count(*) OVER (PARTITION BY scorer, score) - 1) / 2.0 AS x, rank() OVER (PARTITION BY scorer ORDER BY distance) + (count(*) OVER (PARTITION BY scorer, distance) - 1) / 2.0 AS y FROM k),
rho AS (SELECT scorer, corr(x, y) AS rho FROM r GROUP BY scorer), l AS (SELECT *, (ap - pos / (pos + neg)) / (1 - pos / (pos + neg)) AS lift FROM a WHERE ap IS NOT NULL)
SELECT tau, scorer, round(ap, 6) AS ap, round(lift, 6) AS lift, round(auc, 6) AS auc, round(rho, 6) AS rho, row_number() OVER (PARTITION BY tau ORDER BY lift DESC, scorer DESC) AS place FROM l JOIN rho USING (scorer)"""


@query(RANKING)
def method_ranking(spark, d):
    """Scorers by lift at every threshold."""
    return rounded(metrics.ranking(judged(spark, d), _scorers(), [0.02, 0.05]), 6, "ap", "lift", "auc", "rho")


@query(f"SELECT CAST(tau AS DOUBLE) AS tau, place, scorer, lift, auc FROM ({RANKING})")
def ranking_text(spark, d):
    """K5: the ranking as a text table, read again."""
    from pointspark.sources.text import write_ranking

    path = f"{scratch(spark)}/ranking.txt"
    write_ranking(method_ranking(spark, d), path, "scorers of the labelled cloud")
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\n\n")).alias("block")).where(F.col("block").startswith("tau"))
    rows = lines.select(F.regexp_extract("block", r"tau = (\S+)", 1).cast("double").alias("tau"), F.explode(F.split("block", r"\n")).alias("line"))
    p = F.split(F.trim("line"), r"\s+")
    return rows.where(F.col("line").rlike(r"^ *\d+ ")).select("tau", p[0].cast("long").alias("place"), p[1].alias("scorer"), p[3].cast("double").alias("lift"), p[4].cast("double").alias("auc"))


@query(f"""WITH {JUDGED}, {AUC.format(by='scene', source='j')}, n AS (SELECT scene, count(*) AS n FROM j GROUP BY scene) SELECT a.scene, CASE WHEN a.scene = (SELECT min(scene) FROM j) THEN 'held out' ELSE 'fitted on' END AS role, n, tau, round(auc, 6) AS auc FROM a JOIN n ON n.scene = a.scene""")
def breakdown_by_role(spark, d):
    """M14."""
    j = judged(spark, d)
    held = [j.agg(F.min("scene")).first()[0]]
    return rounded(metrics.by_role(j, "scene", held, [0.02, 0.05]), 6, "auc")


@query(f"""WITH {LABELLED}, l AS (SELECT distance, 'classical_' || unnest(['knn', 'balm', 'quality']) AS scorer, unnest([knn, balm, quality]) AS score FROM lab), c AS (SELECT scorer, score, count(*) FILTER (WHERE distance > 0.05) AS pos, count(*) FILTER (WHERE NOT distance > 0.05) AS neg FROM l WHERE score IS NOT NULL GROUP BY ALL),
w AS (SELECT *, sum(pos) OVER v AS tp, sum(neg) OVER v AS fp FROM c WINDOW v AS (PARTITION BY scorer ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT scorer, CAST(sum(pos) AS BIGINT) AS pos, round(sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)), 6) AS auc, round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS ap FROM w GROUP BY scorer""")
def classical_baselines(spark, d):
    """Single statistics as scorers."""
    b = metrics.baselines(labelled(spark, d), [], {c: F.col(c) for c in ("knn", "balm", "quality")}, TAU)
    return rounded(b.select("scorer", "pos", "auc", "ap"), 6, "auc", "ap")


@query(f"""WITH {JUDGED}, b AS (SELECT point_id, distance, 'model' AS scorer, score FROM j UNION ALL SELECT point_id, distance, 'sor', coalesce(knn, {INF}) FROM j),
r AS (SELECT scorer, distance, row_number() OVER (PARTITION BY scorer ORDER BY score, point_id) AS rn, count(*) OVER (PARTITION BY scorer) AS n FROM b), f AS (SELECT round(unnest(range(26)) * 0.02, 2) AS budget),
k AS (SELECT scorer, budget, n, greatest(round_even(n * (1 - budget), 0), 1) AS keep, distance FROM r, f WHERE rn <= greatest(round_even(n * (1 - budget), 0), 1)), a AS (SELECT scorer, 1 - keep / n AS removed, avg(distance) AS m FROM k GROUP BY scorer, budget, n, keep),
w AS (SELECT scorer, CAST(fraction AS DOUBLE) AS fraction, arg_min(removed, (round(abs(removed - fraction), 9), removed)) AS removed, arg_min(m, (round(abs(removed - fraction), 9), removed)) AS m FROM a, (SELECT unnest([0.05, 0.10, 0.20, 0.30]) AS fraction) q GROUP BY scorer, fraction)
SELECT w.scorer, w.fraction, round(w.removed, 6) AS removed, round(w.m, 5) AS mean_c2c, round((w.m - s.m) / s.m * 100, 3) + 0 AS change_percent FROM w JOIN w s ON s.scorer = 'sor' AND s.fraction = w.fraction""")
def headline_change(spark, d):
    """Change of the mean against the baseline at the realised budgets."""
    j = judged(spark, d).select("point_id", "score", "distance", "knn")
    both = j.withColumn("scorer", F.lit("model")).unionByName(j.withColumns({"score": F.coalesce("knn", F.lit(float("inf"))), "scorer": F.lit("sor")}))
    h = metrics.headline(metrics.budget_curve(both, ["scorer"], "point_id", TAU), [], "scorer", "sor", [0.05, 0.10, 0.20, 0.30])
    return h.select("scorer", "fraction", F.round("removed", 6).alias("removed"), F.round("mean_c2c", 5).alias("mean_c2c"), (F.round("change_percent", 3) + 0).alias("change_percent"))


HEX = "sqrt(3.0)"


@query(f"""WITH {JUDGED}, h AS (SELECT ({HEX} / 3 * score - distance / 3) * 2 / 0.02 * {HEX} / 2 AS a, distance * 2 / 3 * 2 / 0.02 * {HEX} / 2 AS b FROM j WHERE isfinite(score)), e AS (SELECT a, b, -a - b AS c, floor(a + 0.5) AS na, floor(b + 0.5) AS nb, floor(-a - b + 0.5) AS nc FROM h)
SELECT CAST(CASE WHEN abs(na - a) > abs(nb - b) AND abs(na - a) > abs(nc - c) THEN -nb - nc ELSE na END AS BIGINT) AS q, CAST(CASE WHEN NOT (abs(na - a) > abs(nb - b) AND abs(na - a) > abs(nc - c)) AND abs(nb - b) > abs(nc - c) THEN -na - nc ELSE nb END AS BIGINT) AS r, count(*) AS n FROM e GROUP BY ALL""")
def hexbins(spark, d):
    """Predicted against true distance."""
    return metrics.hexbins(judged(spark, d), finite("score"), F.col("distance"), 0.02)


# ---- models -----------------------------------------------------------------------------------------------------


@query("""SELECT * FROM (VALUES ('a planted channel is the most important', true), ('its bucket is the most important', true), ('the mean model beats the mean', true), ('the 0.9 quantile covers 0.85 to 0.95', true), ('rounds stop early', true), ('a bundle scores the same', true),
('the best features alone explain it', true), ('one pass scores every model', true)) v(property, holds)""")
def model_properties(spark, d):
    """Properties of models fitted on the labelled cloud with a target made of two of its channels."""
    o = table(spark, d, "outlier_analysis").groupBy("point_id").agg(*[F.min(present(c)).alias(c) for c in ("balm_res", "range", "plane_quality", "view_diversity", "mean_knn_dist", "ang_rate")])
    noise = (F.pmod(F.xxhash64("point_id"), F.lit(1000)) - 500) / 2000
    target = F.log1p(F.abs(F.coalesce("range", F.lit(0.0)))) + 0.1 * F.log1p(F.abs(F.coalesce("balm_res", F.lit(0.0)))) + noise
    rows = cut(model.split_groups(o.withColumn("C2C_distance", target), F.col("point_id"), 0.2))
    fs = ["balm_res", "range", "plane_quality", "view_diversity", "mean_knn_dist", "ang_rate"]
    mean, high = (model.fit(rows, fs, "C2C_distance", "point_id", k) for k in ("mean", "q90"))
    x, y, held = model.training_sample(rows, fs, "C2C_distance", "point_id")
    gain = model.permutation_importance(mean, fs, x[held], y[held])
    buckets = model.importance_buckets(fs)
    by_bucket = model.permutation_importance(mean, fs, x[held], y[held], buckets)
    small = model.top_arms(gain, (2,))["top2"]
    slim = model.fit(rows, small, "C2C_distance", "point_id")
    path = scratch(spark)
    model.save(path, mean, fs, {"arm": "slam_plus"})
    again, names, _ = model.load(path)
    scored = model.score(rows, {"mean": (mean, fs), "high": (high, fs)}).agg(F.avg((F.col("C2C_distance") < F.col("high")).cast("double")).alias("c"), F.count("mean").alias("n"), F.count("*").alias("all")).first()
    error = lambda m, cols: np.mean((y[held] - m.predict(x[held][:, [fs.index(c) for c in cols]])) ** 2)
    out = [
        ("a planted channel is the most important", max(gain, key=gain.get) == "range"),
        ("its bucket is the most important", max(by_bucket, key=by_bucket.get) == "A"),
        ("the mean model beats the mean", error(mean, fs) < 0.5 * np.var(y[held])),
        ("the 0.9 quantile covers 0.85 to 0.95", 0.85 <= scored["c"] <= 0.95),
        ("rounds stop early", 0 < len(mean.trees) < 300),
        ("a bundle scores the same", names == fs and np.array_equal(again.predict(x), mean.predict(x))),
        ("the best features alone explain it", error(slim, small) < 0.5 * np.var(y[held])),
        ("one pass scores every model", scored["n"] == scored["all"]),
    ]
    return spark.createDataFrame([(a, bool(b)) for a, b in out], "property string, holds boolean")


# ---- rules that follow a session scan by scan -------------------------------------------------------------------


@query(f"""WITH RECURSIVE {TRAJ}, r AS (SELECT cloud_id, scan_id, t, t + 0.5 AS e, row_number() OVER (PARTITION BY cloud_id ORDER BY scan_id) AS i FROM poses WHERE sane),
w AS (SELECT cloud_id, scan_id, i, true AS keep, e AS last FROM r WHERE i = 1 UNION ALL SELECT r.cloud_id, r.scan_id, r.i, NOT w.last - r.t > 0.010, CASE WHEN NOT w.last - r.t > 0.010 THEN r.e ELSE w.last END FROM w JOIN r ON r.cloud_id = w.cloud_id AND r.i = w.i + 1)
SELECT cloud_id, scan_id FROM w WHERE keep""")
def late_sweeps_dropped(spark, d):
    """Sweeps that begin before the end of the last one that was kept are dropped."""
    p = poses(spark, d).where("sane").select("cloud_id", "scan_id", "t", (F.col("t") + 0.5).alias("t_end"))
    return sessions.drop_late(p, "cloud_id", "t", "t_end", "scan_id").select("cloud_id", "scan_id")


RESET = """r AS (SELECT cloud_id, scan_id, degenerate, row_number() OVER (PARTITION BY cloud_id ORDER BY scan_id) AS i FROM s),
w AS (SELECT cloud_id, scan_id, i, CASE WHEN degenerate THEN 1 ELSE 0 END AS run, 0 AS session, 1 AS place FROM r WHERE i = 1
UNION ALL SELECT r.cloud_id, r.scan_id, r.i, CASE WHEN NOT r.degenerate THEN 0 WHEN w.run > {bound} THEN 1 ELSE w.run + 1 END, CASE WHEN w.run > {bound} THEN w.session + 1 ELSE w.session END, CASE WHEN w.run > {bound} THEN 1 ELSE w.place + 1 END FROM w JOIN r ON r.cloud_id = w.cloud_id AND r.i = w.i + 1)"""


def _degenerate(spark: SparkSession, d: str) -> DataFrame:
    return poses(spark, d).select("cloud_id", "scan_id", F.coalesce(finite("ang_rate") > 0.2, F.lit(True)).alias("degenerate"))


DEGENERATE = f"{TRAJ}, g AS (SELECT cloud_id, scan_id, arg_min(row(ang_rate)::STRUCT(a FLOAT), (received_at, coalesce(t, 0), coalesce(x, 0), coalesce(y, 0), coalesce(z, 0))).a AS a FROM trajectory GROUP BY ALL), s AS (SELECT cloud_id, scan_id, coalesce({fin('a')} > 0.2, true) AS degenerate FROM g)"


@query(f"WITH RECURSIVE {DEGENERATE}, {RESET.format(bound=1)} SELECT cloud_id, scan_id, session, place > 2 AS saved FROM w")
def session_reset(spark, d):
    """More than one degenerate scan in a row ends a session; its first two scans aren't saved."""
    return sessions.reset_sessions(_degenerate(spark, d), "cloud_id", "scan_id", "degenerate", 1, 2).select("cloud_id", "scan_id", "session", "saved")


@query(f"WITH RECURSIVE {DEGENERATE}, {RESET.format(bound=3)} SELECT cloud_id AS stream, scan_id, CAST(session AS BIGINT) AS session, place > 2 AS saved FROM w")
def sessions_reset_stream(spark, d):
    """The same rule as keyed state of a stream."""
    path = scratch(spark)
    _degenerate(spark, d).select(F.col("cloud_id").alias("stream"), "scan_id", "degenerate").write.parquet(path)
    return sessions.drained(sessions.reset_stream(sessions.files_stream(spark, path)), "append", keyed=True)


@query(f"""WITH RECURSIVE {TRAJ}, r AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY scan_id) AS i FROM poses WHERE sane), k AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY i) AS j FROM r WHERE i % 10 = 0),
w AS (SELECT cloud_id, scan_id, j, true AS keep, x AS lx, y AS ly, z AS lz, qx AS la, qy AS lb, qz AS lc, qw AS lw FROM k WHERE j = 1
UNION ALL SELECT k.cloud_id, k.scan_id, k.j, v.far, CASE WHEN v.far THEN k.x ELSE lx END, CASE WHEN v.far THEN k.y ELSE ly END, CASE WHEN v.far THEN k.z ELSE lz END, CASE WHEN v.far THEN k.qx ELSE la END, CASE WHEN v.far THEN k.qy ELSE lb END, CASE WHEN v.far THEN k.qz ELSE lc END, CASE WHEN v.far THEN k.qw ELSE lw END
FROM w JOIN k ON k.cloud_id = w.cloud_id AND k.j = w.j + 1, LATERAL (SELECT NOT (sqrt(power(k.x - lx, 2) + power(k.y - ly, 2) + power(k.z - lz, 2)) < 0.1 AND degrees(2 * acos(least(1.0, abs(k.qx*la + k.qy*lb + k.qz*lc + k.qw*lw) / greatest(sqrt(k.qx*k.qx+k.qy*k.qy+k.qz*k.qz+k.qw*k.qw) * sqrt(la*la+lb*lb+lc*lc+lw*lw), 1e-12)))) < 5.0) AS far) v)
SELECT cloud_id, scan_id FROM w WHERE keep""")
def session_keyframes(spark, d):
    """W9."""
    return sessions.session_keyframes(poses(spark, d).where("sane").select("cloud_id", "scan_id", "x", "y", "z", "qx", "qy", "qz", "qw"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 21600000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, s HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT to_timestamp(floor(epoch_us(max(ts)) / 1000) / 1000.0)::TIMESTAMP FROM events)""")
def sessions_stream(spark, d):
    """Sessions by inactivity as a stream: those that its last watermark has closed."""
    path = scratch(spark)
    table(spark, d, "events").select("user_id", "ts").write.parquet(path)
    s = sessions.drained(sessions.sessions_stream(sessions.files_stream(spark, path), "user_id", "ts", "6 hours"), "append")
    return s.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("""SELECT a.user_id, a.event_id AS sweep, count(*) AS samples FROM events a JOIN events b ON a.event_type = 'view' AND b.event_type <> 'view' AND b.user_id = a.user_id AND b.ts > a.ts - INTERVAL 30 HOUR AND b.ts <= a.ts GROUP BY ALL HAVING count(*) >= 2""")
def sweeps_with_samples(spark, d):
    """A stream-stream interval join of sweeps with their samples; enough samples make a sweep usable."""
    a, b = scratch(spark), scratch(spark)
    e = table(spark, d, "events")
    e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("sweep"), (F.col("ts") - F.expr("INTERVAL 30 HOURS")).alias("begin"), F.col("ts").alias("finish")).write.parquet(a)
    e.where("event_type <> 'view'").select("user_id", "event_id", F.col("ts").alias("at")).write.parquet(b)
    j = sessions.sync_samples(sessions.files_stream(spark, a), sessions.files_stream(spark, b), "user_id", "begin", "finish", "at", longest="30 hours")
    return sessions.enough_samples(sessions.drained(j, "append"), ["user_id", "sweep"], 2)


@query(f"""WITH {TRAJ}, {QUAT}, v AS (SELECT DISTINCT pt_id, scan_id, x, y, z FROM pcd WHERE {XYZ_OK}), g AS (SELECT pt_id, CAST(scan_id AS DOUBLE) AS path, {WX} AS x, {WY} AS y, {WZ} AS z FROM v JOIN q USING (scan_id)), c AS (SELECT path, {cells(40.0)}, x FROM g),
b AS (SELECT *, CASE WHEN path - lag(path) OVER w > 20.5 THEN 1 ELSE 0 END AS new FROM c WINDOW w AS (PARTITION BY ix, iy, iz ORDER BY path)), e AS (SELECT *, sum(new) OVER (PARTITION BY ix, iy, iz ORDER BY path) AS episode FROM b),
s AS (SELECT ix, iy, iz, episode, count(*) AS n, avg(x) AS cx, max(path) AS seen FROM e GROUP BY ALL), l AS (SELECT *, episode = max(episode) OVER (PARTITION BY ix, iy, iz) AS newest, (SELECT max(path) FROM c) AS head FROM s)
SELECT ix, iy, iz, n, round(cx, 4) AS cx FROM l WHERE NOT newest OR seen + 20.5 <= head""")
def map_state_stream(spark, d):
    """Voxels as keyed state, closed when they come back too late and evicted when they never do."""
    pts = grid.located(table(spark, d, "pcd")).select("pt_id", "scan_id", "x", "y", "z").distinct()
    rows = cut(merge.to_world(pts, poses(spark, d)).select("x", "y", "z", F.col("scan_id").cast("double").alias("path")))
    path = scratch(spark)
    half = rows.agg(F.avg("path")).first()[0]
    for part in ((F.col("path") <= half), (F.col("path") > half)):  # two batches, in the order of the path
        rows.where(part).coalesce(1).write.mode("append").parquet(path)
    closed = sessions.drained(sessions.map_stream(sessions.files_stream(spark, path, 1), 40.0, 20.5), "append", keyed=True).where("not open")
    return closed.select("ix", "iy", "iz", "n", F.round("cx", 4).alias("cx"))
