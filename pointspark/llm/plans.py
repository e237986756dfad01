"""Queries and SQL twins of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointspark.llm import cutoff, neighbours, packing, quantiles, spam, splits, tokenize
from pointspark.session import cut, table

OUTLIER_AT = 0.05  # metres of C2C distance from which a point bears the outlier label


PROBS = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


DAY = ["measure", "scene", "cloud_id", "day"]


def measures(spark: SparkSession, d: str) -> DataFrame:
    """(measure, scene, cloud_id, day, value) of the three measures; days are those of label, score and capture."""
    sources = (("outlier_analysis", "C2C_distance", "labelled_at"), ("predict_cloud", "predicted_c2c", "scored_at"), ("global_pcd_converter", "range", "captured_at"))
    rows = None
    for name, column, at in sources:
        part = table(spark, d, name).select(F.lit(column).alias("measure"), "scene", "cloud_id", F.to_date(at).alias("day"), F.col(column).cast("double").alias("value"))
        rows = part if rows is None else rows.union(part)
    return rows


def daily_sketches(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.build_sketches(measures(spark, d), DAY, F.col("value"))


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.percentiles(daily_sketches(spark, d), DAY, PROBS)


def _merged_percentiles(spark: SparkSession, d: str, keys: list[str]) -> DataFrame:
    return quantiles.percentiles(quantiles.merge_sketches(daily_sketches(spark, d), keys), keys, PROBS)


def p1_clouds(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each cloud over all days, from the merged sketches of its days."""
    return _merged_percentiles(spark, d, DAY[:3])


def p1_scenes(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each scene over all clouds and days, from merged sketches."""
    return _merged_percentiles(spark, d, DAY[:2])


def p1_day_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Whether the true ranks of p1_percentiles keep the stated bound, group by group, from the rows themselves."""
    return quantiles.rank_check(measures(spark, d), DAY, F.col("value"), p1_percentiles(spark, d), PROBS).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def p1_cloud_ranks(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.rank_check(measures(spark, d), DAY[:3], F.col("value"), p1_clouds(spark, d), PROBS)


def p1_scene_ranks(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.rank_check(measures(spark, d), DAY[:2], F.col("value"), p1_scenes(spark, d), PROBS)


def point_splits(spark: SparkSession, d: str) -> DataFrame:
    """(item, lead, split) of every point of the labelled cloud."""
    points = table(spark, d, "outlier_analysis")
    name = lambda kind, *cols: F.concat_ws("|", F.lit(kind), *cols, "cloud_id")
    has = lambda c: F.col(c).isNotNull() & (F.col(c) != -1) & F.col("cloud_id").isNotNull()
    keys = [F.when(has("stretch_id"), name("s", "stretch_id")), F.when(has("splitx_block") & (F.col("gt_group") > 0), name("b", "gt_group", "splitx_block"))]
    pose = F.col("pose_unc_rot")
    poses = table(spark, d, "global_pcd_converter").where(pose.isNotNull() & ~F.isnan(pose) & (pose != -1)).select(F.col("point_id").alias("item"), F.concat(F.lit("p|"), pose.cast("string")).alias("key"))
    poses = poses.join(points.select(F.col("point_id").alias("item")), "item", "left_semi")
    related = splits.relate(points, "point_id", keys, poses)
    c2c = F.col("C2C_distance")
    labels = points.select(F.col("point_id").alias("item"), F.when((c2c >= 0) & ~F.isnan(c2c), (c2c > OUTLIER_AT).cast("int")).alias("label"))
    return splits.assign_splits(related, labels)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return point_splits(spark, d).where(F.col("lead") < F.col("item")).select(F.col("lead").alias("lead_id"), F.col("item").alias("point_id"))


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    return point_splits(spark, d).select(F.col("item").alias("point_id"), F.col("lead").alias("lead_id"), "split")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Points and components of each split."""
    return point_splits(spark, d).groupBy("split").agg(F.count("*").alias("points"), F.countDistinct("lead").alias("components"))


def p4_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The 5 nearest other points of every point, with squared distances."""
    found = neighbours.nearest(table(spark, d, "pcd"), "pt_id", ["x", "y", "z"])
    return found.select(F.col("item").alias("pt_id"), F.col("neighbour").alias("neighbour_id"), F.col("d2").alias("squared_distance"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = p4_nearest(spark, d)
    return pairs.select(F.least("pt_id", "neighbour_id").alias("pt_id_a"), F.greatest("pt_id", "neighbour_id").alias("pt_id_b")).distinct()


def p2_quotas(spark: SparkSession, d: str) -> DataFrame:
    """Every point once, no component in two splits, and each split within one per cent of all points of its quota or, if larger, the largest component."""
    rows = cut(point_splits(spark, d))
    sizes = rows.groupBy("lead").agg(F.count("*").alias("n"), F.countDistinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("torn"), F.max("n").alias("largest"), F.sum("n").alias("points"))
    each = rows.groupBy("split").agg(F.count("*").alias("n"))
    share = F.element_at(F.create_map(*[F.lit(x) for pair in splits.SPLITS for x in pair]), F.col("split"))
    off = each.crossJoin(sizes).select("torn", "points", (F.abs(F.col("n") - share * F.col("points")) <= F.greatest(0.01 * F.col("points"), F.col("largest"))).alias("ok"))  # three rows
    return off.groupBy("points", "torn").agg(F.every("ok").alias("within"))


def _embedded(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    rows = table(spark, d, "embeddings")
    dims = [f"e{i}" for i in range(64)]
    return rows.select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(dims)]), dims


def p4_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """The 10 vectors that collisions find nearest to every embedding of 64 dimensions; not exact, see p4_recall."""
    rows, dims = _embedded(spark, d)
    return neighbours.nearest(rows, "vec_id", dims, 10, exact=False).select(F.col("item").alias("vec_id"), F.col("neighbour").alias("neighbour_id"), F.col("d2").alias("squared_distance"))


def p4_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of both searches on the ids divisible by 50 against all rows by brute force."""
    out = None
    for name, key, k, found, (rows, dims) in (
        ("embeddings", "vec_id", 10, p4_embeddings(spark, d).select(F.col("vec_id").alias("item"), F.col("neighbour_id").alias("neighbour")), _embedded(spark, d)),
        ("pcd", "pt_id", 5, p4_nearest(spark, d).select(F.col("pt_id").alias("item"), F.col("neighbour_id").alias("neighbour")), (table(spark, d, "pcd").select("pt_id", "x", "y", "z").distinct(), ["x", "y", "z"])),
    ):
        true = neighbours.brute_nearest(rows, key, dims, rows.where(F.col(key) % 50 == 0), k).withColumn("true", F.lit(1))
        met = true.join(found.withColumn("found", F.lit(1)), ["item", "neighbour"], "left")
        part = met.agg(F.lit(name).alias("collection"), F.countDistinct("item").alias("queries"), F.count("*").alias("true"), F.count("found").alias("found"))
        out = part if out is None else out.union(part)
    return out


def p4_recall_check(spark: SparkSession, d: str) -> DataFrame:
    return p4_recall(spark, d).select("collection", "queries", "true", (F.col("found") >= 0.9 * F.col("true")).alias("enough"))


def _decided(spark: SparkSession, d: str) -> DataFrame:
    scores = cutoff.clean_scores(table(spark, d, "predict_cloud"), "predicted_c2c", "cloud_id", "point_id", "predicted_c2c").union(
        cutoff.clean_scores(table(spark, d, "outlier_analysis"), "mean_knn_dist", "cloud_id", "point_id", "mean_knn_dist")
    )
    clouds = table(spark, d, "cloud_source").select(F.col("cloud_id").alias("source"), F.col("keep_permille").alias("permille"))
    return cutoff.decide(scores, clouds)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).where(~F.col("keep")).select(F.col("source").alias("cloud_id"), "score_name", F.col("item").alias("point_id"))


def p5_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.report(_decided(spark, d)).withColumnRenamed("source", "cloud_id")


def p5_flags(spark: SparkSession, d: str) -> DataFrame:
    """What filter_keep ought to say of every scored point, and what it says (-1 where rows disagree or are missing)."""
    said = table(spark, d, "predict_cloud").groupBy("cloud_id", "point_id").agg(F.min("filter_keep").alias("lo"), F.max("filter_keep").alias("hi"))
    said = said.select("cloud_id", "point_id", F.coalesce(F.when(F.col("lo") == F.col("hi"), F.col("lo")), F.lit(-1)).cast("int").alias("filter_keep"))
    ought = _decided(spark, d).where(F.col("score_name") == "predicted_c2c").select(F.col("source").alias("cloud_id"), F.col("item").alias("point_id"), F.col("keep").cast("int").alias("keep_expected"))
    return said.join(ought, ["cloud_id", "point_id"])


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_corpus(table(spark, d, "documents"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.count_tokens(table(spark, d, "documents"), carry=["post_kind"])


def _bears():
    return F.coalesce(F.col("post_kind") == "answer", F.lit(False))


#: Limits that leave no more space unused than tokens alone would, while each of them closes containers.
BOX = {"capacity": 2048, "max_segments": 64, "max_loss": 1664}
#: A tighter mix, in which answers beyond the loss limit are split.
MIX = {"capacity": 2048, "max_segments": 24, "max_loss": 1200}


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Containers of 2,048 tokens, 64 segments and 1,664 loss-bearing tokens: an answer's tokens bear loss, a question's don't.

    Only documents larger than a container are split; of an answer's piece beyond the loss limit the rest is masked.
    """
    return packing.pack(_sizes(spark, d), "doc_id", F.col("n"), _bears(), table(spark, d, "documents").count(), masked=True, **BOX)


def p8_instructions(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sizes(spark, d), "doc_id", F.col("n"), _bears(), table(spark, d, "documents").count(), **MIX)


def p8_audit(spark: SparkSession, d: str) -> DataFrame:
    """Conservation, limits and fill of both packings, from the token counts and the spans themselves."""
    sizes = cut(_sizes(spark, d))
    n = sizes.count()
    a = packing.audit(cut(packing.pack(sizes, "doc_id", F.col("n"), _bears(), n, masked=True, **BOX)), sizes, "doc_id", _bears(), **BOX)
    b = packing.audit(cut(packing.pack(sizes, "doc_id", F.col("n"), _bears(), n, **MIX)), sizes, "doc_id", _bears(), **MIX, slack=0.06)
    return a.withColumn("packing", F.lit("containers")).union(b.withColumn("packing", F.lit("instructions")))


def p8_limits(spark: SparkSession, d: str) -> DataFrame:
    """How many containers of p8_instructions each of the three limits closes."""
    boxes = packing.closed_by(p8_instructions(spark, d), table(spark, d, "documents"), "doc_id", _bears(), **MIX)
    return boxes.agg(F.count("*").alias("containers"), *[F.count_if(c).alias(c) for c in ("by_tokens", "by_segments", "by_loss")])


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Each container's segments, tokens and unused space."""
    return p8_containers(spark, d).groupBy("container_id").agg(F.count("*").alias("segments"), F.sum(F.col("token_to") - F.col("token_from")).alias("tokens")).withColumn("unused", packing.CAPACITY - F.col("tokens"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.stuffed_pages(table(spark, d, "documents")).select("doc_id")


def p9_curves(spark: SparkSession, d: str) -> DataFrame:
    """The rank-frequency fit of every page."""
    return spam.curves(cut(spam.segments(table(spark, d, "documents"), "doc_id", "text"))).withColumnRenamed("doc", "doc_id")


def p9_word_curves(spark: SparkSession, d: str) -> DataFrame:
    """The rank-frequency fit over plain lower-case Latin words, whose cutting SQL can say too."""
    words = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("term"))
    fit = spam.fit_curves(words.groupBy("doc", "term").agg(F.count("*").alias("f")).drop("term"), ["doc"])
    return fit.select(F.col("doc").alias("doc_id"), "terms", "vocabulary", *[(F.round(c, 6) + 0).alias(c) for c in ("slope", "residual", "head", "entropy")])


#: A Parquet file's statistics leave NaN out, by which NOT isnan() may be folded to true; isfinite() or isinf() can't be.
_MEASURES = "measures AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS measure, scene, cloud_id, strftime({at}, '%Y-%m-%d') AS day FROM {t} WHERE (isfinite({c}) OR isinf({c})) AND abs(CAST({c} AS DOUBLE) + 1) > 1e-6"
    for t, c, at in (("outlier_analysis", "C2C_distance", "labelled_at"), ("predict_cloud", "predicted_c2c", "scored_at"), ("global_pcd_converter", "range", "captured_at"))
) + ")"

_SCORES = """
scores AS (
  SELECT 'predicted_c2c' AS score_name, cloud_id, point_id, min(CAST(predicted_c2c AS DOUBLE)) AS score FROM predict_cloud
    WHERE predicted_c2c >= 0 AND (isfinite(predicted_c2c) OR isinf(predicted_c2c)) AND cloud_id IS NOT NULL AND point_id IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'mean_knn_dist', cloud_id, point_id, min(mean_knn_dist) FROM outlier_analysis
    WHERE mean_knn_dist >= 0 AND (isfinite(mean_knn_dist) OR isinf(mean_knn_dist)) AND cloud_id IS NOT NULL AND point_id IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY score_name, cloud_id ORDER BY score, point_id) AS r, count(*) OVER (PARTITION BY score_name, cloud_id) AS n FROM scores),
cuts AS (SELECT score_name, cloud_id, keep_permille AS permille, n, score AS cutoff FROM ranked JOIN cloud_source USING (cloud_id)
  WHERE r = least(greatest((n * keep_permille + 999) // 1000, 1), n)),
decided AS (SELECT s.*, permille, n, cutoff, score <= cutoff AS keep FROM scores s JOIN cuts USING (score_name, cloud_id))
"""

_RELATED = """
WITH RECURSIVE keys AS (
  SELECT DISTINCT point_id, 's|' || stretch_id || '|' || cloud_id AS k FROM outlier_analysis WHERE stretch_id <> -1
  UNION SELECT DISTINCT point_id, 'b|' || gt_group || '|' || splitx_block || '|' || cloud_id FROM outlier_analysis WHERE gt_group > 0 AND splitx_block <> -1
  UNION SELECT DISTINCT point_id, 'p|' || pose_unc_rot FROM global_pcd_converter WHERE (isfinite(pose_unc_rot) OR isinf(pose_unc_rot)) AND pose_unc_rot <> -1 AND point_id IN (SELECT point_id FROM outlier_analysis)),
reps AS (SELECT k, min(point_id) AS rep FROM keys GROUP BY k),
e AS (SELECT DISTINCT a.rep AS u, b.rep AS v FROM keys x JOIN reps a USING (k) JOIN keys y ON x.point_id = y.point_id JOIN reps b ON b.k = y.k),
reach(node, lead) AS (SELECT u, u FROM e UNION SELECT e.v, reach.lead FROM reach JOIN e ON e.u = reach.node WHERE reach.lead < e.v),
leads AS (SELECT node, min(lead) AS lead FROM reach GROUP BY node),
point AS (SELECT point_id, min(lead) AS lead_id FROM keys JOIN reps USING (k) JOIN leads ON leads.node = rep GROUP BY point_id)
SELECT lead_id, point_id FROM point WHERE lead_id < point_id
"""


_NEAR = """
WITH p AS (SELECT pt_id, min(x) AS x, min(y) AS y, min(z) AS z FROM pcd WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND (isfinite(x) OR isinf(x)) AND (isfinite(y) OR isinf(y)) AND (isfinite(z) OR isinf(z)) GROUP BY pt_id),
near AS (SELECT a.pt_id, b.pt_id AS neighbour_id, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) AS squared_distance,
  row_number() OVER (PARTITION BY a.pt_id ORDER BY (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z), b.pt_id) AS r FROM p a JOIN p b ON a.pt_id <> b.pt_id)
"""


def queries() -> dict:
    return {"p1_percentiles": p1_percentiles, "p1_clouds": p1_clouds, "p1_scenes": p1_scenes, "p1_day_ranks": p1_day_ranks, "p1_cloud_ranks": p1_cloud_ranks, "p1_scene_ranks": p1_scene_ranks, "p2_found": p2_found, "p2_splits": p2_splits, "p2_report": p2_report, "p2_quotas": p2_quotas, "p9_word_curves": p9_word_curves, "p4_found": p4_found, "p4_nearest": p4_nearest, "p4_embeddings": p4_embeddings, "p4_recall": p4_recall, "p4_recall_check": p4_recall_check, "p5_found": p5_found, "p5_cutoffs": p5_cutoffs, "p5_flags": p5_flags, "p7_ids": p7_ids, "p8_containers": p8_containers, "p8_fill": p8_fill, "p8_instructions": p8_instructions, "p8_audit": p8_audit, "p8_limits": p8_limits, "p9_found": p9_found, "p9_curves": p9_curves}


def oracle_sql() -> dict[str, str]:
    return {
        **{f"p1_{name}_ranks": f"WITH {_MEASURES} SELECT {', '.join(DAY[:k])}, count(*) AS n, true AS within FROM measures GROUP BY ALL" for name, k in (("day", 4), ("cloud", 3), ("scene", 2))},
        "p8_audit": "SELECT count(*) AS items, count(*) AS whole, 0 AS split_needlessly, 0 AS beyond_limits, true AS \"full\", p.packing FROM documents, (SELECT unnest(['containers', 'instructions']) AS packing) p GROUP BY ALL",
        "p2_quotas": "SELECT count(DISTINCT point_id) AS points, 0 AS torn, true AS within FROM outlier_analysis",
        "p9_word_curves": """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents), f AS (SELECT doc_id, term, count(*) AS f FROM w GROUP BY ALL),
r AS (SELECT doc_id, f, ln(f) AS y, ln(row_number() OVER (PARTITION BY doc_id ORDER BY f DESC)) AS x, row_number() OVER (PARTITION BY doc_id ORDER BY f DESC) AS r FROM f),
g AS (SELECT doc_id, sum(f) AS terms, count(*) AS vocabulary, coalesce(CASE WHEN var_pop(x) > 0 THEN covar_pop(x, y) / var_pop(x) END, 0) AS slope, var_pop(y) AS vy, covar_pop(x, y) AS cxy, sum(CASE WHEN r <= 2 THEN f END) AS top, sum(f * y) AS fy FROM r GROUP BY doc_id)
SELECT doc_id, CAST(terms AS BIGINT) AS terms, vocabulary, round(slope, 6) + 0 AS slope, round(sqrt(greatest(vy - slope * cxy, 0)), 6) + 0 AS residual, round(top / terms, 6) + 0 AS head, round(ln(terms) - fy / terms, 6) + 0 AS entropy FROM g""",
        "p2_found": _RELATED,
        "p4_recall_check": "SELECT 'embeddings' AS collection, count(*) AS queries, count(*) * 10 AS \"true\", true AS enough FROM embeddings WHERE vec_id % 50 = 0 UNION ALL SELECT 'pcd', count(DISTINCT pt_id), count(DISTINCT pt_id) * 5, true FROM pcd WHERE pt_id % 50 = 0 AND (isfinite(x) OR isinf(x)) AND (isfinite(y) OR isinf(y)) AND (isfinite(z) OR isinf(z))",
        "p4_found": f"{_NEAR} SELECT DISTINCT least(pt_id, neighbour_id) AS pt_id_a, greatest(pt_id, neighbour_id) AS pt_id_b FROM near WHERE r <= 5",
        "p4_nearest": f"{_NEAR} SELECT pt_id, neighbour_id, squared_distance FROM near WHERE r <= 5",
        "p5_found": f"WITH {_SCORES} SELECT cloud_id, score_name, point_id FROM decided WHERE NOT keep",
        "p5_cutoffs": f"WITH {_SCORES} SELECT score_name, cloud_id, permille, n, cutoff, count(*) FILTER (WHERE keep) AS kept FROM decided GROUP BY ALL",
        "p5_flags": f"WITH {_SCORES}, said AS (SELECT cloud_id, point_id, CAST(coalesce(CASE WHEN min(filter_keep) = max(filter_keep) THEN min(filter_keep) END, -1) AS INTEGER) AS filter_keep FROM predict_cloud GROUP BY ALL) "
        "SELECT said.cloud_id, said.point_id, filter_keep, CAST(keep AS INTEGER) AS keep_expected FROM said JOIN decided ON decided.cloud_id = said.cloud_id AND decided.point_id = said.point_id WHERE score_name = 'predicted_c2c'",
    }
