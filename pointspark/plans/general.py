"""Queries of the general data-quality operators: load profiles and schema drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointspark.operators import drift, profile
from pointspark.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rules = profile.rules_from_table(table(spark, d, "channel_rule"))
    return profile.find_issues(profile.profile_loads(table(spark, d, "global_pcd_converter"), rules))


def p3_profile(spark: SparkSession, d: str) -> DataFrame:
    """Every column of the delivered cloud, with a rule where channel_rule has one."""
    clouds = table(spark, d, "global_pcd_converter")
    given = {r.column: r for r in profile.rules_from_table(table(spark, d, "channel_rule"))}
    columns = [c for c in clouds.columns if c not in ("feed_id", "load_id", "load_seq")]
    return profile.profile_loads(clouds, [given.get(c, profile.ColumnRule(c)) for c in columns], resolve=True)


def p3_columns(spark: SparkSession, d: str) -> DataFrame:
    """The figures of p3_profile that have a closed form: counts, distincts, ranges, broken rules and the exact largest gap."""
    rows = p3_profile(spark, d)
    return rows.select("load_id", "column_name", "rows", "missing", "distinct_values", "min_value", "max_value", "min_text", "max_text", "out_of_range", "off_pattern", "top_count", "rows_before", "missing_before", "distinct_before", F.round("largest_gap", 9).alias("largest_gap"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "cloud_file"), table(spark, d, "cloud_record"))


def p6_fields(spark: SparkSession, d: str) -> DataFrame:
    return drift.canonical_fields(table(spark, d, "cloud_file"), table(spark, d, "cloud_record"))


def _unified(stage: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        files, records = table(spark, d, "cloud_file"), table(spark, d, "cloud_record")
        return drift.unified_table(files, records, stage, drift.canonical_fields(files, records))

    return query


def p6_cells(spark: SparkSession, d: str) -> DataFrame:
    """Both unified tables, one row a given value: (stage, file_id, row_no, field, value)."""
    files, records = table(spark, d, "cloud_file"), table(spark, d, "cloud_record")
    canon, out = drift.canonical_fields(files, records), None
    for stage in ("pcd", "outlier_analysis"):
        rows = drift.unified_table(files, records, stage, canon)
        fields = [c for c in rows.columns if c not in ("series_id", "file_seq", "file_id", "row_no")]
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("double").alias("value")) for c in fields]))
        part = rows.select(F.lit(stage).alias("stage"), "file_id", "row_no", cells.alias("e")).select("stage", "file_id", "row_no", "e.*").where(F.col("value").isNotNull())
        out = part if out is None else out.union(part)
    return out


def queries() -> dict:
    return {"p6_cells": p6_cells, "p3_found": p3_found, "p3_profile": p3_profile, "p3_columns": p3_columns, "p6_found": p6_found, "p6_fields": p6_fields, "p6_table_pcd": _unified("pcd"), "p6_table_outlier_analysis": _unified("outlier_analysis")}


_P3_SQL = """
WITH rule AS (SELECT column_name, sentinel, lo, hi, coalesce(whole, false) AS whole, pattern FROM channel_rule),
nums AS (
  SELECT feed_id, load_id, load_seq, column_name, CAST(v AS DOUBLE) AS v, CAST(NULL AS VARCHAR) AS t FROM (
    SELECT feed_id, load_id, load_seq, unnest(['balm_res','ekf_res','plane_quality','obs_count','view_diversity','temp_consistency']) AS column_name,
      unnest([balm_res,ekf_res,plane_quality,obs_count,view_diversity,temp_consistency]) AS v FROM global_pcd_converter)
  UNION ALL SELECT feed_id, load_id, load_seq, 'scan_file', NULL, scan_file FROM global_pcd_converter),
vals AS (
  SELECT feed_id, load_id, load_seq, column_name, r.lo, r.hi, r.whole, r.pattern, t,
    CASE WHEN v IS NULL OR NOT (isfinite(v) OR isinf(v)) OR abs(v - r.sentinel) <= 1e-6 THEN NULL ELSE v END AS v,
    CASE WHEN column_name = 'scan_file' THEN t IS NOT NULL AND trim(t, ' ') <> '' ELSE NOT (v IS NULL OR NOT (isfinite(v) OR isinf(v)) OR coalesce(abs(v - r.sentinel) <= 1e-6, false)) END AS valid
  FROM nums JOIN rule r USING (column_name)),
stats AS (
  SELECT feed_id, load_id, load_seq, column_name, count(*) AS n, count(*) FILTER (WHERE valid) AS nv,
    count(DISTINCT CASE WHEN valid THEN coalesce(t, CAST(v AS VARCHAR)) END) AS dv,
    bool_or(valid AND t IS NULL AND (coalesce(v < lo, false) OR coalesce(v > hi, false))) AS bad_range,
    bool_or(valid AND CASE WHEN t IS NULL THEN whole AND NOT isinf(v) AND v <> floor(v) ELSE NOT regexp_full_match(t, pattern) END) AS bad_pattern
  FROM vals GROUP BY ALL),
loads AS (SELECT DISTINCT feed_id, load_id, load_seq FROM global_pcd_converter),
prev AS (SELECT load_id, lag(load_id) OVER (PARTITION BY feed_id ORDER BY load_seq) AS before FROM loads),
pairs AS (SELECT s.*, p.n AS pn, p.nv AS pnv, p.dv AS pdv, p.load_id AS before FROM stats s JOIN prev USING (load_id) JOIN stats p ON p.load_id = prev.before AND p.column_name = s.column_name),
cnt AS (SELECT load_id, column_name, v, count(*) AS c FROM vals WHERE valid AND t IS NULL GROUP BY ALL),
both_sides AS (
  SELECT pairs.load_id, pairs.column_name, v, c AS a, 0 AS b FROM pairs JOIN cnt ON cnt.load_id = pairs.load_id AND cnt.column_name = pairs.column_name
  UNION ALL SELECT pairs.load_id, pairs.column_name, v, 0, c FROM pairs JOIN cnt ON cnt.load_id = pairs.before AND cnt.column_name = pairs.column_name),
merged AS (SELECT load_id, column_name, v, sum(a) AS a, sum(b) AS b FROM both_sides GROUP BY ALL),
cum AS (SELECT load_id, column_name, sum(a) OVER w AS a1, sum(b) OVER w AS b1, sum(a) OVER k AS aa, sum(b) OVER k AS bb FROM merged
  WINDOW w AS (PARTITION BY load_id, column_name ORDER BY v ROWS UNBOUNDED PRECEDING), k AS (PARTITION BY load_id, column_name)),
gap AS (SELECT load_id, column_name, max(abs(CAST(a1 AS DOUBLE) * bb - CAST(b1 AS DOUBLE) * aa) / (CAST(aa AS DOUBLE) * bb)) AS g FROM cum WHERE aa > 0 AND bb > 0 GROUP BY ALL)
SELECT load_id, column_name, 'range' AS issue FROM stats WHERE bad_range
UNION ALL SELECT load_id, column_name, 'pattern' FROM stats WHERE bad_pattern
UNION ALL SELECT load_id, column_name, 'missing' FROM pairs WHERE ((n - nv) * pn - (pn - pnv) * n) * 100 > 15 * n * pn
UNION ALL SELECT load_id, column_name, 'distinct' FROM pairs WHERE nv >= 50 AND pnv >= 50 AND dv * 5 < pdv
UNION ALL SELECT load_id, column_name, 'shift' FROM pairs JOIN gap USING (load_id, column_name) WHERE nv >= 50 AND pnv >= 50 AND g > 0.25
"""


#: Columns of the delivered cloud by the form that their values take in the profile.
_REAL = "x y z intensity rgb balm_res ekf_res reflectivity plane_quality obs_count view_diversity temp_consistency ambient ring scan_time range_detach range_edge int_detach ring_rough range pose_unc_rot ang_rate".split()
_LONG, _TIME, _TEXT = ["point_id", "scan_id", "cell_id"], ["loaded_at", "captured_at"], ["scan_file", "scene", "cloud_id"]
_P3_COLUMNS = f"""
WITH rule AS (SELECT column_name, sentinel, lo, hi, coalesce(whole, false) AS whole, pattern FROM channel_rule),
cells AS (
  SELECT feed_id, load_id, load_seq, column_name, v, CAST(NULL AS BIGINT) AS w, CAST(NULL AS VARCHAR) AS t FROM (SELECT feed_id, load_id, load_seq, unnest([{", ".join(f"'{c}'" for c in _REAL + _TIME)}]) AS column_name,
    unnest([{", ".join([f'CAST("{c}" AS DOUBLE)' for c in _REAL] + [f"CAST(epoch_us({c}) AS DOUBLE)" for c in _TIME])}]) AS v FROM global_pcd_converter)
  UNION ALL SELECT feed_id, load_id, load_seq, column_name, NULL, w, NULL FROM (SELECT feed_id, load_id, load_seq, unnest([{", ".join(f"'{c}'" for c in _LONG)}]) AS column_name, unnest([{", ".join(_LONG)}]) AS w FROM global_pcd_converter)
  UNION ALL SELECT feed_id, load_id, load_seq, column_name, NULL, NULL, t FROM (SELECT feed_id, load_id, load_seq, unnest([{", ".join(f"'{c}'" for c in _TEXT)}]) AS column_name, unnest([{", ".join(_TEXT)}]) AS t FROM global_pcd_converter)),
vals AS (SELECT c.*, r.lo, r.hi, coalesce(r.whole, false) AS whole, r.pattern,
  CASE WHEN column_name IN ('scan_file', 'scene', 'cloud_id') THEN CASE WHEN trim(t, ' ') <> '' THEN t END WHEN w IS NOT NULL THEN CAST(w AS VARCHAR) WHEN (isfinite(v) OR isinf(v)) AND NOT coalesce(abs(v - r.sentinel) <= 1e-6, false) THEN CAST(v AS VARCHAR) END AS k,
  CASE WHEN w IS NOT NULL THEN CAST(w AS DOUBLE) WHEN (isfinite(v) OR isinf(v)) AND NOT coalesce(abs(v - r.sentinel) <= 1e-6, false) THEN v END AS num FROM cells c LEFT JOIN rule r USING (column_name)),
freq AS (SELECT load_id, column_name, k, count(*) AS n FROM vals WHERE k IS NOT NULL GROUP BY ALL),
stats AS (SELECT load_id, column_name, count(*) AS rows, count(*) FILTER (WHERE k IS NULL) AS missing, count(DISTINCT k) AS distinct_values, min(num) AS min_value, max(num) AS max_value, min(CASE WHEN t IS NOT NULL THEN k END) AS min_text, max(CASE WHEN t IS NOT NULL THEN k END) AS max_text,
  count(*) FILTER (WHERE coalesce(num < lo, false) OR coalesce(num > hi, false)) AS out_of_range,
  count(*) FILTER (WHERE k IS NOT NULL AND CASE WHEN t IS NULL THEN whole AND NOT isinf(num) AND num <> floor(num) ELSE coalesce(NOT regexp_full_match(k, pattern), false) END) AS off_pattern FROM vals GROUP BY ALL),
tops AS (SELECT load_id, column_name, max(n) AS top_count FROM freq GROUP BY ALL),
prev AS (SELECT load_id, lag(load_id) OVER (PARTITION BY feed_id ORDER BY load_seq) AS before FROM (SELECT DISTINCT feed_id, load_id, load_seq FROM global_pcd_converter)),
cnt AS (SELECT load_id, column_name, num AS v, count(*) AS c FROM vals WHERE num IS NOT NULL GROUP BY ALL),
sides AS (SELECT load_id, column_name, v, c AS a, 0 AS b FROM cnt UNION ALL SELECT prev.load_id, column_name, v, 0, c FROM prev JOIN cnt ON cnt.load_id = prev.before),
merged AS (SELECT load_id, column_name, v, sum(a) AS a, sum(b) AS b FROM sides GROUP BY ALL),
cum AS (SELECT load_id, column_name, sum(a) OVER w AS a1, sum(b) OVER w AS b1, sum(a) OVER k AS aa, sum(b) OVER k AS bb FROM merged
  WINDOW w AS (PARTITION BY load_id, column_name ORDER BY v ROWS UNBOUNDED PRECEDING), k AS (PARTITION BY load_id, column_name)),
gap AS (SELECT load_id, column_name, max(abs(CAST(a1 AS DOUBLE) * bb - CAST(b1 AS DOUBLE) * aa) / (CAST(aa AS DOUBLE) * bb)) AS g FROM cum WHERE aa > 0 AND bb > 0 GROUP BY ALL)
SELECT s.load_id, s.column_name, s.rows, s.missing, s.distinct_values, s.min_value, s.max_value, s.min_text, s.max_text, s.out_of_range, s.off_pattern, top_count, p.rows AS rows_before, p.missing AS missing_before, p.distinct_values AS distinct_before, round(g, 9) AS largest_gap
FROM stats s JOIN prev ON prev.load_id = s.load_id LEFT JOIN stats p ON p.load_id = prev.before AND p.column_name = s.column_name LEFT JOIN tops ON tops.load_id = s.load_id AND tops.column_name = s.column_name
LEFT JOIN gap ON gap.load_id = s.load_id AND gap.column_name = s.column_name
"""

_P6_SQL = r"""
WITH RECURSIVE head AS (SELECT *, ltrim(header) LIKE '{%' AS js FROM cloud_file),
pcd AS (SELECT file_id, string_split_regex(trim(regexp_extract(header, '(?im)^[ \t]*FIELDS[ \t]+([^\r\n]*)', 1), E' \t'), '[ \t]+') AS n, string_split_regex(trim(regexp_extract(header, '(?im)^[ \t]*TYPE[ \t]+([^\r\n]*)', 1), E' \t'), '[ \t]+') AS t,
  string_split_regex(trim(regexp_extract(header, '(?im)^[ \t]*SIZE[ \t]+([^\r\n]*)', 1), E' \t'), '[ \t]+') AS s FROM head WHERE NOT js),
listed AS (SELECT file_id, unnest(CAST(header->'$.extra_dims' AS STRUCT(name VARCHAR, type VARCHAR)[])) AS e FROM head WHERE js AND json_type(header, '$.extra_dims') = 'ARRAY'),
mapped AS (SELECT file_id, unnest(map_entries(CAST(header->'$.extra_dims' AS MAP(VARCHAR, VARCHAR)))) AS e FROM head WHERE js AND json_type(header, '$.extra_dims') = 'OBJECT'),
entry AS (SELECT file_id, lower(trim(n[i])) AS name, upper(t[i]) || s[i] AS type, i FROM (SELECT *, unnest(range(1, len(n) + 1)) AS i FROM pcd)
  UNION ALL SELECT file_id, lower(trim(e.name)), lower(trim(e.type)), 0 FROM listed UNION ALL SELECT file_id, lower(trim(e.key)), lower(trim(e.value)), 0 FROM mapped),
fields AS (SELECT file_id, name, arg_min(type, i) AS type FROM entry WHERE name <> '' GROUP BY ALL),
pairs AS (SELECT file_id, before FROM (SELECT file_id, lag(file_id) OVER (PARTITION BY series_id ORDER BY file_seq, file_id) AS before FROM cloud_file) WHERE before IS NOT NULL),
own AS (SELECT * FROM fields WHERE name NOT IN ('point_idx', 'x', 'y', 'z')),
sets AS (SELECT coalesce(a.file_id, b.file_id) AS file_id, coalesce(a.before, b.before) AS before, coalesce(a.name, b.name) AS name, a.type AS type_new, b.type AS type_old
  FROM (SELECT file_id, before, name, type FROM pairs JOIN own USING (file_id)) a FULL JOIN (SELECT pairs.file_id, before, name, type FROM pairs JOIN own ON own.file_id = before) b ON a.file_id = b.file_id AND a.name = b.name),
vals AS (SELECT r.file_id, row_no, name, value FROM (SELECT file_id, row_no, n, string_split_regex(trim(payload, E' \t\r\n'), '[ \t]+') AS v, unnest(range(1, len(n) + 1)) AS i FROM cloud_record JOIN pcd USING (file_id)) r, LATERAL (SELECT lower(trim(n[i])) AS name, v[i] AS value)
  UNION ALL SELECT file_id, row_no, lower(trim(e.key)), e.value FROM (SELECT file_id, row_no, unnest(map_entries(CAST(replace(payload, 'NaN', 'null') AS JSON)::MAP(VARCHAR, VARCHAR))) AS e FROM cloud_record WHERE ltrim(payload) LIKE '{%')),
given AS (SELECT file_id, row_no, name, trim(value) AS value, TRY_CAST(value AS DOUBLE) AS d FROM vals WHERE value IS NOT NULL AND lower(trim(value)) NOT IN ('nan', '', 'null')),
idx AS (SELECT file_id, row_no, CAST(min(d) AS BIGINT) AS point FROM given WHERE name = 'point_idx' GROUP BY ALL),
flat AS (SELECT DISTINCT file_id, point, name, CASE WHEN regexp_full_match(value, '[+-]?[0-9]+') THEN CAST(TRY_CAST(value AS HUGEINT) AS VARCHAR) WHEN d = floor(d) AND abs(d) < 9007199254740992 THEN CAST(CAST(d AS HUGEINT) AS VARCHAR) WHEN d IS NOT NULL THEN CAST(d AS VARCHAR) ELSE value END AS value
  FROM given JOIN idx USING (file_id, row_no)),
asked AS (SELECT a.file_id, a.before, a.name AS new_field, b.name AS old_field FROM sets a JOIN sets b ON a.file_id = b.file_id WHERE a.type_old IS NULL AND b.type_new IS NULL),
renames AS (SELECT asked.file_id, old_field, new_field FROM asked JOIN flat a ON a.file_id = asked.file_id AND a.name = new_field JOIN flat b ON b.file_id = before AND b.name = old_field AND b.point = a.point GROUP BY ALL HAVING bool_and(a.value = b.value)),
moved AS (SELECT file_id, name, type_new, type_old FROM sets WHERE type_new IS NOT NULL AND type_old IS NOT NULL
  UNION ALL SELECT r.file_id, new_field, a.type, b.type FROM renames r JOIN pairs USING (file_id) JOIN fields a ON a.file_id = r.file_id AND a.name = new_field JOIN fields b ON b.file_id = before AND b.name = old_field)
"""
_P6_FOUND = _P6_SQL + """
SELECT file_id, 'renamed' AS change, old_field, new_field FROM renames
UNION ALL SELECT file_id, 'removed', name, '' FROM sets WHERE type_new IS NULL AND (file_id, name) NOT IN (SELECT (file_id, old_field) FROM renames)
UNION ALL SELECT file_id, 'added', '', name FROM sets WHERE type_old IS NULL AND (file_id, name) NOT IN (SELECT (file_id, new_field) FROM renames)
UNION ALL SELECT file_id, 'retyped', name, name FROM moved WHERE type_new <> type_old
"""
_P6_FIELDS = _P6_SQL + """,
up AS (SELECT f.file_id, f.name, pairs.before, coalesce(r.old_field, f.name) AS was FROM fields f JOIN pairs USING (file_id) LEFT JOIN renames r ON r.file_id = f.file_id AND r.new_field = f.name JOIN fields p ON p.file_id = pairs.before AND p.name = coalesce(r.old_field, f.name)),
walk(file_id, name, here, was, depth) AS (SELECT file_id, name, file_id, name, 0 FROM fields UNION ALL SELECT walk.file_id, walk.name, up.before, up.was, depth + 1 FROM walk JOIN up ON up.file_id = here AND up.name = walk.was)
SELECT walk.file_id, walk.name, any_value(fields.type) AS type, arg_max(was, depth) AS canonical FROM walk JOIN fields ON fields.file_id = walk.file_id AND fields.name = walk.name GROUP BY walk.file_id, walk.name
"""


_P6_CELLS = _P6_FIELDS.replace("SELECT walk.file_id, walk.name, any_value", ", canon AS (SELECT walk.file_id, walk.name, any_value").replace("GROUP BY walk.file_id, walk.name\n", "GROUP BY walk.file_id, walk.name)\n") + """
SELECT stage, g.file_id, g.row_no, coalesce(canonical, g.name) AS field, g.d AS value FROM given g JOIN cloud_file USING (file_id) LEFT JOIN canon ON canon.file_id = g.file_id AND canon.name = g.name
WHERE g.d IS NOT NULL AND (canonical IS NOT NULL OR g.name IN ('point_idx', 'x', 'y', 'z'))
"""


def oracle_sql() -> dict[str, str]:
    return {"p6_cells": _P6_CELLS, "p3_found": _P3_SQL, "p3_columns": _P3_COLUMNS, "p6_found": _P6_FOUND, "p6_fields": _P6_FIELDS}
