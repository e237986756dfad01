"""Text sources: trajectories, loop edges, station sidecars, configuration, feature side-files, vendor layouts."""

from __future__ import annotations

import copy
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pointspark.sources import storage

#: Columns of a trajectory line after the first eight, and of the short form.
TRAJECTORY = ("t", "x", "y", "z", "qx", "qy", "qz", "qw", "vx", "vy", "vz", "bgx", "bgy", "bgz", "bax", "bay", "baz", "gx", "gy", "gz", "v6_0", "v6_1", "v6_2", "v6_3", "v6_4", "v6_5")
SIDECAR = (
    "merged_las string, station_field string, source_dir string, n_stations int, points long, stations array<struct<id:int,name:string,source:string,"
    "rotation:array<array<double>>,origin:array<double>,points:long,el_min:double,el_max:double,max_range:double>>"
)


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """One row a line with at least eight numbers; scan_id is the line's place among them.

    A trajectory is one small file: it is read as a whole so that the order of lines is certain.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda s: F.size(F.split(F.trim(s), r"\s+")) >= 8)).alias("scan_id", "line"))
    parts = F.split(F.trim("line"), r"\s+")
    return lines.select(F.col("scan_id").cast("long").alias("scan_id"), *[F.get(parts, F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(TRAJECTORY)])


def read_edges(spark: SparkSession, path: str, sessions: list[str] | None = None) -> DataFrame:
    """Loop edges, oriented from the session that comes first (by the given order, else by name); ``known`` marks edges of
    two given sessions, the others are kept as they are (S15)."""
    p = F.split(F.trim("value"), r"\s+")
    names = ["session1", "session2", "id1", "id2", "tx", "ty", "tz", "qx", "qy", "qz", "qw"]
    rows = spark.read.text(path).where(F.size(p) >= 11).select(*[(F.get(p, F.lit(i)) if i < 2 else F.get(p, F.lit(i)).try_cast("long" if i < 4 else "double")).alias(n) for i, n in enumerate(names)])
    if sessions:
        order = F.array(*[F.lit(s) for s in sessions])
        a, b = F.array_position(order, F.col("session1")), F.array_position(order, F.col("session2"))
        known = (a > 0) & (b > 0)
    else:
        a, b, known = F.col("session1"), F.col("session2"), F.lit(True)
    from pointspark.functions import rigid

    flip = known & (a > b)
    back = rigid.apply_inverse(rigid.rotation(tuple(F.col(q) for q in ("qx", "qy", "qz", "qw"))), [F.col(t) for t in ("tx", "ty", "tz")], [F.lit(0.0)] * 3)
    new = {"session1": "session2", "session2": "session1", "id1": "id2", "id2": "id1"}
    cols = [F.when(flip, F.col(new[c])).otherwise(F.col(c)).alias(c) for c in ("session1", "session2", "id1", "id2")]
    cols += [F.when(flip, v).otherwise(F.col(c)).alias(c) for c, v in zip(("tx", "ty", "tz"), back)]
    cols += [F.when(flip, -F.col(c)).otherwise(F.col(c)).alias(c) for c in ("qx", "qy", "qz")]
    return rows.select(*cols, "qw", known.alias("known"))


def write_trajectory(traj: DataFrame, path: str) -> None:
    """One line a scan in scan order, as read_trajectory reads it; a trajectory is one small file."""
    cols = [c for c in TRAJECTORY if c in traj.columns]
    line = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in cols])
    rows = traj.orderBy("scan_id").select(line.alias("line")).toLocalIterator()
    storage.write_whole(path, ((r["line"] + "\n").encode() for r in rows))


def write_edges(edges: DataFrame, path: str) -> None:
    """Loop edges as text lines, one file a partition."""
    edges.select(F.concat_ws(" ", "session1", "session2", "id1", "id2", "tx", "ty", "tz", "qx", "qy", "qz", "qw").alias("value")).write.mode("overwrite").text(path)


def write_sidecar(stations: DataFrame, path: str, merged: str) -> None:
    """The sidecar of a merged reference cloud: one JSON document with its stations, tens of rows."""
    rows = [json.loads(r["s"]) for r in stations.select(F.to_json(F.struct("id", "name", "source", "rotation", "origin", "points", "el_min", "el_max", "max_range")).alias("s"), "id").orderBy("id").toLocalIterator()]
    whole = {"merged_las": merged, "station_field": "station_id", "source_dir": "", "n_stations": len(rows), "points": sum(r.get("points") or 0 for r in rows), "stations": rows}
    storage.write_whole(path, [json.dumps(whole).encode()])


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """One row a station of a merged reference cloud."""
    return spark.read.schema(SIDECAR).json(path, multiLine=True).select("merged_las", F.inline("stations"))


def write_report(df: DataFrame, path: str) -> None:
    """A nested one-row report as JSON (K5)."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_ranking(ranking: DataFrame, path: str, title: str = "") -> None:
    """A ranking table as text (K5): one block a threshold, scorers from the best one on; a few rows."""
    out, tau = [title] if title else [], None
    for r in ranking.orderBy("tau", "place").toLocalIterator():
        if r["tau"] != tau:
            tau = r["tau"]
            out += ["", f"tau = {tau}", f"{'place':>5} {'scorer':<32} {'ap':>10} {'lift':>10} {'auc':>10} {'rho':>10}"]
        out.append(f"{r['place']:>5} {r['scorer']:<32} " + " ".join(f"{'-' if r[c] is None else format(r[c], '.6f'):>10}" for c in ("ap", "lift", "auc", "rho")))
    storage.write_whole(path, ["\n".join(out).encode()])


def overlaid(defaults: dict[str, Any], settings: dict[str, Any]) -> dict[str, Any]:
    """Defaults with the given settings laid over them: tables meet key by key, anything else is replaced."""
    result = copy.deepcopy(defaults)
    open_tables = [(result, settings)]
    while open_tables:
        below, above = open_tables.pop()
        for key in above:
            if all(isinstance(side.get(key), dict) for side in (below, above)):
                open_tables.append((below[key], above[key]))
            else:
                below[key] = copy.deepcopy(above[key])
    return result


def read_config(path: str, defaults: dict[str, Any]) -> dict[str, Any]:
    """A JSON configuration file over the defaults."""
    with storage.reader(path) as f:
        return load_config(json.loads(f.read()), defaults)


def load_config(given: dict[str, Any], defaults: dict[str, Any]) -> dict[str, Any]:
    """Defaults under the given settings; a single group may be written without a list; names must be unique."""
    out = overlaid(defaults, given)
    groups = out.get("gt_groups")
    if isinstance(groups, dict):
        groups = [groups]
    if not groups:
        raise ValueError("gt_groups is missing")
    names = [g.get("name") for g in groups]
    if None in names or len(set(names)) < len(names):
        raise ValueError("groups need unique names")
    out["gt_groups"] = groups
    if out.get("output_frame") not in (None, *names):
        raise ValueError("output_frame names no group")
    return out


def attach_features(cloud: DataFrame, features: DataFrame, key: str = "point_id") -> DataFrame:
    """Feature side-file joined on demand (S19); a clash of names is an error."""
    clash = (set(cloud.columns) & set(features.columns)) - {key}
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    return cloud.join(features, key, "left")


#: Vendor layouts as (canonical column, expression on the vendor's columns).
VENDORS: dict[str, dict[str, str]] = {
    "velodyne": {"x": "x", "y": "y", "z": "z", "intensity": "intensity", "ring": "cast(ring as int)", "offset": "cast(time as double)"},
    "ouster": {"x": "x", "y": "y", "z": "z", "intensity": "intensity", "ring": "cast(ring as int)", "offset": "cast(t as double) / 1e9"},
    "hesai": {"x": "x", "y": "y", "z": "z", "intensity": "intensity", "ring": "cast(ring as int)", "offset": "timestamp - min_timestamp"},
    "robosense": {"x": "x", "y": "y", "z": "z", "intensity": "intensity", "ring": "cast(ring as int)", "offset": "timestamp - min_timestamp"},
    "tartanair": {"x": "x", "y": "y", "z": "z", "intensity": "cast(0 as float)", "ring": "cast(0 as int)", "offset": "cast(0 as double)"},
}


def canonical_sweep(df: DataFrame, vendor: str, scan: str = "scan_id", blind: float = 0.0, every: int = 1, latest: float = 0.11) -> DataFrame:
    """A vendor's rows in canonical columns; points within the blind radius, decimated ones and late offsets dropped.

    ``place`` numbers what is left of a sweep by point time: the order that de-skewing walks in.
    """
    layout = VENDORS[vendor]
    if any("min_timestamp" in e for e in layout.values()):
        df = df.join(df.groupBy(scan).agg(F.min("timestamp").alias("min_timestamp")), scan)
    out = df.select(scan, "point_idx", *[F.expr(e).alias(c) for c, e in layout.items()])
    far = F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2 > blind * blind
    kept = out.where(far & (F.col("point_idx") % every == 0) & (F.col("offset") <= latest))
    return kept.withColumn("place", F.row_number().over(W.partitionBy(scan).orderBy("offset", "point_idx")))  # a sweep is bounded by its scanner
