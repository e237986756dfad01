"""Trajectories, scan-to-world merge, and merge-wide cell statistics.

A trajectory has one row a scan; repeated rows count once (the earliest received). Invalid poses are kept as rows but flagged,
and transform nothing. Windows run over the scans of one cloud (metadata, one row a scan), never over points, except the
episode statistics, whose groups are the scans that saw one cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pointspark.functions import rigid
from pointspark.functions.missing import finite, present

Q = ("qx", "qy", "qz", "qw")
P = ("x", "y", "z")
SANE_RADIUS = 1e4  # metres from the median position


def one_per_scan(traj: DataFrame) -> DataFrame:
    rest = [c for c in traj.columns if c not in ("cloud_id", "scan_id")]
    row = F.min_by(F.struct(*rest), F.struct("received_at", *[F.coalesce(F.col(c), F.lit(0.0)) for c in ("t", *P)]))
    return traj.groupBy("cloud_id", "scan_id").agg(row.alias("r")).select("cloud_id", "scan_id", "r.*")


def flag_poses(traj: DataFrame, radius: float = SANE_RADIUS) -> DataFrame:
    """Adds ``sane``: finite pose and time, a quaternion with a norm, within radius of the cloud's median position."""
    ok = finite("t").isNotNull()
    for c in (*P, *Q):
        ok &= finite(c).isNotNull()
    ok &= rigid.norm(*[finite(c) for c in Q]) > 0
    mid = traj.where(ok).groupBy("cloud_id").agg(*[F.percentile(finite(c), F.lit(0.5)).alias(f"mid_{c}") for c in P])
    near = rigid.norm(*[finite(c) - F.col(f"mid_{c}") for c in P]) <= radius
    return traj.join(mid, "cloud_id", "left").withColumn("sane", F.coalesce(ok & near, F.lit(False))).drop(*[f"mid_{c}" for c in P])


def pose_channels(traj: DataFrame) -> DataFrame:
    """(cloud_id, scan_id, pose_unc_rot, ang_rate) from flagged poses (N10); NULL where not usable."""
    unc = F.sqrt((finite("v6_0") + finite("v6_1") + finite("v6_2")) / 3)
    w = W.partitionBy("cloud_id").orderBy("scan_id")
    nxt = [F.lead(c).over(w) for c in Q]
    dt = F.lead("t").over(w) - F.col("t")
    angle = rigid.rotation_angle(tuple(F.col(c) for c in Q), tuple(nxt))
    step = F.when((dt > 1e-9) & F.col("sane") & F.lead("sane").over(w), angle / dt)
    rows = traj.select("cloud_id", "scan_id", unc.alias("pose_unc_rot"), step.alias("step"), F.lead("scan_id").over(w).isNull().alias("last"))
    return rows.select("cloud_id", "scan_id", "pose_unc_rot", F.when(F.col("last"), F.lag("step").over(w)).otherwise(F.col("step")).alias("ang_rate"))


def path_stretches(traj: DataFrame, metres: float | None = None, scans: int | None = None) -> DataFrame:
    """(cloud_id, scan_id, t, path, stretch): cumulative path length and its pieces by length or by scans."""
    w = W.partitionBy("cloud_id").orderBy("scan_id")
    step = rigid.norm(*[F.col(c) - F.lag(c).over(w) for c in P])
    rows = traj.select("cloud_id", "scan_id", "t", F.coalesce(step, F.lit(0.0)).alias("step"), (F.row_number().over(w) - 1).alias("i"))
    run = F.sum("step").over(w.rowsBetween(W.unboundedPreceding, 0))
    piece = F.floor(F.col("path") / metres) if metres else F.floor(F.col("i") / scans)
    return rows.withColumn("path", run).select("cloud_id", "scan_id", "t", "path", piece.cast("int").alias("stretch"))


def stretch_spans(stretches: DataFrame) -> DataFrame:
    return stretches.groupBy("cloud_id", "stretch").agg(F.count("*").alias("scans"), (F.max("t") - F.min("t")).alias("seconds"))


def to_world(points: DataFrame, traj: DataFrame, offset: int = 0, channels: DataFrame | None = None) -> DataFrame:
    """Points of sane scans in the world frame, with range and, from ``channels``, the per-scan columns.

    channels: scan_id and further columns, one row a scan. The pose table is joined on scan_id + offset, which names one scan in all
    clouds; it is small against the points and broadcast by the planner when it is.
    """
    if channels is not None:
        extra = [c for c in channels.columns if c not in ("scan_id", "cloud_id")]
        points = points.join(channels.select((F.col("scan_id") - offset).alias("scan_id"), *extra), "scan_id", "left")
    poses = traj.where("sane").select((F.col("scan_id") - offset).alias("scan_id"), *[F.col(c).alias(f"p_{c}") for c in (*P, *Q)])
    r = rigid.rotation(tuple(F.col(f"p_{c}") for c in Q))
    world = rigid.apply(r, [F.col(f"p_{c}") for c in P], [F.col(c) for c in P])
    joined = points.join(poses, "scan_id")
    rest = [c for c in points.columns if c not in P]
    return joined.select(*rest, *[v.alias(c) for v, c in zip(world, P)], rigid.norm(*P).alias("range"))


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance: float, left_id: str, right_id: str, by: list[str], left_t: str = "t", right_t: str = "t") -> DataFrame:
    """(by, left_id, right_id, dt): nearest right row in time within the tolerance, each right row used once.

    Rows meet in time buckets of the tolerance, so the join is an equi-join; the first left row in time keeps a contested one.
    """
    bucket = lambda c: F.floor(c / tolerance).cast("long")
    a = left.where(finite(left_t).isNotNull()).select(*by, F.col(left_id).alias("l"), F.col(left_t).alias("lt"), F.explode(F.array(*[bucket(F.col(left_t)) + i for i in (-1, 0, 1)])).alias("k"))
    b = right.where(finite(right_t).isNotNull()).select(*by, F.col(right_id).alias("r"), F.col(right_t).alias("rt"), bucket(F.col(right_t)).alias("k"))
    dt = F.abs(F.col("rt") - F.col("lt"))
    pairs = a.join(b, [*by, "k"]).where(dt <= tolerance).withColumn("dt", dt)
    best = pairs.groupBy(*by, "l").agg(F.min_by(F.struct("r", "dt", "lt"), F.struct("dt", "rt", "r")).alias("m")).select(*by, "l", "m.*")
    first = best.groupBy(*by, "r").agg(F.min_by(F.struct("l", "dt"), F.struct("lt", "l")).alias("m"))
    return first.select(*by, F.col("m.l").alias(left_id), F.col("r").alias(right_id), F.col("m.dt").alias("dt"))


def first_per_cell(points: DataFrame, key: str = "point_idx") -> DataFrame:
    """The first row of each cell in each scan, as seen by the merge."""
    row = F.struct(present("obs_count", 0.0).alias("obs"), present("view_diversity").alias("vd"), present("temp_consistency").alias("tc"))
    return points.where(F.col("cell_id") >= 0).groupBy("cell_id", "scan_id").agg(F.min_by(row, key).alias("r")).select("cell_id", "scan_id", F.coalesce("r.obs", F.lit(0.0)).alias("obs"), "r.vd", "r.tc")


def cell_statistics(firsts: DataFrame) -> DataFrame:
    """(cell_id, obs_count, view_diversity, temp_consistency) over all scans of a cell.

    An observation count below the previous one starts a new episode; the ends of all episodes are summed.
    """
    w = W.partitionBy("cell_id").orderBy("scan_id")
    rows = firsts.withColumn("prev", F.lag("obs").over(w))
    ended = F.sum(F.when(F.col("obs") < F.col("prev"), F.col("prev")).otherwise(0.0))
    return rows.groupBy("cell_id").agg(
        (ended + F.max_by("obs", "scan_id")).alias("obs_count"), F.max("vd").alias("view_diversity"),
        F.max_by("tc", F.when(F.col("tc").isNotNull(), F.struct("obs", (-F.col("scan_id")).alias("s")))).alias("temp_consistency"),
    )


def with_cell_statistics(points: DataFrame, stats: DataFrame) -> DataFrame:
    """Per-scan snapshots replaced by the merge-wide values where a cell has them."""
    cols = ("obs_count", "view_diversity", "temp_consistency")
    s = stats.select("cell_id", *[F.col(c).alias(f"m_{c}") for c in cols])
    return points.join(s, "cell_id", "left").withColumns({c: F.coalesce(F.col(f"m_{c}"), F.col(c)) for c in cols}).drop(*[f"m_{c}" for c in cols])


def keyframes_near(poses: DataFrame, radius: float, item: str = "scan_id") -> DataFrame:
    """Pairs of keyframes of a cloud within the radius (J19), each pair once."""
    from pointspark.operators.grid import halo_join

    pairs = halo_join(poses, poses, radius, item, item)
    return pairs.where(F.col("a_id") < F.col("b_id"))


def pick_keyframes(traj: DataFrame, every: int) -> DataFrame:
    """The last scan of each run of ``every`` scans (count windows, W8/W10)."""
    w = W.partitionBy("cloud_id").orderBy("scan_id")
    return traj.withColumn("i", F.row_number().over(w) - 1).where((F.col("i") + 1) % every == 0).drop("i")


def sliding_windows(frames: DataFrame, size: int, stride: int) -> DataFrame:
    """(cloud_id, window, scan_id, position): count windows of ``size`` rows every ``stride`` rows."""
    w = W.partitionBy("cloud_id").orderBy("scan_id")
    rows = frames.select("cloud_id", "scan_id", (F.row_number().over(w) - 1).alias("i"))
    first = F.greatest(F.lit(0), F.floor((F.col("i") - size) / stride) + 1)
    return rows.withColumn("window", F.explode(F.sequence(first.cast("long"), F.floor(F.col("i") / stride).cast("long")))).select("cloud_id", "window", "scan_id", (F.col("i") - F.col("window") * stride).alias("position"))




def merge_clouds(points: DataFrame, traj: DataFrame, key: str = "point_idx") -> DataFrame:
    """The merged world cloud (K7): merge-wide cell statistics first, then every point transformed with them, its range and per-scan channels.

    One plan: the statistics pass is an aggregate of a few columns, the transform pass a join with it and with the poses.
    """
    stats = cell_statistics(first_per_cell(points, key))
    return to_world(with_cell_statistics(points, stats), traj, channels=pose_channels(traj))


def keyframe_clouds(points: DataFrame, traj: DataFrame, size: int, voxel: float, item: str) -> DataFrame:
    """(cloud_id, keyframe, item, x, y, z): the map of an earlier session.

    Every ``size`` scans of a cloud make a keyframe, named by and put in the frame of their last scan; an unfinished run makes none. Points of a
    voxel are thinned to their mean, kept under the first point's id.
    """
    w = W.partitionBy("cloud_id").orderBy("scan_id")
    runs = traj.where("sane").select("cloud_id", "scan_id", *P, *Q, F.floor((F.row_number().over(w) - 1) / size).alias("run"))
    last = runs.groupBy("cloud_id", "run").agg(F.count("*").alias("n"), F.max_by(F.struct("scan_id", *P, *Q), "scan_id").alias("k")).where(F.col("n") == size).select("cloud_id", "run", F.col("k.scan_id").alias("keyframe"), *[F.col(f"k.{c}").alias(f"k_{c}") for c in (*P, *Q)])
    world = to_world(points.select(item, "scan_id", *P), traj).select(item, "scan_id", *P)
    rows = world.join(runs.select("cloud_id", "scan_id", "run"), "scan_id").join(last, ["cloud_id", "run"])
    r = rigid.rotation(tuple(F.col(f"k_{c}") for c in Q))
    local = rigid.apply_inverse(r, [F.col(f"k_{c}") for c in P], [F.col(c) for c in P])
    rows = rows.select("cloud_id", "keyframe", item, *[v.alias(c) for v, c in zip(local, P)])
    cell = {n: F.floor(F.col(c) / voxel).cast("long") for n, c in zip(("ix", "iy", "iz"), P)}
    return rows.withColumns(cell).groupBy("cloud_id", "keyframe", *cell).agg(F.min(item).alias(item), *[F.avg(c).alias(c) for c in P]).drop(*cell)


def deskew(points: DataFrame, traj: DataFrame, at: str = "scan_time") -> DataFrame:
    """Points of a scan moved into the frame of its end, by the motion between its pose and the next one.

    The scan's pose is that of its beginning; a point taken ``at`` seconds later is carried back by the part of the motion that was still to
    come: rotation about the axis of the relative rotation by the remaining share of its angle, translation in proportion. Scans
    without a sane next pose keep their points.
    """
    w = W.partitionBy("cloud_id").orderBy("scan_id")
    sane = traj.where("sane")
    nxt = lambda c: F.lead(c).over(w)
    qn = F.sqrt(sum(F.col(c) * F.col(c) for c in Q))
    unit = sane.withColumns({c: F.col(c) / qn for c in Q})
    x, y, z, ww = (F.col(c) for c in Q)
    X, Y, Z, V = (nxt(c) for c in Q)
    # relative rotation conj(q) * q_next, on the shorter side
    rel = [ww * X - x * V - y * Z + z * Y, ww * Y + x * Z - y * V - z * X, ww * Z - x * Y + y * X - z * V, ww * V + x * X + y * Y + z * Z]
    moved = rigid.apply_inverse(rigid.rotation(tuple(F.col(c) for c in Q)), [F.col(c) for c in P], [nxt(c) for c in P])
    rows = unit.select("scan_id", *[r.alias(f"r{i}") for i, r in enumerate(rel)], *[m.alias(f"d{i}") for i, m in enumerate(moved)], (nxt("t") - F.col("t")).alias("dt"))
    sign = F.when(F.col("r3") < 0, -1.0).otherwise(1.0)
    s = F.sqrt(F.col("r0") ** 2 + F.col("r1") ** 2 + F.col("r2") ** 2)
    rows = rows.select("scan_id", "dt", "d0", "d1", "d2", (2 * F.atan2(s, F.abs(F.col("r3")))).alias("angle"), *[F.when(s > 1e-12, sign * F.col(f"r{i}") / s).otherwise(0.0).alias(f"a{i}") for i in range(3)]).where(F.col("dt") > 1e-9)
    share = F.coalesce(finite(at), F.lit(0.0)) / F.col("dt")
    j = points.join(rows, "scan_id", "left").withColumns({"_s": share, "_u": share - 1})
    # p' = R(u angle) p + T, with u = share - 1 <= 0: seen from the end, the point lies further along the motion
    c, v = F.cos(F.col("_u") * F.col("angle")), F.sin(F.col("_u") * F.col("angle"))
    p, a = [F.col(k) for k in P], [F.col(f"a{i}") for i in range(3)]
    dot = a[0] * p[0] + a[1] * p[1] + a[2] * p[2]
    cross = [a[1] * p[2] - a[2] * p[1], a[2] * p[0] - a[0] * p[2], a[0] * p[1] - a[1] * p[0]]
    turned = [p[i] * c + cross[i] * v + a[i] * dot * (1 - c) for i in range(3)]
    # translation still to come, in the frame of the end: -(1 - share) R(angle)^T d
    ce, ve = F.cos(F.col("angle")), -F.sin(F.col("angle"))
    d = [F.col(f"d{i}") for i in range(3)]
    ddot = a[0] * d[0] + a[1] * d[1] + a[2] * d[2]
    dcross = [a[1] * d[2] - a[2] * d[1], a[2] * d[0] - a[0] * d[2], a[0] * d[1] - a[1] * d[0]]
    back = [d[i] * ce + dcross[i] * ve + a[i] * ddot * (1 - ce) for i in range(3)]
    new = {k: F.when(F.col("dt").isNotNull(), turned[i] + F.col("_u") * back[i]).otherwise(F.col(k)) for i, k in enumerate(P)}
    return j.withColumns({f"_{k}": e for k, e in new.items()}).select(*[c for c in points.columns if c not in P], *[F.col(f"_{k}").alias(k) for k in P])


def static_start(samples: DataFrame, by: list[str], order: str, first: int, gravity: float = 9.81) -> DataFrame:
    """(by, n, g0..g2, b0..b2): gravity and gyroscope bias of a sensor that stands still, from its first samples.

    samples: a0..a2 (accelerations), w0..w2 (turn rates). Gravity is against the mean acceleration, scaled to its known size; missing samples are left out.
    """
    w = W.partitionBy(*by).orderBy(order)
    cols = [f"{k}{i}" for k in "aw" for i in range(3)]
    ok = F.lit(True)
    for c in cols:
        ok &= finite(c).isNotNull()
    rows = samples.where(ok).withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= first)
    mean = rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in cols])
    size = rigid.norm("a0", "a1", "a2")
    return mean.select(*by, "n", *[F.when(size > 0, -F.col(f"a{i}") * gravity / size).alias(f"g{i}") for i in range(3)], *[F.col(f"w{i}").alias(f"b{i}") for i in range(3)])


def _upright(g: list[Column]) -> list[list[Column]]:
    """Rotation that turns a gravity vector to the nearer side of the z axis."""
    size = rigid.norm(*g)
    n = [c / size for c in g]
    up = F.when(n[2] < 0, -1.0).otherwise(1.0)
    ax = [n[1] * up, -n[0] * up]  # n x (0, 0, up)
    s = F.sqrt(ax[0] * ax[0] + ax[1] * ax[1])
    kx, ky = F.when(s > 0, ax[0] / s).otherwise(0.0), F.when(s > 0, ax[1] / s).otherwise(0.0)
    angle = F.asin(F.when(s > 1, 1.0).otherwise(s))  # NULL without a gravity
    c, d, v = F.cos(angle), 1 - F.cos(angle), F.sin(angle)
    return [[c + kx * kx * d, kx * ky * d, ky * v], [kx * ky * d, c + ky * ky * d, -kx * v], [-ky * v, kx * v, c]]


def align_gravity(traj: DataFrame, by: str = "cloud_id", order: str = "scan_id") -> DataFrame:
    """Positions, velocities and gravity of each session turned so that its first scan's gravity lies along z."""
    first = traj.where(finite("gx").isNotNull() & finite("gy").isNotNull() & finite("gz").isNotNull() & (rigid.norm("gx", "gy", "gz") > 0)).groupBy(by).agg(F.min_by(F.struct("gx", "gy", "gz"), order).alias("_g"))
    r = _upright([F.col("_g.gx"), F.col("_g.gy"), F.col("_g.gz")])
    zero = [F.lit(0.0)] * 3
    sets = (("x", "y", "z"), ("vx", "vy", "vz"), ("gx", "gy", "gz"))
    new = {c: v for cols in sets for c, v in zip(cols, rigid.apply(r, zero, [F.col(c) for c in cols]))}
    rows = traj.join(first, by, "left")
    return rows.select(*[F.coalesce(new[c], F.col(c)).alias(c) if c in new else F.col(c) for c in traj.columns])


def apply_correction(traj: DataFrame, corrections: DataFrame) -> DataFrame:
    """States after a loop was closed (X16): from a correction's first scan on, poses, velocities and gravity move with it.

    corrections: cloud_id, from_scan, m (12 doubles, a 3 x 4 transform, row by row), a few rows; of several the latest one that has begun counts.
    """
    e = [[F.col("m")[4 * i + j] for j in range(3)] for i in range(3)]
    # the correction's quaternion; the branch by the largest of 4 w^2, 4 x^2, 4 y^2, 4 z^2 keeps it well conditioned
    trace = e[0][0] + e[1][1] + e[2][2]
    s = [1 + trace, 1 + e[0][0] - e[1][1] - e[2][2], 1 - e[0][0] + e[1][1] - e[2][2], 1 - e[0][0] - e[1][1] + e[2][2]]
    off = {"x": e[2][1] - e[1][2], "y": e[0][2] - e[2][0], "z": e[1][0] - e[0][1], "xy": e[0][1] + e[1][0], "xz": e[0][2] + e[2][0], "yz": e[1][2] + e[2][1]}
    forms = F.array(*[F.array(*f) for f in ((off["x"], off["y"], off["z"], s[0]), (s[1], off["xy"], off["xz"], off["x"]), (off["xy"], s[2], off["yz"], off["y"]), (off["xz"], off["yz"], s[3], off["z"]))])
    big = F.greatest(*s)
    form = F.element_at(forms, F.array_position(F.array(*s), big).cast("int"))
    c = corrections.select(F.col("cloud_id").alias("_c"), "from_scan", F.struct("m", F.transform(form, lambda v: v / (2 * F.sqrt(big))).alias("q")).alias("_f"))
    begun = traj.select("cloud_id", "scan_id").distinct().join(c, (F.col("cloud_id") == F.col("_c")) & (F.col("scan_id") >= F.col("from_scan")))
    latest = begun.groupBy("cloud_id", "scan_id").agg(F.max_by("_f", "from_scan").alias("_f")).select("cloud_id", "scan_id", F.col("_f.m").alias("_m"), F.col("_f.q").alias("_q"))
    rows = traj.join(latest, ["cloud_id", "scan_id"], "left")
    r = [[F.col("_m")[4 * i + j] for j in range(3)] for i in range(3)]
    t, zero = [F.col("_m")[4 * i + 3] for i in range(3)], [F.lit(0.0)] * 3
    new = dict(zip(P, rigid.apply(r, t, [F.col(k) for k in P])))
    for cols in (("vx", "vy", "vz"), ("gx", "gy", "gz")):
        new |= dict(zip(cols, rigid.apply(r, zero, [F.col(k) for k in cols])))
    d = [F.col("_q")[i] for i in range(4)]
    x, y, z, w = (F.col(q) for q in Q)
    new["qx"] = d[3] * x + d[0] * w + d[1] * z - d[2] * y
    new["qy"] = d[3] * y - d[0] * z + d[1] * w + d[2] * x
    new["qz"] = d[3] * z + d[0] * y - d[1] * x + d[2] * w
    new["qw"] = d[3] * w - d[0] * x - d[1] * y - d[2] * z
    return rows.select(*[F.when(F.col("_m").isNotNull(), new[k]).otherwise(F.col(k)).alias(k) if k in new else F.col(k) for k in traj.columns])
