"""Scanner visibility and the evaluation domain.

Stations are a dimension table of tens of rows with a pose, an elevation span and a reach; panoramas are sparse tables of the
nearest and farthest return a bin. Points meet stations by an explicit bounded broadcast, panorama bins by an equi-join. Defined
cases: points without finite coordinates see nothing (code 0); no stations means nothing is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pointspark.functions import rigid
from pointspark.operators import grid
from pointspark.operators.graph import connected_leads
from pointspark.session import cut

UNKNOWN, OCCLUDED, FREE, OBSERVED = 0, 1, 2, 3
IN_DOMAIN, NO_GT, OUT_FOOTPRINT, OUT_Z, EXCLUDED, NOT_VISIBLE = 0, 1, 2, 3, 4, 5
MAX_STATIONS = 100_000  # rows that may be broadcast


def station_matrix(stations: DataFrame) -> DataFrame:
    """Poses as twelve columns r00..r22, t0..t2."""
    cols = [F.col("rotation")[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)] + [F.col("origin")[i].alias(f"t{i}") for i in range(3)]
    return stations.select("station_id", "scene", "gt_group", "el_min", "el_max", "max_range", *cols)


def _local() -> list[Column]:
    r = [[F.col(f"r{i}{j}") for j in range(3)] for i in range(3)]
    return rigid.apply_inverse(r, [F.col(f"t{i}") for i in range(3)], [F.col(c) for c in grid.XYZ])


def station_view(points: DataFrame, stations: DataFrame, resolution: float) -> DataFrame:
    """Points in the spherical bins of every station of their scene within reach (J10): r, az bin, el bin.

    Stations are broadcast after a check of their number and joined on the scene.
    """
    if stations.count() > MAX_STATIONS:
        raise ValueError("too many stations to broadcast")
    seen = grid.located(points).join(F.broadcast(station_matrix(stations)), "scene")
    l0, l1, l2 = _local()
    seen = seen.withColumns({"l0": l0, "l1": l1, "l2": l2}).withColumn("r", rigid.norm("l0", "l1", "l2"))
    seen = seen.where((F.col("r") > 1e-6) & (F.col("r") <= F.col("max_range")))
    el = F.degrees(F.asin(F.greatest(F.least(F.col("l2") / F.col("r"), F.lit(1.0)), F.lit(-1.0))))
    az = F.degrees(F.atan2("l1", "l0"))
    n_az = round(360 / resolution)
    seen = seen.withColumns({"el": el, "ia": F.pmod(F.floor((az + 180) / resolution), F.lit(n_az)).cast("int")})
    return seen.where(F.col("el").between(F.col("el_min"), F.col("el_max"))).withColumn("ie", F.floor((F.col("el") - F.col("el_min")) / resolution).cast("int")).drop("l0", "l1", "l2")


def panorama(reference_view: DataFrame) -> DataFrame:
    """(station_id, ia, ie, near, far) of the reference returns."""
    return reference_view.groupBy("station_id", "ia", "ie").agg(F.min("r").alias("near"), F.max("r").alias("far"))


def widen(bins: DataFrame, n_az: int) -> DataFrame:
    """3 x 3 minimum of near and maximum of far; azimuth wraps, elevation doesn't."""
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(e).alias("e")) for a in (-1, 0, 1) for e in (-1, 0, 1)])
    out = bins.select("station_id", "near", "far", "ia", "ie", F.explode(steps).alias("s"))
    spread = out.groupBy("station_id", F.pmod(F.col("ia") + F.col("s.a"), F.lit(n_az)).alias("ia"), (F.col("ie") + F.col("s.e")).alias("ie"))
    return spread.agg(F.min("near").alias("near"), F.max("far").alias("far"))


def verdicts(view: DataFrame, bins: DataFrame, eps0: float = 0.02, eps_rate: float = 0.002, behind: float = 0.10) -> DataFrame:
    """View rows with the per-station code: free space, occluded, observed, or unknown without a return (L1)."""
    v = view.join(bins, ["station_id", "ia", "ie"], "left")
    eps = F.lit(eps0) + eps_rate * F.col("r")
    code = F.when(F.col("near").isNull(), UNKNOWN).when(F.col("r") < F.col("near") - eps, FREE).when(F.col("r") > F.col("far") + eps + behind, OCCLUDED).otherwise(OBSERVED)
    return v.withColumn("code", code)


def fuse(points: DataFrame, seen: DataFrame, item: str) -> DataFrame:
    """(item, visibility, group): the highest code of all stations, its first group on ties, group 0 for unknown (L2)."""
    best = seen.groupBy(item).agg(F.max(F.struct("code", (-F.col("gt_group")).alias("g"))).alias("b"))
    out = points.select(item).distinct().join(best, item, "left")
    code = F.coalesce("b.code", F.lit(UNKNOWN))
    return out.select(item, code.alias("visibility"), F.when(code > UNKNOWN, -F.col("b.g")).otherwise(0).alias("group"))


def within_reach(points: DataFrame, stations: DataFrame, margin: float) -> DataFrame:
    """Points within max_range + margin of at least one station of their scene."""
    if stations.count() > MAX_STATIONS:
        raise ValueError("too many stations to broadcast")
    s = stations.select("scene", *[F.col("origin")[i].alias(f"t{i}") for i in range(3)], "max_range")
    near = rigid.square_distance([F.col(f"p.{c}") for c in grid.XYZ], [F.col(f"s.t{i}") for i in range(3)]) <= (F.col("s.max_range") + margin) ** 2
    return grid.located(points).alias("p").join(F.broadcast(s).alias("s"), (F.col("p.scene") == F.col("s.scene")) & near, "left_semi")


def domain_code(visibility: Column, excluded: Column, cropped: Column, c2c: Column) -> Column:
    """Evaluation-domain code from the gates in their order (L3)."""
    return (
        F.when(~visibility.isin(FREE, OBSERVED), NOT_VISIBLE).when(excluded, EXCLUDED).when(cropped, NO_GT).when(c2c.isNull() & (visibility == OBSERVED), NO_GT).otherwise(IN_DOMAIN)
    )


def clamp_free_space(visibility: Column, code: Column, c2c: Column, max_distance: float) -> Column:
    """Free-space points in the domain without a distance get the cap; points out of the domain none (L3)."""
    return F.when((code == IN_DOMAIN) & (visibility == FREE) & c2c.isNull(), F.lit(max_distance)).when(code == IN_DOMAIN, c2c)


def cropped_away(distance: Column, full_distance: Column, margin: float) -> Column:
    """The true surface is nearer than anything that the crop left (L4)."""
    return F.coalesce(full_distance < distance - margin, F.lit(False))


def in_boxes(boxes: list[tuple[tuple[float, ...], tuple[float, ...]]]) -> Column:
    """Inside any axis-aligned box."""
    hit = F.lit(False)
    for lo, hi in boxes:
        hit |= F.col("x").between(lo[0], hi[0]) & F.col("y").between(lo[1], hi[1]) & F.col("z").between(lo[2], hi[2])
    return F.coalesce(hit, F.lit(False))


def in_polygon(polygon: list[tuple[float, float]], x: str = "x", y: str = "y") -> Column:
    """Even-odd test against a configured polygon, as one JVM expression over its edges."""
    crossings = F.lit(0)
    px, py = F.col(x), F.col(y)
    for (x1, y1), (x2, y2) in zip(polygon, polygon[1:] + polygon[:1]):
        if y1 != y2:
            crossings += (((F.lit(y1) > py) != (F.lit(y2) > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)).cast("int")
    return F.coalesce(crossings % 2 == 1, F.lit(False))


def in_prism(polygon: list[tuple[float, float]], z_lo: float, z_hi: float) -> Column:
    return in_polygon(polygon) & F.col("z").between(z_lo, z_hi)


def in_voxels(points: DataFrame, mask: DataFrame, size: float) -> DataFrame:
    """Points whose voxel is in the mask."""
    return grid.with_cell(points, size).join(mask.select(*grid.CELL).distinct(), grid.CELL, "left_semi")


def polygon_cells(spark, polygon: list[tuple[float, float]], cell: float) -> DataFrame:
    """Cells of the xy grid whose centre lies in the polygon."""
    xs, ys = [p[0] for p in polygon], [p[1] for p in polygon]
    n = lambda v: int(v // cell)
    rows = spark.range(n(min(xs)), n(max(xs)) + 1).withColumnRenamed("id", "ix").withColumn("iy", F.explode(F.sequence(F.lit(n(min(ys))).cast("long"), F.lit(n(max(ys))).cast("long"))))
    rows = rows.withColumns({"x": (F.col("ix") + 0.5) * cell, "y": (F.col("iy") + 0.5) * cell})
    return rows.where(in_polygon(polygon)).select("ix", "iy")


def footprint(reference: DataFrame, cell: float, least: int, grow: float, fill: bool = True) -> DataFrame:
    """Cells with enough reference points, with enclosed holes filled, dilated by ceil(grow / cell) cells."""
    steps = -int(-grow // cell)
    kept = grid.with_cell(reference, cell, ["x", "y"], ["ix", "iy"]).groupBy("ix", "iy").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("ix", "iy")
    kept = fill_holes(kept) if fill else kept
    disc = [(a, b) for a in range(-steps, steps + 1) for b in range(-steps, steps + 1) if abs(a) + abs(b) <= steps]
    moves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in disc])
    return kept.select("ix", "iy", F.explode(moves).alias("m")).select((F.col("ix") + F.col("m.a")).alias("ix"), (F.col("iy") + F.col("m.b")).alias("iy")).distinct()


def fill_holes(cells: DataFrame) -> DataFrame:
    """Cells enclosed by others, by their four sides, become part of them.

    Nothing is rasterised: the empty runs between occupied cells of a column are the nodes, runs that touch in neighbouring columns
    are joined, and a component is a hole unless one of its runs lies open to the outside.
    """
    cells = cut(cells.select("ix", "iy").distinct())
    w = W.partitionBy("ix").orderBy("iy")
    runs = cells.withColumn("before", F.lag("iy").over(w)).where(F.col("iy") - F.col("before") > 1).select("ix", (F.col("before") + 1).alias("lo"), (F.col("iy") - 1).alias("hi"))
    runs = cut(runs.withColumn("run", F.monotonically_increasing_id()))
    spans = cells.groupBy("ix").agg(F.min("iy").alias("first"), F.max("iy").alias("last"))
    sides = runs.select("run", "lo", "hi", F.explode(F.array(F.col("ix") - 1, F.col("ix") + 1)).alias("ix"))
    shut = sides.join(spans, "ix", "left")
    open_ = shut.where(F.col("first").isNull() | (F.col("lo") < F.col("first")) | (F.col("hi") > F.col("last"))).select("run").distinct().withColumn("open", F.lit(True))
    b = runs.select("ix", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("run").alias("v"))
    touching = runs.select((F.col("ix") + 1).alias("ix"), "lo", "hi", F.col("run").alias("u")).join(b, "ix").where((F.col("lo") <= F.col("hi2")) & (F.col("lo2") <= F.col("hi"))).select("u", "v")
    leads = connected_leads(touching)
    owner = runs.join(leads, F.col("run") == F.col("node"), "left").select("ix", "lo", "hi", "run", F.coalesce("lead", "run").alias("group")).join(open_, "run", "left")
    holes = owner.join(owner.where("open").select("group").distinct(), "group", "left_anti")
    return cells.union(holes.select("ix", F.explode(F.sequence("lo", "hi")).alias("iy")))


def merge_stations(scans: DataFrame, stations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged cloud, station table) of station scans in their own frames.

    scans: station_id, x, y, z, and other columns that are carried along; stations: id, rotation, origin. Invalid returns (a column
    ``invalid`` above 0, or no finite coordinates) are left out. The table holds what sizes a panorama: points, elevation span and
    farthest return, from the station's own frame. Poses are broadcast behind a check of their number.
    """
    if stations.count() > MAX_STATIONS:
        raise ValueError("too many stations to broadcast")
    own = grid.located(scans)
    own = own.where(F.coalesce(F.col("invalid"), F.lit(0)) == 0).drop("invalid") if "invalid" in own.columns else own
    r = rigid.norm(*grid.XYZ)
    el = F.when(r > 1e-6, F.degrees(F.asin(F.greatest(F.least(F.col("z") / r, F.lit(1.0)), F.lit(-1.0)))))
    table = own.groupBy(F.col("station_id").alias("id")).agg(F.count("*").alias("points"), F.min(el).alias("el_min"), F.max(el).alias("el_max"), F.max(r).alias("max_range"))
    poses = stations.select(F.col("id").alias("station_id"), *[F.col("rotation")[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)], *[F.col("origin")[i].alias(f"t{i}") for i in range(3)])
    m = [[F.col(f"r{i}{j}") for j in range(3)] for i in range(3)]
    world = rigid.apply(m, [F.col(f"t{i}") for i in range(3)], [F.col(c) for c in grid.XYZ])
    rest = [c for c in own.columns if c not in grid.XYZ]
    merged = own.join(F.broadcast(poses), "station_id").select(*[v.alias(c) for v, c in zip(world, grid.XYZ)], *rest)
    return merged, stations.drop("points", "el_min", "el_max", "max_range").join(table, "id", "left")


def proximity_domain(points: DataFrame, cells: DataFrame, cell: float, z_lo: float, z_hi: float, excluded: Column, covered: Column) -> DataFrame:
    """Domain code by z band, footprint, exclusion and coverage, in this order."""
    inside = cells.select("ix", "iy", F.lit(True).alias("inside"))
    rows = grid.with_cell(points, cell, ["x", "y"], ["ix", "iy"]).join(inside, ["ix", "iy"], "left")
    code = F.when(~F.col("z").between(z_lo, z_hi), OUT_Z).when(F.col("inside").isNull(), OUT_FOOTPRINT).when(excluded, EXCLUDED).when(~covered, NO_GT).otherwise(IN_DOMAIN)
    return rows.withColumn("code", code).drop("ix", "iy", "inside")


def density_gate(points: DataFrame, reference: DataFrame, cell: float, percent: float, code: str = "domain_code") -> DataFrame:
    """Adds reference_count, threshold and the gated code: in-domain points in sparse reference voxels become NO_GT.

    The threshold is the percentile of the non-zero counts that in-domain points experience.
    """
    counts = grid.with_cell(reference, cell).groupBy(*grid.CELL).agg(F.count("*").alias("reference_count"))
    seen = grid.with_cell(points, cell).join(counts, grid.CELL, "left").withColumn("reference_count", F.coalesce("reference_count", F.lit(0)))
    limit = seen.where((F.col(code) == IN_DOMAIN) & (F.col("reference_count") > 0)).agg(F.percentile("reference_count", F.lit(percent / 100)).alias("threshold"))
    gated = F.when((F.col(code) == IN_DOMAIN) & (F.col("reference_count") < F.col("threshold")), NO_GT).otherwise(F.col(code))
    return seen.crossJoin(F.broadcast(limit)).withColumn("gated_code", gated.cast("int")).drop(*grid.CELL)  # limit: one row


def composition(df: DataFrame, code: str, classes: int) -> DataFrame:
    """Count and share of every class, absent ones included."""
    counts = df.where(F.col(code).isNotNull()).groupBy(F.col(code).cast("int").alias("code")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(classes).select(F.col("id").cast("int").alias("code"))
    total = counts.agg(F.sum("n").alias("total"))
    return every.join(counts, "code", "left").crossJoin(F.broadcast(total)).select("code", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("n") / F.col("total"), F.lit(0.0)).alias("share"))
