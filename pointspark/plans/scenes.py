"""Queries of geometry, planes, registration, merge and visibility operators that need more than one table's columns, each with an SQL twin.

Eigenvectors have a closed form in SQL: for a symmetric 3 x 3 matrix A with eigenvalues l0 <= l1 <= l2 the projector on the smallest axis is
(A - l1)(A - l2) / ((l0 - l1)(l0 - l2)), so a distance from a fitted plane is the root of a quadratic form.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointspark.functions.missing import finite
from pointspark.operators import grid, merge, places, planes, register, rings, spatial, stats
from pointspark.operators import visibility as vis
from pointspark.plans.reference import D2, FIRST, OUT, PCD, RING, SIDES, TRAJ, XYZ_OK, cells, fin, out_points, poses, pres, ring_points, rounded, scan_points, two_sides
from pointspark.session import cut, table

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


def eigen(source: str, name: str, keep: str) -> str:
    """CTEs from ``source`` with vxx .. vzz to ``name`` with the columns ``keep``, the matrix and l0 <= l1 <= l2."""
    return f"""{name}_q AS (SELECT *, (vxx + vyy + vzz) / 3 AS q, sqrt((power(vxx - (vxx + vyy + vzz) / 3, 2) + power(vyy - (vxx + vyy + vzz) / 3, 2) + power(vzz - (vxx + vyy + vzz) / 3, 2) + 2 * (vxy*vxy + vxz*vxz + vyz*vyz)) / 6) AS p FROM {source}),
{name}_f AS (SELECT *, CASE WHEN p > 0 THEN acos(greatest(-1.0, least(1.0, ((vxx-q)*((vyy-q)*(vzz-q) - vyz*vyz) - vxy*(vxy*(vzz-q) - vyz*vxz) + vxz*(vxy*vyz - (vyy-q)*vxz)) / (2*p*p*p)))) / 3 ELSE 0 END AS phi FROM {name}_q),
{name} AS (SELECT {keep}, vxx, vxy, vxz, vyy, vyz, vzz, q + 2*p*cos(phi + 2*pi()/3) AS l0, 3*q - (q + 2*p*cos(phi)) - (q + 2*p*cos(phi + 2*pi()/3)) AS l1, q + 2*p*cos(phi) AS l2 FROM {name}_f)"""


def projected(x: str, y: str, z: str) -> str:
    """Length of (x, y, z) along the axis of l0, of a row that has the matrix and its eigenvalues."""
    row = lambda a, b, c, d, l: f"(({a} - {l})*({x}) + {b}*({y}) + {c}*({z}))" if d == 0 else f"({b}*({x}) + ({a} - {l})*({y}) + {c}*({z}))" if d == 1 else f"({b}*({x}) + {c}*({y}) + ({a} - {l})*({z}))"  # noqa: E731, E741
    parts = [("vxx", "vxy", "vxz", 0), ("vyy", "vxy", "vyz", 1), ("vzz", "vxz", "vyz", 2)]
    return "sqrt(greatest(0.0, (" + " + ".join(f"{row(*p, 'l1')} * {row(*p, 'l2')}" for p in parts) + ") / nullif((l0 - l1) * (l0 - l2), 0)))"


MOMENTS = "count(*) AS n, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, avg(x*x) - avg(x)*avg(x) AS vxx, avg(x*y) - avg(x)*avg(y) AS vxy, avg(x*z) - avg(x)*avg(z) AS vxz, avg(y*y) - avg(y)*avg(y) AS vyy, avg(y*z) - avg(y)*avg(z) AS vyz, avg(z*z) - avg(z)*avg(z) AS vzz"


def rough_sql(near: str) -> str:
    """CTE ``rough`` (pt_id, r) from a CTE of neighbours relative to their point (pt_id, x, y, z)."""
    return f"{near}_m AS (SELECT pt_id, {MOMENTS} FROM {near} GROUP BY pt_id HAVING count(*) >= 4), {eigen(f'{near}_m', f'{near}_e', 'pt_id, cx, cy, cz')}, {near}_r AS (SELECT pt_id, {projected('cx', 'cy', 'cz')} AS r FROM {near}_e)"


REL = "b.x - a.x AS x, b.y - a.y AS y, b.z - a.z AS z"
BALL = f"{PCD}, thin AS (SELECT min(pt_id) AS pt_id, arg_min(x, pt_id) AS x, arg_min(y, pt_id) AS y, arg_min(z, pt_id) AS z FROM p GROUP BY floor(x / 0.08), floor(y / 0.08), floor(z / 0.08)), ball AS (SELECT a.pt_id, {REL} FROM p a JOIN thin b ON abs(a.x - b.x) < 0.4 AND abs(a.y - b.y) < 0.4 AND abs(a.z - b.z) < 0.4 WHERE {D2} < 0.4 * 0.4 QUALIFY row_number() OVER (PARTITION BY a.pt_id ORDER BY {D2}, b.pt_id) <= 100), {rough_sql('ball')}"
FIXED = f"near AS (SELECT a.pt_id, {REL} FROM p a JOIN p b ON true QUALIFY row_number() OVER (PARTITION BY a.pt_id ORDER BY {D2}, b.pt_id) <= 30), {rough_sql('near')}"


@query(f"WITH {BALL} SELECT p.pt_id, round(r, 4) AS roughness FROM p LEFT JOIN ball_r USING (pt_id)")
def roughness_r040(spark, d):
    return rounded(spatial.roughness(scan_points(spark, d), 0.4, "pt_id"), 4, "roughness")


@query(f"WITH {PCD}, {FIXED} SELECT p.pt_id, round(r, 4) AS roughness FROM p LEFT JOIN near_r USING (pt_id)")
def roughness_k30(spark, d):
    return rounded(spatial.roughness_k(scan_points(spark, d), 30, "pt_id"), 4, "roughness")


NEWER = f"newer AS (SELECT pt_id FROM pcd GROUP BY pt_id HAVING bool_or({fin('intensity_orig')} IS NOT NULL))"


@query(f"""WITH {BALL}, {FIXED}, {NEWER}, far AS (SELECT a.pt_id, sqrt({D2}) AS dist, row_number() OVER (PARTITION BY a.pt_id ORDER BY {D2}, b.pt_id) AS rank FROM p a JOIN p b ON a.pt_id <> b.pt_id QUALIFY rank <= 30),
m AS (SELECT pt_id, avg(dist) FILTER (WHERE rank <= 6) AS k6, avg(dist) AS k30 FROM far GROUP BY pt_id)
SELECT p.pt_id, round(k6, 6) AS mean_knn_dist_k6, round(k30, 6) AS mean_knn_dist_k30, round(near_r.r, 4) AS roughness_k30, round(ball_r.r, 4) AS roughness_r040 FROM p JOIN newer USING (pt_id) LEFT JOIN m USING (pt_id) LEFT JOIN near_r USING (pt_id) LEFT JOIN ball_r USING (pt_id)""")
def geometry_features(spark, d):
    """All scales at once, asked for the newer points only, against the whole cloud."""
    _, newer = two_sides(spark, d)
    g = spatial.geometry_features(scan_points(spark, d), "pt_id", [6, 30], [0.4], [30], newer)
    return rounded(rounded(g, 6, "mean_knn_dist_k6", "mean_knn_dist_k30"), 4, "roughness_k30", "roughness_r040")


# ---- planes -----------------------------------------------------------------------------------------------------

SIZE, LEAST, THICK, RATIO, DEPTH = 4.0, 8, 0.01, 0.05, 3


def _levels() -> str:
    out, rest = [], "p"
    for i in range(DEPTH):
        s = SIZE / 2**i
        out.append(f"c{i} AS (SELECT pt_id, x, y, z, {cells(s)} FROM {rest}), m{i} AS (SELECT ix, iy, iz, {MOMENTS} FROM c{i} GROUP BY ix, iy, iz)")
        out.append(eigen(f"m{i}", f"e{i}", "ix, iy, iz, n, cx, cy, cz"))
        out.append(f"n{i} AS (SELECT {i} AS level, *, n > {LEAST} AND l0 < {THICK} AND l0 < {RATIO} * l2 AS is_plane, {'n > ' + str(LEAST) + ' AND NOT (l0 < ' + str(THICK) + ' AND l0 < ' + str(RATIO) + ' * l2)' if i < DEPTH - 1 else 'false'} AS split FROM e{i})")
        out.append(f"r{i} AS (SELECT pt_id, x, y, z FROM c{i} JOIN n{i} USING (ix, iy, iz) WHERE split)")
        rest = f"r{i}"
    return ", ".join(out) + ", leaves AS (" + " UNION ALL ".join(f"SELECT * FROM n{i} WHERE NOT split" for i in range(DEPTH)) + ")"


LEAVES = f"{PCD}, {_levels()}"


def plane_leaves(spark: SparkSession, d: str) -> DataFrame:
    return planes.plane_map(scan_points(spark, d), SIZE, [LEAST] * DEPTH, THICK, [RATIO] * DEPTH)


@query(f"WITH {LEAVES} SELECT level, ix, iy, iz, n, round(greatest(l0, 0.0), 6) AS l0, round(greatest(l1, 0.0), 6) AS l1, round(l2, 6) AS l2, is_plane FROM leaves")
def plane_map(spark, d):
    """Eigenvalues and verdict of every leaf."""
    return rounded(plane_leaves(spark, d), 6, "l0", "l1", "l2").select("level", *grid.CELL, "n", "l0", "l1", "l2", "is_plane")


@query(f"""WITH {LEAVES}, j AS (SELECT p.pt_id, l.*, p.x - cx AS dx, p.y - cy AS dy, p.z - cz AS dz FROM p JOIN leaves l ON is_plane AND ix = floor(p.x / ({SIZE} / power(2, level))) AND iy = floor(p.y / ({SIZE} / power(2, level))) AND iz = floor(p.z / ({SIZE} / power(2, level)))),
r AS (SELECT pt_id, level, l0, l2, dx*dx + dy*dy + dz*dz AS reach, {projected('dx', 'dy', 'dz')} AS res FROM j) SELECT pt_id, arg_max(level, level) AS level, round(arg_max(res, level), 4) AS residual FROM r WHERE res < 0.15 AND reach - res*res <= 9 * l2 GROUP BY pt_id""")
def plane_matches(spark, d):
    """Each point with the plane of its deepest leaf."""
    m = planes.match_planes(scan_points(spark, d), plane_leaves(spark, d), SIZE, DEPTH, 0.05, "pt_id")
    return rounded(m.select("pt_id", "level", "residual"), 4, "residual")


def _axis() -> str:
    """Normal (nx, ny, nz) of a row with the matrix and its eigenvalues: the projector's column of the largest diagonal entry."""
    a = {"xx": "vxx", "xy": "vxy", "xz": "vxz", "yy": "vyy", "yz": "vyz", "zz": "vzz"}
    at = lambda i, j: a["".join(sorted(i + j))]
    entry = lambda i, j: "(" + " + ".join(f"({at(i, k)}{' - l1' if i == k else ''}) * ({at(k, j)}{' - l2' if k == j else ''})" for k in "xyz") + ") / nullif((l0 - l1) * (l0 - l2), 0)"
    m = ", ".join(f"{entry(i, j)} AS m{i}{j}" for i in "xyz" for j in "xyz")
    pick = lambda i: f"CASE WHEN mxx >= myy AND mxx >= mzz THEN m{i}x / sqrt(mxx) WHEN myy >= mzz THEN m{i}y / sqrt(myy) ELSE m{i}z / sqrt(mzz) END AS n{i}"
    return f"nm AS (SELECT *, {m} FROM leaves WHERE is_plane), pn AS (SELECT level, ix, iy, iz, cx, cy, cz, {pick('x')}, {pick('y')}, {pick('z')} FROM nm)"


@query(f"""WITH RECURSIVE {LEAVES}, {_axis()}, e AS (SELECT row(a.level, a.ix, a.iy, a.iz)::STRUCT(level INTEGER, ix BIGINT, iy BIGINT, iz BIGINT) AS a, row(b.level, b.ix, b.iy, b.iz)::STRUCT(level INTEGER, ix BIGINT, iy BIGINT, iz BIGINT) AS b FROM pn a JOIN pn b ON a.level = b.level AND abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 AND abs(a.iz - b.iz) <= 1
  WHERE (a.ix, a.iy, a.iz) > (b.ix, b.iy, b.iz) AND abs(a.nx*b.nx + a.ny*b.ny + a.nz*b.nz) >= cos(radians(30.0)) AND abs((a.cx-b.cx)*a.nx + (a.cy-b.cy)*a.ny + (a.cz-b.cz)*a.nz) <= 1.0),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), n AS (SELECT row(level, ix, iy, iz)::STRUCT(level INTEGER, ix BIGINT, iy BIGINT, iz BIGINT) AS a FROM pn), r(node, lead) AS (SELECT a, a FROM n UNION SELECT s.b, r.lead FROM r JOIN s ON s.a = r.node WHERE r.lead < s.b), g AS (SELECT node, min(lead) AS lead FROM r GROUP BY node)
SELECT node.level AS level, node.ix AS ix, node.iy AS iy, node.iz AS iz, concat_ws('|', lead.level, lead.ix, lead.iy, lead.iz) AS label FROM g""")
def plane_labels(spark, d):
    """Connected planes of every level."""
    return planes.plane_labels(plane_leaves(spark, d), 30.0, 1.0)


@query(f"""WITH {PCD}, u AS (SELECT {cells(4.0)}, x / sqrt(x*x+y*y+z*z) AS x, y / sqrt(x*x+y*y+z*z) AS y, z / sqrt(x*x+y*y+z*z) AS z FROM p WHERE x*x+y*y+z*z > 0), m AS (SELECT ix, iy, iz, count(*) AS n, avg(x*x) AS vxx, avg(x*y) AS vxy, avg(x*z) AS vxz, avg(y*y) AS vyy, avg(y*z) AS vyz, avg(z*z) AS vzz FROM u GROUP BY ix, iy, iz),
{eigen('m', 'e', 'ix, iy, iz, n')} SELECT ix, iy, iz, n, round(greatest(l0, 0.0), 6) + 0 AS diversity FROM e""")
def cell_view_diversity(spark, d):
    """A17."""
    v = planes.view_diversity(grid.with_cell(scan_points(spark, d), 4.0), grid.CELL, "x", "y", "z")
    return v.select(*grid.CELL, "n", (F.round("diversity", 6) + 0).alias("diversity"))


# ---- merge ------------------------------------------------------------------------------------------------------


@query(f"""WITH {TRAJ}, {FIRST}, w AS (SELECT *, lag(obs) OVER (PARTITION BY cell_id ORDER BY scan_id) AS prev FROM f),
s AS (SELECT cell_id, sum(CASE WHEN obs < prev THEN prev ELSE 0 END) + arg_max(obs, scan_id) AS o, max(vd) AS v, arg_max(tc, (obs, -scan_id)) FILTER (WHERE tc IS NOT NULL) AS t FROM w GROUP BY cell_id)
SELECT DISTINCT pt_id, round(coalesce(o, {fin('obs_count')}), 4) AS obs_count, round(coalesce(v, {fin('view_diversity')}), 6) AS view_diversity, round(coalesce(t, {fin('temp_consistency')}), 6) AS temp_consistency FROM pcd LEFT JOIN s ON s.cell_id = pcd.cell_id""")
def cell_statistics_back(spark, d):
    """Merge-wide statistics put back to the points."""
    p = table(spark, d, "pcd").withColumns({c: finite(c) for c in ("obs_count", "view_diversity", "temp_consistency")})
    out = merge.with_cell_statistics(p, merge.cell_statistics(merge.first_per_cell(table(spark, d, "pcd"))))
    return rounded(rounded(out.select("pt_id", "obs_count", "view_diversity", "temp_consistency"), 4, "obs_count"), 6, "view_diversity", "temp_consistency").distinct()


QUAT = "q AS (SELECT cloud_id, scan_id, t, x AS px, y AS py, z AS pz, qx/n AS a, qy/n AS b, qz/n AS c, qw/n AS w FROM (SELECT *, sqrt(qx*qx + qy*qy + qz*qz + qw*qw) AS n FROM poses WHERE sane))"
WX, WY, WZ = "(1-2*(b*b+c*c))*x + 2*(a*b-c*w)*y + 2*(a*c+b*w)*z + px", "2*(a*b+c*w)*x + (1-2*(a*a+c*c))*y + 2*(b*c-a*w)*z + py", "2*(a*c-b*w)*x + 2*(b*c+a*w)*y + (1-2*(a*a+b*b))*z + pz"


@query(f"""WITH {TRAJ}, {QUAT}, n AS (SELECT *, lead(t) OVER w AS t1, lead(sane) OVER w AS sane1, lead(qx) OVER w AS x1, lead(qy) OVER w AS y1, lead(qz) OVER w AS z1, lead(qw) OVER w AS w1, lead(scan_id) OVER w AS nxt FROM poses WINDOW w AS (PARTITION BY cloud_id ORDER BY scan_id)),
s AS (SELECT *, CASE WHEN t1 - t > 1e-9 AND sane AND sane1 THEN 2 * acos(least(1.0, abs(qx*x1 + qy*y1 + qz*z1 + qw*w1) / (sqrt(qx*qx+qy*qy+qz*qz+qw*qw) * sqrt(x1*x1+y1*y1+z1*z1+w1*w1)))) / (t1 - t) END AS step FROM n),
ch AS (SELECT scan_id, sqrt(({fin('v6_0')} + {fin('v6_1')} + {fin('v6_2')}) / 3) AS unc, CASE WHEN nxt IS NULL THEN lag(step) OVER (PARTITION BY cloud_id ORDER BY scan_id) ELSE step END AS rate FROM s)
SELECT pt_id, round({WX}, 5) AS x, round({WY}, 5) AS y, round({WZ}, 5) AS z, round(sqrt(x*x + y*y + z*z), 5) AS range, round(unc, 9) AS pose_unc_rot, round(rate, 5) AS ang_rate FROM (SELECT DISTINCT pt_id, scan_id, x, y, z FROM pcd WHERE {XYZ_OK}) JOIN q USING (scan_id) LEFT JOIN ch USING (scan_id)""")
def merged_cloud(spark, d):
    """The merge driver's points with their per-scan channels."""
    p = grid.located(table(spark, d, "pcd"))
    out = merge.merge_clouds(p, poses(spark, d))
    return rounded(rounded(out.select("pt_id", "x", "y", "z", "range", "pose_unc_rot", "ang_rate"), 5, "x", "y", "z", "range", "ang_rate"), 9, "pose_unc_rot").distinct()


@query(f"""WITH {TRAJ}, {QUAT}, r AS (SELECT *, (row_number() OVER (PARTITION BY cloud_id ORDER BY scan_id) - 1) // 5 AS run FROM q), l AS (SELECT cloud_id, run, max(scan_id) AS keyframe FROM r GROUP BY ALL HAVING count(*) = 5),
k AS (SELECT l.*, px AS kx, py AS ky, pz AS kz, a AS ka, b AS kb, c AS kc, w AS kw FROM l JOIN q ON q.scan_id = keyframe),
g AS (SELECT r.cloud_id, keyframe, pt_id, {WX} - kx AS dx, {WY} - ky AS dy, {WZ} - kz AS dz, ka, kb, kc, kw FROM (SELECT DISTINCT pt_id, scan_id, x, y, z FROM pcd WHERE {XYZ_OK}) p JOIN r USING (scan_id) JOIN k ON k.cloud_id = r.cloud_id AND k.run = r.run),
o AS (SELECT cloud_id, keyframe, pt_id, (1-2*(kb*kb+kc*kc))*dx + 2*(ka*kb+kc*kw)*dy + 2*(ka*kc-kb*kw)*dz AS x, 2*(ka*kb-kc*kw)*dx + (1-2*(ka*ka+kc*kc))*dy + 2*(kb*kc+ka*kw)*dz AS y, 2*(ka*kc+kb*kw)*dx + 2*(kb*kc-ka*kw)*dy + (1-2*(ka*ka+kb*kb))*dz AS z FROM g)
SELECT cloud_id, keyframe, count(*) AS n, round(sum(x) / count(*), 3) AS x, round(sum(y) / count(*), 3) AS y FROM (SELECT cloud_id, keyframe, avg(x) AS x, avg(y) AS y FROM o GROUP BY cloud_id, keyframe, floor(x / 0.5), floor(y / 0.5), floor(z / 0.5)) GROUP BY cloud_id, keyframe""")
def previous_map(spark, d):
    """Keyframes of five scans from an earlier session, thinned by voxels."""
    p = grid.located(table(spark, d, "pcd")).select("pt_id", "scan_id", "x", "y", "z").distinct()
    k = merge.keyframe_clouds(p, poses(spark, d), 5, 0.5, "pt_id")
    return rounded(k.groupBy("cloud_id", "keyframe").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y")), 3, "x", "y")


@query(f"""WITH {TRAJ}, {QUAT}, n AS (SELECT scan_id, a, b, c, w, lead(a) OVER o AS a1, lead(b) OVER o AS b1, lead(c) OVER o AS c1, lead(w) OVER o AS w1, lead(px) OVER o - px AS ex, lead(py) OVER o - py AS ey, lead(pz) OVER o - pz AS ez, lead(t) OVER o - t AS dt FROM q WINDOW o AS (PARTITION BY cloud_id ORDER BY scan_id)),
r AS (SELECT scan_id, dt, w*a1 - a*w1 - b*c1 + c*b1 AS rx, w*b1 + a*c1 - b*w1 - c*a1 AS ry, w*c1 - a*b1 + b*a1 - c*w1 AS rz, w*w1 + a*a1 + b*b1 + c*c1 AS rw, (1-2*(b*b+c*c))*ex + 2*(a*b+c*w)*ey + 2*(a*c-b*w)*ez AS d0, 2*(a*b-c*w)*ex + (1-2*(a*a+c*c))*ey + 2*(b*c+a*w)*ez AS d1, 2*(a*c+b*w)*ex + 2*(b*c-a*w)*ey + (1-2*(a*a+b*b))*ez AS d2 FROM n WHERE dt > 1e-9),
m AS (SELECT *, sqrt(rx*rx+ry*ry+rz*rz) AS s, CASE WHEN rw < 0 THEN -1 ELSE 1 END AS sg FROM r), k AS (SELECT scan_id, dt, d0, d1, d2, 2*atan2(s, abs(rw)) AS an, CASE WHEN s > 1e-12 THEN sg*rx/s ELSE 0 END AS k0, CASE WHEN s > 1e-12 THEN sg*ry/s ELSE 0 END AS k1, CASE WHEN s > 1e-12 THEN sg*rz/s ELSE 0 END AS k2 FROM m),
v AS (SELECT DISTINCT pt_id, scan_id, x, y, z, coalesce({fin('scan_time')}, 0) AS st FROM pcd WHERE {XYZ_OK}), j AS (SELECT v.*, k.* EXCLUDE (scan_id), st / dt - 1 AS u FROM v LEFT JOIN k ON k.scan_id = v.scan_id)
SELECT pt_id, round(CASE WHEN dt IS NULL THEN x ELSE x*cos(u*an) + (k1*z - k2*y)*sin(u*an) + k0*(k0*x+k1*y+k2*z)*(1-cos(u*an)) + u*(d0*cos(an) - (k1*d2 - k2*d1)*sin(an) + k0*(k0*d0+k1*d1+k2*d2)*(1-cos(an))) END, 5) AS x,
round(CASE WHEN dt IS NULL THEN z ELSE z*cos(u*an) + (k0*y - k1*x)*sin(u*an) + k2*(k0*x+k1*y+k2*z)*(1-cos(u*an)) + u*(d2*cos(an) - (k0*d1 - k1*d0)*sin(an) + k2*(k0*d0+k1*d1+k2*d2)*(1-cos(an))) END, 5) AS z FROM j""")
def deskewed(spark, d):
    """The points of each scan moved by the motion between its pose and the next."""
    p = grid.located(table(spark, d, "pcd")).select("pt_id", "scan_id", "x", "y", "z", F.coalesce(finite("scan_time"), F.lit(0.0)).alias("scan_time")).distinct()
    return rounded(merge.deskew(p, poses(spark, d)).select("pt_id", "x", "z"), 5, "x", "z")


@query(f"WITH {RING}, k AS (SELECT scene, ring, col, CASE WHEN rl + rr IS NULL THEN 0 ELSE least(rl, rr) / sc END AS detach, CASE WHEN rl + rr IS NULL THEN 0 ELSE greatest(rl, rr) / sc END AS edge FROM s), a AS (SELECT scene, point_id, CAST(floor({pres('ring')} / 16) AS INTEGER) AS ring, CAST(floor((atan2(y, x) + pi()) / (2 * pi()) * 24) AS INTEGER) % 24 AS col FROM global_pcd_converter WHERE {XYZ_OK} AND {pres('ring')} >= 0) SELECT a.scene, point_id, round(coalesce(detach, 0), 5) AS detach, round(coalesce(edge, 0), 5) AS edge FROM a LEFT JOIN k ON k.scene = a.scene AND k.ring = a.ring AND k.col = a.col")
def ring_detach_points(spark, d):
    """Every point with its cell's figures."""
    p = ring_points(spark, d)
    s = rings.scatter(p, rings.ring_features(rings.lattice(p, ["scene"], "range", "range", "point_id"), ["scene"], 24), ["scene"])
    return rounded(s.select("scene", "point_id", "detach", "edge"), 5, "detach", "edge")


# ---- visibility -------------------------------------------------------------------------------------------------

@query(f"""WITH {OUT}, m AS (SELECT o.point_id, s.station_id, o.x, o.y, o.z, rotation AS r, origin[1] AS t1, o.x - origin[1] AS dx, o.y - origin[2] AS dy, o.z - origin[3] AS dz FROM o JOIN station s ON s.scene = o.scene),
l AS (SELECT *, r[1][1]*dx + r[2][1]*dy + r[3][1]*dz AS a, r[1][2]*dx + r[2][2]*dy + r[3][2]*dz AS b, r[1][3]*dx + r[2][3]*dy + r[3][3]*dz AS c FROM m), g AS (SELECT *, sqrt(a*a+b*b+c*c) AS rng FROM l)
SELECT station_id, count(*) AS points, round(min(CASE WHEN rng > 1e-6 THEN degrees(asin(greatest(-1.0, least(1.0, c / rng)))) END), 4) AS el_min, round(max(CASE WHEN rng > 1e-6 THEN degrees(asin(greatest(-1.0, least(1.0, c / rng)))) END), 4) AS el_max, round(max(rng), 4) AS max_range, round(avg(r[1][1]*a + r[1][2]*b + r[1][3]*c + t1), 3) AS x FROM g GROUP BY station_id""")
def stations_merged(spark, d):
    """Every point as a return of every station of its scene, in the station's frame, merged back into the project frame."""
    s = table(spark, d, "station")
    seen = out_points(spark, d).select("point_id", "scene", "x", "y", "z").join(F.broadcast(vis.station_matrix(s)), "scene")
    local = [v.alias(c) for v, c in zip(vis._local(), grid.XYZ)]
    scans = seen.select("station_id", "point_id", *local, F.lit(0).alias("invalid"))
    merged, about = vis.merge_stations(scans, s.withColumnRenamed("station_id", "id"))
    x = merged.groupBy("station_id").agg(F.avg("x").alias("x"))
    return rounded(rounded(about.join(x, F.col("id") == F.col("station_id")).select("station_id", "points", "el_min", "el_max", "max_range", "x"), 4, "el_min", "el_max", "max_range"), 3, "x")


@query(f"WITH {SIDES}, f AS (SELECT a.pt_id, sqrt(min({D2})) AS full_d, sqrt(min({D2}) FILTER (WHERE b.z < 1)) AS crop_d FROM (SELECT * FROM e WHERE NOT n) a LEFT JOIN (SELECT * FROM e WHERE n) b ON {D2} < 0.25 GROUP BY a.pt_id) SELECT pt_id, coalesce(full_d < coalesce(crop_d, 0.5) - 0.05, false) AS cropped FROM f")
def cropped_away(spark, d):
    """L4: the true surface is nearer than anything that a crop at z < 1 left."""
    old, new = two_sides(spark, d)
    full = spatial.nearest_capped(old, new, 0.5, "pt_id", "pt_id").withColumnRenamed("distance", "full")
    crop = spatial.nearest_capped(old, new.where("z < 1"), 0.5, "pt_id", "pt_id")
    return full.join(crop, "pt_id").select("pt_id", vis.cropped_away(F.coalesce("distance", F.lit(0.5)), F.col("full"), 0.05).alias("cropped"))


@query(f"SELECT DISTINCT pt_id FROM pcd WHERE {XYZ_OK} AND x BETWEEN -61 AND 61 AND y BETWEEN -51 AND 51 AND z BETWEEN -16 AND 16")
def box_prefilter(spark, d):
    """P9."""
    return grid.in_box(grid.located(table(spark, d, "pcd")), (-60.0, -50.0, -15.0), (60.0, 50.0, 15.0), 1.0).select("pt_id").distinct()


# ---- registration -----------------------------------------------------------------------------------------------

TURN = np.radians(3.0)
MOVE = np.array([[np.cos(TURN), -np.sin(TURN), 0, 0.2], [np.sin(TURN), np.cos(TURN), 0, -0.1], [0, 0, 1, 0.05], [0, 0, 0, 1]])
MX, MY, MZ = "cos(radians(3.0))*x - sin(radians(3.0))*y + 0.2", "sin(radians(3.0))*x + cos(radians(3.0))*y - 0.1", "z + 0.05"


@query("SELECT round(3.0, 6) AS degrees, round(max(sqrt(power(a, 2) + power(b, 2) + 0.0025)), 6) AS shift FROM (SELECT cos(radians(3.0))*x - sin(radians(3.0))*y + 0.2 - x AS a, sin(radians(3.0))*x + cos(radians(3.0))*y - 0.1 - y AS b FROM (SELECT unnest([-20.0, 30.0]) AS x) q, (SELECT unnest([-10.0, 40.0]) AS y) r)")
def transform_delta(spark, d):
    """Rotation angle and largest shift of a box's corners."""
    turn, shift = stats.transform_delta(np.eye(4), MOVE, (-20.0, -10.0, -5.0), (30.0, 40.0, 5.0))
    return spark.createDataFrame([(round(turn, 6), round(shift, 6))], "degrees double, shift double")


@query(f"WITH {PCD}, s AS (SELECT sqrt(power({MX} - x, 2) + power({MY} - y, 2) + power({MZ} - z, 2)) AS d FROM p) SELECT count(*) AS n, round(quantile_cont(d, 0.95), 6) AS p95, round(max(d), 6) AS largest FROM s")
def pose_delta(spark, d):
    """Shift of the points themselves."""
    p = scan_points(spark, d)
    moved = register.transform(p.select("pt_id", "x", "y", "z"), MOVE).select("pt_id", *[F.col(c).alias(f"m{c}") for c in grid.XYZ])
    out = stats.pose_delta(p.join(moved, "pt_id"), [F.col(c) for c in grid.XYZ], [F.col(f"m{c}") for c in grid.XYZ])
    return rounded(out.select("n", "p95", "largest"), 6, "p95", "largest")


AXES = "CASE CAST(floor(x) AS BIGINT) & 1 WHEN 0 THEN 1.0 ELSE 0.0 END AS nx, CASE CAST(floor(x) AS BIGINT) & 1 WHEN 0 THEN 0.0 ELSE 1.0 END AS nz"


def _with_normals(df: DataFrame) -> DataFrame:
    even = F.floor("x").cast("long").bitwiseAND(F.lit(1)) == 0
    return df.withColumns({"nx": F.when(even, 1.0).otherwise(0.0), "ny": F.lit(0.0), "nz": F.when(even, 0.0).otherwise(1.0)})


@query(f"WITH {SIDES}, m AS (SELECT a.pt_id, arg_min(b.pt_id, ({D2}, b.pt_id)) AS target FROM (SELECT * FROM e WHERE NOT n) a JOIN (SELECT * FROM e WHERE n) b ON {D2} < 0.25 GROUP BY a.pt_id) SELECT m.pt_id, target, b.x AS t_x, CASE CAST(floor(b.x) AS BIGINT) & 1 WHEN 0 THEN 1.0 ELSE 0.0 END AS nx FROM m JOIN e b ON b.pt_id = target")
def correspondences(spark, d):
    """Source points with their nearest target and its normal."""
    old, new = two_sides(spark, d)
    m = register.matched(old, _with_normals(new), 0.5, "pt_id", "pt_id")
    return m.select(F.col("a_id").alias("pt_id"), F.col("b_id").alias("target"), "t_x", "nx")


@query(f"""WITH {SIDES}, k AS (SELECT pt_id, n, x, y, z, {AXES} FROM e), m AS (SELECT a.pt_id AS s, arg_min(b.pt_id, ({D2}, b.pt_id)) AS t FROM (SELECT * FROM k WHERE NOT n) a JOIN (SELECT * FROM k WHERE n) b ON {D2} < 4.0 GROUP BY a.pt_id),
h AS (SELECT count(*) FILTER (WHERE abs(a.nx*b.nx + a.nz*b.nz) >= 0.9 AND abs((a.x-b.x)*b.nx + (a.z-b.z)*b.nz) <= 0.3) AS matched FROM m JOIN k a ON a.pt_id = s JOIN k b ON b.pt_id = t) SELECT matched, (SELECT count(*) FROM k WHERE NOT n) AS source, round(matched / (SELECT count(*) FROM k WHERE NOT n), 6) AS score FROM h""")
def plane_verification(spark, d):
    """Share of source planes whose nearest target agrees."""
    old, new = two_sides(spark, d)
    return rounded(places.plane_score(_with_normals(old), _with_normals(new), 2.0, 0.9, 0.3, "pt_id"), 6, "score")


@query(f"""WITH {SIDES}, s AS (SELECT pt_id, x, y, z, CASE WHEN x >= 0 THEN 1 ELSE 2 END AS gt_group, CASE WHEN y >= 0 THEN 1 ELSE 2 END AS stretch_id FROM e WHERE NOT n),
t AS (SELECT pt_id, stretch_id, gt_group = 1 AND stretch_id = 1 AS own, CASE WHEN gt_group = 1 AND stretch_id = 1 THEN x + 0.1 ELSE x END AS x, CASE WHEN gt_group = 2 THEN y + 0.05 ELSE y END AS y, z FROM s),
f AS (SELECT a.pt_id, sqrt(min({D2})) AS dist FROM t a JOIN (SELECT * FROM e WHERE n) b ON {D2} < 0.25 GROUP BY a.pt_id) SELECT t.pt_id, t.stretch_id, own, round(coalesce(dist, 0.5), 6) AS c2c FROM t LEFT JOIN f USING (pt_id)""")
def stretches_relabelled(spark, d):
    """A stretch with a transform of its own, one whose shift is beyond the limit, and groups' own transforms."""
    old, new = two_sides(spark, d)
    points = old.select("pt_id", "x", "y", "z", F.when(F.col("x") >= 0, 1).otherwise(2).alias("gt_group"), F.when(F.col("y") >= 0, 1).otherwise(2).alias("stretch_id"))
    m = lambda x, y: [1.0, 0.0, 0.0, x, 0.0, 1.0, 0.0, y, 0.0, 0.0, 1.0, 0.0]
    moves = spark.createDataFrame([(1, None, m(0.0, 0.0), 0.0, 0.0), (2, None, m(0.0, 0.05), 0.0, 0.0), (1, 1, m(0.1, 0.0), 0.1, 0.0), (1, 2, m(3.0, 0.0), 3.0, 0.0)], "gt_group int, stretch_id int, m array<double>, shift double, turn double")
    return rounded(register.relabel_stretches(points, moves, new, 0.5, "pt_id", "pt_id", least_points=1), 6, "c2c")


def _room(spark: SparkSession) -> DataFrame:
    """A room with a pillar, with normals: the same cloud in any partitioning."""
    i = F.col("id")
    u, v = (i % 40) * 0.25, F.floor(i / 40) * 0.25
    face = lambda n, x, y, z, nx, ny, nz: spark.range(n).select(x.alias("x"), y.alias("y"), z.alias("z"), F.lit(nx).alias("nx"), F.lit(ny).alias("ny"), F.lit(nz).alias("nz"))
    zero = F.lit(0.0)
    rows = face(1600, u, v, zero, 0.0, 0.0, 1.0).union(face(480, u, zero, v, 0.0, 1.0, 0.0)).union(face(480, zero, u, v, 1.0, 0.0, 0.0))
    rows = rows.union(face(480, F.lit(6.0) + (i % 8) * 0.1, F.lit(3.0), F.floor(i / 8) * 0.05, 0.0, 1.0, 0.0)).union(face(480, F.lit(6.0), F.lit(3.0) + (i % 8) * 0.1, F.floor(i / 8) * 0.05, 1.0, 0.0, 0.0))
    # ids from the coordinates, so that every evaluation gives the same ones
    return rows.distinct().withColumn("k", F.xxhash64("x", "y", "z", "nx", "ny", "nz"))


def _close(m: np.ndarray, degrees: float, metres: float) -> bool:
    turn, shift = stats.transform_delta(np.eye(4), m @ MOVE)
    return turn < degrees and shift < metres


@query("SELECT * FROM (VALUES ('coarse start', true), ('candidate by short fit', true), ('multiscale registration', true), ('rounds of mask and registration', true), ('yaw peaks apart', true)) v(step, recovered)")
def registration(spark, d):
    """A room moved by a known transform is brought back."""
    target = cut(_room(spark))
    source = cut(register.transform(target.select("k", "x", "y", "z"), MOVE))
    levels = [(0.4, 0.8), (0.2, 0.4), (0.1, 0.2)]
    starts = register.coarse_align(source, target, 0.25, (0.5, 3.0), 3, 3.0, peaks=2, apart=20.0)
    coarse = _close(starts[0], 4.0, 1.0)
    yaw = [np.degrees(np.arctan2(s[1, 0], s[0, 0])) for s in starts]
    best = register.best_start(source, target, [np.eye(4), starts[0]], levels[0], "k", "k")
    fine, fitness = register.icp(source, target, levels, "k", "k", best)
    align = lambda p: register.icp(p, target, levels[1:], "k", "k")[0]
    again = register.rounds(source, lambda p: p.where(F.col("z") < 2.5), align, best)
    got = [("coarse start", coarse), ("candidate by short fit", _close(best, 3.0, 0.4)), ("multiscale registration", _close(fine, 0.05, 0.005) and fitness > 0.99), ("rounds of mask and registration", _close(again, 0.05, 0.005)), ("yaw peaks apart", len(yaw) == 2 and abs((yaw[0] - yaw[1] + 180) % 360 - 180) > 20)]
    return spark.createDataFrame([(a, bool(b)) for a, b in got], "step string, recovered boolean")


# ---- states -----------------------------------------------------------------------------------------------------


@query(f"""WITH {PCD}, k AS (SELECT {cells(8.0)}, x, y, z, x >= 0 AND y < 0 AS off FROM p), m AS (SELECT ix, iy, iz, {MX} AS x, {MY} AS y, {MZ} AS z FROM k WHERE NOT off), c AS (SELECT ix, iy, iz, {MOMENTS} FROM m GROUP BY ix, iy, iz)
SELECT ix, iy, iz, n, round(cx, 5) AS cx, round(cz, 5) AS cz, round(vxx, 4) + 0 AS vxx, round(vxy, 4) + 0 AS vxy, round(vyz, 4) + 0 AS vyz FROM c""")
def cluster_algebra(spark, d):
    """Clusters less the points of a quarter, then transformed, from their sums alone."""
    p = grid.with_cell(scan_points(spark, d), 8.0)
    left = grid.subtract_clusters(grid.point_clusters(p, grid.CELL), grid.point_clusters(p.where("x >= 0 and y < 0"), grid.CELL), grid.CELL)
    c = grid.covariance(grid.transform_clusters(left, MOVE.tolist()))
    return c.select(*grid.CELL, "n", F.round("cx", 5).alias("cx"), F.round("cz", 5).alias("cz"), *[(F.round(v, 4) + 0).alias(v) for v in ("vxx", "vxy", "vyz")])


STATE = f"""one AS (SELECT cloud_id, scan_id, arg_min(row(t, x, y, z, vx, vy, vz, gx, gy, gz, bgx, bgy, bgz)::STRUCT(t DOUBLE, x DOUBLE, y DOUBLE, z DOUBLE, vx DOUBLE, vy DOUBLE, vz DOUBLE, gx DOUBLE, gy DOUBLE, gz DOUBLE, bgx DOUBLE, bgy DOUBLE, bgz DOUBLE), (received_at, coalesce(t, 0), coalesce(x, 0), coalesce(y, 0), coalesce(z, 0))) AS r FROM trajectory GROUP BY ALL),
st AS (SELECT cloud_id, scan_id, r.* FROM one)"""


@query(f"""WITH {STATE}, s AS (SELECT * FROM st WHERE {" AND ".join(f"coalesce(isfinite({c}), false)" for c in ("gx", "gy", "gz", "bgx", "bgy", "bgz"))} QUALIFY row_number() OVER (PARTITION BY cloud_id ORDER BY scan_id) <= 10),
m AS (SELECT cloud_id, count(*) AS n, avg(-gx) AS a, avg(-gy) AS b, avg(-gz) AS c, avg(bgx) AS w FROM s GROUP BY cloud_id) SELECT cloud_id, n, round(-a * 9.81 / sqrt(a*a+b*b+c*c), 6) AS g0, round(-c * 9.81 / sqrt(a*a+b*b+c*c), 6) AS g2, round(w, 9) AS b0 FROM m""")
def static_start(spark, d):
    """Gravity and bias from the first samples of each session."""
    t = merge.one_per_scan(table(spark, d, "trajectory"))
    samples = t.select("cloud_id", "scan_id", *[(-F.col(c)).alias(f"a{i}") for i, c in enumerate(("gx", "gy", "gz"))], *[F.col(c).alias(f"w{i}") for i, c in enumerate(("bgx", "bgy", "bgz"))])
    s = merge.static_start(samples, ["cloud_id"], "scan_id", 10)
    return s.select("cloud_id", "n", F.round("g0", 6).alias("g0"), F.round("g2", 6).alias("g2"), F.round("b0", 9).alias("b0"))


@query(f"""WITH {STATE}, f AS (SELECT cloud_id, arg_min({{'a': gx, 'b': gy, 'c': gz}}, scan_id) AS g FROM st WHERE coalesce(isfinite(gx) AND isfinite(gy) AND isfinite(gz), false) AND gx*gx+gy*gy+gz*gz > 0 GROUP BY cloud_id),
n AS (SELECT cloud_id, g.a / sqrt(g.a*g.a+g.b*g.b+g.c*g.c) AS a, g.b / sqrt(g.a*g.a+g.b*g.b+g.c*g.c) AS b, CASE WHEN g.c < 0 THEN -1 ELSE 1 END AS up FROM f), k AS (SELECT cloud_id, sqrt(a*a+b*b) AS s, CASE WHEN a*a+b*b > 0 THEN b*up / sqrt(a*a+b*b) ELSE 0 END AS kx, CASE WHEN a*a+b*b > 0 THEN -a*up / sqrt(a*a+b*b) ELSE 0 END AS ky FROM n),
r AS (SELECT *, asin(least(s, 1.0)) AS an FROM k) SELECT st.cloud_id, scan_id, round({fin('(cos(an) + kx*kx*(1-cos(an)))*x + kx*ky*(1-cos(an))*y + ky*sin(an)*z')}, 4) AS x, round({fin('-ky*sin(an)*x + kx*sin(an)*y + cos(an)*z')}, 4) AS z, round({fin('(cos(an) + kx*kx*(1-cos(an)))*gx + kx*ky*(1-cos(an))*gy + ky*sin(an)*gz')}, 6) + 0 AS gx FROM st JOIN r ON r.cloud_id = st.cloud_id""")
def gravity_aligned(spark, d):
    """Sessions turned upright."""
    a = merge.align_gravity(merge.one_per_scan(table(spark, d, "trajectory")))
    return a.select("cloud_id", "scan_id", F.round(finite("x"), 4).alias("x"), F.round(finite("z"), 4).alias("z"), (F.round(finite("gx"), 6) + 0).alias("gx"))


@query(f"""WITH {TRAJ}, v AS (SELECT cloud_id, scan_id, arg_min(row(vx, vy)::STRUCT(vx DOUBLE, vy DOUBLE), (received_at, coalesce(t, 0), coalesce(x, 0), coalesce(y, 0), coalesce(z, 0))) AS v FROM trajectory GROUP BY ALL), w AS (SELECT cloud_id, (min(scan_id) + max(scan_id)) // 2 AS half FROM poses WHERE sane GROUP BY cloud_id),
j AS (SELECT p.*, v.v.vx AS vx, v.v.vy AS vy, scan_id >= half AS new FROM poses p JOIN v USING (cloud_id, scan_id) JOIN w USING (cloud_id) WHERE sane)
SELECT scan_id, round(CASE WHEN new THEN {MX} ELSE x END, 5) AS x, round(CASE WHEN new THEN {MY} ELSE y END, 5) AS y, round({fin('CASE WHEN new THEN cos(radians(3.0))*vx - sin(radians(3.0))*vy ELSE vx END')}, 5) AS vx,
round(CASE WHEN new THEN cos(radians(1.5))*qz + sin(radians(1.5))*qw ELSE qz END, 6) AS qz, round(CASE WHEN new THEN cos(radians(1.5))*qx - sin(radians(1.5))*qy ELSE qx END, 6) AS qx FROM j""")
def loop_corrected(spark, d):
    """From the middle of each session on, states follow a loop's correction."""
    p = poses(spark, d).where("sane")
    at = p.groupBy("cloud_id").agg(F.floor((F.min("scan_id") + F.max("scan_id")) / 2).alias("from_scan"))
    fix = at.withColumn("m", F.array(*[F.lit(float(v)) for v in MOVE[:3].ravel()]))
    c = merge.apply_correction(p, fix)
    return c.select("scan_id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), F.round(finite("vx"), 5).alias("vx"), F.round("qz", 6).alias("qz"), F.round("qx", 6).alias("qx"))


@query(f"""WITH {STATE}, g AS (SELECT cloud_id, t, vx, vz FROM st WHERE {" AND ".join(f"coalesce(isfinite({c}), false)" for c in ("t", "vx", "vy", "vz"))}), s AS (SELECT cloud_id, t, lead(t) OVER w - t AS dt, (vx + lead(vx) OVER w) / 2 AS ax, (vz + lead(vz) OVER w) / 2 AS az FROM g WINDOW w AS (PARTITION BY cloud_id ORDER BY t)),
k AS (SELECT *, coalesce(sum(ax * dt) OVER (PARTITION BY cloud_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS v0 FROM s WHERE dt > 0) SELECT cloud_id, count(*) AS steps, round(sum(dt), 5) AS seconds, round(sum(ax * dt) / sum(dt), 6) + 0 AS vx, round(sum(az * dt) / sum(dt), 6) + 0 AS vz, round(sum(v0 * dt + ax * dt * dt / 2) / power(sum(dt), 2), 5) + 0 AS px FROM k GROUP BY cloud_id""")
def preintegrated(spark, d):
    """X11: whole sessions as intervals without rotation, the velocities standing in for accelerations (no table holds inertial samples)."""
    from pointspark.operators.inertial import preintegrate

    t = merge.one_per_scan(table(spark, d, "trajectory"))
    samples = t.select("cloud_id", "t", *[F.lit(0.0).alias(f"w{i}") for i in range(3)], *[F.col(c).alias(f"a{i}") for i, c in enumerate(("vx", "vy", "vz"))])
    p = preintegrate(samples, ["cloud_id"])
    s = F.col("seconds")
    return p.select("cloud_id", "steps", F.round(s, 5).alias("seconds"), (F.round(F.col("v")[0] / s, 6) + 0).alias("vx"), (F.round(F.col("v")[2] / s, 6) + 0).alias("vz"), (F.round(F.col("p")[0] / s**2, 5) + 0).alias("px"))
