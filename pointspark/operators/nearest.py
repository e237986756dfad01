"""The k nearest others of every point, over the whole table or within a margin, among its own or another cloud.

A k-d tree fitted on a bounded sample splits space into leaves. A point's k-th distance within its own leaf bounds the search
(radius); the point is then sent to every leaf that this ball touches, its own included, and the nearest k of what comes back
are kept. Of many points at one place only the k + 1 smallest ids can be anybody's neighbours, so only they are indexed. Leaves are cut by
counts, so a crowded place costs no more than an empty one; a margin only shortens the search radius.

Leaves hold about LEAF_ROWS rows up to SAMPLE_ROWS / SAMPLE_PER_LEAF leaves (6.4 million points); beyond that they grow with the
data, and the sample bound has to be raised with them. Distances are computed in blocks of PAIRS_AT_ONCE.

Defined cases: ids are integers and count once (the smallest coordinates, should their rows differ); rows without finite
coordinates take no part; -0.0 equals 0.0; ties are broken by the smaller id; with fewer than k other points all are neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pointspark.operators import grid
from pointspark.session import cut, shuffle_partitions

LEAF_ROWS, SAMPLE_ROWS, SAMPLE_PER_LEAF = 2048, 200_000, 64
PAIRS_AT_ONCE = 1_000_000
#: Slack for the rounding of square roots.
SLACK = 1e-9


class Tree:
    """Half-space splits at medians of a sample; the leaves cover all of space."""

    def __init__(self, sample: np.ndarray, leaves: int) -> None:
        self.dim, self.at, self.left, self.right, self.leaf, self.leaves = [], [], [], [], [], 0
        self._grow(sample, leaves)

    def _grow(self, rows: np.ndarray, leaves: int) -> int:
        node = len(self.dim)
        for a in (self.dim, self.at, self.left, self.right, self.leaf):
            a.append(-1)
        d = int(np.argmax(np.ptp(rows, axis=0))) if len(rows) else 0
        if leaves <= 1 or len(rows) < 2 or np.ptp(rows[:, d]) == 0:
            self.leaf[node] = self.leaves
            self.leaves += 1
            return node
        v = rows[:, d]
        at = float(np.median(v))
        if not (v < at).any():
            at = float(v[v > v.min()].min())
        self.dim[node], self.at[node] = d, at
        self.left[node] = self._grow(rows[v < at], leaves // 2)
        self.right[node] = self._grow(rows[v >= at], leaves - leaves // 2)
        return node

    def reach(self, p: np.ndarray, r: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(index, leaf) of all leaves that the closed ball around each point touches; without r, of its own leaf."""
        dim, at, left, right, leaf = (np.array(a) for a in (self.dim, self.at, self.left, self.right, self.leaf))
        q, node, out = np.arange(len(p)), np.zeros(len(p), dtype=np.int64), []
        while len(q):
            end = leaf[node] >= 0
            out.append((q[end], leaf[node[end]]))
            q, node = q[~end], node[~end]
            side = p[q, dim[node]] - at[node]
            low, high = (side < 0, side >= 0) if r is None else (side < r[q], side >= -r[q])
            q, node = np.concatenate([q[low], q[high]]), np.concatenate([left[node[low]], right[node[high]]])
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int))


def _xyz(t: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.column_stack([t.column(c).to_numpy() for c in grid.XYZ])


def _squares(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row of a, squared distances) by blocks of rows of a, summed in the order of ``grid.halo_join``."""
    step = max(1, PAIRS_AT_ONCE // max(1, len(b)))
    for i in range(0, len(a), step):
        x, y, z = (a[i : i + step, j, None] - b[None, :, j] for j in range(3))
        yield i, x * x + y * y + z * z


def _one_per_id(points: DataFrame, item: str) -> DataFrame:
    # adding 0.0 turns -0.0 into 0.0, so that equal places have equal keys
    place = F.struct(*[(F.col(c).cast("double") + F.lit(0.0)).alias(c) for c in grid.XYZ])
    return cut(grid.located(points).where(F.col(item).isNotNull()).groupBy(F.col(item).cast("long").alias("a_id")).agg(F.min(place).alias("p")).select("a_id", "p.*"))


def nearest(points: DataFrame, k: int, item: str, margin: float | None = None, reference: DataFrame | None = None, reference_item: str | None = None, others_only: bool = True) -> DataFrame:
    """(a_id, b_id, d2, rank): the k nearest of every point, closer than ``margin`` if given.

    They are looked for among ``reference``, else among the points themselves; with ``others_only`` a point of the same id isn't one.
    """
    spark, own = points.sparkSession, reference is None
    rows = _one_per_id(points, item)
    targets = rows if own else _one_per_id(reference, reference_item or item)
    entries = cut(targets.withColumn("copy", F.row_number().over(W.partitionBy(*grid.XYZ).orderBy("a_id"))).where(F.col("copy") <= k + 1).drop("copy"))
    asking, others = rows, None
    if own:  # the copies that aren't indexed have the first k of their place as neighbours
        crowded = entries.groupBy(*grid.XYZ).agg(F.sort_array(F.collect_list("a_id")).alias("ids")).where(F.size("ids") > k)  # at most k + 1 ids each
        others = rows.join(crowded, grid.XYZ).where(F.col("a_id") > F.element_at("ids", k + 1)).select("a_id", F.explode(F.slice("ids", 1, k)).alias("b_id"), F.lit(0.0).alias("d2"))
        asking = entries

    n = entries.count()
    leaves = max(1, min(n // max(LEAF_ROWS, 4 * k), SAMPLE_ROWS // SAMPLE_PER_LEAF))
    every = max(1, n // SAMPLE_ROWS)
    sample = entries.where(F.pmod(F.xxhash64("a_id"), F.lit(every)) == 0).select(*grid.XYZ).limit(2 * SAMPLE_ROWS).toPandas().to_numpy(dtype=np.float64).reshape(-1, 3)
    tree, parts = spark.sparkContext.broadcast(Tree(sample, leaves)), shuffle_partitions(spark)
    kinds = "a_id long, x double, y double, z double"
    cap, self_counts = np.inf if margin is None else margin * margin, others_only

    def to_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, leaf = tree.value.reach(_xyz(b))
            mine = np.empty(b.num_rows, dtype=np.int32)
            mine[q] = leaf
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(mine)], names=[*b.schema.names, "leaf"])

    # partitions of a given number aren't merged for their small size: the work is in the kernels, not in the bytes
    leafed = lambda df: df.select("a_id", *grid.XYZ).mapInArrow(to_leaf, f"{kinds}, leaf int").repartition(parts, "leaf")
    placed = leafed(entries)

    def bound(g: pa.Table, h: pa.Table) -> pa.Table:
        p, to = _xyz(g), _xyz(h)
        # a point itself may be among them at 0, so the k-th other is at place k
        r2, at = np.full(len(p), cap), k if self_counts else k - 1
        if len(to) > at:
            for i, d2 in _squares(p, to):
                r2[i : i + len(d2)] = np.minimum(np.partition(d2, at, axis=1)[:, at], cap)
        q, leaf = tree.value.reach(p, np.sqrt(r2) * (1 + SLACK) + SLACK)
        return pa.table([g.column("a_id").take(pa.array(q)), *[pa.array(p[q, j]) for j in range(3)], pa.array(r2[q]), pa.array(leaf.astype(np.int32))], names=["a_id", *grid.XYZ, "r2", "leaf"])

    asked = placed if own else leafed(asking)
    guests = asked.groupBy("leaf").cogroup(placed.groupBy("leaf")).applyInArrow(bound, f"{kinds}, r2 double, leaf int").repartition(parts, "leaf")

    def visit(g: pa.Table, h: pa.Table) -> pa.Table:
        ids, hosts, at, to, r2 = g.column("a_id").to_numpy(), h.column("a_id").to_numpy(), _xyz(g), _xyz(h), g.column("r2").to_numpy()
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for i, d2 in _squares(at, to):
            mine = ids[i : i + len(d2)]
            near = (d2 <= r2[i : i + len(d2), None]) & (d2 < cap)
            q, v = np.nonzero(near)
            d = d2[q, v]
            if self_counts:
                other = mine[q] != hosts[v]
                q, v, d = q[other], v[other], d[other]
            v = hosts[v]
            by = np.lexsort((v, d, q))
            q, v, d = q[by], v[by], d[by]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < k
            out.append((mine[q[keep]], v[keep], d[keep]))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out)], names=["a_id", "b_id", "d2"])

    found = guests.groupBy("leaf").cogroup(placed.groupBy("leaf")).applyInArrow(visit, "a_id long, b_id long, d2 double")
    order = W.partitionBy("a_id").orderBy("d2", "b_id")
    if others is not None:
        found = found.union(others)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
