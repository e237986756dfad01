"""Train, validation and test splits that keep related records together.

Records are related if they share a key (given as several key expressions), also through other records. Each key is
represented by the smallest id that bears it; representatives that meet in a record are joined by an edge, so the graph
holds keys, not records. Partitions first replace their edges by a spanning forest; alternating large-star and
small-star rounds then contract the rest, each round written to the shared folder.

The components are allocated by min-cost flow: bundled by identical size and label profile, the bundles' mass flows to
(label class, split) quotas and on to split quotas with a cost for every unit of deviation; the flow is rounded
to whole components; the members of a bundle are assigned by the rank of their hash.

Defined cases: NULL, NaN and missing keys relate nothing; repeated rows count once; a record without any key is its own
component; ties and order don't matter; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pointspark.operators.graph import connected_leads
from pointspark.session import cut

SPLITS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))
#: Components of more than this share of the smallest quota flow on their own.
GIANT_SHARE = 0.02
#: Rows that one task ranks at most, about, when members of a bundle are assigned by hash.
RANK_ROWS = 50_000
#: Weight of a unit of deviation from a split's size and from its share of a label class.
SIZE_COST, CLASS_COST = 1000, 1


def relate(records: DataFrame, item: str, keys: list[Column], extra: DataFrame | None = None) -> DataFrame:
    """(item, lead): every distinct record with the smallest id of its component.

    ``keys`` are string expressions on ``records``, NULL where missing; ``extra`` (item, key) adds keys from other tables.
    """
    base = records.where(F.col(item).isNotNull())
    own = base.select(F.col(item).alias("item"), F.explode(F.array_compact(F.array(*keys))).alias("key"))
    pairs = (own if extra is None else own.union(extra.select("item", "key").where(F.col("key").isNotNull()))).distinct()
    reps = pairs.groupBy("key").agg(F.min("item").alias("rep"), F.count("*").alias("n")).where(F.col("n") > 1)
    seen = pairs.join(reps.select("key", "rep"), "key").groupBy("item").agg(F.min("rep").alias("first"), F.collect_set("rep").alias("reps"))
    seen = cut(seen)
    edges = seen.where(F.size("reps") > 1).select(F.explode("reps").alias("u"), F.col("first").alias("v")).distinct()
    leads = connected_leads(edges)
    items = base.select(F.col(item).alias("item")).distinct()
    return items.join(seen.select("item", "first"), "item", "left").join(leads, F.col("first") == F.col("node"), "left").select("item", F.coalesce("lead", "first", "item").alias("lead"))


class _Flow:
    """Min-cost flow by successive shortest paths, for the few nodes of the quota network."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, cap: int, cost: int) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def solve(self, s: int, t: int) -> None:
        while True:
            dist, via, queue = {s: 0}, {}, [s]
            for a in queue:  # label correcting; costs may be negative on residual arcs
                for e in self.out[a]:
                    b, d = self.to[e], dist[a] + self.cost[e]
                    if self.cap[e] > 0 and d < dist.get(b, 1 << 62):
                        dist[b], via[b] = d, e
                        queue.append(b)
            if t not in dist:
                return
            path, b = [], t
            while b != s:
                path.append(via[b])
                b = self.to[via[b] ^ 1]
            push = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= push
                self.cap[e ^ 1] += push


def solve_quotas(masses: list[tuple[int, int]], quota: list[int], class_quota: dict[int, list[int]]) -> np.ndarray:
    """masses: (label class, mass) of each supply. Returns mass [supply, split] of least deviation cost."""
    k, classes = len(quota), sorted(class_quota)
    at = {c: i for i, c in enumerate(classes)}
    n = len(masses)
    cs = lambda c, s: 2 + n + at[c] * k + s
    sp = lambda s: 2 + n + len(classes) * k + s
    g = _Flow(2 + n + len(classes) * k + k)
    big = sum(m for _, m in masses) + 1
    arcs = []
    for i, (c, m) in enumerate(masses):
        g.arc(0, 2 + i, m, 0)
        arcs.append([g.arc(2 + i, cs(c, s), big, 0) for s in range(k)])
    for c in classes:
        for s in range(k):
            g.arc(cs(c, s), sp(s), max(class_quota[c][s], 0), 0)
            g.arc(cs(c, s), sp(s), big, CLASS_COST)
    for s in range(k):
        g.arc(sp(s), 1, max(quota[s], 0), 0)
        g.arc(sp(s), 1, big, SIZE_COST)
    g.solve(0, 1)
    return np.array([[g.cap[e ^ 1] for e in row] for row in arcs], dtype=np.int64).reshape(n, k)


def allocate(bundles: list[tuple[int, int, int]], shares: list[float]) -> list[list[int]]:
    """bundles: (size, label class, components). Returns how many components of each bundle go to each split.

    Bundles with giant components are fixed one component at a time, largest first, at the split that the flow favours
    and where they exceed the quota least; the mass of the others is then solved at once and rounded to whole components,
    carrying the remainder of each bundle on to the next.
    """
    k, total = len(shares), sum(z * m for z, _, m in bundles)
    target = np.array([round(total * s) for s in shares])
    target[0] += total - target.sum()
    mass: dict[int, int] = {}
    for z, c, m in bundles:
        mass[c] = mass.get(c, 0) + z * m
    cquota = {c: np.array([round(v * s) for s in shares]) for c, v in mass.items()}
    out = [[0] * k for _ in bundles]
    left = target.astype(np.int64).copy()
    order = sorted(range(len(bundles)), key=lambda i: (-bundles[i][0], bundles[i][1]))
    giant = [i for i in order if bundles[i][0] > GIANT_SHARE * max(target.min(), 1)]
    flow = solve_quotas([(bundles[i][1], bundles[i][0] * bundles[i][2]) for i in giant], list(target), cquota) if giant else np.zeros((0, k))
    for i, f in zip(giant, flow):
        z, c, m = bundles[i]
        for _ in range(m):
            over = np.maximum(z - left, 0)
            s = min(range(k), key=lambda s: (over[s], -f[s], -cquota[c][s], s))
            out[i][s] += 1
            left[s] -= z
            cquota[c][s] -= z
            f[s] -= z
    small = [i for i in order if bundles[i][0] <= GIANT_SHARE * max(target.min(), 1)]
    groups = sorted({bundles[i][1] for i in small})
    masses = [(c, sum(bundles[i][0] * bundles[i][2] for i in small if bundles[i][1] == c)) for c in groups]
    if masses:
        flow = solve_quotas(masses, list(left), {c: list(q) for c, q in cquota.items()})
        for c, f in zip(groups, flow):
            due = f.astype(np.float64)
            rest = float(due.sum())
            for i in (i for i in small if bundles[i][1] == c):
                z, _, m = bundles[i]
                exact = due * (z * m / rest) / z if rest else np.zeros(k)
                whole = np.floor(exact).astype(np.int64)
                while whole.sum() < m:  # each remaining component where most mass is still due
                    s = int(np.argmax(due - whole * z))
                    whole[s] += 1
                out[i] = [int(x) for x in whole]
                due -= whole * z
                rest -= z * m
    return out


def assign_splits(related: DataFrame, labels: DataFrame, splits: tuple[tuple[str, float], ...] = SPLITS, seed: int = 42) -> DataFrame:
    """(item, lead, split): all members of a component get the same split.

    labels: (item, label) with label 1 or 0, or NULL. A component's profile is the tenth of its labelled
    members that bear label 1 (0..10), or 11 without any; sizes and profiles bound the bundles on the driver by twelve times
    the number of distinct component sizes, itself at most the root of twice the number of records.
    """
    related = cut(related.join(labels.groupBy("item").agg(F.max("label").alias("label")), "item", "left"))
    comps = related.groupBy("lead").agg(F.count("*").alias("size"), F.avg("label").alias("rate"))
    comps = comps.select("lead", "size", F.coalesce(F.floor(F.col("rate") * 10).cast("int"), F.lit(11)).alias("profile"))
    bundles = [(r["size"], r["profile"], r["count"]) for r in comps.groupBy("size", "profile").count().collect()]
    plan = allocate(bundles, [s for _, s in splits])
    bounds = [(z, c, [sum(row[: j + 1]) for j in range(len(row))], max(1, m // RANK_ROWS)) for (z, c, m), row in zip(bundles, plan)]
    plan_df = related.sparkSession.createDataFrame(bounds, "size long, profile int, bounds array<long>, slots int")
    comps = comps.join(plan_df, ["size", "profile"]).withColumn("h", F.xxhash64("lead", F.lit(seed)))
    # rank of the hash within the bundle: slots of the hash are counted, prefix-summed, and ranked each on its own
    comps = comps.withColumn("slot", F.pmod(F.shiftright("h", 20), F.col("slots")))
    slot = W.partitionBy("size", "profile").orderBy("slot")
    starts = comps.groupBy("size", "profile", "slot").count().select("size", "profile", "slot", (F.sum("count").over(slot) - F.col("count")).alias("start"))
    rank = F.row_number().over(W.partitionBy("size", "profile", "slot").orderBy("h", "lead"))
    named = F.array(*[F.lit(n) for n, _ in splits])
    ranked = comps.withColumn("place", rank).join(starts, ["size", "profile", "slot"]).withColumn("place", F.col("place") + F.col("start"))
    chosen = ranked.select("lead", F.element_at(named, F.size(F.filter("bounds", lambda b: b < F.col("place"))) + 1).alias("split"))
    return related.join(chosen, "lead").select("item", "lead", "split")
