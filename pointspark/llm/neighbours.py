"""The k most similar vectors of every vector, by collision-counting hashing with query-centred windows.

Each leaf of the index keeps one sorted array a projection, and there are more projections than dimensions. A query opens a
window around its own projected value in every array (so buckets are centred on the query) and counts, for each vector, the arrays in
which it collides with the query; vectors that reach the collision threshold, which is below the number of arrays, are verified
by their true distance. Windows are widened by virtual rehashing (w doubles) until k verified vectors lie within w.

A window's half-width is only a share of w, so that it holds few vectors; a vector within w is then found with a probability that grows with
its collisions, not for sure. That gives a bound on the k-th distance, often the distance itself. With ``exact`` a second
pass takes the orthonormal arrays alone and windows as wide as that bound: a vector within it collides in all of them,
so nothing nearer is missed, and ties go to the smaller id. Without ``exact`` the pass is left out: in many dimensions, where every ball reaches
most of the data, only the share decides, and recall has to be measured (p4_recall).

Distribution: a k-d tree fitted on a bounded sample (SAMPLE_ROWS) splits space into leaves of about LEAF_ROWS rows; all
rows are indexed. A query first searches its own leaf, which bounds its k-th distance, and is then sent only to
those other leaves that this ball reaches. Of many vectors at one place only the k + 1 smallest ids can be anybody's
neighbours, so only they are indexed; the others' neighbours are the first k of them.

Defined cases: rows with a NULL or NaN coordinate or a NULL id take no part; an id counts once (the smallest coordinates,
should its rows differ); -0.0 equals 0.0; with fewer than k other vectors, all of them are neighbours; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pointspark.session import cut

K = 5
LEAF_ROWS, SAMPLE_ROWS, SAMPLE_PER_LEAF = 4096, 200_000, 64
PAIRS_AT_ONCE = 1_000_000
QUERY_BLOCK = 20_000
#: Slack for the rounding of projected values.
SLACK = 1e-9


@cache
def _projections(dim: int) -> np.ndarray:
    """Unit directions: the first ``dim`` are orthonormal, the others are those of a second such frame."""
    frames = [np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))[0] for seed in (7, 8)]
    return np.concatenate([frames[0], frames[1][: max(1, dim // 2)]]) if dim > 1 else np.ones((3, 1))


def settings(dim: int) -> tuple[int, float]:
    """(collision threshold, half-width of a window as a share of w) for the projections of ``dim`` dimensions.

    Of m random directions a vector at distance w has components of about w / sqrt(dim); two such deviations, or in few
    dimensions 0.7 w, hold nearly all of them for a neighbour and fewer for vectors further off.
    """
    m = len(_projections(dim))
    return (m - 1 if dim <= 8 else int(0.9 * m)), min(0.7, 2 / dim**0.5)


class SortedProjections:
    """One sorted array a projection over the vectors of a leaf."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.dim = vectors.shape[1]
        self.axes = _projections(self.dim)
        self.threshold, self.share = settings(self.dim)
        self.values = vectors @ self.axes.T
        self.order = np.argsort(self.values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.values, self.order, axis=0)
        self.rank = np.empty_like(self.order)
        np.put_along_axis(self.rank, self.order, np.arange(len(ids))[:, None], axis=0)

    def candidates(self, queries: np.ndarray, half: np.ndarray, arrays: int, threshold: int):
        """Yields (query index, vector index, squared distance) of vectors with enough collisions in the first arrays, in blocks of queries."""
        proj = queries @ self.axes[:arrays].T
        half = half * (1 + SLACK) + SLACK
        lo = np.stack([np.searchsorted(self.sorted[:, j], proj[:, j] - half) for j in range(arrays)])
        hi = np.stack([np.searchsorted(self.sorted[:, j], proj[:, j] + half, side="right") for j in range(arrays)])
        # a vector that reaches the threshold is in one of the arrays - threshold + 1 narrowest windows: the counting starts from these
        first = np.argsort(hi - lo, axis=0, kind="stable")[: arrays - threshold + 1]
        everyone = np.arange(len(queries))
        for turn in range(len(first)):
            n_all = (hi - lo)[first[turn], everyone]
            for part in np.split(everyone, np.flatnonzero(np.diff(np.cumsum(n_all) // PAIRS_AT_ONCE)) + 1):
                if not len(part):
                    continue
                n, j = n_all[part], first[turn, part]
                q, jq = np.repeat(part, n), np.repeat(j, n)
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[j, part], n)
                v = self.order[at, jq]
                # most pairs fail early: what can't reach the threshold any more is dropped
                for earlier in range(turn):
                    e = first[earlier, q]
                    r = self.rank[v, e]
                    new = (r < lo[e, q]) | (r >= hi[e, q])
                    q, v = q[new], v[new]
                misses = np.zeros(len(v), dtype=np.int16)
                for i in range(arrays):
                    r = self.rank[v, i]
                    misses += (r < lo[i, q]) | (r >= hi[i, q])
                    ok = misses <= arrays - threshold
                    q, v, misses = q[ok], v[ok], misses[ok]
                yield q, v, ((queries[q] - self.vectors[v]) ** 2).sum(axis=1)

    def within(self, qids: np.ndarray, queries: np.ndarray, w: np.ndarray, k: int, exact: bool = True):
        """The k nearest others among those within w: arrays (query index, neighbour id, squared distance)."""
        out = []
        for q, v, d2 in self.candidates(queries, w, self.dim, self.dim) if exact else self.candidates(queries, w * self.share, len(self.axes), self.threshold):
            ids = self.ids[v]
            ok = (d2 <= w[q] ** 2) & (ids != qids[q])
            q, ids, d2 = q[ok], ids[ok], d2[ok]
            by = np.lexsort((ids, d2, q))
            q, ids, d2 = q[by], ids[by], d2[by]
            first = np.searchsorted(q, q)
            keep = np.arange(len(q)) - first < k
            out.append((q[keep], ids[keep], d2[keep]))
        if not out:
            return np.zeros(0, int), np.zeros(0, self.ids.dtype), np.zeros(0)
        q, ids, d2 = (np.concatenate(x) for x in zip(*out))
        by = np.lexsort((ids, d2, q))  # a query's candidates may come in several turns
        q, ids, d2 = q[by], ids[by], d2[by]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[keep], ids[keep], d2[keep]

    def start_width(self, k: int) -> np.ndarray:
        """Lower bound of each own vector's k-th distance: the k-th gap in any single projection."""
        n = len(self.ids)
        width = np.zeros(n)
        for j in range(self.dim):
            s = self.sorted[:, j]
            gaps = np.full((2 * k, n), np.inf)
            for i in range(1, min(k, n - 1) + 1):
                gaps[i - 1, i:] = s[i:] - s[:-i]
                gaps[k + i - 1, :-i] = s[i:] - s[:-i]
            kth = np.partition(gaps, k - 1, axis=0)[k - 1]
            width[self.order[:, j]] = np.maximum(width[self.order[:, j]], kth)
        return np.where(np.isfinite(width), width, 0.0)

    def own_neighbours(self, k: int, exact: bool = True):
        """k nearest others of every own vector by virtual rehashing: (index, neighbour id, squared distance)."""
        n = len(self.ids)
        span = float(np.ptp(self.vectors, axis=0).sum()) + SLACK
        limit = span / self.share  # from here on the windows hold the whole leaf
        w = np.clip(self.start_width(k), span * 1e-6, limit)
        radius, todo, out = np.full(n, span), np.arange(n), []
        while len(todo):
            last = w[todo] >= limit
            q, ids, d2 = self.within(self.ids[todo], self.vectors[todo], w[todo], k, exact=False)
            found = np.bincount(q, minlength=len(todo))
            full = (found >= min(k, n - 1)) | last
            ok = full[q]
            out.append((todo[q[ok]], ids[ok], d2[ok]))
            far = np.zeros(len(todo))
            np.maximum.at(far, q, d2)
            radius[todo] = np.where(found >= min(k, n - 1), np.sqrt(far), span)
            todo = todo[~full]
            w[todo] = np.minimum(w[todo] * 2, limit)
        if exact:
            return self.within(self.ids, self.vectors, np.nextafter(np.minimum(radius, span), np.inf), k)
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), self.ids, np.zeros(0))


class Tree:
    """k-d tree of leaves, small enough to broadcast: SAMPLE_ROWS / SAMPLE_PER_LEAF leaves at most."""

    def __init__(self, sample: np.ndarray, leaves: int) -> None:
        self.dim, self.at, self.left, self.right, self.leaf = [], [], [], [], []
        self.leaves = 0
        self._grow(sample, leaves)

    def _grow(self, rows: np.ndarray, leaves: int) -> int:
        node = len(self.dim)
        for a in (self.dim, self.at, self.left, self.right, self.leaf):
            a.append(-1)
        d = int(np.argmax(np.ptp(rows, axis=0))) if len(rows) else 0
        cut_at = float(np.median(rows[:, d])) if len(rows) else 0.0
        low = rows[:, d] < cut_at if len(rows) else np.zeros(0, bool)
        if leaves <= 1 or len(rows) < 2 or not low.any() or low.all():
            self.leaf[node] = self.leaves
            self.leaves += 1
            return node
        self.dim[node], self.at[node] = d, cut_at
        self.left[node] = self._grow(rows[low], leaves // 2)
        self.right[node] = self._grow(rows[~low], leaves - leaves // 2)
        return node

    def reach(self, v: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, leaf) of all leaves that the ball of radius r around each vector may touch; r = 0 gives its own leaf."""
        dim, at, left, right, leaf = (np.array(a) for a in (self.dim, self.at, self.left, self.right, self.leaf))
        q, node, out = np.arange(len(v)), np.zeros(len(v), dtype=np.int64), []
        while len(q):
            end = leaf[node] >= 0
            out.append((q[end], leaf[node[end]]))
            q, node = q[~end], node[~end]
            side = v[q, dim[node]] - at[node]
            lo, hi = side < r[q] + SLACK * (r[q] > 0), side >= -(r[q] + SLACK * (r[q] > 0))
            lo = np.where(r[q] > 0, lo, side < 0)
            q, node = np.concatenate([q[lo], q[hi]]), np.concatenate([left[node[lo]], right[node[hi]]])
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int))


def _matrix(t: pa.Table | pa.RecordBatch, dims: list[str]) -> np.ndarray:
    return np.column_stack([t.column(c).to_numpy() for c in dims])


def nearest(points: DataFrame, item: str, dims: list[str], k: int = K, exact: bool = True) -> DataFrame:
    """(item, neighbour, d2): the k nearest other vectors of every vector; without ``exact`` those that the collisions bring."""
    spark = points.sparkSession
    ok = F.col(item).isNotNull()
    for c in dims:
        ok &= F.col(c).isNotNull() & ~F.isnan(F.col(c))
    # adding 0.0 turns -0.0 into 0.0, so that equal places have equal keys
    rows = points.where(ok).groupBy(F.col(item).alias("item")).agg(F.min(F.struct(*[(F.col(c).cast("double") + F.lit(0.0)).alias(c) for c in dims])).alias("p")).select("item", "p.*")
    rows = cut(rows)
    place = W.partitionBy(*dims).orderBy("item")
    entries = cut(rows.withColumn("copy", F.row_number().over(place)).where(F.col("copy") <= k + 1).drop("copy"))
    crowded = entries.groupBy(*dims).agg(F.sort_array(F.collect_list("item")).alias("ids")).where(F.size("ids") > k)  # at most k + 1 ids each
    others = rows.join(crowded, dims).where(F.col("item") > F.element_at("ids", k + 1)).select("item", F.explode(F.slice("ids", 1, k)).alias("neighbour"), F.lit(0.0).alias("d2"))

    n = entries.count()
    leaves = max(1, min(n // LEAF_ROWS, SAMPLE_ROWS // SAMPLE_PER_LEAF))
    every = max(1, n // min(SAMPLE_ROWS, leaves * SAMPLE_PER_LEAF * 4))
    sample = entries.where(F.pmod(F.xxhash64("item"), F.lit(every)) == 0).select(*dims).limit(2 * SAMPLE_ROWS).toPandas().to_numpy(dtype=np.float64).reshape(-1, len(dims))
    tree = spark.sparkContext.broadcast(Tree(sample, leaves))
    kinds = "item long, " + ", ".join(f"{c} double" for c in dims)

    def to_leaf(batches):
        for b in batches:
            v = _matrix(b, dims)
            q, leaf = tree.value.reach(v, np.zeros(len(v)))
            own = np.empty(len(v), dtype=np.int32)
            own[q] = leaf
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own)], names=[*b.schema.names, "leaf"])

    placed = entries.select(F.col("item").cast("long").alias("item"), *dims).mapInArrow(to_leaf, f"{kinds}, leaf int")

    def at_home(t: pa.Table) -> pa.Table:
        ids, v = t.column("item").to_numpy(), _matrix(t, dims)
        here = int(t.column("leaf")[0].as_py())
        index = SortedProjections(ids, v)
        q, nb, d2 = index.own_neighbours(k, exact)
        by = np.lexsort((nb, d2, q))
        q, nb, d2 = q[by], nb[by], d2[by]
        n = np.bincount(q, minlength=len(ids))
        last = np.cumsum(n) - 1
        radius = np.full(len(ids), np.inf)
        radius[n >= k] = np.sqrt(d2[last[n >= k]])
        # a tie at the k-th distance may lie just across a border, so the ball is closed and never empty
        i, leaf = tree.value.reach(v, np.maximum(radius, SLACK))
        away = leaf != here
        i, leaf = i[away], leaf[away]
        order = np.argsort(i, kind="stable")
        ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        lends = np.concatenate([[0], np.cumsum(np.bincount(i, minlength=len(ids)))]).astype(np.int32)
        return pa.table([
            pa.array(ids), *[pa.array(v[:, j]) for j in range(len(dims))], pa.array(radius),
            pa.ListArray.from_arrays(ends, pa.array(nb)), pa.ListArray.from_arrays(ends, pa.array(d2)), pa.ListArray.from_arrays(lends, pa.array(leaf[order].astype(np.int32))),
        ], names=["item", *dims, "radius", "nbs", "d2s", "away"])

    home = cut(placed.groupBy("leaf").applyInArrow(at_home, f"{kinds}, radius double, nbs array<long>, d2s array<double>, away array<int>"))
    visits = home.where(F.size("away") > 0).select("item", *dims, "radius", F.explode("away").alias("leaf"))

    def visit(guests: pa.Table, hosts: pa.Table) -> pa.Table:
        names = ["item", "neighbour", "d2"]
        if not guests.num_rows or not hosts.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        index = SortedProjections(hosts.column("item").to_numpy(), _matrix(hosts, dims))
        qids, v, r = guests.column("item").to_numpy(), _matrix(guests, dims), guests.column("radius").to_numpy()
        span = 2 * float(np.abs(np.vstack([v, index.vectors])).max()) * len(dims) + 1
        q, nb, d2 = index.within(qids, v, np.minimum(np.nextafter(r, np.inf), span), k, exact)
        return pa.table([pa.array(qids[q]), pa.array(nb), pa.array(d2)], names=names)

    guests = visits.groupBy("leaf").cogroup(placed.groupBy("leaf")).applyInArrow(visit, "item long, neighbour long, d2 double")
    own = home.select("item", F.explode(F.arrays_zip("nbs", "d2s")).alias("e")).select("item", F.col("e.nbs").alias("neighbour"), F.col("e.d2s").alias("d2"))
    best = W.partitionBy("item").orderBy("d2", "neighbour")
    ranked = own.union(guests).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")
    return ranked.union(others)


def brute_nearest(points: DataFrame, item: str, dims: list[str], asked: DataFrame, k: int = K) -> DataFrame:
    """(item, neighbour): the k nearest others of the ``asked`` items (a stated query set), against all rows.

    Queries are broadcast in blocks of about QUERY_BLOCK; a task keeps the k best of each while its rows pass, so no pair is shuffled.
    """
    ok = F.col(item).isNotNull()
    for c in dims:
        ok &= F.col(c).isNotNull() & ~F.isnan(F.col(c))
    rows = points.where(ok).select(F.col(item).cast("long").alias("item"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(dims)])
    names = [f"v{i}" for i in range(len(dims))]
    mine = cut(rows.join(asked.select(F.col(item).cast("long").alias("item")).distinct(), "item", "left_semi").dropDuplicates(["item"]))
    blocks = -(-mine.count() // QUERY_BLOCK)
    found = None
    for block in range(blocks):
        part = mine.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).toPandas()
        sent = points.sparkSession.sparkContext.broadcast((part["item"].to_numpy(), part[names].to_numpy(dtype=np.float64)))

        def best(batches, sent=sent):
            qids, q = sent.value
            kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # query, neighbour, squared distance
            limit = np.full(len(qids), np.inf)
            for b in batches:
                ids, v = b.column(0).to_numpy(), _matrix(b, names)
                for start in range(0, len(qids), 256):
                    d2 = sum((q[start : start + 256, j, None] - v[None, :, j]) ** 2 for j in range(len(names)))
                    i, j = np.nonzero(d2 <= limit[start : start + 256, None])
                    new = ids[j] != qids[start + i]
                    kept = [np.concatenate([a, x]) for a, x in zip(kept, (start + i[new], ids[j[new]], d2[i[new], j[new]]))]
                    if len(kept[0]) > 4 * k * len(qids) or start + 256 >= len(qids):
                        by = np.lexsort((kept[1], kept[2], kept[0]))
                        kept = [x[by] for x in kept]
                        fit = np.arange(len(by)) - np.searchsorted(kept[0], kept[0]) < k
                        kept = [x[fit] for x in kept]
                        at, n = np.unique(kept[0], return_counts=True)
                        full = np.cumsum(n)[n >= k] - 1
                        limit[at[n >= k]] = kept[2][full]
            yield pa.RecordBatch.from_arrays([pa.array(qids[kept[0]]), pa.array(kept[1]), pa.array(kept[2])], names=["item", "neighbour", "d2"])

        got = rows.mapInArrow(best, "item long, neighbour long, d2 double")
        found = got if found is None else found.union(got)
    if found is None:
        return mine.select("item", F.col("item").alias("neighbour"))
    # an id that rows repeat counts once
    found = found.groupBy("item", "neighbour").agg(F.min("d2").alias("d2"))
    return found.withColumn("r", F.row_number().over(W.partitionBy("item").orderBy("d2", "neighbour"))).where(F.col("r") <= k).select("item", "neighbour")
