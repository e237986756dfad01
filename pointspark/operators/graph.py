"""Connected components: local spanning forests, then alternating large-star and small-star rounds.

Edges stay distributed; every round is written to the shared folder. Defined cases: loops and repeated edges relate nothing
new; NULL ends are dropped; nodes without an edge don't appear; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointspark.session import cut


#: Edges that a partition folds into its forest at once; beyond so many edges a node's are spread over several partitions.
FOLD_EDGES, HEAVY = 1_000_000, 100_000


def _leads(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its local component) of all nodes that aren't the smallest themselves."""
    nodes, flat = np.unique(ends, return_inverse=True)
    u, v = flat.reshape(-1, 2).T
    lead = np.arange(len(nodes))
    while True:  # hook the larger lead to the smaller, then shortcut
        a, b = lead[u], lead[v]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        if (lo == hi).all():
            break
        np.minimum.at(lead, hi, lo)
        while True:
            up = lead[lead]
            if (up == lead).all():
                break
            lead = up
    keep = lead != np.arange(len(nodes))
    return nodes[keep], nodes[lead[keep]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one partition -> its spanning forest; what is held never exceeds the partition's nodes and FOLD_EDGES."""
    held, waiting, size = np.zeros((0, 2), dtype=np.int64), [], 0
    for b in batches:
        waiting.append(np.column_stack([b.column(0).to_numpy(), b.column(1).to_numpy()]))
        size += b.num_rows
        if size >= FOLD_EDGES:
            held, waiting, size = np.column_stack(_leads(np.concatenate([held, *waiting]))), [], 0
    if size or len(held):
        u, v = _leads(np.concatenate([held, *waiting]))
        for i in range(0, len(u), FOLD_EDGES):
            yield pa.RecordBatch.from_arrays([pa.array(u[i : i + FOLD_EDGES]), pa.array(v[i : i + FOLD_EDGES])], names=["u", "v"])


def _gathered(edges: DataFrame) -> DataFrame:
    """Edges with those of one ``v`` together, except that a heavy ``v`` is spread by its ``u``: no hub makes a task of its own."""
    degree = edges.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > HEAVY).select("v", F.ceil(F.col("n") / HEAVY).alias("parts"))
    # so many nodes at most have more than HEAVY edges each: one in HEAVY rows
    spread = edges.join(degree, "v", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("u"), F.col("parts")), F.lit(0)))
    return spread.repartition("v", "salt").select("u", "v")


def connected_leads(edges: DataFrame) -> DataFrame:
    """(node, lead): the smallest node of the component of every node that has an edge (u, v)."""
    step = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    step = cut(step.mapInArrow(_forest, "u long, v long").distinct())
    step = _gathered(step).mapInArrow(_forest, "u long, v long")
    step, before = cut(step.distinct()), None
    while True:
        # large star: larger neighbours to the smallest of the neighbourhood
        both = step.union(step.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: smaller neighbours and the node itself to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        step = cut(small.where(F.col("u") != F.col("v")).distinct())
        now = step.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return step.select(F.col("u").alias("node"), F.col("v").alias("lead"))
        before = tuple(now)
