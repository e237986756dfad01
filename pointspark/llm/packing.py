"""Filling containers of fixed capacity: vector bin packing by the dot-product heuristic.

Items carry three sizes: tokens, segments (one each) and loss-bearing tokens. A container takes, again and again, the item
that fits and whose weighted dot product with the container's remaining capacities is largest, the weights being the
mean demands. Items of equal sizes are interchangeable, so a task works on counts of size classes. Items larger than a
container are split into full containers and a remainder; no other item is split. An item may also be larger than a container by its
loss-bearing tokens: it is split at that limit too, or, if ``masked``, at most ``max_loss`` tokens of a piece bear loss and the others are
masked. Items are spread by hash over groups of about GROUP_ITEMS, packed independently in tasks of their own: each group
leaves at most a few containers part-filled.

Defined cases: items of no tokens (NULL and empty texts) are placed with an empty span and take a segment; ties are broken
by the smaller key; repeated keys are placed as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
MAX_SEGMENTS = 256
GROUP_ITEMS = 10_000
SCHEMA = "container_id long, doc_id long, token_from long, token_to long, at int"


def fill(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(container, offset) of each item; every item fits an empty container."""
    cap = np.array(limits, dtype=np.float64)
    classes, at = np.unique(np.column_stack([tokens, loss]), axis=0, return_inverse=True)
    at = at.ravel()
    size = np.column_stack([classes[:, 0], np.ones(len(classes)), classes[:, 1]]) / cap
    members = np.argsort(at, kind="stable")
    first = np.searchsorted(at[members], np.arange(len(classes)))
    left = np.bincount(at, minlength=len(classes))
    weight = np.maximum((size * left[:, None]).sum(axis=0) / max(len(tokens), 1), 1e-12)
    raw = np.column_stack([classes[:, 0], np.ones(len(classes), dtype=np.int64), classes[:, 1]])
    container, offset = np.zeros(len(tokens), dtype=np.int64), np.zeros(len(tokens), dtype=np.int64)
    room, no = np.array(limits), 0
    for _ in range(len(tokens)):
        fits = (left > 0) & (raw <= room).all(axis=1)
        if not fits.any():
            room, no = np.array(limits), no + 1
            fits = left > 0
        score = np.where(fits, size @ (weight * room / cap), -1.0)
        c = int(np.argmax(score))
        item = members[first[c]]
        first[c] += 1
        left[c] -= 1
        container[item], offset[item] = no, limits[0] - room[0]
        room = room - raw[c]
    return container, offset


def pack(items: DataFrame, key: str, tokens: Column, loss: Column, count: int, capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS, max_loss: int = CAPACITY, group_items: int = GROUP_ITEMS, masked: bool = False) -> DataFrame:
    """(container_id, doc_id, token_from, token_to, at): every item's spans and where they lie in their containers.

    ``count`` is the number of items, for the number of groups. An item's loss-bearing tokens are all or none of its tokens.
    """
    groups = max(1, count // group_items)
    rows = items.select(F.col(key).cast("long").alias("doc_id"), tokens.cast("long").alias("n"), loss.cast("boolean").alias("bears")).withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    split_at = capacity if masked else min(capacity, max_loss)

    def packed(t: pa.Table) -> pa.Table:
        t = t.sort_by("doc_id")
        ids, n, bears, g = (t.column(c).to_numpy() for c in ("doc_id", "n", "bears", "g"))
        bears = bears.astype(bool)
        step = np.where(bears, split_at, capacity)
        whole = np.where(n > step, n // step, 0)
        rest = n - whole * step
        open_ = np.flatnonzero((rest > 0) | (n == 0))
        box, at = fill(rest[open_], np.where(bears, np.minimum(rest, max_loss), 0)[open_], (capacity, max_segments, max_loss))
        used = int(box.max()) + 1 if len(box) else 0
        rep = np.repeat(np.arange(len(n)), whole)
        no = np.arange(len(rep)) - np.repeat(np.cumsum(whole) - whole, whole)
        high = int(g[0]) << 32
        cols = [
            np.concatenate([high + box, high + used + np.arange(len(rep))]),
            np.concatenate([ids[open_], ids[rep]]),
            np.concatenate([(whole * step)[open_], no * step[rep]]),
            np.concatenate([n[open_], (no + 1) * step[rep]]),
            np.concatenate([at, np.zeros(len(rep), dtype=np.int64)]).astype(np.int32),
        ]
        return pa.table(cols, names=["container_id", "doc_id", "token_from", "token_to", "at"])

    # a stated number of partitions is kept: groups are few and small in bytes, but dear to pack
    return rows.repartition(groups, "g").groupBy("g").applyInArrow(packed, SCHEMA)


def closed_by(spans: DataFrame, sizes: DataFrame, key: str, loss: Column, capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS, max_loss: int = CAPACITY) -> DataFrame:
    """(container_id, tokens, segments, loss, by_tokens, by_segments, by_loss): each container's load and the limits that it has reached."""
    n = F.col("token_to") - F.col("token_from")
    rows = spans.join(sizes.select(F.col(key).cast("long").alias("doc_id"), loss.alias("bears")).distinct(), "doc_id")
    boxes = rows.groupBy("container_id").agg(F.sum(n).alias("tokens"), F.count("*").alias("segments"), F.sum(F.when(F.col("bears"), F.least(n, F.lit(max_loss))).otherwise(0)).alias("loss"))
    return boxes.select("*", (F.col("tokens") == capacity).alias("by_tokens"), (F.col("segments") == max_segments).alias("by_segments"), (F.col("loss") == max_loss).alias("by_loss"))


def audit(spans: DataFrame, sizes: DataFrame, key: str, loss: Column, capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS, max_loss: int = CAPACITY, slack: float = 0.01) -> DataFrame:
    """One row: items, how many are whole, containers beyond a limit, items split needlessly, and whether the fill is within ``slack`` of the bound."""
    n = F.col("token_to") - F.col("token_from")
    mine = sizes.groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.count("*").alias("times"), F.sum("n").alias("n"), F.max("n").alias("longest"))
    got = spans.groupBy("doc_id").agg(F.sum(n).alias("got"), F.count("*").alias("parts"))
    items = mine.join(got, "doc_id", "full").agg(
        F.sum("times").alias("items"), F.sum(F.when(F.col("n") == F.col("got"), F.col("times")).otherwise(0)).alias("whole"), F.count_if((F.col("parts") > F.col("times")) & (F.col("longest") <= min(capacity, max_loss))).alias("split_needlessly"), F.sum("n").alias("total"),
    )
    boxes = closed_by(spans, sizes, key, loss, capacity, max_segments, max_loss).agg(
        F.count_if((F.col("tokens") > capacity) | (F.col("segments") > max_segments) | (F.col("loss") > max_loss)).alias("beyond_limits"), F.sum("loss").alias("loss"), F.sum("segments").alias("segments"), F.count("*").alias("boxes"),
    )
    least = F.greatest(F.col("total") / capacity, F.col("segments") / max_segments, F.col("loss") / max_loss)
    return items.crossJoin(boxes).select("items", "whole", "split_needlessly", "beyond_limits", (F.col("boxes") <= F.ceil(least * (1 + slack)) + 1).alias("full"))  # one row each
