"""Percentiles of very large numeric columns from dyadic count-sketches.

A value is encoded as an order-preserving integer of BITS bits (sign, exponent, leading mantissa bits), which bounds the
relative error of a returned value by 2**-(MANTISSA+1). For each binary resolution of the codes a sketch keeps either exact
counts (few nodes) or a count-sketch with random signs (DEPTH rows of WIDTH counters). Everything is linear: sketches are
merged by addition, rows are deleted by adding a negative weight. A rank is inverted by descending the levels from
the coarsest to the finest, going right when the wanted rank exceeds the left child's estimated count.

A group of at most SPARSE distinct codes keeps the signed counts of its codes, from which all levels follow exactly; beyond
that they are spread into the dense counters. Both are the same linear map. Figures: SPARSE codes take 12 bytes each, so
1.5 kB, a dense sketch 280 kB in memory and, packed, 10 to 30 kB for some thousand values; the sparse form is thus only used where it is far
smaller, and it has no error at all.

Errors: a value is the middle of its code's range, 2**-(MANTISSA+1) of its magnitude from the ends. Rank error: 0 for sparse groups;
for dense groups the noise of a level is what collisions leave in the median over DEPTH independent rows. It is read from the
sketch itself, by asking for PHANTOMS nodes that aren't there (random counters and signs): ``rank_error`` is SPREAD times the root of
the summed squares of each signed level's largest answer, or, if less, the exact count of the finest exact node on the way
down, which the answer can't leave.

Defined cases: NULL, NaN and the missing marker -1 (within 1e-6) are left out; infinities are valid extreme values; magnitudes
below 2**-128 count as zero and from (1 - 2**-10) * 2**128 on as infinite; groups without a valid value give no row; group
columns may be NULL; repeated rows count as delivered; empty input gives empty output.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointspark.session import shuffle_partitions

MANTISSA, EXPONENT_BITS = 9, 8
BITS = 1 + EXPONENT_BITS + MANTISSA
WIDTH, DEPTH = 512, 7
#: Levels with at most so many nodes keep exact counts: 8 of the 18; the 10 finer ones are signed.
EXACT_NODES = 256
SPARSE = 128
SPREAD, PHANTOMS = 1.5, 1024
#: A task hands on its partial sketches when it holds so many buffered entries (a dense sketch counts all its counters).
FLUSH_ENTRIES = 16_000_000
_HALF = 1 << (BITS - 1)
_LOW_EXP = 1023 - (1 << (EXPONENT_BITS - 1))
MARKER, TOLERANCE = -1.0, 1e-6
SCHEMA = "n long, codes array<int>, counts array<long>, dense binary"


def encode(values: np.ndarray) -> np.ndarray:
    """Order-preserving codes 0 .. 2**BITS - 1 of doubles."""
    bits = np.abs(values).astype(np.float64).view(np.int64)
    mag = (bits >> (52 - MANTISSA)) - (_LOW_EXP << MANTISSA) + 1
    mag = np.clip(mag, 0, _HALF - 1)
    return np.where(np.signbit(values), _HALF - mag, _HALF + mag).astype(np.int64)


def decode(codes: np.ndarray) -> np.ndarray:
    """Middle of each code's range of values."""
    mag = np.abs(codes - _HALF)
    low = ((np.maximum(mag - 1, 0) + (_LOW_EXP << MANTISSA)) << (52 - MANTISSA)) + (1 << (51 - MANTISSA))
    v = np.where(mag == 0, 0.0, low.astype(np.int64).view(np.float64))
    v = np.where(mag == _HALF - 1, np.inf, v)
    return np.where(codes < _HALF, -v, v)


def _levels() -> tuple[list[tuple[int, bool]], np.ndarray]:
    kinds = [(lv, (1 << (BITS - lv)) <= EXACT_NODES) for lv in range(BITS)]
    sizes = [(1 << (BITS - lv)) if exact else WIDTH * DEPTH for lv, exact in kinds]
    return kinds, np.concatenate([[0], np.cumsum(sizes)])


LEVELS, OFFSETS = _levels()


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64: every bit of the result depends on every bit of x."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@cache
def _hashes(level: int) -> tuple[np.ndarray, np.ndarray]:
    """Counter and sign of every node of a level in each row, with a seed of its own a level and row: [DEPTH, nodes]."""
    seeds = _mixed(_mixed(np.arange(level * DEPTH, (level + 1) * DEPTH, dtype=np.uint64)))
    h = _mixed(np.arange(1 << (BITS - level), dtype=np.uint64)[None, :] ^ seeds[:, None])
    col = (h >> np.uint64(32)) % np.uint64(WIDTH)
    sign = 1 - 2 * ((h >> np.uint64(7)) & np.uint64(1)).astype(np.int8)
    return (OFFSETS[level] + np.arange(DEPTH)[:, None] * WIDTH + col.astype(np.int64)).astype(np.int32), sign


def _slots(level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counter and sign of nodes in each row of a level's count-sketch: [DEPTH, n]."""
    at, sign = _hashes(level)
    return at[:, nodes], sign[:, nodes].astype(np.int64)


def spread(codes: np.ndarray, counts: np.ndarray, into: np.ndarray | None = None) -> np.ndarray:
    """Add signed counts of codes to the dense counters of all levels."""
    cells = np.zeros(OFFSETS[-1], dtype=np.int64) if into is None else into
    for lv, exact in LEVELS:
        node = codes >> lv
        if exact:
            np.add.at(cells, OFFSETS[lv] + node, counts)
        else:
            at, sign = _slots(lv, node)
            np.add.at(cells, at, sign * counts[None, :])
    return cells


def node_counts(cells: np.ndarray, level: int, nodes: np.ndarray) -> np.ndarray:
    if LEVELS[level][1]:
        return cells[OFFSETS[level] + nodes].astype(np.float64)
    at, sign = _slots(level, nodes)
    return np.median(cells[at] * sign, axis=0)


def _descend(cells: np.ndarray, n: int, probs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes at the given probabilities, and the count of the finest exact node that each lies in."""
    rank = np.clip(np.ceil(np.asarray(probs) * n), 1, n)
    node, within = np.zeros(len(rank), dtype=np.int64), np.full(len(rank), n)
    for lv in range(BITS - 1, -1, -1):
        left = np.maximum(node_counts(cells, lv, node * 2), 0)
        right = rank > left
        rank = np.where(right, rank - left, rank)
        node = node * 2 + right
        if LEVELS[lv][1]:
            within = node_counts(cells, lv, node)
    return node, within


def invert(cells: np.ndarray, n: int, probs: np.ndarray) -> np.ndarray:
    """Values at the given probabilities by descending the levels."""
    return decode(_descend(cells, n, probs)[0])


@cache
def _phantoms() -> tuple[np.ndarray, np.ndarray]:
    h = _mixed(np.arange(DEPTH * PHANTOMS, dtype=np.uint64) + np.uint64(1 << 40)).reshape(DEPTH, PHANTOMS)
    return (np.arange(DEPTH)[:, None] * WIDTH + ((h >> np.uint64(32)) % np.uint64(WIDTH)).astype(np.int64)), 1 - 2 * ((h >> np.uint64(7)) & np.uint64(1)).astype(np.int64)


def rank_error(cells: np.ndarray, n: int, probs: np.ndarray) -> float:
    """Bound on the rank error at any of the probabilities, as a share of n."""
    at, sign = _phantoms()
    noise = [np.abs(np.median(cells[OFFSETS[lv] + at] * sign, axis=0)).max() for lv, exact in LEVELS if not exact]
    return float(min(SPREAD * np.square(noise).sum() ** 0.5, _descend(cells, n, probs)[1].max()) / n)


def invert_sparse(codes: np.ndarray, counts: np.ndarray, n: int, probs: np.ndarray) -> np.ndarray:
    rank = np.clip(np.ceil(np.asarray(probs) * n), 1, n)
    at = np.searchsorted(np.cumsum(counts), rank)
    return decode(codes[np.minimum(at, len(codes) - 1)].astype(np.int64))


class Sketch:
    """Signed counts of codes, dense beyond SPARSE distinct codes."""

    __slots__ = ("n", "parts", "held", "cells")

    def __init__(self) -> None:
        self.n, self.parts, self.held, self.cells = 0, [], 0, None

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self.n += int(counts.sum())
        if self.cells is not None:
            spread(codes.astype(np.int64), counts, self.cells)
            return
        self.parts.append((codes, counts))
        self.held += len(codes)
        if self.held > 4 * SPARSE:
            self._compact()

    def add_cells(self, n: int, cells: np.ndarray) -> None:
        self._densify()
        self.n += n
        self.cells += cells

    def _compact(self) -> None:
        codes, at = np.unique(np.concatenate([c for c, _ in self.parts]), return_inverse=True)
        counts = np.zeros(len(codes), dtype=np.int64)
        np.add.at(counts, at, np.concatenate([k for _, k in self.parts]))
        codes, counts = codes[counts != 0], counts[counts != 0]
        self.parts, self.held = [(codes, counts)], len(codes)
        if len(codes) > SPARSE:
            self._densify()

    def _densify(self) -> None:
        if self.cells is None:
            self.cells = np.zeros(OFFSETS[-1], dtype=np.int64)
            for codes, counts in self.parts:
                spread(codes.astype(np.int64), counts, self.cells)
            self.parts, self.held = [], 0

    def row(self) -> tuple:
        if self.cells is None and self.parts:
            self._compact()
        if self.cells is not None:
            return self.n, None, None, zlib.compress(self.cells.tobytes(), 1)
        codes, counts = self.parts[0] if self.parts else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        return self.n, codes.astype(np.int32), counts, None


def _emit(keys: list[tuple], sketches: list[Sketch], schema: pa.Schema, part: int | None) -> pa.RecordBatch:
    rows = [s.row() for s in sketches]
    cols = [pa.array([k[i] for k in keys], type=schema.field(i).type) for i in range(len(keys[0]))]
    if part is not None:
        cols.append(pa.array([part] * len(keys), type=pa.int32()))
    cols += [pa.array([r[i] for r in rows], type=t) for i, t in enumerate((pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()))]
    return pa.RecordBatch.from_arrays(cols, schema=schema)


def _kinds(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def _arrow(df: DataFrame, keys: list[str], part: bool) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [pa.field(k, to_arrow_type(df.schema[k].dataType)) for k in keys] + [pa.field("part", pa.int32())] * part
    return pa.schema([*fields, pa.field("n", pa.int64()), pa.field("codes", pa.list_(pa.int32())), pa.field("counts", pa.list_(pa.int64())), pa.field("dense", pa.binary())])


def build_sketches(df: DataFrame, keys: list[str], value: Column, weight: Column | None = None) -> DataFrame:
    """(keys, n, codes, counts, dense): one sketch a group of ``keys``; a negative ``weight`` deletes.

    Each task folds its rows into partial sketches before anything is shuffled; a hot group thus reaches the merge as one
    partial sketch a task, and those are merged in two rounds.
    """
    v = value.cast("double")
    rows = df.select(*keys, v.alias("_v"), (F.lit(1) if weight is None else weight).cast("long").alias("_w"))
    rows = rows.where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs(F.col("_v") - MARKER) > TOLERANCE))
    k = len(keys)
    schema = _arrow(df, keys, True)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId() if context else 0
        held: dict[tuple, Sketch] = {}
        buffered = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            gid = np.zeros(batch.num_rows, dtype=np.int64)
            dicts = []
            for i in range(k):
                d = pc.dictionary_encode(batch.column(i), null_encoding="encode")
                gid = gid * max(len(d.dictionary), 1) + d.indices.to_numpy(zero_copy_only=False)
                dicts.append(d)
            codes = encode(batch.column(k).to_numpy())
            w = batch.column(k + 1).to_numpy()
            both, at = np.unique(gid * (1 << BITS) + codes, return_inverse=True)
            counts = np.zeros(len(both), dtype=np.int64)
            np.add.at(counts, at, w)
            groups, starts = np.unique(both >> BITS, return_index=True)
            codes = (both & ((1 << BITS) - 1)).astype(np.int32)
            ends = np.append(starts[1:], len(both))
            names = []
            rest = groups.copy()
            for d in reversed(dicts):
                m = max(len(d.dictionary), 1)
                words = d.dictionary.to_pylist()
                names.append([words[j] for j in rest % m])
                rest //= m
            for key, a, b in zip(zip(*reversed(names)), starts, ends):
                sketch = held.setdefault(key, Sketch())
                sparse = sketch.cells is None
                sketch.add(codes[a:b], counts[a:b])
                buffered += OFFSETS[-1] if sparse and sketch.cells is not None else 0
            buffered += len(both)
            if buffered > FLUSH_ENTRIES:
                yield _emit(list(held), list(held.values()), schema, part)
                held, buffered = {}, 0
        if held:
            yield _emit(list(held), list(held.values()), schema, part)

    partial = rows.mapInArrow(fold, f"{_kinds(df, keys)}, part int, {SCHEMA}")
    fan = max(1, int(shuffle_partitions(df.sparkSession) ** 0.5))
    if fan > 8:  # many tasks: merge each hot group's partial sketches in several tasks first
        partial = _merged(partial.withColumn("part", F.pmod("part", F.lit(fan))), [*keys, "part"])
    return merge_sketches(partial.drop("part"), keys)


def _merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Streaming merge of equal keys: rows are co-located and sorted by key, one sketch is open at a time."""
    k = len(keys)
    schema = _arrow(sketches, keys, False)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_, done_keys, done = None, None, [], []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(k)]
            ns, codes, counts, dense = (batch.column(k + i) for i in range(4))
            for i, now in enumerate(zip(*cols)):
                if now != key:
                    if open_ is not None:
                        done_keys.append(key)
                        done.append(open_)
                        if len(done) >= 256:
                            yield _emit(done_keys, done, schema, None)
                            done_keys, done = [], []
                    key, open_ = now, Sketch()
                if dense[i].is_valid:
                    open_.add_cells(ns[i].as_py(), np.frombuffer(zlib.decompress(dense[i].as_py()), dtype=np.int64))
                else:
                    open_.add(codes[i].values.to_numpy(), counts[i].values.to_numpy())
        if open_ is not None:
            yield _emit([*done_keys, key], [*done, open_], schema, None)

    cols = [F.col(f"`{c}`") for c in keys]
    return sketches.select(*cols, "n", "codes", "counts", "dense").repartition(*cols).sortWithinPartitions(*cols).mapInArrow(merge, f"{_kinds(sketches, keys)}, {SCHEMA}")


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of the sketches of each group of ``keys``; stored sketches of days or loads combine this way."""
    return _merged(sketches, keys)


def subtract(sketches: DataFrame) -> DataFrame:
    """The same sketches with all counts negated: merged with a total, they delete their rows from it."""

    def negate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            cols["n"] = pc.negate(cols["n"])
            cols["counts"] = pa.array([None if x is None else [-y for y in x] for x in cols["counts"].to_pylist()], type=pa.list_(pa.int64()))
            cols["dense"] = pa.array([None if x is None else zlib.compress((-np.frombuffer(zlib.decompress(x), dtype=np.int64)).tobytes(), 1) for x in cols["dense"].to_pylist()], type=pa.binary())
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return sketches.mapInArrow(negate, sketches.schema)


def percentiles(sketches: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """(keys, n, one column a probability, rank_error): values read from the sketches of groups with n > 0.

    rank_error is the bound on the rank error as a share of n: from the sketch's own counters, 0 if exact.
    """
    p = np.array(list(probs.values()))
    names = list(probs)
    k = len(keys)
    base = _arrow(sketches, keys, False)
    schema = pa.schema([*[base.field(i) for i in range(k)], pa.field("n", pa.int64()), *[pa.field(x, pa.float64()) for x in names], pa.field("rank_error", pa.float64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, rows = [], []
            for i in range(b.num_rows):
                n = b.column(k)[i].as_py()
                if n <= 0:
                    continue
                dense = b.column(k + 3)[i]
                if dense.is_valid:
                    cells = np.frombuffer(zlib.decompress(dense.as_py()), dtype=np.int64)
                    rows.append([n, *invert(cells, n, p), rank_error(cells, n, p)])
                else:
                    rows.append([n, *invert_sparse(b.column(k + 1)[i].values.to_numpy(), b.column(k + 2)[i].values.to_numpy(), n, p), 0.0])
                keep.append(i)
            if keep:
                taken = b.select(list(range(k))).take(pa.array(keep))
                cols = [*[taken.column(i) for i in range(k)], *[pa.array([r[j] for r in rows], type=schema.field(k + j).type) for j in range(len(names) + 2)]]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return sketches.select(*keys, "n", "codes", "counts", "dense").mapInArrow(read, f"{_kinds(sketches, keys)}, n long, " + ", ".join(f"`{x}` double" for x in names) + ", rank_error double")


def rank_check(df: DataFrame, keys: list[str], value: Column, found: DataFrame, probs: dict[str, float]) -> DataFrame:
    """(keys, n, within): whether the true ranks of all values of ``found`` keep its rank_error, by counting the rows themselves.

    A value stands for its code's range, so the rows below and up to it are counted with a relative slack of 2**-MANTISSA.
    """
    v = value.cast("double")
    rows = df.select(*[F.col(k).alias(f"_k_{k}") for k in keys], v.alias("_v")).where(v.isNotNull() & ~F.isnan(v) & (F.abs(v - MARKER) > TOLERANCE))
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"_k_{k}").eqNullSafe(F.col(k))
    slack = lambda p: F.when(F.abs(F.col(p)) == float("inf"), F.lit(0.0)).otherwise(F.abs(F.col(p)) * 2.0**-MANTISSA + 2.0**-127)
    top = 2.0**128 * (1 - 2.0**-MANTISSA)
    low = lambda p: F.when(F.col(p) == float("inf"), F.lit(top)).otherwise(F.col(p) - slack(p))
    high = lambda p: F.when(F.col(p) == float("-inf"), F.lit(-top)).otherwise(F.col(p) + slack(p))
    met = rows.join(found, same).groupBy(*keys, "n", "rank_error").agg(F.count("*").alias("_n"), *[F.count_if(F.col("_v") < low(p)).alias(f"_b_{p}") for p in probs], *[F.count_if(F.col("_v") <= high(p)).alias(f"_u_{p}") for p in probs])
    ok = F.col("n") == F.col("_n")
    for p, q in probs.items():
        rank = F.greatest(F.ceil(F.lit(q) * F.col("n")), F.lit(1))
        room = F.col("rank_error") * F.col("n")
        ok &= (F.col(f"_b_{p}") < rank + room) & (F.col(f"_u_{p}") >= rank - room)
    return met.select(*keys, "n", ok.alias("within"))
