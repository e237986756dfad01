"""PCD files as a Spark data source: read (ascii, binary) by ranges of records, write one file per partition."""

from __future__ import annotations

import io
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from pointspark.sources import storage

#: NumPy and Spark types of PCD TYPE and SIZE; unsigned ones widen by one step.
TYPES = {
    ("F", 4): ("<f4", "float"), ("F", 8): ("<f8", "double"), ("I", 1): ("<i1", "byte"), ("I", 2): ("<i2", "short"), ("I", 4): ("<i4", "int"), ("I", 8): ("<i8", "long"),
    ("U", 1): ("<u1", "short"), ("U", 2): ("<u2", "int"), ("U", 4): ("<u4", "long"), ("U", 8): ("<u8", "decimal(20,0)"),
}
RECORDS_PER_PARTITION = 1_000_000


@dataclass
class Header:
    fields: list[str]
    kinds: list[tuple[str, int]]
    counts: list[int]
    points: int
    data: str
    offset: int

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([(f, TYPES[k][0]) if c == 1 else (f, TYPES[k][0], (c,)) for f, k, c in zip(self.fields, self.kinds, self.counts)])

    @property
    def ddl(self) -> str:
        return ", ".join(f"`{f}` " + (TYPES[k][1] if c == 1 else f"array<{TYPES[k][1]}>") for f, k, c in zip(self.fields, self.kinds, self.counts))


def read_header(path: str) -> Header:
    """Header of a PCD file; compressed data, unknown types and incomplete headers are errors."""
    got: dict[str, list[str]] = {}
    with io.BufferedReader(storage.reader(path)) as f:
        while "DATA" not in got:
            raw = f.readline()
            if not raw:
                raise ValueError(f"{path}: no DATA line")
            words = raw.decode("ascii", "replace").split()
            if words and not words[0].startswith("#"):
                got[words[0].upper()] = words[1:]
        offset = f.tell()
    if not got.get("FIELDS") or len(got.get("SIZE", [])) != len(got["FIELDS"]) or len(got.get("TYPE", [])) != len(got["FIELDS"]):
        raise ValueError(f"{path}: FIELDS, SIZE and TYPE don't agree")
    data = got["DATA"][0].lower()
    if data not in ("ascii", "binary"):
        raise ValueError(f"{path}: DATA {data} can't be read; save it as binary or ascii")
    kinds = [(t.upper(), int(s)) for t, s in zip(got["TYPE"], got["SIZE"])]
    bad = [k for k in kinds if k not in TYPES]
    if bad:
        raise ValueError(f"{path}: unsupported types {bad}")
    points = int(got["POINTS"][0]) if got.get("POINTS") else int(got["WIDTH"][0]) * int(got["HEIGHT"][0])
    return Header(got["FIELDS"], kinds, [int(c) for c in got.get("COUNT", ["1"] * len(kinds))], points, data, offset)


@dataclass
class _Records(InputPartition):
    path: str
    start: int
    count: int


def _files(path: str) -> list[str]:
    return storage.listing(path, ".pcd")


def _arrow(rec: np.ndarray, h: Header, path: str, start: int) -> pa.RecordBatch:
    cols = []
    for f, k, c in zip(h.fields, h.kinds, h.counts):
        v = np.ascontiguousarray(rec[f])
        kind = {"float": pa.float32(), "double": pa.float64(), "byte": pa.int8(), "short": pa.int16(), "int": pa.int32(), "long": pa.int64()}.get(TYPES[k][1], pa.decimal128(20, 0))
        flat = pa.array([int(x) for x in v.ravel()], type=kind) if k == ("U", 8) else pa.array(v.ravel()).cast(kind)
        cols.append(flat if c == 1 else pa.FixedSizeListArray.from_arrays(flat, c).cast(pa.list_(kind)))
    name = os.path.splitext(os.path.basename(path))[0]
    cols += [pa.array([name] * len(rec)), pa.array(np.arange(start, start + len(rec)))]
    return pa.RecordBatch.from_arrays(cols, names=[*h.fields, "_file", "_row"])


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.per = options["path"], int(options.get("recordsPerPartition", RECORDS_PER_PARTITION))

    def partitions(self) -> list[InputPartition]:
        """Fixed-width records can be split anywhere; an ascii file is one partition."""
        out: list[InputPartition] = []
        for p in _files(self.path):
            h = read_header(p)
            step = self.per if h.data == "binary" else max(h.points, 1)
            out += [_Records(p, a, min(step, h.points - a)) for a in range(0, h.points, step)]
        return out

    def read(self, part: _Records) -> Iterator[pa.RecordBatch]:
        h = read_header(part.path)
        dt, step = h.dtype, 65_536
        if h.data == "binary":
            with io.BufferedReader(storage.reader(part.path)) as f:
                f.seek(h.offset + part.start * dt.itemsize)
                for a in range(part.start, part.start + part.count, step):
                    raw = f.read(min(step, part.start + part.count - a) * dt.itemsize)
                    rec = np.frombuffer(raw[: len(raw) // dt.itemsize * dt.itemsize], dtype=dt)
                    if not len(rec):
                        return
                    yield _arrow(rec, h, part.path, a)
            return
        with io.BufferedReader(storage.reader(part.path)) as f:
            f.seek(h.offset)
            done = 0
            while done < part.count:
                lines = [ln.split() for ln in (f.readline() for _ in range(min(step, part.count - done))) if ln.strip()]
                if not lines:
                    return
                rec = np.zeros(len(lines), dtype=dt)
                at = 0
                for name, c in zip(h.fields, h.counts):
                    block = np.array([ln[at : at + c] for ln in lines])
                    kind = rec.dtype[name].base
                    rec[name] = (block.astype(kind) if kind.kind == "f" else block.astype(float).astype(kind)).reshape(rec[name].shape)
                    at += c
                yield _arrow(rec, h, part.path, done)
                done += len(lines)


@dataclass
class _Written(WriterCommitMessage):
    path: str | None


class _Writer(DataSourceArrowWriter):
    """Binary (or ascii) files, staged under another name and renamed on commit."""

    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.ascii, self.schema = options["path"], options.get("format", "binary") == "ascii", schema

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        back = {"float": ("F", 4), "double": ("F", 8), "tinyint": ("I", 1), "smallint": ("I", 2), "int": ("I", 4), "bigint": ("I", 8)}
        fields = [(f.name, back[f.dataType.simpleString()]) for f in self.schema.fields if f.dataType.simpleString() in back]
        dt = np.dtype([(n, TYPES[k][0]) for n, k in fields])
        names, body, n = [n for n, _ in fields], [], 0
        for b in batches:
            rec = np.zeros(b.num_rows, dtype=dt)
            for name in names:
                v = b.column(b.schema.names.index(name)).to_numpy(zero_copy_only=False)
                rec[name] = np.nan_to_num(v, nan=0) if dt[name].kind == "i" else v
            body.append("".join(" ".join(repr(x) for x in r) + "\n" for r in rec.tolist()).encode() if self.ascii else rec.tobytes())
            n += b.num_rows
        if not n:
            return _Written(None)
        # the header holds the count, and shared storage can't be sought in while it is written
        head = ["# .PCD v0.7", "VERSION 0.7", "FIELDS " + " ".join(names), "SIZE " + " ".join(str(k[1]) for _, k in fields), "TYPE " + " ".join(k[0] for _, k in fields), "COUNT " + " ".join("1" for _ in fields)]
        head += [f"WIDTH {n}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {n}", f"DATA {'ascii' if self.ascii else 'binary'}"]
        staged = f"{self.path.rstrip('/')}/.{uuid.uuid4().hex}.partial"
        storage.write_whole(staged, [("\n".join(head) + "\n").encode(), *body])
        return _Written(staged)

    def commit(self, messages: list) -> None:
        for i, m in enumerate(m for m in messages if m is not None and m.path):
            storage.move(m.path, f"{self.path.rstrip('/')}/part-{i:05d}.pcd")

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and m.path:
                storage.remove(m.path)


def merge_files(path: str, target: str) -> int:
    """One binary cloud from the files of a folder with equal fields (K3): headers are summed, bodies are copied in blocks."""
    heads = [(f, read_header(f)) for f in _files(path)]
    first = heads[0][1]
    if any((h.fields, h.kinds, h.counts, h.data) != (first.fields, first.kinds, first.counts, "binary") for _, h in heads):
        raise ValueError("files differ in their fields, or aren't binary")
    n = sum(h.points for _, h in heads)
    head = ["# .PCD v0.7", "VERSION 0.7", "FIELDS " + " ".join(first.fields), "SIZE " + " ".join(str(k[1]) for k in first.kinds), "TYPE " + " ".join(k[0] for k in first.kinds), "COUNT " + " ".join(map(str, first.counts))]
    head += [f"WIDTH {n}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {n}", "DATA binary"]

    def blocks():
        yield ("\n".join(head) + "\n").encode()
        for name, h in heads:
            with storage.reader(name) as f:
                f.seek(h.offset)
                left = h.points * h.dtype.itemsize
                while left > 0 and (raw := f.read(min(left, 16 << 20))):
                    left -= len(raw)
                    yield raw

    storage.write_whole(target, blocks())
    return n


class PcdSource(DataSource):
    """``spark.read.format("pcd").load(path)``: a file or a folder of files with equal fields."""

    @classmethod
    def name(cls) -> str:
        return "pcd"

    def schema(self) -> str:
        return read_header(_files(self.options["path"])[0]).ddl + ", _file string, _row long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PcdSource)


def bounds(df: DataFrame) -> DataFrame:
    """(n, x_min ... z_max) of finite points."""
    from pointspark.functions.missing import finite

    return df.agg(F.count("*").alias("n"), *[a for c in ("x", "y", "z") for a in (F.min(finite(c)).alias(f"{c}_min"), F.max(finite(c)).alias(f"{c}_max"))])


def cached_bounds(spark: SparkSession, path: str, cache: str) -> DataFrame:
    """bounds of a file or folder, kept in a JSON file beside it and taken from there until a file's name, size or time changes."""
    stamp = [list(storage.stamp(f)) for f in _files(path)]
    if storage.exists(cache):
        with storage.reader(cache) as f:
            kept = json.loads(f.read())
        if kept["files"] == stamp:
            return spark.createDataFrame([kept["bounds"]], "n long, " + ", ".join(f"{c}_{s} double" for c in "xyz" for s in ("min", "max")))
    register(spark)
    got = bounds(spark.read.format("pcd").load(path))
    storage.write_whole(cache, [json.dumps({"files": stamp, "bounds": list(got.first())}).encode()])
    return cached_bounds(spark, path, cache)


def without_constant_channels(df: DataFrame, channels: list[str]) -> DataFrame:
    """Drops channels that hold nothing but their marker."""
    from pointspark.functions.missing import constant_channels

    empty = [r["channel"] for r in constant_channels(df, channels).where("given = 0").collect()]
    return df.drop(*empty)


def unpack_rgb(df: DataFrame, rgb: str = "rgb") -> DataFrame:
    """Packed colours as r, g, b in 0..255 (K2)."""
    at = lambda n: F.shiftright(F.col(rgb), n).bitwiseAND(255).cast("int")
    return df.withColumns({"r": at(16), "g": at(8), "b": at(0)})
