"""Cloud tables in Parquet with staged replacement, and uncompressed LAS in and out with colours and extra dimensions.

LAS follows the public specification: point formats 0 to 3, further columns as extra bytes described by a variable-length record.
Rows without finite coordinates aren't written; a field that a file doesn't have is an error that lists those it has.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

from pointspark.sources import storage


def upsert_columns(df: DataFrame, new: dict[str, Column], drop: list[str] | None = None) -> DataFrame:
    return df.withColumns(new).drop(*(drop or []))


def replace_cloud(df: DataFrame, path: str, rows: int | None = None) -> None:
    """Writes beside the target and swaps folders, so that a path being read is never overwritten; a changed row count is an
    error if ``rows`` is given (K1). For file systems with an atomic rename of folders."""
    staged, old = f"{path}.partial", f"{path}.old"
    df.write.mode("overwrite").parquet(staged)
    if rows is not None and (n := df.sparkSession.read.parquet(staged).count()) != rows:
        storage.remove(staged)
        raise ValueError(f"{n} rows instead of {rows}")
    if storage.exists(path):
        storage.move(path, old)
    storage.move(staged, path)
    storage.remove(old)


#: Fixed values of the LAS format: header and record layouts, base fields of point formats, and codes of extra-byte types.
_HEAD = "<4sHHIHH8sBB32s32sHHHIIBHI5I3d3d6d"
_VLR = "<H16sHH32s"
_EXTRA = "<2sBB32s4s24s24s24s24s24s32s"
_BASE = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("flags", "u1"), ("classification", "u1"), ("scan_angle", "i1"), ("user_data", "u1"), ("source_id", "<u2")]
_TIME, _RGB = [("gps_time", "<f8")], [("r", "<u2"), ("g", "<u2"), ("b", "<u2")]
_FORMATS = {0: _BASE, 1: _BASE + _TIME, 2: _BASE + _RGB, 3: _BASE + _TIME + _RGB}
_TYPES = {1: "u1", 2: "i1", 3: "<u2", 4: "<i2", 5: "<u4", 6: "<i4", 7: "<u8", 8: "<i8", 9: "<f4", 10: "<f8"}
_CODES = {"tinyint": 2, "smallint": 4, "int": 6, "bigint": 8, "float": 9, "double": 10, "boolean": 1}
_SPARK = {"u1": "smallint", "i1": "tinyint", "<u2": "int", "<i2": "smallint", "<u4": "bigint", "<i4": "int", "<u8": "decimal(20,0)", "<i8": "bigint", "<f4": "float", "<f8": "double"}


def write_las(df: DataFrame, folder: str, scale: float = 0.001, intensity_scale: float = 1.0) -> DataFrame:
    """One LAS 1.2 file a partition (K2): (file, points). Columns besides x, y, z, intensity and r, g, b become extra dimensions (K1)."""
    colours = all(c in df.columns for c in "rgb")
    base = ["x", "y", "z", *(["intensity"] if "intensity" in df.columns else []), *("rgb" if colours else "")]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    extra = [(c, _CODES[kinds[c]]) for c in df.columns if c not in base and kinds[c] in _CODES]
    dropped = [c for c in df.columns if c not in base and kinds[c] not in _CODES]
    if dropped:
        raise ValueError(f"LAS can't hold {dropped}")
    point = np.dtype((_BASE + _RGB if colours else _BASE) + [(c, _TYPES[k]) for c, k in extra])
    names = [*base, *[c for c, _ in extra]]
    described = b"".join(struct.pack(_EXTRA, b"", k, 0, c.encode()[:32], b"", b"", b"", b"", b"", b"", b"") for c, k in extra)
    vlr = struct.pack(_VLR, 0, b"LASF_Spec", 4, len(described), b"Extra bytes") + described if extra else b""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, lo, hi, offset, body = 0, np.full(3, np.inf), np.full(3, -np.inf), None, []
        for b in batches:
            col = {c: b.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(names)}
            xyz = np.column_stack([col[c].astype(float) for c in "xyz"])
            ok = np.isfinite(xyz).all(axis=1)
            xyz = xyz[ok]
            if not len(xyz):
                continue
            offset = np.floor(xyz[0]) if offset is None else offset
            rec = np.zeros(len(xyz), dtype=point)
            for i, c in enumerate("XYZ"):
                rec[c] = np.round((xyz[:, i] - offset[i]) / scale)
            for c in names[3:]:
                v = col[c][ok]
                if c in base:
                    v = np.nan_to_num(v.astype(float)) * (intensity_scale if c == "intensity" else 1.0)
                    rec[c] = np.clip(v, 0, 65535)
                else:
                    # whole numbers have no NaN: a missing one is 0
                    rec[c] = v if point[c].kind == "f" else (v if v.dtype.kind in "iub" else [0 if x is None or x != x else int(x) for x in v])
            body.append(rec.tobytes())
            n, lo, hi = n + len(rec), np.minimum(lo, xyz.min(axis=0)), np.maximum(hi, xyz.max(axis=0))
        if n:
            box = [v for a, b in zip(hi, lo) for v in (a, b)]
            head = struct.pack(_HEAD, b"LASF", 0, 0, 0, 0, 0, b"", 1, 2, b"pointspark", b"pointspark", 1, 1, 227, 227 + len(vlr), 1 if extra else 0, 2 if colours else 0, point.itemsize, n, n, 0, 0, 0, 0, scale, scale, scale, *offset, *box)
            name = f"{folder.rstrip('/')}/part-{TaskContext.get().partitionId():05d}.las"
            storage.write_whole(name, [head, vlr, *body])
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], names=["file", "points"])

    return df.select(*names).mapInArrow(save, "file string, points long")


def las_layout(path: str) -> tuple[dict, list[tuple[str, str]]]:
    """(header figures, fields as (name, NumPy type)) of a LAS file, extra dimensions included."""
    with storage.reader(path) as f:
        raw = f.read(227)
        h = struct.unpack(_HEAD, raw)
        if h[0] != b"LASF" or h[16] not in _FORMATS:
            raise ValueError(f"{path}: not an uncompressed LAS file of point format 0 to 3")
        fields = list(_FORMATS[h[16]])
        f.seek(h[13])
        for _ in range(h[15]):
            _, user, record, length, _ = struct.unpack(_VLR, f.read(54))
            data = f.read(length)
            if user.rstrip(b"\0") == b"LASF_Spec" and record == 4:
                for i in range(0, length - 191, 192):
                    e = struct.unpack(_EXTRA, data[i : i + 192])
                    fields.append((e[3].rstrip(b"\0").decode(), _TYPES[e[1]]))
    return {"at": h[14], "size": h[17], "points": h[18], "scale": h[24:27], "offset": h[27:30], "box": h[30:36]}, fields


def read_las(spark: SparkSession, path: str, per_task: int = 1_000_000, fields: list[str] | None = None, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """(file, point_id, x, y, z, intensity or the named fields) of uncompressed LAS files, by ranges of records.

    ``origin`` is taken off the coordinates. A field that one of the files doesn't have is an error that lists its fields.
    """
    wanted, jobs, kinds = fields if fields is not None else ["intensity"], [], {}
    for f in storage.listing(path, ".las"):
        head, layout = las_layout(f)
        have = dict(layout)
        missing = [c for c in wanted if c not in have]
        if missing:
            raise ValueError(f"{f}: no fields {missing}; there are {sorted(have)}")
        kinds = {c: _SPARK[have[c]] for c in wanted} if not kinds else kinds
        about = json.dumps([head["scale"], head["offset"], layout])
        jobs += [(f, head["at"], head["size"], a, min(per_task, head["points"] - a), about) for a in range(0, head["points"], per_task)]
    if not jobs:
        return spark.createDataFrame([], "file string, point_id long, x double, y double, z double" + "".join(f", `{c}` {kinds.get(c, 'int')}" for c in wanted))
    rows = spark.createDataFrame(jobs, "file string, at long, size int, start long, n long, about string").repartition(len(jobs))
    arrow = {"smallint": pa.int16(), "tinyint": pa.int8(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "decimal(20,0)": pa.decimal128(20, 0)}

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for j in b.to_pylist():
                scale, offset, layout = json.loads(j["about"])
                dt = np.dtype([tuple(x) for x in layout])
                with storage.reader(j["file"]) as f:
                    f.seek(j["at"] + j["start"] * j["size"])
                    raw = np.frombuffer(f.read(j["n"] * j["size"]), dtype=np.uint8).reshape(-1, j["size"])[:, : dt.itemsize]
                rec = np.ascontiguousarray(raw).view(dt).ravel()
                xyz = [rec[c] * scale[i] + (offset[i] - origin[i]) for i, c in enumerate("XYZ")]
                cols = [pa.array([int(v) for v in rec[c]], type=arrow[kinds[c]]) if kinds[c].startswith("dec") else pa.array(rec[c]).cast(arrow[kinds[c]]) for c in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([j["file"]] * len(rec)), pa.array(np.arange(j["start"], j["start"] + len(rec))), *map(pa.array, xyz), *cols], names=["file", "point_id", "x", "y", "z", *wanted])

    return rows.mapInArrow(load, "file string, point_id long, x double, y double, z double" + "".join(f", `{c}` {kinds[c]}" for c in wanted))
