"""Files on shared storage: bare paths are mounted folders, URIs (hdfs://, s3://, gs://, file://) go through Arrow's file systems.

Executors open the same path that the driver lists, so it has to be one that all of them see. Nothing here seeks in a file
that is being written, and a file gets its name only when it is whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import pyarrow.fs as pafs


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and the path in it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path[5:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def listing(path: str, suffix: str) -> list[str]:
    """Files of a folder that end so, sorted by name; a file is itself."""
    fs, at = locate(path)
    if fs.get_file_info(at).type != pafs.FileType.Directory:
        return [path]
    names = sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(at)) if i.is_file and i.base_name.endswith(suffix) and not i.base_name.startswith("."))
    return [f"{path.rstrip('/')}/{n}" for n in names]


def reader(path: str):
    """A readable, seekable file."""
    fs, at = locate(path)
    return fs.open_input_file(at)


def write_whole(path: str, parts: Iterable[bytes]) -> None:
    """Writes a file under another name and renames it: readers see all of it or nothing."""
    fs, at = locate(path)
    folder, _, name = at.rpartition("/")
    if folder:
        fs.create_dir(folder, recursive=True)
    staged = f"{folder}/.{name}.{uuid.uuid4().hex}.partial" if folder else f".{name}.{uuid.uuid4().hex}.partial"
    with fs.open_output_stream(staged) as f:
        for p in parts:
            f.write(p)
    fs.move(staged, at)


def move(source: str, target: str) -> None:
    fs, a = locate(source)
    fs.move(a, locate(target)[1])


def remove(path: str) -> None:
    fs, at = locate(path)
    kind = fs.get_file_info(at).type
    if kind == pafs.FileType.Directory:
        fs.delete_dir(at)
    elif kind == pafs.FileType.File:
        fs.delete_file(at)


def exists(path: str) -> bool:
    fs, at = locate(path)
    return fs.get_file_info(at).type != pafs.FileType.NotFound


def stamp(path: str) -> tuple[str, int, float]:
    """(name, size, time of change) of a file."""
    fs, at = locate(path)
    info = fs.get_file_info(at)
    return info.base_name, info.size, info.mtime_ns / 1e9 if info.mtime_ns else 0.0
