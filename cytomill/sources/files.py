"""Opening of plain or gzip files, on local disks or any store that pyarrow reads, with the errors users expect."""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from typing import IO

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it; a path without a scheme is local. As with Hadoop's paths, a per cent
    sign in a path is itself, so the folders that Spark writes are found by their names."""
    if "://" not in path:
        return fs.LocalFileSystem(), path
    scheme, _, rest = path.partition("://")
    authority, _, name = rest.partition("/")
    at, root = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return at, f"{root.rstrip('/')}/{name}"


def exists(path: str) -> bool:
    at, name = located(path)
    return at.get_file_info(name).type == fs.FileType.File


def modified(path: str) -> int | None:
    """Nanoseconds of the last change, None if there is no such file or folder."""
    at, name = located(path)
    return at.get_file_info(name).mtime_ns


def size(path: str) -> int:
    at, name = located(path)
    return at.get_file_info(name).size


def fingerprint(path: str) -> str:
    """What a file or a folder of files holds, by the names, sizes and last bytes of its files: a Parquet file's footer has its rows' numbers, bounds
    and checksums. It changes when data are written anew and stays when a file is only touched; names that begin with _ or a dot do not count."""
    at, name = located(path)
    info = at.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"{path} not found")
    found = [info] if info.type == fs.FileType.File else at.get_file_info(fs.FileSelector(name, recursive=True))
    out = hashlib.sha256()
    for f in sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
        with at.open_input_file(f.path) as source:
            source.seek(max(0, f.size - (64 << 10)))
            out.update(f"{f.path[len(name):]}:{f.size}:".encode() + source.read())
    return out.hexdigest()[:16]


def write_text(path: str, text: str) -> None:
    at, name = located(path)
    if (folder := name.rpartition("/")[0]):
        at.create_dir(folder, recursive=True)
    with at.open_output_stream(name) as f:
        f.write(text.encode())


def listed(path: str) -> list[str]:
    """All files in a folder and those below it, relative to it."""
    at, name = located(path)
    found = at.get_file_info(fs.FileSelector(name, recursive=True))
    return sorted(f.path[len(name.rstrip("/")) + 1 :] for f in found if f.type == fs.FileType.File)


def write_joined(path: str, head: bytes, parts: list[str], piece: int = 4 << 20) -> None:
    """``head`` and the bytes of ``parts`` as one file, copied piece by piece under another name and renamed at the end."""
    at, name = located(path)
    if (folder := name.rpartition("/")[0]):
        at.create_dir(folder, recursive=True)
    passing = f"{name}.{uuid.uuid4().hex}.passing"
    with at.open_output_stream(passing) as to:
        to.write(head)
        for part in parts:
            source, inner = located(part)
            with source.open_input_file(inner) as f:
                while data := f.read(piece):
                    to.write(data)
    at.move(passing, name)


def remove(path: str) -> None:
    """A folder and all in it."""
    at, name = located(path)
    at.delete_dir(name)


def open_binary(path: str) -> IO[bytes]:
    """For reading, with seeks."""
    at, name = located(path)
    if isinstance(at, fs.LocalFileSystem):
        return open(name, "rb")
    return io.BufferedReader(at.open_input_file(name), 1 << 20)


def is_gzip(path: str) -> bool:
    with open_binary(path) as f:
        return f.read(2) == b"\x1f\x8b"


def check_file(path: str) -> None:
    at, name = located(path)
    info = at.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"{path} not found")
    if not info.size:
        raise ValueError(f"{path} is empty")


def open_text(path: str) -> IO[str]:
    """A plain or gzip text file, told apart by its first bytes."""
    check_file(path)
    f = open_binary(path)
    return io.TextIOWrapper(gzip.GzipFile(fileobj=f) if is_gzip(path) else f, encoding="utf-8")
