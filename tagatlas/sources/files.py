"""Byte ranges of files in any store that pyarrow knows (local and mounted folders, addresses with a scheme), and over http.

Snapshots: what a file is known by (its ETag, or size and time) is pinned when a read is planned, and every task holds what it reads against
that. A file that was replaced meanwhile is an error (Changed), never half of each; steady() then plans and reads once more.
Folders: a file `_current` lists the files that count. It is swapped in one step, so a reader sees all files of a run or none of them.
"""

from __future__ import annotations

import json
import tempfile
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable
from typing import TypeVar

import pyarrow.fs

T = TypeVar("T")
CURRENT, CHANGED = "_current", "changed since its read was planned"


class Changed(OSError):
    """A file is no longer the one whose read was planned."""

    def __init__(self, path: str) -> None:
        super().__init__(f"{path} {CHANGED}")


def store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


def listed(path: str, ending: str) -> list[str]:
    """An http address or a file itself, or the files of a folder with an ending, in order: those that its list names, or without a list all but hidden and unfinished ones (_ or . first)."""
    if _over_http(path):
        return [path]
    fs, inner = store(path)
    info = fs.get_file_info(inner)
    if info.type == pyarrow.fs.FileType.File:
        return [path]
    names = current(path)
    if names is not None:
        return [f"{path.rstrip('/')}/{n}" for n in names if n.endswith(ending)]
    found = [f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(inner)) if f.type == pyarrow.fs.FileType.File and f.base_name.endswith(ending) and f.base_name[0] not in "_."]
    return [f"{path.rstrip('/')}/{p.rsplit('/', 1)[-1]}" for p in sorted(found)]


def current(folder: str) -> list[str] | None:
    """The names in a folder's list, or None if it has no list."""
    fs, inner = store(folder.rstrip("/"))
    if fs.get_file_info(f"{inner}/{CURRENT}").type != pyarrow.fs.FileType.File:
        return None
    with fs.open_input_stream(f"{inner}/{CURRENT}") as file:
        return json.loads(file.read())["files"]


def make_current(folder: str, names: list[str]) -> None:
    """Swaps a folder's list for one of these names, in one step. Files that it no longer names stay, for reads that are under way, until unlisted ones are removed."""
    fs, inner = store(folder.rstrip("/"))
    own = f"{inner}/{CURRENT}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        out.write(json.dumps({"files": sorted(names)}).encode())
    fs.move(own, f"{inner}/{CURRENT}")


def remove_unlisted(folder: str, ending: str) -> int:
    """Removes the files with an ending that a folder's list doesn't name; for times when no older read is under way. Returns how many."""
    names = current(folder)
    if names is None:
        return 0
    fs, inner = store(folder.rstrip("/"))
    gone = [f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(inner)) if f.type == pyarrow.fs.FileType.File and f.base_name.endswith(ending) and f.base_name not in names]
    for path in gone:
        fs.delete_file(path)
    return len(gone)


def snapshot(path: str) -> str:
    """What a file or address is known by: changes when its content is replaced."""
    if _over_http(path):
        return _HttpFile(path).etag
    fs, inner = store(path)
    info = fs.get_file_info(inner)
    if info.type != pyarrow.fs.FileType.File:
        raise FileNotFoundError(path)
    return f"{info.size}-{info.mtime_ns}"


def steady(make: Callable[[], T]) -> T:
    """make(), which plans and runs a read; once more if a file changed under it, and an error if one does again."""
    try:
        return make()
    except Exception as e:  # an error of a task comes as the engine's own, with the message inside
        if CHANGED not in str(e):
            raise
        return make()


def _over_http(path: str) -> bool:
    return path.startswith(("http://", "https://"))


def http_range(url: str, offset: int, length: int, timeout: float = 60) -> tuple[bytes, int | None]:
    """Bytes of an address, and its whole size if the answer tells."""
    return _http_range(url, offset, length, timeout)[:2]


def _http_range(url: str, offset: int, length: int, timeout: float = 60) -> tuple[bytes, int | None, str]:
    """Bytes of an address, its whole size if the answer tells, and its ETag, or else its time ("" if neither is told).

    A server that refuses a first range as longer than the file (416) is asked again for all it has. Any other status from 300 on is an
    error, and so is a whole file (200) longer than asked or of unknown length: such a server doesn't serve ranges."""

    def asked(last: int):
        request = urllib.request.Request(url, headers={"Range": f"bytes={offset}-{last}", "Accept-Encoding": "identity"})
        try:
            return urllib.request.urlopen(request, timeout=timeout)
        except urllib.error.HTTPError as e:
            return e

    with asked(offset + length - 1) as first:
        status, told = first.status, first.headers.get("Content-Range") or ""
        if status != 416 or offset:
            return _answered(first, length)
    if not told.startswith("bytes */"):
        raise OSError(f"{url}: refused a range without telling its length")
    with asked(int(told[8:]) - 1) as second:
        return _answered(second, length)


def _answered(answer, length: int) -> tuple[bytes, int | None, str]:
    if answer.status >= 300:
        raise OSError(f"{answer.url}: status {answer.status}")
    size = answer.headers.get("Content-Length")
    if answer.status == 200 and (size is None or int(size) > length):
        raise OSError(f"{answer.url}: serves no byte ranges")
    told = (answer.headers.get("Content-Range") or "").rpartition("/")[2]
    known = answer.headers.get("ETag") or answer.headers.get("Last-Modified") or ""
    return answer.read(), int(told) if told.isdigit() else int(size) if answer.status == 200 else None, known


class _HttpFile:
    """The part of a file's interface that Ranges needs, over ranges of an address."""

    def __init__(self, url: str) -> None:
        self.url, self.at = url, 0
        _, self.known, self.etag = _http_range(url, 0, 1)

    def size(self) -> int:
        if self.known is None:
            raise OSError(f"{self.url}: tells no length")
        return self.known

    def seek(self, at: int) -> None:
        self.at = at

    def read(self, length: int) -> bytes:
        got, size, etag = _http_range(self.url, self.at, length) if length else (b"", self.known, self.etag)
        if etag != self.etag or (size is not None and size != self.known):
            raise Changed(self.url)
        if len(got) != length:
            raise OSError(f"{self.url}: {len(got)} bytes of {length} at {self.at}")
        self.at += length
        return got

    def close(self) -> None:
        pass


class Ranges:
    """An open file or http address to read ranges of; a range that reaches past the end is cut there.

    It must be the snapshot that was planned, if one is given, and stay the same: an address is held against it with every range, a
    file when it is opened and again when it is closed, before a task's rows count."""

    def __init__(self, path: str, planned: str | None = None) -> None:
        self.path = path
        if _over_http(path):
            self.file = _HttpFile(path)
            self.size, self.snapshot = self.file.size(), self.file.etag
        else:
            fs, inner = store(path)
            self.snapshot = snapshot(path)
            self.file = fs.open_input_file(inner)
            self.size = self.file.size()
        if planned is not None and planned != self.snapshot:
            self.file.close()
            raise Changed(path)

    def read(self, offset: int, length: int) -> bytes:
        if offset < 0 or offset > self.size:
            raise ValueError(f"range begins outside the file: {offset} of {self.size}")
        self.file.seek(offset)
        return self.file.read(min(length, self.size - offset))

    def __enter__(self) -> Ranges:
        return self

    def __exit__(self, kind: object, *_: object) -> None:
        self.file.close()
        if kind is None and not _over_http(self.path):
            try:
                same = snapshot(self.path) == self.snapshot
            except FileNotFoundError:
                same = False
            if not same:
                raise Changed(self.path)


def shared_folder(spark, what: str) -> str:
    """A fresh path that driver and executors reach: under spark.checkpoint.dir; a local one only where it is unset and the master is local."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tagatlas-")
    return f"{where.rstrip('/')}/{what}-{uuid.uuid4().hex}"
