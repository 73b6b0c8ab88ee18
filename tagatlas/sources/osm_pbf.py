"""OpenStreetMap extracts (PBF) as a Spark data source.

    spark.dataSource.register(OsmPbf)
    spark.read.format("osm_pbf").load(path)

gives feature_type (node, way, relation), osm_id, lon, lat, nodes, members and tags. An extract is a row of blobs; the planner only
reads the few bytes before each to learn where it lies, and tasks unpack about blob_bytes of them each.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tagatlas.sources.archive_format import varints
from tagatlas.sources.files import Ranges, listed

SCHEMA = "feature_type string, osm_id bigint, lon double, lat double, nodes array<bigint>, members array<struct<type:string,ref:bigint,role:string>>, tags map<string,string>"
ENDING = ".pbf"
#: Fixed values of the format: member types by number.
MEMBER_TYPES = ("node", "way", "relation")


class OsmPbf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("blob_bytes", 32 << 20)))


@dataclass
class Blobs(InputPartition):
    path: str
    places: list[tuple[int, int]]


class _Reader(DataSourceReader):
    def __init__(self, path: str, blob_bytes: int) -> None:
        self.path, self.blob_bytes = path, blob_bytes

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in listed(self.path, ENDING):
            places, size = [], 0
            with Ranges(path) as file:
                at = 0
                while at < file.size:
                    (n,) = struct.unpack(">I", file.read(at, 4))
                    head = dict(fields(file.read(at + 4, n)))
                    at, length = at + 4 + n, head[3]
                    if head[1] == b"OSMData":
                        places.append((at, length))
                        size += length
                    at += length
                    if size >= self.blob_bytes:
                        out.append(Blobs(path, places))
                        places, size = [], 0
            if places:
                out.append(Blobs(path, places))
        return out or [Blobs("", [])]

    def read(self, part: Blobs) -> Iterator[tuple]:
        if part.places:
            with Ranges(part.path) as file:
                for at, length in part.places:
                    yield from elements(unpacked(file.read(at, length)))


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbered fields of a protocol-buffer message: whole numbers and byte strings."""
    at = 0

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        elif kind == 2:
            n = number()
            yield tag >> 3, data[at : at + n]
            at += n
        elif kind in (1, 5):
            at += 8 if kind == 1 else 4
        else:
            raise ValueError(f"unknown kind of field {kind}")


def unpacked(blob: bytes) -> bytes:
    f = dict(fields(blob))
    if 1 in f:
        return f[1]
    if 3 in f:
        return zlib.decompress(f[3])
    raise ValueError("blob is compressed in a way this reader doesn't know")


def _signed(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def _whole(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _steps(data: bytes) -> list[int]:
    out, at = [], 0
    for v in varints(data):
        at += _signed(v)
        out.append(at)
    return out


def elements(block: bytes) -> Iterator[tuple]:
    words: list[str] = []
    groups, scale, north, east = [], 100, 0, 0
    for number, value in fields(block):
        if number == 1:
            words = [w.decode("utf-8", "replace") for k, w in fields(value) if k == 1]
        elif number == 2:
            groups.append(value)
        elif number == 17:
            scale = value
        elif number == 19:
            north = _whole(value)
        elif number == 20:
            east = _whole(value)
    place = lambda lon, lat: ((east + scale * lon) / 1e9, (north + scale * lat) / 1e9)
    for group in groups:
        for number, value in fields(group):
            if number == 2:
                yield from _dense(value, words, place)
            elif number in (1, 3, 4):
                f = dict(fields(value))
                tags = {words[k]: words[v] for k, v in zip(varints(f.get(2, b"")), varints(f.get(3, b"")))}
                if number == 1:
                    yield ("node", _signed(f[1]), *place(_signed(f[9]), _signed(f[8])), None, None, tags)
                elif number == 3:
                    yield ("way", _whole(f[1]), None, None, _steps(f.get(8, b"")), None, tags)
                else:
                    parts = zip(varints(f.get(10, b"")), _steps(f.get(9, b"")), varints(f.get(8, b"")), strict=True)
                    yield ("relation", _whole(f[1]), None, None, None, [(MEMBER_TYPES[t], ref, words[role]) for t, ref, role in parts], tags)


def _dense(data: bytes, words: list[str], place) -> Iterator[tuple]:
    f = dict(fields(data))
    pairs, at = varints(f.get(10, b"")), 0
    for osm_id, lat, lon in zip(_steps(f.get(1, b"")), _steps(f.get(8, b"")), _steps(f.get(9, b"")), strict=True):
        tags = {}
        while at < len(pairs) and pairs[at]:
            tags[words[pairs[at]]] = words[pairs[at + 1]]
            at += 2
        at += 1
        yield ("node", osm_id, *place(lon, lat), None, None, tags)
