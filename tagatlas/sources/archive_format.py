"""The binary format of tile archives: headers, directories and compression. Versions 1 and 2 are read, version 3 is read and written."""

from __future__ import annotations

import gzip
import json
import struct
import zlib

import numpy as np
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

# Fixed values of the format: magic words, the header's layout after them, and the numbers of compressions.
MAGIC, LEGACY_MAGIC = b"PMTiles", b"PM"
LAYOUT = struct.Struct("<7sB11QBBBBBB4iB2i")
FIRST_READ, LEGACY_READ = 16_384, 512_000
UNKNOWN, NONE, GZIP = 0, 1, 2
LEGACY_ENTRY = 17
LEGACY_BOUNDS = (-180.0, -85.0, 180.0, 85.0)
_COUNTS = ["root_offset", "root_length", "metadata_offset", "metadata_length", "leaf_offset", "leaf_length", "data_offset", "data_length", "addressed_tiles", "tile_entries", "tile_contents"]
_BYTES = ["clustered", "internal_compression", "tile_compression", "tile_type", "min_zoom", "max_zoom"]
_PLACES = ["min_lon", "min_lat", "max_lon", "max_lat"]
HEADER = StructType(
    [StructField("archive", StringType()), StructField("version", IntegerType())] + [StructField(n, LongType()) for n in _COUNTS] + [StructField(n, IntegerType()) for n in _BYTES]
    + [StructField(n, DoubleType()) for n in _PLACES] + [StructField("center_zoom", IntegerType()), StructField("center_lon", DoubleType()), StructField("center_lat", DoubleType()), StructField("metadata", StringType())]
)


def version(data: bytes) -> int:
    if data[:7] == MAGIC and len(data) >= LAYOUT.size:
        if data[7] != 3:
            raise ValueError(f"archive of version {data[7]}")
        return 3
    if data[:2] == LEGACY_MAGIC:
        return 2 if struct.unpack_from("<H", data, 2)[0] == 2 else 1
    raise ValueError("not a tile archive")


def header(data: bytes) -> dict:
    if version(data) < 3:
        return _legacy_header(data)
    values = LAYOUT.unpack_from(data)
    out = {"version": values[1]} | dict(zip(_COUNTS, values[2:13])) | dict(zip(_BYTES, values[13:19])) | {n: v / 1e7 for n, v in zip(_PLACES, values[19:23])}
    return out | {"center_zoom": values[23], "center_lon": values[24] / 1e7, "center_lat": values[25] / 1e7}


def _legacy_header(data: bytes) -> dict:
    about, entries = struct.unpack_from("<IH", data, 4)
    text = data[10 : 10 + about].decode("utf-8")
    said = json.loads(text) if about else {}
    numbers = lambda key: [float(v) for v in said[key].split(",")] if isinstance(said.get(key), str) else said.get(key)
    bounds, center = numbers("bounds") or LEGACY_BOUNDS, numbers("center") or (0.0, 0.0, 0.0)
    out = dict.fromkeys(_COUNTS, 0) | dict.fromkeys(_BYTES, 0) | dict(zip(_PLACES, bounds))
    compressed = GZIP if said.get("compression") == "gzip" else UNKNOWN
    kind = {"pbf": 1, "png": 2, "jpg": 3, "webp": 4, "avif": 5}.get(said.get("format"), 1 if compressed == GZIP else 0)
    return out | {
        "version": version(data), "root_offset": 10 + about, "root_length": entries * LEGACY_ENTRY, "tile_compression": compressed, "tile_type": kind,
        "min_zoom": int(said.get("minzoom", 0)), "max_zoom": int(said.get("maxzoom", 0)), "center_lon": center[0], "center_lat": center[1], "center_zoom": int(center[2]), "metadata": text,
    }


def packed_header(h: dict) -> bytes:
    fixed = [round(h[n] * 1e7) for n in _PLACES]
    return LAYOUT.pack(MAGIC, 3, *[h[n] for n in _COUNTS], *[h[n] for n in _BYTES], *fixed, h["center_zoom"], round(h["center_lon"] * 1e7), round(h["center_lat"] * 1e7))


def unpacked(data: bytes, compression: int | None = None) -> bytes:
    """Data of a compression by its number, or (None) of whatever its first bytes say: gzip, zlib or raw deflate."""
    if compression in (UNKNOWN, NONE):
        return data
    if compression == GZIP:
        return gzip.decompress(data)
    if compression is not None:
        raise ValueError(f"compression {compression} is not known")
    if data[:2] == b"\x1f\x8b":
        return gzip.decompress(data)
    zlib_like = len(data) > 1 and data[0] & 15 == 8 and data[0] >> 4 <= 7 and (data[0] << 8 | data[1]) % 31 == 0
    return zlib.decompress(data, zlib.MAX_WBITS if zlib_like else -zlib.MAX_WBITS)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def varints(data: bytes) -> list[int]:
    """All numbers of a byte string; one of more than ten bytes, or cut short, is an error."""
    out, n, shift = [], 0, 0
    for b in data:
        n |= (b & 127) << shift
        if b < 128:
            out.append(n)
            n = shift = 0
        elif (shift := shift + 7) > 63:
            raise ValueError("number of more than ten bytes")
    if shift:
        raise ValueError("number cut short")
    return out


def _numbers(data: bytes) -> np.ndarray:
    """varints(), as an array."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    if not len(raw) or raw[-1] > 127:
        return np.array(varints(data), np.int64)
    starts = np.concatenate(([0], ends[:-1] + 1))
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    if place.max() > 8:  # it may pass 63 bits
        return np.array(varints(data), np.int64)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts)


def directory_columns(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """tile_id, run_length, offset and length of the entries of an unpacked directory, which has columns of id steps, runs, lengths and places."""
    values = _numbers(data)
    n = int(values[0])
    if len(values) < 1 + 4 * n:
        raise ValueError("directory cut short")
    steps, runs, lengths, places = (values[1 + k * n : 1 + (k + 1) * n] for k in range(4))
    i, before = np.arange(n), np.cumsum(lengths) - lengths
    # an entry without a place lies behind the one before; its place counts from the last that has one
    start = np.maximum.accumulate(np.where((places != 0) | (i == 0), i, 0))
    return np.cumsum(steps), runs, places[start] - 1 + before - before[start], lengths


def directory(data: bytes) -> list[tuple[int, int, int, int]]:
    """Entries (tile_id, run_length, offset, length) of an unpacked directory."""
    return list(zip(*(c.tolist() for c in directory_columns(data))))


def packed_columns(ids: np.ndarray, runs: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> bytes:
    """The inverse of directory_columns."""
    follows = np.concatenate(([False], offsets[1:] == offsets[:-1] + lengths[:-1]))[: len(ids)]
    values = np.concatenate(([len(ids)], np.diff(ids, prepend=0), runs, lengths, np.where(follows, 0, offsets + 1))).astype(np.int64)
    if values.min() < 0:
        raise ValueError("numbers of a directory are 0 or more, and ids ascend")
    n_bytes = 1 + sum((values >= 1 << 7 * k).astype(np.int64) for k in range(1, 9))
    starts, out = np.cumsum(n_bytes) - n_bytes, np.zeros(int(n_bytes.sum()), np.uint8)
    for k in range(int(n_bytes.max())):
        more = n_bytes > k
        out[starts[more] + k] = (values[more] >> 7 * k) & 127 | np.where(n_bytes[more] > k + 1, 128, 0)
    return out.tobytes()


def packed_directory(entries: list[tuple[int, int, int, int]]) -> bytes:
    return packed_columns(*np.array(entries, np.int64).reshape(-1, 4).T)


def legacy_directory(data: bytes) -> list[tuple[int, int, int, bool, int, int]]:
    """Entries (z, x, y, is_dir, offset, length) of records of 17 bytes."""
    whole = lambda at, n: int.from_bytes(data[at : at + n], "little")
    return [(data[p] & 127, whole(p + 1, 3), whole(p + 4, 3), data[p] > 127, whole(p + 7, 6), whole(p + 13, 4)) for p in range(0, len(data) - LEGACY_ENTRY + 1, LEGACY_ENTRY)]


def packed_legacy_directory(entries: list[tuple[int, int, int, bool, int, int]]) -> bytes:
    """Records in the order of version 1, with offsets of the full 48 bits."""
    order = sorted(entries, key=lambda e: (e[3], e[0], e[1], e[2]))
    return b"".join(bytes([z | is_dir << 7]) + x.to_bytes(3, "little") + y.to_bytes(3, "little") + offset.to_bytes(6, "little") + length.to_bytes(4, "little") for z, x, y, is_dir, offset, length in order)


def packed_legacy_archive(version: int, about: dict, entries: list[tuple[int, int, int, bool, int, int]]) -> bytes:
    """The start of an archive of version 1 or 2: header, metadata and root directory."""
    text = json.dumps(about).encode("utf-8")
    return LEGACY_MAGIC + struct.pack("<HIH", version, len(text), len(entries)) + text + packed_legacy_directory(entries)
