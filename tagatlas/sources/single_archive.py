"""One archive file from many tasks.

    write_one(tiles, "s3://bucket/cycling.pmtiles", metadata='{"name": "cycling"}')

1. Equal tiles are found by a hash of their content; each content belongs to the first tile that has it.
2. Contents are dealt out by ranges of these first ids, and each task writes the compressed contents of its range as one segment. Which
   segments count is told by a table that lists them, so that what a lost or repeated task has left is not read.
3. A prefix sum over the sizes of the segments gives every content its place; runs of ids with one place become entries.
4. Leaf directories are packed by ranges of ids, into segments as well. Only their first ids and lengths meet, in the root directory.
5. The header is known now, and with it the place of each segment in the file: on a local or mounted file system tasks copy
   the segments to their places side by side; in other stores one task joins them as a stream. The file gets its name at the end.

What the driver sees is a row for each task and each leaf, and a root of 16 kB. No task holds more than a blob and a leaf, whatever the archive's size.
"""

from __future__ import annotations

import gzip
import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagatlas.operators.directory import block_runs, joined_runs
from tagatlas.sources import archive_format as fmt
from tagatlas.sources.files import shared_folder, store
from tagatlas.sources.tile_archive import LEAF_ENTRIES, ROOT_ROOM, level

#: Tiles of one content from which on its place is broadcast; there are at most (all tiles / SHARED) such contents.
SHARED = 100_000
#: So many pointers to leaves fit into a root: those of more entries have larger leaves, which are then packed once and not until they are few enough.
POINTERS = 2048
PIECE = 8 << 20


def write_one(tiles: DataFrame, path: str, parts: int | None = None, **options: object) -> None:
    """Writes tiles (tile_id, data; ids without repeats, in any order) as the archive `path`, which is replaced if it exists.

    Options: metadata (JSON), tile_type and tile_compression (numbers), min_lon .. max_lat, center_lon, center_lat, center_zoom. parts is the least
    number of ranges that contents are dealt to; without it, as many as a shuffle has. No tiles give an archive without entries; tiles or ids that are null are left out.
    """
    spark = tiles.sparkSession
    fs, target = store(path)
    folder, _, name = target.rpartition("/")
    work = f"{folder}/_{name}-{uuid.uuid4().hex}"
    fs.create_dir(work, recursive=True)
    by_range = lambda df, c: (df.repartitionByRange(c) if parts is None else df.repartitionByRange(parts, c)).sortWithinPartitions(c)
    compression = int(options.get("tile_compression", fmt.GZIP))

    named = _table(tiles.where("tile_id is not null and data is not null").select(F.col("tile_id").cast("long").alias("tile_id"), "data", F.sha2("data", 256).alias("hash")), "tiles")
    contents = named.groupBy("hash").agg(F.min("tile_id").alias("first"), F.count(F.lit(1)).alias("n"), F.any_value("data").alias("data"))
    root_uri = path[: -len(name)] + work[len(folder) + 1 :]
    blobs = _table(by_range(contents, "first").select("first", "n", "hash", "data").mapInArrow(_data_segments(root_uri, compression == fmt.GZIP), "first long, n long, hash string, segment string, at long, length long"), "blobs")
    data = _segments(blobs)
    entries = joined_runs(_table(block_runs(_places(named, blobs, data).withColumn("archive", F.lit(name))), "runs")).select("tile_id", "run_length", "offset", "length")
    count = entries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("run_length"), F.lit(0)).alias("tiles"), F.min("tile_id").alias("low"), F.max(F.col("tile_id") + F.col("run_length") - 1).alias("high")).first()

    root, leaves = None, []
    if count.n <= 2 * LEAF_ENTRIES:  # few enough for one read, perhaps
        rows = [tuple(r) for r in entries.orderBy("tile_id").collect()]
        _ascending([(r[0], r[0] + r[1] - 1) for r in rows])
        root = gzip.compress(fmt.packed_directory(rows), mtime=0)
        root = root if len(root) <= ROOT_ROOM else None
    size = LEAF_ENTRIES
    while count.n > POINTERS * size:
        size *= 2
    while root is None:
        packed = _table(by_range(entries, "tile_id").mapInArrow(_leaf_segments(root_uri, size), "first long, last long, segment string, at long, length long"), "leaves")
        leaves = _segments(packed)
        start = dict(_starts(leaves))
        pointers = sorted((r.first, r.last, start[r.segment] + r.at, r.length) for r in (_Leaf(*x) for x in packed.collect()))
        _ascending([p[:2] for p in pointers])
        root = gzip.compress(fmt.packed_directory([(first, 0, at, length) for first, _, at, length in pointers]), mtime=0)
        if len(root) > ROOT_ROOM:
            root, size = None, 2 * size

    about = gzip.compress(json.dumps(json.loads(str(options.get("metadata", "{}")))).encode(), mtime=0)
    o = lambda key, default: float(options.get(key, default))
    head = {"root_offset": fmt.LAYOUT.size, "root_length": len(root), "metadata_length": len(about), "leaf_length": sum(n for _, n in leaves), "data_length": sum(n for _, n in data)}
    head |= {"addressed_tiles": count.tiles, "tile_entries": count.n, "tile_contents": blobs.count(), "metadata_offset": fmt.LAYOUT.size + len(root)}
    head["leaf_offset"] = head["metadata_offset"] + len(about)
    head["data_offset"] = head["leaf_offset"] + head["leaf_length"]
    head |= {"clustered": 1, "internal_compression": fmt.GZIP, "tile_compression": compression, "tile_type": int(options.get("tile_type", 1)), "min_zoom": level(count.low or 0), "max_zoom": level(count.high or 0)}
    head |= {"min_lon": o("min_lon", -180), "min_lat": o("min_lat", -85), "max_lon": o("max_lon", 180), "max_lat": o("max_lat", 85), "center_zoom": int(o("center_zoom", 0)), "center_lon": o("center_lon", 0), "center_lat": o("center_lat", 0)}
    _join(spark, root_uri, fmt.packed_header(head) + root + about, leaves + data, f"{root_uri}/whole")
    fs.move(f"{work}/whole", target)
    fs.delete_dir(work)


class _Leaf:
    def __init__(self, first, last, segment, at, length) -> None:
        self.first, self.last, self.segment, self.at, self.length = first, last, segment, at, length


def _table(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: tasks that write segments run for it once, and lost executors don't repeat them."""
    out = shared_folder(df.sparkSession, what)
    df.write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def _ascending(ranges: list[tuple[int, int]]) -> None:
    for (_, last), (first, _) in zip(ranges, ranges[1:]):
        if first <= last:
            raise ValueError(f"tile id {first} more than once")


class _Segment:
    """A new file of a folder to which a task appends; it is made with the first bytes."""

    def __init__(self, folder: str) -> None:
        self.fs, self.folder = store(folder)
        self.name, self.size, self.out = uuid.uuid4().hex, 0, None

    def append(self, data: bytes) -> int:
        if self.out is None:
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}")
        self.out.write(data)
        self.size += len(data)
        return self.size - len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def _data_segments(folder: str, compress: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = _Segment(folder)
        for batch in batches:
            at, length = [], []
            for value in batch["data"]:
                stored = value.as_py()
                stored = gzip.compress(stored, mtime=0) if compress else stored
                at.append(segment.append(stored))
                length.append(len(stored))
            yield pa.RecordBatch.from_arrays([batch["first"], batch["n"], batch["hash"], pa.array([segment.name] * len(at)), pa.array(at, pa.int64()), pa.array(length, pa.int64())], ["first", "n", "hash", "segment", "at", "length"])
        segment.close()

    return of


def _leaf_segments(folder: str, size: int):
    """Entries in order, packed as leaves of at most size entries; a range ends with a shorter one."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, held = _Segment(folder), np.zeros((4, 0), np.int64)

        def leaf(entries: np.ndarray) -> tuple:
            firsts, lasts = entries[0], entries[0] + entries[1] - 1
            for k in np.flatnonzero(firsts[1:] <= lasts[:-1])[:1]:
                _ascending([(firsts[k], lasts[k]), (firsts[k + 1], lasts[k + 1])])
            packed = gzip.compress(fmt.packed_columns(*entries), mtime=0)
            return int(firsts[0]), int(lasts[-1]), segment.name, segment.append(packed), len(packed)

        names = ["first", "last", "segment", "at", "length"]
        rows = lambda found: pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names)
        for batch in batches:
            held = np.concatenate([held, [batch[c].to_numpy(zero_copy_only=False) for c in ("tile_id", "run_length", "offset", "length")]], axis=1)
            full = held.shape[1] // size * size
            found = [leaf(held[:, k : k + size]) for k in range(0, full, size)]
            held = held[:, full:]
            if found:
                yield rows(found)
        if held.shape[1]:
            yield rows([leaf(held)])
        segment.close()

    return of


def _segments(rows: DataFrame) -> list[tuple[str, int]]:
    """(name, size) of segments in the order of what they hold; one row for each task that wrote any."""
    got = rows.groupBy("segment").agg(F.min("first").alias("first"), F.sum("length").alias("size")).orderBy("first", "segment").collect()
    return [(r.segment, r.size) for r in got]


def _starts(segments: list[tuple[str, int]]) -> Iterator[tuple[str, int]]:
    at = 0
    for name, size in segments:
        yield name, at
        at += size


def _places(named: DataFrame, blobs: DataFrame, segments: list[tuple[str, int]]) -> DataFrame:
    """(tile_id, offset, length) of every tile. Tiles with a content of their own need no join; contents of very many tiles are broadcast, all others join by hash."""
    starts = named.sparkSession.createDataFrame(list(_starts(segments)), "segment string, start long")
    placed = blobs.join(F.broadcast(starts), "segment").select("first", "n", "hash", (F.col("start") + F.col("at")).alias("offset"), "length")
    alone = placed.where("n = 1").select(F.col("first").alias("tile_id"), "offset", "length")
    most, some = placed.where(F.col("n") > SHARED), placed.where((F.col("n") > 1) & (F.col("n") <= SHARED))
    many, ids = F.broadcast(most.select("hash", "offset", "length")), named.select("tile_id", "hash")
    rest = ids.join(F.broadcast(most.select("hash")), "hash", "left_anti").join(some.select("hash", "offset", "length"), "hash")
    return alone.unionByName(ids.join(many, "hash").drop("hash")).unionByName(rest.drop("hash"))


def _join(spark, folder: str, head: bytes, segments: list[tuple[str, int]], out: str) -> None:
    """Writes head and then all segments, in order, as the file out."""
    fs, target = store(out)
    jobs, at = [], len(head)
    for name, size in segments:
        jobs.append((name, at, size))
        at += size
    if _in_place(fs):
        with open(target, "wb") as file:
            file.write(head)
            file.truncate(at)

        def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, start, size in zip(*(c.to_pylist() for c in batch.columns)):
                    with open(f"{os.path.dirname(target)}/{name}", "rb") as part, open(target, "r+b") as file:
                        file.seek(start)
                        _copy(part, file, size, name)
                yield batch

    else:
        jobs = [(json.dumps([(n, s) for n, _, s in jobs]), 0, 0)]

        def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            there, whole = store(out)
            for batch in batches:
                with there.open_output_stream(whole) as file:
                    file.write(head)
                    for name, size in json.loads(batch["segment"][0].as_py()):
                        with there.open_input_stream(f"{store(folder)[1]}/{name}") as part:
                            _copy(part, file, size, name)
                yield batch

    if jobs:
        kinds = "segment string, start long, size long"
        made = spark.createDataFrame(jobs, kinds).repartition(max(1, min(len(jobs), 1000))).mapInArrow(copied, kinds)
        if made.count() != len(jobs):
            raise OSError(f"{out}: not all segments were joined")


def _in_place(fs: pyarrow.fs.FileSystem) -> bool:
    """Whether tasks may write into a file side by side."""
    return isinstance(fs, pyarrow.fs.LocalFileSystem)


def _copy(part, file, size: int, name: str) -> None:
    left = size
    while left and (piece := part.read(min(PIECE, left))):
        file.write(piece)
        left -= len(piece)
    if left:
        raise OSError(f"segment {name} is {left} bytes short")
