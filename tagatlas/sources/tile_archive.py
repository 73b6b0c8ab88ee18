"""Tile archives as a Spark data source.

    spark.dataSource.register(TileArchive)
    spark.read.format("tile_archive").option("what", "tiles").load(path)       one row for each tile: archive, tile_id, data
    ... what = "entries"   archive, directory, tile_id, run_length, offset, length: all directories, as operators.directory.flattened reads them
    ... what = "headers"   one row for each archive
    ... what = "legacy"    archive, directory, z, x, y, is_dir, offset, length of versions 1 and 2
    tiles.repartitionByRange("tile_id").sortWithinPartitions("tile_id").write.format("tile_archive").mode("append").save(folder)

With option("pushdown", "true"), and spark.sql.python.filterPushdown.enabled set, filters on tile_id leave out leaves without such ids.
Reads are of one snapshot: the planner pins what each file is known by, and a task that meets another file fails (files.steady reads anew). With
option("pins", json.dumps(pins(path))), a read is held to a snapshot taken earlier. mode("overwrite") replaces all archives of a folder in one step.
A path is an archive or a folder of them. The planner reads each archive's first bytes; tasks read one leaf directory each (some, where there are over 400) and
the ranges of bytes that it lists. A task writes one archive, of its range of ids, so no blob passes the driver and a lost task is written again.
"""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from tagatlas.sources import archive_format as fmt
from tagatlas.sources.files import Changed, Ranges, current, listed, make_current, snapshot, store

SCHEMAS = {
    "tiles": "archive string, tile_id bigint, data binary",
    "entries": "archive string, directory bigint, tile_id bigint, run_length bigint, offset bigint, length bigint",
    "headers": fmt.HEADER,
    "legacy": "archive string, directory bigint, z int, x bigint, y bigint, is_dir boolean, offset bigint, length bigint",
}
ENDING = ".pmtiles"
ENTRY = ("z", "x", "y", "is_dir", "offset", "length")
DEPTH, ROOT_ROOM, LEAF_ENTRIES = 4, fmt.FIRST_READ - fmt.LAYOUT.size, 4096
READ_AHEAD, ROWS = 8 << 20, 10_000
#: Tasks in which an archive's leaves are read, at most; a task takes longer to begin than a leaf to read.
PARTS = 400


class TileArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tile_archive"

    def _what(self) -> str:
        what = self.options.get("what", "tiles")
        if what not in SCHEMAS:
            raise ValueError(f"what is one of {', '.join(SCHEMAS)}, not {what}")
        return what

    def schema(self):
        return SCHEMAS[self._what()]

    def reader(self, schema) -> DataSourceReader:
        kind = _Narrowed if self.options.get("pushdown", "false").lower() == "true" else _Batches
        return kind(self._what(), self.options["path"], json.loads(self.options.get("pins", "{}")))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], {k: v for k, v in self.options.items() if k != "path"}, [f.name for f in schema.fields], overwrite)


@dataclass
class Part(InputPartition):
    """Directories of an archive: offset and length of neighbouring leaves in the leaf section (None: the root)."""

    path: str
    leaves: list[tuple[int, int]] | None
    snapshot: str


def pins(path: str) -> dict[str, str]:
    """What each archive of a path is known by now."""
    return {archive_name(p): snapshot(p) for p in listed(path, ENDING)}


def blob(folder: str, archive: Column, offset: Column, length: Column, pinned: dict[str, str] | None = None) -> Column:
    """The unpacked tile at a place that a lookup has found in an archive of the folder; NULL where it has found none.

    Only those bytes are read, by the executors; rows sorted by archive and offset are read in one sweep. With pins, an archive that is no longer
    the one in which the place was found is an error."""

    @F.pandas_udf("binary")
    def read(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        files: dict[str, tuple[Ranges, dict]] = {}
        with ExitStack() as opened:
            for names, offsets, lengths in parts:
                out = []
                for name, at, n in zip(names, offsets, lengths):
                    if name is None or pd.isna(at) or pd.isna(n):
                        out.append(None)
                        continue
                    if name not in files:
                        file = opened.enter_context(Ranges(f"{folder.rstrip('/')}/{name}{ENDING}", (pinned or {}).get(name)))
                        files[name] = (file, fmt.header(file.read(0, fmt.FIRST_READ)))
                    file, head = files[name]
                    out.append(fmt.unpacked(file.read(head["data_offset"] + int(at), int(n)), head["tile_compression"]))
                yield pd.Series(out, dtype=object)

    return read(archive, offset, length)


def legacy_directories(entries: DataFrame) -> DataFrame:
    """directory and data (binary) of the old format from rows directory, z, x, y, is_dir, offset, length: one record each, in the old order.

    A directory is one blob, which readers hold whole, and so one row."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):  # one directory at a time becomes Python values, however many a batch has
                own = batch["_e"][k].values
                data = fmt.packed_legacy_directory(list(zip(*(own.field(c).to_pylist() for c in ENTRY))))
                yield pa.RecordBatch.from_arrays([batch["directory"].slice(k, 1), pa.array([data], pa.binary())], ["directory", "data"])

    rows = entries.groupBy("directory").agg(F.collect_list(F.struct(*ENTRY)).alias("_e"))
    return rows.mapInArrow(packed, f"directory {rows.schema['directory'].dataType.simpleString()}, data binary")


def legacy_entries(directories: DataFrame) -> DataFrame:
    """Rows directory, place (from 0), z, x, y, is_dir, offset, length of directories (directory, data) of the old format."""
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                found = fmt.legacy_directory(batch["data"][k].as_py())
                own = batch["directory"].take(pa.array([k] * len(found), pa.int64()))
                columns = [pa.array(c, kind) for c, kind in zip(zip(*found), kinds)] or [pa.array([], kind) for kind in kinds]
                yield pa.RecordBatch.from_arrays([own, pa.array(range(len(found)), pa.int32()), *columns], ["directory", "place", *ENTRY])

    kind = directories.schema["directory"].dataType.simpleString()
    return directories.select("directory", "data").mapInArrow(read, f"directory {kind}, place int, z int, x bigint, y bigint, is_dir boolean, offset bigint, length bigint")


def archive_name(path: str) -> str:
    return path.rsplit("/", 1)[-1].removesuffix(ENDING)


class _Reader(DataSourceReader):
    def __init__(self, what: str, path: str, pinned: dict[str, str] | None = None) -> None:
        self.what, self.path, self.pinned = what, path, pinned or {}
        self.low, self.high = 0, 1 << 62

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in listed(self.path, ENDING):
            known = snapshot(path)
            if self.pinned.get(archive_name(path), known) != known:
                raise Changed(path)
            out.append(Part(path, None, known))
            if self.what in ("tiles", "entries"):
                with Ranges(path, known) as file:
                    head, columns = _root(file)
                    root = list(zip(*(c.tolist() for c in columns)))
                    # a leaf holds ids from its own first up to the next entry's
                    ends = [e[0] for e in root[1:]] + [1 << 62]
                    leaves = [(offset, length) for (first, run, offset, length), end in zip(root, ends) if run == 0 and first <= self.high and end > self.low]
                    each = -(-len(leaves) // PARTS) or 1
                    out += [Part(path, leaves[k : k + each], known) for k in range(0, len(leaves), each)]
        return out or [Part("", None, "")]

    def read(self, part: Part) -> Iterator[tuple]:
        if self.what in ("tiles", "entries"):
            for batch in self.batches(part):
                yield from zip(*(c.to_pylist() for c in batch.columns))
        elif part.path:
            with Ranges(part.path, part.snapshot) as file:
                if self.what == "headers":
                    yield _header_row(archive_name(part.path), file)
                else:
                    yield from _legacy_rows(archive_name(part.path), file)

    def batches(self, part: Part) -> Iterator[pa.RecordBatch]:
        """Tiles or entries of a part; a directory of entries is a batch, tiles are in batches of up to ROWS rows and about READ_AHEAD bytes."""
        if not part.path:
            return
        name = archive_name(part.path)
        with Ranges(part.path, part.snapshot) as file:
            for head, directory, entries in _tree(file, part, pointers=self.what == "entries"):
                n = len(entries[0])
                if self.what == "entries" and n:
                    yield pa.RecordBatch.from_arrays([pa.repeat(name, n), pa.repeat(pa.scalar(directory, pa.int64()), n), *map(pa.array, entries)], ["archive", "directory", "tile_id", "run_length", "offset", "length"])
                elif n:
                    for ids, tiles in _tiles(file, head, entries):
                        yield pa.RecordBatch.from_arrays([pa.repeat(name, len(ids)), pa.array(ids, pa.int64()), pa.array(tiles, pa.binary())], ["archive", "tile_id", "data"])


class _Batches(_Reader):
    """The reader as Spark takes it: whole batches where there are many rows."""

    def read(self, part: Part) -> Iterator[tuple] | Iterator[pa.RecordBatch]:
        yield from self.batches(part) if self.what in ("tiles", "entries") else super().read(part)


class _Narrowed(_Batches):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Narrows the ids sought, so that leaves without any of them are no parts (which needs spark.sql.python.filterPushdown.enabled).

        All filters stay with Spark too, since a leaf also holds its neighbours."""
        for f in filters:
            values = f.value if isinstance(f, In) else (getattr(f, "value", None),)
            if getattr(f, "attribute", None) == ("tile_id",) and None not in values:
                if isinstance(f, EqualTo):
                    self.low, self.high = max(self.low, f.value), min(self.high, f.value)
                elif isinstance(f, In) and f.value:
                    self.low, self.high = max(self.low, min(f.value)), min(self.high, max(f.value))
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value)
            yield f


def _head(file: Ranges) -> tuple[dict, bytes]:
    first = file.read(0, fmt.FIRST_READ)
    head = fmt.header(first)
    if head["version"] != 3:
        raise ValueError("archives of version 1 and 2 are read with what = legacy")
    return head, first


def _root(file: Ranges) -> tuple[dict, tuple]:
    """The header, and the root's tile_id, run_length, offset and length."""
    head, first = _head(file)
    at, n = head["root_offset"], head["root_length"]
    data = first[at : at + n] if at + n <= len(first) else file.read(at, n)
    return head, fmt.directory_columns(fmt.unpacked(data, head["internal_compression"]))


def _tree(file: Ranges, part: Part, pointers: bool) -> Iterator[tuple[dict, int | None, tuple]]:
    """The header with the part's own directory and, for a leaf, those below it; the root's leaves are parts of their own."""
    kept = lambda entries: entries if pointers else tuple(c[entries[1] > 0] for c in entries)
    if part.leaves is None:
        head, root = _root(file)
        yield head, None, kept(root)
        return
    head, _ = _head(file)
    todo = [(offset, length, 1) for offset, length in reversed(part.leaves)]
    while todo:
        offset, length, depth = todo.pop()
        if depth >= DEPTH:
            raise ValueError("tile directories are nested too deeply")
        entries = fmt.directory_columns(fmt.unpacked(file.read(head["leaf_offset"] + offset, length), head["internal_compression"]))
        yield head, offset, kept(entries)
        below = entries[1] == 0
        todo += [(at, n, depth + 1) for at, n in zip(entries[2][below].tolist(), entries[3][below].tolist())]


def _tiles(file: Ranges, head: dict, columns: tuple) -> Iterator[tuple[list[int], list[bytes]]]:
    """Ids and tiles of a directory, some at a time. Neighbouring places are read together, up to READ_AHEAD bytes; if all places are so close, all at once."""
    entries, k = list(zip(*(c.tolist() for c in columns))), 0
    low, high = int(columns[2].min()), int((columns[2] + columns[3]).max())
    ids, tiles, held = [], [], 0
    while k < len(entries):
        start, end, j = entries[k][2], entries[k][2] + entries[k][3], k + 1
        if high - low <= READ_AHEAD:
            start, end, j = low, high, len(entries)
        while j < len(entries) and start <= entries[j][2] <= end and entries[j][2] + entries[j][3] - start <= READ_AHEAD:
            end = max(end, entries[j][2] + entries[j][3])
            j += 1
        data = file.read(head["data_offset"] + start, end - start)
        for tile_id, run, offset, length in entries[k:j]:
            tile, last = fmt.unpacked(data[offset - start : offset - start + length], head["tile_compression"]), tile_id + run
            while tile_id < last:
                n = min(last - tile_id, ROWS - len(ids), max(1, (READ_AHEAD - held) // max(1, len(tile))))
                ids.extend(range(tile_id, tile_id + n))
                tiles.extend([tile] * n)
                tile_id, held = tile_id + n, held + n * len(tile)
                if len(ids) >= ROWS or held >= READ_AHEAD:
                    yield ids, tiles
                    ids, tiles, held = [], [], 0
        k = j
    if ids:
        yield ids, tiles


def _header_row(name: str, file: Ranges) -> tuple:
    first = file.read(0, fmt.FIRST_READ)
    if fmt.version(first) < 3:
        head = fmt.header(file.read(0, fmt.LEGACY_READ))
    else:
        head = fmt.header(first)
        about = file.read(head["metadata_offset"], head["metadata_length"])
        head["metadata"] = fmt.unpacked(about, head["internal_compression"]).decode("utf-8") if about else None
    return (name, *[head.get(f) for f in fmt.HEADER.names[1:]])


def _legacy_rows(name: str, file: Ranges) -> Iterator[tuple]:
    first = file.read(0, fmt.LEGACY_READ)
    head = fmt.header(first)
    if head["version"] == 3:
        return
    at, n = head["root_offset"], head["root_length"]
    root = fmt.legacy_directory(first[at : at + n])
    yield from ((name, None, *e) for e in root)
    for offset, length in sorted({(e[4], e[5]) for e in root if e[3]}):
        yield from ((name, offset, *e) for e in fmt.legacy_directory(file.read(offset, length)))


@dataclass
class Written(WriterCommitMessage):
    unfinished: str | None
    finished: str | None


class _Writer(DataSourceWriter):
    """Options: metadata (JSON), tile_type and tile_compression (numbers), min_lon .. max_lat, center_lon, center_lat, center_zoom."""

    def __init__(self, folder: str, options: dict, columns: list[str], overwrite: bool = False) -> None:
        self.folder, self.options, self.columns, self.run, self.overwrite = folder.rstrip("/"), options, columns, uuid.uuid4().hex[:12], overwrite

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        fs, folder = store(self.folder)
        i_id, i_data = self.columns.index("tile_id"), self.columns.index("data")
        own = f"{folder}/_{uuid.uuid4().hex}"
        blobs = None
        entries: list[list[int]] = []
        places: dict[bytes, tuple[int, int]] = {}
        size = tiles = contents = 0
        compress = int(self.options.get("tile_compression", fmt.GZIP)) == fmt.GZIP
        for row in rows:
            tile_id, data = row[i_id], bytes(row[i_data])
            if entries and tile_id < entries[-1][0] + entries[-1][1]:
                raise ValueError(f"tile ids must ascend within a partition: {tile_id}")
            if blobs is None:
                fs.create_dir(folder, recursive=True)
                blobs = fs.open_output_stream(own + ".data")
            key = data if len(data) <= 1024 else None  # small blobs repeat (sea, empty land); large ones don't
            place = places.get(key) if key is not None else None
            if place is None:
                stored = gzip.compress(data, mtime=0) if compress else data
                place = (size, len(stored))
                blobs.write(stored)
                size, contents = size + len(stored), contents + 1
                if key is not None and len(places) < 100_000:
                    places[key] = place
            if entries and entries[-1][0] + entries[-1][1] == tile_id and (entries[-1][2], entries[-1][3]) == place:
                entries[-1][1] += 1
            else:
                entries.append([tile_id, 1, *place])
            tiles += 1
        if blobs is None:
            return Written(None, None)
        blobs.close()
        self._assemble(fs, own, [tuple(e) for e in entries], size, tiles, contents)
        return Written(own, f"{folder}/part-{TaskContext.get().partitionId():05d}-{self.run}{ENDING}")

    def _assemble(self, fs, own: str, entries: list[tuple], size: int, tiles: int, contents: int) -> None:
        root, leaves = _directories(entries)
        about = gzip.compress(json.dumps(json.loads(self.options.get("metadata", "{}"))).encode(), mtime=0)
        o = lambda key, default: float(self.options.get(key, default))
        head = {"root_offset": fmt.LAYOUT.size, "root_length": len(root), "metadata_length": len(about), "leaf_length": len(leaves), "data_length": size, "addressed_tiles": tiles, "tile_entries": len(entries), "tile_contents": contents}
        head["metadata_offset"] = head["root_offset"] + len(root)
        head["leaf_offset"] = head["metadata_offset"] + len(about)
        head["data_offset"] = head["leaf_offset"] + len(leaves)
        head |= {"clustered": 1, "internal_compression": fmt.GZIP, "tile_compression": int(self.options.get("tile_compression", fmt.GZIP)), "tile_type": int(self.options.get("tile_type", 1)), "min_zoom": level(entries[0][0]), "max_zoom": level(entries[-1][0] + entries[-1][1] - 1)}
        head |= {"min_lon": o("min_lon", -180), "min_lat": o("min_lat", -85), "max_lon": o("max_lon", 180), "max_lat": o("max_lat", 85), "center_zoom": int(o("center_zoom", 0)), "center_lon": o("center_lon", 0), "center_lat": o("center_lat", 0)}
        with fs.open_output_stream(own) as out, fs.open_input_stream(own + ".data") as data:
            out.write(fmt.packed_header(head) + root + about + leaves)
            while piece := data.read(1 << 20):
                out.write(piece)
        fs.delete_file(own + ".data")

    def commit(self, messages: list[Written]) -> None:
        fs, _ = store(self.folder)
        for m in messages:
            if m is not None and m.unfinished:
                fs.move(m.unfinished, m.finished)
        before = current(self.folder)
        if self.overwrite or before is not None:  # files of this run count from here on, all at once
            fs.create_dir(store(self.folder)[1], recursive=True)
            own = [m.finished.rsplit("/", 1)[-1] for m in messages if m is not None and m.finished]
            make_current(self.folder, own if self.overwrite else [*before, *own])

    def abort(self, messages: list[Written]) -> None:
        fs, _ = store(self.folder)
        for m in messages:
            if m is not None and m.unfinished:
                fs.delete_file(m.unfinished)


def level(tile_id: int) -> int:
    return ((3 * tile_id + 1).bit_length() - 1) // 2


def _directories(entries: list[tuple]) -> tuple[bytes, bytes]:
    """The root and the leaves; all entries in the root if it fits into the first read, else leaves of equal size, larger where the root would not fit."""
    pack = lambda e: gzip.compress(fmt.packed_directory(e), mtime=0)
    root = pack(entries)
    if len(root) <= ROOT_ROOM:
        return root, b""
    per_leaf = LEAF_ENTRIES
    while True:
        leaves, pointers = bytearray(), []
        for k in range(0, len(entries), per_leaf):
            leaf = pack(entries[k : k + per_leaf])
            pointers.append((entries[k][0], 0, len(leaves), len(leaf)))
            leaves += leaf
        root = pack(pointers)
        if len(root) <= ROOT_ROOM:
            return root, bytes(leaves)
        per_leaf *= 2
