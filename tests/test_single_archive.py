import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagatlas.sources import archive_format as fmt
from tagatlas.sources import single_archive, tile_archive
from tagatlas.sources.files import Changed, current, make_current, remove_unlisted, snapshot, steady
from tagatlas.sources.single_archive import write_one
from tagatlas.sources.tile_archive import TileArchive, _Reader, blob, pins


def read(spark, path, what="tiles", **options):
    spark.dataSource.register(TileArchive)
    return spark.read.format("tile_archive").option("what", what).options(**options).load(path)


def made(spark, n=12_000, data="concat('tile ', tile_id % 700)"):
    """Tiles of level 14 in no order; a third of them are alike."""
    return spark.range(n).selectExpr("89478485 + id * 3 + id % 2 AS tile_id").selectExpr("tile_id", f"CAST(CASE WHEN tile_id % 3 = 0 THEN 'sea' ELSE {data} END AS BINARY) AS data").orderBy(F.rand(3))


def pairs(df):
    return sorted((r.tile_id, bytes(r.data)) for r in df.collect())


@pytest.mark.parametrize(("shared", "local"), [(100_000, True), (50, True), (100_000, False)])
def test_one_file_from_many_tasks(spark, tmp_path, monkeypatch, shared, local):
    monkeypatch.setattr(single_archive, "SHARED", shared)
    if not local:  # as in stores that take no writes in place
        monkeypatch.setattr(single_archive, "_in_place", lambda fs: False)
    tiles, path = made(spark), str(tmp_path / "out" / "map.pmtiles")
    write_one(tiles, path, parts=9, metadata='{"name": "map"}', min_lon=-140)
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["map.pmtiles"]  # one file, and nothing left beside it
    assert pairs(read(spark, path)) == pairs(tiles)
    head = read(spark, path, "headers").first()
    want = {r.tile_id: bytes(r.data) for r in tiles.collect()}
    assert (head.addressed_tiles, head.tile_contents, head.min_zoom, head.max_zoom, head.min_lon) == (len(want), len(set(want.values())), 14, 14, -140)
    assert json.loads(head.metadata) == {"name": "map"} and (tmp_path / "out" / "map.pmtiles").stat().st_size == head.leaf_offset + head.leaf_length + head.data_length
    entries = read(spark, path, "entries").collect()
    assert len({r.directory for r in entries if r.run_length == 0 or r.directory is not None} - {None}) >= 8  # leaf directories
    assert head.tile_entries == sum(r.run_length > 0 for r in entries) and head.root_length <= fmt.FIRST_READ
    # contents lie in the order of the first tile that has them, whichever task wrote them
    first = {}
    for r in sorted((r for r in entries if r.run_length > 0), key=lambda r: r.tile_id):
        first.setdefault(r.offset, (r.tile_id, r.length))
    at = 0
    for offset in sorted(first, key=lambda o: first[o][0]):
        assert offset == at
        at += first[offset][1]
    assert at == head.data_length
    write_one(tiles.where("tile_id % 2 = 0"), path)  # replaces it
    assert pairs(read(spark, path)) == pairs(tiles.where("tile_id % 2 = 0"))


def test_many_entries_are_packed_once_and_read_by_batches(spark, tmp_path, monkeypatch):
    """Leaves are as large as the root asks for from the start; runs are a table, not made twice; tasks give Spark whole batches of a few leaves."""
    monkeypatch.setattr(single_archive, "LEAF_ENTRIES", 16)
    monkeypatch.setattr(tile_archive, "PARTS", 7)
    made_tables, table = [], single_archive._table
    monkeypatch.setattr(single_archive, "_table", lambda df, what: made_tables.append(what) or table(df, what))
    tiles, path = made(spark, 100_000), str(tmp_path / "a.pmtiles")
    write_one(tiles, path, parts=4, tile_compression=1)
    assert made_tables == ["tiles", "blobs", "runs", "leaves"]
    entries = read(spark, path, "entries").collect()
    leaves = {r.offset for r in entries if r.directory is None}
    assert 700 < len(leaves) <= single_archive.POINTERS + 4 and {r.directory for r in entries} == leaves | {None}
    reader = TileArchive({"path": path, "what": "tiles"}).reader(None)
    parts = reader.partitions()
    assert len(parts) <= 8 and sum(len(p.leaves or []) for p in parts) == len(leaves)
    batches = [b for p in parts for b in reader.read(p)]
    assert all(isinstance(b, pa.RecordBatch) and b.num_rows <= tile_archive.ROWS for b in batches) and sum(b.num_rows for b in batches) == 100_000
    assert pairs(read(spark, path)) == pairs(tiles)


def test_a_run_of_large_tiles_comes_in_bounded_batches(spark, tmp_path):
    rows = spark.range(30).selectExpr("id + 5 AS tile_id", "CAST(repeat('x', 1000000) AS BINARY) AS data")
    write_one(rows, path := str(tmp_path / "a.pmtiles"))
    batches = [b for p in _Reader("tiles", path).partitions() for b in _Reader("tiles", path).batches(p)]
    assert max(b.nbytes for b in batches) <= tile_archive.READ_AHEAD + 1_100_000
    assert pairs(read(spark, path)) == [(k, b"x" * 1_000_000) for k in range(5, 35)]


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_directories_by_columns(n):
    """The same bytes as number by number."""
    rnd = random.Random(n)
    at, entries = 0, []
    for _ in range(n):
        at += rnd.choice([1, 3, 200, 2**40 // (n + 1)])
        run, length = rnd.choice([0, 1, 1, 130]), rnd.choice([1, 127, 128, 2**31])
        offset = entries[-1][2] + entries[-1][3] if entries and rnd.random() < 0.6 else rnd.choice([0, 126, 127, 2**45])
        entries.append((at, run, offset, length))
        at += run
    follows = [i > 0 and e[2] == entries[i - 1][2] + entries[i - 1][3] for i, e in enumerate(entries)]
    ids = [e[0] for e in entries]
    columns = [[n], [b - a for a, b in zip([0, *ids], ids)], [e[1] for e in entries], [e[3] for e in entries], [0 if f else e[2] + 1 for f, e in zip(follows, entries)]]
    data = b"".join(fmt.varint(v) for c in columns for v in c)
    assert fmt.packed_directory(entries) == data and fmt.directory(data) == entries and fmt._numbers(data).tolist() == fmt.varints(data)
    if n:
        for wrong in (data[:-1], data + b"\x80", b"\x80" * 11 + data):
            with pytest.raises(ValueError):
                fmt.directory(wrong)
        with pytest.raises(ValueError):
            fmt.packed_directory([(5, 1, 0, 1), (4, 1, 0, 1)])


def test_small_empty_and_wrong(spark, tmp_path):
    path = str(tmp_path / "a.pmtiles")
    rows = spark.createDataFrame([(5, b"x"), (6, b"x"), (7, b""), (0, b"y"), (None, b"z"), (9, None)], "tile_id long, data binary")
    write_one(rows, path, tile_compression=1)
    assert pairs(read(spark, path)) == [(0, b"y"), (5, b"x"), (6, b"x"), (7, b"")]
    got = read(spark, path, "entries").orderBy("tile_id").select("tile_id", "run_length", "offset", "length").collect()
    assert [tuple(r) for r in got] == [(0, 1, 0, 1), (5, 2, 1, 1), (7, 1, 2, 0)]
    write_one(rows.limit(0), path)
    assert read(spark, path).count() == 0 and read(spark, path, "headers").first().addressed_tiles == 0
    with pytest.raises(ValueError, match="more than once"):
        write_one(spark.createDataFrame([(5, b"x"), (5, b"y")], "tile_id long, data binary"), str(tmp_path / "b.pmtiles"))


def test_a_replaced_file_is_all_new_or_an_error(spark, tmp_path):
    path = str(tmp_path / "a.pmtiles")
    old, new = made(spark), made(spark, data="concat('new ', tile_id % 500)")
    write_one(old, path)
    reader = _Reader("tiles", path)
    parts = reader.partitions()
    assert len(parts) > 2 and sorted((i, bytes(d)) for p in parts for _, i, d in reader.read(p)) == pairs(old)
    df = read(spark, path)
    df._jdf.queryExecution().toRdd().getNumPartitions()  # planned: what each task reads is settled
    half = list(reader.read(parts[0])) + list(reader.read(parts[1]))
    write_one(new, path)
    assert half
    with pytest.raises(Changed):
        list(reader.read(parts[2]))
    with pytest.raises(Exception, match="changed since its read was planned"):
        df.collect()
    calls = []

    def make():
        calls.append(1)
        return pairs(df if len(calls) == 1 else read(spark, path))

    assert steady(make) == pairs(new) and len(calls) == 2
    with pytest.raises(Exception, match="changed since"):
        steady(lambda: df.collect())
    with pytest.raises(ZeroDivisionError):
        steady(lambda: 1 / 0)


def test_a_file_replaced_while_a_task_reads_it(spark, tmp_path):
    path = str(tmp_path / "a.pmtiles")
    write_one(made(spark), path)
    reader = _Reader("tiles", path)
    rows = reader.read(reader.partitions()[1])
    next(rows)
    write_one(made(spark, 20), path)
    with pytest.raises(Changed):  # before the task ends, so none of its rows count
        list(rows)


def test_lookups_are_held_to_their_snapshot(spark, tmp_path):
    path = str(tmp_path / "a.pmtiles")
    write_one(made(spark, 300), path)
    pinned = pins(str(tmp_path))
    entries = read(spark, str(tmp_path), "entries", pins=json.dumps(pinned)).where("run_length > 0")
    ask = lambda: entries.select("tile_id", blob(str(tmp_path), F.col("archive"), F.col("offset"), F.col("length"), pinned).alias("data"))
    assert len(ask().collect()) == entries.count() and pinned == {"a": snapshot(path)}
    found = entries.collect()
    places = spark.createDataFrame(found, entries.schema)
    write_one(made(spark, 200), path)
    with pytest.raises(Exception, match="changed since"):
        places.select(blob(str(tmp_path), F.col("archive"), F.col("offset"), F.col("length"), pinned)).collect()
    with pytest.raises(Exception, match="changed since"):
        read(spark, str(tmp_path), "entries", pins=json.dumps(pinned)).collect()


def test_a_folder_is_replaced_in_one_step(spark, tmp_path):
    spark.dataSource.register(TileArchive)
    folder = str(tmp_path / "f")
    write = lambda df, mode, n: df.repartitionByRange(n, "tile_id").sortWithinPartitions("tile_id").write.format("tile_archive").mode(mode).save(folder)
    old, new = made(spark, 900), made(spark, 600, "concat('new ', tile_id % 50)")
    write(old, "append", 3)
    assert current(folder) is None
    before = read(spark, folder)
    before._jdf.queryExecution().toRdd().getNumPartitions()
    write(new, "overwrite", 2)
    assert len(current(folder)) == 2 and pairs(read(spark, folder)) == pairs(new)
    assert pairs(before) == pairs(old)  # a read that was planned before is all old
    more = spark.createDataFrame([(1, b"m")], "tile_id long, data binary")
    write(more, "append", 1)
    assert pairs(read(spark, folder)) == sorted(pairs(new) + [(1, b"m")])
    names = current(folder)
    make_current(folder, names[:1])
    assert read(spark, folder, "headers").count() == 1 and remove_unlisted(folder, ".pmtiles") == 5
    assert remove_unlisted(str(tmp_path), ".pmtiles") == 0
