"""Archives and extracts: round trips through files, all versions, and damaged input."""

import gzip
import json
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagatlas.functions.tiles import tile_id
from tagatlas.operators import directory
from tagatlas.plans import map_build
from tagatlas.sources import archive_format as fmt
from tagatlas.sources.files import Ranges, http_range
from tagatlas.sources.osm_pbf import OsmPbf
from tagatlas.sources.tile_archive import TileArchive, _directories, _Narrowed, legacy_directories, legacy_entries
from tagatlas.sources.tile_archive import blob as tile_at


@pytest.fixture()
def served():
    """A server of ranges: content by path, and what it does wrong by the path's first letter."""
    import http.server
    import threading

    files = {}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            data, kind = files[self.path], self.path[1]
            first, last = (int(v) for v in self.headers["Range"][6:].split("-"))
            status, told, body = 206, f"bytes {first}-{min(last, len(data) - 1)}/{len(data)}", data[first : last + 1]
            if kind == "s" and last >= len(data) or first >= len(data):  # strict, or nothing there
                status, told, body = 416, f"bytes */{len(data)}" if kind != "m" else "", b""
            elif kind == "w":  # whole file, whatever was asked
                status, told, body = 200, "", data
            elif kind == "e":
                status, told, body = 503, "", b""
            self.send_response(status)
            if told:
                self.send_header("Content-Range", told)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield files, f"http://127.0.0.1:{server.server_port}"
    server.shutdown()
    server.server_close()


def test_http_ranges(served):
    files, at = served
    data = bytes(range(200))
    files |= {f"/{k}": data for k in ("range", "strict", "whole", "error")} | {"/mute": b""}
    assert http_range(f"{at}/range", 10, 5) == (data[10:15], 200)
    assert http_range(f"{at}/strict", 0, 500)[0] == data  # refused, then asked for what is there
    assert http_range(f"{at}/whole", 0, 300) == (data, 200)
    for path, offset, length in (("strict", 100, 500), ("whole", 0, 100), ("error", 0, 5), ("mute", 0, 5)):
        with pytest.raises(OSError):
            http_range(f"{at}/{path}", offset, length)
    with Ranges(f"{at}/range") as file:
        assert (file.size, file.read(190, 50), file.read(0, 3), file.read(200, 4)) == (200, data[190:], data[:3], b"")
        with pytest.raises(ValueError):
            file.read(201, 1)


def test_archive_over_http(spark_sources, served, tmp_path):
    files, at = served
    rows = spark_sources.range(50).select((F.col("id") + 100).alias("tile_id"), F.concat(F.lit("t"), F.col("id")).cast("binary").alias("data"))
    map_build.write_archive(rows, str(tmp_path / "out"), 1)
    (one,) = [f for f in (tmp_path / "out").iterdir() if not f.name.startswith("_")]
    files[f"/range/{one.name}"] = one.read_bytes()
    read = lambda where: sorted(map(tuple, spark_sources.read.format("tile_archive").option("what", "entries").load(where).collect()))
    assert len(read(str(one))) == 50 and read(f"{at}/range/{one.name}") == read(str(one))


@pytest.fixture(scope="module")
def spark_sources(spark):
    spark.dataSource.register(TileArchive)
    spark.dataSource.register(OsmPbf)
    return spark


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 10**9), st.integers(0, 1000), st.integers(0, 2**40), st.integers(1, 2**31)), max_size=60))
def test_directory_round_trip(steps):
    at, entries = 0, []
    for step, run, offset, length in steps:
        at += step
        entries.append((at, run, offset, length))
    assert fmt.directory(fmt.packed_directory(entries)) == entries


def test_contiguous_places_and_first_zero():
    entries = [(5, 1, 0, 10), (6, 2, 10, 5), (9, 1, 0, 10)]
    data = fmt.packed_directory(entries)
    assert fmt.varints(data)[-3:] == [1, 0, 1] and fmt.directory(data) == entries
    assert fmt.directory(b"\x01\x05\x01\x0a\x00") == [(5, 1, -1, 10)]


def test_numbers_and_compression():
    assert fmt.varints(fmt.varint(2**63 - 1)) == [2**63 - 1]
    for bad in (b"\x80", b"\xff" * 11):
        with pytest.raises(ValueError):
            fmt.varints(bad)
    raw = zlib.compressobj(wbits=-15)
    deflated = raw.compress(b"abc" * 50) + raw.flush()
    assert {fmt.unpacked(d) for d in (gzip.compress(b"abc" * 50), zlib.compress(b"abc" * 50), deflated)} == {b"abc" * 50}
    assert fmt.unpacked(b"x", 1) == fmt.unpacked(b"x", 0) == b"x"
    with pytest.raises(ValueError):
        fmt.unpacked(b"x", 3)


def test_legacy_records_take_all_48_bits():
    entries = [(3, 2, 1, True, 2**47 + 5, 7), (14, 16383, 1, False, 2**40 + 1, 2**31), (0, 0, 0, False, 0, 1)]
    assert fmt.legacy_directory(fmt.packed_legacy_directory(entries)) == [entries[2], entries[1], entries[0]]


@pytest.mark.parametrize("data", [b"", b"PMTiles\x04" + b"\0" * 200, b"no archive at all"])
def test_not_an_archive(data):
    with pytest.raises((ValueError, struct.error)):
        fmt.header(data)


def test_large_directories_get_leaves():
    import random

    rng, entries, at = random.Random(1), [], 0
    for i in range(30_000):
        at += rng.randint(1, 1000)
        entries.append((at, 1, rng.randint(0, 2**40), rng.randint(1, 10**6)))
    root, leaves = _directories(entries)
    assert len(root) <= 16_384 - 127
    pointers = fmt.directory(gzip.decompress(root))
    assert all(p[1] == 0 for p in pointers)
    assert [e for p in pointers for e in fmt.directory(gzip.decompress(leaves[p[2] : p[2] + p[3]]))] == entries


def tiles_of(spark, n: int):
    rows = spark.range(n).selectExpr("id * 3 + (id div 50) AS tile_id", "encode(concat('tile ', CASE WHEN id % 3 = 0 THEN 'sea' ELSE CAST(hash(id) AS STRING) END), 'utf-8') AS data")
    return rows.unionByName(rows.where("tile_id % 9 = 0").selectExpr("tile_id + 1 AS tile_id", "data"))


def test_archives_round_trip(spark_sources, tmp_path):
    spark, folder = spark_sources, str(tmp_path / "out")
    tiles = tiles_of(spark, 20_000)
    map_build.write_archive(tiles.dropDuplicates(["tile_id"]), folder, parts=3, metadata=json.dumps({"name": "n"}), tile_type=1, min_lon=-140)
    back = spark.read.format("tile_archive").load(folder)
    want = {r["tile_id"]: bytes(r["data"]) for r in tiles.collect()}
    assert {r["tile_id"]: bytes(r["data"]) for r in back.collect()} == want and back.count() == len(want)
    heads = spark.read.format("tile_archive").option("what", "headers").load(folder).collect()
    assert len(heads) == 3 and sum(h["addressed_tiles"] for h in heads) == len(want) and {h["min_lon"] for h in heads} == {-140.0} and json.loads(heads[0]["metadata"]) == {"name": "n"}
    assert any(h["tile_entries"] < h["addressed_tiles"] for h in heads) and all(h["tile_contents"] < h["tile_entries"] for h in heads)
    entries = directory.flattened(spark.read.format("tile_archive").option("what", "entries").load(folder))
    asked = spark.range(0, 61_000).selectExpr("id AS tile_id").crossJoin(entries.select("archive").distinct())
    assert directory.range_lookup(asked, entries).where("entry_id is not null").count() == len(want)
    hits = directory.range_lookup(asked, entries).where("tile_id % 100 < 7")
    got = hits.withColumn("data", tile_at(folder, F.col("archive"), F.col("offset"), F.col("length"))).where("data is not null").collect()
    assert {r["tile_id"]: bytes(r["data"]) for r in got} == {k: v for k, v in want.items() if k % 100 < 7}
    with pytest.raises(Exception, match="ascend"):
        tiles_of(spark, 10).orderBy(F.desc("tile_id")).coalesce(1).write.format("tile_archive").mode("append").save(str(tmp_path / "bad"))


def test_empty_archive_folder_and_no_rows(spark_sources, tmp_path):
    (tmp_path / "none").mkdir()
    assert spark_sources.read.format("tile_archive").load(str(tmp_path / "none")).count() == 0
    map_build.write_archive(tiles_of(spark_sources, 0), str(tmp_path / "zero"))
    assert not list((tmp_path).glob("zero/*.pmtiles"))


def test_legacy_archive(spark_sources, tmp_path):
    leaf = fmt.packed_legacy_directory([(8, 3, 4, False, 900, 10), (8, 2, 5, False, 910, 11)])
    about = json.dumps({"bounds": "-10,-20,30,40", "center": "1,2,3", "minzoom": "0", "maxzoom": "8", "format": "png"}).encode()
    root = [(0, 0, 0, False, 700, 5), (7, 1, 2, True, 0, len(leaf))]
    at = 10 + len(about) + 2 * 17
    root[1] = (7, 1, 2, True, at, len(leaf))
    data = b"PM" + struct.pack("<HIH", 2, len(about), len(root)) + about + fmt.packed_legacy_directory(root) + leaf
    (tmp_path / "old.pmtiles").write_bytes(data)
    spark, path = spark_sources, str(tmp_path / "old.pmtiles")
    head = spark.read.format("tile_archive").option("what", "headers").load(path).first()
    assert (head["version"], head["min_lon"], head["max_lat"], head["center_zoom"], head["max_zoom"], head["tile_type"]) == (2, -10.0, 40.0, 3, 8, 2)
    rows = spark.read.format("tile_archive").option("what", "legacy").load(path)
    asked = spark.createDataFrame([("old", 0, 0, 0), ("old", 8, 3, 4), ("old", 8, 2, 5), ("old", 8, 9, 9), ("old", 3, 1, 1)], "archive string, z int, x bigint, y bigint")
    got = directory.legacy_lookup(asked, rows.where("directory is null"), rows.where("directory is not null"))
    assert {(r["z"], r["x"], r["y"]): (r["offset"], r["length"]) for r in got.collect()} == {(0, 0, 0): (700, 5), (8, 3, 4): (900, 10), (8, 2, 5): (910, 11), (8, 9, 9): (None, None), (3, 1, 1): (None, None)}


# --- extracts


def varint(n):
    return fmt.varint(n & (2**64 - 1))


def field(number, value):
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def zigzag(n):
    return (n << 1) ^ (n >> 63)


def packed(values):
    return b"".join(varint(v) for v in values)


def steps(values):
    return packed(zigzag(b - a) for a, b in zip([0, *values], values))


def blob(kind, data, compress=True):
    body = field(2, len(data)) + field(3, zlib.compress(data)) if compress else field(1, data)
    head = field(1, kind) + field(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def extract(words, group):
    return field(1, b"".join(field(1, w.encode()) for w in words)) + field(2, group)


def write_extract(path):
    words = ["", "amenity", "bicycle_parking", "highway", "cycleway", "type", "route", "bicycle", "forward", "name", "Grün"]
    dense = field(1, steps([5, 7, -3])) + field(8, steps([490000000, 490010000, 480000000])) + field(9, steps([-1231000000, -1231010000, -1220000000])) + field(10, packed([1, 2, 9, 10, 0, 0, 0]))
    way = field(1, 70) + field(2, packed([3, 9])) + field(3, packed([4, 10])) + field(8, steps([5, 7]))
    relation = field(1, 90) + field(2, packed([5, 6])) + field(3, packed([6, 7])) + field(8, packed([8, 0])) + field(9, steps([70, 5])) + field(10, packed([1, 0]))
    node = field(1, zigzag(11)) + field(2, packed([1])) + field(3, packed([2])) + field(8, zigzag(100)) + field(9, zigzag(-200))
    path.write_bytes(blob(b"OSMHeader", b"") + blob(b"OSMData", extract(words, field(2, dense))) + blob(b"OSMData", extract(words, field(3, way) + field(4, relation)), False) + blob(b"OSMData", extract(words, field(1, node))))


def test_extract(spark_sources, tmp_path):
    write_extract(tmp_path / "a.osm.pbf")
    rows = spark_sources.read.format("osm_pbf").option("blob_bytes", 1).load(str(tmp_path / "a.osm.pbf"))
    assert rows.rdd.getNumPartitions() == 3
    got = {(r["feature_type"], r["osm_id"]): r for r in rows.collect()}
    assert set(got) == {("node", 5), ("node", 7), ("node", -3), ("node", 11), ("way", 70), ("relation", 90)}
    assert got["node", 5]["tags"] == {"amenity": "bicycle_parking", "name": "Grün"} and (round(got["node", 5]["lon"], 6), round(got["node", 5]["lat"], 6)) == (-123.1, 49.0)
    assert got["way", 70]["nodes"] == [5, 7] and got["way", 70]["tags"] == {"highway": "cycleway", "name": "Grün"}
    assert [tuple(m) for m in got["relation", 90]["members"]] == [("way", 70, "forward"), ("node", 5, "")]


def read_tile(data):
    """Layers of a vector tile: name, and for each feature its geometry type, attributes and drawing numbers."""
    from tagatlas.sources.osm_pbf import fields

    out = {}
    for _, layer in fields(data):
        name, keys, values, raw = None, [], [], []
        for n, v in fields(layer):
            if n == 1:
                name = v.decode()
            elif n == 2:
                raw.append(list(fields(v)))
            elif n == 3:
                keys.append(v.decode())
            elif n == 4:
                kind, x = next(iter(fields(v)))
                values.append(x.decode() if kind == 1 else bool(x) if kind == 7 else (x >> 1) ^ -(x & 1))
        feats = []
        for f in raw:
            d = dict(f)
            tags = fmt.varints(d[2])
            feats.append((d[3], {keys[k]: values[v] for k, v in zip(tags[::2], tags[1::2])}, fmt.varints(d[4])))
        out[name] = feats
    return out


def test_map_build_from_extract_to_archive(spark_sources, tmp_path):
    spark = spark_sources
    write_extract(tmp_path / "a.osm.pbf")
    nodes, ways, relations = map_build.split_elements(spark.read.format("osm_pbf").load(str(tmp_path / "a.osm.pbf")))
    mapped = map_build.map_features(nodes, ways, relations)
    assert {(r["kind"], r["osm_id"], r["routes"]) for r in mapped.collect()} == {("line", 70, "90"), ("point", 5, None), ("point", 11, None)}
    built = map_build.tiles(mapped, 14)
    map_build.write_archive(built, str(tmp_path / "out"), parts=2)
    back = spark.read.format("tile_archive").load(str(tmp_path / "out"))
    lon, lat = -123.1, 49.0
    from tagatlas.functions.tiles import tile_xy

    at = spark.range(1).select(F.explode(F.sequence(F.lit(6), F.lit(14))).alias("z")).select("z", tile_xy(F.lit(lon), F.lit(lat), F.col("z")).alias("t"))
    found = at.select("z", tile_id(F.col("z"), F.col("t.x"), F.col("t.y")).alias("tile_id")).join(back, "tile_id", "left").orderBy("z").collect()
    tiles = {r["z"]: read_tile(bytes(r["data"])) if r["data"] is not None else None for r in found}
    # the street is 130 m long, more than the 100 m that level 6 asks for; parking waits for level 12
    assert [f[0] for f in tiles[6]["cycling"]] == [2] and sorted(f[0] for f in tiles[12]["cycling"]) == [1, 2]
    line = next(f for f in tiles[14]["cycling"] if f[0] == 2)
    assert line[1] == {"shared_with_pedestrians": False, "shared_with_vehicles": False, "comfort": 4, "oneway": 0, "class": "track", "subclass": "cycleway", "name": "Grün", "routes": "90"}
    assert "name" not in next(f for f in tiles[12]["cycling"] if f[0] == 2)[1]
    assert next(f for f in tiles[12]["cycling"] if f[0] == 1)[1] == {"amenity": "bicycle_parking", "name": "Grün", "osmNodeId": 5}


def test_run_build(spark_sources, tmp_path):
    from tagatlas.plans.run_build import build

    write_extract(tmp_path / "a.osm.pbf")
    build(spark_sources, str(tmp_path / "a.osm.pbf"), str(tmp_path / "out"), max_zoom=12, name="n", version="2", attribution=None)
    head = spark_sources.read.format("tile_archive").option("what", "headers").load(str(tmp_path / "out")).first()
    assert (head["min_zoom"], head["max_zoom"], json.loads(head["metadata"])) == (6, 12, {"name": "n", "version": "2"})


def test_leaves_out_of_range_are_not_read(spark_sources, tmp_path):
    import random

    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

    rng, ids = random.Random(3), []
    for _ in range(40_000):
        ids.append((ids[-1] if ids else 0) + rng.randint(1, 9))
    spark, folder = spark_sources, str(tmp_path / "out")
    rows = spark.createDataFrame([(i,) for i in ids], "tile_id bigint").selectExpr("tile_id", "encode(repeat(CAST(hash(tile_id) AS STRING), 1 + CAST(abs(hash(tile_id, 1)) % 9 AS INT)), 'utf-8') AS data")
    map_build.write_archive(rows, folder)
    whole = len(_Narrowed("tiles", folder).partitions())
    assert whole > 3
    for pushed, some in (([EqualTo(("tile_id",), ids[20_000])], 2), ([GreaterThanOrEqual(("tile_id",), ids[0]), LessThan(("tile_id",), ids[10])], 2), ([In(("tile_id",), (ids[5], ids[-5]))], whole)):
        reader = _Narrowed("tiles", folder)
        assert list(reader.pushFilters(pushed)) == pushed and len(reader.partitions()) == some
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = spark.read.format("tile_archive").option("pushdown", "true").load(folder).where(F.col("tile_id").between(ids[30_000], ids[30_100]))
        assert sorted(r["tile_id"] for r in got.collect()) == ids[30_000:30_101]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_old_directories_of_a_batch_are_read_one_at_a_time(spark):
    rows = spark.range(3000).selectExpr("id % 300 AS directory", "CAST(14 AS INT) AS z", "id AS x", "id * 3 AS y", "id % 5 = 0 AS is_dir", "281474976000000 + id AS offset", "1 + id AS length").coalesce(1)
    made = legacy_directories(rows)
    back = legacy_entries(made)
    assert back.drop("place").exceptAll(rows).count() == rows.exceptAll(back.drop("place")).count() == 0
    # plain pandas functions turn all directories of a batch into Python values at once
    for df in (made, back):
        assert "ArrowEvalPython" not in df._jdf.queryExecution().executedPlan().toString()
