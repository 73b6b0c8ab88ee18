"""Merging of lines: small shapes by hand, and both steps against merging in one go."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tagatlas.operators import features, merge
from tagatlas.plans import catalog, map_build, views


def shape(lines):
    return sorted((tuple(map(tuple, p)), n) for p, n in lines)


def chain(*lines):
    got = merge.chain([np.array(line, float) for line in lines], [1] * len(lines))
    return sorted((min(tuple(map(tuple, p)), tuple(map(tuple, p[::-1]))), n) for p, n in got)


def test_chains():
    assert chain([(0, 0), (1, 0)], [(2, 0), (1, 0)], [(2, 0), (3, 0)]) == [(((0, 0), (1, 0), (2, 0), (3, 0)), 3)]
    # three ends meet: nothing is joined there
    assert len(chain([(0, 0), (1, 0)], [(1, 0), (2, 0)], [(1, 0), (1, 1)])) == 3
    # a ring of two halves, and a line closed in itself
    assert [n for _, n in chain([(0, 0), (1, 1)], [(1, 1), (0, 0)])] == [2]
    assert len(chain([(0, 0), (1, 1), (0, 0)], [(0, 0), (5, 5)])) == 2
    # a point stands for an end elsewhere
    assert len(merge.chain([np.array([(0.0, 0), (1, 0)]), np.array([(1.0, 0), (2, 0)]), np.array([(1.0, 0)])], [1, 1, 0])) == 2


def test_simplify_and_clip():
    line = np.array([(0, 0), (1, 0.01), (2, 0), (3, 2), (4, 0)], float)
    assert merge.simplify(line, 0.1).tolist() == [[0, 0], [2, 0], [3, 2], [4, 0]]
    assert len(merge.simplify(line, 0.0)) == 5
    pieces = list(merge.clip(np.array([(-10, 5), (5, 5), (5, 30), (8, 30), (8, 5)], float), 0, 20))
    assert [p.tolist() for p in pieces] == [[[0, 5], [5, 5], [5, 20]], [[8, 20], [8, 5]]]
    assert list(merge.clip(np.array([(-5, -5), (-1, -1)], float), 0, 20)) == []


def test_two_steps_give_what_one_gives(spark):
    rows = features.in_tiles(features.lines(views.placed_ways(spark, "/root/testdata/sf0.001")).where("osm_id < 400"), 9)
    look = ["comfort", "oneway", "class"]
    got = {}
    for cell in (32, 10**9):
        out = merge.merge_lines(rows, look, cell_px=cell).select("z", "x", "y", *look, "n_lines", F.transform("geom", lambda p: F.concat_ws(" ", F.round(p.x, 3).cast("string"), F.round(p.y, 3).cast("string"))).alias("g"))
        got[cell] = sorted((*r[:7], min(tuple(r["g"]), tuple(reversed(r["g"])))) for r in out.collect())
    assert got[32] == got[10**9] and got[32]
    assert max(r[6] for r in got[32]) > 1
    # oneway streets never merge, and every line shown at level 9 is counted once in each tile
    assert all(r[6] == 1 for r in got[32] if r[4] == 1)


def test_cells_change_nothing_on_a_random_net(spark):
    rnd = np.random.default_rng(3)
    rows = []
    for k in range(500):
        p = rnd.integers(0, 24, 2)
        points = [p]
        for _ in range(int(rnd.integers(1, 4))):
            points.append(points[-1] + [(0, 1), (1, 0), (0, -1), (-1, 0)][int(rnd.integers(4))])
        look = int(rnd.integers(3))
        rows.append((9, 1, 1, "cycling", look, 1 if k % 11 == 0 else 0, k, [(float(x), float(y)) for x, y in points]))
    tiles = spark.createDataFrame(rows, "z int, x long, y long, layer string, look int, oneway int, osm_id long, geom array<struct<x: double, y: double>>")
    got = {}
    for cell in (3, 7, 10**9):
        out = merge.merge_lines(tiles, ["look"], tolerance_px=0, cell_px=cell).collect()
        got[cell] = sorted((r.look, r.n_lines, min(tuple((p.x, p.y) for p in r.geom), tuple((p.x, p.y) for p in reversed(r.geom)))) for r in out)
    # a ring may begin anywhere, so its points aren't compared
    slim = lambda g: sorted(((look, n, () if p[0] == p[-1] else p) for look, n, p in g), key=str)
    assert len(slim(got[3])) == len(got[10**9]) > 50
    assert slim(got[3]) == slim(got[7]) == slim(got[10**9])


def test_short_lines_go_only_at_low_levels(spark):
    geom = "array(named_struct('x', -123.0D, 'y', 49.0D), named_struct('x', -122.9999D, 'y', 49.0D))"
    ways = spark.sql(f"SELECT 1L AS way_id, map('highway', 'cycleway') AS tags, {geom} AS geom")
    out = merge.merge_lines(features.in_tiles(features.lines(ways), 9), ["comfort"])
    assert {r["z"] for r in out.select("z").distinct().collect()} == {8, 9}


def test_a_line_without_points_is_nowhere(spark):
    ways = spark.sql("SELECT 1L AS way_id, map('highway', 'cycleway') AS tags, cast(array() AS array<struct<x:double,y:double>>) AS geom")
    assert features.in_tiles(features.lines(ways), 8).count() == 0


def test_a_long_way_is_only_in_tiles_along_it(spark):
    ways = spark.sql("SELECT 1L AS way_id, map('highway', 'cycleway') AS tags, transform(sequence(0, 100), i -> named_struct('x', -170D + i * 3D, 'y', 80D - i * 1.6D)) AS geom")
    rows = features.in_tiles(features.lines(ways), 6).select("x", "y").collect()
    assert len(rows) == len(set(rows)) and 64 < len(rows) < 300
    point = features.parking_points(spark.sql("SELECT 'node' AS feature_type, 1L AS osm_id, map('amenity', 'bicycle_parking') AS tags, array(named_struct('x', 10D, 'y', 10D)) AS geom, true AS is_point, false AS can_be_line, false AS can_be_polygon"))
    assert [r["z"] for r in features.in_tiles(point, 14).orderBy("z").collect()] == [12, 13, 14]


def test_lines_beyond_the_map_stay_where_they_are(spark):
    leg = lambda lat: [Row(x=10.0, y=lat), Row(x=10.001, y=lat)]
    rows = spark.createDataFrame([(1, leg(86.0)), (2, leg(-86.0)), (3, leg(60.0))], "osm_id long, geom array<struct<x: double, y: double>>").withColumns({"kind": F.lit("line"), "min_zoom": F.lit(8), "buffer_px": F.lit(4.0)})
    wy = lambda lat: (1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2
    got = {r.osm_id: r for r in features.in_tiles(rows, 8, beyond=True).collect()}
    for i, lat in ((1, 86.0), (2, -86.0), (3, 60.0)):
        assert got[i].y == math.floor(wy(lat) * 256) and got[i].geom[0].y == pytest.approx((wy(lat) * 256 - got[i].y) * 256, abs=1e-6)
    assert got[1].y < 0 and got[2].y > 255
    assert {r.osm_id: r.y for r in features.in_tiles(rows, 8).collect()} == {1: 0, 2: 255, 3: got[3].y}


def test_lines_kept_apart_by_their_own_ids_are_not_shuffled(spark):
    line = [Row(x=1.0, y=1.0), Row(x=90.0, y=1.0)]
    rows = spark.createDataFrame([(i, 1, line) for i in range(50)], "osm_id long, oneway int, geom array<struct<x: double, y: double>>").selectExpr("*", "14 AS z", "0L AS x", "0L AS y", "'cycling' AS layer")
    seen = merge.merge_lines(rows, ["oneway"])
    got = seen.collect()
    assert len(got) == 50 and {(r.n_lines, len(r.geom)) for r in got} == {(1, 2)}
    plan = merge.merge_lines(rows.where("oneway = 1"), ["oneway"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan


def net(spark):
    """Ways over a grid of places, some long, some many times the same, some past the northern edge; names and looks differ."""
    rnd, rows = np.random.default_rng(6), []
    for k in range(260):
        north, p = (85.0, 0.05) if k % 9 == 0 else (49.2, 0.01), rnd.integers(0, 12, 2)
        points = [p]
        for _ in range(int(rnd.integers(1, 4))):
            points.append(points[-1] + [(0, 1), (1, 0), (0, -1), (-1, 0), (3, 2)][int(rnd.integers(5))])
        shape = [Row(x=-123.1 + float(x) * 0.01, y=north[0] + float(y) * north[1]) for x, y in points]
        tags = {"highway": "cycleway"} | ({"oneway": "yes"} if k % 13 == 0 else {}) | ({"name": f"N{k % 2}"} if k % 3 else {}) | ({"foot": "designated", "segregated": "no"} if k % 4 == 0 else {})
        rows += [(len(rows) + i, tags | ({"name": str(i % 2)} if k % 10 == 1 else {}), shape) for i in range((1, 1, 1, 2, 3, 7)[k % 6])]
    rows += [(10_000, {"highway": "cycleway"}, [Row(x=1.0, y=1.0)]), (10_001, {"highway": "cycleway"}, []), (10_002, {"highway": "cycleway"}, [Row(x=179.99, y=1.0), Row(x=180.5, y=1.0)])]
    return features.lines(spark.createDataFrame(rows, "way_id long, tags map<string,string>, geom array<struct<x: double, y: double>>"))


def drawn(df):
    def shape(g):
        p = [(round(v.x, 6), round(v.y, 6)) for v in g]
        return () if p[0] == p[-1] else min(p, p[::-1])  # a ring may begin anywhere

    return sorted((str((r.z, r.x, r.y, *[r[c] for c in map_build.LOOK], r.n_lines)), str(shape(r.geom))) for r in df.collect())


@pytest.mark.parametrize("beyond", [False, True])
def test_merging_before_tiles_gives_what_merging_in_tiles_gives(spark, beyond):
    rows = net(spark)
    placed = features.in_tiles(rows, 14, beyond=beyond).cache()
    want = merge.merge_lines(placed, map_build.LOOK)
    got = drawn(merge.merged(rows, map_build.LOOK, 14, beyond=beyond))
    assert got == drawn(want) and len(got) > 5000
    only = placed.where("x % 2 = 0").select("z", "x", "y").distinct()
    assert drawn(merge.merged(rows, map_build.LOOK, 14, beyond=beyond, only=only)) == drawn(want.join(only, ["z", "x", "y"], "left_semi"))
    tiles = merge.tiles_of(rows, 14, beyond=beyond).collect()
    assert sorted(map(tuple, tiles)) == sorted(map(tuple, placed.where("size(geom) > 1").select("z", "x", "y", "osm_id").collect()))


def test_pieces_of_a_batch_end_where_a_key_ends():
    keys = [[1, 1, 2], [2], [2, 2], [2, 3, 3], [], [3, 4], [5]]
    got = list(merge._runs((pa.RecordBatch.from_pydict({"_h": pa.array(k, pa.int64())}) for k in keys), "_h"))
    assert sum((b["_h"].to_pylist() for b in got), []) == sum(keys, [])
    few = merge.AT_ONCE
    try:
        merge.AT_ONCE = 2
        got = [b["_h"].to_pylist() for b in merge._runs((pa.RecordBatch.from_pydict({"_h": pa.array(k, pa.int64())}) for k in keys), "_h")]
    finally:
        merge.AT_ONCE = few
    assert sum(got, []) == sum(keys, []) and len(got) > 2 and all(a[-1] != b[0] for a, b in zip(got, got[1:]))


def test_lines_that_meet_no_other_are_not_shuffled_by_tile(spark):
    def written():
        of = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(of.apply(i).shuffleWriteRecords() for i in range(of.size()))

    before = written()
    rows = len(catalog.merged_lines(spark, "/root/testdata/sf0.001").select("n_lines").collect())
    assert rows > 10_000 and written() - before < rows
