"""Single elements, parking details, areas' centres, boxes, the service's decisions, directories and the incremental run."""

import pytest
from pyspark.sql import functions as F

from tagatlas.operators import directory, elements, features, geometry, routes, service
from tagatlas.streaming import rebuild

ELEMENT = "feature_type string, osm_id bigint, tags map<string,string>"


def test_lookup_needs_type_and_id(spark):
    rows = spark.createDataFrame([("node", 1, {"a": "n"}), ("way", 1, {"a": "w"})], ELEMENT)
    assert elements.exactly_one(elements.lookup(rows, "way", 1)).collect()[0]["tags"] == {"a": "w"}
    assert elements.lookup(rows, None, 1).count() == elements.lookup(rows, "way", None).count() == 0
    for found in (elements.lookup(rows, "way", 2), rows):
        with pytest.raises(Exception, match="elements found"):
            elements.exactly_one(found).collect()


def test_parking_details(spark):
    rows = spark.createDataFrame([
        ("node", 1, {"amenity": "bicycle_parking", "bicycle_parking": "stands", "capacity": "12", "covered": "partial", "indoor": "no", "fee": "no", "name": "N"}),
        ("way", 2, {"amenity": "bicycle_parking", "bicycle_parking": "carousel", "capacity": "many", "covered": "", "type": "bike_parking"}),
        ("relation", 3, {"amenity": "bicycle_parking"}), ("node", 4, {"amenity": "bench"}), ("node", 5, {"amenity": "bicycle_parking", "type": "x"}), ("node", 6, None),
    ], ELEMENT)
    got = {r["osm_id"]: r for r in elements.parking_details(rows).collect()}
    assert set(got) == {1, 2}
    a, b = got[1], got[2]
    assert (a["bicycleParkingType"], a["capacity"], a["covered"], a["indoor"], a["other_tags"]) == ("stands", 12.0, True, False, {"bicycle_parking": "stands", "fee": "no"})
    assert (b["bicycleParkingType"], b["capacity"], b["covered"], b["other_tags"]) == (None, None, None, {"bicycle_parking": "carousel", "capacity": "many", "covered": ""})
    assert [tuple(r) for r in elements.parking_box(elements.parking_details(rows)).orderBy("osm_id").collect()] == [("node", 1, "12", "stands"), ("way", 2, "Unknown", "Unknown")]
    with pytest.raises(Exception, match="not bicycle parking"):
        elements.parking_details(rows, strict=True).collect()


def test_routes_keep_all_ways_and_order_ids(spark):
    ways = spark.createDataFrame([(1,), (2,), (3,)], "way_id bigint")
    kind = {"type": "route", "route": "bicycle"}
    relations = spark.createDataFrame([
        (10, [("way", 1, ""), ("way", 1, "x"), ("node", 2, "")], kind), (9, [("way", 1, "")], kind), (8, [("way", 2, "")], {"type": "route", "route": "hiking"}), (7, None, kind), (6, [], None),
    ], "relation_id bigint, members array<struct<type:string,ref:bigint,role:string>>, tags map<string,string>")
    got = lambda **k: {r["way_id"]: r["routes"] for r in routes.with_routes(ways, relations, **k).collect()}
    assert got() == {1: "9,10", 2: None, 3: None}
    assert got(dedupe_members=False)[1] == "9,10,10"


def test_closed_ways_are_lines_and_areas(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 2.0, 0.0), (3, 2.0, 2.0), (4, 0.0, 2.0)], "node_id bigint, lon double, lat double")
    ring = [1, 2, 3, 4, 1]
    ways = spark.createDataFrame([(1, ring, {}), (2, ring, {"area": "yes"}), (3, ring, {"area": "no"}), (4, [1, 2], None), (5, [1, 99], {}), (6, None, {}), (7, [99], {})], "way_id bigint, nodes array<bigint>, tags map<string,string>")
    got = {r["way_id"]: r for r in geometry.capabilities(geometry.with_geometry(ways, nodes)).collect()}
    assert [(got[i]["can_be_line"], got[i]["can_be_polygon"]) for i in (1, 2, 3, 4)] == [(True, True), (False, True), (True, False), (True, False)]
    assert [len(got[i]["geom"]) for i in range(1, 8)] == [5, 5, 5, 2, 1, 0, 0]
    centre = lambda points: tuple(spark.createDataFrame([(points,)], "g array<struct<x:double,y:double>>").select(features.centroid(F.col("g")).alias("c")).first()["c"] or ())
    assert centre([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]) == (1.0, 1.0)
    assert centre([(1.0, 1.0), (3.0, 1.0)]) == (2.0, 1.0) and centre([(5.0, 6.0)]) == (5.0, 6.0) and centre([]) == ()
    parking = spark.createDataFrame([("way", 1, {"amenity": "bicycle_parking"}, False, True, True), ("node", 2, {"amenity": "bicycle_parking"}, True, False, False), ("node", 3, {"amenity": "bicycle_parking"}, True, True, False)], ELEMENT + ", is_point boolean, can_be_line boolean, can_be_polygon boolean")
    got = features.all_features(features.parking_points(parking), features.parking_centroids(parking)).select("kind", "osm_id", "osmNodeId", "osmWayId").collect()
    assert sorted(map(tuple, got)) == [("centroid", 1, None, 1), ("point", 2, 2, None)]


def test_every_answer_of_the_service(spark):
    requests = spark.createDataFrame([
        (1, "POST", "/m/0/0/0.mvt"), (2, "GET", "/nothing here"), (3, "GET", "/lost/0/0/0.mvt"), (4, "GET", "/m.json"), (5, "GET", "/m/9/0/0.mvt"), (6, "GET", "/m/1/0/0.png"), (7, "GET", "/m/1/0/0.pbf"), (8, "HEAD", "/m/1/0/0.mvt"),
        (9, "GET", "/m/1/1/1.mvt"), (10, "GET", "/a/1/2/3.json"), (11, "GET", "/any/1/0/0.zip"), (12, "GET", "/m/1/5/0.mvt"), (13, None, "/m/1/0/0.mvt"), (14, "GET", None),
    ], "i int, method string, path string")
    archives = spark.createDataFrame([("m", 1, 0, 8, "{m}"), ("a", 1, 0, 8, "{}"), ("any", 0, 0, 8, "{}")], "archive string, tile_type int, min_zoom int, max_zoom int, tilejson string")
    entries = spark.createDataFrame([("m", 0, 2, 100, 7)], "archive string, tile_id bigint, run_length bigint, offset bigint, length bigint")
    got = {r["i"]: r for r in service.answers(requests, archives, entries).collect()}
    assert [got[i]["status"] for i in range(1, 15)] == [405, 404, 404, 200, 404, 400, 200, 200, 204, 400, 204, 204, 200, 404]
    assert (got[7]["body_offset"], got[7]["body_length"], got[7]["content_type"]) == (100, 7, "application/x-protobuf")
    assert (got[4]["body_text"], got[4]["content_type"], got[9]["content_type"]) == ("{m}", "application/json", None)
    assert [got[i]["cache_control"] for i in (1, 2, 3, 9)] == [None, None, "max-age=86400", "max-age=86400"]


ENTRY = "archive string, directory bigint, tile_id bigint, run_length bigint, offset bigint, length bigint"


def test_directory_trees(spark):
    rows = [("a", None, 0, 1, 0, 5), ("a", None, 10, 0, 100, 9), ("a", 100, 10, 2, 5, 5), ("a", 100, 20, 0, 200, 9), ("a", 200, 20, 0, 300, 9), ("a", 300, 20, 3, 10, 5), ("a", 777, 50, 1, 0, 1)]
    got = directory.flattened(spark.createDataFrame(rows, ENTRY))
    assert sorted((r["tile_id"], r["run_length"]) for r in got.collect()) == [(0, 1), (10, 2), (20, 3)]
    deep = [*rows[:-2], ("a", 300, 20, 0, 400, 9), ("a", 400, 20, 1, 0, 1)]
    with pytest.raises(Exception, match="too deeply"):
        directory.flattened(spark.createDataFrame(deep, ENTRY)).collect()


@pytest.mark.parametrize("bits", [2, 4, 16])
def test_runs_and_lookups_at_any_block_size(spark, bits):
    places = [i // 7 if i % 13 else 1000 + i for i in range(300)]
    rows = [("a", i, places[i] * 10, 5) for i in range(300) if i % 50 != 49]
    rows += [("b", i, 0, 1) for i in range(200)]  # one place behind a whole archive
    tiles = spark.createDataFrame(rows, "archive string, tile_id bigint, offset bigint, length bigint")
    found = directory.runs(tiles, bits)
    want, last = [], None
    for row in rows:
        if last and (last[0], last[1] + last[4], last[2], last[3]) == row:
            last[4] += 1
        else:
            want.append(last := [*row, 1])
    assert sorted((r["archive"], r["tile_id"], r["offset"], r["length"], r["run_length"]) for r in found.collect()) == sorted(map(tuple, want))
    asked = spark.createDataFrame([(x, i) for x in "abc" for i in (-5, 0, 48, 49, 50, 150, 199, 298, 299, 10**9)] + [(None, 1), ("a", None)], "archive string, tile_id bigint")
    known = {(a, i): (o, n) for a, i, o, n in rows}
    for look in (directory.range_lookup, directory.asof_lookup):
        got = look(asked, found, bits).collect()
        assert len(got) == 32
        assert all((r["offset"], r["length"]) == known.get((r["archive"], r["tile_id"]), (None, None)) for r in got)


def test_encoding_is_undone_by_decoding(spark):
    rows = [(1, 5, 1, 0, 10), (1, 6, 1, 10, 5), (1, 9, 2, 0, 10), (2, 0, 1, 40, 1)]
    entries = spark.createDataFrame(rows, "directory int, tile_id bigint, run_length bigint, offset bigint, length bigint")
    got = directory.decoded(directory.encoded(entries)).select("directory", "tile_id", "run_length", "offset", "length").collect()
    assert sorted(map(tuple, got)) == rows
    odd = spark.createDataFrame([(1, 0, 5, 1, 10, 0)], "directory int, i int, delta bigint, run_length bigint, length bigint, raw_offset bigint")
    assert directory.decoded(odd).first()["offset"] == -1


def test_incremental_run_takes_only_what_is_new(spark, tmp_path):
    folders = [str(tmp_path / n) for n in ("ways", "out", "state")]
    for k, highway in enumerate(["cycleway", "path", "cycleway"]):
        spark.createDataFrame([(k, {"highway": highway})], "way_id bigint, tags map<string,string>").write.mode("append").parquet(folders[0])
        rebuild.classify_new(spark, *folders).awaitTermination(60)
    got = spark.read.parquet(folders[1])
    assert sorted(r["osm_id"] for r in got.collect()) == [0, 2]
    rebuild.comfort_counts(spark, folders[0], str(tmp_path / "seen"), str(tmp_path / "counts")).awaitTermination(60)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "seen")).collect()] == [("track", 4, 2)]


def test_boxes(spark):
    rows = spark.createDataFrame([("N", "lane", True, False, 0, None, None), (None, "track", False, True, -1, True, True), ("", "lane", False, False, 1, None, None)], "name string, class string, shared_with_vehicles boolean, shared_with_pedestrians boolean, oneway int, construction boolean, dooring_risk boolean")
    got = [(r["title"], r["badges"]) for r in elements.way_box(rows).collect()]
    assert got == [
        ("N (Cycling Lane)", ["shared with vehicles", "shared lane"]),
        ("Cycling Track", ["Under Construction", "risk of dooring (adjacent parking)", "shared with pedestrians", "one way", "track (separated from roadway)"]),
        ("Cycling Lane", ["one way", "bike lane on roadway"]),
    ]


def test_rings():
    closed = [[1, 2, 3, 1]]
    assert geometry.rings(closed) == closed and geometry.rings([]) == []
    # halves that run either way, a dead end on the way, and a line that leads nowhere
    assert [sorted(set(r)) for r in geometry.rings([[1, 2, 3], [3, 9], [1, 4, 3], [20, 21]])] == [[1, 2, 3, 4]]
    # two rings that touch at a node stay two rings, wherever the walk begins
    eight = [[2, 3, 1], [1, 4, 5], [5, 1], [1, 2]]
    for k in range(4):
        assert sorted(sorted(set(r)) for r in geometry.rings(eight[k:] + eight[:k])) == [[1, 2, 3], [1, 4, 5]]
    assert geometry.rings([[1, 2], [2, 3], [3, 4]]) == []


@pytest.mark.parametrize("seed", range(20))
def test_rings_find_all_of_a_shuffled_cover(seed):
    import random

    r, lines, want = random.Random(seed), [], []
    for k in range(5):
        nodes = list(range(100 * k, 100 * k + r.randint(4, 12)))
        cuts = sorted(r.sample(range(len(nodes)), r.randint(1, 4)))
        ring = nodes[cuts[0] :] + nodes[: cuts[0]]
        at = [c - cuts[0] for c in cuts] + [len(nodes)]
        lines += [(ring + ring[:1])[a : b + 1] for a, b in zip(at, at[1:])]
        want.append(nodes)
    lines = [line[:: r.choice((1, -1))] for line in lines] + [[900, 901], [901, 902]]
    r.shuffle(lines)
    got = geometry.rings(lines)
    assert sorted(sorted(x[1:]) for x in got) == want
    assert all(x[0] == x[-1] and {frozenset(p) for p in zip(x, x[1:])} <= {frozenset(p) for line in lines for p in zip(line, line[1:])} for x in got)


def test_relation_areas(spark):
    of = lambda *refs: [("way", ref, role) for ref, role in refs]
    tags = {"type": "multipolygon", "amenity": "bicycle_parking"}
    relations = spark.createDataFrame([
        (1, of((10, "outer"), (11, "outer"), (12, "inner")), tags), (2, of((10, "outer"), (99, "outer")), tags), (3, of((12, "inner")), tags), (4, [], tags), (5, None, None),
        (6, of((12, None)), {"type": "boundary"}), (7, of((12, "outer")), {"type": "route"}), (8, [("node", 12, "outer")], tags), (9, of((12, ""), (13, "outer")), tags), (10, of((14, "outer")), tags),
    ], "relation_id bigint, members array<struct<type:string,ref:bigint,role:string>>, tags map<string,string>")
    p = lambda *xy: [(float(a), float(b)) for a, b in xy]
    ways = spark.createDataFrame([
        (10, [1, 2, 3], p((0, 0), (8, 0), (8, 8))), (11, [1, 4, 3], p((0, 0), (0, 8), (8, 8))), (12, [5, 6, 7, 8, 5], p((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))),
        (13, [9, 10, 11, 9], p((10, 0), (12, 0), (12, 4), (10, 0))), (14, [1, 2, 3, 1], p((0, 0), (1, 1))), (15, None, None),
    ], "way_id bigint, nodes array<bigint>, geom array<struct<x:double,y:double>>")
    got = {r["osm_id"]: (r["c"]["x"], r["c"]["y"]) for r in geometry.relation_areas(relations, ways).select("osm_id", features.centroid(F.col("geom")).alias("c")).collect()}
    assert set(got) == {1, 6, 9}
    assert got[1] == pytest.approx(((64 * 4 - 16 * 2) / 48, (64 * 4 - 16 * 2) / 48)) and got[6] == (2.0, 2.0)
    # two areas: a square of 16 and a triangle of 4
    assert got[9] == pytest.approx(((16 * 2 + 4 * 34 / 3) / 20, (16 * 2 + 4 * 4 / 3) / 20))
    assert geometry.relation_areas(relations.limit(0), ways).count() == 0 and geometry.relation_areas(relations, ways.limit(0)).count() == 0


def test_parking_of_a_relation_is_a_feature(spark):
    from tagatlas.plans import map_build

    nodes = spark.createDataFrame([(k, float(x), float(y), None) for k, x, y in ((1, 0, 0), (2, 2, 0), (3, 2, 2), (4, 0, 2))], "node_id bigint, lon double, lat double, tags map<string,string>")
    ways = spark.createDataFrame([(20, [1, 2, 3], None), (21, [3, 4, 1], {"foot": "yes"})], "way_id bigint, nodes array<bigint>, tags map<string,string>")
    members = [("way", 20, "outer"), ("way", 21, "outer")]
    relations = spark.createDataFrame([(30, members, {"type": "multipolygon", "amenity": "bicycle_parking", "name": "a"}), (31, members, {"type": "multipolygon"})], "relation_id bigint, members array<struct<type:string,ref:bigint,role:string>>, tags map<string,string>")
    (r,) = map_build.map_features(nodes, ways, relations).collect()
    assert (r["kind"], r["feature_type"], r["osm_id"], r["osmWayId"], r["name"]) == ("centroid", "relation", 30, 30, "a")
    assert [tuple(p) for p in r["geom"]] == [(1.0, 1.0)]
