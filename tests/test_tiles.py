"""Hilbert ids, their inverse, zoom values, addresses and conversions of tags."""

import time

import pytest
from pyspark.sql import functions as F

from tagatlas.functions import tags, tiles, urls, zoom


def test_ids_are_a_bijection_of_each_level_and_neighbours_touch(spark):
    cells = spark.range(5).selectExpr("CAST(id AS INT) AS z").selectExpr("z", "explode(sequence(0, CAST(power(2, z) - 1 AS INT))) AS x", "CAST(power(2, z) AS INT) AS n").selectExpr("z", "x", "explode(sequence(0, n - 1)) AS y")
    rows = cells.select("z", "x", "y", tiles.tile_id(F.col("z"), F.col("x"), F.col("y")).alias("id")).withColumn("t", tiles.tile_zxy(F.col("id"))).collect()
    assert sorted(r["id"] for r in rows) == list(range(sum(4**z for z in range(5))))
    assert all((r["t"]["z"], r["t"]["x"], r["t"]["y"]) == (r["z"], r["x"], r["y"]) for r in rows)
    by_id = {r["id"]: r for r in rows}
    for i, r in by_id.items():
        if i + 1 in by_id and by_id[i + 1]["z"] == r["z"]:
            assert abs(by_id[i + 1]["x"] - r["x"]) + abs(by_id[i + 1]["y"] - r["y"]) == 1
    assert [by_id[i]["id"] for i in (1, 2, 3, 4)] == [1, 2, 3, 4] and [(by_id[i]["x"], by_id[i]["y"]) for i in (1, 2, 3, 4)] == [(0, 0), (0, 1), (1, 1), (1, 0)]


def test_deep_levels_and_bounds(spark):
    far = spark.sql("SELECT 26 AS z, 67108863L AS x, 67108863L AS y UNION ALL SELECT 26, 0L, 12345678L")
    got = far.select("x", "y", tiles.tile_zxy(tiles.tile_id(F.col("z"), F.col("x"), F.col("y"))).alias("t")).collect()
    assert all((r["t"]["z"], r["t"]["x"], r["t"]["y"]) == (26, r["x"], r["y"]) for r in got)
    wrong = spark.sql("SELECT 1 AS z, 2 AS x, 0 AS y UNION ALL SELECT 27, 0, 0 UNION ALL SELECT 1, -1, 0")
    assert {r[0] for r in wrong.select(tiles.tile_id(F.col("z"), F.col("x"), F.col("y"), strict=False)).collect()} == {None}
    with pytest.raises(Exception, match="outside its level"):
        wrong.select(tiles.tile_id(F.col("z"), F.col("x"), F.col("y"))).collect()
    assert spark.sql("SELECT CAST(NULL AS INT) AS z").select(tiles.tile_id(F.col("z"), F.col("z"), F.col("z"))).first()[0] is None
    assert spark.range(1).select(tiles.tile_zxy(F.lit(-1).cast("bigint"))).first()[0] is None


def test_places(spark):
    got = spark.range(1).select(tiles.tile_xy(F.lit(-123.135), F.lit(49.272), F.lit(12)).alias("a"), tiles.tile_xy(F.lit(180.0), F.lit(-90.0), F.lit(3)).alias("b")).first()
    assert tuple(got["a"]) == (646, 1401) and tuple(got["b"]) == (7, 7)


def test_zoom_values(spark):
    rows = spark.sql("SELECT explode(array(0D, 10D, 13D, 16D, 20D)) AS z")
    got = rows.select(zoom.interpolated(F.col("z"), [(10, 2), (16, 8)]), zoom.interpolated(F.col("z"), [(10, 2), (16, 8)], 2.0), zoom.stepped(F.col("z"), [(10, "a"), (16, "b")]), zoom.interpolated_color(F.col("z"), [(10, (0, 0, 0, 0.0)), (16, (200, 100, 0, 1.0))])).collect()
    assert [r[0] for r in got] == [2, 2, 5, 8, 8]
    assert [round(r[1], 6) for r in got] == [2, 2, round(2 + 6 * 7 / 63, 6), 8, 8]
    assert [r[2] for r in got] == ["a", "a", "a", "b", "b"]
    assert got[2][3] == "rgba(100,50,0,0.5)"
    with pytest.raises(ValueError):
        zoom.stepped(F.col("z"), [(2, 1), (1, 1)])


def test_addresses(spark):
    paths = ["/a/1/2/3.mvt", "/a/b/9/8/7Xpbf", "/a/1/2/3.json", "/a/b.json", "/a b.json", "", None, "/x/99999999999999999999/0/0.png"]
    got = [tuple(r[0]) for r in spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string").orderBy("i").select(urls.request(F.col("p"))).collect()]
    none = (False, "", None, None, None, "")
    assert got == [(True, "a", 1, 2, 3, "mvt"), (True, "a/b", 9, 8, 7, "pbf"), (True, "a", 1, 2, 3, "json"), (True, "a/b", None, None, None, "json"), none, none, none, (True, "x", 2**62, 0, 0, "png")]
    rows = spark.createDataFrame([("https://a", "https://a,*"), ("https://b", "https://a"), ("https://a", None)], "o string, l string")
    assert [r[0] for r in rows.select(urls.allowed_origin(F.col("o"), F.col("l"))).collect()] == ["*", None, None]
    rows = spark.createDataFrame([("base", None), ("base", ""), ("base", "x/{name}-{name}.bin")], "n string, t string")
    assert [r[0] for r in rows.select(urls.archive_path(F.col("n"), F.col("t"))).collect()] == ["base.pmtiles", "base.pmtiles", "x/base-base.bin"]
    assert spark.range(1).select(urls.view_query(F.lit(12.34567), F.lit(-123.1), F.lit(49.2))).first()[0] == "zoom=12.3457&lng=-123.1000000000&lat=49.2000000000"
    assert spark.range(1).select(urls.numbers(F.lit("1, 2.5,x"))).first()[0] == [1.0, 2.5, None]
    assert [r[0] for r in spark.createDataFrame([("Planet",), ("british-columbia",)], "a string").select(urls.extract_source(F.col("a"))).collect()] == ["aws:latest", "geofabrik:british-columbia"]
    rows = spark.createDataFrame([("", ["https://x", "pmtiles://y"]), (None, ["https://x"]), ("s", None)], "s string, a array<string>")
    assert [tuple(r) for r in rows.select(urls.tile_source(F.col("s"), "d"), urls.reads_archives(F.col("a"))).collect()] == [("d", True), ("d", False), ("s", False)]


def test_conversions(spark):
    rows = spark.createDataFrame([(v,) for v in ["", " 12 ", "0x1F", "1e2", "~5", "5d", "NaN", None]], "v string")
    assert [r[0] for r in rows.select(tags.coerced_number(F.col("v"))).collect()] == [0.0, 12.0, 31.0, 100.0, None, None, None, None]
    rows = spark.createDataFrame([(v,) for v in ["yes", "partial", "no", "", None]], "v string")
    assert [r[0] for r in rows.select(tags.yes_or_no(F.col("v"))).collect()] == [True, True, False, None, None]
    rows = spark.createDataFrame([(v,) for v in [" 12abc", "x1", "-7", "99999999999999999999", None]], "v string")
    assert [r[0] for r in rows.select(tags.leading_integer(F.col("v"))).collect()] == [12, None, -7, None, None]
    rows = spark.createDataFrame([(v,) for v in ["30", "50 mph", "none", "", None, "-5", "99999999999999999999"]], "v string")
    assert [r[0] for r in rows.select(tags.whole_number(F.col("v"))).collect()] == [30, 0, 0, 0, None, -5, 0]
    assert [r[0] for r in rows.select(tags.whole_number(F.col("v"), "null")).collect()] == [30, None, None, None, None, -5, None]
    rows = spark.createDataFrame([(v,) for v in [None, float("nan"), 3.0, 9.0]], "v double")
    assert [r[0] for r in rows.select(tags.clamped(F.col("v"), 5, 20, 13)).collect()] == [13.0, 13.0, 5.0, 9.0]


def test_null_safe_tests_of_tags(spark):
    rows = spark.createDataFrame([({"a": "x"},), ({},), (None,)], "tags map<string,string>")
    a = tags.tag("a")
    got = rows.select(tags.has("a"), tags.equals(a, "x"), tags.differs(a, "x"), tags.within(a, "x", "y"), tags.outside(a, "x", "y")).collect()
    assert [tuple(r) for r in got] == [(True, True, False, True, False)] + [(False, False, True, False, True)] * 2


def test_a_million_tiles_in_seconds(spark):
    at = spark.range(1_000_000).selectExpr("id", "id * 7919 % 16384 AS x", "id * 6101 % 16384 AS y")
    began = time.monotonic()
    ids = at.select("x", "y", tiles.tile_zxy(tiles.tile_id(F.lit(14), F.col("x"), F.col("y"))).alias("t"))
    assert ids.where("t.z <> 14 OR t.x <> x OR t.y <> y").count() == 0
    assert time.monotonic() - began < 60  # the walk of each row on its own took 800 s of one core
