"""Filters with present, missing and wrong-typed attributes, and the layers that draw."""

import pytest
from pyspark.sql import functions as F

from tagatlas.operators import styles
from tagatlas.plans import catalog


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame([(0, "line", "track", 3, True), (1, "point", None, None, None), (2, "centroid", "lane", 5, False), (3, "polygon", "x", 1, None)], "i int, kind string, class string, n int, b boolean")


CASES = [
    (["==", "class", "track"], [0]), (["!=", "class", "track"], [1, 2, 3]), (["in", "class", "track", "lane"], [0, 2]), (["!in", "class", "track", "lane"], [1, 3]), (["has", "n"], [0, 2, 3]), (["!has", "n"], [1]),
    ([">", "n", 3], [2]), ([">=", "n", 3], [0, 2]), (["<", "n", 3], [3]), (["<=", "n", 3], [0, 3]), (["==", "n", "3"], []), (["!=", "n", "3"], [0, 1, 2, 3]), (["==", "b", True], [0]), (["!=", "b", True], [1, 2, 3]),
    (["==", "n", True], []), (["==", "$type", "Point"], [1, 2]), (["==", "$type", "LineString"], [0]), (["all", ["has", "n"], ["any", ["==", "n", 1], ["==", "n", 5]]], [2, 3]), (["none", ["has", "n"]], [1]),
    (["all"], [0, 1, 2, 3]), (["any"], []), (["has", "absent"], []), (["!=", "absent", 1], [0, 1, 2, 3]), ([">", "class", 1], []),
]


@pytest.mark.parametrize("tree, want", CASES, ids=lambda v: str(v))
def test_filters(rows, tree, want):
    got = rows.select("i", styles.condition(tree, rows).alias("c")).collect()
    assert all(r["c"] is not None for r in got)
    assert sorted(r["i"] for r in got if r["c"]) == want


def test_unknown_filter(rows):
    with pytest.raises(ValueError):
        styles.condition(["~", "class", "a"], rows)


def test_layers_are_all_there():
    assert [len(x) for x in (styles.CYCLING, styles.WALKING, styles.BASEMAP)] == [10, 2, 45]
    assert len({layer[0] for layer in styles.CYCLING + styles.WALKING + styles.BASEMAP}) == 57


def test_drawing_order_and_hits(spark):
    feats = spark.createDataFrame([("cycling", "line", "way", 1, 13, 3, 1, "track", "N"), ("cycling", "line", "way", 2, 12, 1, 0, "lane", None), ("cycling", "line", "way", 3, 7, 1, 0, "lane", None)], "layer string, kind string, feature_type string, osm_id bigint, z int, comfort int, oneway int, class string, name string")
    got = [(r["osm_id"], r["style_layer"]) for r in styles.drawn(feats, styles.CYCLING).orderBy("osm_id", "layer_ord").collect()]
    assert got == [(1, "cycling_path_3"), (1, "cycling_path_3_inner"), (1, "cycling_path_oneway_arrows_white"), (1, "cycling_path_name"), (2, "cycling_path_1")]
    hits = styles.drawn(feats, styles.CYCLING).withColumn("click", F.lit(1))
    assert [tuple(r) for r in styles.top_hit(hits, "click").collect()] == [(1, "cycling_path_3", "way", 1)]


def test_small_expressions(rows):
    got = rows.where("i = 0").select(styles.label("{class} {absent}", rows), styles.label("{class}", rows, upper=True), styles.marked_color(F.lit("c"), F.lit(None).cast("boolean"), F.lit(True)), styles.marked_color(F.lit("c"), F.lit(False), F.lit(None).cast("boolean")), styles.arrow_rotation(F.lit(1)), styles.arrow_rotation(F.lit(-1))).first()
    assert tuple(got) == ("track ", "TRACK", styles.MARKED_COLOR, "c", 90, 270)


def test_paint_by_hand(spark):
    rows = spark.createDataFrame(
        [("highway_motorway_inner", 5, "A"), ("highway_motorway_inner", 6, "A"), ("highway_motorway_casing", 13, "A"), ("place_town", 7, "A"), ("place_town", 8, None), ("highway_name_motorway", 9, "A"), ("walking_path", 13, "A"), ("boundary_state", 2, "A"), ("background", 4, "A")],
        "style_layer string, z int, `name:latin` string",
    ).withColumns({"ref": F.lit("h1"), "name:nonlatin": F.lit("b")})
    got = {(r["style_layer"], r["z"]): r for r in styles.painted(rows, styles.BASEMAP_PAINT).collect()}
    assert [got["highway_motorway_inner", z]["color"] for z in (5, 6)] == ["rgba(217,217,217,0.53)", "rgba(255,255,255,1.0)"]
    assert got["highway_motorway_inner", 5]["width"] == pytest.approx(2 - 0.7 * 0.4 / 0.96)
    assert got["highway_motorway_casing", 13]["width"] == pytest.approx(3 + 37 * (1.4**7 - 1) / (1.4**14 - 1))
    assert [(r["icon"], r["anchor"], r["label"], r["icon_size"]) for r in (got["place_town", 7], got["place_town", 8])] == [("circle-11", "left", "A\nB", 0.4), ("", "center", "\nB", 0.4)]
    assert tuple(got["highway_name_motorway", 9][c] for c in ("label", "size", "spacing", "translate", "font")) == ("h1", 10, 350, "0,2", "Metropolis Light")
    assert tuple(got["walking_path", 13][c] for c in ("color", "width", "cap", "join", "label")) == ("rgb(238, 165, 80)", 1, "round", "round", None)
    assert tuple(got["boundary_state", 2][c] for c in ("dash", "blur", "width", "opacity")) == ("2,2", 0.4, 1, 1)
    assert all(got["background", 4][c] is None for c in ("color", "width", "dash", "label"))


@pytest.mark.parametrize("layers", [styles.PAINT, styles.BASEMAP_PAINT], ids=["cycling", "basemap"])
def test_whole_levels_are_painted_by_a_small_table(spark, layers):
    """The same values as row by row, at all levels and at none; the rows themselves meet no interpolation."""
    rows = spark.createDataFrame([(name, z, z is not None and z % 3 == 0) for name in [*layers, "unknown", None] for z in [*range(-3, 31), None]], "style_layer string, z int, selected boolean")
    rows = rows.withColumns({"oneway": F.col("z") % 2, "name": F.lit("n"), "name:latin": F.lit("a"), "name:nonlatin": F.lit("b"), "ref": F.lit("r")})
    got, want = styles.painted(rows, layers), styles.painted(rows.withColumn("z", F.col("z").cast("double")), layers)
    assert got.columns == want.columns and got.count() == rows.count()
    order = lambda df: sorted((tuple(r) for r in df.withColumn("z", F.col("z").cast("double")).collect()), key=repr)
    assert order(got) == order(want)
    plan = got.select("color", "width", "dash")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_features_are_spread_before_levels_multiply_them(spark):
    plan = catalog.style_basemap_paint(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    spread = plan.index("hashpartitioning(k")  # plans are printed from the last step to the first
    assert all(plan.index(step) < spread for step in ("Generate explode", "BroadcastHashJoin")) and "[0,1,2,3,4,5,6,7,8,9,10,11,12,13,14,15,16,17]" not in plan


def test_every_layer_with_features_is_painted():
    for layers, paint in ((styles.CYCLING, styles.PAINT), (styles.BASEMAP + styles.WALKING, styles.BASEMAP_PAINT)):
        assert {layer[0] for layer in layers if layer[1]} == set(paint)
        known = {"color", "stroke", "marked", "base", "rotate", "label", "upper", *styles.PAINT_NUMBERS, *styles.PAINT_WORDS}
        assert all(set(p) <= known for p in paint.values())
