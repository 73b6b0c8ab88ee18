import math
import random

from pyspark.sql import functions as F

from tagatlas.operators import hits
from tagatlas.plans import catalog

LINES = "layer_ord int, style_layer string, feature_type string, osm_id long, z int, geom array<struct<x: double, y: double>>, reach double"


def pixel(lon, lat, z):
    phi = math.radians(lat)
    return (lon + 180) / 360 * 2**z * 256, (1 - math.log(math.tan(phi) + 1 / math.cos(phi)) / math.pi) / 2 * 2**z * 256


def apart(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    t = max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n)) if n else 0
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def test_against_all_pairs(spark):
    rnd = random.Random(2)
    place = lambda: (rnd.uniform(-123.2, -123.1), rnd.uniform(49.2, 49.25))
    lines = [(k % 5, f"l{k % 5}", "way", k, 13 + k % 2, [place() for _ in range(rnd.choice([1, 2, 2, 5]))], rnd.choice([0.0, 1.5, 20.0, 90.0])) for k in range(60)]
    lines += [(9, "l9", "way", 100, 13, [(-170.0, 49.22), (-60.0, 49.23)], 3.0), (9, "l9", "way", 101, 13, [], 3.0), (9, "l9", "way", 102, 13, [place(), place()], None), (9, "l9", "node", 103, 14, [(-123.15, 49.22)], 30.0)]
    clicks = [(k, 13 + k % 2, *place()) for k in range(300)] + [(900, None, 0.0, 0.0), (901, 13, None, 49.2), (902, 14, -123.15, 49.22), (903, 14, -123.15, 49.22)]
    want = {}
    for c, z, lon, lat in clicks:
        for order, _, kind, i, level, geom, reach in lines:
            if z is not None and lon is not None and level == z and geom and reach is not None:
                points = [pixel(*g, z) for g in geom]
                d = min(apart(pixel(lon, lat, z), a, b) for a, b in zip(points, points[1:] or points))
                if d <= reach:
                    want[c, i] = (order, kind, d)
    drawn = spark.createDataFrame([(*r[:5], [{"x": x, "y": y} for x, y in r[5]], r[6]) for r in lines], LINES)
    asked = spark.createDataFrame(clicks, "click long, z int, lon double, lat double")
    for cell in (16, 64, 1000):
        found = hits.hits(asked, drawn, cell_px=cell)
        got = {(r.click, r.osm_id): (r.layer_ord, r.feature_type, r.distance) for r in found.collect()}
        assert got.keys() == want.keys() and all(abs(got[k][2] - want[k][2]) < 1e-6 and got[k][:2] == want[k][:2] for k in got)
    top = {r.click: r.osm_id for r in hits.drawn_last(found).collect()}
    assert top == {c: max((want[x][0], x[1]) for x in want if x[0] == c)[1] for c, _ in want}
    # a leg across the map is in the cells along it, not in those of its box
    assert hits.cells(hits.placed(drawn.where("osm_id = 100"))).count() < 4 * 110 / 360 * 2**13 * 256 / hits.CELL_PX
    assert hits.hits(asked.limit(0), drawn).count() == hits.hits(asked, drawn.limit(0)).count() == 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and F is not None


def test_rows_that_no_click_is_near_go_first(spark):
    """All hits stay, also at the edges of blocks and of the map; of other rows only those over several blocks do."""
    rnd = random.Random(5)
    edge = [-180.0 + 360 / 1024 * k for k in (150, 151, 1024)]  # borders of blocks
    place = lambda: (rnd.choice([*edge, -123.15]) + rnd.uniform(-0.0005, 0.0005), rnd.choice([49.2, 85.2, -89.0]) + rnd.uniform(-0.0005, 0.0005))
    close = lambda p: (p[0] + rnd.uniform(-0.0003, 0.0003), p[1] + rnd.uniform(-0.0003, 0.0003))
    ways = [[p, *[close(p) for _ in range(rnd.choice([0, 1, 1, 3]))]] for p in (place() for _ in range(300))]
    ways += [[(-170.0, 49.22), (-60.0, 49.23)], [], [(10.0, 10.0), (10.001, 10.001)], [(float("nan"), 49.2), place(), place()], [(200.0, 49.2), (200.0, 49.2001)]]
    clicks = [(k, 13 + k % 2, *place()) for k in range(300)] + [(900, 13, 200.0, 49.2), (901, 13, None, 49.2), (902, None, -123.15, 49.22)]
    rows = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in w]) for k, w in enumerate(ways)], "osm_id long, geom array<struct<x: double, y: double>>")
    asked = spark.createDataFrame(clicks, "click long, z int, lon double, lat double")
    drawn = lambda df: df.selectExpr("1 AS layer_ord", "'l' AS style_layer", "'way' AS feature_type", "osm_id", "CAST(13 + osm_id % 2 AS INT) AS z", "geom", "CAST(3 + osm_id % 2 AS DOUBLE) AS reach")
    kept = hits.near(rows, asked, 13, 4.0)
    found = lambda df: sorted((r.click, r.osm_id, r.distance) for r in hits.hits(asked, drawn(df)).collect())
    assert found(kept) == found(rows) and len(found(rows)) > 100 and kept.columns == rows.columns
    ids = [r.osm_id for r in kept.collect()]
    assert len(set(ids)) == len(ids) and 302 not in ids and {300, 301, 303, 304} <= set(ids)
    none = hits.near(rows.where("osm_id in (302, 304)"), asked.limit(0), 13, 4.0)
    assert none.count() == 0


def test_ways_meet_the_clicks_before_they_are_classified(spark):
    plan = catalog.clicked_places(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("_asked") > plan.index("style_layer")  # printed from the last step to the first
