"""Map features from classified ways, points and areas, and what of them each zoom level shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagatlas.functions.tags import equals, tag
from tagatlas.functions.tiles import world_xy
from tagatlas.operators.comfort import ATTRIBUTES, classify

#: From which zoom level lines, points and a line's details show, the buffer around a tile in pixels, and the pixels of a tile.
LINE_ZOOM, POINT_ZOOM, DETAIL_ZOOM = 6, 12, 13
BUFFER_PX, TILE_PX = 4.0, 256
DETAILS = ("name", "surface", "routes")
PARKING = "bicycle_parking"


def lines(ways: DataFrame, layer: str = "cycling", **policy: str) -> DataFrame:
    """Line features: classified ways with name, surface and, if the input has it, routes."""
    out = classify(ways, **policy)
    routes = F.col("routes") if "routes" in ways.columns else F.lit(None).cast("string")
    extra = [F.col("geom")] if "geom" in ways.columns else []
    return out.select(
        F.lit(layer).alias("layer"), F.lit("line").alias("kind"), F.lit("way").alias("feature_type"), F.col("way_id").alias("osm_id"), "branch", *ATTRIBUTES,
        tag("name").alias("name"), tag("surface").alias("surface"), routes.alias("routes"), F.lit(LINE_ZOOM).alias("min_zoom"), F.lit(BUFFER_PX).alias("buffer_px"), *extra,
    )


def parking_points(elements: DataFrame, layer: str = "cycling") -> DataFrame:
    """Bicycle parking at points. Elements: feature_type, osm_id, tags, is_point, can_be_line, can_be_polygon."""
    wanted = F.coalesce("is_point", F.lit(False)) & ~F.coalesce("can_be_line", F.lit(False)) & equals(tag("amenity"), PARKING)
    return _parking(elements.where(wanted), layer, "point").withColumn("osmNodeId", F.col("osm_id"))


def parking_centroids(elements: DataFrame, layer: str = "cycling") -> DataFrame:
    """Bicycle parking areas, at their centre; an element that is also a line counts here too."""
    wanted = F.coalesce("can_be_polygon", F.lit(False)) & equals(tag("amenity"), PARKING)
    got = _parking(elements.where(wanted), layer, "centroid").withColumn("osmWayId", F.col("osm_id"))
    return got.withColumn("geom", F.array(centroid(F.col("geom")))) if "geom" in elements.columns else got


def _parking(elements: DataFrame, layer: str, kind: str) -> DataFrame:
    extra = [F.col("geom")] if "geom" in elements.columns else []
    return elements.select(
        F.lit(layer).alias("layer"), F.lit(kind).alias("kind"), "feature_type", "osm_id", tag("amenity").alias("amenity"), tag("name").alias("name"), F.lit(POINT_ZOOM).alias("min_zoom"), *extra
    )


def all_features(*parts: DataFrame) -> DataFrame:
    """Features of several kinds as one layer; what a kind doesn't have is NULL."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def centroid(ring: Column) -> Column:
    """Centre of the area within a ring of x, y points; of the points themselves where the ring has no area."""
    n = F.size(ring)
    if_closed = F.when((n > 1) & (ring[0] == F.try_element_at(ring, n)), n - 1).otherwise(n)
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(if_closed - 1, F.lit(0))), lambda i: F.struct(ring[i].alias("a"), ring[F.pmod(i + 1, F.greatest(if_closed, F.lit(1)))].alias("b")))
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("area", "x", "y", "sx", "sy")])

    def step(at: Column, p: Column) -> Column:
        # taken relative to the first point, so that small areas far from the origin keep their digits
        ax, ay, bx, by = p.a.x - ring[0].x, p.a.y - ring[0].y, p.b.x - ring[0].x, p.b.y - ring[0].y
        cross = ax * by - bx * ay
        return F.struct((at.area + cross).alias("area"), (at.x + (ax + bx) * cross).alias("x"), (at.y + (ay + by) * cross).alias("y"), (at.sx + ax).alias("sx"), (at.sy + ay).alias("sy"))

    total = F.aggregate(pairs, zero, step)
    area = F.abs(total.area) > 0
    x = F.when(area, total.x / F.nullif(3 * total.area, F.lit(0.0))).otherwise(total.sx / if_closed)
    y = F.when(area, total.y / F.nullif(3 * total.area, F.lit(0.0))).otherwise(total.sy / if_closed)
    return F.when(n > 0, F.struct((x + ring[0].x).alias("x"), (y + ring[0].y).alias("y")))


def at_zooms(features: DataFrame, max_zoom: int, from_zoom: int = 0) -> DataFrame:
    """One row for each zoom level that shows a feature. Details stay hidden below their level, and so don't keep lines apart when merged."""
    low = F.greatest(F.col("min_zoom"), F.lit(from_zoom))
    rows = features.where(low <= max_zoom).withColumn("z", F.explode(F.sequence(low, F.lit(max_zoom))))
    shown = {c: F.when((F.col("kind") != "line") | (F.col("z") >= DETAIL_ZOOM), F.col(c)) for c in DETAILS if c in features.columns}
    return rows.withColumns(shown)


def in_tiles(features: DataFrame, max_zoom: int, from_zoom: int = 0, beyond: bool = False) -> DataFrame:
    """Features with geom (array of lon x, lat y) at each zoom level in every tile that one of their legs may meet, buffer included.

    Adds z, x, y, and geom in pixels from the tile's corner. The boxes of single legs are looked at, so a long way across the map is
    not in all tiles of its own box. A feature without points is in no tile. What lies north or south of the map is drawn along its edge; if beyond,
    it stays where it is, and rows of tiles are counted on past the map: y is negative north of it."""
    placed = features.where(F.size("geom") > 0).withColumn("geom", F.transform("geom", lambda p: world_xy(p.x, p.y, beyond)))
    rows = at_zooms(placed, max_zoom, from_zoom)
    side = F.pow(F.lit(2.0), F.col("z"))
    margin = F.coalesce(F.col("buffer_px"), F.lit(0.0)) / TILE_PX if "buffer_px" in features.columns else F.lit(0.0)
    none = F.expr("cast(array() as array<bigint>)")

    def bounds(a: Column, b: Column, c: str) -> tuple[Column, Column]:
        first, last = F.floor(F.least(a, b) * side - margin).cast("bigint"), F.floor(F.greatest(a, b) * side + margin).cast("bigint")
        return (first, last) if beyond and c == "y" else (F.greatest(first, F.lit(0).cast("bigint")), F.least(last, side.cast("bigint") - 1))

    def span(a: Column, b: Column, c: str) -> Column:
        first, last = bounds(a, b, c)
        return F.when(first <= last, F.sequence(first, last)).otherwise(none)

    def met(i: Column) -> Column:
        a, b = F.col("geom")[i], F.col("geom")[F.least(i + 1, F.size("geom") - 1)]
        return F.flatten(F.transform(span(a.x, b.x, "x"), lambda x: F.transform(span(a.y, b.y, "y"), lambda y: F.struct(x.alias("x"), y.alias("y")))))

    legs = F.sequence(F.lit(0), F.greatest(F.size("geom") - 2, F.lit(0)))
    # most features are in one tile, or have one leg: then nothing is tried leg by leg
    a, b = F.col("geom")[0], F.element_at("geom", -1)
    ends = {}
    for c in "xy":
        ends |= dict(zip((f"_{c}0", f"_{c}1"), bounds(a[c], b[c], c)))
    one = F.array(F.struct(F.col("_x0").alias("x"), F.col("_y0").alias("y")))
    some = F.flatten(F.transform(F.sequence("_x0", "_x1"), lambda x: F.transform(F.sequence("_y0", "_y1"), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    short = F.when((F.col("_x0") > F.col("_x1")) | (F.col("_y0") > F.col("_y1")), F.filter(one, lambda t: F.lit(False))).when((F.col("_x0") == F.col("_x1")) & (F.col("_y0") == F.col("_y1")), one).otherwise(some)
    tiles = F.when(F.size("geom") <= 2, short).otherwise(F.array_distinct(F.flatten(F.transform(legs, met))))
    rows = rows.withColumns(ends).withColumn("_t", F.explode(tiles)).withColumns({"x": F.col("_t.x"), "y": F.col("_t.y")}).drop("_t", *ends)
    # of a long way only the legs from the first to the last that the tile may meet
    inside = lambda a, b, at: (F.floor(F.least(a, b) * side - margin) <= F.col(at)) & (F.floor(F.greatest(a, b) * side + margin) >= F.col(at))
    here = F.filter(legs, lambda i: inside(F.col("geom")[i].x, F.col("geom")[i + 1].x, "x") & inside(F.col("geom")[i].y, F.col("geom")[i + 1].y, "y"))
    here = F.when(F.size("geom") > 2, here)
    rows = rows.withColumn("_h", here).withColumn("geom", F.when(F.size("_h") > 0, F.slice("geom", F.col("_h")[0] + 1, F.element_at("_h", -1) - F.col("_h")[0] + 2)).otherwise(F.col("geom"))).drop("_h")
    pixel = lambda p: F.struct(((p.x * side - F.col("x")) * TILE_PX).alias("x"), ((p.y * side - F.col("y")) * TILE_PX).alias("y"))
    pixels = F.when(F.size("geom") == 2, F.array(pixel(F.col("geom")[0]), pixel(F.col("geom")[1]))).otherwise(F.transform("geom", pixel))
    return rows.withColumn("geom", pixels)
