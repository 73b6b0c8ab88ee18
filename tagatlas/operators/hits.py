"""What is drawn under a place of the map: clicks and features meet in the cells of a grid.

A feature is in the cells that its drawn width may touch, leg by leg and column by column, so a long leg across the map isn't in all
cells of its box. A click is in one cell. So only what shares a cell is compared, by distance. Equal places are asked once, however many clicks they
have; a cell with very many different places is split by the engine's skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagatlas.functions.tiles import world_xy
from tagatlas.operators.features import TILE_PX

#: Pixels of a cell; and the level of the map whose tiles are the blocks of near().
CELL_PX, BLOCK_LEVEL = 64, 10
FEATURE = ("layer_ord", "style_layer", "feature_type", "osm_id")


def placed(rows: DataFrame, geom: str = "geom") -> DataFrame:
    """rows with geom, points of lon x and lat y, in pixels of their level z from the map's corner."""
    side = F.pow(F.lit(2.0), F.col("z")) * TILE_PX
    world = F.transform(geom, lambda p: world_xy(p.x, p.y))
    return rows.withColumn(geom, F.transform(world, lambda p: F.struct((p.x * side).alias("x"), (p.y * side).alias("y"))))


def near(rows: DataFrame, clicks: DataFrame, z: int, reach: float, geom: str = "geom") -> DataFrame:
    """rows with geom, points of lon x and lat y, without most of those that no click (lon, lat) can be near: for use before rows are made into what is drawn.

    reach is the greatest, in pixels at the lowest level z. A row goes if its box, reach included, lies in one block of the map and no click does; rows
    over several blocks stay. There are at most 4 ** BLOCK_LEVEL blocks, which are broadcast."""
    n = 1 << BLOCK_LEVEL
    margin = (reach + 1) / (TILE_PX << z)  # and a pixel, for what rounding does
    block = lambda v: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(v * n).cast("bigint")))
    at = clicks.where("lon is not null and lat is not null").select(world_xy(F.col("lon"), F.col("lat")).alias("_p"))
    asked = at.select((block(F.col("_p.x")) * n + block(F.col("_p.y"))).alias("_asked")).distinct()
    side = lambda c, of: of(F.transform(geom, lambda p: p[c]))
    corners = rows.withColumn("_a", world_xy(side("x", F.array_min), side("y", F.array_max))).withColumn("_z", world_xy(side("x", F.array_max), side("y", F.array_min)))
    first, last = ([block(F.col(f"{end}.{c}") + d) for c in "xy"] for end, d in (("_a", -margin), ("_z", margin)))
    number = ~F.isnan("_a.x") & ~F.isnan("_a.y") & ~F.isnan("_z.x") & ~F.isnan("_z.y")  # no number is in no block
    placed = corners.withColumn("_block", F.when(number & (first[0] == last[0]) & (first[1] == last[1]), first[0] * n + first[1]))
    met = placed.join(F.broadcast(asked), F.col("_block") == F.col("_asked"), "left").where("_asked is not null or _block is null")
    return met.select(*rows.columns)


def cells(drawn: DataFrame, cell_px: int = CELL_PX) -> DataFrame:
    """drawn (z, geom in pixels, reach in pixels, ...) once for each leg and cell that the leg, reach included, may touch: adds ax, ay, bx, by, cx, cy.

    A feature of one point is a leg of no length; one without points, or without reach, is nowhere."""
    legs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("geom") - 2, F.lit(0))), lambda i: F.struct(F.col("geom")[i].alias("a"), F.col("geom")[F.least(i + 1, F.size("geom") - 1)].alias("b")))
    rows = drawn.where("size(geom) > 0 and reach >= 0").withColumn("_leg", F.explode(legs))
    rows = rows.select(*drawn.columns, *[F.col(f"_leg.{p}.{c}").alias(f"{p}{c}") for p in "ab" for c in "xy"])
    ax, ay, bx, by, reach = (F.col(c) for c in ("ax", "ay", "bx", "by", "reach"))
    at = lambda v: F.floor(v / cell_px).cast("bigint")
    width = bx - ax

    def column(cx: Column) -> Column:
        # the part of the leg that may be within reach of the column, and how far up and down it goes
        low, high = F.greatest(F.least(ax, bx), cx * cell_px - reach), F.least(F.greatest(ax, bx), (cx + 1) * cell_px + reach)
        y = lambda x: ay + (x - ax) / F.nullif(width, F.lit(0.0)) * (by - ay)
        first, last = F.coalesce(y(low), ay), F.coalesce(y(high), by)
        return F.transform(F.sequence(at(F.least(first, last) - reach), at(F.greatest(first, last) + reach)), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))

    met = F.flatten(F.transform(F.sequence(at(F.least(ax, bx) - reach), at(F.greatest(ax, bx) + reach)), column))
    return rows.withColumn("_c", F.explode(met)).withColumns({"cx": F.col("_c.cx"), "cy": F.col("_c.cy")}).drop("_c")


def distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """From a point to the leg from a to b."""
    dx, dy = bx - ax, by - ay
    along = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)))), F.lit(0.0))
    return F.hypot(px - ax - along * dx, py - ay - along * dy)


def hits(clicks: DataFrame, drawn: DataFrame, click: str = "click", cell_px: int = CELL_PX) -> DataFrame:
    """(click, layer_ord, style_layer, feature_type, osm_id, distance) for every click (z, lon, lat) and drawn feature (FEATURE, z, geom in lon and lat, reach) that reaches it.

    distance, in pixels, is that of the nearest leg. A click or feature without a place, or at levels where the other isn't, hits nothing."""
    asked = placed(clicks.select(click, "z", F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))).alias("geom")).where("z is not null"))
    asked = asked.select(click, "z", F.col("geom")[0].x.alias("px"), F.col("geom")[0].y.alias("py")).where("px is not null and py is not null")
    at = asked.select("z", "px", "py").distinct().withColumns({c: F.floor(F.col(p) / cell_px).cast("bigint") for c, p in (("cx", "px"), ("cy", "py"))})
    legs = cells(placed(drawn.select(*FEATURE, "z", "geom", "reach")), cell_px).drop("geom")
    near = at.join(legs, ["z", "cx", "cy"]).withColumn("distance", distance(*(F.col(c) for c in ("px", "py", "ax", "ay", "bx", "by")))).where("distance <= reach")
    near = near.groupBy("z", "px", "py", *FEATURE).agg(F.min("distance").alias("distance"))
    return asked.join(near, ["z", "px", "py"]).select(click, *FEATURE, "distance")


def drawn_last(found: DataFrame, click: str = "click") -> DataFrame:
    """For each click the feature drawn over all others that it hits."""
    top = F.max_by(F.struct("style_layer", "feature_type", "osm_id", "distance"), F.struct("layer_ord", "osm_id"))
    return found.groupBy(click).agg(top.alias("_t")).select(click, "_t.*")
