"""The map build: from elements of an extract to the tiles of an archive."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagatlas.functions import vector_tile
from tagatlas.functions.tags import equals, tag
from tagatlas.functions.tiles import tile_id
from tagatlas.operators import areas, features, geometry, merge, routes
from tagatlas.operators.comfort import ATTRIBUTES

#: What lines of a tile must share to be drawn as one.
LOOK = [*ATTRIBUTES, *features.DETAILS]
POINT_ATTRIBUTES = ["amenity", "name", "osmNodeId", "osmWayId"]


def split_elements(elements: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, ways and relations of an extract as read by sources.osm_pbf."""
    of = lambda kind: elements.where(F.col("feature_type") == kind)
    nodes = of("node").select(F.col("osm_id").alias("node_id"), "lon", "lat", "tags")
    return nodes, of("way").select(F.col("osm_id").alias("way_id"), "nodes", "tags"), of("relation").select(F.col("osm_id").alias("relation_id"), "members", "tags")


def map_features(nodes: DataFrame, ways: DataFrame, relations: DataFrame, layer: str = "cycling") -> DataFrame:
    """Features of the layer: classified lines with their routes, and bicycle parking at points and areas (closed ways, and relations that are areas)."""
    shaped = geometry.capabilities(geometry.with_geometry(ways, nodes))
    lines = features.lines(routes.with_routes(shaped, relations), layer)
    point = F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")))
    points = nodes.select(F.lit("node").alias("feature_type"), F.col("node_id").alias("osm_id"), "tags", point.alias("geom"), F.lit(True).alias("is_point"), F.lit(False).alias("can_be_line"), F.lit(False).alias("can_be_polygon"))
    areas = shaped.select(F.lit("way").alias("feature_type"), F.col("way_id").alias("osm_id"), "tags", "geom", "is_point", "can_be_line", "can_be_polygon")
    # relations that are areas: only those that will be features, and only the ways that these have, are given shapes
    wanted = relations.where(equals(tag("amenity"), features.PARKING))
    outlines = wanted.select(F.explode("members").alias("m")).where("m.type = 'way'").select(F.col("m.ref").alias("way_id"))
    wholes = geometry.relation_areas(wanted, geometry.with_geometry(ways.join(outlines, "way_id", "left_semi"), nodes))
    areas = areas.unionByName(wholes.select(F.lit("relation").alias("feature_type"), "osm_id", "tags", "geom", F.lit(False).alias("is_point"), F.lit(False).alias("can_be_line"), F.lit(True).alias("can_be_polygon")))
    return features.all_features(lines, features.parking_points(points, layer), features.parking_centroids(areas, layer))


def tiles(mapped: DataFrame, max_zoom: int = 14, fills: DataFrame | None = None) -> DataFrame:
    """Rows tile_id, z, x, y, data: vector tiles of map features, ordered by nothing yet.

    fills are areas that are drawn as such: layer, osm_id, min_zoom, rings (lon and lat, as operators.areas makes them) and attributes.

    The rows of one tile meet in one task, since a tile is one blob; lines have been merged and simplified before."""
    lines = merge.merged(mapped.where("kind = 'line'"), LOOK, max_zoom).withColumn("feature", _feature(vector_tile.LINE, LOOK, None))
    points = features.in_tiles(mapped.where("kind not in ('line', 'polygon')"), max_zoom).withColumn("feature", _feature(vector_tile.POINT, POINT_ATTRIBUTES, "osm_id"))
    rows = lines.select(*merge.TILE, "feature").unionByName(points.select(*merge.TILE, "feature"))
    if fills is not None:
        shapes = areas.in_tiles(fills, max_zoom).where(F.col("z") >= F.col("min_zoom"))
        given = [c for c in fills.columns if c not in ("layer", "osm_id", "min_zoom", "rings")]
        rows = rows.unionByName(shapes.withColumn("feature", _fill(given)).select(*merge.TILE, "feature"))

    @F.pandas_udf("binary")
    def encoded(layers: pd.Series, groups: pd.Series) -> pd.Series:
        return pd.Series([vector_tile.layer(name, (_unpacked(f) for f in sorted(group, key=repr))) for name, group in zip(layers, groups)])

    layers = rows.groupBy(*merge.TILE).agg(F.collect_list("feature").alias("_f")).withColumn("data", encoded("layer", "_f"))
    # layers of one tile follow each other in its message
    whole = layers.groupBy("z", "x", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("layer", "data"))), lambda p: p.data).alias("_d"))
    return whole.select(tile_id(F.col("z"), F.col("x"), F.col("y")).alias("tile_id"), "z", "x", "y", F.aggregate("_d", F.lit(b""), lambda a, d: F.concat(a, d)).alias("data"))


def _feature(kind: int, attributes: list[str], osm_id: str | None):
    given = F.to_json(F.struct(*attributes))
    flat = F.flatten(F.transform("geom", lambda p: F.array(p.x, p.y)))
    return F.struct(F.lit(kind).alias("kind"), (F.col(osm_id) if osm_id else F.lit(None)).cast("bigint").alias("id"), given.alias("attributes"), flat.alias("points"), F.lit(None).cast("array<int>").alias("sizes"))


def _fill(attributes: list[str]):
    """A polygon as a feature: its rings' points one after the other, and how many points each has."""
    sizes = F.transform("rings", lambda r: (F.size(r) / 2).cast("int"))
    return F.struct(F.lit(vector_tile.POLYGON).alias("kind"), F.col("osm_id").cast("bigint").alias("id"), F.to_json(F.struct(*attributes)).alias("attributes"), F.flatten("rings").alias("points"), sizes.alias("sizes"))


def _unpacked(f: dict) -> tuple:
    import json

    flat = list(f["points"])
    places: list = list(zip(flat[::2], flat[1::2]))
    if f["sizes"] is not None:
        ends = list(itertools.accumulate(int(n) for n in f["sizes"]))
        places = [places[a:b] for a, b in zip([0, *ends], ends)]
    return f["kind"], None if f["id"] is None or pd.isna(f["id"]) else int(f["id"]), json.loads(f["attributes"]), places


def write_archive(built: DataFrame, folder: str, parts: int | None = None, **options: object) -> None:
    """Writes tiles as archives of ascending ranges of ids, one for each part; sources.tile_archive must be registered.

    Without a number, parts are as many as a shuffle has, less where Spark finds them small."""
    rows = built.select("tile_id", "data")
    ordered = (rows.repartitionByRange("tile_id") if parts is None else rows.repartitionByRange(parts, "tile_id")).sortWithinPartitions("tile_id")
    ordered.write.format("tile_archive").options(**options).mode("append").save(folder)
