"""What a tile service would answer: requests joined with archive headers and tile directories, as one table of outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagatlas.functions.tiles import tile_id
from tagatlas.functions.urls import request
from tagatlas.operators.directory import range_lookup

#: Tile types by their number in a header, as (extension of tile addresses, content type); and seconds that answers may be kept.
TILE_TYPES = {1: ("mvt", "application/x-protobuf"), 2: ("png", "image/png"), 3: ("jpg", "image/jpeg"), 4: ("webp", "image/webp"), 5: ("avif", None)}
MAX_AGE = 86_400


def tile_extension(tile_type: Column) -> Column:
    return _by_type(tile_type, 0)


def content_type(tile_type: Column) -> Column:
    return _by_type(tile_type, 1)


def _by_type(tile_type: Column, part: int) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for number, parts in TILE_TYPES.items():
        out = out.when(tile_type == number, F.lit(parts[part]))
    return out


def answers(requests: DataFrame, archives: DataFrame, entries: DataFrame, max_age: int = MAX_AGE) -> DataFrame:
    """Adds status, content_type, cache_control, body_offset and body_length to requests (method, path).

    Archives: (archive, tile_type, min_zoom, max_zoom, tilejson). Entries: flattened directories. In this order: posted requests are
    not allowed (405); paths that name neither a tile nor a tileset, and archives that don't exist, are not found (404); a tileset is
    its description; tiles outside the archive's zoom levels are not found; an extension that is not the archive's is wrong (400),
    but pbf names vector tiles too, and an archive of unknown type takes any; a tile without data is empty (204)."""
    asked = requests.withColumn("_r", request(F.col("path")))
    asked = asked.withColumns({"archive": F.col("_r.name"), "tile_id": tile_id(F.col("_r.z"), F.col("_r.x"), F.col("_r.y"), strict=False)})
    known = archives.select("archive", "tile_type", "min_zoom", "max_zoom", "tilejson")
    # archives are few, and small beside the requests; Spark broadcasts them where their size allows
    rows = range_lookup(asked.join(known, "archive", "left"), entries)
    z, ext = F.col("_r.z"), F.col("_r.ext")
    fits = (ext == tile_extension(F.col("tile_type"))) | ((ext == "pbf") & (F.col("tile_type") == 1)) | ~F.coalesce(F.col("tile_type").isin(*TILE_TYPES), F.lit(False))
    status = (
        F.when(F.upper("method").eqNullSafe(F.lit("POST")), 405).when(~F.col("_r.ok"), 404).when(F.col("tile_type").isNull(), 404).when(z.isNull(), 200)
        .when(~z.between(F.col("min_zoom"), F.col("max_zoom")), 404).when(~F.coalesce(fits, F.lit(False)), 400).when(F.col("entry_id").isNotNull(), 200).otherwise(204)
    )
    rows = rows.withColumn("status", status)
    tile = (F.col("status") == 200) & z.isNotNull()
    tileset = (F.col("status") == 200) & z.isNull()
    return rows.select(
        *requests.columns, "archive", z.alias("z"), F.col("_r.x").alias("x"), F.col("_r.y").alias("y"), ext.alias("ext"), "status",
        F.when(tileset, "application/json").when(tile, content_type(F.col("tile_type"))).alias("content_type"),
        F.when((F.col("status") != 405) & F.col("_r.ok"), F.lit(f"max-age={max_age}")).alias("cache_control"),
        F.when(tile, F.col("offset")).alias("body_offset"), F.when(tile, F.col("length")).alias("body_length"), F.when(tileset, F.col("tilejson")).alias("body_text"),
    )


def tilejson(archives: DataFrame, hostname: str) -> DataFrame:
    """Adds tilejson, the description of each archive: fields of (archive, tile_type, min_zoom, max_zoom, min_lon .. max_lat, center_*, name, description, attribution, version).

    Fields without a value are left out."""
    ending = F.coalesce(F.concat(F.lit("."), tile_extension(F.col("tile_type"))), F.lit(""))
    tiles = F.array(F.concat(F.lit(f"https://{hostname}/"), F.col("archive"), F.lit("/{z}/{x}/{y}"), ending))
    doc = F.struct(
        F.lit("3.0.0").alias("tilejson"), F.lit("xyz").alias("scheme"), tiles.alias("tiles"), "attribution", "description", "name", "version",
        F.array("min_lon", "min_lat", "max_lon", "max_lat").alias("bounds"), F.array("center_lon", "center_lat", F.col("center_zoom").cast("double")).alias("center"),
        F.col("min_zoom").alias("minzoom"), F.col("max_zoom").alias("maxzoom"),
    )
    return archives.withColumn("tilejson", F.to_json(doc))


def size_estimates(input_bytes: Column) -> Column:
    """Struct of planned bytes for an input: intermediate 200 per 60, output 100 per 60, memory 20 per 67."""
    whole = lambda num, den: F.call_function("div", input_bytes * num, F.lit(den).cast("bigint"))
    return F.struct(whole(200, 60).alias("intermediate_bytes"), whole(100, 60).alias("output_bytes"), whole(20, 67).alias("memory_bytes"))
