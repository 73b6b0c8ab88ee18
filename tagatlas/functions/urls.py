"""Names, request paths and view addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagatlas.functions.tags import clamped, leading_number

#: The paths that a tile service answers. The dot before an extension stands for any character.
NAME = r"[0-9a-zA-Z/!\-_.*'()]+"
TILE = rf"^/({NAME})/(\d+)/(\d+)/(\d+).([a-z]+)$"
TILESET = rf"^/({NAME}).json$"

#: Lowest, highest and default of a view's zoom, longitude and latitude.
VIEW = {"zoom": (5.0, 20.0, 13.0), "lng": (-140.0, -115.0, -123.135), "lat": (47.0, 60.0, 49.272)}


def area_slug(area: Column) -> Column:
    """Runs of anything but letters become one underscore."""
    return F.regexp_replace(area, "[^a-zA-Z]+", "_")


def extract_source(area: Column) -> Column:
    """Where an area's extract comes from: the whole planet has a source of its own."""
    return F.when(F.lower(area) == "planet", F.lit("aws:latest")).otherwise(F.concat(F.lit("geofabrik:"), area))


def archive_path(name: Column, template: Column) -> Column:
    """The template with {name} filled in; without a template (NULL or empty), the name with the usual ending."""
    return F.when(F.coalesce(F.length(template), F.lit(0)) > 0, F.replace(template, F.lit("{name}"), name)).otherwise(F.concat(name, F.lit(".pmtiles")))


def request(path: Column) -> Column:
    """Struct ok, name, z, x, y, ext of a request path. A tile path is tried first; a tileset has no z, x and y."""
    part = lambda i: F.regexp_extract(path, TILE, i)
    tile, tileset = F.coalesce(path.rlike(TILE), F.lit(False)), F.coalesce(path.rlike(TILESET), F.lit(False))
    number = lambda i: F.when(tile, F.coalesce(part(i).try_cast("bigint"), F.lit(2**62)))
    return F.struct(
        (tile | tileset).alias("ok"),
        F.when(tile, part(1)).when(tileset, F.regexp_extract(path, TILESET, 1)).otherwise("").alias("name"),
        number(2).alias("z"), number(3).alias("x"), number(4).alias("y"),
        F.when(tile, part(5)).when(tileset, "json").otherwise("").alias("ext"),
    )


def view_state(url: Column) -> Column:
    """Struct zoom, lng, lat read from an address's query, kept within the map's limits."""
    return F.struct(*[clamped(leading_number(F.try_parse_url(url, F.lit("QUERY"), F.lit(k))), *limits).alias(k) for k, limits in VIEW.items()])


def view_query(zoom: Column, lng: Column, lat: Column) -> Column:
    """The query text that keeps a view: four decimals of zoom and ten of the place."""
    return F.format_string("zoom=%.4f&lng=%.10f&lat=%.10f", zoom, lng, lat)


def allowed_origin(origin: Column, allowed: Column) -> Column:
    """The last of the comma-separated allowed origins that is the request's or *; NULL if none is."""
    hits = F.filter(F.split(F.coalesce(allowed, F.lit("")), ","), lambda o: (o == origin) | (o == "*"))
    return F.try_element_at(hits, F.lit(-1))


def numbers(text: Column) -> Column:
    """Comma-separated numbers as an array of doubles; unreadable ones are NULL."""
    return F.transform(F.split(text, ","), lambda v: F.trim(v).try_cast("double"))


def tile_source(setting: Column, default: str) -> Column:
    """The address that a map draws from: the setting, or without one (NULL or empty) the default."""
    return F.coalesce(F.nullif(setting, F.lit("")), F.lit(default))


def reads_archives(addresses: Column) -> Column:
    """Whether any of the addresses is that of a tile archive."""
    return F.coalesce(F.exists(addresses, lambda a: F.startswith(a, F.lit("pmtiles://"))), F.lit(False))


def kept_query(target: Column, query: Column) -> Column:
    """A link's address with the current page's query, so that the view stays; a bare ? where that has none. NULL if the link has a query of its own, which isn't supported."""
    return F.when(~F.contains(target, F.lit("?")), F.concat(target, F.lit("?"), F.coalesce(query, F.lit(""))))
