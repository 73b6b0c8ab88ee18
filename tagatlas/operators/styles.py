"""Style layers: filters and zoom ranges as data, compiled to columns, and applied to all layers in one pass over the features."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegralType, NumericType, StringType

from tagatlas.functions.zoom import interpolated, interpolated_color, stepped

#: The geometry type that a filter calls $type, by kind of feature.
GEOMETRY = {"line": "LineString", "point": "Point", "centroid": "Point", "polygon": "Polygon"}

_LINE, _AREA, _POINT = (["==", "$type", t] for t in ("LineString", "Polygon", "Point"))
_BUILT = ["!=", "construction", True]
_ONE_WAY = ["any", ["==", "oneway", 1], ["==", "oneway", -1]]
_RAIL, _TRANSIT = ["==", "class", "rail"], [_LINE, ["==", "class", "transit"], ["!in", "brunnel", "tunnel"]]
_MOTORWAY, _MAJOR = ["==", "class", "motorway"], [_LINE, ["in", "class", "primary", "secondary", "tertiary", "trunk"]]
_OPEN_MOTORWAY = [_LINE, ["!in", "brunnel", "bridge", "tunnel"], _MOTORWAY]

#: The style layers in drawing order, as (id, source layer, least zoom, zoom to stop before, conditions that must all hold).
CYCLING = [
    ("cycling_path_construction", "cycling", None, None, [_LINE, ["==", "construction", True]]),
    ("cycling_path_4", "cycling", None, None, [_LINE, ["==", "comfort", 4], _BUILT]),
    ("cycling_path_3", "cycling", None, None, [_LINE, ["==", "comfort", 3], _BUILT]),
    ("cycling_path_3_inner", "cycling", 13, None, [_LINE, ["==", "comfort", 3], _BUILT]),
    ("cycling_path_2", "cycling", None, None, [_LINE, ["==", "comfort", 2], _BUILT]),
    ("cycling_path_1", "cycling", 8, None, [_LINE, ["==", "comfort", 1], _BUILT]),
    ("cycling_path_oneway_arrows_white", "cycling", 8, None, [_LINE, _ONE_WAY, [">=", "comfort", 3], _BUILT]),
    ("cycling_path_oneway_arrows_green", "cycling", 8, None, [_LINE, _ONE_WAY, ["<=", "comfort", 2], _BUILT]),
    ("cycling_path_name", "cycling", None, None, [_LINE, ["any", ["==", "class", "track"], ["==", "class", "lane"]], ["has", "name"], [">=", "comfort", 2]]),
    ("bike_parking_point", "cycling", None, None, [_POINT, ["==", "amenity", "bicycle_parking"]]),
]
WALKING = [
    ("walking_path", "transportation", None, None, [_LINE, ["==", "class", "path"], ["!=", "subclass", "cycleway"]]),
    ("walking_path_name", "transportation_name", None, None, [_LINE, ["!=", "class", "motorway"], ["==", "subclass", "path"]]),
]
BASEMAP = [
    ("background", None, None, None, []),
    ("landcover_wood", "landcover", 10, None, [_AREA, ["==", "class", "wood"]]),
    ("park", "park", None, None, [_AREA]),
    ("water", "water", None, None, [_AREA, ["!=", "brunnel", "tunnel"]]),
    ("waterway", "waterway", None, None, [_LINE]),
    ("water_name", "water_name", None, None, [_LINE]),
    ("tunnel_motorway_casing", "transportation", 6, None, [_LINE, ["==", "brunnel", "tunnel"], _MOTORWAY]),
    ("tunnel_motorway_inner", "transportation", 6, None, [_LINE, ["==", "brunnel", "tunnel"], _MOTORWAY]),
    ("aeroway-taxiway", "aeroway", 12, None, [["in", "class", "taxiway"]]),
    ("aeroway-runway-casing", "aeroway", 11, None, [["in", "class", "runway"]]),
    ("aeroway-area", "aeroway", 4, None, [_AREA, ["in", "class", "runway", "taxiway"]]),
    ("aeroway-runway", "aeroway", 11, None, [["in", "class", "runway"], _LINE]),
    ("road_area_pier", "transportation", None, None, [_AREA, ["==", "class", "pier"]]),
    ("road_pier", "transportation", None, None, [_LINE, ["in", "class", "pier"]]),
    ("highway_path", "transportation", None, None, [_LINE, ["==", "class", "path"]]),
    ("highway_minor", "transportation", 8, None, [_LINE, ["in", "class", "minor", "service", "track"]]),
    ("highway_major_casing", "transportation", 11, None, _MAJOR),
    ("highway_major_inner", "transportation", 11, None, _MAJOR),
    ("highway_major_subtle", "transportation", None, 11, _MAJOR),
    ("highway_motorway_casing", "transportation", 6, None, _OPEN_MOTORWAY),
    ("highway_motorway_inner", "transportation", 6, None, _OPEN_MOTORWAY),
    ("highway_motorway_subtle", "transportation", None, 6, [_LINE, _MOTORWAY]),
    ("railway_transit", "transportation", 16, None, _TRANSIT),
    ("railway_transit_dashline", "transportation", 16, None, _TRANSIT),
    ("railway_service", "transportation", 16, None, [_LINE, _RAIL, ["has", "service"]]),
    ("railway_service_dashline", "transportation", 16, None, [_LINE, _RAIL, ["has", "service"]]),
    ("railway", "transportation", 13, None, [_LINE, ["!has", "service"], _RAIL]),
    ("railway_dashline", "transportation", 13, None, [_LINE, ["!has", "service"], _RAIL]),
    ("highway_motorway_bridge_casing", "transportation", 6, None, [_LINE, ["==", "brunnel", "bridge"], _MOTORWAY]),
    ("highway_motorway_bridge_inner", "transportation", 6, None, [_LINE, ["==", "brunnel", "bridge"], _MOTORWAY]),
    ("highway_name_other", "transportation_name", None, None, [["!=", "class", "motorway"], _LINE, ["!=", "subclass", "cycleway"]]),
    ("highway_name_motorway", "transportation_name", None, None, [_LINE, _MOTORWAY]),
    ("boundary_state", "boundary", None, None, [["==", "admin_level", 4]]),
    ("boundary_country_z0-4", "boundary", None, 5, [["==", "admin_level", 2], ["!has", "claimed_by"]]),
    ("boundary_country_z5-", "boundary", 5, None, [["==", "admin_level", 2]]),
    ("place_other", "place", None, 14, [["in", "class", "continent", "hamlet", "neighbourhood", "isolated_dwelling"], _POINT]),
    ("place_suburb", "place", None, 15, [_POINT, ["==", "class", "suburb"]]),
    ("place_village", "place", None, 14, [_POINT, ["==", "class", "village"]]),
    ("place_town", "place", None, 15, [_POINT, ["==", "class", "town"]]),
    ("place_city", "place", None, 14, [_POINT, ["!=", "capital", 2], ["==", "class", "city"], [">", "rank", 3]]),
    ("place_capital", "place", None, 12, [_POINT, ["==", "capital", 2], ["==", "class", "city"]]),
    ("place_city_large", "place", None, 12, [_POINT, ["!=", "capital", 2], ["<=", "rank", 3], ["==", "class", "city"]]),
    ("place_state", "place", None, 12, [_POINT, ["==", "class", "state"]]),
    ("place_country_other", "place", None, 8, [_POINT, ["==", "class", "country"], ["!has", "iso_a2"]]),
    ("place_country_minor", "place", None, 8, [_POINT, ["==", "class", "country"], [">=", "rank", 2], ["has", "iso_a2"]]),
]
#: The cycling layers a pointer can meet, below which zoom it meets none, and the line widths by zoom.
CLICKABLE, CLICK_ZOOM = ("cycling_path_1", "cycling_path_2", "cycling_path_3", "cycling_path_4", "cycling_path_construction", "bike_parking_point"), 13
WIDTHS = {
    "cycling_path_construction": [(10, 3), (16, 4)], "cycling_path_4": [(10, 2), (16, 8)], "cycling_path_3": [(10, 2), (16, 7)],
    "cycling_path_3_inner": [(0, 2)], "cycling_path_2": [(10, 3), (16, 6)], "cycling_path_1": [(10, 2), (16, 4)],
}
ARROW_OPACITY = [(1, 0.0), (14, 0.0), (15, 0.9)]
#: What the cycling layers are painted with. Numbers by zoom are stops (level, value); a marked colour gives way to a selected feature's.
PAINT = {
    "cycling_path_construction": {"color": "rgba(226, 109, 35, 1)", "marked": True, "width": WIDTHS["cycling_path_construction"], "dash": [(0, "0.4,1")], "cap": "butt", "join": "bevel"},
    "cycling_path_4": {"color": "rgba(26, 109, 35, 1)", "marked": True, "width": WIDTHS["cycling_path_4"], "cap": "round", "join": "round"},
    "cycling_path_3": {"color": "rgba(26, 109, 35, 1)", "marked": True, "width": WIDTHS["cycling_path_3"], "cap": "round", "join": "round"},
    "cycling_path_3_inner": {"color": "rgba(255, 255, 255, 0.6)", "width": WIDTHS["cycling_path_3_inner"], "dash": [(0, "2,4")], "cap": "round", "join": "round"},
    "cycling_path_2": {"color": "rgba(26, 109, 35, 1)", "marked": True, "width": WIDTHS["cycling_path_2"], "dash": [(0, "1"), (12, "0.4,1.4")], "cap": "round", "join": "round"},
    "cycling_path_1": {"color": "rgba(26, 50, 35, 1)", "marked": True, "width": WIDTHS["cycling_path_1"], "dash": [(0, "0.3,2")], "cap": "round", "join": "round"},
    "cycling_path_oneway_arrows_white": {"icon": "chevron-white", "placement": "line", "spacing": [(0, 40)], "size": [(0, 0.6)], "opacity": ARROW_OPACITY, "rotate": 90},
    "cycling_path_oneway_arrows_green": {"icon": "chevron-green", "placement": "line", "spacing": [(0, 40)], "size": [(0, 0.8)], "opacity": ARROW_OPACITY, "rotate": "oneway"},
    "cycling_path_name": {"color": "rgba(24, 79, 19, 1)", "label": "{name}", "upper": True, "size": [(0, 10)], "font": "Metropolis Regular", "placement": "line", "spacing": [(0, 350)], "max_angle": [(0, 30)], "pitch_alignment": "viewport", "rotation_alignment": "map", "offset": "0,1.1", "halo": "rgba(231, 231, 131, 0.72)", "halo_width": [(0, 2)], "blur": [(0, 1)]},
    "bike_parking_point": {"color": "rgba(231, 231, 131, 0.72)", "size": [(8, 1), (12, 1), (16, 3)], "stroke": "rgba(26, 109, 35, 1)", "width": [(8, 0.5), (12, 0.5), (16, 2)], "opacity": [(12, 0), (14, 0.5), (16, 0.8)]},
}
MARKED_COLOR = "rgba(200, 100, 100, 1)"

_ROUND, _BUTT = {"cap": "round", "join": "round"}, {"cap": "butt", "join": "miter"}
_TIES = {"join": "round", "color": "#fafafa", "dash": [(0, "3,3")]}
_NAME = {"upper": True, "size": [(0, 10)], "font": "Metropolis Regular", "color": "rgb(117, 129, 145)", "halo": "rgb(242,243,240)", "halo_width": [(0, 1)], "blur": [(0, 1)]}
_ALONG = {"placement": "line", "spacing": [(0, 350)], "pitch_alignment": "viewport"}
_PLACE = _NAME | {"label": "{name:latin}\n{name:nonlatin}"}
_CENTRED = _PLACE | {"anchor": "center", "justify": "center", "offset": "0.5,0"}
_BESIDE = _PLACE | {"justify": "left", "offset": "0.5,0.2", "icon_size": [(0, 0.4)], "icon_opacity": [(0, 0.7)]}
_DOTTED = _BESIDE | {"icon": [(0, "circle-11"), (8, "")], "anchor": [(0, "left"), (8, "center")]}
_COUNTRY = _NAME | {"label": "{name:latin}", "color": [(3, (157, 169, 177, 1)), (4, (153, 153, 153, 1))], "halo": "rgba(236,236,234,0.7)", "halo_width": [(0, 1.4)], "blur": [(0, 0)]}
_BORDER = _ROUND | {"color": "rgb(230, 204, 207)", "opacity": [(0, 1)]}
_COUNTRY_BORDER = _BORDER | {"blur": [(0, 0.4), (22, 4)], "width": [(3, 1), (22, 20)], "base": 1.1}
_MOTORWAY_CASING = _BUTT | {"color": "rgb(213, 213, 213)", "opacity": [(0, 1)], "width": [(5.8, 0), (6, 3), (20, 40)], "base": 1.4}
_MOTORWAY_INNER = _ROUND | {"color": [(5.8, (216.75, 216.75, 216.75, 0.53)), (6, (255, 255, 255, 1))], "width": [(4, 2), (6, 1.3), (20, 30)], "base": 1.4}
#: What the base map's and the walking layers are painted with, as PAINT. Widths grow by base where there is one; a colour by zoom is stops of (red, green, blue, opacity).
BASEMAP_PAINT = {
    "landcover_wood": {"color": "rgba(246, 248, 246, 1)", "opacity": [(10, 0), (12, 1)]},
    "park": {"color": "rgba(214, 219, 214, 1)"},
    "water": {"color": "rgba(203, 217, 243, 1)"},
    "waterway": {"color": "hsl(195, 17%, 78%)"},
    "water_name": {"label": "{name:latin}\n{name:nonlatin}", "placement": "line", "spacing": [(0, 500)], "font": "Metropolis Medium Italic", "rotation_alignment": "map", "size": [(0, 12)], "color": "rgb(157,169,177)", "halo": "rgb(242,243,240)", "halo_width": [(0, 1)], "blur": [(0, 1)]},
    "tunnel_motorway_casing": _MOTORWAY_CASING,
    "tunnel_motorway_inner": _MOTORWAY_INNER | {"color": "rgb(234,234,234)"},
    "aeroway-taxiway": _ROUND | {"color": "hsl(0, 0%, 88%)", "opacity": [(0, 1)], "width": [(13, 1.8), (20, 20)], "base": 1.55},
    "aeroway-runway-casing": _ROUND | {"color": "hsl(0, 0%, 88%)", "opacity": [(0, 1)], "width": [(11, 6), (17, 55)], "base": 1.5},
    "aeroway-area": {"color": "rgba(255, 255, 255, 1)", "opacity": [(13, 0), (14, 1)]},
    "aeroway-runway": _ROUND | {"color": "rgba(255, 255, 255, 1)", "opacity": [(0, 1)], "width": [(11, 4), (17, 50)], "base": 1.5},
    "road_area_pier": {"color": "rgb(242,243,240)"},
    "road_pier": _ROUND | {"color": "rgb(242,243,240)", "width": [(15, 1), (17, 4)], "base": 1.2},
    "highway_path": _ROUND | {"color": "rgb(234, 234, 234)", "opacity": [(0, 0.9)], "width": [(13, 1), (20, 10)]},
    "highway_minor": _ROUND | {"color": "hsl(0, 0%, 88%)", "opacity": [(0, 0.9)], "width": [(13, 1.8), (20, 20)], "base": 1.55},
    "highway_major_casing": _BUTT | {"color": "rgb(213, 213, 213)", "dash": [(0, "12,0")], "width": [(10, 3), (20, 23)], "base": 1.3},
    "highway_major_inner": _ROUND | {"color": "#fff", "width": [(10, 2), (20, 20)], "base": 1.3},
    "highway_major_subtle": _ROUND | {"color": "hsla(0, 0%, 85%, 0.69)", "width": [(0, 2)]},
    "highway_motorway_casing": _MOTORWAY_CASING | {"dash": [(0, "2,0")]},
    "highway_motorway_inner": _MOTORWAY_INNER,
    "highway_motorway_subtle": _ROUND | {"color": "hsla(0, 0%, 85%, 0.53)", "width": [(4, 2), (6, 1.3)], "base": 1.4},
    "railway_transit": {"join": "round", "color": "#dddddd", "width": [(0, 3)]},
    "railway_transit_dashline": _TIES | {"width": [(0, 2)]},
    "railway_service": {"join": "round", "color": "#dddddd", "width": [(0, 3)]},
    "railway_service_dashline": _TIES | {"width": [(0, 2)]},
    "railway": {"join": "round", "color": "#dddddd", "width": [(16, 3), (20, 7)], "base": 1.3},
    "railway_dashline": _TIES | {"width": [(16, 2), (20, 6)], "base": 1.3},
    "highway_motorway_bridge_casing": _MOTORWAY_CASING | {"dash": [(0, "2,0")], "width": [(5.8, 0), (6, 5), (20, 45)]},
    "highway_motorway_bridge_inner": _MOTORWAY_INNER,
    "highway_name_other": _NAME | _ALONG | {"label": "{name:latin} {name:nonlatin}", "max_angle": [(0, 30)], "rotation_alignment": "map", "color": "rgba(116, 108, 108, 1)", "halo": "rgba(255, 255, 255, 0.46)", "translate": "0,-10"},
    "highway_name_motorway": _NAME | _ALONG | {"label": "{ref}", "upper": False, "font": "Metropolis Light", "rotation_alignment": "viewport", "halo": "hsl(0, 0%, 100%)", "translate": "0,2"},
    "boundary_state": _BORDER | {"blur": [(0, 0.4)], "dash": [(0, "2,2")], "width": [(3, 1), (22, 15)], "base": 1.3},
    "boundary_country_z0-4": _COUNTRY_BORDER,
    "boundary_country_z5-": _COUNTRY_BORDER,
    "place_other": _CENTRED,
    "place_suburb": _CENTRED,
    "place_village": _BESIDE | {"anchor": "left"},
    "place_town": _DOTTED,
    "place_city": _DOTTED,
    "place_capital": _DOTTED | {"icon": [(0, "star-11"), (8, "")], "icon_size": [(0, 1)], "size": [(0, 14)]},
    "place_city_large": _DOTTED | {"size": [(0, 14)]},
    "place_state": _PLACE | {"color": "rgb(113, 129, 144)"},
    "place_country_other": _COUNTRY | {"font": "Metropolis Light Italic", "size": [(0, 9), (6, 11)]},
    "place_country_minor": _COUNTRY | {"size": [(0, 10), (6, 12)]},
    "walking_path": _ROUND | {"color": "rgb(238, 165, 80)", "width": [(13, 1), (20, 10)]},
    "walking_path_name": _NAME | _ALONG | {"label": "{name:latin} {name:nonlatin}", "max_angle": [(0, 30)], "rotation_alignment": "map", "color": "rgb(50, 50, 50)", "halo": "rgba(238, 165, 80, 0.5)", "halo_width": [(0, 2)], "translate": "0,-10"},
}
#: What painted() gives of a layer: values by zoom, and words, some of which change at a zoom.
PAINT_NUMBERS = ("width", "size", "opacity", "blur", "halo_width", "spacing", "max_angle", "icon_size", "icon_opacity")
PAINT_WORDS = ("dash", "cap", "join", "icon", "halo", "font", "anchor", "justify", "offset", "translate", "placement", "pitch_alignment", "rotation_alignment")


def condition(tree: list, features: DataFrame) -> Column:
    """A filter such as ["all", ["==", "class", "path"], ["!has", "service"]] as a column that is never NULL.

    != and !in hold where the attribute is missing, all other comparisons don't. A value of another type than the attribute equals
    nothing. $type is the geometry type."""
    op, args = tree[0], tree[1:]
    if op in ("all", "any", "none"):
        parts = [condition(a, features) for a in args]
        if op == "all":
            return reduce(lambda a, b: a & b, parts, F.lit(True))
        either = reduce(lambda a, b: a | b, parts, F.lit(False))
        return either if op == "any" else ~either
    value, kind = _attribute(args[0], features)
    if op in ("has", "!has"):
        return value.isNotNull() if op == "has" else value.isNull()
    wanted = [w for w in args[1:] if _comparable(w, kind)]
    if op in ("==", "in"):
        return reduce(lambda a, b: a | b, [value.eqNullSafe(F.lit(w)) for w in wanted], F.lit(False))
    if op in ("!=", "!in"):
        return ~reduce(lambda a, b: a | b, [value.eqNullSafe(F.lit(w)) for w in wanted], F.lit(False))
    ordered = {">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__, "<=": Column.__le__}
    if op not in ordered:
        raise ValueError(f"unknown filter {op}")
    return F.coalesce(ordered[op](value, F.lit(wanted[0])), F.lit(False)) if wanted else F.lit(False)


def _attribute(name: str, features: DataFrame) -> tuple[Column, object]:
    if name == "$type":
        return F.create_map(*[F.lit(v) for pair in GEOMETRY.items() for v in pair])[F.col("kind")], StringType()
    return (F.col(f"`{name}`"), features.schema[name].dataType) if name in features.columns else (F.lit(None).cast("string"), StringType())


def _comparable(value: object, kind: object) -> bool:
    if isinstance(value, bool):
        return isinstance(kind, BooleanType)
    return isinstance(kind, NumericType if isinstance(value, (int, float)) else StringType)


def shown(layer: tuple, features: DataFrame) -> Column:
    """Whether a style layer shows a feature (layer, kind, z and attributes) at its zoom level."""
    _, source, low, high, tests = layer
    out = condition(["all", *tests], features)
    out = out & F.coalesce(F.col("layer") == source, F.lit(False)) if source else F.lit(False)
    out = out & F.coalesce(F.col("z") >= low, F.lit(False)) if low is not None else out
    return out & F.coalesce(F.col("z") < high, F.lit(False)) if high is not None else out


def drawn(features: DataFrame, layers: list[tuple]) -> DataFrame:
    """Features once for each style layer that shows them, with style_layer and layer_ord (the place in drawing order).

    All layers are tested in one pass over the features. A layer without source, such as a background, shows no feature."""
    marks = [F.when(shown(layer, features), F.struct(F.lit(i).alias("layer_ord"), F.lit(layer[0]).alias("style_layer"))) for i, layer in enumerate(layers)]
    return features.withColumn("_m", F.explode(F.array_compact(F.array(*marks)))).select(*[c for c in features.columns if c not in ("layer_ord", "style_layer")], "_m.*")


def drawn_to(features: DataFrame, layers: list[tuple], max_zoom: int, details: tuple[str, ...] = (), detail_zoom: int = 0) -> DataFrame:
    """What drawn() gives for features at each level from min_zoom to max_zoom, where details are hidden below detail_zoom.

    Conditions don't depend on the level but for details, so each feature is tested once, or twice where a layer asks for a detail; what
    is made for each level is only what is drawn there. Details stay as they are."""
    bare = [c for c in details if c in features.columns]
    marks = []
    for i, (name, source, low, high, tests) in enumerate(layers):
        if source is None:
            continue
        first, last = F.greatest("min_zoom", F.lit(low or 0)), F.lit(min(max_zoom, high - 1) if high is not None else max_zoom)
        here = F.coalesce(F.col("layer") == source, F.lit(False))
        entry = lambda test, a, b: F.when(here & test & (a <= b), F.struct(F.lit(i).alias("layer_ord"), F.lit(name).alias("style_layer"), a.alias("_from"), b.alias("_to")))  # noqa: B023, E731
        own = condition(["all", *tests], features)
        if any(c in repr(tests) for c in bare):
            lines = F.col("kind") == "line"
            marks.append(entry(F.when(lines, _without(tests, features, bare)).otherwise(own), first, F.least(last, F.lit(detail_zoom - 1))))
            marks.append(entry(own, F.greatest(first, F.lit(detail_zoom)), last))
        else:
            marks.append(entry(own, first, last))
    rows = features.withColumn("_m", F.explode(F.array_compact(F.array(*marks))))
    rows = rows.select(*[c for c in features.columns if c not in ("layer_ord", "style_layer", "z")], "_m.*")
    return rows.withColumn("z", F.explode(F.sequence("_from", "_to"))).drop("_from", "_to")


def _without(tests: list, features: DataFrame, missing: list[str]) -> Column:
    """The tests where some attributes are missing."""
    return condition(["all", *tests], features.drop(*missing))


def _by_layer(keys: tuple[str, ...], make, layers: dict[str, dict], kind: str) -> Column:
    """One CASE over the layers that have the first key; layers that agree in all keys share a branch."""
    groups: dict[str, tuple[list[str], dict]] = {}
    for name, paint in layers.items():
        if keys[0] in paint:
            groups.setdefault(repr([paint.get(k) for k in keys]), ([], paint))[0].append(name)
    branches = [(F.col("style_layer").isin(*names), make(paint).cast(kind)) for names, paint in groups.values()]
    return reduce(lambda out, b: out.when(*b), branches[1:], F.when(*branches[0])) if branches else F.lit(None).cast(kind)


def painted(rows: DataFrame, layers: dict[str, dict] = PAINT) -> DataFrame:
    """Rows of drawn() with color, stroke, rotation, label, PAINT_NUMBERS and PAINT_WORDS; NULL where a layer has none.

    selected and hover, where rows have them, mark a feature. What depends on the layer and a whole level only is computed once for each of both, and joined as a
    small broadcast table; levels that aren't whole numbers are computed row by row."""
    marked = F.lit(False)
    for c in ("selected", "hover"):
        marked = marked | F.coalesce(F.col(c), F.lit(False)) if c in rows.columns else marked
    names = ("color", "stroke", *PAINT_NUMBERS, *PAINT_WORDS)
    if isinstance(rows.schema["z"].dataType, IntegralType):
        table, level = _paint_table(rows.sparkSession, layers)
        at = level(F.col("z"))
        out = rows.join(F.broadcast(table), (F.col("style_layer") == F.col("_layer")) & (at == F.col("_level")), "left")
        value = {c: F.col(f"_{c}") for c in names}
    else:
        out, value = rows, _at_level(F.col("z").cast("double"), layers)
    having = lambda test: F.col("style_layer").isin(*[name for name, p in layers.items() if test(p)])
    value["color"] = F.when(having(lambda p: "color" in p and p.get("marked")) & marked, F.lit(MARKED_COLOR)).otherwise(value["color"])
    value["stroke"] = F.when(having(lambda p: "stroke" in p) & marked, F.lit(MARKED_COLOR)).otherwise(value["stroke"])
    return out.withColumns({
        **value, "rotation": _by_layer(("rotate",), lambda p: arrow_rotation(F.col("oneway")) if p["rotate"] == "oneway" else F.lit(p["rotate"]), layers, "int"),
        "label": _by_layer(("label", "upper"), lambda p: label(p["label"], rows, p.get("upper", False)), layers, "string"),
    }).drop("_layer", "_level", *[f"_{c}" for c in names])


def _at_level(z: Column, layers: dict[str, dict]) -> dict[str, Column]:
    """What the layer and the level z (double) give."""
    color = lambda key: _by_layer((key,), lambda p: F.lit(p[key]) if isinstance(p[key], str) else interpolated_color(z, p[key]), layers, "string")
    number = lambda key: _by_layer((key, "base"), lambda p: interpolated(z, p[key], p.get("base", 1.0) if key == "width" else 1.0), layers, "double")
    word = lambda key: _by_layer((key,), lambda p: F.lit(p[key]) if isinstance(p[key], str) else stepped(z, p[key]), layers, "string")
    return {"color": color("color"), "stroke": color("stroke"), **{k: number(k) for k in PAINT_NUMBERS}, **{k: word(k) for k in PAINT_WORDS}}


def _paint_table(spark: SparkSession, layers: dict[str, dict]) -> tuple[DataFrame, Callable[[Column], Column]]:
    """_at_level for each layer (_layer) and whole level (_level), with names led by _; and the _level of a row's z.

    Beyond the first and the last stop nothing changes any more, so one level on either side stands for all others. A level below both stands for NULL."""
    stops = [stop[0] for paint in layers.values() for v in paint.values() if isinstance(v, list) for stop in v] or [0]
    low, high = math.floor(min(stops)) - 1, math.ceil(max(stops)) + 1
    rows = spark.range(low - 1, high + 1, 1, 1).select(F.col("id").cast("int").alias("_level"), F.explode(F.array(*[F.lit(name) for name in layers])).alias("style_layer"))
    values = _at_level(F.when(F.col("_level") >= low, F.col("_level").cast("double")), layers)
    table = rows.select(F.col("style_layer").alias("_layer"), "_level", *[c.alias(f"_{name}") for name, c in values.items()])
    return table, lambda z: F.when(z.isNull(), low - 1).otherwise(F.greatest(F.least(z, F.lit(high)), F.lit(low))).cast("int")


def top_hit(hits: DataFrame, click: str) -> DataFrame:
    """For each click the feature drawn last among those that can be met, at zoom 13 and above."""
    able = hits.where(F.col("style_layer").isin(*CLICKABLE) & (F.col("z") >= CLICK_ZOOM))
    return able.groupBy(click).agg(F.max_by(F.struct("style_layer", "feature_type", "osm_id"), F.struct("layer_ord", "osm_id")).alias("_t")).select(click, "_t.*")


def marked_color(color: Column, selected: Column, hover: Column) -> Column:
    """A feature's colour: the mark's where it is selected or under the pointer."""
    return F.when(F.coalesce(selected, F.lit(False)) | F.coalesce(hover, F.lit(False)), F.lit(MARKED_COLOR)).otherwise(color)


def arrow_rotation(oneway: Column) -> Column:
    return F.when(oneway.eqNullSafe(F.lit(1)), 90).otherwise(270)


def label(template: str, features: DataFrame, upper: bool = False) -> Column:
    """A label such as "{name:latin} {name:nonlatin}"; missing attributes leave nothing."""
    parts = []
    for i, piece in enumerate(template.replace("}", "{").split("{")):
        parts.append(F.lit(piece) if i % 2 == 0 else F.coalesce(_attribute(piece, features)[0].cast("string"), F.lit("")))
    return F.upper(F.concat(*parts)) if upper else F.concat(*parts)
