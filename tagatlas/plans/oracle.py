"""The queries of the catalog in SQL, written apart from the operators, to compare their results with."""

from __future__ import annotations

from tagatlas.functions.urls import TILE, TILESET
from tagatlas.operators import styles
from tagatlas.operators.elements import PARKING_TYPES
from tagatlas.operators.merge import EQUATOR_M
from tagatlas.plans import views


def _columns(columns: dict[str, str]) -> str:
    return ", ".join(f'{sql} AS "{name}"' for name, sql in columns.items())


def _ways(source: str) -> str:
    return f"""ways AS (SELECT k AS way_id, {_columns(views.WAY_TAGS)} FROM (SELECT *, k % 16 AS a, CAST(floor(k / 16) AS BIGINT) AS m FROM ({source})))"""


WAYS = _ways("SELECT o_orderkey AS k, o_custkey AS c FROM orders")
RULES = """speeds AS (SELECT *, CASE WHEN maxspeed IS NULL THEN NULL WHEN regexp_full_match(maxspeed, '[+-]?[0-9]+') THEN TRY_CAST(maxspeed AS BIGINT) ELSE 0 END <= 30 AS slow,
  coalesce(oneway = 'yes', false) AS ow, coalesce("cycleway:left" = 'lane', false) AS ll, coalesce("cycleway:right" = 'lane', false) AS rl, coalesce(foot = 'designated', false) AS fd FROM ways),
branches AS (SELECT *, CASE
  WHEN highway = 'cycleway' THEN 1
  WHEN highway IN ('path', 'pedestrian') AND bicycle = 'designated' THEN 2
  WHEN highway IS NOT NULL AND cycleway = 'track' THEN 3
  WHEN highway = 'construction' AND construction = 'cycleway' THEN 4
  WHEN highway IS NOT NULL AND NOT ow AND (cycleway = 'lane' OR "cycleway:both" = 'lane' OR (ll AND rl)) THEN 5
  WHEN highway IS NOT NULL AND NOT ow AND ((rl AND "cycleway:right:oneway" = 'no') OR (ll AND "cycleway:left:oneway" = 'no')) THEN 6
  WHEN highway IS NOT NULL AND ow AND (cycleway = 'lane' OR rl OR ll) THEN 7
  WHEN (highway IS NOT NULL AND cycleway IN ('shared_lane', 'shared')) OR "cycleway:both" IN ('shared_lane', 'shared') THEN 8
  WHEN highway = 'residential' AND bicycle IN ('yes', 'designated') AND slow THEN 9
  WHEN highway IS NOT NULL AND ((rl AND "cycleway:left" = 'no') OR (ll AND "cycleway:right" = 'no')) THEN 10 END AS branch FROM speeds),
sides AS (SELECT *, CASE WHEN branch = 5 THEN 'both' WHEN branch = 6 THEN CASE WHEN rl THEN 'right' ELSE 'left' END WHEN branch IN (7, 10) THEN CASE WHEN ll THEN 'left' ELSE 'right' END END AS side,
  CASE WHEN branch = 1 THEN fd AND coalesce(segregated = 'no', false) WHEN branch = 2 THEN (fd OR highway = 'pedestrian') AND segregated IS DISTINCT FROM 'yes' WHEN branch IN (3, 4) THEN fd AND segregated IS DISTINCT FROM 'yes' WHEN branch = 9 THEN coalesce(foot = 'yes', false) ELSE false END AS swp
  FROM branches WHERE branch IS NOT NULL),
doors AS (SELECT *, coalesce(CASE WHEN side = 'left' THEN "parking:left" WHEN side = 'right' THEN "parking:right" END IN ('lane', 'street_side', 'separate'), false) AS beside,
  coalesce("parking:both" IN ('lane', 'street_side', 'separate'), false) AS both_sides FROM sides),
risks AS (SELECT *, CASE WHEN branch = 5 THEN both_sides OR coalesce(parking IN ('lane', 'street_side'), false) OR coalesce("parking:left" IN ('lane', 'street_side', 'separate'), false) OR coalesce("parking:right" IN ('lane', 'street_side', 'separate'), false) WHEN branch = 7 THEN beside WHEN branch = 10 THEN beside OR both_sides ELSE false END AS risk FROM doors),
lines AS (SELECT way_id AS osm_id, branch, swp AS shared_with_pedestrians, branch IN (8, 9) AS shared_with_vehicles,
  CASE WHEN branch <= 4 THEN CASE WHEN swp THEN 3 ELSE 4 END WHEN branch = 8 THEN CASE WHEN motor_vehicle = 'private' OR slow THEN 3 ELSE 1 END WHEN branch = 9 THEN 3 WHEN risk THEN 1 ELSE 2 END AS comfort,
  CASE WHEN branch <= 4 THEN CAST(ow AS INT) WHEN branch IN (5, 6) THEN 0 WHEN branch = 7 THEN CASE WHEN ll AND rl THEN 0 ELSE 1 END WHEN branch IN (8, 9) THEN CASE WHEN "oneway:bicycle" = 'no' THEN 0 ELSE CAST(ow AS INT) END ELSE CASE WHEN ll THEN -1 ELSE 1 END END AS oneway,
  CASE WHEN branch <= 4 THEN 'track' ELSE 'lane' END AS class, CASE WHEN branch IN (1, 4) THEN 'cycleway' WHEN branch = 2 THEN 'path' WHEN branch = 3 THEN concat('combined-', highway) END AS subclass, side,
  CASE WHEN branch = 4 THEN true END AS construction, CASE WHEN risk THEN true END AS dooring_risk, name, surface FROM risks)"""
LINES = f"{WAYS}, {RULES}"
RELATIONS = f"relations AS (SELECT p_partkey AS relation_id, {_columns(views.RELATION_TAGS)} FROM part), kept AS (SELECT relation_id FROM relations WHERE type = 'route' AND route = 'bicycle')"
ON_ROUTES = f"{RELATIONS}, pairs AS (SELECT DISTINCT l_orderkey AS way_id, l_partkey AS relation_id FROM lineitem JOIN kept ON l_partkey = relation_id WHERE l_linenumber <> 7), lists AS (SELECT way_id, string_agg(CAST(relation_id AS VARCHAR), ',' ORDER BY relation_id) AS routes FROM pairs GROUP BY way_id)"
ELEMENTS = f"elements AS (SELECT coalesce(event_type = 'signup', false) AS area, event_id AS osm_id, {_columns(views.EVENT_TAGS)} FROM events)"
TILES = f"tiles AS (SELECT event_id, user_id, {_columns(views.TILE14)} FROM events)"


def hilbert(z: str, x: str, y: str, source: str, key: str) -> str:
    """CTEs that end in ids(key, tile_id): the curve walked by recursion, one level a step."""
    return f"""walk AS (SELECT {key} AS key, {z} AS z, {z} - 1 AS bit, CAST({x} AS BIGINT) AS x, CAST({y} AS BIGINT) AS y, CAST(0 AS BIGINT) AS d FROM {source}
  UNION ALL SELECT key, z, bit - 1, CASE WHEN ry = 1 THEN mx WHEN rx = 1 THEN h - 1 - my ELSE my END, CASE WHEN ry = 1 THEN my WHEN rx = 1 THEN h - 1 - mx ELSE mx END, d * 4 + xor(3 * rx, ry)
  FROM (SELECT *, (1::BIGINT << bit) AS h, x % (1::BIGINT << bit) AS mx, y % (1::BIGINT << bit) AS my, (x >> bit) & 1 AS rx, (y >> bit) & 1 AS ry FROM walk WHERE bit >= 0)),
ids AS (SELECT key, d + CAST((power(4, z) - 1) / 3 AS BIGINT) AS tile_id FROM walk WHERE bit = -1)"""


PLACES = f"""{TILES}, low AS (SELECT DISTINCT x14 // 256 AS x, y14 // 256 AS y FROM tiles), {hilbert('6', 'x', 'y', 'low', 'x * 64 + y')},
places AS (SELECT 'cycling' AS archive, tile_id, (tile_id // 4) * 1000 AS "offset", 100 + (tile_id // 4) % 50 AS length FROM ids),
islands AS (SELECT *, tile_id - row_number() OVER (PARTITION BY "offset" ORDER BY tile_id) AS g FROM places),
entries AS (SELECT archive, min(tile_id) AS tile_id, count(*) AS run_length, "offset", length FROM islands GROUP BY archive, "offset", length, g)"""
LOOKUP = f"""WITH RECURSIVE {PLACES}, asked AS (SELECT event_id, 1365 + (event_id * 7919 + user_id) % 4096 AS tile_id FROM events)
SELECT a.event_id, a.tile_id, e.tile_id AS entry_id, e."offset" AS "offset", e.length FROM asked a LEFT JOIN entries e ON a.tile_id >= e.tile_id AND a.tile_id < e.tile_id + e.run_length"""

REQUESTS = f"""requests AS (SELECT page_id, {_columns(views.REQUESTS)} FROM pages),
parsed AS (SELECT *, regexp_matches(path, '{TILE.replace("'", "''")}') AS tile, regexp_matches(path, '{TILESET.replace("'", "''")}') AS tileset,
  regexp_extract(path, '{TILE.replace("'", "''")}', ['name', 'z', 'x', 'y', 'ext']) AS t, regexp_extract(path, '{TILESET.replace("'", "''")}', 1) AS set_name FROM requests),
asked AS (SELECT page_id, method, path, tile OR tileset AS ok, CASE WHEN tile THEN t.name WHEN tileset THEN set_name ELSE '' END AS archive, CASE WHEN tile THEN TRY_CAST(t.z AS BIGINT) END AS z, CASE WHEN tile THEN TRY_CAST(t.x AS BIGINT) END AS x,
  CASE WHEN tile THEN TRY_CAST(t.y AS BIGINT) END AS y, CASE WHEN tile THEN t.ext WHEN tileset THEN 'json' ELSE '' END AS ext FROM parsed)"""
ARCHIVES = "archives AS (SELECT * FROM (VALUES ('cycling', 1, 0, 14), ('base', 2, 2, 10)) AS v(archive, tile_type, min_zoom, max_zoom))"


def _sql_test(tree: list, types: dict[str, str]) -> str:
    op, args = tree[0], tree[1:]
    if op in ("all", "any"):
        return "(" + (" AND " if op == "all" else " OR ").join(_sql_test(a, types) for a in args) + ")" if args else "true"
    name = args[0]
    value = "CASE kind WHEN 'line' THEN 'LineString' WHEN 'polygon' THEN 'Polygon' ELSE 'Point' END" if name == "$type" else f'"{name}"' if name in types else "NULL"
    if op in ("has", "!has"):
        return f"({value} IS {'NOT ' if op == 'has' else ''}NULL)"
    spelled = [f"'{w}'" if isinstance(w, str) else str(w).lower() for w in args[1:]]
    if op in ("==", "in"):
        return f"coalesce({value} IN ({', '.join(spelled)}), false)"
    if op in ("!=", "!in"):
        return f"NOT coalesce({value} IN ({', '.join(spelled)}), false)"
    return f"coalesce({value} {op} {spelled[0]}, false)"


def style_sql(layers: list[tuple], source: str, key: str, columns: set[str], ctes: str) -> str:
    parts = []
    for i, (name, layer, low, high, tests) in enumerate(layers):
        if layer is None:
            continue
        where = [f"layer = '{layer}'", *[_sql_test(t, dict.fromkeys(columns, "")) for t in tests], *([f"z >= {low}"] if low is not None else []), *([f"z < {high}"] if high is not None else [])]
        parts.append(f"SELECT {key}, z, {i} AS layer_ord, '{name}' AS style_layer FROM {source} WHERE {' AND '.join(where)}")
    return f"WITH {ctes} " + " UNION ALL ".join(parts)


def _interpolate(stops: list[tuple[float, float]], base: float) -> str:
    out = f"CASE WHEN z <= {stops[0][0]} THEN CAST({stops[0][1]} AS DOUBLE)"
    for (z0, v0), (z1, v1) in zip(stops, stops[1:]):
        part = f"((z - {z0}) / CAST({z1 - z0} AS DOUBLE))" if base == 1 else f"((power({base}, z - {z0}) - 1) / (power({base}, {z1 - z0}) - 1))"
        out += f" WHEN z <= {z1} THEN {v0} + {part} * {v1 - v0}"
    return out + f" ELSE {stops[-1][1]} END"


ZOOMS = "zooms AS (SELECT n_nationkey AS k, CAST(unnest(range(0, 23)) AS INT) AS z FROM nation)"
DETAIL = "(SELECT l.*, r.routes, z FROM lines l LEFT JOIN lists r ON l.osm_id = r.way_id, (SELECT CAST(unnest(range(6, 15)) AS INT) AS z))"
GATED = f"gated AS (SELECT osm_id, z, branch, shared_with_pedestrians, shared_with_vehicles, comfort, oneway, class, subclass, side, construction, dooring_risk, CASE WHEN z >= 13 THEN name END AS name, CASE WHEN z >= 13 THEN surface END AS surface, CASE WHEN z >= 13 THEN routes END AS routes FROM {DETAIL})"
CAPACITY = r"""CASE WHEN trim(capacity) = '' THEN 0.0 WHEN trim(capacity) = '0x1F' THEN 31.0 ELSE TRY_CAST(trim(capacity) AS DOUBLE) END"""
PARKING = f"""{ELEMENTS}, parking AS (SELECT CASE WHEN area THEN 'way' ELSE 'node' END AS feature_type, osm_id, name, operator, fee, covered, bicycle_parking, capacity AS raw, "type" AS kind_tag, {CAPACITY} AS capacity_n, indoor,
  CASE WHEN bicycle_parking IN ({', '.join(f"'{p}'" for p in PARKING_TYPES)}) THEN bicycle_parking END AS kind FROM elements WHERE amenity = 'bicycle_parking' AND coalesce("type", 'bike_parking') = 'bike_parking')"""


def _yes(column: str) -> str:
    return f"CASE WHEN {column} = 'no' THEN false WHEN {column} <> '' THEN true END"


def _box(value: str) -> str:
    return f"CASE WHEN coalesce({value}, 0) <> 0 THEN regexp_replace(CAST({value} AS VARCHAR), '\\.0$', '') ELSE 'Unknown' END"


VIEW_DEFAULTS = {"zoom": 13.0, "lng": -123.135, "lat": 49.272}
ATTRIBUTES = "shared_with_pedestrians, shared_with_vehicles, comfort, oneway, class, subclass, side, construction, dooring_risk"

SQL = {
    "classify_ways": f"WITH {LINES} SELECT osm_id, branch, {ATTRIBUTES} FROM lines",
    "comfort_histogram": f"WITH {LINES} SELECT class, comfort, count(*) AS n_ways FROM lines GROUP BY class, comfort",
    "dooring_risk_ways": f"WITH {LINES} SELECT osm_id, branch, side, comfort FROM lines WHERE dooring_risk",
    "bike_route_filter": f"WITH {RELATIONS} SELECT relation_id FROM kept",
    "way_routes": f"WITH {WAYS}, {ON_ROUTES} SELECT w.way_id, routes FROM ways w LEFT JOIN lists l ON w.way_id = l.way_id",
    "parking_features": f"WITH {ELEMENTS} SELECT CASE WHEN area THEN 'centroid' ELSE 'point' END AS kind, osm_id, amenity, name, 12 AS min_zoom, CASE WHEN NOT area THEN osm_id END AS \"osmNodeId\", CASE WHEN area THEN osm_id END AS \"osmWayId\" FROM elements WHERE amenity = 'bicycle_parking'",
    "zoom_gated_attributes": f"WITH {LINES}, {ON_ROUTES}, {GATED} SELECT osm_id, z, comfort, name, surface, routes FROM gated",
    "oneway_merge_keys": f"WITH {LINES} SELECT osm_id, oneway, CASE WHEN oneway = 1 THEN osm_id END AS no_merge FROM lines",
    "merge_group_sizes": f"WITH {LINES}, {ON_ROUTES}, {GATED} SELECT z, {ATTRIBUTES}, name, surface, routes, CASE WHEN oneway = 1 THEN osm_id END AS no_merge, count(*) AS n_lines FROM gated GROUP BY ALL",
    "min_length_filter": "WITH rows AS (SELECT o_orderkey, CAST(3 + o_orderkey % 6 AS INT) AS z, CAST(o_custkey % 1200 AS DOUBLE) AS metres FROM orders) SELECT o_orderkey, z, metres FROM rows WHERE metres >= CASE z WHEN 4 THEN 1000 WHEN 5 THEN 500 WHEN 6 THEN 100 WHEN 7 THEN 50 ELSE 0 END",
    "style_cycling_layers": style_sql(styles.CYCLING, "shown", "kind, osm_id", {"comfort", "construction", "oneway", "class", "name", "amenity"},
        f"{LINES}, {ELEMENTS}, feats AS (SELECT 'line' AS kind, osm_id, comfort, construction, oneway, class, name, NULL AS amenity, 6 AS mz FROM lines UNION ALL SELECT CASE WHEN area THEN 'centroid' ELSE 'point' END, osm_id, NULL, NULL, NULL, NULL, name, amenity, 12 FROM elements WHERE amenity = 'bicycle_parking'), "
        "shown AS (SELECT 'cycling' AS layer, kind, osm_id, comfort, construction, oneway, class, CASE WHEN kind <> 'line' OR z >= 13 THEN name END AS name, amenity, z FROM feats, (SELECT CAST(unnest(range(6, 15)) AS INT) AS z) WHERE z >= mz)"),
    "style_walking_layers": style_sql(styles.WALKING, "base", "k", set(views.BASE), f"base AS (SELECT k, {_columns(views.BASE)} FROM (SELECT p_partkey AS k FROM part))"),
    "style_basemap_layers": style_sql(styles.BASEMAP, "base", "k", set(views.BASE), f"base AS (SELECT k, {_columns(views.BASE)} FROM (SELECT p_partkey AS k FROM part))"),
    "zoom_interpolate_linear": f"WITH {ZOOMS} SELECT k, z, round({_interpolate([(10, 2), (16, 8)], 1)}, 6) AS width, round({_interpolate([(1, 0.0), (14, 0.0), (15, 0.9)], 1)}, 6) AS opacity FROM zooms",
    "zoom_interpolate_exponential": f"WITH {ZOOMS} SELECT k, z, round({_interpolate([(4, 2), (6, 1.3), (20, 30)], 1.4)}, 6) AS width FROM zooms",
    "zoom_step": f"WITH {ZOOMS} SELECT k, z, CASE WHEN z >= 12 THEN 'dashed' ELSE 'solid' END AS dash FROM zooms",
    "tile_hilbert_id": f"WITH RECURSIVE {TILES}, {hilbert('14', 'x14', 'y14', 'tiles', 'event_id')} SELECT key AS event_id, tile_id FROM ids",
    "tile_zxy": f"WITH {TILES} SELECT event_id, 14 AS z, x14 AS x, y14 AS y FROM tiles",
    "lonlat_to_tile": "WITH places AS (SELECT event_id, -140.0 + (event_id % 2500) * 0.01 AS lon, 47.0 + (user_id % 1300) * 0.01 AS lat FROM events) SELECT event_id, CAST(floor((CAST(lon AS DOUBLE) + 180) / 360 * 4096) AS BIGINT) AS x, CAST(floor((1 - ln(tan(radians(CAST(lat AS DOUBLE))) + 1 / cos(radians(CAST(lat AS DOUBLE)))) / pi()) / 2 * 4096) AS BIGINT) AS y FROM places",
    "directory_run_encode": f"WITH RECURSIVE {PLACES} SELECT archive, tile_id, run_length, \"offset\", length FROM entries",
    "directory_encode": f"WITH RECURSIVE {PLACES}, d AS (SELECT tile_id // 64 AS directory, * FROM entries) SELECT directory, row_number() OVER w - 1 AS i, tile_id - coalesce(lag(tile_id) OVER w, 0) AS delta, run_length, length, CASE WHEN lag(\"offset\" + length) OVER w = \"offset\" THEN 0 ELSE \"offset\" + 1 END AS raw_offset FROM d WINDOW w AS (PARTITION BY directory ORDER BY tile_id)",
    "directory_decode": f"WITH RECURSIVE {PLACES} SELECT tile_id // 64 AS directory, row_number() OVER (PARTITION BY tile_id // 64 ORDER BY tile_id) - 1 AS i, tile_id, run_length, \"offset\", length FROM entries",
    "tile_range_lookup": LOOKUP,
    "tile_asof_lookup": LOOKUP.replace("SELECT a.event_id, a.tile_id, e.tile_id AS entry_id, e.\"offset\" AS \"offset\", e.length FROM asked a LEFT JOIN entries e ON a.tile_id >= e.tile_id AND a.tile_id < e.tile_id + e.run_length",
        "SELECT a.event_id, a.tile_id, CASE WHEN a.tile_id < e.tile_id + run_length THEN e.tile_id END AS entry_id, CASE WHEN a.tile_id < e.tile_id + run_length THEN e.\"offset\" END AS \"offset\", CASE WHEN a.tile_id < e.tile_id + run_length THEN e.length END AS length FROM asked a ASOF LEFT JOIN entries e ON a.tile_id >= e.tile_id"),
    "leaf_walk": f"WITH RECURSIVE {PLACES} SELECT archive, tile_id, run_length, \"offset\", length FROM entries",
    "legacy_directory_sort": f"WITH {TILES}, d AS (SELECT DISTINCT 14 AS z, x14 AS x, y14 AS y, x14 % 5 = 0 AS is_dir FROM tiles) SELECT row_number() OVER (ORDER BY is_dir, z, x, y) AS place, is_dir, z, x, y FROM d",
    "legacy_leaf_lookup": f"WITH {TILES} SELECT event_id, CASE WHEN x14 % 3 = 0 THEN x14 * 16384 + y14 END AS \"offset\", CASE WHEN x14 % 3 = 0 THEN 7 END AS length FROM tiles",
    "tile_path_parse": f"WITH {REQUESTS} SELECT page_id, ok, archive AS name, z, x, y, ext FROM asked",
    "service_status": f"""WITH RECURSIVE {PLACES}, {REQUESTS}, {ARCHIVES}, hits AS (SELECT a.*, tile_type, min_zoom, max_zoom FROM asked a LEFT JOIN archives USING (archive)),
{hilbert('z', 'x', 'y', '(SELECT * FROM hits WHERE z IS NOT NULL)', 'page_id').replace('walk', 'walk2').replace('ids AS', 'ids2 AS')},
found AS (SELECT h.*, e.tile_id AS entry_id, e."offset" AS o, e.length AS l FROM hits h LEFT JOIN ids2 i ON h.page_id = i.key LEFT JOIN entries e ON e.archive = h.archive AND i.tile_id >= e.tile_id AND i.tile_id < e.tile_id + e.run_length),
done AS (SELECT *, CASE WHEN method = 'POST' THEN 405 WHEN NOT ok OR tile_type IS NULL THEN 404 WHEN z IS NULL THEN 200 WHEN z NOT BETWEEN min_zoom AND max_zoom THEN 404 WHEN NOT (ext = CASE tile_type WHEN 1 THEN 'mvt' ELSE 'png' END OR (ext = 'pbf' AND tile_type = 1)) THEN 400 WHEN entry_id IS NOT NULL THEN 200 ELSE 204 END AS status FROM found)
SELECT page_id, archive, status, CASE WHEN status = 200 AND z IS NULL THEN 'application/json' WHEN status = 200 THEN CASE tile_type WHEN 1 THEN 'application/x-protobuf' ELSE 'image/png' END END AS content_type,
 CASE WHEN status <> 405 AND ok THEN 'max-age=86400' END AS cache_control, CASE WHEN status = 200 AND z IS NOT NULL THEN o END AS body_offset, CASE WHEN status = 200 AND z IS NOT NULL THEN l END AS body_length FROM done""",
    "tilejson_fields": """SELECT * FROM (VALUES ('cycling', '3.0.0', 'https://tiles.example.org/cycling/{z}/{x}/{y}.mvt', 0, 14, 'Cycling'), ('base', '3.0.0', 'https://tiles.example.org/base/{z}/{x}/{y}.png', 2, 10, NULL)) AS v(archive, tilejson, tiles, minzoom, maxzoom, name)""",
    "area_slug": "SELECT p_partkey, regexp_replace(p_name, '[^a-zA-Z]+', '_', 'g') AS slug, CASE WHEN lower(p_name) = 'planet' THEN 'aws:latest' ELSE concat('geofabrik:', p_name) END AS source FROM part",
    "parking_coerce": f"WITH {PARKING} SELECT feature_type, osm_id, kind AS \"bicycleParkingType\", name, operator, {_yes('indoor')} AS indoor, capacity_n AS capacity, {_yes('covered')} AS covered FROM parking",
    "other_tags_keys": f"""WITH {PARKING} SELECT feature_type, osm_id, list_aggregate(list_filter([CASE WHEN bicycle_parking IS NOT NULL THEN 'bicycle_parking' END, CASE WHEN raw IS NOT NULL AND capacity_n IS NULL THEN 'capacity' END, CASE WHEN covered = '' THEN 'covered' END, CASE WHEN fee IS NOT NULL THEN 'fee' END], lambda k: k IS NOT NULL), 'string_agg', ',') AS other_keys FROM parking""",
    "parking_box": f"WITH {PARKING} SELECT feature_type, osm_id, {_box('capacity_n')} AS capacity_text, coalesce(kind, 'Unknown') AS type_text FROM parking",
    "osm_point_lookup": f"WITH {ELEMENTS} SELECT CASE WHEN area THEN 'way' ELSE 'node' END AS feature_type, osm_id, amenity, name FROM elements WHERE osm_id = 8 AND NOT area",
    "way_badges": f"""WITH {LINES} SELECT osm_id, concat(coalesce(name || ' (', ''), 'Cycling ', CASE class WHEN 'lane' THEN 'Lane' ELSE 'Track' END, CASE WHEN name IS NOT NULL THEN ')' ELSE '' END) AS title,
 concat_ws('|', CASE WHEN construction THEN 'Under Construction' END, CASE WHEN dooring_risk THEN 'risk of dooring (adjacent parking)' END, CASE WHEN shared_with_vehicles THEN 'shared with vehicles' END, CASE WHEN shared_with_pedestrians THEN 'shared with pedestrians' END, CASE WHEN oneway <> 0 THEN 'one way' END,
 CASE WHEN class = 'track' THEN 'track (separated from roadway)' WHEN shared_with_vehicles THEN 'shared lane' ELSE 'bike lane on roadway' END) AS badges FROM lines""",
    "size_estimates": "SELECT p_partkey, (p_partkey * 1000003) * 200 // 60 AS intermediate_bytes, (p_partkey * 1000003) * 100 // 60 AS output_bytes, (p_partkey * 1000003) * 20 // 67 AS memory_bytes FROM part",
}
SQL["url_view_state"] = "WITH u AS (SELECT page_id, " + views.VIEW_URL + " AS u FROM pages), n AS (SELECT page_id, " + ", ".join(f"TRY_CAST(nullif(regexp_extract(u, '[?&]{k}=([+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?)', 1), '') AS DOUBLE) AS {k}" for k in VIEW_DEFAULTS) + """ FROM u)
SELECT page_id, CASE WHEN zoom IS NULL THEN 13.0 ELSE least(greatest(zoom, 5.0), 20.0) END AS zoom, CASE WHEN lng IS NULL THEN -123.135 ELSE least(greatest(lng, -140.0), -115.0) END AS lng, CASE WHEN lat IS NULL THEN 49.272 ELSE least(greatest(lat, 47.0), 60.0) END AS lat FROM n"""
#: Legs of streets run east, so what merges in a tile are neighbours in a street that look alike: islands of ids.
SQL["merged_lines"] = f"""WITH {LINES}, {ON_ROUTES}, {GATED},
legs AS (SELECT *, power(2.0, z) AS scale, (-123.3 + (osm_id % 8) * CAST(0.002 AS DOUBLE) + (floor(osm_id / 8) % 40) * CAST(0.02 AS DOUBLE) + 180) / 360 AS x0, (-123.3 + ((osm_id % 8) + 1) * CAST(0.002 AS DOUBLE) + (floor(osm_id / 8) % 40) * CAST(0.02 AS DOUBLE) + 180) / 360 AS x1, radians(49.0 + floor(osm_id / 320) * 0.003) AS phi FROM gated),
placed AS (SELECT *, (1 - ln(tan(phi) + 1 / cos(phi)) / pi()) / 2 AS wy FROM legs),
wide AS (SELECT *, unnest(range(CAST(floor(x0 * scale - 4 / 256.0) AS BIGINT), CAST(floor(x1 * scale + 4 / 256.0) AS BIGINT) + 1)) AS x FROM placed),
met AS (SELECT *, unnest(range(CAST(floor(wy * scale - 4 / 256.0) AS BIGINT), CAST(floor(wy * scale + 4 / 256.0) AS BIGINT) + 1)) AS y FROM wide),
marked AS (SELECT *, CASE WHEN oneway = 1 THEN osm_id END AS apart, osm_id - row_number() OVER (PARTITION BY z, x, y, {ATTRIBUTES}, name, surface, routes, CASE WHEN oneway = 1 THEN osm_id END, osm_id // 8 ORDER BY osm_id) AS island FROM met),
merged AS (SELECT z, x, y, {ATTRIBUTES}, name, surface, routes, count(*) AS n_lines, (max(x1) - min(x0)) * any_value(scale) * 256 AS pixels FROM marked GROUP BY z, x, y, {ATTRIBUTES}, name, surface, routes, apart, osm_id // 8, island)
SELECT z, x, y, {ATTRIBUTES}, name, surface, routes, n_lines, 2 AS n_points FROM merged
WHERE pixels * {EQUATOR_M} / (256 * power(2.0, z) * cosh(pi() * (1 - 2 * (y + 0.5) / power(2.0, z)))) >= CASE z WHEN 6 THEN 100 WHEN 7 THEN 50 ELSE 0 END"""
_BLOBS = f"""WITH RECURSIVE {PLACES}, blobs AS (SELECT tile_id, concat('tile ', tile_id // 4) AS data FROM ids), firsts AS (SELECT data, min(tile_id) AS first, length(data) AS n FROM blobs GROUP BY data),
placed AS (SELECT data, n, CAST(coalesce(sum(n) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place FROM firsts),
isles AS (SELECT tile_id, data, tile_id - row_number() OVER (PARTITION BY data ORDER BY tile_id) AS g FROM blobs)"""
SQL["archive_round_trip"] = f"{_BLOBS} SELECT tile_id, data FROM blobs"
SQL["archive_entries"] = f'{_BLOBS} SELECT min(tile_id) AS tile_id, count(*) AS run_length, place AS "offset", n AS length FROM isles JOIN placed USING (data) GROUP BY data, g, place, n'
SQL["archive_headers"] = f"""{_BLOBS} SELECT 3 AS version, (SELECT count(*) FROM blobs) AS addressed_tiles, (SELECT count(*) FROM (SELECT DISTINCT data, g FROM isles)) AS tile_entries, (SELECT count(*) FROM firsts) AS tile_contents,
 1 AS tile_type, 1 AS tile_compression, 6 AS min_zoom, 6 AS max_zoom, CAST(-140 AS DOUBLE) AS min_lon, CAST(60.5 AS DOUBLE) AS max_lat, 6 AS center_zoom, (SELECT CAST(sum(n) AS BIGINT) FROM firsts) AS data_length, 'Events' AS name, 'Tiles with events' AS description, 'nobody' AS attribution"""
SQL["archive_blobs"] = f"{_BLOBS}, asked AS (SELECT event_id, 1365 + (event_id * 7919 + user_id) % 4096 AS tile_id FROM events) SELECT event_id, a.tile_id, data FROM asked a LEFT JOIN blobs b ON a.tile_id = b.tile_id"
SQL["archive_legacy_entries"] = f"""WITH {TILES}, d AS (SELECT DISTINCT x14, y14, (x14 // 128) * 128 + y14 // 128 AS directory FROM tiles)
SELECT directory, CAST(row_number() OVER (PARTITION BY directory ORDER BY x14 % 5 = 0, x14, y14) - 1 AS INT) AS place, 14 AS z, x14 AS x, y14 AS y, x14 % 5 = 0 AS is_dir, 281474976000000 + x14 AS "offset", y14 + 1 AS length FROM d"""
_DEEP = f"""WITH RECURSIVE {TILES}, up AS (SELECT DISTINCT x14 // 2 AS x13, y14 // 2 AS y13 FROM tiles),
deep AS (SELECT 2 * x13 + dx AS x, 2 * y13 + dy AS y, {views.DEEP_DATA} AS data FROM up, (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy)), {hilbert('14', 'x', 'y', 'deep', 'x * 16384 + y')},
blobs AS (SELECT tile_id, data FROM ids JOIN deep ON key = x * 16384 + y), firsts AS (SELECT data, min(tile_id) AS first, length(data) AS n FROM blobs GROUP BY data),
placed AS (SELECT data, n, CAST(coalesce(sum(n) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place FROM firsts),
isles AS (SELECT tile_id, data, tile_id - row_number() OVER (PARTITION BY data ORDER BY tile_id) AS g FROM blobs)"""
SQL["single_archive_tiles"] = f"{_DEEP} SELECT 'events' AS archive, tile_id, data FROM blobs"
SQL["single_archive_entries"] = f'{_DEEP} SELECT min(tile_id) AS tile_id, count(*) AS run_length, place AS "offset", n AS length FROM isles JOIN placed USING (data) GROUP BY data, g, place, n'
SQL["single_archive_header"] = f"""{_DEEP} SELECT 'events' AS archive, 3 AS version, (SELECT count(*) FROM blobs) AS addressed_tiles, (SELECT count(*) FROM (SELECT DISTINCT data, g FROM isles)) AS tile_entries, (SELECT count(*) FROM firsts) AS tile_contents,
 14 AS min_zoom, 14 AS max_zoom, (SELECT CAST(sum(n) AS BIGINT) FROM firsts) AS data_length, 'Events' AS name"""
#: The map as if built anew from the changed elements. Legs still run east, and what merges are neighbours in a street.
_CHANGED = f"""SELECT o_orderkey AS k, o_custkey + CASE WHEN {views.RETAGGED.replace("k", "o_orderkey")} THEN 7 ELSE 0 END AS c FROM orders WHERE NOT ({views.GONE.replace("k", "o_orderkey")})
  UNION ALL SELECT o_orderkey + {views.TWIN_STEP}, o_custkey FROM orders WHERE {views.TWIN.replace("k", "o_orderkey")}"""


def _leg(n: str) -> str:
    lon = views.NODE_LON.replace("(n ", f"({n} ")
    return lon + f" + CASE WHEN {views.MOVED.replace('n ', n + ' ')} THEN {views.MOVE} ELSE 0 END"


SQL["incremental_lines"] = f"""WITH {_ways(_CHANGED)}, {RULES}, {ON_ROUTES.replace("route = 'bicycle')", f"route = 'bicycle' AND NOT ({views.ROUTE_GONE}))")}, {GATED},
ends AS (SELECT *, 9 * CAST(floor(osm_id / 8) AS BIGINT) + osm_id % 8 AS n FROM gated),
legs AS (SELECT *, power(2.0, z) AS scale, ({_leg('n')} + 180) / 360 AS wx0, ({_leg('(n + 1)')} + 180) / 360 AS wx1, radians({views.NODE_LAT}) AS phi FROM ends),
met0 AS (SELECT *, (1 - ln(tan(phi) + 1 / cos(phi)) / pi()) / 2 AS wy FROM legs),
wide AS (SELECT *, unnest(range(CAST(floor(wx0 * scale - 4 / 256.0) AS BIGINT), CAST(floor(wx1 * scale + 4 / 256.0) AS BIGINT) + 1)) AS x FROM met0),
met AS (SELECT *, unnest(range(CAST(floor(wy * scale - 4 / 256.0) AS BIGINT), CAST(floor(wy * scale + 4 / 256.0) AS BIGINT) + 1)) AS y FROM wide),
marked AS (SELECT *, CASE WHEN oneway = 1 THEN osm_id END AS apart, osm_id - row_number() OVER (PARTITION BY z, x, y, {ATTRIBUTES}, name, surface, routes, CASE WHEN oneway = 1 THEN osm_id END, osm_id // 8 ORDER BY osm_id) AS island FROM met),
merged AS (SELECT z, x, y, {ATTRIBUTES}, name, surface, routes, count(*) AS n_lines, sum((wx1 - wx0) * scale * 256) AS pixels, min(wx0) AS w0, max(wx1) AS w1, any_value(wy) AS wy, any_value(scale) AS scale
  FROM marked GROUP BY z, x, y, {ATTRIBUTES}, name, surface, routes, apart, osm_id // 8, island)
SELECT z, x, y, {ATTRIBUTES}, name, surface, routes, n_lines, round(greatest((w0 * scale - x) * 256, -4), 2) AS x0, round(least((w1 * scale - x) * 256, 260), 2) AS x1, round((wy * scale - y) * 256, 2) AS y0, round((wy * scale - y) * 256, 2) AS y1, 2 AS n_points FROM merged
WHERE pixels * {EQUATOR_M} / (256 * power(2.0, z) * cosh(pi() * (1 - 2 * (y + 0.5) / power(2.0, z)))) >= CASE z WHEN 6 THEN 100 WHEN 7 THEN 50 ELSE 0 END"""
SQL["archive_paths"] = "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN concat('maps/', p_name, '/v1/', p_name, '.pmtiles') ELSE p_name || '.pmtiles' END AS path FROM part"
SQL["allowed_origins"] = "SELECT page_id, CASE page_id % 4 WHEN 0 THEN '*' WHEN 2 THEN regexp_extract(url, '^(https?://[^/?#]*)', 1) END AS origin FROM pages"
SQL["view_queries"] = "SELECT event_id, printf('zoom=%.4f&lng=%.10f&lat=%.10f', CAST(5 + (event_id % 60) * 0.25 AS DOUBLE), CAST(-140 + (user_id % 100) * 0.25 AS DOUBLE), CAST(47 + (event_id % 52) * 0.25 AS DOUBLE)) AS query FROM events"
SQL["link_queries"] = "SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN concat('/map/', page_id, '?', CASE WHEN page_id % 3 <> 0 THEN concat('zoom=', page_id % 20) END) END AS href FROM pages"
#: A square of side 4 less, in two of three, a hole of side s whose lower left corner lies at 1, 1.
SQL["relation_centers"] = """WITH a AS (SELECT p_partkey AS k, CAST(p_partkey % 350 - 175 AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y, CAST(1 + p_partkey % 2 AS DOUBLE) AS s, CASE WHEN p_partkey % 3 <> 0 THEN (1 + p_partkey % 2) ** 2 ELSE 0 END AS hole FROM part WHERE p_size % 5 = 0 AND p_partkey % 7 <> 0)
SELECT k AS osm_id, round(x + (32 - hole * (1 + s / 2)) / (16 - hole), 6) AS x, round(y + (32 - hole * (1 + s / 2)) / (16 - hole), 6) AS y FROM a"""
SQL["base_schema"] = "SELECT event_id, event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0 AS fits FROM events"
SQL["tile_sources"] = "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 1 THEN 'https://t.example/' || n_name ELSE 'pmtiles://base.pmtiles' END AS base, n_nationkey % 3 <> 1 AS archives FROM nation"
SQL["split_numbers"] = "SELECT event_id, CAST(-100 - event_id % 50 AS DOUBLE) AS n0, CAST(user_id % 90 + 0.5 AS DOUBLE) AS n1, CASE WHEN event_id % 3 <> 0 THEN CAST(event_id AS DOUBLE) END AS n2, 3 AS size, -100 - event_id % 50 AS leading FROM events"
_BYTE = "((event_id * 65537) >> (8 * (6 - {i}))) & 255"
SQL["little_endian"] = "SELECT event_id, " + ", ".join("CAST(" + " + ".join(f"(({_BYTE.format(i=at + i)}) << {8 * i})" for i in range(n)) + f" AS BIGINT) AS at{at}_{n}" for at, n in ((0, 3), (1, 6), (0, 7), (4, 3))) + " FROM events"
SQL["present_tags"] = f"WITH {ELEMENTS}, t AS (SELECT osm_id, list_sort(list_filter([" + ", ".join(f"""CASE WHEN "{k}" IS NOT NULL THEN '{k}' END""" for k in views.EVENT_TAGS) + "], lambda k: k IS NOT NULL)) AS k FROM elements) SELECT osm_id AS event_id, CAST(len(k) AS INT) AS n_tags, array_to_string(k, ',') AS keys FROM t"
SQL["clicked_features"] = f"""WITH hits AS (SELECT *, osm_id % 97 AS click, CASE WHEN kind = 'line' THEN 'way' ELSE kind END AS feature_type FROM ({SQL["style_cycling_layers"]}) WHERE z >= 13 AND style_layer IN ({", ".join(f"'{c}'" for c in styles.CLICKABLE)}))
SELECT click, style_layer, feature_type, osm_id FROM (SELECT *, row_number() OVER (PARTITION BY click ORDER BY layer_ord DESC, osm_id DESC, z) AS r FROM hits) WHERE r = 1"""
SQL["feature_marks"] = f"""WITH {LINES} SELECT osm_id, CASE WHEN osm_id % 3 <> 0 AND (o_custkey % 50 = 0 OR o_custkey % 70 = 1) THEN '{styles.MARKED_COLOR}' ELSE 'green' END AS color, CASE WHEN oneway = 1 THEN 90 ELSE 270 END AS rotation,
 upper(concat(coalesce(name, ''), ' ', coalesce(surface, ''))) AS label FROM lines JOIN orders ON o_orderkey = osm_id"""


def _paint(key: str, spell) -> str:
    return "CASE " + " ".join(f"WHEN style_layer = '{name}' THEN {spell(p[key], p)}" for name, p in styles.PAINT.items() if key in p) + " END"


def _mark(color: str, marks: bool) -> str:
    return f"CASE WHEN osm_id % 50 = 0 OR osm_id % 70 = 1 THEN '{styles.MARKED_COLOR}' ELSE '{color}' END" if marks else f"'{color}'"


def _dash(stops: list, _: dict) -> str:
    return "CASE " + " ".join(f"WHEN z >= {at} THEN '{v}'" for at, v in reversed(stops)) + " END"


_word, _number = lambda v, _: f"'{v}'", lambda v, _: f"CAST({_interpolate(v, 1)} AS DOUBLE)"
SQL["style_cycling_paint"] = f"""SELECT kind, osm_id, z, style_layer, {_paint("color", lambda v, p: _mark(v, bool(p.get("marked"))))} AS color, {_paint("stroke", lambda v, p: _mark(v, True))} AS stroke,
 {", ".join(f"round({_paint(k, _number)}, 6) AS {k}" for k in ("width", "size", "opacity"))}, {_paint("dash", _dash)} AS dash, {", ".join(f"{_paint(k, _word)} AS {k}" for k in ("cap", "icon", "halo"))},
 {_paint("rotate", lambda v, _: "CASE WHEN oneway = 1 THEN 90 ELSE 270 END" if v == "oneway" else str(v))} AS rotation, {_paint("label", lambda v, p: "upper(coalesce(name, ''))")} AS label FROM ({SQL["style_cycling_layers"].replace("kind, osm_id, z,", "kind, osm_id, name, oneway, z,")})"""


def _base_paint(key: str, spell) -> str:
    return "CASE style_layer " + " ".join(f"WHEN '{name}' THEN {spell(p[key], p)}" for name, p in styles.BASEMAP_PAINT.items() if key in p) + " END"


def _base_color(v: object, _: dict) -> str:
    if isinstance(v, str):
        return f"'{v}'"
    part = [_interpolate([(z, c[i]) for z, c in v], 1) for i in range(4)]
    return "concat('rgba(', " + ", ',', ".join(f"CAST(round({c}) AS INT)" for c in part[:3]) + f", ',', round(CAST({part[3]} AS DOUBLE), 4), ')')"


def _base_label(template: str, p: dict) -> str:
    pieces = [f"coalesce(\"{piece}\", '')" if i % 2 else "'" + piece.replace("\n", "' || chr(10) || '") + "'" for i, piece in enumerate(template.replace("}", "{").split("{"))]
    joined = " || ".join(pieces)
    return f"upper({joined})" if p.get("upper") else joined


_BASE_ROWS = style_sql(styles.BASEMAP + styles.WALKING, "base", ", ".join(["k", *[f'"{c}"' for c in views.BASE_NAMES]]), set(views.BASE),
    f"raw AS (SELECT p_partkey AS k, p_name AS name FROM part), base AS (SELECT k, {_columns({c: e for c, e in views.BASE.items() if c != 'z'})}, {_columns(views.BASE_NAMES)}, CAST(unnest(range(0, 18)) AS INT) AS z FROM raw)")
SQL["style_basemap_paint"] = f"""SELECT k, z, layer_ord, style_layer, {_base_paint("color", _base_color)} AS color,
 {", ".join(f"round({_base_paint(k, lambda v, p, k=k: f'CAST({_interpolate(v, p.get("base", 1) if k == "width" else 1)} AS DOUBLE)')}, 6) AS {k}" for k in styles.PAINT_NUMBERS)},
 {", ".join(f"{_base_paint(k, lambda v, p: _word(v, p) if isinstance(v, str) else _dash(v, p))} AS {k}" for k in styles.PAINT_WORDS)}, {_base_paint("label", _base_label)} AS label FROM ({_BASE_ROWS})"""

_ORDER = ", ".join(f"('{layer[0]}', {i})" for i, layer in enumerate(styles.CYCLING))
SQL["clicked_places"] = f"""WITH clicks AS (SELECT event_id, {_columns(views.CLICKS)} FROM events),
points AS (SELECT event_id, z, (lon + 180) / 360 * power(2.0, z) * 256 AS px, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * power(2.0, z) * 256 AS py FROM clicks),
painted AS (SELECT * FROM ({SQL["style_cycling_paint"]}) WHERE kind = 'line' AND width IS NOT NULL AND z >= {styles.CLICK_ZOOM} AND style_layer IN ({", ".join(f"'{c}'" for c in styles.CLICKABLE)})),
legs AS (SELECT osm_id, z, style_layer, ord, width / 2 AS reach, (-123.3 + (osm_id % 8) * CAST(0.002 AS DOUBLE) + (floor(osm_id / 8) % 40) * CAST(0.02 AS DOUBLE) + 180) / 360 * power(2.0, z) * 256 AS x0,
  (-123.3 + (osm_id % 8 + 1) * CAST(0.002 AS DOUBLE) + (floor(osm_id / 8) % 40) * CAST(0.02 AS DOUBLE) + 180) / 360 * power(2.0, z) * 256 AS x1,
  (1 - ln(tan(radians(49.0 + floor(osm_id / 320) * 0.003)) + 1 / cos(radians(49.0 + floor(osm_id / 320) * 0.003))) / pi()) / 2 * power(2.0, z) * 256 AS ly FROM painted JOIN (VALUES {_ORDER}) AS o(style_layer, ord) USING (style_layer)),
near AS (SELECT event_id, style_layer, ord, osm_id, sqrt((py - ly) ** 2 + greatest(x0 - px, px - x1, 0) ** 2) AS distance, reach FROM points p JOIN legs l ON p.z = l.z AND abs(p.py - l.ly) <= reach AND p.px BETWEEN l.x0 - reach AND l.x1 + reach)
SELECT event_id, style_layer, 'way' AS feature_type, osm_id, round(distance, 3) AS distance FROM near WHERE distance <= reach QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ord DESC, osm_id DESC) = 1"""
_Y = "(1 - ln(tan(radians({0})) + 1 / cos(radians({0}))) / pi()) / 2 * side"
#: A square, or its hole, and a tile share a rectangle.
SQL["clipped_areas"] = f"""WITH a AS (SELECT p_partkey AS k, CAST(p_partkey % 350 - 175 AS DOUBLE) AS lon, CAST(p_size AS DOUBLE) AS lat, CASE WHEN p_partkey % 3 <> 0 THEN 1 + p_partkey % 2 ELSE 0 END AS s FROM part WHERE p_size % 5 = 0 AND p_partkey % 7 <> 0),
levels AS (SELECT *, power(2.0, z) * 256 AS side FROM a, (SELECT CAST(unnest(range(3, 7)) AS INT) AS z)),
boxes AS (SELECT *, (lon + 180) / 360 * side AS x0, (lon + 184) / 360 * side AS x1, {_Y.format("(lat + 4)")} AS y0, {_Y.format("lat")} AS y1, (lon + 181) / 360 * side AS hx0, (lon + 181 + s) / 360 * side AS hx1, {_Y.format("(lat + 1 + s)")} AS hy0, {_Y.format("(lat + 1)")} AS hy1 FROM levels),
cols AS (SELECT *, unnest(range(CAST(floor(x0 / 256) AS BIGINT), CAST(floor(x1 / 256) AS BIGINT) + 1)) AS x FROM boxes), tiles AS (SELECT *, unnest(range(CAST(floor(y0 / 256) AS BIGINT), CAST(floor(y1 / 256) AS BIGINT) + 1)) AS y FROM cols),
cut AS (SELECT *, greatest(least(x1, 256 * x + 256) - greatest(x0, 256 * x), 0) * greatest(least(y1, 256 * y + 256) - greatest(y0, 256 * y), 0) AS own,
  greatest(least(hx1, 256 * x + 256) - greatest(hx0, 256 * x), 0) * greatest(least(hy1, 256 * y + 256) - greatest(hy0, 256 * y), 0) AS hole FROM tiles)
SELECT k AS osm_id, z, x, y, CAST(CASE WHEN hole > 1e-9 THEN 2 ELSE 1 END AS INT) AS n_rings, round(own - hole, 2) AS pixels FROM cut WHERE own > 1e-9"""
SQL["schema_reasons"] = f"""WITH {ELEMENTS}, e AS (SELECT *, CASE WHEN area THEN 'way' ELSE 'node' END AS feature_type, {CAPACITY} AS n FROM elements)
SELECT 'bike_parking' AS schema, feature_type, osm_id, n AS capacity, concat_ws('; ', CASE WHEN "type" <> 'bike_parking' THEN 'type: not bike_parking' END, CASE WHEN amenity IS NULL THEN 'amenity: missing' WHEN amenity <> 'bicycle_parking' THEN 'amenity: not bicycle_parking' END) AS reasons FROM e
UNION ALL SELECT 'bench', feature_type, osm_id, n, concat_ws('; ', CASE WHEN amenity IS NULL THEN 'amenity: missing' WHEN amenity <> 'bench' THEN 'amenity: not bench' END,
  CASE WHEN capacity IS NULL THEN 'capacity: missing' WHEN n IS NULL THEN 'capacity: not a number' END, CASE WHEN covered NOT IN ('yes', 'no') THEN 'covered: not one of yes, no' END) FROM e"""
SQL["legacy_archives"] = f"""WITH s AS (SELECT s_nationkey AS k, s_suppkey AS s FROM supplier), old AS (SELECT k, {_columns(views.OLD)}, {_columns(views.OLD_ENTRIES)} FROM s)
SELECT 'n' || k AS archive, version, 0 AS min_zoom, max_zoom, min_lon, max_lat, CASE format WHEN 'pbf' THEN 1 WHEN 'png' THEN 2 WHEN 'jpg' THEN 3 ELSE 4 END AS tile_type, z, x, y, "offset", length FROM old"""
SQL["works_on_ways"] = f"""WITH {LINES}, works AS (SELECT k, {_columns(views.WORKS_TAGS)} FROM (SELECT o_orderkey AS k FROM orders))
SELECT osm_id, branch, construction, CASE WHEN construction THEN website END AS website, CASE WHEN construction THEN opening_date END AS opening_date FROM lines JOIN works ON k = osm_id"""
