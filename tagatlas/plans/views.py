"""Map-like views of the driver's tables, for queries and tests. Expressions are SQL that Spark and other engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _case(of: str, values: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {of} IN ({keys}) THEN '{value}'" for value, keys in values.items()) + " END"


#: From order key k and customer key c: a = k mod 16, m = k div 16. A tag that is NULL is absent.
WAY_TAGS = {
    "highway": _case("a", {"cycleway": "0", "path": "1", "pedestrian": "2", "secondary": "3, 9", "construction": "4, 5", "tertiary": "6, 7, 8", "residential": "10, 12, 13", "primary": "14, 15"}),
    "bicycle": _case("a", {"designated": "1, 2, 13", "yes": "12"}),
    "cycleway": _case("a", {"track": "3, 5", "lane": "6", "shared_lane": "10"}),
    "cycleway:both": _case("a", {"shared": "11", "lane": "15"}),
    "cycleway:left": _case("a", {"lane": "7, 9, 14", "no": "13"}),
    "cycleway:right": _case("a", {"lane": "7, 8, 13", "no": "14"}),
    "cycleway:right:oneway": _case("a", {"no": "8"}),
    "cycleway:left:oneway": _case("a", {"no": "9"}),
    "construction": _case("a", {"cycleway": "4, 5"}),
    "foot": _case("c % 3", {"designated": "0", "yes": "1"}),
    "segregated": _case("m % 3", {"yes": "0", "no": "1"}),
    "oneway": _case("CAST(floor(c / 3) AS BIGINT) % 3", {"yes": "0", "-1": "1"}),
    "maxspeed": _case("CAST(floor(m / 3) AS BIGINT) % 5", {"30": "0", "50": "1", "20": "2", "50 mph": "3"}),
    "motor_vehicle": _case("c % 11", {"private": "0"}),
    "oneway:bicycle": _case("c % 5", {"no": "0"}),
    "parking": _case("(m + c) % 8", {"lane": "0", "separate": "1"}),
    "parking:both": _case("(m + c) % 8", {"lane": "2", "separate": "3"}),
    "parking:right": _case("(m + c) % 8", {"lane": "4"}),
    "parking:left": _case("(m + c) % 8", {"street_side": "5"}),
    "surface": _case("k % 7", {"asphalt": "0, 1, 2", "gravel": "3"}),
    "name": "CASE WHEN m % 4 <> 3 THEN concat('Way ', CAST(k AS STRING)) END",
}
RELATION_TAGS = {"type": "CASE WHEN p_size % 5 = 0 THEN 'multipolygon' ELSE 'route' END", "route": "CASE WHEN p_partkey % 3 = 0 THEN 'bicycle' ELSE 'hiking' END"}
TILE14 = {"x14": "(event_id * 7919 + user_id * 104729) % 16384", "y14": "(event_id * 6101 + user_id) % 16384"}
EVENT_TAGS = {
    "amenity": "CASE WHEN event_type IN ('view', 'signup') THEN 'bicycle_parking' WHEN event_type = 'click' THEN 'bench' END",
    "name": "CASE WHEN event_id % 3 = 0 THEN concat('Rack ', CAST(event_id AS STRING)) END",
    "capacity": "CASE WHEN event_id % 10 = 1 THEN '' WHEN event_id % 10 = 0 THEN concat('~', CAST(user_id AS STRING)) WHEN event_id % 10 = 2 THEN concat(' ', CAST(user_id % 50 AS STRING), ' ') WHEN event_id % 10 = 3 THEN '0x1F' WHEN event_id % 10 <> 4 THEN CAST(user_id % 50 AS STRING) END",
    "bicycle_parking": _case("event_id % 6", {"stands": "0", "two-tier": "1", "carousel": "2", "rack": "3"}),
    "covered": _case("event_id % 5", {"yes": "0", "no": "1", "partial": "2", "": "3"}),
    "indoor": _case("event_id % 7", {"room": "0", "no": "1"}),
    "operator": "CASE WHEN event_id % 9 = 0 THEN 'City' END",
    "fee": "CASE WHEN event_id % 4 = 0 THEN 'no' END",
    "type": _case("event_id % 29", {"bike_parking": "1", "rack": "0"}),
}
#: Attributes of base-map features made from parts, for filters to choose among.
BASE = {
    "layer": _case("k % 11", {"transportation": "0, 1, 2, 3", "transportation_name": "4", "place": "5, 6", "boundary": "7", "aeroway": "8", "water": "9", "landcover": "10"}),
    "kind": _case("CAST(floor(k / 11) AS BIGINT) % 7", {"line": "0, 1, 2", "polygon": "3, 4", "point": "5, 6"}),
    "class": _case("CAST(floor(k / 7) AS BIGINT) % 29", {
        "motorway": "0, 1", "primary": "2", "trunk": "3", "minor": "4", "service": "5", "path": "6, 7", "pier": "8", "rail": "9, 10", "transit": "11, 12", "runway": "13, 14", "taxiway": "15",
        "wood": "16", "city": "17, 18, 19", "town": "20", "village": "21", "suburb": "22", "state": "23", "country": "24, 25", "hamlet": "26", "secondary": "27",
    }),
    "subclass": _case("k % 5", {"path": "0, 1", "cycleway": "2"}),
    "brunnel": _case("k % 4", {"bridge": "0", "tunnel": "1"}),
    "service": "CASE WHEN k % 3 = 0 THEN 'yard' END",
    "iso_a2": "CASE WHEN k % 2 = 0 THEN 'XX' END",
    "claimed_by": "CASE WHEN k % 13 = 0 THEN 'YY' END",
    "rank": "CASE WHEN k % 6 <> 5 THEN CAST(k % 6 AS INT) END",
    "admin_level": "CASE WHEN k % 3 <> 2 THEN CAST(2 + 2 * (k % 3) AS INT) END",
    "capital": "CASE WHEN k % 5 < 2 THEN 2 END",
    "z": "CAST(k % 18 AS INT)",
}
#: Names of base-map features for labels, from k and a part's name.
BASE_NAMES = {"name:latin": "CASE WHEN k % 9 <> 0 THEN name END", "name:nonlatin": "CASE WHEN k % 4 = 1 THEN concat('N', CAST(k AS STRING)) END", "ref": "CASE WHEN k % 2 = 0 THEN concat('H', CAST(k % 100 AS STRING)) END"}
#: What ways under construction say of the works.
WORKS_TAGS = {"website": "CASE WHEN k % 3 <> 0 THEN concat('https://works.example/', CAST(k AS STRING)) END", "opening_date": "CASE WHEN k % 4 < 3 THEN concat('2030-0', CAST(1 + k % 9 AS STRING)) END"}
#: Archives of the old format, one for each nation k; and what each has of its suppliers s.
OLD = {"version": "CAST(1 + k % 2 AS INT)", "max_zoom": "CAST(k % 12 AS INT)", "min_lon": "CAST(-10 - k AS DOUBLE)", "max_lat": "CAST(10 + k AS DOUBLE)", "format": _case("k % 4", {"png": "0", "pbf": "1", "jpg": "2", "webp": "3"})}
OLD_ENTRIES = {"z": "CAST(20 AS INT)", "x": "s % 1000", "y": "CAST(floor(s / 1000) AS BIGINT)", "offset": "600000 + s * 200", "length": "100 + s % 50"}
#: Clicks on the map of placed ways, near the streets and up to 22 m beside them.
CLICKS = {
    "z": "CAST(13 + event_id % 2 AS INT)",
    "lon": "CAST(-123.3 AS DOUBLE) + (event_id * 37 % 1600) * CAST(0.0005 AS DOUBLE) + (event_id % 7) * CAST(0.00003 AS DOUBLE)",
    "lat": "CAST(49.0 AS DOUBLE) + (user_id % 40) * CAST(0.003 AS DOUBLE) + (event_id % 9 - 4) * CAST(0.00005 AS DOUBLE)",
}
#: Requests made from pages: every tenth is malformed, others ask for tiles of several levels, kinds and archives.
_Z = "page_id % 16"
_SIDE = "CAST(power(2, page_id % 16) AS BIGINT)"
_EXT = "CASE page_id % 4 WHEN 0 THEN 'mvt' WHEN 1 THEN 'pbf' WHEN 2 THEN 'png' ELSE 'json' END"
_NAME = "CASE WHEN page_id % 7 = 0 THEN 'base' WHEN page_id % 17 = 0 THEN 'lost' ELSE 'cycling' END"
REQUESTS = {
    "method": "CASE WHEN page_id % 23 = 0 THEN 'POST' ELSE 'GET' END",
    "path": f"CASE WHEN page_id % 10 = 0 THEN concat('/{{', CAST(page_id AS STRING)) WHEN page_id % 10 = 9 THEN concat('/', {_NAME}, '.json') WHEN page_id % 10 IN (1, 2, 3) THEN concat('/', {_NAME}, '/6/', CAST(page_id * 31 % 64 AS STRING), '/', CAST(page_id * 17 % 64 AS STRING), '.', {_EXT}) ELSE concat('/', {_NAME}, '/', CAST({_Z} AS STRING), '/', CAST(page_id * 31 % {_SIDE} AS STRING), '/', CAST(page_id * 17 % {_SIDE} AS STRING), '.', {_EXT}) END",
}
VIEW_URL = "concat(replace(url, '#top', ''), CASE WHEN replace(url, '#top', '') LIKE '%?%' THEN '&' ELSE '?' END, 'zoom=', CASE page_id % 5 WHEN 0 THEN '12abc' WHEN 1 THEN 'x' WHEN 2 THEN '99' WHEN 3 THEN '7.25' ELSE '' END, '&lng=', CAST(-100 - page_id % 60 AS STRING), '.5&lat=', CASE WHEN page_id % 4 = 0 THEN '1e2' ELSE CAST(45 + page_id % 20 AS STRING) END)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tags(columns: dict[str, str]):
    made = F.create_map(*[x for key, sql in columns.items() for x in (F.lit(key), F.expr(sql))])
    return F.map_filter(made, lambda k, v: v.isNotNull())


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_custkey AS c", "o_orderkey % 16 AS a", "CAST(floor(o_orderkey / 16) AS BIGINT) AS m")
    return rows.select(F.col("k").alias("way_id"), _tags(WAY_TAGS).alias("tags"))


def placed_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways with geometry: legs of streets that run east, eight ways to a street, each way of two points."""
    lon = lambda step: F.expr(f"-123.3D + ((way_id % 8) + {step}) * 0.002D + (floor(way_id / 8) % 40) * 0.02D")
    lat = F.expr("49.0D + floor(way_id / 320) * 0.003D")
    return ways(spark, sf_dir).withColumn("geom", F.array(*[F.struct(lon(s).alias("x"), lat.alias("y")) for s in (0, 1)]))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("relation_id"), _tags(RELATION_TAGS).alias("tags"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr("l_partkey AS relation_id", "CASE WHEN l_linenumber = 7 THEN 'node' ELSE 'way' END AS type", "l_orderkey AS ref")


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and, for signups, areas."""
    area = "coalesce(event_type = 'signup', false)"
    rows = read(spark, sf_dir, "events")
    return rows.select(F.expr(f"CASE WHEN {area} THEN 'way' ELSE 'node' END").alias("feature_type"), F.col("event_id").alias("osm_id"), F.expr(f"NOT {area}").alias("is_point"), F.lit(False).alias("can_be_line"), F.expr(area).alias("can_be_polygon"), _tags(EVENT_TAGS).alias("tags"))


def event_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "user_id", *[F.expr(sql).alias(name) for name, sql in TILE14.items()])


def base_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt out by k while rows are narrow: a million of them are a file of few tasks, and each becomes many rows."""
    rows = read(spark, sf_dir, "part").selectExpr("p_partkey AS k", "p_name AS name").repartition("k")
    return rows.select("k", "name", *[F.expr(sql).alias(c) for c, sql in BASE.items()])


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", *[F.expr(sql).alias(c) for c, sql in REQUESTS.items()])


def tile_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of level 6 that have events, as an archive lists them: four neighbouring ids share a place, and 100 to 149 bytes."""
    from tagatlas.functions.tiles import tile_id

    ids = event_tiles(spark, sf_dir).select(F.lit("cycling").alias("archive"), tile_id(F.lit(6), F.shiftright("x14", 8), F.shiftright("y14", 8)).alias("tile_id")).distinct()
    return ids.selectExpr("archive", "tile_id", "CAST(floor(tile_id / 4) AS BIGINT) * 1000 AS offset", "100 + CAST(floor(tile_id / 4) AS BIGINT) % 50 AS length")


def area_relations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Relations and their ways: a square in two halves, the second drawn backwards, with a square hole in two of three. Every seventh lacks a half."""
    rows = read(spark, sf_dir, "part").selectExpr("p_partkey AS k", "CAST(p_partkey % 350 - 175 AS DOUBLE) AS x", "CAST(p_size AS DOUBLE) AS y", "CAST(1 + p_partkey % 2 AS DOUBLE) AS s", *[f"{sql} AS {c}" for c, sql in RELATION_TAGS.items()])
    member = lambda i, role: f"named_struct('type', 'way', 'ref', 3 * k + {i}, 'role', '{role}')"
    relations = rows.select(F.col("k").alias("relation_id"), F.create_map(F.lit("type"), F.col("type"), F.lit("amenity"), F.lit("bicycle_parking")).alias("tags"), F.expr(f"concat(array({member(0, 'outer')}, {member(1, '')}), CASE WHEN k % 3 <> 0 THEN array({member(2, 'inner')}) ELSE array() END)").alias("members"))
    ring = lambda i, nodes, xy: rows.where("k % 7 <> 0" if i == 1 else "true").selectExpr(f"3 * k + {i} AS way_id", f"transform(array({nodes}), n -> 8 * k + n) AS nodes", "array(" + ", ".join(f"named_struct('x', x + {a}, 'y', y + {b})" for a, b in xy) + ") AS geom")
    hole = ring(2, "4, 5, 6, 7, 4", [(1, 1), ("1 + s", 1), ("1 + s", "1 + s"), (1, "1 + s"), (1, 1)])
    return relations, ring(0, "0, 1, 2", [(0, 0), (4, 0), (4, 4)]).unionByName(ring(1, "0, 3, 2", [(0, 0), (0, 4), (4, 4)])).unionByName(hole)


#: Streets as nodes and ways: eight ways and nine nodes each. A node's place by its number n; a way's first node by its number k.
NODE_LON, NODE_LAT = "CAST(-123.3 AS DOUBLE) + (n % 9) * CAST(0.002 AS DOUBLE) + (CAST(floor(n / 9) AS BIGINT) % 40) * CAST(0.02 AS DOUBLE)", "CAST(49.0 AS DOUBLE) + floor(n / 360) * CAST(0.003 AS DOUBLE)"
FIRST_NODE = "9 * CAST(floor(k / 8) AS BIGINT) + k % 8"
#: Planted changes: orders of a remainder by 50 are deleted (1), get the tags of another customer (2) or a twin far off (4); nodes move along their street; routes go.
GONE, RETAGGED, TWIN, TWIN_STEP = "k % 50 = 1", "k % 50 = 2", "k % 50 = 4", 3_200_000
MOVED, MOVE, ROUTE_GONE = "n % 200 = 5", "CAST(0.0003 AS DOUBLE)", "relation_id % 60 = 3"


def _keyed(spark: SparkSession, sf_dir: str, key: str = "o_orderkey", customer: str = "o_custkey", where: str = "true") -> DataFrame:
    """Ways with tags and nodes, numbered by an expression."""
    rows = read(spark, sf_dir, "orders").where(where.replace("k %", "o_orderkey %")).selectExpr(f"{key} AS k", f"{customer} AS c").selectExpr("k", "c", "k % 16 AS a", "CAST(floor(k / 16) AS BIGINT) AS m")
    return rows.select(F.col("k").alias("way_id"), F.expr(f"array({FIRST_NODE}, {FIRST_NODE} + 1)").alias("nodes"), _tags(WAY_TAGS).alias("tags"))


def _nodes(ways: DataFrame) -> DataFrame:
    rows = ways.select(F.explode("nodes").alias("n")).distinct()
    return rows.selectExpr("n AS node_id", f"{NODE_LON} AS lon", f"{NODE_LAT} AS lat", "CAST(NULL AS MAP<STRING, STRING>) AS tags")


def street_elements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, ways and relations with their members, as an extract has them."""
    ways = _keyed(spark, sf_dir)
    groups = members(spark, sf_dir).groupBy("relation_id").agg(F.collect_list(F.struct("type", "ref", F.lit("").alias("role"))).alias("members"))
    return _nodes(ways), ways, relations(spark, sf_dir).join(groups, "relation_id", "left").select("relation_id", "members", "tags")


def street_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planted changes, as streaming.map_folder takes them."""
    nodes, ways, groups = street_elements(spark, sf_dir)
    twins = _keyed(spark, sf_dir, f"o_orderkey + {TWIN_STEP}", where=TWIN)
    of = lambda df, kind, op, key: df.select(F.lit(kind).alias("kind"), F.lit(op).alias("op"), F.lit(1).cast("long").alias("seq"), F.col(key).alias("id"), "*").drop(key)
    parts = [
        of(ways.where(GONE.replace("k", "way_id")), "way", "delete", "way_id"), of(_keyed(spark, sf_dir, customer="o_custkey + 7", where=RETAGGED), "way", "modify", "way_id"), of(twins, "way", "create", "way_id"), of(_nodes(twins).withColumn("lon", F.when(F.expr(MOVED.replace("n", "node_id")), F.col("lon") + F.expr(MOVE)).otherwise(F.col("lon"))), "node", "create", "node_id"),
        of(nodes.where(MOVED.replace("n", "node_id")).withColumn("lon", F.col("lon") + F.expr(MOVE)), "node", "modify", "node_id"), of(groups.where(ROUTE_GONE), "relation", "delete", "relation_id"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def deep_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of level 14 (x, y, data): the four under each tile of level 13 that has events. A third of them are alike, most others share their data with some far off."""
    up = event_tiles(spark, sf_dir).selectExpr("shiftright(x14, 1) AS x13", "shiftright(y14, 1) AS y13").distinct()
    return up.selectExpr("*", "explode(array(0, 1)) AS dx").selectExpr("*", "explode(array(0, 1)) AS dy").selectExpr("2 * x13 + dx AS x", "2 * y13 + dy AS y", f"{DEEP_DATA} AS data")


DEEP_DATA = "CASE WHEN x13 % 3 = 0 THEN 'sea' ELSE concat('tile ', CAST(x13 % 1000 AS STRING), ' ', CAST(dx AS STRING)) END"


def archives(spark: SparkSession) -> DataFrame:
    rows = [("cycling", 1, 0, 14, -140.0, 47.0, -115.0, 60.0, -123.135, 49.272, 13, "Cycling", None, "OSM", "1"), ("base", 2, 2, 10, -180.0, -85.0, 180.0, 85.0, 0.0, 0.0, 4, None, "Base map", None, "2")]
    names = "archive string, tile_type int, min_zoom int, max_zoom int, min_lon double, min_lat double, max_lon double, max_lat double, center_lon double, center_lat double, center_zoom int, name string, description string, attribution string, version string"
    return spark.createDataFrame(rows, names)
