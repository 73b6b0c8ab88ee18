"""A built map that follows changes: only tiles that a change set reaches are merged and written again.

    folder = MapFolder(spark, "s3://bucket/map")
    folder.build(nodes, ways, relations)
    folder.update(changes)                      # create, modify, delete of nodes, ways and relations
    folder.lines()                              # the tiles as they are now
    follow(folder, "s3://bucket/changes", "s3://bucket/checkpoint")   # the same for each file of changes that comes

What depends on what is found by semi-joins: a changed node reaches the ways through it, a changed relation its members, and a way the tiles
where it was and where it is now (the index: tile and way). Those tiles are merged from all lines that they have, whose shapes
(classified, with routes and places) are kept, so that only ways that were reached are joined to nodes and routes anew.

Every table (elements, shapes, index, merged lines) is a base and deltas: a delta has a version, the keys that it replaces and their rows. Readers
take of each key the rows of the last version that replaced it. A version counts once the folder's list names it, which is
swapped in one step; so readers see all of a change set or nothing of it, and an update that was lost is written again under its number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tagatlas.operators import features, geometry, merge, routes
from tagatlas.plans.map_build import LOOK
from tagatlas.sources.files import current, make_current, store

MEMBERS = "array<struct<type: string, ref: bigint, role: string>>"
#: Changes of all kinds: op is create, modify or delete; of several changes of an element the one with the greatest seq holds.
CHANGES = f"kind string, op string, seq bigint, id bigint, lon double, lat double, nodes array<bigint>, members {MEMBERS}, tags map<string, string>"
KINDS = {"nodes": ("node", ["lon", "lat", "tags"]), "ways": ("way", ["nodes", "tags"]), "relations": ("relation", ["members", "tags"])}
KEY = {"nodes": "node_id", "ways": "way_id", "relations": "relation_id"}
TILE = ["z", "x", "y"]


@dataclass
class Elements:
    """nodes: node_id, lon, lat, tags; ways: way_id, nodes, tags; relations: relation_id, members, tags."""

    nodes: DataFrame
    ways: DataFrame
    relations: DataFrame


def last_changes(changes: DataFrame, table: str) -> DataFrame:
    """The last change of each element of a table: op, the key and the table's columns. Changes without an id are left out."""
    kind, columns = KINDS[table]
    rows = changes.where((F.col("kind") == kind) & F.col("id").isNotNull()).select("op", "seq", F.col("id").alias(KEY[table]), *columns)
    last = Window.partitionBy(KEY[table]).orderBy(F.desc_nulls_last("seq"), F.desc(F.col("op") == "delete"))
    return rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "seq")


def touched_ways(old: Elements, now: Elements, changed: dict[str, DataFrame]) -> DataFrame:
    """(way_id) of ways that a change reaches, by themselves, by a node or by a relation they are or were a member of."""
    # a way that passes other nodes than before is among the changed ones
    through = old.ways.select("way_id", F.explode("nodes").alias("node_id"))
    by_node = through.join(changed["nodes"].select("node_id"), "node_id", "left_semi").select("way_id")
    groups = old.relations.select("relation_id", "members").unionByName(now.relations.select("relation_id", "members"))
    groups = groups.join(changed["relations"].select("relation_id"), "relation_id", "left_semi")
    by_relation = groups.select(F.explode("members").alias("m")).where("m.type = 'way' and m.ref is not null").select(F.col("m.ref").alias("way_id"))
    return changed["ways"].select("way_id").unionByName(by_node).unionByName(by_relation).distinct()


class MapFolder:
    def __init__(self, spark: SparkSession, folder: str, max_zoom: int = 14, beyond: bool = False) -> None:
        """beyond: as in features.in_tiles."""
        self.spark, self.folder, self.max_zoom, self.beyond = spark, folder.rstrip("/"), max_zoom, beyond

    # versions

    def version(self) -> int:
        """The last version that counts; -1 before a build."""
        return max((int(n.split("-")[1]) for n in current(self.folder) or [] if n.startswith("version-")), default=-1)

    def batches(self) -> set[int]:
        """Batches of a stream that are in the map."""
        return {int(n.split("-")[1]) for n in current(self.folder) or [] if n.startswith("batch-")}

    def _count(self, version: int, batch: int | None) -> None:
        fs, inner = store(self.folder)
        fs.create_dir(inner, recursive=True)
        # batches come in order, so the last one says it for all
        known = [f"batch-{batch}"] if batch is not None else [n for n in current(self.folder) or [] if n.startswith("batch-")]
        make_current(self.folder, [f"version-{version}", *known])

    def _write(self, table: str, version: int, keys: DataFrame | None, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{table}/rows/version={version}")
        if keys is not None:
            keys.distinct().write.mode("overwrite").parquet(f"{self.folder}/{table}/keys/version={version}")

    def _read(self, table: str, key: list[str], version: int | None = None) -> DataFrame:
        """The table as of a version: of each key the rows of the last version that replaced it."""
        version = self.version() if version is None else version
        base = self.spark.read.parquet(f"{self.folder}/{table}/rows/version=0")
        part = lambda kind: [f"{self.folder}/{table}/{kind}/version={v}" for v in range(1, version + 1)]
        if version < 1:
            return base
        read = lambda kind: self.spark.read.option("basePath", f"{self.folder}/{table}/{kind}").parquet(*part(kind)).withColumn("version", F.col("version").cast("int"))
        keys = read("keys").groupBy(*key).agg(F.max("version").alias("version"))
        # deltas are small beside the base, which is only read past the keys they replaced
        fresh = read("rows").join(keys, [*key, "version"], "left_semi").drop("version")
        return base.join(keys.select(*key), key, "left_anti").unionByName(fresh.select(*base.columns))

    def elements(self, version: int | None = None) -> Elements:
        return Elements(*(self._read(t, [KEY[t]], version) for t in KEY))

    def lines(self, version: int | None = None) -> DataFrame:
        """Merged lines of all tiles: z, x, y, layer, attributes, n_lines, geom."""
        return self._read("lines", TILE, version)

    # work

    def _shaped(self, of: Elements, only: DataFrame | None = None) -> DataFrame:
        """Ways that are lines of the map, with all that they are drawn by."""
        ways = of.ways if only is None else of.ways.join(only, "way_id", "left_semi")
        # attributes are less to shuffle than tags, and nodes go their own way to their places
        lines = features.lines(ways).withColumnRenamed("osm_id", "way_id").join(geometry.shapes(ways, of.nodes), "way_id")
        return routes.with_routes(lines, of.relations).select("way_id", "layer", *LOOK, "min_zoom", "buffer_px", "geom")

    def _merged(self, shapes: DataFrame, only: DataFrame | None = None) -> DataFrame:
        return merge.merged(shapes.withColumnRenamed("way_id", "osm_id"), LOOK, self.max_zoom, beyond=self.beyond, only=only)

    def _places(self, shapes: DataFrame) -> DataFrame:
        return merge.tiles_of(shapes.withColumnRenamed("way_id", "osm_id"), self.max_zoom, beyond=self.beyond).withColumnRenamed("osm_id", "way_id")

    def build(self, nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> None:
        """Builds the map from all elements, as version 0; a map that was there before is no longer read once this one counts."""
        for table, rows in zip(KEY, (nodes, ways, relations)):
            self._write(table, 0, None, rows.select(KEY[table], *KINDS[table][1]))
        own = Elements(*(self._read(t, [KEY[t]], 0) for t in KEY))
        self._write("shapes", 0, None, self._shaped(own))
        shapes = self._read("shapes", ["way_id"], 0)
        self._write("index", 0, None, self._places(shapes))
        self._write("lines", 0, None, self._merged(shapes))
        self._count(0, None)

    def update(self, changes: DataFrame, batch: int | None = None) -> int:
        """Brings the map up to date with changes (CHANGES) and returns its version.

        A delete of what isn't there changes nothing; a create of what is there replaces it. With the number of a batch that is in the map already, nothing is done."""
        if batch is not None and batch <= max(self.batches(), default=-1):
            return self.version()
        before = self.version()
        if before < 0:
            raise ValueError(f"{self.folder}: nothing built yet")
        version, old, changed = before + 1, self.elements(), {}
        for table, key in KEY.items():
            self._write(f"changed-{table}", version, None, last_changes(changes, table))
            rows = self.spark.read.parquet(f"{self.folder}/changed-{table}/rows/version={version}")
            self._write(table, version, rows.select(key), rows.where("op <> 'delete'").drop("op"))
            changed[table] = self.spark.read.parquet(f"{self.folder}/{table}/keys/version={version}")
        now = self.elements(version)
        self._write("reached", version, None, touched_ways(old, now, changed))
        ways = self.spark.read.parquet(f"{self.folder}/reached/rows/version={version}")
        self._write("shapes", version, ways, self._shaped(now, ways))
        self._write("index", version, ways, self._places(self.spark.read.parquet(f"{self.folder}/shapes/rows/version={version}")))
        places = self.spark.read.parquet(f"{self.folder}/index/rows/version={version}")
        was = self._places(self._read("shapes", ["way_id"], before).join(ways, "way_id", "left_semi"))
        self._write("dirty", version, None, was.select(*TILE).unionByName(places.select(*TILE)).distinct())
        dirty = self.spark.read.parquet(f"{self.folder}/dirty/rows/version={version}")
        # all lines that those tiles have now: what is in a tile is in the tile above it too, so the lowest level says which
        lowest = F.col("z") == features.LINE_ZOOM
        there = self._read("index", ["way_id"], version).where(lowest).join(dirty.where(lowest), TILE, "left_semi").select("way_id").distinct()
        self._write("lines", version, dirty, self._merged(self._read("shapes", ["way_id"], version).join(there, "way_id", "left_semi"), dirty))
        self._count(version, batch)
        return version

    def compact(self) -> None:
        """Writes base and deltas as a new base in a folder of its own, which then is this map's folder."""
        to = MapFolder(self.spark, f"{self.folder}/compacted-{self.version()}", self.max_zoom, self.beyond)
        for table, key in [*((t, [k]) for t, k in KEY.items()), ("shapes", ["way_id"]), ("index", ["way_id"]), ("lines", TILE)]:
            to._write(table, 0, None, self._read(table, key))
        to._count(0, max(self.batches(), default=None))
        self.folder = to.folder


def follow(folder: MapFolder, changes: str, checkpoint: str) -> StreamingQuery:
    """Updates the map with the Parquet files of changes that have come since the last run, and ends. A batch that is run again after a loss counts once."""
    rows = folder.spark.readStream.schema(CHANGES).parquet(changes)
    return rows.writeStream.foreachBatch(lambda part, number: folder.update(part, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
