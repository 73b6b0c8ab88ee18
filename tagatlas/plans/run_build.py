"""spark-submit tagatlas/plans/run_build.py EXTRACT OUT [--max-zoom 14] [--parts N] [--single] [--layer cycling] [--name NAME] [--description TEXT] [--attribution HTML] [--version V]

Builds the map of an extract (a .pbf file or a folder of them) as tile archives in the folder OUT, or with --single as the one file OUT/NAME.pmtiles.
Name, description, attribution and version become fields of the archives' metadata; those not given are left out.
"""

from __future__ import annotations

import argparse
import json

from pyspark import StorageLevel
from pyspark.sql import SparkSession

from tagatlas.plans import map_build
from tagatlas.sources.osm_pbf import OsmPbf
from tagatlas.sources.single_archive import write_one
from tagatlas.sources.tile_archive import TileArchive


def build(spark: SparkSession, extract: str, out: str, max_zoom: int = 14, parts: int | None = None, layer: str = "cycling", single: bool = False, **about: str | None) -> None:
    spark.dataSource.register(OsmPbf)
    spark.dataSource.register(TileArchive)
    # nodes, ways and relations are three passes over the extract, which is unpacked once
    elements = spark.read.format("osm_pbf").load(extract).persist(StorageLevel.DISK_ONLY)
    mapped = map_build.map_features(*map_build.split_elements(elements), layer=layer)
    metadata = json.dumps({k: v for k, v in about.items() if v is not None})
    if single:
        write_one(map_build.tiles(mapped, max_zoom), f"{out.rstrip('/')}/{about.get('name') or layer}.pmtiles", parts, metadata=metadata)
    else:
        map_build.write_archive(map_build.tiles(mapped, max_zoom), out, parts, metadata=metadata)
    elements.unpersist()


def main() -> None:
    args = argparse.ArgumentParser(description="Builds tile archives from a map extract.")
    args.add_argument("extract")
    args.add_argument("out")
    args.add_argument("--max-zoom", type=int, default=14)
    args.add_argument("--parts", type=int, help="archives to write; as many as a shuffle has if not given")
    args.add_argument("--single", action="store_true", help="write one archive file, named by --name")
    args.add_argument("--layer", default="cycling")
    args.add_argument("--name", default="cycling")
    for field in ("description", "attribution", "version"):
        args.add_argument(f"--{field}")
    got = args.parse_args()
    build(SparkSession.builder.appName("map-build").getOrCreate(), got.extract, got.out, got.max_zoom, got.parts, got.layer, got.single, name=got.name, description=got.description, attribution=got.attribution, version=got.version)


if __name__ == "__main__":
    main()
