"""Areas in tiles: polygons with holes, cut to each tile of each level.

An area is cut to the four tiles under a tile, from what that tile has of it, level by level; so a tile costs what lies in it, not the whole
outline. After STEP levels the pieces are dealt out anew, so an area that fills a continent is no single task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagatlas.functions.tiles import world_xy
from tagatlas.operators import geometry
from tagatlas.operators.features import BUFFER_PX, TILE_PX

STEP = 3
RINGS = "array<array<double>>"


def relation_rings(relations: DataFrame, ways: DataFrame) -> DataFrame:
    """(osm_id, tags, rings) of relations that are areas, as geometry.relation_areas finds them; rings: flat lists x, y, x, y of lon and lat, outer ones first and counterclockwise, inner ones clockwise."""
    lines = geometry.relation_lines(relations, ways)

    @F.pandas_udf(RINGS)
    def of(lists: pd.Series) -> pd.Series:
        return pd.Series([[[float(v) for p in ring for v in p] for ring in geometry.turned_rings(own)] for own in lists], dtype=object)

    shapes = lines.select("relation_id", of("_l").alias("rings")).where(F.size("rings") > 0)
    return relations.join(shapes, "relation_id").select(F.col("relation_id").alias("osm_id"), "tags", "rings")


def way_rings(ways: DataFrame) -> DataFrame:
    """(osm_id, tags, rings) of closed ways (way_id, nodes, tags, geom) that may be areas."""
    rows = geometry.capabilities(ways).where("can_be_polygon and size(geom) > 3")
    return rows.select(F.col("way_id").alias("osm_id"), "tags", F.array(F.flatten(F.transform("geom", lambda p: F.array(p.x, p.y)))).alias("rings"))


def cut(ring: np.ndarray, low: float, high: float) -> np.ndarray:
    """What of a ring (n points, the last not the first again) lies within a square, as one ring; empty if nothing does.

    Parts that leave the square and come back are joined along its edge, which adds no area."""
    for axis in (0, 1):
        for edge, sign in ((low, 1.0), (high, -1.0)):
            if not len(ring):
                return ring
            off = sign * (ring[:, axis] - edge)
            inside = off >= 0
            if inside.all():
                continue
            follow, beyond = np.roll(ring, -1, 0), np.roll(off, -1)
            crossed = np.flatnonzero(inside != (beyond >= 0))
            t = off[crossed] / (off[crossed] - beyond[crossed])
            met = ring[crossed] + t[:, None] * (follow[crossed] - ring[crossed])
            met[:, axis] = edge
            own = np.flatnonzero(inside)
            order = np.argsort(np.concatenate([2 * own, 2 * crossed + 1]), kind="stable")
            ring = np.concatenate([ring[own], met])[order]
    return ring


def area(ring: np.ndarray) -> float:
    """Signed: positive where a ring turns clockwise to the eye, y downwards."""
    if len(ring) < 3:
        return 0.0
    x, y = (ring - ring[0]).T
    return float(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2


def _under(rings: list[np.ndarray], buffer: float) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """The four tiles under a tile, in their own pixels: (0 or 1, 0 or 1, what they have)."""
    for dx in (0, 1):
        for dy in (0, 1):
            found = [cut(2 * r - TILE_PX * np.array([dx, dy]), -buffer, TILE_PX + buffer) for r in rings]
            found = [r for r in found if abs(area(r)) > 1e-9]
            if found:
                yield dx, dy, found


def in_tiles(areas: DataFrame, max_zoom: int, from_zoom: int = 0, buffer_px: float = BUFFER_PX) -> DataFrame:
    """areas (rings in lon and lat, ...) once for each tile (z, x, y) of the levels that has a part of them, with rings in pixels from the tile's corner.

    Outer rings, counterclockwise as given, turn clockwise to the eye, as tiles have it, and inner ones the other way. Rings of fewer than three points or without
    area, and what of an area only touches a tile, are left out; an area without rings is in no tile."""
    at = lambda r, i: world_xy(r[2 * i], r[2 * i + 1])
    flat = lambda r: F.flatten(F.transform(F.sequence(F.shiftright(F.size(r), 1) - 1, F.lit(0)), lambda i: F.transform(F.array(at(r, i).x, at(r, i).y), lambda v: v * TILE_PX)))
    world = F.transform(F.filter("rings", lambda r: F.size(r) >= 6), flat)
    own = [c for c in areas.columns if c != "rings"]
    rows = areas.where("size(rings) > 0").select(F.struct(*own).alias("row"), F.lit(0).alias("z"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), world.alias("rings"))

    def split(upto: int):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    flat = [np.array(r).reshape(-1, 2) for r in batch["rings"][k].as_py()]
                    flat = [r[:-1] if len(r) > 1 and (r[0] == r[-1]).all() else r for r in flat]
                    todo, out = [(batch["z"][k].as_py(), batch["x"][k].as_py(), batch["y"][k].as_py(), flat)], []
                    while todo:
                        z, x, y, rings = todo.pop()
                        out.append((z, x, y, [r.ravel() for r in rings]))
                        if z < upto:
                            todo += [(z + 1, 2 * x + dx, 2 * y + dy, found) for dx, dy, found in _under(rings, buffer_px)]
                    z, x, y, rings = (pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.float64())))))
                    yield pa.RecordBatch.from_arrays([batch["row"].take(pa.array([k] * len(out))), z, x, y, rings], ["row", "z", "x", "y", "rings"])

        return of

    fields = f"row {rows.schema['row'].dataType.simpleString()}, z int, x long, y long, rings {RINGS}"
    found, level = [], 0
    while True:
        upto = min(level + STEP, max_zoom)
        rows = rows.mapInArrow(split(upto), fields)
        # the last level of a step is the first of the next one
        found.append(rows.where((F.col("z") >= from_zoom) & ((F.col("z") < upto) | F.lit(upto == max_zoom))))
        if upto == max_zoom:
            break
        rows, level = rows.where(F.col("z") == upto).repartition("z", "x", "y"), upto
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    # level 0 isn't cut from a tile above it, but nothing reaches beyond the map
    return out.select("row.*", "z", "x", "y", "rings")


def pixel_area(rings):
    """Area of rings as in_tiles gives them, in square pixels; holes count against it."""

    @F.pandas_udf("double")
    def of(column: pd.Series) -> pd.Series:
        return pd.Series([sum(area(np.array(r).reshape(-1, 2)) if len(r) else 0.0 for r in rows) for rows in column], dtype="float64")

    return of(rings)
