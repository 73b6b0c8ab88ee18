"""Shapes of ways from the places of their nodes, and what a way may be drawn as."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagatlas.functions.tags import differs, equals, tag

#: Types of relations that are areas.
AREA_TYPES = ("multipolygon", "boundary")


def with_geometry(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ways (way_id, nodes, ...) with geom, the places (x lon, y lat) of their nodes in order. Nodes: node_id, lon, lat.

    Unknown nodes are left out; a way of which none is known has an empty geom. The join is by node, so a node that many ways pass is
    a key of as many rows as there are ways through it, which stays small; the lists gathered are of one way each."""
    empty = F.expr("cast(array() as array<struct<x:double,y:double>>)")
    return ways.drop("geom").join(shapes(ways, nodes), "way_id", "left").withColumn("geom", F.coalesce("geom", empty))


def shapes(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way_id, geom) of ways of which a node is known."""
    legs = ways.select("way_id", F.posexplode("nodes").alias("_i", "node_id"))
    placed = legs.join(nodes.select("node_id", "lon", "lat"), "node_id")
    return placed.groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "lon", "lat"))), lambda p: F.struct(p.lon.alias("x"), p.lat.alias("y"))).alias("geom"))


def closed(nodes: Column) -> Column:
    return F.coalesce((F.size(nodes) >= 4) & (nodes[0] == F.try_element_at(nodes, F.lit(-1))), F.lit(False))


def capabilities(ways: DataFrame) -> DataFrame:
    """Adds is_point, can_be_line and can_be_polygon. A closed way may be both line and area unless its area tag says which."""
    ring = closed(F.col("nodes"))
    return ways.withColumns({
        "is_point": F.lit(False),
        "can_be_line": (F.size("nodes") >= 2) & ~(ring & equals(tag("area"), "yes")),
        "can_be_polygon": ring & differs(tag("area"), "no"),
    })


def relation_areas(relations: DataFrame, ways: DataFrame) -> DataFrame:
    """Relations (relation_id, members, tags) that are areas: osm_id, tags and geom. Ways: way_id, nodes, geom.

    geom is one path through all rings, outer ones counterclockwise and inner ones clockwise; the legs between rings are walked both
    ways, so sums over the path (area, centre) are those of the area without its holes. Lines are joined where they share end nodes.
    Ways that are unknown or lack nodes, and lines that close no ring, are left out; without an outer ring a relation is no area.
    A relation's members meet in one row, as a relation is one feature."""
    lines = relation_lines(relations, ways)

    @F.pandas_udf("array<double>")
    def path(lists: pd.Series) -> pd.Series:
        return pd.Series([_path(lines) for lines in lists], dtype=object)

    shapes = lines.select("relation_id", path("_l").alias("_p")).where(F.size("_p") > 0)
    geom = F.transform(F.sequence(F.lit(0), F.size("_p") - 2, F.lit(2)), lambda i: F.struct(F.col("_p")[i].alias("x"), F.col("_p")[i + 1].alias("y")))
    return relations.join(shapes.select("relation_id", geom.alias("geom")), "relation_id").select(F.col("relation_id").alias("osm_id"), "tags", "geom")


def relation_lines(relations: DataFrame, ways: DataFrame) -> DataFrame:
    """(relation_id, _l) of relations that are areas: their member lines in order, with nodes, points and whether they are inner."""
    wanted = relations.where(F.coalesce(tag("type").isin(*AREA_TYPES), F.lit(False))).select("relation_id", "tags", "members")
    parts = wanted.select("relation_id", F.posexplode("members").alias("_i", "m")).where("m.type = 'way'").select("relation_id", "_i", F.col("m.ref").alias("way_id"), F.coalesce(F.col("m.role") == "inner", F.lit(False)).alias("inner"))
    flat = F.flatten(F.transform("geom", lambda p: F.array(p.x, p.y)))
    known = ways.where((F.size("nodes") >= 2) & (F.size("nodes") == F.size("geom"))).select("way_id", "nodes", flat.alias("points"))
    return parts.join(known, "way_id").groupBy("relation_id").agg(F.array_sort(F.collect_list(F.struct("_i", "inner", "nodes", "points"))).alias("_l"))


def _path(lines: list[dict]) -> list[float]:
    """Coordinates x, y, x, y ... of the path through the rings of an area; empty if it has no outer ring."""
    out: list[tuple[float, float]] = []
    for ring in turned_rings(lines):
        out += ring
        out.append(out[0])
    return [float(v) for p in out for v in p]


def turned_rings(lines: list[dict]) -> list[list[tuple[float, float]]]:
    """The rings of an area, outer ones first and counterclockwise, inner ones clockwise; none if it has no outer ring."""
    places = {n: (x, y) for line in lines for n, x, y in zip(line["nodes"], line["points"][::2], line["points"][1::2])}
    out: list[list[tuple[float, float]]] = []
    for inner in (False, True):
        for ring in rings([list(line["nodes"]) for line in lines if bool(line["inner"]) == inner]):
            points = [places[n] for n in ring]
            (x0, y0), turn = points[0], 0.0
            for (ax, ay), (bx, by) in zip(points, points[1:]):
                turn += (ax - x0) * (by - y0) - (bx - x0) * (ay - y0)
            out.append(points if (turn < 0) == inner else points[::-1])
        if not out:
            break
    return out


def rings(lines: list[list[int]]) -> list[list[int]]:
    """Closed rings of nodes (first one last again) from lines that meet at their ends. Each line is used once, a repeated one too."""
    at_end: dict[int, list[int]] = {}
    for k, line in enumerate(lines):
        at_end.setdefault(line[0], []).append(k)
        at_end.setdefault(line[-1], []).append(k)
    used, out = [False] * len(lines), []
    for k in range(len(lines)):
        if used[k]:
            continue
        used[k] = True
        # lines walked so far, each from the node where the one before has ended; a node met again closes a ring
        walk, met = [lines[k]], {lines[k][0]: 0}
        while walk:
            end = walk[-1][-1]
            if end in met:
                ring = [end, *(n for line in walk[met[end] :] for n in line[1:])]
                if len(ring) >= 4:
                    out.append(ring)
                del walk[met[end] :]
                met = {line[0]: i for i, line in enumerate(walk)}
                continue
            met[end] = len(walk)
            follow = at_end[end]
            while follow and used[follow[-1]]:
                follow.pop()
            if not follow:
                # a dead end: what led here closes nothing
                walk.pop()
                met = {line[0]: i for i, line in enumerate(walk)}
                continue
            n = follow.pop()
            used[n] = True
            walk.append(lines[n] if lines[n][0] == end else lines[n][::-1])
    return out
