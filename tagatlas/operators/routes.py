"""Which bicycle routes run over a way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagatlas.functions.tags import equals, tag


def bicycle_routes(relations: DataFrame) -> DataFrame:
    return relations.where(equals(tag("type"), "route") & equals(tag("route"), "bicycle"))


def route_ways(relations: DataFrame, members: DataFrame | None = None, dedupe_members: bool = True) -> DataFrame:
    """Pairs way_id, relation_id of ways on bicycle routes. Members are those in the relations' own array, or rows (relation_id, type, ref).

    A way that is several times a member of one route counts once, unless dedupe_members is false."""
    kept = bicycle_routes(relations)
    if members is None:
        rows = kept.select("relation_id", F.explode("members").alias("m")).select("relation_id", "m.type", "m.ref")
    else:
        rows = members.join(kept.select("relation_id"), "relation_id", "left_semi")
    rows = rows.where("type = 'way' and ref is not null").select(F.col("ref").alias("way_id"), "relation_id")
    return rows.distinct() if dedupe_members else rows


def with_routes(ways: DataFrame, relations: DataFrame, members: DataFrame | None = None, dedupe_members: bool = True) -> DataFrame:
    """Ways with routes: ids of the bicycle routes over them, ascending and comma-separated; NULL for none. All ways stay.

    The lists are built on the route side, which is small beside the ways; whether it is broadcast is left to its measured size."""
    lists = (
        route_ways(relations, members, dedupe_members)
        .groupBy("way_id")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list("relation_id")), lambda i: i.cast("string")), ",").alias("routes"))
    )
    return ways.drop("routes").join(lists, "way_id", "left")
