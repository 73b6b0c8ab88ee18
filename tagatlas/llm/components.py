"""Connected components of a large, sparse graph with DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagatlas.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge; root is the least node that it reaches.

    edges has u and v (bigint); loops, repeats, either direction and nulls (left out) are allowed. Large-star and
    small-star steps take turns: every node hooks its greater, then its lesser neighbours to the least one it knows.
    The minimum of each node is aggregated map-side first and joined back, so a node with very many neighbours is no
    group in one task. Each round is kept in the shared folder; the rounds grow with the logarithm of a path's length.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, seen = cut(e), None
    while True:
        mark = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen or mark[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = mark
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = cut(small.select("x.u", "x.v").where("u <> v").distinct())
