"""Tile directories as tables: decoding, run-length encoding and the search for a tile's entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A directory tree has so many levels at most.
DEPTH = 4


def decoded(raw: DataFrame, directory: str = "directory") -> DataFrame:
    """Entries tile_id, run_length, offset, length from rows (directory, i, delta, run_length, length, raw_offset).

    Ids are running sums of the deltas. A raw offset of 0 means right behind the entry before; others are one too high (so 0 at
    the first entry gives -1). The windows are within one directory, which its format keeps small."""
    w = Window.partitionBy(directory).orderBy("i")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = raw.withColumn("tile_id", F.sum("delta").over(so_far))
    rows = rows.withColumn("_island", F.sum(F.when((F.col("raw_offset") != 0) | (F.col("i") == 0), 1).otherwise(0)).over(so_far))
    inside = Window.partitionBy(directory, "_island").orderBy("i")
    before = F.coalesce(F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("offset", F.first("raw_offset").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1 + before).select(directory, "i", "tile_id", "run_length", "offset", "length")


def encoded(entries: DataFrame, directory: str = "directory") -> DataFrame:
    """The inverse of decoded, for entries (directory, tile_id, run_length, offset, length)."""
    w = Window.partitionBy(directory).orderBy("tile_id")
    follows = F.coalesce(F.col("offset") == F.lag(F.col("offset") + F.col("length")).over(w), F.lit(False))
    return entries.select(
        directory, (F.row_number().over(w) - 1).alias("i"), (F.col("tile_id") - F.coalesce(F.lag("tile_id").over(w), F.lit(0))).alias("delta"),
        "run_length", "length", F.when(follows, 0).otherwise(F.col("offset") + 1).alias("raw_offset"),
    )


def runs(tiles: DataFrame, block_bits: int = 16) -> DataFrame:
    """Rows (archive, tile_id, offset, length), one per tile, become runs of consecutive ids with one place: (archive, tile_id, run_length, offset, length).

    Runs are found within blocks of ids, so that neither a large archive nor one blob behind a third of all tiles lands in one
    task; then only the runs at the blocks' edges, two per block, are put together."""
    return joined_runs(block_runs(tiles, block_bits), block_bits)


def block_runs(tiles: DataFrame, block_bits: int = 16) -> DataFrame:
    """The first step of runs(): runs that end where a block of ids ends."""
    block = F.expr(f"shiftright(tile_id, {block_bits})")
    w = Window.partitionBy("archive", "_block").orderBy("tile_id")
    same = (F.lag("tile_id").over(w) + 1 == F.col("tile_id")) & (F.lag("offset").over(w) == F.col("offset")) & (F.lag("length").over(w) == F.col("length"))
    rows = tiles.withColumn("_block", block).withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = rows.groupBy("archive", "_block", "_run", "offset", "length").agg(F.min("tile_id").alias("tile_id"), F.count("*").alias("run_length"))
    return found.select("archive", "tile_id", "run_length", "offset", "length")


def joined_runs(found: DataFrame, block_bits: int = 16) -> DataFrame:
    """The second step: puts together the runs at the blocks' edges. It reads found twice, which may be a table where there are many runs."""
    inside = F.lit((1 << block_bits) - 1)
    edge = (F.col("tile_id").bitwiseAND(inside) == 0) | ((F.col("tile_id") + F.col("run_length")).bitwiseAND(inside) == 0)
    plain = ("archive", "tile_id", "run_length", "offset", "length")
    inner = found.where(~edge).select(*plain)
    v = Window.partitionBy("archive").orderBy("tile_id")
    joins = (F.lag(F.col("tile_id") + F.col("run_length")).over(v) == F.col("tile_id")) & (F.lag("offset").over(v) == F.col("offset")) & (F.lag("length").over(v) == F.col("length"))
    edges = found.where(edge).withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    edges = edges.withColumn("_run", F.sum("_new").over(v.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = edges.groupBy("archive", "_run", "offset", "length").agg(F.min("tile_id").alias("tile_id"), F.sum("run_length").alias("run_length"))
    return inner.unionByName(joined.select(*plain))


def flattened(directories: DataFrame) -> DataFrame:
    """Tile entries (archive, tile_id, run_length, offset, length) of all directories reachable from the root.

    Directories: (archive, directory, tile_id, run_length, offset, length), where directory is NULL in the root and the leaf's offset
    elsewhere; an entry of run length 0 points to the leaf at its offset. More than four levels are an error."""
    plain = ("archive", "tile_id", "run_length", "offset", "length")
    level = directories.where("directory is null").select(*plain)
    leaves = directories.where("directory is not null")
    out = level.where("run_length > 0")
    for _ in range(DEPTH - 1):
        level = leaves.join(level.where("run_length = 0").select("archive", F.col("offset").alias("directory")).distinct(), ["archive", "directory"]).select(*plain)
        out = out.unionByName(level.where("run_length > 0"))
    # a pointer in the last level leads deeper than any reader follows
    too_deep = level.where("run_length = 0").select("archive", "tile_id", F.raise_error(F.lit("tile directories are nested too deeply")).cast("bigint").alias("run_length"), "offset", "length")
    return out.unionByName(too_deep)


def range_lookup(requests: DataFrame, entries: DataFrame, block_bits: int = 8) -> DataFrame:
    """Requests (archive, tile_id, ...) with the entry whose run holds their tile: entry_id, offset, length, NULL where none does.

    A run is listed in every block of ids that it meets, so the join is by equality of the block; the range only filters within it."""
    end = F.col("tile_id") + F.col("run_length") - 1
    blocks = F.sequence(F.shiftright("tile_id", block_bits), F.shiftright(end, block_bits))
    listed = entries.where("run_length > 0").select(
        F.col("archive").alias("_a"), F.explode(blocks).alias("_b"), F.col("tile_id").alias("entry_id"), end.alias("_end"), "offset", "length"
    )
    asked = requests.drop("entry_id", "offset", "length").alias("q")
    hit = (F.col("q.archive") == F.col("_a")) & (F.shiftright("q.tile_id", block_bits) == F.col("_b")) & F.col("q.tile_id").between(F.col("entry_id"), F.col("_end"))
    return asked.join(listed, hit, "left").drop("_a", "_b", "_end")


def asof_lookup(requests: DataFrame, entries: DataFrame, block_bits: int = 12) -> DataFrame:
    """The same answer as range_lookup, by order instead of ranges: the last entry at or below each request, if its run reaches so far.

    Requests and entries are sorted together within blocks of ids; what a block needs from those before it is their last entry alone."""
    place = F.struct("tile_id", "run_length", "offset", "length")
    block = F.shiftright("tile_id", block_bits)
    rows = entries.where("run_length > 0").select("archive", "tile_id", block.alias("_b"), place.alias("_e"), F.lit(None).cast(requests.schema).alias("_q"))
    last = rows.groupBy("archive", "_b").agg(F.max("_e").alias("_last"))
    asked = requests.select("archive", "tile_id", block.alias("_b"), F.lit(None).cast(rows.schema["_e"].dataType).alias("_e"), F.struct(*requests.columns).alias("_q"))
    # blocks are few: one row for each block of ids that has entries or requests
    marks = asked.select("archive", "_b").distinct().join(last, ["archive", "_b"], "full")
    carry = Window.partitionBy("archive").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.select("archive", "_b", F.last("_last", ignorenulls=True).over(carry).alias("_before"))
    w = Window.partitionBy("archive", "_b").orderBy("tile_id", F.col("_q").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.unionByName(asked).withColumn("_e", F.last("_e", ignorenulls=True).over(w)).where("_q is not null")
    found = found.join(marks, ["archive", "_b"], "left").withColumn("_e", F.coalesce("_e", "_before"))
    hit = F.col("_q.tile_id") < F.col("_e.tile_id") + F.col("_e.run_length")
    kept = [c for c in requests.columns if c not in ("entry_id", "offset", "length")]
    got = found.select(*[F.col(f"_q.{c}").alias(c) for c in kept], *[F.when(hit, F.col(f"_e.{a}")).alias(b) for a, b in (("tile_id", "entry_id"), ("offset", "offset"), ("length", "length"))])
    # a request without an archive or an id meets no window neighbour and finds nothing
    return got


def numbered(rows: DataFrame, block: list[str], within: list[str]) -> DataFrame:
    """Adds place, the number of each row from 1 on by block and then by within, which together tell rows apart.

    Rows are numbered within their block. What came before is summed over the blocks' counts level by level: within the blocks that
    share all but the last column, then over those groups, so that only values of the first column meet in one window."""
    counts = rows.groupBy(*block).agg(F.count("*").alias("_n"))
    before = None
    for k in range(len(block), 0, -1):
        level = counts.groupBy(*block[:k]).agg(F.sum("_n").alias("_n"))
        w = (Window.partitionBy(*block[: k - 1]) if k > 1 else Window.partitionBy(F.lit(0))).orderBy(block[k - 1]).rowsBetween(Window.unboundedPreceding, -1)
        level = level.select(*block[:k], F.coalesce(F.sum("_n").over(w), F.lit(0)).alias(f"_b{k}"))
        before = level if before is None else before.join(level, block[:k])
    inside = F.row_number().over(Window.partitionBy(*block).orderBy(*within))
    parts = [f"_b{k}" for k in range(1, len(block) + 1)]
    return rows.join(before, block).withColumn("place", sum((F.col(p) for p in parts), inside)).drop(*parts)


def legacy_order(entries: DataFrame) -> DataFrame:
    """The order of a version 1 directory: tiles by z, x, y, then pointers to leaves."""
    return entries.orderBy("is_dir", "z", "x", "y")


def legacy_lookup(requests: DataFrame, root: DataFrame, leaves: DataFrame) -> DataFrame:
    """Requests (archive, z, x, y) with offset and length from version 1 and 2 directories (archive, z, x, y, is_dir, offset, length; leaves also directory).

    A tile is sought in the root, else in the leaf that the root lists for its ancestor on the level of the root's last pointer."""
    exact = root.where("not is_dir").select("archive", "z", "x", "y", F.col("offset").alias("_o"), F.col("length").alias("_l"))
    pointers = root.where("is_dir")
    level = pointers.groupBy("archive").agg(F.max_by("z", F.struct("z", "x", "y")).alias("_level"))
    found = requests.join(exact, ["archive", "z", "x", "y"], "left").join(level, "archive", "left")
    up = F.expr("cast(z - _level as int)")
    found = found.withColumn("_px", F.when(up >= 0, F.expr("shiftright(x, cast(z - _level as int))"))).withColumn("_py", F.when(up >= 0, F.expr("shiftright(y, cast(z - _level as int))")))
    leaf = pointers.select("archive", F.col("z").alias("_level"), F.col("x").alias("_px"), F.col("y").alias("_py"), F.col("offset").alias("directory"))
    found = found.join(leaf, ["archive", "_level", "_px", "_py"], "left")
    inside = leaves.where("not is_dir").select("archive", "directory", "z", "x", "y", F.col("offset").alias("_lo"), F.col("length").alias("_ll"))
    found = found.join(inside, ["archive", "directory", "z", "x", "y"], "left")
    return found.select(*requests.columns, F.coalesce("_o", "_lo").alias("offset"), F.coalesce("_l", "_ll").alias("length"))
