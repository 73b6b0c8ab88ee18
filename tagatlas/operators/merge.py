"""Lines of a tile that touch and look alike become one; short ones go, the rest are simplified and clipped."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagatlas.functions.tiles import world_xy
from tagatlas.operators.features import BUFFER_PX, DETAIL_ZOOM, DETAILS, TILE_PX

#: Metres below which a merged line is left out, up to a zoom level.
SHORTEST_M = {4: 1000.0, 5: 500.0, 6: 100.0, 7: 50.0}
EQUATOR_M = 40_075_016.686
TILE = ("z", "x", "y", "layer")
#: The level of the blocks in which lines are looked through for others that they meet, and the most rows of tiles made at once.
BLOCK_ZOOM, AT_ONCE = 12, 100_000


def shortest_line(z: Column) -> Column:
    """Metres below which a line is left out at a zoom level; 0 for levels that the table doesn't name."""
    out = None
    for level, metres in SHORTEST_M.items():
        out = F.when(z == level, metres) if out is None else out.when(z == level, metres)
    return F.coalesce(out, F.lit(0.0))


def merge_keys(features: DataFrame) -> DataFrame:
    """Adds no_merge, which keeps lines apart: those one-way along the line keep their arrows' direction only on their own.

    It is the feature's own id, so that a lost task computes the same again. Lines one-way against the line (-1) may merge."""
    return features.withColumn("no_merge", F.when(F.col("oneway") == 1, F.col("osm_id")))


def merge_lines(tiles: DataFrame, attributes: list[str], tolerance_px: float = 0.1, cell_px: int = 32, buffer_px: float = BUFFER_PX) -> DataFrame:
    """Rows z, x, y, layer, the attributes, n_lines and geom: what each tile draws of its lines.

    Lines with equal attributes (NULL equals NULL) that meet end to end, where no third line ends, are chained. A chain shorter
    than the table of shortest lines says is left out; the rest are simplified to within tolerance_px and cut at the tile's edge plus
    a buffer, which may leave several pieces. Lines that are not on the tile, or of fewer than two points, are left out.

    First the lines within each small cell of a tile are chained. A line that leaves its cell waits in the cell of its start, and a
    point stands for it in the cell of its end. Only what still meets a waiting line is gathered by tile; all other chains are
    finished on their own, so that no task holds all lines of a dense tile. Lines that no_merge keeps apart by their own ids meet no other and aren't shuffled; a
    column no_merge that tiles already have may keep groups of lines together, which are merged as all others."""
    keys = [*TILE, *attributes, "no_merge"]
    own = "no_merge" not in tiles.columns
    rows = (merge_keys(tiles) if own else tiles).where("size(geom) > 1")
    at = [F.floor(F.element_at("geom", i)[c] / cell_px) for i in (1, -1) for c in "xy"]
    flat = F.flatten(F.transform("geom", lambda p: F.array(p.x, p.y)))
    alone = rows.where("no_merge is not null").select(*keys, F.array(F.struct(F.lit(1).cast("bigint").alias("n_lines"), F.lit(True).alias("waits"), flat.alias("points"))).alias("lines"))
    rows = rows.where("no_merge is null") if own else rows
    rows = rows.select(*keys, *[c.alias(n) for c, n in zip(at, ("_cx", "_cy", "_lx", "_ly"))], flat.alias("points"))
    leaves = (F.col("_cx") != F.col("_lx")) | (F.col("_cy") != F.col("_ly"))
    entry = lambda x, y, n, waits, points: F.struct(F.col(x).alias("_cx"), F.col(y).alias("_cy"), F.struct(F.lit(n).cast("bigint").alias("n_lines"), waits.alias("waits"), points.alias("points")).alias("line"))
    whole, stub = entry("_cx", "_cy", 1, leaves, F.col("points")), entry("_lx", "_ly", 0, F.lit(False), F.slice("points", -2, 2))
    rows = rows.select(*keys, F.explode(F.when(leaves, F.array(whole, stub)).otherwise(F.array(whole))).alias("_e")).select(*keys, "_e.*")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    # groups are sorted by a hash first, which tells most of them apart at once
    near = rows.groupBy(F.xxhash64(*keys, "_cx", "_cy").alias("_h"), *keys, "_cx", "_cy").agg(F.collect_list("line").alias("lines")).drop("_h", "_cx", "_cy")
    near = near.mapInArrow(_by_cell(keys), f"{fields}, own bigint, line struct<n_lines: bigint, waits: boolean, points: array<double>>")
    drawn = near.groupBy(F.xxhash64(*keys, "own").alias("_h"), *keys, "own").agg(F.collect_list("line").alias("lines")).drop("_h", "own")
    drawn = drawn.unionByName(alone) if own else drawn
    out = [k for k in keys if k != "no_merge"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*out).schema)
    return drawn.mapInArrow(_by_tile(out, tolerance_px, buffer_px), f"{fields}, n_lines bigint, geom array<struct<x: double, y: double>>")


def merged(features: DataFrame, attributes: list[str], max_zoom: int, from_zoom: int = 0, beyond: bool = False, only: DataFrame | None = None, tolerance_px: float = 0.1, buffer_px: float = BUFFER_PX) -> DataFrame:
    """What merge_lines gives of features.in_tiles, for line features; of the tiles `only` (z, x, y), if given.

    A line travels once, not once for each level and tile: to the block of the map that it begins in. There those are told apart that meet no
    other line of their look at any of their points, since a tile may cut them at each. They are drawn where they are, and so are lines kept apart by
    their own ids, and all but three of lines that are wholly equal: where three end nothing is joined. Only the others are
    gathered by tile. A line that leaves its block counts as meeting others, and in the blocks of its other points it stands for itself."""
    details = [c for c in attributes if c in DETAILS]
    look = ["layer", *[c for c in attributes if c not in DETAILS]]
    margin = F.coalesce(F.col("buffer_px"), F.lit(0.0)) / TILE_PX if "buffer_px" in features.columns else F.lit(0.0)
    rows = merge_keys(features).where("size(geom) > 1").withColumn("geom", F.transform("geom", lambda p: world_xy(p.x, p.y, beyond)))
    flat = F.flatten(F.transform("geom", lambda p: F.array(p.x, p.y)))
    rows = rows.select(*look, "no_merge", "geom", F.greatest(F.col("min_zoom"), F.lit(from_zoom)).cast("int").alias("low"), margin.cast("double").alias("margin"), *details, flat.alias("points"))
    # one flow for all, which the two readers below share: with a filter in each, lines would be made twice
    blocks = F.array_distinct(F.transform("geom", lambda p: F.struct(*[F.floor(p[c] * 2.0**BLOCK_ZOOM).alias(f"_b{c}") for c in "xy"])))
    near = rows.withColumn("_n", F.when(F.col("no_merge").isNull(), blocks).otherwise(F.slice(blocks, 1, 1)))
    near = near.select("*", F.posexplode("_n").alias("_i", "_b")).select(*look, "_b.*", (F.col("_i") == 0).alias("first"), (F.size("_n") > 1).alias("leaves"), F.col("no_merge").isNotNull().alias("apart"), "low", "margin", *details, "points")
    # rows that belong together follow each other: gathered into lists by Spark they would be sorted by all of their keys
    near = near.withColumn("_h", F.xxhash64(*look, "_bx", "_by")).repartition("_h").sortWithinPartitions("_h")
    kinds = {f.name: f.dataType.simpleString() for f in features.select(*look, *details).schema}
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in ("layer", *attributes))
    place = lambda rows, which, draw: rows.mapInArrow(_by_block(["layer", *attributes], look, details, which, max_zoom, beyond, draw), f"z int, x bigint, y bigint, {fields}, n_lines bigint, geom array<struct<x: double, y: double>>")
    chosen = lambda rows: rows if only is None else rows.join(only, ["z", "x", "y"], "left_semi")
    drawn = chosen(place(near, "alone", (tolerance_px, buffer_px)))
    gathered = chosen(place(near, "meeting", None)).drop("n_lines").withColumn("no_merge", F.lit(None).cast("bigint"))
    return drawn.unionByName(merge_lines(gathered, attributes, tolerance_px, buffer_px=buffer_px))


def tiles_of(features: DataFrame, max_zoom: int, from_zoom: int = 0, beyond: bool = False) -> DataFrame:
    """Rows z, x, y, osm_id: the tiles that features.in_tiles has line features of two points or more in."""
    margin = F.coalesce(F.col("buffer_px"), F.lit(0.0)) / TILE_PX if "buffer_px" in features.columns else F.lit(0.0)
    rows = features.where("size(geom) > 1").withColumn("geom", F.transform("geom", lambda p: world_xy(p.x, p.y, beyond)))
    flat = F.flatten(F.transform("geom", lambda p: F.array(p.x, p.y)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, every = _world(batch), np.ones(len(batch), bool)
            for z, rows, tile in _in_tiles(lines, np.asarray(batch["low"]), np.asarray(batch["margin"]), every, every, max_zoom, beyond, False):
                ids = batch["osm_id"].take(pa.array(rows.group))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tile), z, np.int32)), *[pa.array(np.ascontiguousarray(tile[:, c])) for c in (0, 1)], ids], ["z", "x", "y", "osm_id"])

    return rows.select("osm_id", F.greatest(F.col("min_zoom"), F.lit(from_zoom)).cast("int").alias("low"), margin.cast("double").alias("margin"), flat.alias("points")).mapInArrow(run, f"z int, x bigint, y bigint, osm_id {dict(features.dtypes)['osm_id']}")


@dataclass
class Lines:
    """Lines of many groups in flat arrays: line i has group[i], weight n[i], and points xy[at[i]:at[i + 1]]; a line of one point stands for an end elsewhere."""

    group: np.ndarray
    n: np.ndarray
    waits: np.ndarray
    at: np.ndarray
    xy: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch) -> Lines:
        lists = batch["lines"]
        own = lists.flatten()
        n, waits, points = own.field("n_lines"), own.field("waits"), own.field("points")
        at = np.asarray(points.offsets) // 2
        xy = np.asarray(points.flatten()).reshape(-1, 2)
        return Lines(np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets))), np.asarray(n), np.asarray(waits.to_numpy(zero_copy_only=False), bool), at - at[0], xy)

    @property
    def size(self) -> np.ndarray:
        return np.diff(self.at)

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """For each end (two a line, one after the other) its vertex, -1 for a second end that a point hasn't; and how many ends each vertex has."""
        place = self.xy[np.stack([self.at[:-1], self.at[1:] - 1], 1).ravel()]
        group, real = np.repeat(self.group, 2), np.ones(2 * len(self.n), bool)
        real[1::2] = self.size > 1
        found = np.flatnonzero(real)
        order = found[np.lexsort((place[found, 1], place[found, 0], group[found]))]
        new = np.ones(len(order), bool)
        new[1:] = (group[order[1:]] != group[order[:-1]]) | (place[order[1:]] != place[order[:-1]]).any(1)
        vertex = np.full(len(real), -1)
        vertex[order] = np.cumsum(new) - 1
        return vertex, np.bincount(vertex[order], minlength=0)

    def chained(self, free: np.ndarray) -> Lines:
        """The lines that are free, joined at vertices where exactly two ends of different free lines meet; others are left out.

        A chain begins at the lesser of its ends, a ring with its least line, so the order of the input doesn't matter."""
        vertex, degree = self.ends()
        ready = np.repeat(free, 2) & (vertex >= 0)
        ready[ready] = degree[vertex[ready]] == 2
        met = np.flatnonzero(ready)
        met = met[np.argsort(vertex[met], kind="stable")]
        pair = np.flatnonzero((vertex[met[:-1]] == vertex[met[1:]]) & (met[:-1] // 2 != met[1:] // 2)) if len(met) > 1 else np.zeros(0, int)
        mate = np.full(len(vertex), -1)
        mate[met[pair]], mate[met[pair + 1]] = met[pair + 1], met[pair]
        both = mate.reshape(-1, 2)
        alone = np.flatnonzero(free & (both < 0).all(1))
        line, back, first = [], [], []
        place = self.xy[np.stack([self.at[:-1], self.at[1:] - 1], 1).ravel()]
        some = np.flatnonzero(np.repeat((both >= 0).any(1), 2) & (mate < 0))
        starts = some[np.lexsort((place[some, 1], place[some, 0], np.repeat(self.group, 2)[some]))].tolist()
        ring = np.flatnonzero((both >= 0).all(1))
        starts += (2 * ring[np.lexsort((place[2 * ring + 1, 1], place[2 * ring + 1, 0], place[2 * ring, 1], place[2 * ring, 0]))]).tolist()
        seen, to = bytearray(len(self.n)), mate.tolist()
        for e in starts:
            if seen[e >> 1]:
                continue
            begins = True
            while e >= 0 and not seen[e >> 1]:
                seen[e >> 1] = 1
                line.append(e >> 1)
                back.append(e & 1)
                first.append(begins)
                begins, e = False, to[e ^ 1]
        line = np.concatenate([alone, np.array(line, int)])
        back = np.concatenate([np.zeros(len(alone), bool), np.array(back, bool)])
        first = np.concatenate([np.ones(len(alone), bool), np.array(first, bool)])
        chain, size = np.cumsum(first) - 1, self.size[line] - ~first
        k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        start = np.where(back, self.at[line + 1] - 1 - ~first, self.at[line] + ~first)
        take = np.repeat(start, size) + np.where(np.repeat(back, size), -k, k)
        many = int(first.sum())
        at = np.concatenate([[0], np.cumsum(np.bincount(chain, weights=size, minlength=many).astype(int))])
        return Lines(self.group[line[first]], np.bincount(chain, weights=self.n[line], minlength=many).astype(np.int64), np.zeros(many, bool), at, self.xy[take])

    def subset(self, keep: np.ndarray) -> Lines:
        own = np.flatnonzero(keep)
        size = self.size[own]
        take = np.repeat(self.at[own], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return Lines(self.group[own], self.n[own], self.waits[own], np.concatenate([[0], np.cumsum(size)]), self.xy[take])

    def __add__(self, other: Lines) -> Lines:
        pairs = [(getattr(self, c), getattr(other, c)) for c in ("group", "n", "waits")]
        return Lines(*[np.concatenate(p) for p in pairs], np.concatenate([self.at, self.at[-1] + other.at[1:]]), np.concatenate([self.xy, other.xy]))


def _by_cell(keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = Lines.of(batch)
            vertex, degree = lines.ends()
            stands = np.repeat(lines.waits | (lines.size == 1), 2) & (vertex >= 0)
            # a waiting line's end lies in another cell, where a point stands for it
            stands[1::2] &= ~lines.waits
            waiting = np.bincount(vertex[stands], minlength=len(degree))
            chains = lines.chained(~lines.waits & (lines.size > 1))
            # which chains end where exactly one other end, of a waiting line, is
            places = lines.xy[np.stack([lines.at[:-1], lines.at[1:] - 1], 1).ravel()]
            meets = (degree == 2) & (waiting == 1)
            # a vertex that nothing may be joined at stays one in the second step, where some of its chains may be missing
            busy = np.zeros(len(batch), bool)
            busy[lines.group[lines.waits | (lines.size == 1)]] = True
            of_group = np.zeros(len(degree), int)
            of_group[vertex[vertex >= 0]] = np.repeat(lines.group, 2)[vertex >= 0]
            blocked = (degree > 2) & busy[of_group]
            _, some = np.unique(vertex, return_index=True)
            some = some[vertex[some] >= 0]

            def stub(mask: np.ndarray) -> Lines:
                at = some[mask[vertex[some]]]
                return Lines(lines.group[at // 2], np.zeros(len(at), np.int64), np.zeros(len(at), bool), np.arange(len(at) + 1), places[at])

            open_ends = chains + stub(meets)
            v, _ = open_ends.ends()
            touched = np.zeros(v.max() + 1 if len(v) else 0, bool)
            touched[v[2 * len(chains.n) :: 2]] = True
            pairs = v[: 2 * len(chains.n)].reshape(-1, 2)
            done = ~touched[pairs].any(1) if len(pairs) else np.zeros(0, bool)
            out = chains + lines.subset(lines.waits) + stub(blocked)
            # what is done gets a number by its ends, so that it isn't gathered, and a mark, so that it stays as it is
            own, ready = np.zeros(len(out.n), np.int64), np.zeros(len(out.n), bool)
            ready[: len(done)] = done
            bits = np.concatenate([out.xy[out.at[:-1]], out.xy[out.at[1:] - 1]], 1).view(np.int64)
            own[ready] = ((bits * np.array([31, 1_000_003, 8191, 131])).sum(1) | 1)[ready]
            points = pa.ListArray.from_arrays(pa.array(2 * out.at, pa.int32()), pa.array(out.xy.ravel()))
            line = pa.StructArray.from_arrays([pa.array(out.n), pa.array(ready), points], ["n_lines", "waits", "points"])
            taken = batch.select(keys).take(pa.array(out.group))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(own), line], [*keys, "own", "line"])

    return run


def _world(batch: pa.RecordBatch) -> Lines:
    """The lines of a batch, each a row, on a map of side 1."""
    points, n = batch["points"], len(batch)
    at = np.asarray(points.offsets) // 2
    xy = points.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 2)
    return Lines(np.arange(n), np.ones(n, np.int64), np.zeros(n, bool), at - at[0], xy)


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches, sorted by a key, in other pieces: rows of one key are in one of them."""
    ready: list[pa.RecordBatch] = []
    last: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        seen = batch[key].to_numpy()
        at = int(np.searchsorted(seen, seen[-1]))
        if at == 0 and last and last[-1][key][0].as_py() == seen[-1]:
            last.append(batch)
            continue
        ready, last = [*ready, *last, batch.slice(0, at)], [batch.slice(at)]
        if sum(map(len, ready)) >= AT_ONCE // 2:
            yield pa.concat_batches(ready)
            ready = []
    if ready or last:
        yield pa.concat_batches([*ready, *last])


def _codes(columns: list[pa.Array], code: np.ndarray) -> np.ndarray:
    """Numbers that are equal where these values (NULL equals NULL) and the numbers before are."""
    most = int(code.max(initial=0)) + 1
    for c in columns:
        told = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        several = int(told.max(initial=0)) + 1
        if most * several >= 2**62:
            code = np.unique(code, return_inverse=True)[1]
            most = int(code.max(initial=0)) + 1
        code, most = code * several + told, most * several
    return code


def _by_block(keys: list[str], look: list[str], details: list[str], which: str, max_zoom: int, beyond: bool, draw: tuple[float, float] | None):
    """Rows of tiles, of lines that meet no others (alone) or do (meeting); as the tile draws them, or whole if draw says nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, "_h"):
            lines = _world(batch)
            low, margin = np.asarray(batch["low"]), np.asarray(batch["margin"])
            first, leaves, apart = (batch[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("first", "leaves", "apart"))
            # below the level of details, and from it on
            code = _codes([batch[c] for c in (*look, "_bx", "_by")], np.zeros(len(batch), np.int64))
            touched = _touched(lines, code, ~apart) | leaves
            plain = full = _few(lines, code, low, margin, touched & first)
            if max_zoom >= DETAIL_ZOOM and details:
                code = _codes([batch[c] for c in details], code)
                full = _few(lines, code, low, margin, (_touched(lines, code, touched) | leaves) & first)
            of = (lambda met: met) if which == "meeting" else (lambda met: ~met & first)
            for z, rows, tile in _in_tiles(lines, low, margin, of(plain), of(full), max_zoom, beyond):
                source = rows.group
                if draw:
                    rows.group = np.arange(len(rows.n))
                    rows = _drawn(rows, np.full(len(tile), z), tile[:, 1], *draw)
                    tile, source = tile[rows.group], source[rows.group]
                n, taken, hidden = len(tile), pa.array(source), details if z < DETAIL_ZOOM else ()
                said = [pa.nulls(n, batch[c].type) if c in hidden else batch[c].take(taken) for c in keys]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, z, np.int32)), *[pa.array(np.ascontiguousarray(tile[:, c])) for c in (0, 1)], *said, pa.array(rows.n), _points(rows)], ["z", "x", "y", *keys, "n_lines", "geom"])

    return run


def _touched(lines: Lines, code: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of the lines share a point with another one of their code."""
    out = np.zeros(len(lines.n), bool)
    of = np.repeat(np.arange(len(lines.n)), lines.size)
    seen = np.flatnonzero(among[of])
    if not len(seen):
        return out
    order = seen[np.lexsort((lines.xy[seen, 1], lines.xy[seen, 0], code[of[seen]]))]
    own, place = of[order], lines.xy[order]
    start = np.flatnonzero(np.concatenate([[True], (code[own[1:]] != code[own[:-1]]) | (place[1:] != place[:-1]).any(1)]))
    several = np.minimum.reduceat(own, start) != np.maximum.reduceat(own, start)
    out[own[np.repeat(several, np.diff(np.append(start, len(own))))]] = True
    return out


def _few(lines: Lines, code: np.ndarray, low: np.ndarray, margin: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Those lines among which at most three are wholly equal: the others are in the same tiles as these, where nothing is joined to them."""
    out, seen = np.zeros(len(lines.n), bool), {}
    found = np.flatnonzero(among)
    data, width = lines.xy.tobytes(), 2 * lines.xy.itemsize
    for i, *said, a, b in zip(*[c.tolist() for c in (found, code[found], low[found], margin[found], width * lines.at[found], width * lines.at[found + 1])]):
        key = (*said, data[a:b])
        seen[key] = n = seen.get(key, 0) + 1
        out[i] = n <= 3
    return out


def _in_tiles(lines: Lines, low: np.ndarray, margin: np.ndarray, plain: np.ndarray, full: np.ndarray, max_zoom: int, beyond: bool, shaped: bool = True) -> Iterator[tuple[int, Lines, np.ndarray]]:
    """A level, lines in pixels of tiles (their group is the line's number) and the tiles' x and y; plain lines below the level of details, full ones from it on.

    As in features.in_tiles: in each tile that a leg may meet, from the first of these legs to the last. Unless shaped, their points aren't made."""
    leg_of = np.repeat(np.arange(len(lines.n)), lines.size - 1)
    leg_at = np.delete(np.arange(len(lines.xy)), lines.at[1:] - 1)
    known = np.isfinite(lines.xy).all(1)
    for z in range(int(low.min(initial=max_zoom + 1)), max_zoom + 1):
        here = np.flatnonzero((plain if z < DETAIL_ZOOM else full)[leg_of] & (low[leg_of] <= z) & known[leg_at] & known[leg_at + 1])
        side, of, at = 2.0**z, leg_of[here], leg_at[here]
        a, b, m = lines.xy[at], lines.xy[at + 1], margin[of][:, None]
        first, last = np.floor(np.minimum(a, b) * side - m).astype(np.int64), np.floor(np.maximum(a, b) * side + m).astype(np.int64)
        for c in range(1 if beyond else 2):
            first[:, c], last[:, c] = np.maximum(first[:, c], 0), np.minimum(last[:, c], (1 << z) - 1)
        wide = np.maximum(last - first + 1, 0)
        many = wide.prod(1)
        # legs of one line stay together
        upto = np.cumsum(many)
        ends = np.append(np.flatnonzero(of[1:] != of[:-1]) + 1, len(of)) if len(of) else np.zeros(0, int)
        done = 0
        while done < len(of):
            enough = np.searchsorted(upto[ends - 1], (upto[done - 1] if done else 0) + AT_ONCE, side="right")
            nth = max(int(enough) - 1, int(np.searchsorted(ends, done, side="right")))
            part, done = slice(done, int(ends[nth])), int(ends[nth])
            leg = np.repeat(np.arange(part.start, part.stop), many[part])
            if not len(leg):
                continue
            k = np.arange(len(leg)) - np.repeat(np.cumsum(many[part]) - many[part], many[part])
            tile = first[leg] + np.stack([k // wide[leg, 1], k % wide[leg, 1]], 1)
            until = leg
            if (of[part][1:] == of[part][:-1]).any():
                order = np.lexsort((leg, tile[:, 1], tile[:, 0], of[leg]))
                same = (of[leg[order[1:]]] == of[leg[order[:-1]]]) & (tile[order[1:]] == tile[order[:-1]]).all(1)
                begins = np.flatnonzero(np.concatenate([[True], ~same]))
                tile, until, leg = tile[order[begins]], leg[order[np.append(begins[1:], len(order)) - 1]], leg[order[begins]]
            size = at[until] - at[leg] + 2 if shaped else np.zeros(len(leg), int)
            k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            xy = (lines.xy[np.repeat(at[leg], size) + k] * side - np.repeat(tile, size, axis=0)) * TILE_PX
            yield z, Lines(of[leg], np.ones(len(leg), np.int64), np.zeros(len(leg), bool), np.concatenate([[0], np.cumsum(size)]), xy), tile


def _by_tile(keys: list[str], tolerance: float, buffer_px: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = Lines.of(batch)
            chains = lines.chained(~lines.waits & (lines.size > 1)) + lines.subset(lines.waits)
            pieces = _drawn(chains, batch["z"].to_numpy(), batch["y"].to_numpy(), tolerance, buffer_px)
            taken = batch.select(keys).take(pa.array(pieces.group))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(pieces.n), _points(pieces)], [*keys, "n_lines", "geom"])

    return run


def _points(lines: Lines) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(lines.at, pa.int32()), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(lines.xy[:, c])) for c in (0, 1)], ["x", "y"]))


def _drawn(chains: Lines, z: np.ndarray, y: np.ndarray, tolerance: float, buffer_px: float) -> Lines:
    """What tiles draw of chains, each of the tile of its group: those long enough, simplified and clipped."""
    of = np.repeat(np.arange(len(chains.n)), chains.size)
    step = np.hypot(*np.diff(chains.xy, axis=0, prepend=chains.xy[:1]).T) if len(of) else np.zeros(0)
    step[chains.at[:-1]] = 0
    least = np.array([SHORTEST_M.get(k, 0.0) for k in range(int(z.max(initial=0)) + 1)])[z] / _metres_per_pixel(z.astype(float), y.astype(float))
    chains = chains.subset(np.bincount(of, weights=step, minlength=len(chains.n)) >= least[chains.group])
    return _cut(chains, tolerance, -buffer_px, TILE_PX + buffer_px)


def _cut(chains: Lines, tolerance: float, low: float, high: float) -> Lines:
    """Chains simplified and clipped. Straight ones and those within the square, most of all, are dealt with at once."""
    if not len(chains.n):
        return chains
    size, start = chains.size, chains.at[:-1]
    of = np.repeat(np.arange(len(size)), size)
    base, inner = (chains.xy[chains.at[1:] - 1] - chains.xy[start])[of], chains.xy - chains.xy[start][of]
    long2 = (base * base).sum(1)
    along = np.clip(np.divide((inner * base).sum(1), long2, out=np.zeros(len(of)), where=long2 > 0), 0, 1)
    off = np.hypot(*(inner - along[:, None] * base).T)
    straight = np.maximum.reduceat(off, start) <= tolerance
    keep = ~straight[of]
    keep[start] = keep[chains.at[1:] - 1] = True
    within = np.logical_and.reduceat(((chains.xy >= low) & (chains.xy <= high)).all(1), start)
    easy = straight & within
    slim = Lines(chains.group, chains.n, chains.waits, np.concatenate([[0], np.cumsum(np.bincount(of, weights=keep).astype(int))]), chains.xy[keep])
    out = slim.subset(easy)
    short = np.flatnonzero(~easy & (slim.size == 2))
    if len(short):
        xy, met = _clipped(slim.xy[slim.at[short]], slim.xy[slim.at[short] + 1], low, high)
        short = short[met]
        out += Lines(slim.group[short], slim.n[short], np.zeros(len(short), bool), 2 * np.arange(len(short) + 1), xy[met].reshape(-1, 2))
    rest, group, n = [], [], []
    for i in np.flatnonzero(~easy & (slim.size != 2)).tolist():
        for piece in clip(simplify(slim.xy[slim.at[i] : slim.at[i + 1]], tolerance), low, high):
            rest.append(piece)
            group.append(slim.group[i])
            n.append(slim.n[i])
    if rest:
        out += Lines(np.array(group), np.array(n, np.int64), np.zeros(len(n), bool), np.concatenate([[0], np.cumsum([len(p) for p in rest])]), np.concatenate(rest))
    return out


def _clipped(a: np.ndarray, b: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """clip() for many lines of two points: each one's part, and whether it has one."""
    d, enter, leave = b - a, np.zeros(len(a)), np.ones(len(a))
    for c in (0, 1):
        still, begins = d[:, c] == 0, a[:, c]
        by = np.where(still, 1.0, d[:, c])
        t0, t1 = (low - begins) / by, (high - begins) / by
        enter = np.where(still, np.where((low <= begins) & (begins <= high), enter, 2.0), np.maximum(enter, np.minimum(t0, t1)))
        leave = np.where(still, leave, np.minimum(leave, np.maximum(t0, t1)))
    first, last = np.where(enter[:, None] > 0, a + enter[:, None] * d, a), np.where(leave[:, None] < 1, a + leave[:, None] * d, b)
    return np.stack([first, last], 1), enter < leave


def _metres_per_pixel(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    north = np.pi * (1 - 2 * (y + 0.5) / 2.0**z)
    return EQUATOR_M / (TILE_PX * 2.0**z * np.cosh(north))


def chain(lines: list[np.ndarray], weights: list[int]) -> list[tuple[np.ndarray, int]]:
    """Lines joined at ends where exactly two ends meet, each with the summed weight; a closed line stays as it is.

    A line of one point only stands for an end of a line elsewhere. The order of the input doesn't matter."""
    at = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(int)
    flat = Lines(np.zeros(len(lines), int), np.array(weights, np.int64), np.zeros(len(lines), bool), at, np.concatenate(lines))
    out = flat.chained(flat.size > 1)
    return [(out.xy[out.at[i] : out.at[i + 1]], int(out.n[i])) for i in range(len(out.n))]


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Leaves out points that lie within the tolerance of the line through those that stay; the ends always stay."""
    keep = np.zeros(len(points), dtype=bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        base, inner = points[b] - points[a], points[a + 1 : b] - points[a]
        long2 = float(base @ base)
        along = np.clip(inner @ base / long2, 0, 1) if long2 else np.zeros(len(inner))
        off = np.hypot(*(inner - along[:, None] * base).T)
        far = int(off.argmax())
        if off[far] > tolerance:
            keep[a + 1 + far] = True
            todo += [(a, a + 1 + far), (a + 1 + far, b)]
    return points[keep]


def clip(points: np.ndarray, low: float, high: float) -> Iterator[np.ndarray]:
    """The parts of a line within a square; each has two points at least."""
    part: list[np.ndarray] = []
    for a, b in zip(points[:-1], points[1:]):
        enter, leave = 0.0, 1.0
        for d, start in zip(b - a, a):
            if d == 0:
                enter = enter if low <= start <= high else 2.0
            else:
                t0, t1 = sorted(((low - start) / d, (high - start) / d))
                enter, leave = max(enter, t0), min(leave, t1)
        if enter >= leave:
            if len(part) > 1:
                yield np.array(part)
            part = []
            continue
        first, last = a + enter * (b - a) if enter > 0 else a, a + leave * (b - a) if leave < 1 else b
        if part and enter > 0:
            yield np.array(part)
            part = []
        part = part or [first]
        part.append(last)
        if leave < 1:
            yield np.array(part)
            part = []
    if len(part) > 1:
        yield np.array(part)
