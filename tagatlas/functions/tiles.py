"""Tile arithmetic as column expressions: Hilbert ids, their inverse, and web-mercator tile coordinates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

MAX_ZOOM = 26
#: A square of the map is cut off where the mercator projection becomes a square.
MAX_LATITUDE = math.degrees(math.atan(math.sinh(math.pi)))


def _long(value: int | Column) -> Column:
    return F.lit(value).cast("bigint")


def first_id(z: Column) -> Column:
    """The number of tiles on all levels above z, which is the first id of the level: (4^z - 1) / 3."""
    return ((F.call_function("shiftleft", _long(1), (2 * z).cast("int")) - 1) / 3).cast("bigint")


@F.pandas_udf(LongType())
def _curve_place(z: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
    """The place of x, y along the curve of level z, bit by bit for a whole batch; none is null."""
    z, x, y = (c.to_numpy(np.int64) for c in (z, x, y))
    d = np.zeros(len(z), np.int64)
    for bit in reversed(range(int(z.max(initial=0)))):
        half, on = np.int64(1 << bit), z > bit
        right, low = (x & half) > 0, (y & half) > 0
        d = np.where(on, d * 4 + np.where(right, np.where(low, 2, 3), low), d)
        # below the quadrant's own bit only the remainder matters, so a flip is a complement of the lower bits
        flip = np.where(right & ~low, half - 1, 0)
        fx, fy = (x & (half - 1)) ^ flip, (y & (half - 1)) ^ flip
        x, y = np.where(on, np.where(low, fx, fy), x), np.where(on, np.where(low, fy, fx), y)
    return pd.Series(d)


@F.pandas_udf(LongType())
def _curve_xy(z: pd.Series, d: pd.Series) -> pd.Series:
    """x and y, in one number (x above MAX_ZOOM bits of y), of a place along the curve of level z: the inverse of _curve_place."""
    z, d = z.to_numpy(np.int64), d.to_numpy(np.int64)
    x, y = np.zeros(len(z), np.int64), np.zeros(len(z), np.int64)
    for bit in range(int(z.max(initial=0))):
        half, on = np.int64(1 << bit), z > bit
        quad = (d >> (2 * bit)) & 3
        right, low = quad >= 2, (quad == 1) | (quad == 2)
        flip = np.where(quad == 3, half - 1, 0)
        fx, fy = x ^ flip, y ^ flip
        x, y = np.where(on, np.where(low, fx, fy) + right * half, x), np.where(on, np.where(low, fy, fx) + low * half, y)
    return pd.Series((x << MAX_ZOOM) | y)


def tile_id(z: Column, x: Column, y: Column, strict: bool = True) -> Column:
    """Id of a tile along the Hilbert curve of its level, after all levels above.

    The curve is walked, by numpy for a batch of rows, from the coarsest quadrant to the finest: each step adds the quadrant's place along the curve and
    turns the square so that the next quadrant is entered as the first. A level above 26, or x or y outside the level,
    is an error, or NULL if not strict."""
    z, x, y = (c.cast("bigint") for c in (z, x, y))
    side = F.call_function("shiftleft", _long(1), z.cast("int"))
    valid = z.between(0, MAX_ZOOM) & x.between(0, side - 1) & y.between(0, side - 1)

    here = lambda c: F.when(valid, c).otherwise(_long(0))
    walked = _curve_place(here(z), here(x), here(y))
    found = F.when(valid, first_id(z) + walked)
    if not strict:
        return found
    wrong = F.raise_error(F.concat(F.lit("tile outside its level: "), F.concat_ws("/", z, x, y))).cast("bigint")
    return F.when(z.isNull() | x.isNull() | y.isNull(), F.lit(None).cast("bigint")).when(~valid, wrong).otherwise(found)


def tile_zxy(id_: Column) -> Column:
    """Struct z, x, y of a tile id: the inverse of tile_id. NULL for an id below 0 or past the last level."""
    firsts = [(4**z - 1) // 3 for z in range(MAX_ZOOM + 2)]
    z, first = F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
    for k in reversed(range(len(firsts) - 1)):
        z, first = F.when(id_ < _long(firsts[k + 1]), _long(k)).otherwise(z), F.when(id_ < _long(firsts[k + 1]), _long(firsts[k])).otherwise(first)
    known = id_.isNotNull() & (id_ >= 0) & z.isNotNull()
    xy = _curve_xy(F.when(known, z).otherwise(_long(0)), F.when(known, id_ - first).otherwise(_long(0)))
    x, y = F.call_function("shiftright", xy, F.lit(MAX_ZOOM)), xy.bitwiseAND(_long((1 << MAX_ZOOM) - 1))
    return F.when(known, F.struct(z.cast("int").alias("z"), x.alias("x"), y.alias("y")))


def world_xy(lon: Column, lat: Column, beyond: bool = False) -> Column:
    """Struct x, y: web-mercator place on a map of side 1, y downwards. Places beyond its edges move to the edge; or, if beyond, lie above or below the map, up to the poles."""
    clipped = F.least(F.greatest(lat.cast("double"), F.lit(-MAX_LATITUDE)), F.lit(MAX_LATITUDE))
    phi = F.radians(F.when(F.abs(lat) < 90, lat.cast("double")).otherwise(clipped) if beyond else clipped)
    y = (1 - F.ln(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2
    return F.struct(((lon.cast("double") + 180) / 360).alias("x"), y.alias("y"))


def tile_xy(lon: Column, lat: Column, z: Column) -> Column:
    """Struct x, y: the tile of level z that holds a place; the outermost tiles take what lies on the far edges."""
    at, side = world_xy(lon, lat), F.pow(F.lit(2.0), z)
    clip = lambda v: F.least(F.greatest(F.floor(v * side).cast("bigint"), _long(0)), side.cast("bigint") - 1)
    return F.struct(clip(at.x).alias("x"), clip(at.y).alias("y"))


def little_endian(data: Column, start: int | Column, length: int) -> Column:
    """Unsigned whole number of up to 7 bytes from binary data; start counts from 0."""
    part = F.substring(data, (F.lit(start) + 1).cast("int"), F.lit(length)) if isinstance(start, Column) else F.substring(data, start + 1, length)
    # F.reverse takes bytes for characters, of which some are longer than a byte
    digits = F.hex(part)
    return F.when(F.length(part) == length, F.conv(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(length))]), 16, 10).cast("bigint"))
