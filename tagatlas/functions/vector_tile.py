"""Vector tiles: features of a tile as the protocol-buffer message that map clients draw."""

from __future__ import annotations

import struct
from collections.abc import Iterable

from tagatlas.sources.archive_format import varint

# Fixed values of the format: the extent of a tile, numbers of geometry types, and drawing commands.
EXTENT, TILE_PX = 4096, 256
POINT, LINE, POLYGON = 1, 2, 3
MOVE, DRAW, CLOSE = 1, 2, 7


def _zigzag(n: int) -> int:
    return (n << 1) ^ (n >> 63)


def _bytes(number: int, data: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(data)) + data


def _value(v: object) -> bytes:
    if isinstance(v, bool):
        return varint(7 << 3) + varint(int(v))
    if isinstance(v, int):
        return varint(6 << 3) + varint(_zigzag(v))
    if isinstance(v, float):
        return varint(3 << 3 | 1) + struct.pack("<d", v)
    return _bytes(1, str(v).encode("utf-8"))


def _geometry(kind: int, pixels: list[tuple[float, float]]) -> list[int]:
    grid = [(round(x * EXTENT / TILE_PX), round(y * EXTENT / TILE_PX)) for x, y in pixels]
    grid = [p for i, p in enumerate(grid) if i == 0 or p != grid[i - 1]]
    if kind == POINT:
        return [MOVE | 1 << 3, _zigzag(grid[0][0]), _zigzag(grid[0][1])]
    if len(grid) < 2:
        return []
    steps = [c for a, b in zip(grid, grid[1:]) for c in (_zigzag(b[0] - a[0]), _zigzag(b[1] - a[1]))]
    return [MOVE | 1 << 3, _zigzag(grid[0][0]), _zigzag(grid[0][1]), DRAW | (len(grid) - 1) << 3, *steps]


def _polygon(rings: list[list[tuple[float, float]]]) -> list[int]:
    """Rings on the grid, each closed by a command; outer ones come first and turn clockwise to the eye, as they are given. A ring that has no area on the grid is left out, and with an outer one all that follow it."""
    out, at, drawn = [], (0, 0), False
    for ring in rings:
        grid = [(round(x * EXTENT / TILE_PX), round(y * EXTENT / TILE_PX)) for x, y in ring]
        grid = [p for i, p in enumerate(grid) if p != grid[i - 1]]
        turn = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(grid, grid[1:] + grid[:1]))
        if len(grid) < 3 or turn == 0 or (turn < 0 and not drawn):
            drawn = drawn and turn <= 0
            continue
        drawn = drawn or turn > 0
        steps = [c for a, b in zip([at, *grid], grid) for c in (_zigzag(b[0] - a[0]), _zigzag(b[1] - a[1]))]
        out += [MOVE | 1 << 3, *steps[:2], DRAW | (len(grid) - 1) << 3, *steps[2:], CLOSE | 1 << 3]
        at = grid[-1]
    return out


def layer(name: str, features: Iterable[tuple[int, int | None, dict, list[tuple[float, float]]]]) -> bytes:
    """A layer of features (geometry type, id, attributes, places in pixels). Places of a polygon are its rings. Attributes without a value, lines without length and polygons without area are left out."""
    keys: dict[str, int] = {}
    values: dict[bytes, int] = {}
    body = b""
    for kind, osm_id, attributes, pixels in features:
        shape = (_polygon(pixels) if kind == POLYGON else _geometry(kind, pixels)) if pixels else []
        if not shape:
            continue
        tags = [t for k, v in attributes.items() if v is not None for t in (keys.setdefault(k, len(keys)), values.setdefault(_value(v), len(values)))]
        feature = varint(1 << 3) + varint(osm_id) if osm_id is not None and osm_id >= 0 else b""
        feature += _bytes(2, b"".join(map(varint, tags))) + varint(3 << 3) + varint(kind) + _bytes(4, b"".join(map(varint, shape)))
        body += _bytes(2, feature)
    head = varint(15 << 3) + varint(2) + _bytes(1, name.encode("utf-8"))
    return _bytes(3, head + body + b"".join(_bytes(3, k.encode("utf-8")) for k in keys) + b"".join(_bytes(4, v) for v in values) + varint(5 << 3) + varint(EXTENT))
