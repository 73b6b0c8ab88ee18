"""Media columns: baseline JPEG files, written for byte payloads and read for luminance thumbnails.

Reading: markers are parsed (SOI, DQT, SOF0/SOF1, DHT, DRI, SOS, EOI; others are skipped), scans are Huffman-decoded, and the
DC coefficient of every luminance block gives one pixel of a thumbnail an eighth as wide and high. Restart intervals are
independent, so they are the lanes of one numpy decoder that takes a symbol of every lane at a step; files of a batch are
decoded together. Interleaved colour scans with sampling factors are understood; only luminance is kept.

Writing: a payload byte is the DC coefficient of one 8x8 block (quantised by 8, so a flat block of exactly that luminance),
a row of 192 bytes is a row of blocks and a restart interval. The Huffman table gives a difference of category k a code of
9 - k bits, so each block takes ten bits with its end-of-block code: any JPEG reader shows the picture, and the payload
comes back without loss. Pictures are at most 8,191 blocks high, longer payloads are several pictures in a row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagatlas.llm.common import unused

ROW = 192
HIGHEST = 8191
#: Lanes that are decoded together; bounds the memory.
LANES = 1 << 14


class BadJpeg(ValueError):
    """Not a baseline JPEG file that can be read."""


# --- writing

_LEVELS = np.arange(-255, 256)
_CATEGORY = np.array([int(abs(x)).bit_length() for x in _LEVELS])
#: code of 9 - k bits (8 - k ones and a zero), k bits of the difference, the end-of-block code 0: ten bits
_TEN = np.array([((((1 << (9 - k)) - 2) << k | (x if x >= 0 else x + (1 << k) - 1)) << 1) for x, k in zip(_LEVELS.tolist(), _CATEGORY.tolist(), strict=True)], np.uint16)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(rows: int) -> bytes:
    counts = bytes([1] * 9 + [0] * 7)  # one code of each length 1 to 9, for the categories 8 to 0
    return b"".join([
        b"\xff\xd8",
        _segment(0xDB, bytes([0]) + bytes([8] * 64)),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, ROW * 8, 1, 1, 0x11, 0)),
        _segment(0xC4, bytes([0x00]) + counts + bytes(range(8, -1, -1))),
        _segment(0xC4, bytes([0x10, 1] + [0] * 15 + [0])),
        _segment(0xDD, struct.pack(">H", ROW)),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


def encode(payload: bytes) -> bytes:
    """JPEG pictures whose luminance blocks are the payload's bytes; its length is a positive multiple of ROW."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, ROW).astype(np.int16) - 128
    out = []
    for at in range(0, len(pixels), HIGHEST):
        part = pixels[at : at + HIGHEST]
        code = _TEN[np.diff(part, axis=1, prepend=0) + 255].reshape(len(part), -1, 4)
        a, b, c, d = (code[:, :, k] for k in range(4))
        five = np.stack([a >> 2, (a << 6 | b >> 4) & 255, (b << 4 | c >> 6) & 255, (c << 2 | d >> 8) & 255, d & 255], axis=2).astype(np.uint8).reshape(len(part), -1)
        # a zero byte after each 0xFF, a restart marker after each row but the last
        ends = np.tile(np.array([[0xFF, 0xD0]], np.uint8), (len(part), 1))
        ends[:, 1] += np.arange(len(part), dtype=np.int64).astype(np.uint8) & 7
        flat = np.concatenate([five, ends], axis=1)
        full = five == 0xFF
        if full.any():
            where = np.flatnonzero(np.concatenate([full, np.zeros((len(part), 2), bool)], axis=1))
            flat = np.insert(flat.ravel(), where + 1, 0)
        out.append(_head(len(part)) + flat.ravel()[:-2].tobytes() + b"\xff\xd9")
    return b"".join(out)


# --- reading


@dataclass
class Scan:
    width: int
    height: int
    blocks: list[tuple[int, int, int]] = field(default_factory=list)  # of an MCU: component, DC table, AC table
    tables: list[np.ndarray] = field(default_factory=list)
    wide: int = 0  # MCUs in a row
    high: int = 0
    h: int = 1
    v: int = 1
    quant: int = 1
    interval: int = 0
    data: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint8))


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits that may come: length << 8 | symbol of the code they begin with; 0 if none."""
    table, code, at = np.zeros(1 << 16, np.uint16), 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            if code >= 1 << length or at >= len(symbols):
                raise BadJpeg("Huffman table")
            table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


_TABLES: dict[bytes, np.ndarray] = {}


def parse(data: bytes) -> list[Scan]:
    """The pictures of a file of baseline JPEG data, each with its entropy-coded bytes."""
    out, at, raw = [], 0, np.frombuffer(data, np.uint8)
    while at < len(data):
        if data[at : at + 2] != b"\xff\xd8":
            raise BadJpeg("no start of image")
        at, quant, tables, interval, frame, ended = at + 2, {}, {}, 0, None, False
        while not ended:
            while data[at : at + 2] == b"\xff\xff":
                at += 1
            if at + 4 > len(data) or data[at] != 0xFF:
                raise BadJpeg("marker expected")
            marker, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + n], at + 2 + n
            try:
                if marker == 0xDB:
                    while body:
                        wide = body[0] >> 4
                        quant[body[0] & 15] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                        body = body[129 if wide else 65 :]
                elif marker in (0xC0, 0xC1):
                    bits, high, wide, n = struct.unpack_from(">BHHB", body)
                    if bits != 8 or not high or not wide:
                        raise BadJpeg("frame")
                    frame = (wide, high, [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)])
                elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    raise BadJpeg("not baseline")
                elif marker == 0xC4:
                    while body:
                        n = sum(body[1:17])
                        if (own := body[1 : 17 + n]) not in _TABLES:
                            if len(_TABLES) > 64:
                                _TABLES.clear()
                            _TABLES[own] = _lookup(own[:16], own[16:])
                        tables[body[0]] = _TABLES[own]
                        body = body[17 + n :]
                elif marker == 0xDD:
                    interval = struct.unpack(">H", body)[0]
                elif marker == 0xDA:
                    wide, high, parts = frame
                    chosen = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
                    if len(parts) != len(chosen):
                        raise BadJpeg("scans that are not interleaved")
                    one = len(parts) == 1
                    hm, vm = (1, 1) if one else (max(p[1] for p in parts), max(p[2] for p in parts))
                    scan = Scan(wide, high, wide=-(-wide // (8 * hm)), high=-(-high // (8 * vm)), quant=quant[parts[0][3]], interval=interval)
                    scan.h, scan.v = (1, 1) if one else parts[0][1:3]
                    for c, (name, h, v, _) in enumerate(parts):
                        scan.tables += [tables[chosen[name] >> 4], tables[16 + (chosen[name] & 15)]]
                        scan.blocks += [(c, 2 * c, 2 * c + 1)] * (1 if one else h * v)
                    stop = at  # the first marker that is no restart
                    while True:
                        stop = data.find(b"\xff", stop)
                        if stop < 0 or stop + 1 >= len(data):
                            raise BadJpeg("no end of image")
                        if data[stop + 1] == 0xD9 or not (data[stop + 1] == 0 or 0xD0 <= data[stop + 1] <= 0xD7):
                            break
                        stop += 2
                    if data[stop + 1] != 0xD9:
                        raise BadJpeg("more than one scan")
                    scan.data, at, ended = raw[at:stop], stop + 2, True
                    out.append(scan)
            except (KeyError, TypeError, IndexError, struct.error) as e:
                raise BadJpeg(f"segment {marker:#x}") from e
    return out


def _lanes(scan: Scan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The scan's bytes without stuffing and markers, each restart interval's first byte, and its number of MCUs."""
    d, total = scan.data, scan.wide * scan.high
    ff = np.flatnonzero(d == 0xFF)
    ff = ff[ff + 1 < len(d)]
    marks = ff[(d[ff + 1] >= 0xD0) & (d[ff + 1] <= 0xD7)]
    gone = np.zeros(len(d), bool)
    gone[ff[d[ff + 1] == 0] + 1] = True
    gone[marks] = gone[marks + 1] = True
    start = np.concatenate([np.zeros(1, np.int64), marks + 2])
    start = start - np.concatenate([np.zeros(1, np.int64), np.cumsum(gone)])[start]
    step = scan.interval or total
    if len(start) != -(-total // step):
        raise BadJpeg("restart markers")
    return d[~gone], start, np.minimum(step, total - step * np.arange(len(start)))


def luminance(scans: list[Scan]) -> list[np.ndarray]:
    """For each picture the DC-only thumbnail: uint8, a pixel for each luminance block."""
    out: list[np.ndarray | None] = [None] * len(scans)
    kinds: dict[tuple, list[int]] = {}
    for k, s in enumerate(scans):
        kinds.setdefault((tuple(s.blocks), *map(id, s.tables)), []).append(k)
    for (blocks, *_), own in kinds.items():
        split = [_lanes(scans[k]) for k in own]
        base = np.cumsum([0] + [len(x[0]) for x in split])
        data = np.concatenate([x[0] for x in split] + [np.zeros(8, np.uint8)])
        start = np.concatenate([x[1] + b for x, b in zip(split, base, strict=False)])
        count = np.concatenate([x[2] for x in split])
        end = np.concatenate([np.append(x[1][1:], len(x[0])) + b for x, b in zip(split, base, strict=False)])
        first = np.cumsum([0] + [int(x[2].sum()) for x in split])
        into = np.cumsum(count) - count
        lum = sum(b[0] == 0 for b in blocks)
        dc = np.zeros((int(count.sum()), lum), np.int32)
        tables = np.stack(scans[own[0]].tables)
        for at in range(0, len(start), LANES):
            part = slice(at, at + LANES)
            _decode(data, start[part], end[part], count[part], into[part], blocks, tables, dc, lum)
        for n, k in enumerate(own):
            s = scans[k]
            value = np.clip((dc[first[n] : first[n + 1]].astype(np.int64) * s.quant + 4) // 8 + 128, 0, 255).astype(np.uint8)
            grid = value.reshape(s.high, s.wide, s.v, s.h).transpose(0, 2, 1, 3).reshape(s.high * s.v, s.wide * s.h)
            out[k] = np.ascontiguousarray(grid[: -(-s.height // 8), : -(-s.width // 8)])
    return out


def _decode(data: np.ndarray, start: np.ndarray, end: np.ndarray, count: np.ndarray, into: np.ndarray, blocks: tuple, tables: np.ndarray, dc: np.ndarray, lum: int) -> None:
    """One symbol of every lane at a step. A lane's window is the 32 bits from the byte that its next bit lies in."""
    low, high = int(start[0]), int(end[-1])
    own = np.concatenate([data[low:high], np.zeros(8, np.uint8)]).astype(np.uint32)
    window = own[:-3] << np.uint32(24) | own[1:-2] << np.uint32(16) | own[2:-1] << np.uint32(8) | own[3:]
    bit, stop = (start - low) * 8, (end - low) * 8
    live = np.argsort(-count, kind="stable")  # lanes that end first are last
    bit, stop, many, into = bit[live], stop[live], count[live], into[live]
    last = np.zeros((1 + max(b[0] for b in blocks), len(live)), np.int32)

    def peek(n: int, at: np.ndarray) -> np.ndarray:
        if (at > stop[:n] + 64).any():
            raise BadJpeg("scan ends early")
        return window[np.minimum(at >> 3, len(window) - 1)] << (at & 7).astype(np.uint32)

    for mcu in range(int(many[0]) if len(many) else 0):
        n = int(np.searchsorted(-many, -mcu, side="left"))  # lanes with more than mcu MCUs
        nth = 0
        for c, t_dc, t_ac in blocks:
            at = bit[:n]
            bits = peek(n, at)
            code = tables[t_dc][bits >> np.uint32(16)]
            length, size = (code >> 8).astype(np.uint32), (code & 255).astype(np.uint32)
            if (length == 0).any() or (size > 11).any():
                raise BadJpeg("code")
            at = at + length
            bits = peek(n, at) if length.max() > 9 else bits << length
            extra = ((bits >> np.uint32(1)) >> (np.uint32(31) - size)).astype(np.int32)
            full = np.int32(1) << size.astype(np.int32)
            last[c, :n] += np.where(extra * 2 < full, extra - full + 1, extra)
            if c == 0:
                dc[into[:n] + mcu, nth] = last[0, :n]
                nth += 1
            at = at + size
            # AC coefficients are read over: run and size, then as many bits, to the end-of-block code or the 63rd
            code = tables[t_ac][peek(n, at) >> np.uint32(16)]
            at = at + (code >> 8)
            if (code >> 8 == 0).any():
                raise BadJpeg("code")
            open_ = np.flatnonzero(code & 255)
            place = np.zeros(len(open_), np.int64)
            symbol = (code & 255).astype(np.int64)[open_]
            while len(open_):
                size_ac, run = symbol & 15, symbol >> 4
                at[open_] += size_ac
                place += run + 1
                if ((size_ac == 0) & (run != 15)).any() or (place > 63).any():
                    raise BadJpeg("coefficients")
                go = place < 63
                open_, place = open_[go], place[go]
                if not len(open_):
                    break
                pos = at[open_]
                if (pos > stop[open_] + 64).any():
                    raise BadJpeg("scan ends early")
                code = tables[t_ac][(window[np.minimum(pos >> 3, len(window) - 1)] << (pos & 7).astype(np.uint32)) >> np.uint32(16)]
                if (code >> 8 == 0).any():
                    raise BadJpeg("code")
                at[open_] += code >> 8
                symbol = (code & 255).astype(np.int64)
                go = symbol > 0
                open_, place, symbol = open_[go], place[go], symbol[go]
            bit[:n] = at


def thumbnail_hash(grid: np.ndarray, side: int = 8) -> str:
    """A hash of 64 bits: whether each cell of an 8 by 8 grid of means is brighter than the mean of all."""
    rows, cols = (np.linspace(0, n, side + 1).astype(int) for n in grid.shape)
    total = np.zeros((grid.shape[0] + 1, grid.shape[1] + 1))
    np.cumsum(np.cumsum(grid, 0, dtype=np.int64), 1, out=total[1:, 1:])
    r0, r1, c0, c1 = np.minimum(rows[:-1], grid.shape[0] - 1), np.maximum(rows[1:], rows[:-1] + 1), np.minimum(cols[:-1], grid.shape[1] - 1), np.maximum(cols[1:], cols[:-1] + 1)
    r1, c1 = np.minimum(r1, grid.shape[0]), np.minimum(c1, grid.shape[1])
    cell = (total[np.ix_(r1, c1)] - total[np.ix_(r0, c1)] - total[np.ix_(r1, c0)] + total[np.ix_(r0, c0)]) / np.outer(r1 - r0, c1 - c0)
    return np.packbits(cell > grid.mean()).tobytes().hex()


def stored(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with media (binary): the text's UTF-8 bytes, filled up with blanks to a multiple of ROW, as JPEG; and n_bytes.

    A null text is an empty one, whose payload is ROW blanks. Existing columns of these names are replaced.
    """

    @F.pandas_udf("binary")
    def media(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            raw = [(x or "").encode() for x in part]
            yield pd.Series([encode(r.ljust(max(1, -(-len(r) // ROW)) * ROW)) for r in raw])

    return docs.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).withColumn("media", media(F.col(text)))


_SEEN = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width long, height long, feature string, error string"


def _read(files: list[bytes | None]) -> list[tuple]:
    parsed, scans, rows = [], [], []
    for f in files:
        try:
            if f is None:
                raise BadJpeg("null")
            got = parse(f)
            for s in got:
                _lanes(s)
            if not got:
                raise BadJpeg("empty")
            parsed.append((len(scans), len(got), None))
            scans += got
        except BadJpeg as e:
            parsed.append((0, 0, str(e)))
    try:
        grids = luminance(scans)
    except BadJpeg:  # a bad file spoils its batch: one by one then
        if len(files) == 1:
            return [(None,) * 8 + ("scan",)]
        return [_read([f])[0] for f in files]
    for f, (at, n, error) in zip(files, parsed, strict=True):
        if error:
            rows.append((None,) * 8 + (error,))
            continue
        own = grids[at : at + n]
        payload = b"".join(g.tobytes() for g in own)
        first = scans[at]
        rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(f), hashlib.sha256(f).hexdigest(), first.width, sum(s.height for s in scans[at : at + n]), f"{first.width}x{sum(s.height for s in scans[at : at + n])}:{'-'.join(thumbnail_hash(g) for g in own)}", None))
    return rows


def features(frame: DataFrame, media: str = "media", batch_bytes: int = 3 << 20) -> DataFrame:
    """frame with what is read back from its JPEG column: the thumbnail's bytes (count, SHA-256, CRC-32 of the last 16),
    the file's size and SHA-256, the picture's width and height, feature (dimensions and a hash of each thumbnail), error.

    A null or unreadable file has null values and a text in error. Existing columns of these names are replaced.
    """

    @F.pandas_udf(_SEEN)
    def read(files: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _SEEN.split(", ")]
        for part in files:
            rows, own, n = [], [], 0
            for f in part:
                own.append(f)
                n += len(f or b"")
                if n > batch_bytes:
                    rows += _read(own)
                    own, n = [], 0
            rows += _read(own) if own else []
            yield pd.DataFrame(rows, columns=names).astype({c.split()[0]: "Int64" for c in _SEEN.split(", ") if c.endswith("long")})

    seen = unused(frame, "seen")
    got = frame.withColumn(seen, read(F.col(media)))
    return got.withColumns({c.split()[0]: F.col(seen).getField(c.split()[0]) for c in _SEEN.split(", ")}).drop(seen)
