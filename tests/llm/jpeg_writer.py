"""A plain baseline writer for tests: YCbCr 4:2:0 with random AC coefficients."""

import struct

import numpy as np


def colour_jpeg(luma, interval):
    """luma: one value for each 8x8 block, even in both directions."""
    rng = np.random.default_rng(9)
    high, wide = luma.shape
    # sixteen codes of five bits for DC categories, 256 codes of nine bits for AC symbols
    dc = {k: (k, 5) for k in range(12)}
    ac_symbols = [0, 0xF0] + [r << 4 | s for r in range(16) for s in range(1, 11)]
    ac = {s: (k, 9) for k, s in enumerate(ac_symbols)}
    seg = lambda m, b: struct.pack(">BBH", 255, m, len(b) + 2) + b
    out = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, b"\0" + bytes([8] * 64)) + seg(0xDB, b"\x11" + struct.pack(">64H", *[300] * 64))
    out += seg(0xC0, struct.pack(">BHHB", 8, high * 8, wide * 8, 3) + bytes([1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1]))
    out += seg(0xC4, b"\x00" + bytes([0] * 4 + [12] + [0] * 11) + bytes(range(12)) + b"\x10" + bytes([0] * 8 + [len(ac_symbols)] + [0] * 7) + bytes(ac_symbols))
    if interval:
        out += seg(0xDD, struct.pack(">H", interval))
    out += seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    bits, last, n, data = "", [0, 0, 0], 0, b""

    def flush():
        nonlocal bits, data
        bits += "1" * (-len(bits) % 8)
        data += bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
        bits = ""

    def number(x, size):
        return format(x if x >= 0 else x + (1 << size) - 1, f"0{size}b") if size else ""

    def block(c, value):
        nonlocal bits
        d = value - last[c]
        last[c] = value
        size = abs(d).bit_length()
        bits += format(dc[size][0], "05b") + number(d, size)
        at = 1
        while at < 64 and rng.random() < 0.6:
            run = int(rng.integers(0, 40))
            if at + run > 63:
                break
            at += run
            while run > 15:
                bits += format(ac[0xF0][0], "09b")
                run -= 16
            x = int(rng.integers(1, 500)) * (1 if rng.random() < 0.5 else -1)
            size = abs(x).bit_length()
            bits += format(ac[run << 4 | size][0], "09b") + number(x, size)
            at += 1
        if at < 64:
            bits += format(ac[0][0], "09b")

    for y in range(0, high, 2):
        for x in range(0, wide, 2):
            if interval and n and n % interval == 0:
                flush()
                data += bytes([255, 0xD0 + (n // interval - 1) % 8])
                last = [0, 0, 0]
            for dy in (0, 1):
                for dx in (0, 1):
                    block(0, int(luma[y + dy, x + dx]) - 128)
            block(1, int(rng.integers(-50, 50)))
            block(2, int(rng.integers(-50, 50)))
            n += 1
    flush()
    return out + data + b"\xff\xd9"
