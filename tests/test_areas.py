import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagatlas.functions import vector_tile
from tagatlas.operators import areas
from tagatlas.plans import map_build
from tests.test_hits import pixel


def star(rnd, x, y, size, n=9):
    """A ring that turns counterclockwise, with bends that leave and enter again."""
    return [(x + size * rnd.uniform(0.3, 1) * math.cos(2 * math.pi * k / n), y + size * rnd.uniform(0.3, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]


def flat(ring):
    return [float(v) for p in [*ring, ring[0]] for v in p]


def test_pieces_sum_to_the_whole(spark):
    rnd = random.Random(1)
    rows, whole = [], {}
    for k in range(12):
        x, y = rnd.uniform(-20, 20), rnd.uniform(-20, 20)
        outer, hole = star(rnd, x, y, 9), star(rnd, x, y, 2)[::-1]
        rows.append((k, [flat(outer), flat(hole)] if k % 3 else [flat(outer)]))
        whole[k] = [sum(-areas.area(np.array([pixel(*p, z) for p in r])) for r in ([outer, hole] if k % 3 else [outer])) for z in range(8)]
    rows += [(100, []), (101, [[1.0, 1.0, 2.0, 2.0]]), (102, None), (103, [flat([(0, 0), (1, 0), (2, 0)])])]
    df = spark.createDataFrame([(*r, "a") for r in rows], "osm_id long, rings array<array<double>>, x string")
    got = areas.in_tiles(df.drop("x"), 7, 2, 0.0).withColumn("pixels", areas.pixel_area(F.col("rings"))).collect()
    for k, want in whole.items():
        for z in range(2, 8):
            assert sum(r.pixels for r in got if (r.osm_id, r.z) == (k, z)) == pytest.approx(want[z], rel=1e-9)
    assert {r.osm_id for r in got} == set(whole) and all(0 <= v <= 256 for r in got for ring in r.rings for v in ring)
    buffered = areas.in_tiles(df.drop("x"), 5, 5).collect()
    assert {(r.osm_id, r.x, r.y) for r in got if r.z == 5} <= {(r.osm_id, r.x, r.y) for r in buffered} and any(v < 0 for r in buffered for ring in r.rings for v in ring)
    assert areas.in_tiles(df.drop("x").limit(0), 3).count() == 0


def test_cut_against_points():
    """A point of the square is in what is cut off just if it is in the ring."""
    rnd = random.Random(3)

    def holds(ring, p):
        x, y = p
        return sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) for a, b in zip(ring, [*ring[1:], *ring[:1]])) % 2 == 1

    for _ in range(60):
        ring = star(rnd, rnd.uniform(-3, 13), rnd.uniform(-3, 13), rnd.uniform(2, 12), rnd.choice([3, 7, 20]))
        got = areas.cut(np.array(ring), 0.0, 10.0)
        assert not len(got) or (got.min() >= 0 and got.max() <= 10)
        for _ in range(60):
            p = (rnd.uniform(0.01, 9.99), rnd.uniform(0.01, 9.99))
            assert holds(ring, p) == holds([tuple(q) for q in got], p)


def numbers(data):
    out, n, shift = [], 0, 0
    for b in data:
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(n)
            n = shift = 0
    return out


def fields(data):
    at = 0

    def whole():
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        key = whole()
        if key & 7 == 2:
            size = whole()
            yield key >> 3, data[at : at + size]
            at += size
        else:
            yield key >> 3, whole()


def drawn(commands):
    """Rings of a polygon's commands."""
    x = y = at = 0
    rings = []
    while at < len(commands):
        what, n = commands[at] & 7, commands[at] >> 3
        at += 1
        if what == 7:
            continue
        for _ in range(n):
            dx, dy = ((v >> 1) ^ -(v & 1) for v in commands[at : at + 2])
            x, y, at = x + dx, y + dy, at + 2
            if what == 1:
                rings.append([])
            rings[-1].append((x, y))
    return rings


def test_polygons_in_a_tile(spark):
    outer, hole = [(0, 0), (100, 0), (100, 100), (0, 100)], [(10, 10), (10, 50), (50, 50), (50, 10)]
    tiny = [(5.0, 5.0), (5.001, 5.0), (5.0, 5.001)]
    body = dict(fields(vector_tile.layer("l", [(vector_tile.POLYGON, 7, {"class": "wood"}, [outer, hole, tiny])])))[3]
    feature = next(dict(fields(v)) for k, v in fields(body) if k == 2)
    assert feature[1] == 7 and feature[3] == 3
    assert drawn(numbers(feature[4])) == [[(16 * x, 16 * y) for x, y in r] for r in (outer, hole)]
    assert 2 not in dict(fields(dict(fields(vector_tile.layer("l", [(vector_tile.POLYGON, 1, {}, [tiny, hole])])))[3]))
    # through the map build, and back
    fills = spark.createDataFrame([("land", 1, 2, [flat([(0, 0), (20, 0), (20, 20), (0, 20)]), flat([(5, 5), (5, 10), (10, 10), (10, 5)])], "wood")], "layer string, osm_id long, min_zoom int, rings array<array<double>>, class string")
    elements = "feature_type string, osm_id long, lon double, lat double, nodes array<long>, members array<struct<type: string, ref: bigint, role: string>>, tags map<string,string>"
    mapped = map_build.map_features(*map_build.split_elements(spark.createDataFrame([], elements)))
    got = {(r.z, r.x, r.y): bytes(r.data) for r in map_build.tiles(mapped, 3, fills).collect()}
    assert {z for z, _, _ in got} == {2, 3}
    feature = next(dict(fields(v)) for k, v in fields(dict(fields(got[3, 4, 3]))[3]) if k == 2)
    top, side = pixel(0, 20, 3)[1] - 3 * 256, pixel(20, 0, 3)[0] - 4 * 256
    want = [[(0, 256 * 16), (0, top * 16), (side * 16, top * 16), (side * 16, 256 * 16)]]
    assert feature[1] == 1 and feature[3] == 3
    shapes = drawn(numbers(feature[4]))
    assert len(shapes) == 2 and areas.area(np.array(shapes[0], float)) > 0 > areas.area(np.array(shapes[1], float))
    assert max(x for x, _ in shapes[0]) == pytest.approx(want[0][2][0], abs=1) and min(y for _, y in shapes[0]) == pytest.approx(want[0][1][1], abs=1)
