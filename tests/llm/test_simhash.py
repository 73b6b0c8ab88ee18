import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tagatlas.llm import simhash
from tagatlas.llm.components import components
from tests.llm.cases import TEXTS, documents, empty


def plain(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute(rows, radius=3):
    fps = [plain(t) for _, t in rows]
    comp = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= radius and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    least = {}
    for c, (i, _) in zip(comp, rows, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return sorted(((i, f"{f:016x}", least.get(c)) for (i, _), f, c in zip(rows, fps, comp, strict=True)), key=str)


def test_fingerprint():
    for t in TEXTS:
        assert simhash.fingerprint(t) % (1 << 64) == plain(t)


def test_near_duplicates(spark):
    docs = documents(spark)
    rnd = random.Random(3)
    base = [rnd.choice("abcdefghij") * 3 + str(rnd.randrange(50)) for _ in range(300)]
    more = []
    for k in range(40):
        w = list(base)
        for _ in range(k % 4):
            w[rnd.randrange(300)] = f"new{rnd.randrange(9)}"
        more.append((1000 - k, " ".join(w)))
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = [tuple(r) for r in docs.collect()]
    assert sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str) == brute(rows)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_links_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    fps = [int(x) for x in base]
    for x in base[:80]:
        for _ in range(3):
            y = int(x)
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                y ^= 1 << int(b)
            fps.append(y)
    fps += [int(base[0]) ^ (1 << b) for b in range(64)]
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    found = components(simhash.links(spark.createDataFrame(signed, "fp long")))
    u, got = sorted(set(fps)), {r.node % (1 << 64): r.root for r in found.collect()}
    import collections

    comp = {f: f for f in u}

    def top(f):
        while comp[f] != f:
            f = comp[f]
        return f

    for i, a in enumerate(u):
        for b in u[:i]:
            if (a ^ b).bit_count() <= 3:
                comp[top(a)] = top(b)
    groups, mine = collections.defaultdict(set), collections.defaultdict(set)
    for f in u:
        groups[top(f)].add(f)
        mine[got.get(f, ("alone", f))].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_pairs_of_a_dominant_tile_are_spread(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 4)
    monkeypatch.setattr(simhash, "FAN", 2)
    # all in one tile: every quarter has one bit set
    fps = [sum(1 << (16 * q + b) for q, b in enumerate((i % 16, i // 16 % 16, i // 7 % 16, i // 3 % 16))) for i in range(0, 256, 2)]
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in set(fps)]
    links = simhash.links(spark.createDataFrame(signed, "fp long"), 4)
    got = {r.node % (1 << 64): r.root for r in components(links).collect()}
    u = np.array(sorted(set(fps)), dtype=np.uint64)
    own, root = simhash._forest(*np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 4), len(u))
    mine = dict(zip(u[own].tolist(), u[root].tolist(), strict=True))
    pairs = {(mine.get(f, f), got.get(f, f)) for f in u.tolist()}
    assert len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs})


def plain_kept(rows, radius=3):
    """One row of each component: least id, nulls last."""
    fps = [plain(t) for _, t in rows]
    comp = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= radius:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    return [[r for r, c in zip(rows, comp, strict=True) if c == k] for k in sorted(set(comp))]


def test_deduplicated_where_ids_repeat(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in ("left", "other"))
    rows = [(1, a), (2, a), (2, b), (None, a + " more"), (None, "x y z " * 9), (None, "x y z " * 9), (5, b + " tail"), (4, None), (None, "")]
    docs = spark.createDataFrame([(*r, "f", {"k": k}) for k, r in enumerate(rows)], "doc_id long, text string, fp string, row map<string,int>")
    groups = plain_kept(rows)
    for part in (docs, docs.repartition(5), docs.orderBy(F.desc("text"))):
        got = simhash.deduplicated(part)
        assert got.columns == docs.columns
        out = [(r.doc_id, r.text) for r in got.collect()]
        assert len(out) == len(groups)
        for g in groups:
            mine = [r for r in out if r in g]
            assert len(mine) == 1 and mine[0][0] == min((i for i, _ in g if i is not None), default=None)
    assert simhash.deduplicated(empty(spark)).count() == 0


def test_components(spark):
    path = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {(r.node, r.root) for r in components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == {(k, 0) for k in range(41)} | {(k, 100) for k in range(100, 130)} | {(200, 200), (201, 200)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert F is not None
