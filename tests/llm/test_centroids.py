import hashlib
import math

import duckdb
import numpy as np
import pytest

from tagatlas.llm import centroids


def plain(rows, k, rounds, dim):
    """The same by Python integers: {position: (cluster, distance)}, centroids."""
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(ok, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in ok]
        new = []
        for n, old in enumerate(centres):
            mine = [v for (_, v), o in zip(ok, own, strict=True) if o == n]
            new.append([sum(col) // len(mine) for col in zip(*mine, strict=True)] if mine else old)
        centres = new
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in ok), key=str), centres


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, x string")


def vectors(n, dim, scale=1.0, seed=0):
    rng = np.random.default_rng(seed)
    return [(k, [float(x) for x in row]) for k, row in enumerate((rng.normal(0, scale, (n, dim)) + rng.integers(0, 4, (n, 1))).astype(np.float32))]


@pytest.mark.parametrize("scale", [0.3, 3e6, 1e12, 1e30])
def test_against_plain(spark, scale):
    rows = vectors(150, 8, scale)
    rows += [(None, rows[3][1]), (7, rows[7][1]), (900, None), (901, [1.0] * 7), (902, [None] + [1.0] * 7), (903, [float("nan")] * 8), (904, [float("inf")] * 8), (905, []), (906, rows[3][1])]
    want, centres = plain(rows, 9, 3, 8)
    got = centroids.cluster(table(spark, rows).repartition(5), 9, 3, dim=8).collect()
    assert sorted(((r.vec_id, r.cluster) for r in got), key=str) == sorted((w[:2] for w in want), key=str)
    small = lambda v: v if v < 1 << 63 else None
    assert sorted(((r.vec_id, r.distance) for r in got), key=str) == sorted(((w[0], small(w[2])) for w in want), key=str)
    sha = {n: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for n, c in enumerate(centres)}
    assert {(r.cluster, r.centroid_sha256) for r in got} == {(w[1], sha[w[1]]) for w in want}
    total = sum(w[2] for w in want)
    assert {r.inertia for r in got} == {small(total)}
    assert {(r.cluster, r.cluster_inertia) for r in got} == {(c, small(sum(w[2] for w in want if w[1] == c))) for c in {w[1] for w in want}}


def test_products_agree_at_the_bounds():
    rng = np.random.default_rng(2)
    for top in (2**10, 2**23, 2**28, 2**40):
        x = rng.integers(-top, top, (20, 16)).astype(float)
        c = rng.integers(-top, top, (5, 16)).tolist()
        plain = [[sum((int(a) - b) ** 2 for a, b in zip(row, y, strict=True)) for y in c] for row in x]
        assert centroids.products(x, c).tolist() == plain


def test_few_ties_and_empty(spark):
    same = [(k, [1.0, -1.5]) for k in range(30)]
    got = centroids.cluster(table(spark, same), 5, 3, dim=2).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)} and len(got) == 30
    assert len(centroids.cluster(table(spark, same[:2]), 40, 5, dim=2).collect()) == 2
    none = centroids.cluster(table(spark, []), 40, 5, dim=2)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_sql(spark):
    rows = vectors(120, 6)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    want = con.execute(centroids.cluster_sql(7, 3, dim=6)).fetchall()
    assert sorted(want) == sorted(tuple(r) for r in centroids.cluster(table(spark, rows), 7, 3, dim=6).collect())
