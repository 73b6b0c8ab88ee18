import itertools
import random

import pytest
from pyspark.sql import functions as F

from tagatlas.llm import mixing
from tests.llm.cases import documents, empty


def test_targets():
    t = mixing.targets({"b": 100, "a": 100, None: 100})
    assert list(t) == ["a", "b", None] and t["a"] == pytest.approx(50) and t["b"] == pytest.approx(100) and t[None] == pytest.approx(150)
    t = mixing.targets({"a": 1000, "b": 10, "c": 10})
    assert t == {"b": 30.0, "c": 30.0, "a": 960.0}
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def cost(x, supply):
    """Least cost of taking x tokens of a supply."""
    return sum(min(max(x - k * supply, 0), supply) * c for k, c in enumerate(mixing.COSTS))


def test_flow_against_brute_force():
    rnd = random.Random(5)
    for _ in range(40):
        supply = [rnd.randint(0, 4) for _ in range(3)]
        members = [sorted(rnd.sample(range(2), rnd.randint(1, 2))) for _ in supply]
        quota = [rnd.randint(0, 6) for _ in range(2)]
        best = None
        for give in itertools.product(*(range(3 * s + 1) for s in supply)):
            # can give be dealt to the quotas? for two quotas the cut conditions are enough
            only = [sum(g for g, m in zip(give, members, strict=True) if m == [q]) for q in (0, 1)]
            if only[0] <= quota[0] and only[1] <= quota[1] and sum(give) <= sum(quota):
                key = (-sum(give), sum(cost(g, s) for g, s in zip(give, supply, strict=True)))
                best = key if best is None else min(best, key)
        flow = mixing.cheapest_flow(supply, members, quota)
        assert (-sum(flow), sum(cost(g, s) for g, s in zip(flow, supply, strict=True))) == best


def test_mixed(spark):
    docs = documents(spark)
    rows = mixing.mixed(docs).collect()
    assert len(rows) == docs.count() and sorted(map(str, rows)) == sorted(map(str, mixing.mixed(docs.repartition(3)).collect()))
    size = {r.source: r.n for r in docs.groupBy("source").agg(F.sum(mixing.words(F.col("text"))).alias("n")).collect()}
    goal = mixing.targets(size)
    assert {(r.source_size, r.target) for r in rows} == {(size[s], goal[s]) for s in size}
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    assert mixing.mixed(empty(spark)).collect() == []


def test_targets_are_met(spark):
    rnd = random.Random(1)
    docs = spark.createDataFrame([(k, "w " * rnd.randint(1, 60), None if k % 9 == 0 else f"s{min(k % 13, 4)}") for k in range(4000)], "doc_id long, text string, source string")
    got = mixing.mixed(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("t"), F.max("size").alias("m")).collect()
    assert len(got) == 6
    for r in got:
        assert abs(r.t - r.target) <= r.m
    again = mixing.repeated(docs).groupBy("doc_id").count()
    taken = mixing.mixed(docs).where("taken > 0").selectExpr("doc_id", "taken div size as n")
    assert again.join(taken, "doc_id").where("count <> n").count() == 0 and again.count() == taken.count()


def test_overlapping_sources(spark):
    docs = spark.createDataFrame([(k, "w " * 10, ["a"] if k % 3 == 0 else ["b"] if k % 3 == 1 else ["a", "b"]) for k in range(300)], "doc_id long, text string, own array<string>")
    got = mixing.mixed(docs, F.col("own")).agg(F.sum("taken")).first()[0]
    assert abs(got - 3000) <= 30
    with pytest.raises(ValueError):
        mixing.mixed(docs, F.col("own"), max_patterns=2)


def test_more_sources_than_the_driver_takes(spark):
    rows = [(k, "w " * (k % 7 + 1), f"s{k % 700:04d}" if k % 11 else None) for k in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(t.split())
    goal = mixing.targets(size)
    got = {r.doc_id: r for r in mixing.mixed(docs, max_patterns=1).collect()}
    assert all((got[i].source_size, got[i].target) == (size[s], pytest.approx(goal[s])) for i, _, s in rows)
    taken = {}
    for i, _, s in rows:
        taken[s] = taken.get(s, 0) + got[i].taken
    assert all(abs(taken[s] - goal[s]) <= 7 for s in size)


def test_overlaps_beside_single_sources(spark):
    rnd = random.Random(2)
    sets = [["a"], ["b"], ["a", "b"], ["b", "a"], ["c"], ["d", None], [None], []]
    docs = spark.createDataFrame([(k, "w " * rnd.randint(1, 20), rnd.choice(sets)) for k in range(3000)], "doc_id long, text string, own array<string>")
    got = mixing.mixed(docs, F.col("own")).join(docs, "doc_id").groupBy(F.array_sort("own").alias("own")).agg(F.sum("taken").alias("taken"), F.sum("size").alias("n"), F.first("target").alias("target"), F.first("source_size").alias("size")).collect()
    of = {tuple(r.own): r for r in got}
    assert len(of) == 7 and of[()].taken == 0
    both = of[("a",)].target + of[("b",)].target
    assert abs(of["a",].taken + of["b",].taken + of["a", "b"].taken - both) <= 60
    assert abs(of["c",].taken - of["c",].target) <= 20
    assert of["a", "b"].target == pytest.approx(both) and all(r.taken <= 3 * r.n for r in got)


def test_rows_pass_through_with_any_names(spark):
    docs = spark.createDataFrame([(k, "a b c", "s", "p", 1, 2, 3, 4, {"a": 1}) for k in range(30)], "doc_id long, text string, source string, pattern string, row int, hash int, times int, last int, col map<string,int>")
    got = mixing.repeated(docs)
    assert got.columns == docs.columns and got.count() == 30
    assert all((r.pattern, r.row, r.hash, r.times, r.last) == ("p", 1, 2, 3, 4) for r in got.collect())


def test_numbered(spark):
    from tagatlas.llm.common import numbered

    names = [f"n{k:03d}" for k in range(500)]
    random.Random(1).shuffle(names)
    df = spark.createDataFrame([(n,) for n in [*names, None]], "name string").repartition(7)
    got = {r.name: r.number for r in numbered(df, F.col("name").asc_nulls_last()).collect()}
    assert got == {n: k for k, n in enumerate([*sorted(names), None])}


def test_picks_fill_what_is_left(spark):
    rnd = random.Random(8)
    rows = [(f"p{k % 5}", rnd.choice([1, 2, 5, 40, 900]) if k % 5 else 7, rnd.randrange(-(1 << 63), 1 << 63)) for k in range(600)]
    rows += [("p1", 3, rows[1][2]), ("p2", 0, 5), ("p6", 50, 1), ("p7", 3, 9)]
    rest = {"p0": 200, "p1": 3000, "p2": 777, "p3": 20000, "p4": 1, "p6": 49, "p7": 3}
    slim = spark.createDataFrame(rows, "pattern string, size long, hash long")
    picks = mixing.picked(slim, spark.createDataFrame(list(rest.items()), "pattern string, rest long"))
    got = slim.join(picks, "pattern").withColumn("more", mixing.again(F.col("size"), F.col("hash"), F.col("picks"))).collect()
    for p, want in rest.items():
        taken = sum(r["size"] for r in got if r.pattern == p and r.more)
        small = [r["size"] for r in got if r.pattern == p and not r.more and 0 < r["size"]]
        assert taken <= want and (want - taken <= 0.002 * want or all(n > want - taken for n in small)), p
    of = {}
    for r in got:
        of.setdefault((r.pattern, r.hash), set()).add(r.more)
    assert all(len(v) == 1 for v in of.values())


def test_the_flow_makes_the_query(spark, monkeypatch):
    seen, real = [], mixing.cheapest_flow
    monkeypatch.setattr(mixing, "cheapest_flow", lambda supply, *a: seen.append(len(supply)) or real(supply, *a))
    docs = documents(spark)
    mixing.mixed(docs).collect()
    assert seen == [docs.select("source").distinct().count()]
