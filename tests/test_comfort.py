"""The comfort table: fixed counts of the derived ways, rows that are expected, single cases for every trap, and random tags held against the SQL."""

import random

import duckdb
import pytest

from tagatlas.operators.comfort import ATTRIBUTES, classify
from tagatlas.plans import oracle, views

SF = "/root/testdata/sf0.001"


def way(branch: int, comfort: int, kind: str, oneway: int = 0, **more) -> dict:
    """What classify says of a way, by attribute; those it leaves out are absent."""
    return {"branch": branch, "comfort": comfort, "class": kind, "oneway": oneway, "shared_with_pedestrians": False, "shared_with_vehicles": False} | more


SHARED, WITH_CARS, RISK = {"shared_with_pedestrians": True}, {"shared_with_vehicles": True}, {"dooring_risk": True}
#: Tags, and what is to be said of them.
EXPECTED = [
    ("highway=cycleway", way(1, 4, "track", subclass="cycleway")),
    ("highway=cycleway foot=designated segregated=yes oneway=yes", way(1, 4, "track", 1, subclass="cycleway")),
    ("highway=cycleway foot=designated segregated=no", way(1, 3, "track", subclass="cycleway", **SHARED)),
    ("highway=path bicycle=designated", way(2, 4, "track", subclass="path")),
    ("highway=path bicycle=designated foot=designated oneway=-1", way(2, 3, "track", subclass="path", **SHARED)),
    ("highway=pedestrian bicycle=designated", way(2, 3, "track", subclass="path", **SHARED)),
    ("highway=pedestrian bicycle=designated segregated=yes", way(2, 4, "track", subclass="path")),
    ("highway=path bicycle=yes", None),
    ("highway=primary cycleway=track foot=designated", way(3, 3, "track", subclass="combined-primary", **SHARED)),
    ("highway=construction construction=cycleway cycleway=track", way(3, 4, "track", subclass="combined-construction")),
    ("cycleway=track", None),
    ("highway=construction construction=cycleway website=w opening_date=2030", way(4, 4, "track", subclass="cycleway", construction=True, website="w", opening_date="2030")),
    ("highway=construction construction=road", None),
    ("highway=primary cycleway=lane parking=separate", way(5, 2, "lane", side="both")),
    ("highway=primary cycleway:both=lane parking=lane", way(5, 1, "lane", side="both", **RISK)),
    ("highway=primary cycleway:left=lane cycleway:right=lane parking:right=separate", way(5, 1, "lane", side="both", **RISK)),
    ("highway=primary cycleway:both=lane oneway=yes", None),
    ("highway=primary cycleway:right=lane cycleway:right:oneway=no parking:right=lane", way(6, 2, "lane", side="right")),
    ("highway=primary cycleway:left=lane cycleway:left:oneway=no oneway=-1", way(6, 2, "lane", side="left")),
    ("highway=primary oneway=yes cycleway=lane", way(7, 2, "lane", 1, side="right")),
    ("highway=primary oneway=yes cycleway:left=lane parking:left=street_side", way(7, 1, "lane", 1, side="left", **RISK)),
    ("highway=primary oneway=yes cycleway:left=lane cycleway:right=lane parking:both=lane", way(7, 2, "lane", side="left")),
    ("cycleway:both=shared_lane", way(8, 1, "lane", **WITH_CARS)),
    ("cycleway=shared_lane", None),
    ("highway=primary cycleway=shared maxspeed=30 oneway=yes", way(8, 3, "lane", 1, **WITH_CARS)),
    ("highway=primary cycleway=shared maxspeed=31 oneway=yes oneway:bicycle=no", way(8, 1, "lane", **WITH_CARS)),
    ("highway=primary cycleway=shared motor_vehicle=private maxspeed=90", way(8, 3, "lane", **WITH_CARS)),
    ("highway=residential bicycle=yes maxspeed=30 cycleway:right=lane cycleway:left=no", way(9, 3, "lane", **WITH_CARS)),
    ("highway=residential bicycle=designated maxspeed=20 foot=yes oneway=yes", way(9, 3, "lane", 1, **WITH_CARS | SHARED)),
    ("highway=residential bicycle=yes", None),
    ("highway=primary cycleway:right=lane cycleway:left=no", way(10, 2, "lane", 1, side="right")),
    ("highway=primary cycleway:left=lane cycleway:right=no parking:both=lane", way(10, 1, "lane", -1, side="left", **RISK)),
    ("highway=motorway", None),
]


VALUES = {
    "highway": ["cycleway", "path", "pedestrian", "construction", "residential", "primary"], "bicycle": ["yes", "designated", "no"], "foot": ["yes", "designated"], "segregated": ["yes", "no"],
    "oneway": ["yes", "-1", "no"], "cycleway": ["lane", "track", "shared", "shared_lane"], "cycleway:both": ["lane", "shared", "shared_lane", "no"], "cycleway:left": ["lane", "no"], "cycleway:right": ["lane", "no"],
    "cycleway:left:oneway": ["no", "yes"], "cycleway:right:oneway": ["no", "yes"], "construction": ["cycleway", "road"], "maxspeed": ["20", "30", "31", "50", "50 mph", "none", ""], "motor_vehicle": ["private", "yes"],
    "oneway:bicycle": ["no", "yes"], "parking": ["lane", "street_side", "separate"], "parking:both": ["lane", "street_side", "separate", "no"], "parking:left": ["lane", "street_side", "separate", "no"],
    "parking:right": ["lane", "street_side", "separate", "no"], "website": ["w"], "opening_date": ["2030"],
}


def run(spark, cases: list[dict | None], **policy):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "way_id bigint, tags map<string,string>")
    got = {r["way_id"]: {k: v for k, v in r.asDict().items() if k in ("branch", *ATTRIBUTES) and v is not None} for r in classify(rows, **policy).collect()}
    return [got.get(i) for i in range(len(cases))]


def test_expected_rows(spark):
    cases = [dict(x.split("=") for x in tags.split()) for tags, _ in EXPECTED]
    assert run(spark, cases) == [want for _, want in EXPECTED]


def test_speeds_that_are_no_numbers(spark):
    street = {"highway": "residential", "bicycle": "yes"}
    cases = [street | {"maxspeed": v} for v in ("30", "+30", "50 mph", "none", "")]
    assert [bool(g) for g in run(spark, cases)] == [True] * 5
    assert [bool(g) for g in run(spark, cases, maxspeed_invalid="null")] == [True, True, False, False, False]


def test_random_tags_match_the_sql(spark):
    rng = random.Random(5)
    cases = [{k: rng.choice(v) for k, v in VALUES.items() if rng.random() < (0.75 if k == "highway" else 0.3)} for _ in range(4000)]
    con = duckdb.connect()
    con.execute("CREATE TABLE ways (way_id BIGINT, " + ", ".join(f'"{k}" VARCHAR' for k in [*VALUES, "name", "surface"]) + ")")
    con.executemany(f"INSERT INTO ways VALUES ({', '.join('?' * (len(VALUES) + 3))})", [(i, *[c.get(k) for k in VALUES], None, None) for i, c in enumerate(cases)])
    found = con.execute(f"WITH {oracle.RULES} SELECT * FROM lines")
    names = [d[0] for d in found.description]
    want = {r[0]: {k: v for k, v in zip(names[1:], r[1:]) if v is not None} for r in found.fetchall()}
    assert {w["branch"] for w in want.values()} == set(range(1, 11))
    works = ("website", "opening_date")
    assert [g and {k: v for k, v in g.items() if k not in works} for g in run(spark, cases)] == [want.get(i) for i in range(len(cases))]


def test_traps(spark):
    cases = [
        {"highway": "cycleway", "foot": "designated"},  # needs an explicit segregated=no
        {"highway": "cycleway", "foot": "designated", "segregated": "no"},
        {"cycleway:both": "shared_lane"},  # no highway needed
        {"highway": "construction", "construction": "cycleway", "cycleway": "track"},  # beside a street first
        {"highway": "residential", "bicycle": "yes", "maxspeed": "30", "cycleway:right": "lane", "cycleway:left": "no"},
        {"highway": "primary", "oneway": "yes", "cycleway:both": "lane"},
        {"highway": "primary", "cycleway": "lane", "parking": "separate"},
        {}, None,
    ]
    got = run(spark, cases)
    assert [g and (g["branch"], g["comfort"]) for g in got] == [(1, 4), (1, 3), (8, 1), (3, 4), (9, 3), None, (5, 2), None, None]


def test_counts_of_derived_ways(spark):
    got = dict(classify(views.ways(spark, SF)).groupBy("branch").count().collect())
    assert got == {1: 94, 2: 188, 3: 188, 4: 94, 5: 191, 6: 119, 7: 191, 8: 188, 9: 92, 10: 89}


def test_unmatched_can_stay_and_bad_policy_fails(spark):
    rows = spark.createDataFrame([(1, {"a": "b"})], "way_id bigint, tags map<string,string>")
    assert classify(rows, keep_unmatched=True).select("branch", "comfort").collect() == [(None, None)]
    with pytest.raises(ValueError):
        classify(rows, maxspeed_invalid="other")


def test_counts_at_the_larger_scale(spark):
    rows = classify(views.ways(spark, "/root/testdata/sf0.01"))
    assert dict(rows.groupBy("comfort").count().collect()) == {1: 2380, 2: 4199, 3: 3681, 4: 4059}
    assert dict(rows.groupBy("oneway").count().collect()) == {-1: 620, 0: 9258, 1: 4441}
    assert dict(rows.where("dooring_risk").groupBy("branch").count().collect()) == {5: 1188, 7: 204, 10: 309}
