import pytest

from tagatlas.operators import elements, schema
from tagatlas.operators.schema import BENCH, PARKING, Field, Schema

ROWS = [
    ("node", 1, {"amenity": "bicycle_parking", "capacity": "12", "bicycle_parking": "stands", "covered": "partial", "fee": "no"}),
    ("way", 2, {"amenity": "bicycle_parking", "capacity": "many", "bicycle_parking": "hooks", "type": "bike_parking", "indoor": "no"}),
    ("node", 3, {"amenity": "bicycle_parking", "type": "rack"}), ("relation", 4, {"amenity": "bicycle_parking"}), ("node", 5, {"amenity": "bench", "capacity": "0x10", "covered": "yes"}),
    ("node", 6, {"amenity": "bench", "capacity": "many", "covered": "partial"}), ("node", None, {"amenity": "bench"}), ("area", 8, {}), (None, 9, None), ("node", 10, {"amenity": "bench", "capacity": "", "x": None}),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, "feature_type string, osm_id long, tags map<string,string>")


def test_parking_as_declared(spark):
    got = schema.accepted(table(spark), PARKING)
    want = elements.parking_details(table(spark))
    key = lambda df: sorted(str(sorted(r.asDict().items())) for r in df.collect())
    assert key(got) == key(want) and got.count() == 2
    assert sorted(got.columns) == sorted(want.columns)


def test_reasons(spark):
    said = {r.osm_id: r.reasons for r in schema.parsed(table(spark), BENCH).collect()}
    assert said[5] == [] and said[1] == ["amenity: not bench", "covered: not one of yes, no"]
    assert said[6] == ["capacity: not a number", "covered: not one of yes, no"]
    assert said[None] == ["osm_id: missing", "capacity: missing"]
    assert said[8] == ["feature_type: not one of node, way, relation", "amenity: missing", "capacity: missing"] == said[9]
    assert said[10] == ["tags: one without a value"]
    assert {r.osm_id for r in schema.refused(table(spark), BENCH).collect()} == {r[1] for r in ROWS} - {5}
    assert schema.parsed(table(spark, []), BENCH).count() == 0
    one = schema.accepted(table(spark), BENCH).first()
    assert (one.capacity, one.covered, one.other_tags) == (16.0, "yes", {})


def test_wrong_declarations():
    for make in (lambda: Field("a", "colour"), lambda: Field("a", "choice"), lambda: Field("a", "exactly", ("x", "y")), lambda: Field("a", "text", ("x",)), lambda: Schema("s", (Field("a"), Field("A"))), lambda: Schema("s", (Field("osm_id"),))):
        with pytest.raises(ValueError):
            make()
