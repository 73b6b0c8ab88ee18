"""Schemas of map elements, declared: which tags an element must and may have, and what becomes of them.

    parsed(elements, BENCH)     typed columns, other_tags, and reasons: why a row doesn't hold to the schema (empty if it does)
    accepted(elements, BENCH)   rows that do, without reasons

A declaration is compiled into columns, so all rows are read and judged in one pass, whatever the number of fields.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagatlas.functions.tags import coerced_number, leftover, tag, yes_or_no
from tagatlas.operators.elements import PARKING_TYPES

ELEMENTS = ("node", "way", "relation")


@dataclass(frozen=True)
class Field:
    """A column made from a tag.

    kind: text; number (as a browser reads it); yes_or_no (other words count as yes); choice (of values); or exactly (the one value).
    A missing tag is NULL, or `default`, or a reason if required. A value that the kind can't read is a reason, or NULL if `lenient`;
    then its tag stays among the others.
    """

    name: str
    kind: str = "text"
    values: tuple[str, ...] = ()
    key: str | None = None
    required: bool = False
    lenient: bool = False
    default: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in ("text", "number", "yes_or_no", "choice", "exactly"):
            raise ValueError(f"{self.name}: no kind {self.kind}")
        if bool(self.values) != (self.kind in ("choice", "exactly")) or (self.kind == "exactly" and len(self.values) != 1):
            raise ValueError(f"{self.name}: {self.kind} with {len(self.values)} values")

    def given(self) -> Column:
        own = tag(self.key or self.name)
        return own if self.default is None else F.coalesce(own, F.lit(self.default))

    def value(self) -> Column:
        if self.kind == "number":
            return coerced_number(self.given())
        if self.kind == "yes_or_no":
            return yes_or_no(self.given())
        return F.when(self.given().isin(*self.values), self.given()) if self.values else self.given()

    def reason(self) -> Column:
        """Why a row doesn't hold to the field, or NULL."""
        wrong = {"number": "not a number", "choice": f"not one of {', '.join(self.values)}", "exactly": f"not {', '.join(self.values)}"}.get(self.kind)
        out = F.when(self.given().isNull(), F.lit(f"{self.name}: missing")) if self.required else F.lit(None).cast("string")
        if wrong and not self.lenient:
            out = F.coalesce(out, F.when(self.given().isNotNull() & self.value().isNull(), F.lit(f"{self.name}: {wrong}")))
        return out


@dataclass(frozen=True)
class Schema:
    """feature_types: the kinds of elements that may have it. Names of fields are the result's columns and must differ from its own."""

    name: str
    fields: tuple[Field, ...]
    feature_types: tuple[str, ...] = ELEMENTS

    def __post_init__(self) -> None:
        names = [f.name.lower() for f in self.fields]
        if len(set(names)) < len(names) or {"feature_type", "osm_id", "other_tags", "reasons"} & set(names):
            raise ValueError(f"{self.name}: names of fields meet")


#: Bicycle parking, as operators.elements.parking_details has it.
PARKING = Schema(
    "bike_parking",
    (
        Field("type", "exactly", ("bike_parking",), default="bike_parking"), Field("amenity", "exactly", ("bicycle_parking",), required=True), Field("bicycleParkingType", "choice", tuple(PARKING_TYPES), key="bicycle_parking", lenient=True),
        Field("name"), Field("operator"), Field("operator:wikidata"), Field("indoor", "yes_or_no"), Field("capacity", "number", lenient=True), Field("covered", "yes_or_no"),
    ),
    ("node", "way"),
)
BENCH = Schema("bench", (Field("amenity", "exactly", ("bench",), required=True), Field("capacity", "number", required=True), Field("covered", "choice", ("yes", "no")), Field("name")))


def parsed(elements: DataFrame, schema: Schema) -> DataFrame:
    """Rows (feature_type, osm_id, tags) with the schema's columns, other_tags (the tags that no column has taken under their own name) and reasons (texts, in the order of the schema; empty for a row that holds to it).

    What all schemas share is judged too: an element of a known kind, with an id and no tag without a value. NULL tags are none."""
    tags = F.coalesce("tags", F.expr("cast(map() as map<string,string>)"))
    rows = elements.withColumn("tags", tags)
    base = [
        F.when(~F.coalesce(F.col("feature_type").isin(*schema.feature_types), F.lit(False)), F.lit(f"feature_type: not one of {', '.join(schema.feature_types)}")), F.when(F.col("osm_id").isNull(), F.lit("osm_id: missing")),
        F.when(F.exists(F.map_values("tags"), lambda v: v.isNull()), F.lit("tags: one without a value")),
    ]
    reasons = F.array_compact(F.array(*base, *[f.reason() for f in schema.fields]))
    taken = F.array_compact(F.array(F.lit("type"), F.lit("featureType"), F.lit("osmId"), *[F.when(f.value().isNotNull(), F.lit(f.name)) for f in schema.fields]))
    return rows.select("feature_type", "osm_id", *[f.value().alias(f.name) for f in schema.fields], leftover(F.col("tags"), taken).alias("other_tags"), reasons.alias("reasons"))


def accepted(elements: DataFrame, schema: Schema) -> DataFrame:
    return parsed(elements, schema).where(F.size("reasons") == 0).drop("reasons")


def refused(elements: DataFrame, schema: Schema) -> DataFrame:
    """(feature_type, osm_id, reasons) of rows that don't hold to the schema."""
    return parsed(elements, schema).where(F.size("reasons") > 0).select("feature_type", "osm_id", "reasons")
