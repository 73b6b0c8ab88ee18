"""Single map elements: looked up by type and id, read against a schema, with the tags that the schema doesn't name kept aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagatlas.functions.tags import coerced_number, equals, leftover, one_of, tag, yes_or_no

#: The kinds of bicycle parking that are known.
PARKING_TYPES = [
    "stands", "wall_loops", "rack", "shed", "bollard", "wide_stands", "building", "lockers", "wave", "anchors", "floor", "safe_loops", "ground_slots",
    "handlebar_holder", "informal", "two-tier", "streetpod", "lean_and_stick", "upright_stands", "tree", "saddle_holder", "crossbar", "rope", "arcadia", "log_with_slots",
]


def lookup(elements: DataFrame, feature_type: str | None, osm_id: int | None) -> DataFrame:
    """The element of a type and id; ids are only unique within their type. No row where either is None."""
    return elements.where((F.col("feature_type") == F.lit(feature_type)) & (F.col("osm_id") == F.lit(osm_id).cast("bigint")))


def exactly_one(found: DataFrame) -> DataFrame:
    """The row found; an error when the result is read if there is none or more than one."""
    n = found.agg(F.count("*").alias("n")).select(F.when(F.col("n") != 1, F.raise_error(F.concat(F.lit("elements found: "), F.col("n").cast("string")))).otherwise(True).alias("ok"))
    # one row each side: the count is the whole of the build side
    return n.where("ok").join(found, F.lit(True), "left").drop("ok")


def fits_base(details: DataFrame) -> Column:
    """Whether a row holds to the schema all kinds of elements share: a text type (NULL stands for the default), a known element type, an id, and no tag aside without value."""
    tags = F.col("other_tags") if "other_tags" in details.columns else F.lit(None).cast("map<string,string>")
    whole = F.coalesce(~F.exists(F.map_values(tags), lambda v: v.isNull()), F.lit(True))
    return F.coalesce(F.col("feature_type").isin("node", "way", "relation"), F.lit(False)) & F.col("osm_id").isNotNull() & whole


def parking_details(elements: DataFrame, strict: bool = False) -> DataFrame:
    """Rows (feature_type, osm_id, tags) as bicycle parking: typed columns, and other_tags with the tags no column has taken.

    Rows of another amenity, another element type or with a tag named type that says otherwise are no parking: left out, or an error
    if strict. An unknown kind of parking and an unreadable capacity are NULL, and then stay among the other tags. The kind is renamed,
    so its own tag always stays among the others."""
    t = lambda k: tag(k)
    fits = equals(t("amenity"), "bicycle_parking") & F.coalesce(F.col("feature_type").isin("node", "way"), F.lit(False)) & equals(F.coalesce(t("type"), F.lit("bike_parking")), "bike_parking")
    rows = elements.where(F.when(fits, True).otherwise(F.raise_error(F.lit("not bicycle parking")).cast("boolean"))) if strict else elements.where(fits)
    fields: dict[str, Column] = {
        "amenity": t("amenity"), "bicycleParkingType": one_of(t("bicycle_parking"), PARKING_TYPES), "name": t("name"), "operator": t("operator"),
        "operator:wikidata": t("operator:wikidata"), "indoor": yes_or_no(t("indoor")), "capacity": coerced_number(t("capacity")), "covered": yes_or_no(t("covered")),
    }
    taken = F.array_compact(F.array(F.lit("type"), F.lit("featureType"), F.lit("osmId"), *[F.when(v.isNotNull(), F.lit(k)) for k, v in fields.items()]))
    return rows.select("feature_type", "osm_id", F.lit("bike_parking").alias("type"), *[v.alias(k) for k, v in fields.items()], leftover(F.col("tags"), taken).alias("other_tags"))


def parking_box(details: DataFrame) -> DataFrame:
    """What an information box says of capacity and kind; an unknown or zero capacity is Unknown."""
    capacity = F.when(F.coalesce(F.col("capacity"), F.lit(0.0)) != 0, F.regexp_replace(F.col("capacity").cast("string"), r"\.0$", "")).otherwise("Unknown")
    return details.select("feature_type", "osm_id", capacity.alias("capacity_text"), F.coalesce("bicycleParkingType", F.lit("Unknown")).alias("type_text"))


def way_box(ways: DataFrame) -> DataFrame:
    """Title and badges of a cycling way's information box."""
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    title = F.concat(F.lit("Cycling "), F.when(F.col("class").eqNullSafe(F.lit("lane")), "Lane").otherwise("Track"))
    title = F.when(F.coalesce(F.length("name"), F.lit(0)) > 0, F.concat(F.col("name"), F.lit(" ("), title, F.lit(")"))).otherwise(title)
    where = F.when(F.col("class") == "track", "track (separated from roadway)").when((F.col("class") == "lane") & on("shared_with_vehicles"), "shared lane").otherwise("bike lane on roadway")
    badges = F.array_compact(F.array(
        F.when(on("construction"), "Under Construction"), F.when(on("dooring_risk"), "risk of dooring (adjacent parking)"), F.when(on("shared_with_vehicles"), "shared with vehicles"),
        F.when(on("shared_with_pedestrians"), "shared with pedestrians"), F.when(F.abs("oneway") == 1, "one way"), where,
    ))
    return ways.withColumns({"title": title, "badges": badges})


def with_state(features: DataFrame, state: DataFrame) -> DataFrame:
    """Features with the state (selected, hover) that state, one row an osm_id, has of them; NULL for those it doesn't know."""
    return features.drop("selected", "hover").join(state.select("osm_id", "selected", "hover"), "osm_id", "left")
