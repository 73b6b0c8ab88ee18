"""Cycling comfort of streets and paths: an ordered table of rules on a way's tags, of which the first that fits counts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagatlas.functions.tags import at_most, differs, equals, tag, whole_number, within

#: The comfort levels, from riding beside traffic to a way of one's own.
LEAST, LOW, HIGH, MOST = 1, 2, 3, 4
#: Kerbside uses from which a door may open onto a lane, and the speed up to which mixed traffic counts as calm.
PARKED = ("lane", "street_side", "separate")
CALM_SPEED = 30

#: Types of the attributes the rules set; one that a rule doesn't name is absent (NULL).
ATTRIBUTES = {
    "shared_with_pedestrians": "boolean", "shared_with_vehicles": "boolean", "comfort": "int", "oneway": "int", "class": "string", "subclass": "string",
    "side": "string", "construction": "boolean", "dooring_risk": "boolean", "website": "string", "opening_date": "string",
}


@dataclass
class Rule:
    name: str
    when: Column
    attributes: dict[str, Column | str | int | bool] = field(default_factory=dict)


def _doors(*sides: Column) -> Column:
    out = within(sides[0], *PARKED)
    for side in sides[1:]:
        out = out | within(side, *PARKED)
    return out


def rules(tags: str = "tags", maxspeed_invalid: str = "zero") -> list[Rule]:
    t = {k: tag(k, tags) for k in (
        "highway", "bicycle", "foot", "segregated", "oneway", "oneway:bicycle", "construction", "cycleway", "cycleway:both", "cycleway:left", "cycleway:right",
        "cycleway:left:oneway", "cycleway:right:oneway", "parking", "parking:both", "parking:left", "parking:right", "motor_vehicle", "website", "opening_date",
    )}
    street, oneway = t["highway"].isNotNull(), equals(t["oneway"], "yes")
    left, right = equals(t["cycleway:left"], "lane"), equals(t["cycleway:right"], "lane")
    calm = at_most(whole_number(tag("maxspeed", tags), maxspeed_invalid), CALM_SPEED)
    walkers = equals(t["foot"], "designated")
    forward = F.when(oneway, 1).otherwise(0)
    no_opposite = F.when(equals(t["oneway:bicycle"], "no"), 0).otherwise(forward)

    def path(shared: Column, subclass: Column | str, **more: Column | bool) -> dict:
        return {"shared_with_pedestrians": shared, "shared_with_vehicles": False, "comfort": F.when(shared, HIGH).otherwise(MOST), "oneway": forward, "class": "track", "subclass": subclass} | more

    def lane(doors: Column | None, direction: Column | int, side: Column | str) -> dict:
        risk = {} if doors is None else {"dooring_risk": F.when(doors, True)}
        comfort = LOW if doors is None else F.when(doors, LEAST).otherwise(LOW)
        return {"shared_with_pedestrians": False, "shared_with_vehicles": False, "comfort": comfort, "oneway": direction, "class": "lane", "side": side} | risk

    mixed = {"shared_with_vehicles": True, "oneway": no_opposite, "class": "lane"}
    left_first, right_first = F.when(left, "left").otherwise("right"), F.when(right, "right").otherwise("left")
    beside_left = lambda side: F.when(side == "left", t["parking:left"]).otherwise(t["parking:right"])
    return [
        Rule("cycleway", equals(t["highway"], "cycleway"), path(walkers & equals(t["segregated"], "no"), "cycleway")),
        Rule("designated_path", within(t["highway"], "path", "pedestrian") & equals(t["bicycle"], "designated"), path((walkers | equals(t["highway"], "pedestrian")) & differs(t["segregated"], "yes"), "path")),
        Rule("track_beside_street", street & equals(t["cycleway"], "track"), path(walkers & differs(t["segregated"], "yes"), F.concat(F.lit("combined-"), t["highway"]))),
        Rule("cycleway_in_construction", equals(t["highway"], "construction") & equals(t["construction"], "cycleway"), path(walkers & differs(t["segregated"], "yes"), "cycleway", construction=True, website=t["website"], opening_date=t["opening_date"])),
        Rule("lanes_both_ways", street & ~oneway & (equals(t["cycleway"], "lane") | equals(t["cycleway:both"], "lane") | (left & right)), lane(within(t["parking"], "lane", "street_side") | _doors(t["parking:both"], t["parking:right"], t["parking:left"]), 0, "both")),
        Rule("two_way_lane", street & ~oneway & ((right & equals(t["cycleway:right:oneway"], "no")) | (left & equals(t["cycleway:left:oneway"], "no"))), lane(None, 0, right_first)),
        Rule("lane_on_oneway_street", street & oneway & (equals(t["cycleway"], "lane") | left | right), lane(_doors(beside_left(left_first)), F.when(left & right, 0).otherwise(1), left_first)),
        # the cycleway:both arm needs no highway
        Rule("shared_lane", (street & within(t["cycleway"], "shared_lane", "shared")) | within(t["cycleway:both"], "shared_lane", "shared"), mixed | {"shared_with_pedestrians": False, "comfort": F.when(equals(t["motor_vehicle"], "private") | calm, HIGH).otherwise(LEAST)}),
        Rule("calm_street", equals(t["highway"], "residential") & within(t["bicycle"], "yes", "designated") & calm, mixed | {"shared_with_pedestrians": equals(t["foot"], "yes"), "comfort": HIGH}),
        Rule("lane_on_one_side", street & ((right & equals(t["cycleway:left"], "no")) | (left & equals(t["cycleway:right"], "no"))), lane(_doors(t["parking:both"], beside_left(left_first)), F.when(left, -1).otherwise(1), left_first)),
    ]


def classify(ways: DataFrame, tags: str = "tags", maxspeed_invalid: str = "zero", keep_unmatched: bool = False) -> DataFrame:
    """Adds branch (1 for the first rule) and the ATTRIBUTES to every way that a rule fits; the others go, unless kept.

    Columns can_be_line (if there) must be true. A map without tags, or NULL, fits no rule. Clashing columns of the input are replaced."""
    table = rules(tags, maxspeed_invalid)
    first = F.when(table[0].when, 1)
    for i, rule in enumerate(table[1:], 2):
        first = first.when(rule.when, i)
    out = ways.where(F.coalesce("can_be_line", F.lit(False))) if "can_be_line" in ways.columns else ways
    # exploding no or one branch drops what fits no rule; a filter would be pushed below and evaluate the whole table a second time
    out = out.withColumn("branch", first if keep_unmatched else F.explode(F.array_compact(F.array(first))))
    return out.withColumns({name: _chosen(table, name).cast(kind) for name, kind in ATTRIBUTES.items()})


def _chosen(table: list[Rule], name: str) -> Column:
    out = None
    for i, rule in enumerate(table, 1):
        if name in rule.attributes:
            value = rule.attributes[name]
            value = value if isinstance(value, Column) else F.lit(value)
            out = F.when(F.col("branch") == i, value) if out is None else out.when(F.col("branch") == i, value)
    return out
