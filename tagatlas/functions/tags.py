"""Tests and conversions of open key/value tags. A missing tag never makes a test NULL: it is false, or true when negated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

JS_HEX = r"^\s*0[xX]([0-9a-fA-F]{1,13})\s*$"
#: What try_cast would take but a JavaScript number would not: trailing type letters, inf and nan spellings.
JS_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|Infinity)\s*$"


def tag(key: str | Column, tags: str | Column = "tags") -> Column:
    """The tag's value, NULL if there is none. The key may be a column."""
    return (F.col(tags) if isinstance(tags, str) else tags)[key]


def has(key: str, tags: str | Column = "tags") -> Column:
    return F.coalesce(F.map_contains_key(F.col(tags) if isinstance(tags, str) else tags, key), F.lit(False))


def equals(value: Column, wanted: object) -> Column:
    return value.eqNullSafe(F.lit(wanted))


def differs(value: Column, unwanted: object) -> Column:
    """True also where there is no value."""
    return ~value.eqNullSafe(F.lit(unwanted))


def within(value: Column, *wanted: object) -> Column:
    return F.coalesce(value.isin(*wanted), F.lit(False))


def outside(value: Column, *unwanted: object) -> Column:
    return ~within(value, *unwanted)


def at_most(value: Column, limit: float) -> Column:
    return F.coalesce(value <= limit, F.lit(False))


def whole_number(value: Column, invalid: str = "zero") -> Column:
    """A tag read as a whole number. Text that is none counts as 0 or as missing (invalid = "zero" or "null"); no tag stays NULL."""
    if invalid not in ("zero", "null"):
        raise ValueError(f"invalid must be zero or null, not {invalid}")
    read = F.when(value.rlike(r"^[+-]?[0-9]+$"), value.try_cast("bigint"))
    return F.when(value.isNotNull(), F.coalesce(read, F.lit(0).cast("bigint"))) if invalid == "zero" else read


def one_of(value: Column, allowed: list[str]) -> Column:
    """The value if it is allowed, else NULL."""
    return F.when(value.isin(allowed), value)


def coerced_number(value: Column) -> Column:
    """Text as a browser coerces it to a number: blank is 0, hexadecimal is read, anything unreadable is NULL."""
    digits = F.regexp_extract(value, JS_HEX, 1)
    plain = F.when(F.trim(value).contains("Infinity"), F.lit(None).cast("double")).otherwise(F.trim(value).try_cast("double"))
    return F.when(value.rlike(r"^\s*$"), 0.0).when(digits != "", F.conv(digits, 16, 10).cast("double")).when(value.rlike(JS_NUMBER), plain)


def yes_or_no(value: Column) -> Column:
    """no is false, other words are true, an empty or missing value is NULL."""
    return F.when(value == "no", False).when(value != "", True)


def leading_integer(value: Column) -> Column:
    """The whole number a text begins with, else NULL."""
    return F.regexp_extract(value, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint")


def leading_number(value: Column) -> Column:
    """The decimal number a text begins with, else NULL."""
    return F.regexp_extract(value, r"^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)", 1).try_cast("double")


def clamped(value: Column, low: float, high: float, default: float) -> Column:
    """The value within [low, high]; the default where there is none or it is not a number."""
    return F.when(value.isNull() | F.isnan(value), F.lit(float(default))).otherwise(F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high))))


def without_nulls(tags: Column) -> Column:
    return F.map_filter(tags, lambda k, v: v.isNotNull())


def leftover(tags: Column, used: Column) -> Column:
    """Tags whose key is not among the used ones."""
    return F.map_filter(F.coalesce(tags, F.expr("cast(map() as map<string,string>)")), lambda k, v: ~F.array_contains(used, k))
