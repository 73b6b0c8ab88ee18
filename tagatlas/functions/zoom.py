"""Values that depend on the zoom level: linear and exponential interpolation between stops, and steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _checked(stops: list[tuple[float, object]]) -> list[tuple[float, object]]:
    if not stops or any(a[0] >= b[0] for a, b in zip(stops, stops[1:])):
        raise ValueError("stops need ascending zoom levels")
    return stops


def interpolated(zoom: Column, stops: list[tuple[float, float]], base: float = 1.0) -> Column:
    """Between two stops the value grows linearly (base 1), or faster towards the upper stop (base over 1). Outside it is the nearest stop's."""
    stops = _checked(stops)
    out = F.when(zoom <= float(stops[0][0]), F.lit(float(stops[0][1])))
    for (z0, v0), (z1, v1) in zip(stops, stops[1:]):
        done = zoom - float(z0)
        part = done / float(z1 - z0) if base == 1 else (F.pow(F.lit(float(base)), done) - 1) / (float(base) ** (z1 - z0) - 1)
        out = out.when(zoom <= float(z1), float(v0) + part * float(v1 - v0))
    return out.when(zoom > float(stops[-1][0]), F.lit(float(stops[-1][1])))


def interpolated_color(zoom: Column, stops: list[tuple[float, tuple[float, ...]]], base: float = 1.0) -> Column:
    """As interpolated, for each of red, green, blue and opacity; written as rgba()."""
    channel = [interpolated(zoom, [(z, c[i]) for z, c in stops], base) for i in range(4)]
    whole = [F.round(c).cast("int").cast("string") for c in channel[:3]]
    return F.concat(F.lit("rgba("), F.concat_ws(",", *whole, F.round(channel[3], 4).cast("string")), F.lit(")"))


def stepped(zoom: Column, stops: list[tuple[float, object]]) -> Column:
    """The value of the last stop at or below the zoom level; below all stops the first one's."""
    out = F.when(zoom < float(_checked(stops)[0][0]), F.lit(stops[0][1]))
    for z, value in reversed(stops):
        out = out.when(zoom >= float(z), F.lit(value))
    return out
