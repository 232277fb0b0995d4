"""Degrees-minutes-seconds text and the inverse spherical Mercator."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from sedgetable.functions.numbers import decimal_or_null
from sedgetable.functions.text import bind, number_text, number_text_15, trim_space

# Accepted degree text, sphere radius and square extent in metres.
_DMS = (
    "(?i)^([+-]?[0-9]+(?:\\.[0-9]+)?)\\s*(?:°|d|\\s)\\s*([0-9]+(?:\\.[0-9]+)?)?\\s*(?:['′m]|\\s)?"
    "\\s*([0-9]+(?:\\.[0-9]+)?)?\\s*(?:[\"″s])?\\s*([NSEW])?\\z"
)
RADIUS = 6378137
EXTENT = math.pi * RADIUS


def degrees_or_null(c: Column, axis: str) -> Column:
    """Decimal degrees text with at most eight decimals; blank stays blank, null means refused."""
    if axis not in ("latitude", "longitude"):
        raise ValueError("axis is latitude or longitude")
    number = lambda v, i: F.coalesce(F.regexp_extract(v, _DMS, i).try_cast("double"), F.lit(0.0))
    letters = ("N", "S") if axis == "latitude" else ("E", "W")

    def total(p: Column) -> Column:
        negative = p["hemisphere"].isin("S", "W") | (p["degrees"] < 0)
        value = F.when(negative, -1.0).otherwise(1.0) * (F.abs(p["degrees"]) + p["minutes"] / 60 + p["seconds"] / 3600)
        ok = (
            (p["minutes"] < 60)
            & (p["seconds"] < 60)
            & ((p["hemisphere"] == "") | p["hemisphere"].isin(*letters))
            & ~((p["degrees"] < 0) & p["hemisphere"].isin("N", "E"))
        )
        return F.when(ok, value)

    def read(v: Column) -> Column:
        parts = F.struct(
            number(v, 1).alias("degrees"),
            number(v, 2).alias("minutes"),
            number(v, 3).alias("seconds"),
            F.upper(F.regexp_extract(v, _DMS, 4)).alias("hemisphere"),
        )
        within = lambda n: F.when(F.abs(n) <= (90 if axis == "latitude" else 180), number_text(F.round(n, 8)))
        return F.when(v == "", F.lit("")).when(v.rlike(_DMS), bind(bind(parts, total), within))

    return bind(trim_space(c), read)


def inverse_mercator(easting: Column, northing: Column) -> tuple[Column, Column]:
    """(latitude, longitude) text of a projected pair; null outside the square extent."""
    x, y = decimal_or_null(easting), decimal_or_null(northing)
    inside = (F.abs(x) <= EXTENT) & (F.abs(y) <= EXTENT)
    longitude = x / RADIUS * 180 / math.pi
    latitude = (F.lit(math.pi / 2) - 2 * F.atan(F.exp(-y / RADIUS))) * 180 / math.pi
    return F.when(inside, number_text_15(latitude)), F.when(inside, number_text_15(longitude))
