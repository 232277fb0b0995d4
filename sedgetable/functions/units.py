"""Reviewed unit conversion between units of one dimension."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sedgetable.functions.numbers import decimal_or_null
from sedgetable.functions.text import bind, number_text_15

# The units of each dimension with their factor to its base unit.
FACTORS = {
    "length": {"mm": 0.001, "cm": 0.01, "m": 1.0, "ft": 0.3048, "km": 1000.0, "mi": 1609.344},
    "mass": {"mg": 0.000001, "g": 0.001, "kg": 1.0},
    "area": {"m2": 1.0, "cm2": 0.0001, "km2": 1000000.0, "ha": 10000.0},
    "duration": {"s": 1.0, "min": 60.0, "h": 3600.0, "d": 86400.0},
}
TEMPERATURES = ("C", "F", "K")
DIMENSION = {unit: kind for kind, units in FACTORS.items() for unit in units} | {t: "temperature" for t in TEMPERATURES}


def _to_celsius(n: Column, unit: Column) -> Column:
    return F.when(unit == "K", n - 273.15).when(unit == "F", (n - 32) * 5 / 9).when(unit == "C", n)


def _from_celsius(n: Column, unit: str) -> Column:
    if unit == "K":
        return n + 273.15
    return n * 9 / 5 + 32 if unit == "F" else n


def convert_unit(value: Column, source: Column, target: str) -> Column:
    """Converted text, or null when the value is no number or the dimensions differ."""
    if target not in DIMENSION:
        raise ValueError(f"unknown unit: {target}")
    n = decimal_or_null(value)
    if target in TEMPERATURES:
        converted = bind(n, lambda x: _from_celsius(_to_celsius(x, source), target))
    else:
        units = FACTORS[DIMENSION[target]]
        table = F.create_map(*[F.lit(x) for unit, factor in units.items() for x in (unit, factor)])
        converted = n * F.try_element_at(table, source) / units[target]
    converted = F.when(source == target, n).otherwise(converted)
    return bind(converted, lambda x: F.when(F.abs(x) < F.lit(float("inf")), number_text_15(x)))
