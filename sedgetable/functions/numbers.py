"""Numeric grammars. Every cast is guarded because bare casts accept ``3d`` and ``NaN``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sedgetable.functions.text import PROJECT_SPACE, RECORD_SPACE, bind, trim_space

# Accepted spellings of numbers, one per grammar.
INTEGER = r"^[+-]?[0-9]+\z"
DECIMAL = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
PYTHON_FLOAT = r"^[+-]?(?:[0-9](?:_?[0-9])*\.?(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?\z"
MAX_SAFE_INTEGER = 9007199254740991


def _finite(number: Column) -> Column:
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def decimal_or_null(c: Column) -> Column:
    """Declared-number grammar: no surrounding space, finite."""
    return F.when(c.rlike(DECIMAL), _finite(c.try_cast("double")))


def integer_or_null(c: Column) -> Column:
    """Declared-integer grammar: digits with a sign, within the exact double range."""
    return F.when(c.rlike(INTEGER), F.when(F.abs(c.try_cast("double")) <= MAX_SAFE_INTEGER, c.try_cast("long")))


def script_number_or_null(c: Column) -> Column:
    """Loose coordinate grammar: outer space ignored; hexadecimal, octal and binary accepted."""
    return bind(trim_space(c, PROJECT_SPACE), trimmed_script_number)


def _radix(digits: Column, base: int, exact: int) -> Column:
    """Value of digits as a double; above ``exact`` digits they are added up one by one."""
    each = F.transform(F.split(digits, ""), lambda d: F.conv(d, base, 10).cast("double"))
    summed = F.aggregate(each, F.lit(0.0), lambda a, d: a * float(base) + d)
    return F.when(F.length(digits) <= exact, F.conv(digits, base, 10).cast("double")).otherwise(summed)


def trimmed_script_number(v: Column) -> Column:
    """The loose coordinate grammar on text without outer space."""
    digits = F.substring(v, 3, 2**31 - 1)
    radix = F.when(v.rlike("^0[xX][0-9a-fA-F]+\\z"), _radix(digits, 16, 15))
    radix = radix.when(v.rlike("^0[oO][0-7]+\\z"), _radix(digits, 8, 17))
    radix = radix.when(v.rlike("^0[bB][01]+\\z"), _radix(digits, 2, 52))
    prefixed = F.when(v.startswith("0") & (F.octet_length(v) > 2), radix.try_cast("double"))
    return F.when(v.rlike(DECIMAL), _finite(v.try_cast("double"))).otherwise(prefixed)


def record_number_or_null(c: Column) -> Column:
    """Import-profile grammar: outer space ignored and single underscores between digits."""
    return bind(trim_space(c, RECORD_SPACE), lambda v: F.when(v.rlike(PYTHON_FLOAT), _finite(F.replace(v, F.lit("_"), F.lit("")).try_cast("double"))))


def type_class(c: Column) -> Column:
    """empty, integer, number, date-like, boolean or text."""
    return bind(
        trim_space(c),
        lambda v: F.when(v == "", "empty")
        .when(v.rlike(INTEGER), "integer")
        .when(v.rlike(DECIMAL), "number")
        .when(v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:T[^\n\r]*)?\z"), "date-like")
        .when(v.rlike("(?i)^(true|false)\\z"), "boolean")
        .otherwise("text"),
    )


def fits_declared_type(c: Column, data_type: str) -> Column:
    from sedgetable.functions.dates import is_iso_day

    if data_type == "integer":
        return integer_or_null(c).isNotNull()
    if data_type == "number":
        return decimal_or_null(c).isNotNull()
    if data_type == "boolean":
        return c.rlike("(?i)^(true|false)\\z")
    if data_type == "date":
        return is_iso_day(c)
    return F.lit(True)
