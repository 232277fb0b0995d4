"""Whitespace, blanks, search and number rendering as native expressions."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The two whitespace sets of the data model. Project tables drop
# the byte-order mark, large tables drop the separator controls and NEL.
_COMMON_SPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    + "".join(chr(code) for code in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
PROJECT_SPACE = _COMMON_SPACE + "\ufeff"
RECORD_SPACE = _COMMON_SPACE + "\x1c\x1d\x1e\x1f\x85"


def trim_space(c: Column, space: str = PROJECT_SPACE) -> Column:
    """Drop outer whitespace. Text that starts and ends in printable ASCII skips the set search."""
    last = F.right(c, F.lit(1))
    plain = (c >= "!") & (c < "\x7f") & (last >= "!") & (last < "\x7f")
    return F.when(plain, c).otherwise(F.btrim(c, F.lit(space)))


def is_blank(c: Column, space: str = PROJECT_SPACE) -> Column:
    return trim_space(c, space) == ""


def starts_with_digit(c: Column) -> Column:
    return (c >= "0") & (c < ":")


def contains_folded(c: Column, text: str) -> Column:
    """Literal substring, A-Z folded; ``%``, ``_`` and ``\\`` are ordinary."""
    fold = lambda x: F.translate(x, string.ascii_uppercase, string.ascii_lowercase)
    return F.contains(fold(c), fold(F.lit(text)))


def folded_name(name: str) -> str:
    """Header reduced to lower-case ASCII letters and digits."""
    return "".join(ch for ch in name.lower() if ch.isascii() and ch.isalnum())


def folded_name_column(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def numeric_sort_key(c: Column) -> Column:
    """Digit runs compare by value: each run carries its length before its digits."""
    runs = F.regexp_extract_all(F.lower(c), F.lit("[0-9]+|[^0-9]+"), F.lit(0))

    def keyed(run: Column) -> Column:
        digits = F.coalesce(F.nullif(F.ltrim(run, F.lit("0")), F.lit("")), F.lit("0"))
        padded = F.concat(F.lpad(F.length(digits).cast("string"), 6, "0"), digits)
        return F.when(run.rlike("^[0-9]"), padded).otherwise(run)

    return F.transform(runs, keyed)


def bind(value: Column, build: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``build``.

    Without it a nested expression is copied at every use and its plan grows
    beyond what can be compiled.
    """
    return F.get(F.transform(F.array(value), build), F.lit(0))


def _plain_number(parts: Column) -> Column:
    """Write sign, significant digits and decimal exponent the way scripts print numbers."""
    sign, digits, exponent = parts["sign"], parts["digits"], parts["exponent"]
    size = F.length(digits)
    whole = F.concat(digits, F.repeat(F.lit("0"), exponent + 1 - size))
    mixed = F.concat(F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, size))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    rest = F.substring(digits, F.lit(2), size)
    science = F.concat(
        F.substring(digits, 1, 1),
        F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(F.lit("")),
        F.when(exponent >= 0, F.lit("e+")).otherwise(F.lit("e-")),
        F.abs(exponent).cast("string"),
    )
    body = (
        F.when(exponent.between(0, 20) & (size <= exponent + 1), whole)
        .when(exponent.between(0, 20), mixed)
        .when(exponent.between(-6, -1), small)
        .otherwise(science)
    )
    return F.concat(sign, body)


def _scientific(text: Column, mark: str) -> Column:
    """Sign, digits without trailing zeros and exponent of a ``d.ddde±x`` text."""
    return F.struct(
        F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit("")).alias("sign"),
        F.rtrim(F.translate(F.substring_index(text, mark, 1), "-.", ""), F.lit("0")).alias("digits"),
        F.substring_index(text, mark, -1).try_cast("int").alias("exponent"),
    )


def number_text(c: Column) -> Column:
    """Shortest text of a double: ``1`` and ``0.0001``, not ``1.0`` and ``1.0E-4``."""
    return bind(
        c.cast("string"),
        lambda text: F.when(text.isin("0.0", "-0.0"), F.lit("0"))
        .when(text.contains("E"), bind(_scientific(text, "E"), _plain_number))
        .otherwise(F.regexp_replace(text, "\\.0$", "")),
    )


def number_text_15(c: Column) -> Column:
    """Text of a double after rounding to 15 significant digits."""
    shown = F.format_string("%.14e", c)
    return bind(F.when(c.isNotNull(), shown), lambda text: bind(_scientific(text, "e"), lambda p: F.when(p["digits"] == "", F.lit("0")).otherwise(_plain_number(p))))
