"""Calendar checks on text. Results stay text, so year 0000 is representable."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sedgetable.functions.text import bind

# Reviewed date formats, month names and day-serial limits.
DATE_FORMATS = ("ISO", "DMY", "MDY", "english-day-month", "english-month-day", "year", "month", "excel1900", "excel1904")
STRICT_FORMATS = ("ISO", "year", "month", "excel1900", "excel1904", "DMY", "MDY")
MONTHS = "january february march april may june july august september october november december".split()
LAST_SERIAL = 2958465
FAR_SERIAL = 2**31 - 1  # days are 32-bit numbers
PHANTOM_SERIAL = 60


def _part(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(c, pattern, group).try_cast("int")


def days_in_month(year: Column, month: Column) -> Column:
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def _existing_day(p: Column) -> Column:
    year, month, day = p["y"], p["m"], p["d"]
    exists = year.between(0, 9999) & month.between(1, 12) & (day >= 1) & (day <= days_in_month(year, month))
    pad = lambda n, size: F.lpad(n.cast("string"), size, "0")
    return F.when(exists, F.concat_ws("-", pad(year, 4), pad(month, 2), pad(day, 2)))


def iso_or_null(year: Column, month: Column, day: Column) -> Column:
    """``yyyy-mm-dd`` when the day exists in the proleptic Gregorian calendar, else null."""
    return bind(F.struct(year.alias("y"), month.alias("m"), day.alias("d")), _existing_day)


def is_iso_day(c: Column) -> Column:
    part = lambda start, size: F.substring(c, start, size).try_cast("int")
    return c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & iso_or_null(part(1, 4), part(6, 2), part(9, 2)).isNotNull()


def _serial(c: Column, base: str, phantom: bool, pattern: str, far: bool = False) -> Column:
    n = F.when(c.rlike(pattern), F.regexp_extract(c, "^([0-9]+)", 1).try_cast("long"))

    def day_of(n: Column) -> Column:
        shift = F.when(n > PHANTOM_SERIAL, n - 1).otherwise(n) if phantom else n
        day = F.when(n.between(0, FAR_SERIAL if far else LAST_SERIAL), F.date_add(F.lit(base).cast("date"), shift.cast("int")))
        # A pattern of year letters puts a plus before a fifth digit.
        text = F.format_string("%04d-%02d-%02d", F.year(day), F.month(day), F.day(day)) if far else F.date_format(day, "yyyy-MM-dd")
        keep = day.isNotNull() if far else F.year(day) <= 9999
        return F.when(keep & (n != PHANTOM_SERIAL) if phantom else keep, text)

    return bind(n, day_of)


def strict_date(c: Column, fmt: str, far: bool = False) -> Column:
    """Whole-column date grammar: mixed separators allowed, four-digit years only. Null means refused.

    ``far`` also reads serial numbers of days after 9999-12-31, whose years have more digits.
    """
    if fmt not in STRICT_FORMATS:
        raise ValueError(f"unsupported date format: {fmt}")
    if fmt == "ISO":
        out = F.when(is_iso_day(c), c)
    elif fmt == "year":
        out = F.when(c.rlike("^[0-9]{4}\\z"), c)
    elif fmt == "month":
        out = F.when(c.rlike("^[0-9]{4}-(0[1-9]|1[0-2])\\z"), c)
    elif fmt in ("excel1900", "excel1904"):
        out = _serial(c, "1904-01-01" if fmt == "excel1904" else "1899-12-31", fmt == "excel1900", "^[0-9]+\\z", far)
    else:
        p = r"^([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})\z"
        first, second = _part(c, p, 1), _part(c, p, 2)
        day, month = (first, second) if fmt == "DMY" else (second, first)
        out = iso_or_null(_part(c, p, 3), month, day)
    return F.when(c == "", c).otherwise(out)


def _month_number(name: Column) -> Column:
    lowered = F.lower(name)
    pairs = []
    for i, month in enumerate(MONTHS, 1):
        pairs += [F.lit(month), F.lit(i)]
        if len(month) > 3:
            pairs += [F.lit(month[:3]), F.lit(i)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), lowered), F.lit(0))


def reviewed_date(c: Column, fmt: str, century: int | None = None) -> Column:
    """Reviewed date grammar: one separator throughout, two-digit years only with a century."""
    if fmt not in DATE_FORMATS:
        raise ValueError(f"unsupported date format: {fmt}")
    if century is not None and (isinstance(century, bool) or not isinstance(century, int) or not 0 <= century <= 9900 or century % 100):
        raise ValueError("a century is a multiple of 100 between 0 and 9900")
    if fmt in ("ISO", "year", "month"):
        out = strict_date(c, fmt)
    elif fmt in ("excel1900", "excel1904"):
        out = _serial(c, "1904-01-01" if fmt == "excel1904" else "1899-12-31", fmt == "excel1900", r"^[0-9]+(?:\.0+)?\z")
    elif fmt in ("DMY", "MDY"):
        p = r"^([0-9]{1,2})([/-])([0-9]{1,2})\2([0-9]{2}|[0-9]{4})\z"

        def read(t: Column) -> Column:
            short = F.lit(None).cast("int") if century is None else t["year"].try_cast("int") + century
            year = F.when(F.length(t["year"]) == 2, short).otherwise(t["year"].try_cast("int"))
            day, month = (t["first"], t["second"]) if fmt == "DMY" else (t["second"], t["first"])
            return iso_or_null(year, month, day)

        parts = F.struct(_part(c, p, 1).alias("first"), _part(c, p, 3).alias("second"), F.regexp_extract(c, p, 4).alias("year"))
        out = F.when(c.rlike(p), bind(parts, read))
    elif fmt == "english-day-month":
        p = r"^([0-9]{1,2})([- ])([A-Za-z]+)\2([0-9]{4})\z"
        out = iso_or_null(_part(c, p, 4), _month_number(F.regexp_extract(c, p, 3)), _part(c, p, 1))
    else:
        p = r"^([A-Za-z]+) ([0-9]{1,2})(?:,)? ([0-9]{4})\z"
        out = iso_or_null(_part(c, p, 3), _month_number(F.regexp_extract(c, p, 1)), _part(c, p, 2))
    return F.when(c == "", c).otherwise(out)


def date_hypotheses(c: Column) -> Column:
    """Every calendar reading of a day/month/year text, as an array of structs."""
    p = r"^([0-9]{1,2})([/-])([0-9]{1,2})\2([0-9]{2}|[0-9]{4})\z"
    first, second, token = _part(c, p, 1), _part(c, p, 3), F.regexp_extract(c, p, 4)
    # A two-digit year leaves the leap day open, so a leap year stands in for it.
    year = F.when(F.length(token) == 4, token.try_cast("int")).otherwise(F.lit(2000))

    def reading(fmt: str, day: Column, month: Column) -> Column:
        row = F.struct(
            F.lit(fmt).alias("format"),
            day.alias("day"),
            month.alias("month"),
            token.alias("year_token"),
            (F.length(token) == 2).alias("century_unresolved"),
        )
        return F.when(iso_or_null(year, month, day).isNotNull(), row)

    return F.array_compact(F.array(reading("DMY", first, second), reading("MDY", second, first)))


# Fixed value: clock time with an optional explicit offset.
_TIME = r"^([0-9]{2}):([0-9]{2})(?::([0-9]{2})(\.[0-9]{1,9})?)?(Z|[-+][0-9]{2}:[0-9]{2})?\z"


def _offset_ok(offset: Column) -> Column:
    hours, minutes = F.substring(offset, 2, 2).try_cast("int"), F.substring(offset, 5, 2).try_cast("int")
    shaped = offset.rlike(r"^[-+][0-9]{2}:[0-9]{2}\z") & (offset != "-00:00")
    return (offset == "Z") | (shaped & (hours <= 14) & (minutes <= 59) & ((hours < 14) | (minutes == 0)))


def reviewed_time(c: Column, assumed_offset: str = "") -> Column:
    """``hh:mm[:ss[.f]]`` with an explicit or reviewed offset; null when either is missing or they differ."""
    explicit = F.regexp_extract(c, _TIME, 5)
    seconds = F.regexp_extract(c, _TIME, 3)
    offset = F.when(explicit != "", explicit).otherwise(F.lit(assumed_offset))
    ok = (
        c.rlike(_TIME)
        & (_part(c, _TIME, 1) <= 23)
        & (_part(c, _TIME, 2) <= 59)
        & ((seconds == "") | (seconds.try_cast("int") <= 59))
        & _offset_ok(offset)
    )
    if assumed_offset:
        ok = ok & ((explicit == "") | (explicit == assumed_offset)) & _offset_ok(F.lit(assumed_offset))
    return F.when(ok, F.concat(F.substring(c, F.lit(1), F.length(c) - F.length(explicit)), offset))


def reviewed_datetime(date: Column, fmt: str, time: Column | None = None, century: int | None = None, assumed_offset: str = "") -> Column:
    """Date-time text with its offset; partial dates are refused and nothing is moved to UTC."""
    if fmt == "ISO-datetime":
        p = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[T ](.+)\z"
        day, clock = reviewed_date(F.regexp_extract(date, p, 1), "ISO"), F.regexp_extract(date, p, 2)
        day = F.when(date.rlike(p), day)
    else:
        if time is None:
            raise ValueError("a separate time column is needed for this format")
        day, clock = reviewed_date(date, fmt, century), time
    whole_day = F.when(day.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}\\z"), day)
    return F.concat(whole_day, F.lit("T"), reviewed_time(clock, assumed_offset))
