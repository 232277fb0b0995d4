from pyspark.sql import functions as F

from sedgetable.functions import coordinates, dates, numbers, text, units


def test_trim_sets(one):
    values = ["\tx ", " x　", "﻿x", "\x1cx\x85"]
    assert one(values, text.trim_space) == ["x", "x", "x", "\x1cx\x85"]
    assert one(values, lambda c: text.trim_space(c, text.RECORD_SPACE)) == ["x", "x", "﻿x", "x"]


def test_numeric_sort_key(spark):
    df = spark.createDataFrame([("a10",), ("a9",), ("a09b",), ("b1",)], "v string")
    assert [r.v for r in df.orderBy(text.numeric_sort_key(F.col("v")), "v").collect()] == ["a9", "a09b", "a10", "b1"]


def test_number_text(one):
    values = ["1", "0.0001", "1e21", "123456789", "-0.5", "1.5e-7", "12345678.25", "1e20", "0", "0.001"]
    shown = ["1", "0.0001", "1e+21", "123456789", "-0.5", "1.5e-7", "12345678.25", "100000000000000000000", "0", "0.001"]
    assert one(values, lambda c: text.number_text(c.cast("double"))) == shown
    assert one(values, lambda c: text.number_text_15(c.cast("double"))) == shown
    assert one(["0.1"], lambda c: text.number_text_15(c.cast("double") * 3)) == ["0.3"]


def test_number_grammars(one):
    values = ["3d", "NaN", "Infinity", " 3 ", "1_0", "0x1F", ".5", "5.", "1e999", "", "+1", "3\n"]
    assert one(values, numbers.decimal_or_null) == [None, None, None, None, None, None, 0.5, 5.0, None, None, 1.0, None]
    assert one(values, numbers.script_number_or_null) == [None, None, None, 3.0, None, 31.0, 0.5, 5.0, None, None, 1.0, 3.0]
    assert one(values, numbers.record_number_or_null) == [None, None, None, 3.0, 10.0, None, 0.5, 5.0, None, None, 1.0, 3.0]


def test_type_class(one):
    values = ["", " ", "12", "-1.5", "1e3", "2020-01-02", "2020-01-02Tx", "TRUE", "x", "1.", " 7 "]
    assert one(values, numbers.type_class) == ["empty", "empty", "integer", "number", "number", "date-like", "date-like", "boolean", "text", "number", "integer"]


def test_reviewed_dates(one):
    day_month = ["05-Apr-2008", "5 April 2008", "29-Feb-2000", "29-Feb-1900", "31-Apr-2008", "5 avril 2008", "5-Apr-08", "5-April 2008", " 5-Apr-2008"]
    assert one(day_month, lambda c: dates.reviewed_date(c, "english-day-month")) == ["2008-04-05", "2008-04-05", "2000-02-29"] + [None] * 6
    assert one(["April 5 2008", "Apr 5, 2008"], lambda c: dates.reviewed_date(c, "english-month-day")) == ["2008-04-05"] * 2
    assert one(["0000-02-29", "0100-02-29", ""], lambda c: dates.reviewed_date(c, "ISO")) == ["0000-02-29", None, ""]
    two_digit = ["04/05/08", "29/02/00", "04/05-2008"]
    assert one(two_digit, lambda c: dates.reviewed_date(c, "DMY")) == [None, None, None]
    assert one(two_digit, lambda c: dates.reviewed_date(c, "DMY", 2000)) == ["2008-05-04", "2000-02-29", None]
    assert one(two_digit, lambda c: dates.reviewed_date(c, "MDY", 1900)) == ["1908-04-05", None, None]
    assert one(two_digit, lambda c: dates.reviewed_date(c, "DMY", 1900)) == ["1908-05-04", None, None]


def test_day_serials(one):
    assert one(["43832.0", "59.0", "61.0", "60.0", "43832.5", "1e4", "2958466", "-1"], lambda c: dates.reviewed_date(c, "excel1900")) == ["2020-01-02", "1900-02-28", "1900-03-01"] + [None] * 5
    assert one(["42370.0", "0.0", "2958465"], lambda c: dates.reviewed_date(c, "excel1904")) == ["2020-01-02", "1904-01-01", None]
    assert one(["04/05-2008", "4/5/08", "60", "61"], lambda c: dates.strict_date(c, "DMY")) == ["2008-05-04", None, None, None]
    assert one(["60", "61", "43832.0"], lambda c: dates.strict_date(c, "excel1900")) == [None, "1900-03-01", None]


def test_date_hypotheses(one):
    found = one(["04/05/08", "31/04/2008", "13/04/2008", "invented"], dates.date_hypotheses)
    assert [(h.format, h.day, h.month, h.year_token, h.century_unresolved) for h in found[0]] == [("DMY", 4, 5, "08", True), ("MDY", 5, 4, "08", True)]
    assert [len(h) for h in found] == [2, 0, 1, 0]


def test_reviewed_datetimes(one):
    iso = lambda offset="": lambda c: dates.reviewed_datetime(c, "ISO-datetime", assumed_offset=offset)
    assert one(["2020-02-29 12:30:45.001-06:00"], iso()) == ["2020-02-29T12:30:45.001-06:00"]
    bad = ["2020-02-30T12:30Z", "2020-01-01T12:30", "2020-01-01T12:30-00:00", "2020-01-01T24:00Z", "2020-01-01T12:30:60Z", "2020-01-01T12:30+14:30"]
    assert one(bad, iso()) == [None] * 6
    assert one(["2020-01-01T12:30Z"], iso("-06:00")) == [None]
    assert one(["12:30"], lambda c: dates.reviewed_time(c, "-06:00")) == ["12:30-06:00"]
    assert one(["12:30"], lambda c: dates.reviewed_time(c, "America/Edmonton")) == [None]
    for value, fmt in (("2008", "year"), ("2008-05", "month")):
        assert one([value], lambda c: dates.reviewed_datetime(c, fmt, F.lit("12:30"), assumed_offset="Z")) == [None]


def test_degrees(one):
    values = ["53 30 N", "53°30'15\"N", "-53 30", "53 61 N", "53 30 E", "", "91 0 0 N", "-10 N", "abc"]
    assert one(values, lambda c: coordinates.degrees_or_null(c, "latitude")) == ["53.5", "53.50416667", "-53.5", None, None, "", None, None, None]


def test_units(one):
    assert one(["32", "x", "1e400"], lambda c: units.convert_unit(c, F.lit("F"), "C")) == ["0", None, None]
    assert one(["0"], lambda c: units.convert_unit(c, F.lit("K"), "C")) == ["-273.15"]
    assert one(["1"], lambda c: units.convert_unit(c, F.lit("mi"), "km")) == ["1.609344"]
    assert one(["1"], lambda c: units.convert_unit(c, F.lit("kg"), "km")) == [None]
    assert one(["1"], lambda c: units.convert_unit(c, F.lit("C"), "F")) == ["33.8"]


def test_search_folds_ascii_only(one):
    from sedgetable.functions.text import contains_folded

    assert one(["CAFÉ", "café", "cafe"], lambda c: contains_folded(c, "Café")) == [False, True, False]
    assert one(["ABC", "x%y"], lambda c: contains_folded(c, "b")) == [True, False]


def test_serial_dates_beyond_four_digit_years_on_request(one):
    serials = ["61", "2958465", "2958466", "9000061", "60", "2147483648"]
    assert one(serials, lambda c: dates.strict_date(c, "excel1900", far=True)) == ["1900-03-01", "9999-12-31", "10000-01-01", "26541-04-29", None, None]
    assert one(serials, lambda c: dates.strict_date(c, "excel1900")) == ["1900-03-01", "9999-12-31"] + [None] * 4
