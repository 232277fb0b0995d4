"""Rule findings in long form. Rules look at text only and never change a value.

All row-local rules run in one scan: cells are unpivoted without a shuffle and
every rule is one branch of a single array expression.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from sedgetable.core import SRC, WIDTH, Field, data_columns, default_fields, explode_marks, require, unpivot_cells
from sedgetable.functions.dates import is_iso_day, reviewed_date
from sedgetable.functions.numbers import decimal_or_null, fits_declared_type, script_number_or_null, trimmed_script_number
from sedgetable.functions.text import folded_name, folded_name_column, is_blank, starts_with_digit, trim_space
from sedgetable.operators.profiles import TYPE_CLASSES
from sedgetable.scale import cells_digest, non_first, salted_join, top_rows

# Marker sets, value shapes and field-name patterns of the rules.
MISSING_TOKENS = ("NA", "N/A", "NULL", "NONE", "-9999", "?")
SENTINELS = ("NA", "N/A", "NULL", "NONE", ".", "-", "?", "-999", "-9999", "9999")
SUGGESTED_SENTINELS = ("NA", "N/A", "NULL", ".", "-", "-9", "-99", "-999", "-9999", "-99999", "-999999", "999", "9999")
NUMERIC_DATE = r"^[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}\z"
SLASH_DATE = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{2}|[0-9]{4})\z"
ENCODING_DAMAGE = "�|Ã.|Â."
FORMULA_START = ("=", "+", "@")
SIGNED_NUMBER = r"^-[0-9]+(?:\.[0-9]*)?(?:[eE][+-]?[0-9]+)?\z"
PARTIAL_DATE = r"^[0-9]{4}\z|^[0-9]{4}-[0-9]{2}\z|^[0-9]{1,2}/[0-9]{4}\z"
SERIAL = r"^[0-9]+(\.[0-9]+)?\z"
ISO_SHAPE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
LATITUDE_NAMES = ("latitude", "lat", "decimallatitude")
LONGITUDE_NAMES = ("longitude", "lon", "lng", "decimallongitude")
PLACE_NAME = r"(?i)latitude|longitude|coordinate|easting|northing|geometry|footprint|geohash|(?:^|[^a-z])(?:lat|lon|lng)(?:$|[^a-z])"
PLACE_TERMS = ("decimalLatitude", "decimalLongitude", "verbatimLatitude", "verbatimLongitude")
UNIT_SUFFIX = r"(?i)_(F|C|K|mm|cm|m|ft|mi|km|mg|g|kg|m2|cm2|km2|ha|s|min|h|d)$"
REQUIRED_METADATA = ("title", "creator", "license", "methods", "spatialCoverage", "temporalCoverage")
# Field-name pattern of each suggested term, on the folded name.
ROLE_PATTERNS = {
    "scientificName": "scientificname|taxonname|species|binomial",
    "vernacularName": "commonname|vernacular",
    "taxonID": "taxonid|taxoncode",
    "decimalLatitude": "latitude|^lat$",
    "decimalLongitude": "longitude|^lon$|^lng$",
    "eventDate": "date|timestamp|^dt$",
    "recordedBy": "observer|recorder|recordedby",
    "occurrenceID": "occurrenceid|recordid",
    "eventID": "eventid|surveyid",
    "locality": "locality|site|locationname",
    "individualCount": "count|abundance|^n$",
    "samplingEffort": "effort|duration|minutes",
}
MEANING_PATTERNS = {
    "scientificName": "^(sp|species|scientificname|taxonname|taxon)$",
    "eventID": "^(eventid|surveyid|surveykey)$",
    "locationID": "^(siteid|site|locationid)$",
    "eventDate": "^(obsdt|dt|date|eventdate|observationdate)$",
    "decimalLatitude": "^(lat|latitude|decimallatitude)$",
    "decimalLongitude": "^(lng|lon|longitude|decimallongitude)$",
    "individualCount": "^(cnt|count|n|individualcount)$",
}
# Order in which kinds of suggestions are shown, and the states that close one.
PRIORITY = {
    "validation": 1, "conflict": 1, "meaning": 2, "missing": 3, "date": 4, "unit": 5, "relationship": 6,
    "codebook": 6, "coordinate": 7, "taxonomy": 8, "trim": 9, "metadata": 10, "privacy": 11, "mapping": 12,
}
CLOSED_STATES = ("Rejected", "Accepted", "Intentionally unresolved", "Reviewed")

COLUMNS = ["rule", "layer", "severity", "column", SRC, "value"]


def _term_axis(field: Field) -> str | None:
    name = field.name.lower()
    if field.term == "decimalLatitude" or name in LATITUDE_NAMES:
        return "latitude"
    if field.term == "decimalLongitude" or name in LONGITUDE_NAMES:
        return "longitude"
    return None


def _screen_axis(field: Field) -> str | None:
    name = folded_name(field.name)
    return "latitude" if name in LATITUDE_NAMES else "longitude" if name in LONGITUDE_NAMES else None


def _named(pattern: str) -> Callable[[Field], bool]:
    return lambda field: re.search(pattern, field.name, re.I) is not None


# Tests take the recorded value and the value without outer whitespace.
Test = Callable[[Column, Column], Column]


def _out_of_range(limit: int) -> Test:
    return lambda v, t: (t != "") & F.coalesce(F.abs(trimmed_script_number(t)) > limit, F.lit(True))


def _screened_range(limit: int) -> Test:
    return lambda v, t: (t != "") & F.coalesce(F.abs(decimal_or_null(t)) > limit, F.lit(True))


def _ambiguous_day_month(v: Column, t: Column) -> Column:
    a, b = F.regexp_extract(v, SLASH_DATE, 1).try_cast("int"), F.regexp_extract(v, SLASH_DATE, 2).try_cast("int")
    return starts_with_digit(v) & F.contains(v, F.lit("/")) & F.coalesce((a <= 12) & (b <= 12) & (a != b), F.lit(False))


def _serial_date(v: Column, t: Column) -> Column:
    n = F.when(starts_with_digit(v) & v.rlike(SERIAL), v.try_cast("double"))
    return F.coalesce((n > 20000) & (n < 80000), F.lit(False))


def _named_month_or_partial(v: Column, t: Column) -> Column:
    shape = r"^(?:[0-9]{4}(?:-[0-9]{2}){0,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})\z"
    named = (v != "") & (reviewed_date(v, "english-day-month").isNotNull() | reviewed_date(v, "english-month-day").isNotNull())
    return t.rlike(shape) | named


def _encoding_damage(v: Column, t: Column) -> Column:
    return (F.octet_length(v) > F.char_length(v)) & v.rlike(ENCODING_DAMAGE)


def _formula(v: Column, t: Column) -> Column:
    return F.substring(v, 1, 1).isin(*FORMULA_START) | (v.startswith("-") & ~v.rlike(SIGNED_NUMBER))


def _impossible_date(v: Column, t: Column) -> Column:
    return (F.octet_length(v) == 10) & starts_with_digit(v) & v.rlike(ISO_SHAPE) & ~is_iso_day(v)


@dataclass(frozen=True)
class CellRule:
    """A row-local rule: which fields it looks at and which values it reports."""

    name: str
    layer: str
    severity: str
    applies: Callable[[Field], bool]
    test: Test


_every = lambda field: True
CELL_RULES: dict[str, CellRule] = {
    rule.name: rule
    for rule in [
        CellRule("blank values", "scientific", "Information", _every, lambda v, t: t == ""),
        CellRule("outer whitespace", "scientific", "Warning", _every, lambda v, t: v != t),
        CellRule("missing tokens", "scientific", "Warning", _every, lambda v, t: F.upper(t).isin(*MISSING_TOKENS)),
        CellRule("ambiguous numeric dates", "scientific", "Warning", _every, lambda v, t: starts_with_digit(t) & (F.octet_length(t) <= 10) & t.rlike(NUMERIC_DATE)),
        CellRule("encoding damage", "scientific", "Warning", _every, _encoding_damage),
        CellRule("formula-like text", "scientific", "Warning", _every, _formula),
        CellRule("latitude range", "scientific", "Warning", lambda f: _term_axis(f) == "latitude", _out_of_range(90)),
        CellRule("longitude range", "scientific", "Warning", lambda f: _term_axis(f) == "longitude", _out_of_range(180)),
        CellRule("count not whole", "scientific", "Warning", lambda f: f.term == "individualCount" or f.name.lower() == "count", lambda v, t: (t != "") & ~t.rlike(r"^[0-9]+\z")),
        CellRule("suspicious sentinels", "scientific", "Warning", _every, lambda v, t: F.upper(t).isin(*SENTINELS)),
        CellRule("partial dates", "scientific", "Information", _named("date|year|^dt$"), lambda v, t: starts_with_digit(v) & v.rlike(PARTIAL_DATE)),
        CellRule("serial dates", "scientific", "Warning", _named("date|^dt$"), _serial_date),
        CellRule("impossible dates", "scientific", "Warning", _every, _impossible_date),
    ]
}
# Import screening and suggestion rules share the scan but are asked for by name.
SCREENING_RULES: dict[str, CellRule] = {
    rule.name: rule
    for rule in [
        CellRule("screened day or month first", "screening", "Information", _every, _ambiguous_day_month),
        CellRule("screened latitude range", "screening", "Information", lambda f: _screen_axis(f) == "latitude", _screened_range(90)),
        CellRule("screened longitude range", "screening", "Information", lambda f: _screen_axis(f) == "longitude", _screened_range(180)),
        CellRule("suggested sentinels", "suggestion", "Information", _every, lambda v, t: F.upper(t).isin(*SUGGESTED_SENTINELS)),
        CellRule("named month or partial date", "suggestion", "Information", lambda f: re.search(MEANING_PATTERNS["eventDate"], folded_name(f.name)) is not None, _named_month_or_partial),
    ]
}
ALL_RULES = CELL_RULES | SCREENING_RULES


def cell_findings(df: DataFrame, fields: Sequence[Field] | None = None, rules: Iterable[str] | None = None) -> DataFrame:
    """All chosen row-local rules in one scan; declared types are checked when fields declare them."""
    fields = list(fields) if fields is not None else default_fields(df)
    chosen = [ALL_RULES[name] for name in (rules if rules is not None else CELL_RULES)]
    value, column, trimmed = F.col("value"), F.col("column"), F.col("__trimmed")
    tests, used, labels = [], set(), []
    for rule in chosen:
        names = [f.name for f in fields if rule.applies(f)]
        if not names:
            continue
        used.update(names)
        hit = rule.test(value, trimmed)
        tests.append(hit if len(names) == len(fields) else column.isin(*names) & hit)
        labels.append(F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.layer).alias("layer"), F.lit(rule.severity).alias("severity")))
    if not tests:
        return unpivot_cells(df).select(F.lit("").alias("rule"), F.lit("").alias("layer"), F.lit("").alias("severity"), "column", SRC, "value").filter(F.lit(False))
    cells = unpivot_cells(df, [f.name for f in fields if f.name in used]).withColumn("__trimmed", trim_space(value))
    hits = explode_marks(cells, ["column", SRC, "value"], tests).withColumn("hit", F.get(F.array(*labels), F.col("mark")))
    return hits.select("hit.rule", "hit.layer", "hit.severity", "column", SRC, "value")


def _record_finding(df: DataFrame, rule: str, severity: str = "Warning", layer: str = "scientific", column: Column | None = None, value: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        F.lit(rule).alias("rule"),
        F.lit(layer).alias("layer"),
        F.lit(severity).alias("severity"),
        (none if column is None else column).alias("column"),
        F.col(SRC),
        (none if value is None else value).alias("value"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Every row that repeats an earlier row in all columns. Only numbers and digests are shuffled."""
    return _record_finding(non_first(df.select(SRC, cells_digest(df).alias("__cells")), ["__cells"]), "exact duplicate rows")


def row_width(df: DataFrame, header_width: int) -> DataFrame:
    return _record_finding(df.filter(F.col(WIDTH) != header_width), "source row width differs", value=F.col(WIDTH).cast("string"))


def mixed_types(profile: DataFrame) -> DataFrame:
    """Columns with several value classes, one of them numeric or date-like. Input is a column profile."""
    kinds = sum([(F.col(f"{k.replace('-', '_')}_count") > 0).cast("int") for k in TYPE_CLASSES])
    telling = (F.col("integer_count") > 0) | (F.col("number_count") > 0) | (F.col("date_like_count") > 0)
    return profile.filter((kinds > 1) & telling).select("column", *[f"{k.replace('-', '_')}_count" for k in TYPE_CLASSES])


def leading_zeros(df: DataFrame) -> DataFrame:
    """Columns holding digits with a leading zero."""
    zeros = F.count_if(F.col("value").rlike(r"^0[0-9]+\z"))
    return unpivot_cells(df).groupBy("column").agg(zeros.alias("cells")).filter("cells > 0")


def declared_type_mismatch(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """Nonempty values that do not fit a declared integer or number."""
    typed = {f.name: f.data_type for f in fields if f.data_type in ("integer", "number")}
    value, bad = F.col("value"), F.lit(False)
    for kind in ("integer", "number"):
        names = [n for n, k in typed.items() if k == kind]
        if names:
            bad = bad | (F.col("column").isin(*names) & ~fits_declared_type(value, kind))
    hits = unpivot_cells(df, list(typed)).filter((value != "") & bad)
    return _record_finding(hits, "declared type mismatch", "Error", "schema", F.col("column"), value)


def outside_vocabulary(df: DataFrame, allowed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nonempty values absent from ``allowed(column, value)``."""
    require(df, columns)
    cells = unpivot_cells(df, columns).filter(F.col("value") != "")
    out = salted_join(cells, allowed.select("column", "value").distinct(), ["column", "value"], "left_anti")
    return _record_finding(out, "outside vocabulary", "Warning", "schema", F.col("column"), F.col("value"))


def _points(df: DataFrame, latitude: str, longitude: str) -> DataFrame:
    """Rows with two numbers. The pair goes through a one-element array, so the filter does not read it a second time."""
    pair = F.struct(script_number_or_null(F.col(f"`{latitude}`")).alias("lat"), script_number_or_null(F.col(f"`{longitude}`")).alias("lon"))
    return df.select(SRC, pair.alias("p")).select(SRC, F.explode(F.array("p")).alias("p")).select(SRC, "p.lat", "p.lon").filter("lat is not null and lon is not null")


def coordinate_columns(fields: Sequence[Field]) -> tuple[str, str] | None:
    """Latitude and longitude columns by term, else by name."""
    found = []
    for term in ("decimalLatitude", "decimalLongitude"):
        match = [f.name for f in fields if f.term == term or (not f.term and re.search(ROLE_PATTERNS[term], folded_name(f.name)))]
        if not match:
            return None
        found.append(match[0])
    return found[0], found[1]


def zero_coordinates(df: DataFrame, latitude: str, longitude: str) -> DataFrame:
    return _record_finding(_points(df, latitude, longitude).filter("lat = 0 and lon = 0"), "coordinates at 0,0")


def swapped_coordinates(df: DataFrame, latitude: str, longitude: str) -> DataFrame:
    points = _points(df, latitude, longitude).filter("abs(lat) > 90 and abs(lat) <= 180 and abs(lon) <= 90")
    return _record_finding(points, "coordinates may be swapped")


def upper_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Element ``floor(n/2)`` of the sorted numbers of each column, exact and without a global sort.

    All columns are narrowed together in decimal steps. A step counts the
    remaining numbers in a bounded number of buckets per column, picks the
    bucket that holds the rank, and hands one row per column to the driver.
    """
    axis = Window.partitionBy("axis")
    running = axis.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbers = df.unpivot([], list(columns), "axis", "v")
    rank: dict[str, int] = {}
    found: dict[str, float] = {}

    def per_axis(values: dict) -> Column:
        return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("axis")]

    for step in (1_000.0, 10_000_000.0, None):
        bucket = F.col("v") if step is None else F.floor(F.col("v") * step).cast("double")
        counted = numbers.groupBy("axis", bucket.alias("b")).agg(F.count("*").alias("n"))
        wanted = per_axis(rank) if rank else F.floor(F.sum("n").over(axis) / 2).cast("long")
        upto = counted.withColumn("rank", wanted).withColumn("upto", F.sum("n").over(running))
        hits = upto.filter("upto > rank and upto - n <= rank").select("axis", "b", (F.col("rank") - F.col("upto") + F.col("n")).alias("left")).collect()
        if not hits:
            return {}
        found, rank = {h["axis"]: h["b"] for h in hits}, {h["axis"]: h["left"] for h in hits}
        if step is not None:
            numbers = numbers.filter(F.floor(F.col("v") * step).cast("double") == per_axis(found))
    return found


def geographic_outliers(df: DataFrame, latitude: str, longitude: str, degrees: float = 10.0, least: int = 5) -> DataFrame:
    """In-range points more than ``degrees`` from the upper-median latitude or longitude."""
    points = _points(df, latitude, longitude).filter("abs(lat) <= 90 and abs(lon) <= 180")
    middle = upper_medians(points, ["lat", "lon"])
    if not middle or points.limit(least).count() < least:
        return _record_finding(points.filter(F.lit(False)), "geographic outlier candidates")
    far = (F.abs(F.col("lat") - middle["lat"]) > degrees) | (F.abs(F.col("lon") - middle["lon"]) > degrees)
    return _record_finding(points.filter(far), "geographic outlier candidates")


def repeated_identifiers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Blank cells and non-first repeats in identifier-named fields."""
    if columns is None:
        columns = [c for c in data_columns(df) if re.search("id$|identifier$", folded_name(c))]
    cells = unpivot_cells(df, columns)
    blank = _record_finding(cells.filter(F.col("value") == ""), "identifier blank", "Information", "screening", F.col("column"), F.col("value"))
    repeats = non_first(cells.filter(F.col("value") != ""), ["column", "value"])
    return blank.unionByName(_record_finding(repeats, "identifier repeat", "Information", "screening", F.col("column"), F.col("value")))


# Dictionary and metadata rules: their input holds one row per field of any number of tables.


def undefined_fields(dictionary: DataFrame) -> DataFrame:
    return dictionary.filter(is_blank(F.col("description"))).select("table", "name")


def unsettled_interpretations(dictionary: DataFrame) -> DataFrame:
    severity = F.when(F.col("status") == "Conflicting", "Warning").otherwise("Information")
    return dictionary.filter(F.col("status").isin("Conflicting", "Inferred")).select("table", "name", "status", severity.alias("severity"))


def unconfirmed_terms(dictionary: DataFrame) -> DataFrame:
    return dictionary.filter((F.col("term") != "") & (F.col("status") != "Confirmed")).select("table", "name", "term", "status")


def metadata_findings(metadata: DataFrame) -> DataFrame:
    """``metadata(table, key, value, status)``: missing required, unknown and conflicting context."""
    blank = F.col("value") == ""
    hits = F.array_compact(
        F.array(
            F.when(F.col("key").isin(*REQUIRED_METADATA) & is_blank(F.col("value")), F.lit("missing required")),
            F.when(blank & (F.col("status") != "Not Applicable"), F.lit("unknown")),
            F.when(F.col("status") == "Conflicting", F.lit("conflicting")),
        )
    )
    return metadata.select("table", "key", F.explode(hits).alias("rule"))


def unconfirmed_datum(tables: DataFrame, metadata: DataFrame) -> DataFrame:
    """``tables(table, has_coordinates)`` whose datum is absent or not confirmed."""
    settled = metadata.filter((F.col("key") == "datum") & (F.col("status") == "Confirmed") & (F.col("value") != "")).select("table").distinct()
    return tables.filter("has_coordinates").select("table").join(settled, "table", "left_anti")


# Suggestions.


def _first_pattern(name: Column, patterns: dict[str, str]) -> Column:
    out = F.lit("")
    for term, pattern in reversed(list(patterns.items())):
        out = F.when(name.rlike(pattern), term).otherwise(out)
    return out


def term_suggestions(dictionary: DataFrame) -> DataFrame:
    """Every term whose name pattern fits a field, with a name-only confidence."""
    folded = folded_name_column(F.col("name"))
    hits = F.array_compact(F.array(*[F.when(folded.rlike(p), F.lit(term)) for term, p in ROLE_PATTERNS.items()]))
    found = dictionary.select("table", "name", folded.alias("folded"), F.explode(hits).alias("term"))
    exact = F.col("folded") == F.lower("term")
    return found.select("table", "name", "term", F.when(exact, "High").otherwise("Medium").alias("confidence"))


def meaning_suggestions(dictionary: DataFrame) -> DataFrame:
    """Fields to define (or map) next, with the candidate term of their name."""
    term = _first_pattern(folded_name_column(F.col("name")), MEANING_PATTERNS)
    open_field = (F.col("status") != "Confirmed") | (F.col("description") == "")
    kind = (
        F.when(F.col("status") == "Conflicting", "conflict")
        .when(open_field, "meaning")
        .when((F.col("term") == "") & (F.col("candidate") != ""), "mapping")
    )
    return dictionary.withColumn("candidate", term).select("table", "name", "candidate", kind.alias("kind")).filter("kind is not null")


def unit_suggestions(dictionary: DataFrame) -> DataFrame:
    """Units read from a field-name suffix, for fields without a recorded unit."""
    unit = F.regexp_extract("name", UNIT_SUFFIX, 1)
    return dictionary.filter((F.col("unit") == "") & (unit != "")).select("table", "name", unit.alias("suggested_unit"))


def companion_unit_labels(df: DataFrame, k: int = 20) -> DataFrame:
    """First ``k`` distinct labels of every ``<name>unit(s)`` column beside its field."""
    names = data_columns(df)
    pairs = []
    for name in names:
        wanted = {folded_name(name) + "unit", folded_name(name) + "units"}
        companion = next((n for n in names if n != name and folded_name(n) in wanted), None)
        if companion:
            pairs.append((name, companion))
    if not pairs:
        return df.select(F.lit("").alias("field"), F.lit("").alias("unit_field"), F.lit(0).alias("rank"), F.lit("").alias("label")).filter(F.lit(False))
    cells = df.select(SRC, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(u).alias("unit_field"), F.col(f"`{u}`").alias("label")) for f, u in pairs])).alias("p")).select(SRC, "p.*")
    first = cells.filter("label <> ''").groupBy("field", "unit_field", "label").agg(F.min(SRC).alias("first_record"))
    return top_rows(first, ["field", "unit_field"], [F.asc("first_record")], k).select("field", "unit_field", "rank", "label")


def sensitive_fields(dictionary: DataFrame) -> DataFrame:
    """Fields that may disclose a place: by name, recorded name, term or flag."""
    named = F.concat_ws(" ", "name", "original_name").rlike(PLACE_NAME)
    return dictionary.filter(named | F.col("term").isin(*PLACE_TERMS) | F.col("sensitive")).select("table", "name", "term", "sensitive")


def codebook_conflicts(df: DataFrame, code: str, meaning: str) -> DataFrame:
    """Codes recorded with more than one distinct meaning."""
    require(df, [code, meaning])
    pairs = df.select(F.col(f"`{code}`").alias("code"), F.col(f"`{meaning}`").alias("meaning")).distinct()
    return pairs.groupBy("code").agg(F.count("*").alias("meanings")).filter("meanings > 1")


def review_queue(items: DataFrame, decisions: DataFrame, k: int = 3) -> DataFrame:
    """Next ``k`` open suggestions. ``items(id, kind)``, ``decisions(key, state, at)``; the latest decision counts."""
    closed = decisions.groupBy("key").agg(F.max_by("state", "at").alias("state")).filter(F.col("state").isin(*CLOSED_STATES))
    ranks = F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair])
    ranked = items.withColumn("priority", F.coalesce(F.try_element_at(ranks, F.col("kind")), F.lit(99)))
    still_open = ranked.join(closed.select(F.col("key").alias("id")), "id", "left_anti")
    return still_open.orderBy("priority", "id").limit(k)


def capped_findings(findings: DataFrame, order: Sequence[str], k: int = 500) -> DataFrame:
    """First ``k`` findings for display, each with the number left out."""
    total = findings.agg(F.count("*").alias("n")).scalar()
    shown = findings.orderBy(*order).limit(k)
    return shown.withColumn("omitted", F.greatest(total - k, F.lit(0)))


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("findings"))
