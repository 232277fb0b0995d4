"""Rule findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedgetable.core import Field, default_fields
from sedgetable.operators import findings as N, profiles as P
from sedgetable.plans.inputs import (
    CUSTOMER, DECIMAL, DICTIONARY_ROWS, INTEGER, METADATA, SURVEY, SURVEY_COLUMNS, cells, dictionary, iso_day, load, matches, script_number, trim, type_class, with_tables,
)
from sedgetable.plans.profiles import profile_sql

_CELLS = cells("t", SURVEY_COLUMNS)
V = "value"
T = trim(V)
DOCUMENTS = "SELECT CAST(doc_id + 1 AS BIGINT) AS __source_record, text, lang, source FROM {documents}"


def _survey(s, d):
    return load(s, d, SURVEY)


def _fields(s, d):
    """Survey dictionary: the counts carry their term, two fields declare types."""
    out = default_fields(_survey(s, d))
    for f in out:
        if f.name == "abundance":
            f.term, f.data_type = "individualCount", "integer"
        if f.name == "longitude":
            f.data_type = "number"
    return out


# Test of each rule in SQL over one cell, with its layer, severity and columns.
RULES = {
    "f04": ("blank values", "Information", f"{T} = ''", None),
    "f05": ("outer whitespace", "Warning", f"{V} <> {T}", None),
    "f07": ("missing tokens", "Warning", f"upper({T}) IN ('NA', 'N/A', 'NULL', 'NONE', '-9999', '?')", None),
    "f08": ("ambiguous numeric dates", "Warning", matches(T, "^[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}$"), None),
    "f09": ("encoding damage", "Warning", f"(contains({V}, '�') OR {matches(V, 'Ã.|Â.')})", None),
    "f10": ("formula-like text", "Warning", f"({matches(V, '^[=+@]')} OR ({V} LIKE '-%' AND NOT {matches(V, '^-[0-9]+([.][0-9]*)?([eE][+-]?[0-9]+)?$')}))", None),
    "f11_latitude": ("latitude range", "Warning", f"{T} <> '' AND coalesce(abs({script_number(V)}) > 90, true)", ["latitude"]),
    "f11_longitude": ("longitude range", "Warning", f"{T} <> '' AND coalesce(abs({script_number(V)}) > 180, true)", ["longitude"]),
    "f12": ("count not whole", "Warning", f"{T} <> '' AND NOT {matches(T, '^[0-9]+$')}", ["abundance"]),
    "f14": ("suspicious sentinels", "Warning", f"upper({T}) IN ('NA', 'N/A', 'NULL', 'NONE', '.', '-', '?', '-999', '-9999', '9999')", None),
    "f15": ("partial dates", "Information", matches(V, "^[0-9]{4}$|^[0-9]{4}-[0-9]{2}$|^[0-9]{1,2}/[0-9]{4}$"), ["event_date"]),
    "f16": ("serial dates", "Warning", f"{matches(V, '^[0-9]+([.][0-9]+)?$')} AND TRY_CAST({V} AS DOUBLE) > 20000 AND TRY_CAST({V} AS DOUBLE) < 80000", ["event_date"]),
    "f17": ("impossible dates", "Warning", f"{matches(V, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')} AND NOT {iso_day(V)}", None),
}
NAMES = {
    "f04": "f04_blank_values", "f05": "f05_outer_whitespace", "f07": "f07_missing_tokens", "f08": "f08_ambiguous_numeric_dates", "f09": "f09_encoding_damage",
    "f10": "f10_formula_like_text", "f11_latitude": "f11_latitude_range", "f11_longitude": "f11_longitude_range", "f12": "f12_count_not_whole",
    "f14": "f14_suspicious_sentinels", "f15": "f15_partial_dates", "f16": "f16_serial_dates", "f17": "f17_impossible_dates",
}


def rule_sql(key: str, layer: str = "scientific") -> str:
    rule, severity, test, columns = RULES[key]
    where = f""" AND "column" IN ({', '.join(repr(c) for c in columns)})""" if columns else ""
    return f"""SELECT '{rule}' AS rule, '{layer}' AS layer, '{severity}' AS severity, "column", __source_record, value FROM cells WHERE ({test}){where}"""


def _cells_cte(select: str) -> str:
    return with_tables("@", t=SURVEY).replace(" @", f", cells AS ({_CELLS}) {select}")


def _rule(key: str):
    return (lambda s, d: N.cell_findings(_survey(s, d), _fields(s, d), [RULES[key][0]])), _cells_cte(rule_sql(key))


def _points_sql() -> str:
    return f"""points AS (SELECT * FROM (SELECT __source_record, {script_number('latitude')} AS lat, {script_number('longitude')} AS lon FROM t
      WHERE {trim('latitude')} <> '' AND {trim('longitude')} <> '') WHERE lat IS NOT NULL AND lon IS NOT NULL)"""


def _points(select: str) -> str:
    return with_tables("@", t=SURVEY).replace(" @", f", {_points_sql()} {select}")


def _row_finding(rule: str, source: str, severity: str = "Warning") -> str:
    return f"""SELECT '{rule}' AS rule, 'scientific' AS layer, '{severity}' AS severity, CAST(NULL AS VARCHAR) AS "column", __source_record, CAST(NULL AS VARCHAR) AS value FROM {source}"""


def _vocabulary(s, d):
    allowed = load(s, d, "SELECT 'segment' AS \"column\", 'BUILDING' AS value FROM {region} UNION SELECT 'nationkey', CAST(n_nationkey AS STRING) FROM {nation} WHERE n_nationkey < 20")
    return N.outside_vocabulary(load(s, d, CUSTOMER), allowed, ["segment", "nationkey"])


def entries():
    out = {NAMES[key]: _rule(key) for key in RULES}
    far = """SELECT __source_record FROM (SELECT * FROM points WHERE abs(lat) <= 90 AND abs(lon) <= 180) p
      WHERE (SELECT count(*) FROM points WHERE abs(lat) <= 90 AND abs(lon) <= 180) >= 5 AND (
        abs(lat - (SELECT list_sort(list(lat))[CAST(floor(count(*) / 2) AS INT) + 1] FROM points WHERE abs(lat) <= 90 AND abs(lon) <= 180)) > 10
        OR abs(lon - (SELECT list_sort(list(lon))[CAST(floor(count(*) / 2) AS INT) + 1] FROM points WHERE abs(lat) <= 90 AND abs(lon) <= 180)) > 10)"""
    out |= {
        "f00_all_row_local_findings": (
            lambda s, d: N.cell_findings(_survey(s, d), _fields(s, d)),
            _cells_cte(" UNION ALL ".join(rule_sql(k) for k in RULES)),
        ),
        "f01_exact_duplicate_rows": (
            lambda s, d: N.duplicate_rows(load(s, d, DOCUMENTS)),
            with_tables(_row_finding("exact duplicate rows", "(SELECT *, row_number() OVER (PARTITION BY text, lang, source ORDER BY __source_record) AS rn FROM x) WHERE rn > 1"), x=DOCUMENTS),
        ),
        "f02_row_width": (
            lambda s, d: N.row_width(_survey(s, d).withColumn("__row_width", F.when(F.col("__source_record") % 9 == 0, 6).otherwise(7)), 7),
            with_tables(
                """SELECT 'source row width differs' AS rule, 'scientific' AS layer, 'Warning' AS severity, CAST(NULL AS VARCHAR) AS "column", __source_record, '6' AS value FROM t WHERE __source_record % 9 = 0""",
                t=SURVEY,
            ),
        ),
        "f03_undefined_fields": (
            lambda s, d: N.undefined_fields(dictionary(s, d)),
            with_tables("""SELECT "table", name FROM dict WHERE trim(description) = '' """, dict=DICTIONARY_ROWS),
        ),
        "f06_mixed_types": (
            lambda s, d: N.mixed_types(P.column_profile(P.value_frequencies(_survey(s, d)))),
            with_tables("@", t=SURVEY).replace(
                " @",
                f""", {profile_sql()} SELECT "column", integer_count, number_count, date_like_count, boolean_count, text_count FROM profile
                WHERE CAST(integer_count > 0 AS INT) + CAST(number_count > 0 AS INT) + CAST(date_like_count > 0 AS INT) + CAST(boolean_count > 0 AS INT) + CAST(text_count > 0 AS INT) > 1
                AND (integer_count > 0 OR number_count > 0 OR date_like_count > 0)""",
            ),
        ),
        "f13_leading_zeros": (
            lambda s, d: N.leading_zeros(_survey(s, d)),
            _cells_cte("""SELECT "column", count(*) AS cells FROM cells WHERE regexp_matches(value, '^0[0-9]+$') GROUP BY "column" """),
        ),
        "f18_unsettled_interpretations": (
            lambda s, d: N.unsettled_interpretations(dictionary(s, d)),
            with_tables("""SELECT "table", name, status, CASE WHEN status = 'Conflicting' THEN 'Warning' ELSE 'Information' END AS severity FROM dict WHERE status IN ('Conflicting', 'Inferred')""", dict=DICTIONARY_ROWS),
        ),
        "f19_declared_type_mismatch": (
            lambda s, d: N.declared_type_mismatch(_survey(s, d), _fields(s, d)),
            _cells_cte(
                f"""SELECT 'declared type mismatch' AS rule, 'schema' AS layer, 'Error' AS severity, "column", __source_record, value FROM cells
                WHERE value <> '' AND (("column" = 'abundance' AND NOT {matches(V, INTEGER)}) OR ("column" = 'longitude' AND NOT {matches(V, DECIMAL)}))"""
            ),
        ),
        "f20_outside_vocabulary": (
            _vocabulary,
            with_tables(
                """SELECT 'outside vocabulary' AS rule, 'schema' AS layer, 'Warning' AS severity, 'segment' AS "column", __source_record, segment AS value FROM c WHERE segment <> '' AND segment <> 'BUILDING'
                UNION ALL SELECT 'outside vocabulary', 'schema', 'Warning', 'nationkey', __source_record, nationkey FROM c WHERE nationkey <> '' AND nationkey NOT IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey < 20)""",
                c=CUSTOMER,
            ),
        ),
        "f21_zero_coordinates": (
            lambda s, d: N.zero_coordinates(_survey(s, d), "latitude", "longitude"),
            _points(_row_finding("coordinates at 0,0", "points WHERE lat = 0 AND lon = 0")),
        ),
        "f22_swapped_coordinates": (
            lambda s, d: N.swapped_coordinates(_survey(s, d), "latitude", "longitude"),
            _points(_row_finding("coordinates may be swapped", "points WHERE abs(lat) > 90 AND abs(lat) <= 180 AND abs(lon) <= 90")),
        ),
        "f23_unconfirmed_datum": (
            lambda s, d: N.unconfirmed_datum(
                dictionary(s, d).groupBy("table").agg(F.max(F.lower("name").isin("latitude", "lat")).alias("has_coordinates")),
                load(s, d, METADATA),
            ),
            with_tables(
                """SELECT DISTINCT "table" FROM dict WHERE lower(name) IN ('latitude', 'lat') AND "table" NOT IN (SELECT "table" FROM meta WHERE "key" = 'datum' AND status = 'Confirmed' AND value <> '')""",
                dict=DICTIONARY_ROWS, meta=METADATA,
            ),
        ),
        "f24_geographic_outliers": (
            lambda s, d: N.geographic_outliers(_survey(s, d), "latitude", "longitude"),
            _points(_row_finding("geographic outlier candidates", f"({far})")),
        ),
        "f25_metadata_findings": (
            lambda s, d: N.metadata_findings(load(s, d, METADATA)),
            with_tables(
                """SELECT "table", "key", 'missing required' AS rule FROM meta WHERE "key" IN ('title', 'creator', 'license', 'methods', 'spatialCoverage', 'temporalCoverage') AND trim(value) = ''
                UNION ALL SELECT "table", "key", 'unknown' FROM meta WHERE value = '' AND status <> 'Not Applicable' UNION ALL SELECT "table", "key", 'conflicting' FROM meta WHERE status = 'Conflicting'""",
                meta=METADATA,
            ),
        ),
        "f26_unconfirmed_terms": (
            lambda s, d: N.unconfirmed_terms(dictionary(s, d)),
            with_tables("""SELECT "table", name, term, status FROM dict WHERE term <> '' AND status <> 'Confirmed'""", dict=DICTIONARY_ROWS),
        ),
    }
    return out
