"""Reviewed translations with outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedgetable.operators import reviewed as V
from sedgetable.plans.inputs import DECIMAL, DICTIONARY_ROWS, SURVEY, dictionary, load, matches, with_tables

# Measurements with recorded units, codes and projected pairs.
MEASURED = """SELECT CAST(o_orderkey + 1 AS BIGINT) AS __source_record,
  CASE o_orderkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'cold' ELSE CAST(o_orderkey % 4000 AS STRING) END AS measure,
  CASE o_orderkey % 5 WHEN 0 THEN 'km' WHEN 1 THEN 'cm' WHEN 2 THEN 'm' WHEN 3 THEN 'kg' ELSE 'unknown' END AS unit,
  CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE CAST(o_custkey % 40 AS STRING) END AS code,
  CASE o_orderkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'NA' WHEN 2 THEN '30000000' ELSE CAST(o_orderkey * 1000 % 20000000 AS STRING) END AS easting,
  CASE o_orderkey % 16 WHEN 0 THEN '' ELSE CAST(o_orderkey * 777 % 19000000 AS STRING) END AS northing,
  lpad(CAST(o_orderkey % 26 AS STRING), 2, '0') || ':' || lpad(CAST(o_orderkey % 62 AS STRING), 2, '0') || CASE o_orderkey % 4 WHEN 0 THEN 'Z' WHEN 1 THEN '-06:00' WHEN 2 THEN '' ELSE '+14:30' END AS clock,
  CAST(1990 + o_orderkey % 40 AS STRING) || '-' || lpad(CAST(1 + o_orderkey % 13 AS STRING), 2, '0') || '-' || lpad(CAST(1 + o_orderkey % 28 AS STRING), 2, '0') AS day
FROM {orders}"""
# Nations as a codebook: some codes have two meanings, one is repeated alike, one has no meaning.
CODEBOOK = """SELECT CAST(n_nationkey + 1 AS BIGINT) AS __source_record, CAST(n_nationkey AS STRING) AS code, CASE WHEN n_nationkey = 3 THEN '' ELSE n_name END AS meaning, CASE WHEN n_nationkey % 7 = 6 THEN '' ELSE 'id:' || CAST(n_nationkey AS STRING) END AS ident FROM {nation}
UNION ALL SELECT CAST(n_nationkey + 101 AS BIGINT), CAST(n_nationkey AS STRING), 'other ' || n_name, 'id:x' FROM {nation} WHERE n_nationkey % 5 = 0
UNION ALL SELECT CAST(n_nationkey + 201 AS BIGINT), CAST(n_nationkey AS STRING), n_name, 'id:' || CAST(n_nationkey AS STRING) FROM {nation} WHERE n_nationkey = 4
UNION ALL SELECT CAST(n_nationkey + 301 AS BIGINT), CAST(n_nationkey + 30 AS STRING), CAST(n_nationkey + 30 AS STRING), '' FROM {nation} WHERE n_nationkey < 3"""


def _measured(s, d):
    return load(s, d, MEASURED)


def _survey(s, d):
    return load(s, d, SURVEY).select("__source_record", "event_date", "note")


def _chain(s, d):
    """A missing-token review feeding a code review whose input is partly open."""
    coded = V.review_codes(_measured(s, d).select("__source_record", "code"), "code", "nation", load(s, d, CODEBOOK), "code", "meaning")
    return V.review_missing(coded, "nation", "final", ["FRANCE"], upstream="nation__review")


def _outcome(value: str, read: str) -> str:
    """Outcome of a reading that is null when refused."""
    return f"CASE WHEN {value} = '' THEN 'empty' WHEN {read} IS NULL THEN 'unresolved' WHEN {read} <> {value} THEN 'converted' ELSE 'unchanged' END"


def _reviewed_sql(source: str, column: str, name: str, read: str, keep: str) -> str:
    return with_tables(
        f"""SELECT {keep}, CASE WHEN {column} <> '' AND r IS NOT NULL THEN r ELSE {column} END AS {name}, {_outcome(column, 'r')} AS {name}__review FROM (SELECT *, {read} AS r FROM t)""",
        t=source,
    )


_CODES = """entries AS (SELECT code AS c, min(meaning) AS lo, max(meaning) AS hi FROM book WHERE code <> '' AND meaning <> '' GROUP BY code),
  coded AS (SELECT m.__source_record, m.code, CASE WHEN m.code = '' THEN 'empty' WHEN lo IS NULL THEN 'unresolved' WHEN lo <> hi THEN 'conflicting' WHEN lo <> m.code THEN 'converted' ELSE 'unchanged' END AS nation__review, lo
    FROM m LEFT JOIN entries e ON e.c = m.code),
  nations AS (SELECT __source_record, code, CASE WHEN nation__review = 'converted' THEN lo ELSE code END AS nation, nation__review FROM coded)"""


def _code_sql(select: str) -> str:
    return with_tables("@", m=MEASURED, book=CODEBOOK).replace(" @", f", {_CODES} {select}")


def _taxon(s, d):
    return V.review_taxonomy(_measured(s, d).select("__source_record", "code"), "code", "taxon", load(s, d, CODEBOOK), "code", "meaning", "ident")


_TAXA = """pairs AS (SELECT code, count(DISTINCT (meaning, ident)) AS n, min(meaning) AS meaning, min(ident) AS ident FROM book WHERE code <> '' GROUP BY code),
  taxa AS (SELECT m.__source_record, m.code, CASE WHEN m.code = '' THEN 'empty' WHEN p.n IS NULL THEN 'unresolved' WHEN p.n > 1 THEN 'conflicting' WHEN p.meaning = '' OR p.ident = '' THEN 'unresolved' ELSE 'converted' END AS taxon__review, p.meaning, p.ident
    FROM m LEFT JOIN pairs p ON p.code = m.code)"""


def entries():
    day = "event_date"
    dmy = f"""CASE WHEN {matches(day, '^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$')} OR {matches(day, '^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$')}
      THEN strftime(TRY_CAST(right({day}, 4) || '-' || lpad(string_split_regex({day}, '[/-]')[2], 2, '0') || '-' || lpad(string_split_regex({day}, '[/-]')[1], 2, '0') AS DATE), '%Y-%m-%d')
      WHEN {matches(day, '^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$')} OR {matches(day, '^[0-9]{1,2}-[0-9]{1,2}-[0-9]{2}$')}
      THEN strftime(TRY_CAST('19' || right({day}, 2) || '-' || lpad(string_split_regex({day}, '[/-]')[2], 2, '0') || '-' || lpad(string_split_regex({day}, '[/-]')[1], 2, '0') AS DATE), '%Y-%m-%d') END"""
    april = f"""CASE WHEN {matches(day, '^[0-9]{1,2} April [0-9]{4}$')} THEN strftime(TRY_CAST(split_part({day}, ' ', 3) || '-04-' || lpad(split_part({day}, ' ', 1), 2, '0') AS DATE), '%Y-%m-%d') END"""
    hypotheses = lambda fmt, a, b: f"""SELECT __source_record, value, '{fmt}' AS format, CAST({a} AS INT) AS day, CAST({b} AS INT) AS month, y AS year_token, length(y) = 2 AS century_unresolved FROM parts
      WHERE TRY_CAST(CASE WHEN length(y) = 2 THEN '2000' ELSE y END || '-' || lpad({b}, 2, '0') || '-' || lpad({a}, 2, '0') AS DATE) IS NOT NULL"""
    clock = """CASE WHEN TRY_CAST(day AS DATE) IS NOT NULL AND CAST(left(clock, 2) AS INT) <= 23 AND CAST(substring(clock, 4, 2) AS INT) <= 59 AND (length(clock) = 5 OR right(clock, 6) = '-06:00')
      THEN day || 'T' || left(clock, 5) || '-06:00' END"""
    metres = """CASE WHEN regexp_matches(measure, '^[0-9]+$') AND unit IN ('km', 'cm', 'm') THEN CASE unit WHEN 'm' THEN measure WHEN 'km' THEN CASE WHEN measure = '0' THEN '0' ELSE measure || '000' END
      ELSE regexp_replace(regexp_replace(CAST(CAST(measure AS DECIMAL(12, 2)) / 100 AS DECIMAL(12, 2))::VARCHAR, '0+$', ''), '[.]$', '') END END"""
    x, y = "TRY_CAST(easting AS DOUBLE)", "TRY_CAST(northing AS DOUBLE)"
    extent = "pi() * 6378137"
    pair = f"easting <> '' AND northing <> '' AND {matches('easting', DECIMAL)} AND {matches('northing', DECIMAL)} AND abs({x}) <= {extent} AND abs({y}) <= {extent}"
    pair_state = f"CASE WHEN easting = '' AND northing = '' THEN 'empty' WHEN {pair} THEN 'converted' ELSE 'unresolved' END"
    outcomes = ("converted", "unchanged", "unresolved", "conflicting", "empty")
    return {
        "t17_reviewed_dates": (
            lambda s, d: V.review_dates(_survey(s, d), "event_date", "day", "DMY", 1900),
            _reviewed_sql(SURVEY, day, "day", dmy, "__source_record, event_date, note"),
        ),
        "t17_reviewed_named_months": (
            lambda s, d: V.review_dates(_survey(s, d), "event_date", "day", "english-day-month"),
            _reviewed_sql(SURVEY, day, "day", april, "__source_record, event_date, note"),
        ),
        "t18_date_hypotheses": (
            lambda s, d: V.unresolved_date_hypotheses(V.review_dates(_survey(s, d), "event_date", "day", "ISO"), "event_date", "day"),
            with_tables(
                f"""SELECT * FROM (WITH parts AS (SELECT __source_record, event_date AS value, string_split_regex(event_date, '[/-]')[1] AS a, string_split_regex(event_date, '[/-]')[2] AS b, string_split_regex(event_date, '[/-]')[3] AS y FROM t
                WHERE {matches(day, '^[0-9]{1,2}/[0-9]{1,2}/([0-9]{2}|[0-9]{4})$')} OR {matches(day, '^[0-9]{1,2}-[0-9]{1,2}-([0-9]{2}|[0-9]{4})$')})
                {hypotheses('DMY', 'a', 'b')} UNION ALL {hypotheses('MDY', 'b', 'a')})""",
                t=SURVEY,
            ),
        ),
        "t19_reviewed_datetimes": (
            lambda s, d: V.review_datetimes(_measured(s, d).select("__source_record", "day", "clock"), "day", "moment", "ISO", "clock", assumed_offset="-06:00"),
            _reviewed_sql(MEASURED, "day", "moment", clock, "__source_record, day, clock"),
        ),
        "t20_reviewed_units": (
            lambda s, d: V.review_units(_measured(s, d).select("__source_record", "measure", "unit"), "measure", "metres", "m", unit_column="unit"),
            _reviewed_sql(MEASURED, "measure", "metres", metres, "__source_record, measure, unit"),
        ),
        "t20_reviewed_temperatures": (
            lambda s, d: V.review_units(_measured(s, d).select("__source_record", "measure"), "measure", "kelvin", "F", source="C"),
            _reviewed_sql(
                MEASURED, "measure", "kelvin",
                """CASE WHEN regexp_matches(measure, '^[0-9]+$') THEN regexp_replace(regexp_replace(CAST(CAST(CAST(measure AS INT) * 9 AS DECIMAL(12, 1)) / 5 + 32 AS DECIMAL(12, 1))::VARCHAR, '0+$', ''), '[.]$', '') END""",
                "__source_record, measure",
            ),
        ),
        "t21_reviewed_codes": (
            lambda s, d: V.review_codes(_measured(s, d).select("__source_record", "code"), "code", "nation", load(s, d, CODEBOOK), "code", "meaning"),
            _code_sql("SELECT * FROM nations"),
        ),
        "t22_reviewed_missing_tokens": (
            lambda s, d: V.review_missing(_survey(s, d), "note", "clean", ["N/A", "none", "-999"]),
            _reviewed_sql(SURVEY, "note", "clean", "CASE WHEN note IN ('N/A', 'none', '-999') THEN '' ELSE note END", "__source_record, event_date, note"),
        ),
        "t23_reviewed_coordinates": (
            lambda s, d: V.review_coordinates(load(s, d, _DEGREES), "south", "latitude", "latitude", "WGS84"),
            _reviewed_sql(
                _DEGREES, "south", "latitude",
                """CASE WHEN TRY_CAST(split_part(south, ' ', 2) AS INT) < 60 AND TRY_CAST(split_part(south, ' ', 1) AS INT) + TRY_CAST(split_part(south, ' ', 2) AS INT) / 60 <= 90 THEN
                CASE WHEN split_part(south, ' ', 1) = '0' AND split_part(south, ' ', 2) = '0' THEN '0' ELSE '-' || split_part(south, ' ', 1) || CASE split_part(south, ' ', 2) WHEN '0' THEN '' WHEN '15' THEN '.25' WHEN '30' THEN '.5' ELSE '.75' END END END""",
                "__source_record, south",
            ),
        ),
        "t24_reviewed_taxonomy": (
            _taxon,
            with_tables("@", m=MEASURED, book=CODEBOOK).replace(
                " @",
                f""", {_TAXA} SELECT __source_record, code, CASE WHEN taxon__review = 'converted' THEN meaning ELSE code END AS taxon, CASE WHEN taxon__review = 'converted' THEN ident ELSE '' END AS taxon__taxon_id, taxon__review FROM taxa""",
            ),
        ),
        "t24_taxonomy_candidates": (
            lambda s, d: V.taxonomy_candidates(load(s, d, _PART_TAXA), "recorded", "target", "ident"),
            with_tables(
                """SELECT recorded, rank, taxon, taxon_id, reference_records FROM (SELECT *, row_number() OVER (PARTITION BY recorded ORDER BY f) AS rank FROM
                (SELECT recorded, target AS taxon, ident AS taxon_id, count(*) AS reference_records, min(__source_record) AS f FROM b WHERE recorded <> '' GROUP BY recorded, target, ident)) WHERE rank <= 5""",
                b=_PART_TAXA,
            ),
        ),
        "t25_coordinate_pairs": (
            lambda s, d: V.review_coordinate_pair(_measured(s, d).select("__source_record", "easting", "northing"), "easting", "northing", "point", "EPSG:3857").selectExpr(
                "__source_record", "easting", "northing", "round(try_cast(point_latitude as double), 8) AS point_latitude", "round(try_cast(point_longitude as double), 8) AS point_longitude", "point__review"
            ),
            with_tables(
                f"""SELECT __source_record, easting, northing, CASE WHEN {pair_state} = 'converted' THEN round((pi() / 2 - 2 * atan(exp(-{y} / 6378137))) * 180 / pi(), 8) END AS point_latitude,
                CASE WHEN {pair_state} = 'converted' THEN round({x} / 6378137 * 180 / pi(), 8) END AS point_longitude, {pair_state} AS point__review FROM t""",
                t=MEASURED,
            ),
        ),
        "t25_unknown_reference_system": (
            lambda s, d: V.review_coordinate_pair(_measured(s, d).select("__source_record", "easting", "northing"), "easting", "northing", "point", "unknown"),
            with_tables(
                """SELECT __source_record, easting, northing, '' AS point_latitude, '' AS point_longitude, CASE WHEN easting = '' AND northing = '' THEN 'empty' ELSE 'unresolved' END AS point__review FROM t""",
                t=MEASURED,
            ),
        ),
        "t26_upstream_outcomes": (
            _chain,
            _code_sql(
                """SELECT *, CASE WHEN nation__review NOT IN ('unresolved', 'conflicting') AND nation = 'FRANCE' THEN '' ELSE nation END AS final,
                CASE WHEN nation = '' THEN 'empty' WHEN nation__review IN ('unresolved', 'conflicting') THEN nation__review WHEN nation = 'FRANCE' THEN 'converted' ELSE 'unchanged' END AS final__review FROM nations"""
            ),
        ),
        "t27_outcome_coverage": (
            lambda s, d: V.outcome_coverage(_chain(s, d), "nation"),
            _code_sql(" UNION ALL ".join(f"""SELECT '{o}' AS outcome, count(*) AS "rows" FROM nations WHERE nation__review = '{o}'""" for o in outcomes)),
        ),
        "t27_coverage_status": (
            lambda s, d: V.coverage_status(_chain(s, d), "nation"),
            _code_sql("SELECT count(*) AS open_rows, CASE WHEN count(*) > 0 THEN 'Inferred' ELSE 'Confirmed' END AS status FROM nations WHERE nation__review IN ('unresolved', 'conflicting')"),
        ),
        "t28_inherited_sensitivity": (
            lambda s, d: V.inherited_sensitivity(dictionary(s, d), _lineage(dictionary(s, d))),
            with_tables(
                """SELECT "table", 'derived ' || CAST(CAST(floor(position / 3) AS BIGINT) AS VARCHAR) AS derived, bool_or(sensitive OR term IN ('decimalLatitude', 'decimalLongitude', 'verbatimLatitude', 'verbatimLongitude')
                OR regexp_matches(name, 'latitude|longitude|coordinate|easting|northing|geometry|footprint|geohash|(^|[^a-z])(lat|lon|lng)($|[^a-z])', 'i')) AS sensitive FROM dict GROUP BY "table", floor(position / 3)""",
                dict=DICTIONARY_ROWS,
            ),
        ),
        "t31_reviewed_meanings": (
            lambda s, d: V.review_meanings(dictionary(s, d), _meanings(dictionary(s, d))).drop("allowed"),
            with_tables(
                """SELECT * EXCLUDE (allowed_text) REPLACE (CASE WHEN hit THEN 'meaning of ' || name ELSE description END AS description, CASE WHEN hit THEN 'km' ELSE unit END AS unit, CASE WHEN hit THEN 'locality' ELSE term END AS term,
                CASE WHEN hit THEN 'curator' ELSE reviewer END AS reviewer, CASE WHEN hit THEN 'protocol' ELSE rationale END AS rationale, CASE WHEN hit THEN 'Confirmed' ELSE status END AS status) FROM (SELECT *, position % 4 = 1 AS hit FROM dict)""",
                dict=DICTIONARY_ROWS,
            ).replace("SELECT * EXCLUDE (allowed_text)", "SELECT * EXCLUDE (allowed_text, hit)"),
        ),
    }


def _lineage(dictionary_rows):
    return dictionary_rows.select("table", F.concat(F.lit("derived "), F.floor(F.col("position") / 3).cast("string")).alias("derived"), F.col("name").alias("source"))


def _meanings(dictionary_rows):
    """Reviewed meanings for every fourth field; changes without a description or reviewer are not taken."""
    described = F.when(F.col("position") % 4 == 3, " ").otherwise(F.concat(F.lit("meaning of "), "name"))
    reviewer = F.when(F.col("position") % 4 == 1, "curator").otherwise("")
    rows = dictionary_rows.filter("position % 4 in (1, 2, 3)")
    return rows.select("table", "name", described.alias("description"), F.lit("km").alias("unit"), F.lit("locality").alias("term"), reviewer.alias("reviewer"), F.lit("protocol").alias("rationale"))


_DEGREES = """SELECT CAST(o_orderkey + 1 AS BIGINT) AS __source_record, CASE WHEN o_orderkey % 12 = 0 THEN '' ELSE CAST(o_orderkey % 95 AS STRING) || ' ' || CAST(o_orderkey % 5 * 15 AS STRING) || ' 0″ S' END AS south FROM {orders}"""
_PART_TAXA = """SELECT CAST(p_partkey + 1 AS BIGINT) AS __source_record, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_brand END AS recorded, CAST(p_size % 4 AS STRING) AS target, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS ident FROM {part}"""
