"""Column profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedgetable.functions.text import is_blank
from sedgetable.operators import findings as N, profiles as P
from sedgetable.plans.inputs import DICTIONARY_ROWS, SURVEY, SURVEY_COLUMNS, DECIMAL, cells, dictionary, load, matches, script_number, trim, trim_record, type_class, with_tables

_CELLS = cells("t", SURVEY_COLUMNS)
KINDS = ("integer", "number", "date-like", "boolean", "text")


def _survey(s, d):
    return load(s, d, SURVEY)


def _freq(s, d):
    return P.value_frequencies(_survey(s, d))


def _approximate(s, d):
    """Whether each sketch is within four standard errors of the exact count."""
    survey = _survey(s, d)
    exact = _freq(s, d).filter(~is_blank(F.col("value"))).groupBy("column").agg(F.count("*").alias("exact_unique"))
    near = F.abs(F.coalesce("approximate_unique", F.lit(0)) - F.col("exact_unique")) <= 1 + 4 * 0.02 * F.col("exact_unique")
    return exact.join(P.approximate_distinct(survey, 0.02), "column", "left").select("column", "exact_unique", near.alias("within_error"))


def profile_sql() -> str:
    """Column profile from the survey's value frequencies."""
    counts = ", ".join(f"""coalesce(sum(CASE WHEN kind = '{k}' THEN n END), 0) AS "n_{k}", min(CASE WHEN kind = '{k}' THEN f END) AS "f_{k}" """ for k in KINDS)
    ranked = " UNION ALL ".join(f"""SELECT "column", '{k}' AS k, "n_{k}" AS n, "f_{k}" AS f FROM merged WHERE "n_{k}" > 0""" for k in KINDS)
    return f"""freq AS (SELECT "column", value, count(*) AS n, min(__source_record) AS f, {type_class('value')} AS kind, {trim('value')} = '' AS blank FROM ({_CELLS}) GROUP BY "column", value),
      wide AS (SELECT "column", CAST(sum(n) AS BIGINT) AS total, CAST(coalesce(sum(CASE WHEN blank THEN n END), 0) AS BIGINT) AS missing, count(CASE WHEN NOT blank THEN 1 END) AS uniq,
        CAST(coalesce(sum(CASE WHEN value <> {trim('value')} THEN n END), 0) AS BIGINT) AS whitespace, min(CASE WHEN NOT blank THEN {script_number('value')} END) AS low, max(CASE WHEN NOT blank THEN {script_number('value')} END) AS high, {counts}
        FROM freq GROUP BY "column"),
      merged AS (SELECT * REPLACE (CASE WHEN "n_integer" > 0 AND "n_number" > 0 THEN 0 ELSE "n_integer" END AS "n_integer", CASE WHEN "n_integer" > 0 AND "n_number" > 0 THEN "n_integer" + "n_number" ELSE "n_number" END AS "n_number") FROM wide),
      dominant AS (SELECT "column", k FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, f) AS rn FROM ({ranked})) WHERE rn = 1),
      profile AS (SELECT m."column", total AS "rows", missing, missing / total * 100 AS null_percent, uniq AS "unique", coalesce(k, 'empty') AS "type",
        {', '.join(f'CAST("n_{k}" AS BIGINT) AS {k.replace("-", "_")}_count' for k in KINDS)}, whitespace,
        CASE WHEN k IN ('integer', 'number') THEN low END AS numeric_min, CASE WHEN k IN ('integer', 'number') THEN high END AS numeric_max, missing = 0 AND uniq = total AS candidate_identifier
        FROM merged m LEFT JOIN dominant d ON m."column" = d."column")"""


def _profiled(select: str) -> str:
    return with_tables("@", t=SURVEY).replace(" @", f", {profile_sql()} {select}")


def entries():
    record_number = f"CASE WHEN {matches(trim_record('value'), DECIMAL)} THEN CAST({trim_record('value')} AS DOUBLE) END"
    return {
        "p01_import_profile": (
            lambda s, d: P.import_profile(_survey(s, d)),
            with_tables(
                f"""SELECT "column", count(*) AS "rows", count(CASE WHEN value = '' THEN 1 END) AS empty, count(CASE WHEN value <> {trim_record('value')} THEN 1 END) AS whitespace,
                CAST(min(length(value)) AS INT) AS min_length, CAST(max(length(value)) AS INT) AS max_length, count({record_number}) AS numeric_count, min({record_number}) AS numeric_min, max({record_number}) AS numeric_max
                FROM ({_CELLS}) GROUP BY "column" """,
                t=SURVEY,
            ),
        ),
        "p02_first_samples": (
            lambda s, d: P.first_samples(_survey(s, d)),
            with_tables(
                f"""SELECT "column", rank, substring(value, 1, 200) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY f) AS rank FROM
                (SELECT "column", value, min(__source_record) AS f FROM ({_CELLS}) WHERE value <> '' GROUP BY "column", value)) WHERE rank <= 5""",
                t=SURVEY,
            ),
        ),
        "p03_value_type_class": (
            lambda s, d: P.classify_values(_survey(s, d), "event_date"),
            with_tables(f"SELECT __source_record, event_date AS value, {type_class('event_date')} AS type_class FROM t", t=SURVEY),
        ),
        "p04_column_profile": (
            lambda s, d: P.column_profile(_freq(s, d)).drop("null_percent", "numeric_min", "numeric_max"),
            _profiled("SELECT * EXCLUDE (null_percent, numeric_min, numeric_max) FROM profile"),
        ),
        "p04_examples": (
            lambda s, d: P.examples(_freq(s, d)),
            with_tables(
                f"""SELECT "column", rank, value FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY f) AS rank FROM
                (SELECT "column", value, min(__source_record) AS f FROM ({_CELLS}) WHERE {trim('value')} <> '' GROUP BY "column", value)) WHERE rank <= 3""",
                t=SURVEY,
            ),
        ),
        "p05_extended_profile": (
            lambda s, d: P.column_profile(_freq(s, d)).selectExpr("`column`", "round(null_percent, 6) AS null_percent", "numeric_min", "numeric_max"),
            _profiled('SELECT "column", round(null_percent, 6) AS null_percent, numeric_min, numeric_max FROM profile'),
        ),
        "p05_common_values": (
            lambda s, d: P.common_values(_freq(s, d)),
            with_tables(
                f"""SELECT "column", rank, value, n FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, f) AS rank FROM
                (SELECT "column", value, count(*) AS n, min(__source_record) AS f FROM ({_CELLS}) GROUP BY "column", value)) WHERE rank <= 8""",
                t=SURVEY,
            ),
        ),
        "p06_candidate_identifiers": (
            lambda s, d: P.candidate_identifiers(P.value_frequencies(load(s, d, "SELECT CAST(c_custkey + 1 AS BIGINT) AS __source_record, CAST(c_custkey AS STRING) AS custkey, c_name AS name, c_mktsegment AS segment FROM {customer}"))),
            """SELECT 'custkey' AS "column", 'High' AS confidence WHERE (SELECT count(DISTINCT c_custkey) = count(*) FROM customer)
            UNION ALL SELECT 'name', 'Low' WHERE (SELECT count(DISTINCT c_name) = count(*) FROM customer) UNION ALL SELECT 'segment', 'Low' WHERE (SELECT count(DISTINCT c_mktsegment) = count(*) FROM customer)""",
        ),
        "p07_key_statistics": (
            lambda s, d: P.key_statistics(_survey(s, d), ["site", "abundance"]),
            with_tables(
                """SELECT count(*) AS "rows", count(CASE WHEN site = '' OR abundance = '' THEN 1 END) AS blanks, count(*) - count(DISTINCT (site, abundance)) AS duplicates, count(DISTINCT (site, abundance)) AS distinct_tuples FROM t""",
                t=SURVEY,
            ),
        ),
        "p08_approximate_distinct": (
            _approximate,
            with_tables(f"""SELECT "column", count(DISTINCT value) AS exact_unique, true AS within_error FROM ({_CELLS}) WHERE {trim('value')} <> '' GROUP BY "column" """, t=SURVEY),
        ),
        "p09_status_rollup": (
            lambda s, d: P.status_rollup(dictionary(s, d)),
            with_tables("SELECT status, count(*) AS fields FROM dict GROUP BY status", dict=DICTIONARY_ROWS),
        ),
        "p09_finding_rollup": (
            lambda s, d: P.finding_rollup(N.cell_findings(_survey(s, d), rules=["blank values", "outer whitespace"])),
            with_tables(
                f"""SELECT 'scientific' AS layer, 'Information' AS severity, count(*) AS findings FROM ({_CELLS}) WHERE {trim('value')} = ''
                UNION ALL SELECT 'scientific', 'Warning', count(*) FROM ({_CELLS}) WHERE value <> {trim('value')}""",
                t=SURVEY,
            ),
        ),
    }
