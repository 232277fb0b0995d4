"""Search, sorting, paging, provenance and traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedgetable.core import Field, default_fields
from sedgetable.operators import findings as N, search as Q
from sedgetable.plans.inputs import CUSTOMER, CUSTOMER_COLUMNS, SURVEY, SURVEY_COLUMNS, cells, load, script_number, trim, with_tables


def _survey(s, d):
    return load(s, d, SURVEY)


def _baseline(s, d):
    wide = load(s, d, CUSTOMER)
    return wide.withColumn("__row_width", F.when(F.col("__source_record") % 9 == 0, 3).otherwise(4))


def _provenance(s, d):
    base = _baseline(s, d)
    working = base.drop("__row_width").withColumn("segment", F.trim("segment")).withColumn("copy", F.col("name"))
    fields = [*default_fields(base.drop("__row_width")), Field("copy", "copy", operation="derive field", source_fields=["name"])]
    return Q.cell_provenance(base, working, fields)


def _trace(s, d):
    df = load(s, d, CUSTOMER).withColumn("upper", F.upper("name")).withColumn("upper__review", F.lit("converted")).withColumn("both", F.concat("upper", F.lit(" "), F.col("nationkey")))
    fields = [
        *default_fields(load(s, d, CUSTOMER)),
        Field("upper", "upper", operation="uppercase", source_fields=["name"], outcome_field="upper__review"),
        Field("both", "both", operation="merge columns", source_fields=["upper", "nationkey"]),
    ]
    return Q.derivation_trace(df, fields, "name")


def entries():
    any_site = " OR ".join(f"contains(lower({c}), 'site 1')" for c in SURVEY_COLUMNS)
    key = "list_aggregate(list_transform(regexp_extract_all(lower(site), '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, 12, '0') ELSE x END), 'string_agg', '')"
    return {
        "q01_literal_row_search": (
            lambda s, d: Q.search_rows(_survey(s, d), "Site 1"),
            with_tables(f"SELECT * FROM t WHERE {any_site}", t=SURVEY),
        ),
        "q01_search_special_characters": (
            lambda s, d: Q.search_rows(_survey(s, d), "n/a").select("__source_record"),
            with_tables("SELECT __source_record FROM t WHERE " + " OR ".join(f"contains(lower({c}), 'n/a')" for c in SURVEY_COLUMNS), t=SURVEY),
        ),
        "q02_column_filters": (
            lambda s, d: Q.filter_rows(_survey(s, d), "site", {"note": "URGENT", "event_date": "-0"}),
            with_tables(
                "SELECT * FROM t WHERE (" + " OR ".join(f"contains(lower({c}), 'site')" for c in SURVEY_COLUMNS) + ") AND contains(lower(note), 'urgent') AND contains(lower(event_date), '-0')",
                t=SURVEY,
            ),
        ),
        "q03_numeric_aware_sort": (
            lambda s, d: Q.sorted_positions(_survey(s, d), "site").select("position", "__source_record", "site"),
            with_tables(f"SELECT row_number() OVER (ORDER BY {key}, __source_record) AS position, __source_record, site FROM t", t=SURVEY),
        ),
        "q04_page": (
            lambda s, d: Q.page(_survey(s, d), 120, 50),
            with_tables("SELECT * FROM t WHERE __source_record BETWEEN 121 AND 170", t=SURVEY),
        ),
        "q04_searched_page": (
            lambda s, d: Q.page(_survey(s, d), 30, 20, "=sum"),
            with_tables("SELECT * FROM t WHERE " + " OR ".join(f"contains(lower({c}), '=sum')" for c in SURVEY_COLUMNS) + " ORDER BY __source_record LIMIT 20 OFFSET 30", t=SURVEY),
        ),
        "q04_page_total": (
            lambda s, d: Q.page_total(_survey(s, d), "=sum"),
            with_tables("SELECT count(*) AS total FROM t WHERE " + " OR ".join(f"contains(lower({c}), '=sum')" for c in SURVEY_COLUMNS), t=SURVEY),
        ),
        "q05_rows_of_finding": (
            lambda s, d: Q.rows_of_finding(_survey(s, d), N.cell_findings(_survey(s, d), rules=["formula-like text"])),
            with_tables("SELECT * FROM t WHERE " + " OR ".join(f"regexp_matches({c}, '^[=+@]') OR ({c} LIKE '-%' AND NOT regexp_matches({c}, '^-[0-9]+(\\.[0-9]*)?([eE][+-]?[0-9]+)?$'))" for c in SURVEY_COLUMNS), t=SURVEY),
        ),
        "q06_cell_provenance": (
            _provenance,
            with_tables(
                """SELECT __source_record, "column", original, working, derived, original IS NOT NULL AND original <> working AS changed FROM (
                  SELECT __source_record, "column", CASE WHEN "column" = 'segment' AND __source_record % 9 = 0 THEN NULL ELSE value END AS original,
                    CASE WHEN "column" = 'segment' THEN trim(value) ELSE value END AS working, false AS derived FROM (@)
                  UNION ALL SELECT __source_record, 'copy', NULL, name, true FROM c)""".replace("@", cells("c", CUSTOMER_COLUMNS)),
                c=CUSTOMER,
            ),
        ),
        "q07_field_context": (
            lambda s, d: Q.field_context(_survey(s, d), "note"),
            with_tables(
                """SELECT value, n, first_record, (SELECT count(*) FROM t) AS "rows", (SELECT count(*) FROM t WHERE note = '') AS blanks, (SELECT count(DISTINCT note) FROM t) AS distinct_values
                FROM (SELECT note AS value, count(*) AS n, min(__source_record) AS first_record FROM t GROUP BY note) ORDER BY n DESC, first_record LIMIT 12""",
                t=SURVEY,
            ),
        ),
        "q08_plot_points": (
            lambda s, d: Q.plot_points(_survey(s, d), "latitude", "longitude"),
            with_tables(
                f"""SELECT * FROM (SELECT __source_record, {script_number('latitude')} AS lat, {script_number('longitude')} AS lon FROM t WHERE {trim('latitude')} <> '' AND {trim('longitude')} <> '')
                WHERE abs(lat) <= 90 AND abs(lon) <= 180""",
                t=SURVEY,
            ),
        ),
        "q09_derivation_trace": (
            _trace,
            with_tables(
                """SELECT __source_record, name AS recorded, 'upper' AS derived, upper(name) AS value, 'converted' AS outcome, 'name > upper' AS trace, '{"name":"' || name || '"}' AS inputs FROM c
                UNION ALL SELECT __source_record, name, 'both', upper(name) || ' ' || nationkey, NULL, 'name > upper > both', '{"upper":"' || upper(name) || '","nationkey":"' || nationkey || '"}' FROM c""",
                c=CUSTOMER,
            ),
        ),
    }
