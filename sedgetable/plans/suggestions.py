"""Import screening, suggestions and the review queue."""

from __future__ import annotations

from sedgetable.operators import findings as N
from sedgetable.plans.findings import RULES, _cells_cte, _fields, rule_sql
from sedgetable.plans.inputs import DECIMAL, DICTIONARY_ROWS, SURVEY, dictionary, load, matches, trim, with_tables

V, T = "value", trim("value")
_ITEMS = """SELECT 'item ' || lpad(CAST(p_partkey AS STRING), 9, '0') AS id,
  CASE p_partkey % 6 WHEN 0 THEN 'meaning' WHEN 1 THEN 'unit' WHEN 2 THEN 'validation' WHEN 3 THEN 'trim' WHEN 4 THEN 'odd' ELSE 'privacy' END AS kind FROM {part}"""
_DECISIONS = """SELECT 'item ' || lpad(CAST(l_partkey AS STRING), 9, '0') AS "key", CASE l_linenumber % 3 WHEN 0 THEN 'Needs review' WHEN 1 THEN 'Accepted' ELSE 'Rejected' END AS state,
  l_orderkey * 10000000 + l_suppkey * 100 + l_linenumber AS "at" FROM {lineitem} WHERE l_partkey % 50 <> 2"""
_MEASURES = """SELECT CAST(o_orderkey + 1 AS BIGINT) AS __source_record, CAST(o_orderkey % 90 AS STRING) AS temp,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS "Temp unit", CAST(o_custkey AS STRING) AS depth, o_orderstatus AS depth_units FROM {orders}"""
_CODES = "SELECT CAST(p_size AS STRING) AS code, p_brand AS meaning FROM {part}"


def _screen(rule: str, test: str, column: str | None = None) -> str:
    where = f""" AND "column" = '{column}'""" if column else ""
    return f"""SELECT '{rule}' AS rule, 'screening' AS layer, 'Information' AS severity, "column", __source_record, value FROM cells WHERE ({test}){where}"""


def _identifiers_sql() -> str:
    return with_tables(
        """SELECT 'identifier blank' AS rule, 'screening' AS layer, 'Information' AS severity, 'record_id' AS "column", __source_record, record_id AS value FROM t WHERE record_id = ''
        UNION ALL SELECT 'identifier repeat', 'screening', 'Information', 'record_id', __source_record, record_id FROM
        (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY __source_record) AS rn FROM t WHERE record_id <> '') WHERE rn > 1""",
        t=SURVEY,
    )


def _names(body: str) -> str:
    return with_tables("@", dict=DICTIONARY_ROWS).replace(" @", """, folded AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS f FROM dict) """ + body)


def entries():
    month_day = f"CASE WHEN {matches(V, '^[0-9]{1,2}/[0-9]{1,2}/([0-9]{2}|[0-9]{4})$')} THEN TRY_CAST(split_part({V}, '/', 1) AS INT) <= 12 AND TRY_CAST(split_part({V}, '/', 2) AS INT) <= 12 AND TRY_CAST(split_part({V}, '/', 1) AS INT) <> TRY_CAST(split_part({V}, '/', 2) AS INT) ELSE false END"
    april = f"TRY_CAST(split_part({V}, ' ', 3) || '-04-' || lpad(split_part({V}, ' ', 1), 2, '0') AS DATE) IS NOT NULL"
    named = f"""SELECT 'named month or partial date' AS rule, 'suggestion' AS layer, 'Information' AS severity, "column", __source_record, value FROM cells WHERE "column" = 'event_date' AND
      ({matches(T, '^([0-9]{4}(-[0-9]{2}){0,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})$')} OR ({matches(V, '^[0-9]{1,2} April [0-9]{4}$')} AND {april}))"""
    roles = " UNION ALL ".join(
        f"""SELECT "table", name, '{term}' AS term, CASE WHEN f = lower('{term}') THEN 'High' ELSE 'Medium' END AS confidence FROM folded WHERE regexp_matches(f, '{pattern}')""" for term, pattern in N.ROLE_PATTERNS.items()
    )
    candidate = "CASE " + " ".join(f"WHEN regexp_matches(f, '{p}') THEN '{t}'" for t, p in N.MEANING_PATTERNS.items()) + " ELSE '' END"
    priority = "CASE kind " + " ".join(f"WHEN '{k}' THEN {p}" for k, p in N.PRIORITY.items()) + " ELSE 99 END"
    place = "latitude|longitude|coordinate|easting|northing|geometry|footprint|geohash|(^|[^a-z])(lat|lon|lng)($|[^a-z])"
    return {
        "f27_screened_day_or_month_first": (
            lambda s, d: N.cell_findings(load(s, d, SURVEY), rules=["screened day or month first"]),
            _cells_cte(_screen("screened day or month first", month_day)),
        ),
        "f28_screened_coordinate_range": (
            lambda s, d: N.cell_findings(load(s, d, SURVEY), rules=["screened latitude range", "screened longitude range"]),
            _cells_cte(
                " UNION ALL ".join(
                    _screen(f"screened {axis} range", f"{T} <> '' AND NOT coalesce(CASE WHEN {matches(T, DECIMAL)} THEN abs(CAST({T} AS DOUBLE)) <= {limit} END, false)", axis)
                    for axis, limit in (("latitude", 90), ("longitude", 180))
                )
            ),
        ),
        "f29_repeated_identifiers": (lambda s, d: N.repeated_identifiers(load(s, d, SURVEY)), _identifiers_sql()),
        "f30_unit_suffix_suggestions": (
            lambda s, d: N.unit_suggestions(dictionary(s, d)),
            with_tables(
                """SELECT "table", name, regexp_extract(name, '(?i)_(F|C|K|mm|cm|m|ft|mi|km|mg|g|kg|m2|cm2|km2|ha|s|min|h|d)$', 1) AS suggested_unit FROM dict
                WHERE unit = '' AND regexp_matches(name, '(?i)_(F|C|K|mm|cm|m|ft|mi|km|mg|g|kg|m2|cm2|km2|ha|s|min|h|d)$')""",
                dict=DICTIONARY_ROWS,
            ),
        ),
        "f30_companion_unit_labels": (
            lambda s, d: N.companion_unit_labels(load(s, d, _MEASURES)),
            with_tables(
                """SELECT field, unit_field, rank, label FROM (SELECT field, unit_field, label, row_number() OVER (PARTITION BY field ORDER BY f) AS rank FROM (
                  SELECT 'temp' AS field, 'Temp unit' AS unit_field, "Temp unit" AS label, min(__source_record) AS f FROM m WHERE "Temp unit" <> '' GROUP BY "Temp unit"
                  UNION ALL SELECT 'depth', 'depth_units', depth_units, min(__source_record) FROM m WHERE depth_units <> '' GROUP BY depth_units)) WHERE rank <= 20""",
                m=_MEASURES,
            ),
        ),
        "f31_term_suggestions": (lambda s, d: N.term_suggestions(dictionary(s, d)), _names(roles)),
        "f31_meaning_suggestions": (
            lambda s, d: N.meaning_suggestions(dictionary(s, d)),
            _names(
                f"""SELECT "table", name, candidate, kind FROM (SELECT "table", name, {candidate} AS candidate, CASE WHEN status = 'Conflicting' THEN 'conflict'
                WHEN status <> 'Confirmed' OR description = '' THEN 'meaning' WHEN term = '' AND {candidate} <> '' THEN 'mapping' END AS kind FROM folded) WHERE kind IS NOT NULL"""
            ),
        ),
        "f32_named_month_or_partial_date": (
            lambda s, d: N.cell_findings(load(s, d, SURVEY), rules=["named month or partial date"]),
            _cells_cte(named),
        ),
        "f33_sensitive_fields": (
            lambda s, d: N.sensitive_fields(dictionary(s, d)),
            with_tables(
                f"""SELECT "table", name, term, sensitive FROM dict WHERE regexp_matches(name || ' ' || original_name, '{place}', 'i')
                OR term IN ('decimalLatitude', 'decimalLongitude', 'verbatimLatitude', 'verbatimLongitude') OR sensitive""",
                dict=DICTIONARY_ROWS,
            ),
        ),
        "f34_codebook_conflicts": (
            lambda s, d: N.codebook_conflicts(load(s, d, _CODES), "code", "meaning"),
            with_tables("SELECT code, count(DISTINCT meaning) AS meanings FROM b GROUP BY code HAVING count(DISTINCT meaning) > 1", b=_CODES),
        ),
        "f35_review_queue": (
            lambda s, d: N.review_queue(load(s, d, _ITEMS), load(s, d, _DECISIONS)),
            with_tables(
                f"""SELECT id, kind, {priority} AS priority FROM i WHERE id NOT IN (SELECT "key" FROM (SELECT "key", arg_max(state, "at") AS state FROM decisions GROUP BY "key")
                WHERE state IN ('Rejected', 'Accepted', 'Intentionally unresolved', 'Reviewed')) ORDER BY priority, id LIMIT 3""",
                i=_ITEMS, decisions=_DECISIONS,
            ),
        ),
        "f36_capped_findings": (
            lambda s, d: N.capped_findings(N.cell_findings(load(s, d, SURVEY), _fields(s, d)), ["rule", "column", "__source_record"]),
            _cells_cte(
                f"""SELECT *, (SELECT count(*) FROM ({' UNION ALL '.join(rule_sql(k) for k in RULES)})) - 500 AS omitted FROM ({' UNION ALL '.join(rule_sql(k) for k in RULES)})
                ORDER BY rule, "column", __source_record LIMIT 500"""
            ),
        ),
        "f36_severity_counts": (
            lambda s, d: N.severity_counts(N.cell_findings(load(s, d, SURVEY), _fields(s, d))),
            _cells_cte(f"SELECT severity, count(*) AS findings FROM ({' UNION ALL '.join(rule_sql(k) for k in RULES)}) GROUP BY severity"),
        ),
        "suggested_sentinels": (
            lambda s, d: N.cell_findings(load(s, d, SURVEY), rules=["suggested sentinels"]),
            _cells_cte(
                f"""SELECT 'suggested sentinels' AS rule, 'suggestion' AS layer, 'Information' AS severity, "column", __source_record, value FROM cells
                WHERE upper({T}) IN ('NA', 'N/A', 'NULL', '.', '-', '999', '9999') OR {matches(T, '^-9{1,6}$')}"""
            ),
        ),
    }
