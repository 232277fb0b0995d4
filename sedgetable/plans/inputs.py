"""Inputs of the registered queries: driver tables as literal text with planted problems.

Every problem is a rule on the row's own key, written once in SQL that Spark and
an ANSI engine both read, so both sides see the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sedgetable.functions.text import PROJECT_SPACE, RECORD_SPACE

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Evaluate SQL over the driver tables it names."""
    named = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **named)


def ansi(sql: str) -> str:
    """The same SQL with plain table names."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def number(expression: str) -> str:
    return f"CAST({expression} AS STRING)"


def pad2(expression: str) -> str:
    return f"lpad(CAST({expression} AS STRING), 2, '0')"


_K = "o_orderkey"
_YEAR = number(f"1990 + {_K} % 40")
_MONTH = pad2(f"1 + {_K} % 12")
_DAY = pad2(f"1 + {_K} % 31")

# Survey records: identifiers, mixed dates, coordinates, counts, padded sites and odd notes.
SURVEY = f"""
SELECT CAST({_K} + 1 AS BIGINT) AS __source_record,
  CASE WHEN {_K} % 10 = 0 THEN '' WHEN {_K} % 50 = 1 THEN {number(_K + ' + 1')} ELSE {number(_K)} END AS record_id,
  CASE {_K} % 13 WHEN 0 THEN '' WHEN 1 THEN 'NA' WHEN 2 THEN {_YEAR} || '-02-30' WHEN 3 THEN {_YEAR} WHEN 4 THEN {_YEAR} || '-' || {_MONTH}
    WHEN 5 THEN '7/' || {_YEAR} WHEN 6 THEN {number('30000 + ' + _K + ' % 60000')} WHEN 7 THEN {number('1 + ' + _K + ' % 20')} || '/' || {number('1 + ' + _K + ' % 14')} || '/' || {_YEAR}
    WHEN 8 THEN {_DAY} || '-' || {_MONTH} || '-99' WHEN 9 THEN {number('1 + ' + _K + ' % 31')} || ' April ' || {_YEAR} WHEN 10 THEN {_YEAR} || '-' || {_MONTH} || '-' || {_DAY} || 'T10:00'
    WHEN 11 THEN ' ' || {_YEAR} || '-' || {_MONTH} || '-' || {_DAY} ELSE {_YEAR} || '-' || {_MONTH} || '-' || {_DAY} END AS event_date,
  CASE {_K} % 17 WHEN 0 THEN '' WHEN 1 THEN 'north' WHEN 2 THEN ' 53 ' WHEN 3 THEN '0' ELSE {number(_K + ' % 260 - 130')} || '.5' END AS latitude,
  CASE WHEN {_K} % 19 = 0 THEN 'NA' WHEN {_K} % 17 = 3 THEN '0.0' ELSE {number('(' + _K + ' * 7) % 400 - 200')} END AS longitude,
  CASE {_K} % 11 WHEN 0 THEN 'two' WHEN 1 THEN '-9999' WHEN 2 THEN '' WHEN 3 THEN '1.5' WHEN 4 THEN '?' ELSE {number(_K + ' % 100')} END AS abundance,
  CASE {_K} % 7 WHEN 0 THEN ' site ' || {number(_K + ' % 25')} WHEN 1 THEN '\tsite ' || {number(_K + ' % 25')} WHEN 2 THEN 'site ' || {number(_K + ' % 25')} || ' ' ELSE 'site ' || {number(_K + ' % 25')} END AS site,
  CASE {_K} % 23 WHEN 0 THEN '=SUM(A1)' WHEN 1 THEN '-x' WHEN 2 THEN '-12.5' WHEN 3 THEN 'cafÃ©' WHEN 4 THEN 'bad �' WHEN 5 THEN '007' WHEN 6 THEN '@home' WHEN 7 THEN '+1'
    WHEN 8 THEN 'N/A' WHEN 9 THEN 'none' WHEN 10 THEN '.' WHEN 11 THEN '-' WHEN 12 THEN '-999' ELSE lower(o_orderpriority) END AS note
FROM {{orders}}"""
SURVEY_COLUMNS = ["record_id", "event_date", "latitude", "longitude", "abundance", "site", "note"]

# Customers as text, the parent and baseline of many queries.
CUSTOMER = """
SELECT CAST(c_custkey + 1 AS BIGINT) AS __source_record, CAST(c_custkey AS STRING) AS custkey, c_name AS name,
  CAST(c_nationkey AS STRING) AS nationkey, CASE WHEN c_custkey % 7 = 0 THEN '  ' || c_mktsegment || ' ' ELSE c_mktsegment END AS segment
FROM {customer}"""
CUSTOMER_COLUMNS = ["custkey", "name", "nationkey", "segment"]

ORDERS = """
SELECT CAST(o_orderkey + 1 AS BIGINT) AS __source_record, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE CAST(o_orderkey AS STRING) END AS orderkey,
  CASE WHEN o_orderkey % 10 = 3 THEN '' ELSE CAST(o_custkey AS STRING) END AS custkey, o_orderstatus AS status, o_orderpriority AS priority
FROM {orders}"""
ORDERS_COLUMNS = ["orderkey", "custkey", "status", "priority"]

# Line items have no unique key; their record number is only used as an identity.
LINES = """
SELECT CAST(0 AS BIGINT) AS __source_record, CAST(l_orderkey AS STRING) AS orderkey, CAST(l_linenumber AS STRING) AS linenumber,
  CAST(l_partkey AS STRING) AS partkey, l_returnflag AS returnflag, l_linestatus AS linestatus
FROM {lineitem}"""

# Two versions of the parts table: rows dropped, repeated and changed by rules on the key.
PARTS = """
SELECT CAST(p_partkey + 1 AS BIGINT) AS __source_record, CASE WHEN p_partkey % 40 = 9 THEN '' ELSE CAST(p_partkey AS STRING) END AS partkey,
  p_name AS name, p_brand AS brand, CAST(p_size AS STRING) AS size
FROM {part}"""
NEW_PARTS = """
SELECT CAST(p_partkey + 1 AS BIGINT) AS __source_record, CASE WHEN p_partkey % 40 = 19 THEN '' ELSE CAST(p_partkey AS STRING) END AS partkey,
  CASE WHEN p_partkey % 6 = 0 THEN p_name || '!' ELSE p_name END AS name, CASE WHEN p_partkey % 15 = 0 THEN lower(p_brand) ELSE p_brand END AS brand, CAST(p_size AS STRING) AS size
FROM {part} WHERE p_partkey % 20 <> 3
UNION ALL
SELECT CAST(10000000000 + p_partkey AS BIGINT), CAST(p_partkey AS STRING), p_name, p_brand, CAST(p_size AS STRING) FROM {part} WHERE p_partkey % 25 = 4
UNION ALL
SELECT CAST(20000000000 + p_partkey AS BIGINT), 'new ' || CAST(p_partkey AS STRING), p_name, p_brand, CAST(p_size AS STRING) FROM {part} WHERE p_partkey % 30 = 7"""
PART_COLUMNS = ["partkey", "name", "brand", "size"]

# A catalogue of field definitions: 15 fields per table.
_P = "p_partkey"
DICTIONARY_ROWS = f"""
SELECT 'table ' || CAST(CAST(floor({_P} / 15) AS BIGINT) AS STRING) AS "table", CAST({_P} % 15 AS INT) AS position,
  CASE {_P} % 15 WHEN 0 THEN 'species' WHEN 1 THEN 'Latitude' WHEN 2 THEN 'obs_dt' WHEN 3 THEN 'temp_C' WHEN 4 THEN 'site-id' WHEN 5 THEN 'event_id' WHEN 6 THEN 'decimalLongitude'
    WHEN 7 THEN 'n' WHEN 8 THEN 'recorded by' WHEN 9 THEN 'effort_min' WHEN 10 THEN 'depth_m' WHEN 11 THEN 'count' WHEN 12 THEN 'lat' ELSE p_name || ' ' || CAST({_P} AS STRING) END AS name,
  CASE WHEN {_P} % 9 = 0 THEN 'geometry ' || p_brand ELSE p_brand END AS original_name,
  CASE {_P} % 10 WHEN 0 THEN '' WHEN 1 THEN '  ' ELSE p_type END AS description,
  CASE {_P} % 6 WHEN 0 THEN 'integer' WHEN 1 THEN 'number' WHEN 2 THEN 'date' WHEN 3 THEN 'money' ELSE 'string' END AS data_type,
  CASE WHEN {_P} % 4 = 0 THEN '' ELSE 'm' END AS unit,
  CASE WHEN {_P} % 3 = 0 THEN '' ELSE p_brand || ',' || p_type END AS allowed_text,
  CASE {_P} % 7 WHEN 0 THEN 'decimalLatitude' WHEN 1 THEN 'eventDate' WHEN 2 THEN 'http://example.org/terms/' || CAST({_P} % 15 AS STRING) ELSE '' END AS term,
  CASE {_P} % 5 WHEN 0 THEN 'Confirmed' WHEN 1 THEN 'Inferred' WHEN 2 THEN 'Unknown' WHEN 3 THEN 'Conflicting' ELSE 'Not Applicable' END AS status,
  'reviewed from ' || p_brand AS rationale, CASE WHEN {_P} % 8 = 0 THEN '' ELSE 'curator' END AS reviewer, {_P} % 12 = 5 AS sensitive
FROM {{part}}"""

# Context of many tables: eight keys each.
METADATA = """
SELECT 'table ' || CAST(CAST(floor(c_custkey / 8) AS BIGINT) AS STRING) AS "table",
  CASE c_custkey % 8 WHEN 0 THEN 'title' WHEN 1 THEN 'creator' WHEN 2 THEN 'license' WHEN 3 THEN 'methods' WHEN 4 THEN 'spatialCoverage' WHEN 5 THEN 'temporalCoverage' WHEN 6 THEN 'datum' ELSE 'purpose' END AS "key",
  CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN c_name ELSE c_mktsegment END AS value,
  CASE c_custkey % 5 WHEN 0 THEN 'Confirmed' WHEN 1 THEN 'Inferred' WHEN 2 THEN 'Unknown' WHEN 3 THEN 'Conflicting' ELSE 'Not Applicable' END AS status
FROM {customer}"""

# An edit log over the customers: a first edit per fifth customer, later edits, undos and redos.
EDITS = """
SELECT CAST(c_custkey * 4 + 1 AS BIGINT) AS sequence, CAST(c_custkey + 1 AS BIGINT) AS __source_record, 'name' AS "column", c_name AS before, c_name || ' (checked)' AS after,
  CASE WHEN c_custkey % 3 = 0 THEN 'batch-trim' ELSE 'edit' END AS action, CAST(NULL AS BIGINT) AS reference FROM {customer}
UNION ALL
SELECT CAST(c_custkey * 4 + 2 AS BIGINT), CAST(c_custkey + 1 AS BIGINT), CASE WHEN c_custkey % 2 = 0 THEN 'name' ELSE 'nationkey' END,
  CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 60 = 0 THEN 'lost' ELSE c_name || ' (checked)' END ELSE CAST(c_nationkey AS STRING) END,
  CASE WHEN c_custkey % 2 = 0 THEN c_name || ' (twice)' ELSE 'N' || CAST(c_nationkey AS STRING) END, 'edit', CAST(NULL AS BIGINT) FROM {customer}
UNION ALL
SELECT CAST(c_custkey * 4 + 3 AS BIGINT), CAST(c_custkey + 1 AS BIGINT), CASE WHEN c_custkey % 2 = 0 THEN 'name' ELSE 'nationkey' END,
  CASE WHEN c_custkey % 2 = 0 THEN c_name || ' (twice)' ELSE 'N' || CAST(c_nationkey AS STRING) END,
  CASE WHEN c_custkey % 2 = 0 THEN c_name || ' (checked)' ELSE CAST(c_nationkey AS STRING) END, 'undo', CAST(c_custkey * 4 + 2 AS BIGINT) FROM {customer}
UNION ALL
SELECT CAST(c_custkey * 4 + 4 AS BIGINT), CAST(c_custkey + 1 AS BIGINT), CASE WHEN c_custkey % 2 = 0 THEN 'name' ELSE 'nationkey' END,
  CASE WHEN c_custkey % 2 = 0 THEN c_name || ' (checked)' ELSE CAST(c_nationkey AS STRING) END,
  CASE WHEN c_custkey % 2 = 0 THEN c_name || ' (twice)' ELSE 'N' || CAST(c_nationkey AS STRING) END, 'redo', CAST(c_custkey * 4 + 2 AS BIGINT) FROM {customer} WHERE c_custkey % 4 = 1"""


def spark_sql(sql: str) -> str:
    """Spark quotes names with backticks."""
    return sql.replace('"', "`")


def load(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return run(spark, sf_dir, spark_sql(sql))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with a stand-in identity; results must not depend on it."""
    return load(spark, sf_dir, LINES).withColumn("__source_record", F.monotonically_increasing_id())


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, DICTIONARY_ROWS)
    allowed = F.when(F.col("allowed_text") == "", F.array().cast("array<string>")).otherwise(F.split("allowed_text", ","))
    return rows.withColumn("allowed", allowed).drop("allowed_text")


def with_tables(sql: str, **named: str) -> str:
    """ANSI query with the planted inputs as common table expressions."""
    ctes = ", ".join(f"{name} AS ({ansi(body)})" for name, body in named.items())
    return f"WITH {ctes} {ansi(sql)}"


def cells(source: str, columns: list[str]) -> str:
    """Unpivoted cells of a common table expression."""
    return " UNION ALL ".join(f"""SELECT __source_record, '{c}' AS "column", "{c}" AS value FROM {source}""" for c in columns)


def trim(expression: str, space: str = PROJECT_SPACE) -> str:
    return f"trim({expression}, '{space}')"


def trim_record(expression: str) -> str:
    return trim(expression, RECORD_SPACE)


def matches(expression: str, pattern: str) -> str:
    return f"regexp_matches({expression}, '{pattern}')"


# Number grammars as SQL.
DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INTEGER = r"^[+-]?[0-9]+$"


def script_number(expression: str) -> str:
    v = trim(expression)
    return f"CASE WHEN {matches(v, DECIMAL)} THEN CAST({v} AS DOUBLE) END"


def type_class(expression: str) -> str:
    v = trim(expression)
    return (
        f"CASE WHEN {v} = '' THEN 'empty' WHEN {matches(v, INTEGER)} THEN 'integer' WHEN {matches(v, DECIMAL)} THEN 'number' "
        f"WHEN {matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}(T.*)?$')} THEN 'date-like' WHEN lower({v}) IN ('true', 'false') THEN 'boolean' ELSE 'text' END"
    )


def iso_day(expression: str) -> str:
    """Real calendar day in ISO shape."""
    return f"({matches(expression, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')} AND TRY_CAST({expression} AS DATE) IS NOT NULL)"
