"""Streams over the driver tables, drained to the end and compared with the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sedgetable.core import default_fields
from sedgetable.plans.findings import RULES, rule_sql
from sedgetable.plans.inputs import cells, load, with_tables
from sedgetable.scale import shared_folder
from sedgetable.streaming import flag_repeats, link_arrivals, run_available, stream_cell_findings

CHOSEN = ("f04", "f05", "f07", "f10", "f17")
EVENT_TEXT = """SELECT CAST(event_id + 1 AS BIGINT) AS __source_record, CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN ' ' || event_type WHEN 2 THEN 'NA' ELSE event_type END AS event_type,
  CASE event_id % 11 WHEN 0 THEN '=1' WHEN 1 THEN '2019-02-30' ELSE CAST(user_id AS STRING) END AS user_id FROM {events}"""


def _arriving(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table's file as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def _findings(s, d):
    events = _arriving(s, d, "events")
    k = F.col("event_id") % 7
    e = F.col("event_id") % 11
    text = events.select(
        (F.col("event_id") + 1).alias("__source_record"),
        F.when(k == 0, "").when(k == 1, F.concat(F.lit(" "), "event_type")).when(k == 2, "NA").otherwise(F.col("event_type")).alias("event_type"),
        F.when(e == 0, "=1").when(e == 1, "2019-02-30").otherwise(F.col("user_id").cast("string")).alias("user_id"),
    )
    found = stream_cell_findings(text, default_fields(text), [RULES[r][0] for r in CHOSEN])
    return s.read.schema(found.schema).parquet(run_available(found, shared_folder(s), "findings"))


def _links(s, d):
    orders = _arriving(s, d, "orders")
    child = orders.select((F.col("o_orderkey") + 1).alias("__source_record"), F.when(F.col("o_orderkey") % 10 == 0, "").otherwise(F.col("o_orderkey").cast("string")).alias("orderkey"))
    parent = load(s, d, "SELECT l_orderkey * 16 + l_linenumber AS __source_record, CAST(l_orderkey AS STRING) AS orderkey FROM {lineitem}")
    linked = link_arrivals(child, parent, ["orderkey"], ["orderkey"]).drop("__parent_source_record")
    return s.read.schema(linked.schema).parquet(run_available(linked, shared_folder(s), "links"))


def _repeats(s, d):
    events = _arriving(s, d, "events")
    seen = events.select(F.col("user_id").cast("string").alias("identifier"), (F.col("event_id") + 1).alias("__source_record"), F.col("ts").cast("timestamp").alias("at"))
    flagged = flag_repeats(s, seen, shared_folder(s), horizon="3650 days", horizon_ms=3650 * 86_400_000)
    return flagged.groupBy("identifier").agg(F.count_if("repeat").alias("repeats"), F.count_if(~F.col("repeat")).alias("firsts"))


def entries():
    keyed = """status AS (SELECT o.__source_record, CASE WHEN o.orderkey = '' THEN 'missing' WHEN i.n IS NULL THEN 'unmatched' WHEN i.n > 1 THEN 'conflicting' ELSE 'linked' END AS __link_status
      FROM (SELECT o_orderkey + 1 AS __source_record, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS orderkey FROM orders) o
      LEFT JOIN (SELECT CAST(l_orderkey AS VARCHAR) AS orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) i ON o.orderkey = i.orderkey)"""
    return {
        "s01_stream_cell_findings": (
            _findings,
            with_tables("@", t=EVENT_TEXT).replace(" @", f", cells AS ({cells('t', ['event_type', 'user_id'])}) " + " UNION ALL ".join(rule_sql(r) for r in CHOSEN)),
        ),
        "s02_stream_link_status": (_links, f"WITH {keyed} SELECT * FROM status"),
        "s03_stream_repeated_identifiers": (_repeats, "SELECT CAST(user_id AS VARCHAR) AS identifier, count(*) - 1 AS repeats, 1 AS firsts FROM events GROUP BY user_id"),
    }
