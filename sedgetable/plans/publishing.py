"""Redaction, descriptors, mapped projections and star exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedgetable.core import default_fields
from sedgetable.operators import findings as N, publishing as X
from sedgetable.plans.inputs import CUSTOMER, DICTIONARY_ROWS, ORDERS, SURVEY, dictionary, load, matches, trim_record, with_tables
from sedgetable.plans.sources import headed_lines
from sedgetable.scale import shared_folder
from sedgetable.sources.delimited import strict_scan
from sedgetable.sources.sinks import checksum_manifest

_ADDRESS = "CASE WHEN term LIKE 'http://%' OR term LIKE 'https://%' THEN term ELSE 'http://rs.tdwg.org/dwc/terms/' || term END"


def _survey_fields(s, d, confirmed: bool):
    fields = default_fields(load(s, d, SURVEY))
    for f in fields:
        if f.name == "latitude":
            f.term, f.status = "decimalLatitude", "Confirmed" if confirmed else "Inferred"
        if f.name == "note":
            f.sensitive = True
    return fields


def _public(mode: str, precision: int = 1):
    return lambda s, d: X.public_table(load(s, d, SURVEY), _survey_fields(s, d, True), mode, precision)


def _mapping(s, d):
    rows = dictionary(s, d)
    target = F.when(F.col("position") == 7, F.lit(None)).when(F.col("position") == 9, "t8").otherwise(F.concat(F.lit("t"), F.col("position").cast("string")))
    wanted = F.regexp_replace("table", "table (1[0-9])$", "table 10")
    return rows.select("table", "name", F.concat(F.lit("target of "), wanted).alias("target_table"), target.alias("target")).filter("target is not null")


def _targets(s, d):
    rows = dictionary(s, d).filter("position <> 5")
    return rows.select(F.concat(F.lit("target of "), "table").alias("target_table"), F.concat(F.lit("t"), F.col("position").cast("string")).alias("target"), F.concat(F.lit("http://example.org/terms/"), F.col("position").cast("string")).alias("term_address"))


def _star(s, d):
    core, orders = load(s, d, CUSTOMER), load(s, d, ORDERS).filter("custkey <> ''")
    folder = shared_folder(s)
    out = X.star_export(core, "custkey", {"orders": (orders, "custkey")}, folder)
    core_back, orders_back = strict_scan(s, out["core"], multi_line=False), strict_scan(s, out["orders"], multi_line=False)
    return core_back.select(F.lit("core").alias("source"), F.concat_ws("|", "custkey", "name", "segment").alias("row")).unionByName(orders_back.select(F.lit("orders").alias("source"), F.concat_ws("|", "orderkey", "custkey", "priority").alias("row")))


def _checksums(s, d):
    """Customers in files of 500 records; every file's bytes and hash can be told from the table."""
    rows = load(s, d, CUSTOMER).select("__source_record", F.concat_ws(",", "custkey", "name", "nationkey", "segment").alias("line"))
    found = checksum_manifest(s, headed_lines(rows, "custkey,name,nationkey,segment", s, 500))
    return found.select(F.regexp_extract("file", "part=([0-9]+)", 1).alias("part"), "bytes", "sha256")


def entries():
    number = f"CASE WHEN {matches(trim_record('latitude'), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$')} THEN CAST({trim_record('latitude')} AS DOUBLE) END"
    place = "latitude|longitude|coordinate|easting|northing|geometry|footprint|geohash|(^|[^a-z])(lat|lon|lng)($|[^a-z])"
    return {
        "x01_sensitive_columns": (
            lambda s, d: N.sensitive_fields(dictionary(s, d)).groupBy("table").agg(F.count("*").alias("sensitive_fields")),
            with_tables(
                f"""SELECT "table", count(*) AS sensitive_fields FROM dict WHERE regexp_matches(name || ' ' || original_name, '{place}', 'i') OR sensitive
                OR term IN ('decimalLatitude', 'decimalLongitude', 'verbatimLatitude', 'verbatimLongitude') GROUP BY "table" """,
                dict=DICTIONARY_ROWS,
            ),
        ),
        "x02_redacted_table": (_public("redact"), with_tables("SELECT * REPLACE ('' AS latitude, '' AS longitude, '' AS note) FROM t", t=SURVEY)),
        "x02_generalised_table": (
            _public("generalize", 1),
            with_tables(f"SELECT * REPLACE (coalesce(CAST({number} AS VARCHAR), '') AS latitude, '' AS longitude, '' AS note) FROM t", t=SURVEY),
        ),
        "x03_field_descriptors": (
            lambda s, d: X.field_descriptors(dictionary(s, d), dictionary(s, d).filter("position = 5")),
            with_tables(
                f"""SELECT "table", position, name, data_type AS type, description, unit, status, CASE WHEN allowed_text = '' THEN '' ELSE '["' || replace(allowed_text, ',', '","') || '"]' END AS enum,
                CASE WHEN term <> '' AND status = 'Confirmed' THEN {_ADDRESS} ELSE '' END AS term_address, position = 5 AS primary_key FROM dict""",
                dict=DICTIONARY_ROWS,
            ),
        ),
        "x04_star_export_round_trip": (
            _star,
            with_tables("SELECT 'core' AS source, custkey || '|' || name || '|' || segment AS row FROM c UNION ALL SELECT 'orders', orderkey || '|' || custkey || '|' || priority FROM o WHERE custkey <> ''", c=CUSTOMER, o=ORDERS),
        ),
        "x05_mapping_findings": (
            lambda s, d: X.mapping_findings(dictionary(s, d), _mapping(s, d), _targets(s, d)),
            with_tables(
                f"""SELECT "table", name, rule FROM (SELECT m."table", m.name, CASE WHEN m.target IS NULL THEN 'column not mapped' WHEN g.target IS NULL THEN 'target field unknown'
                WHEN m.status <> 'Confirmed' OR m.term = '' OR {_ADDRESS} <> g.address THEN 'term not confirmed for target' END AS rule FROM m LEFT JOIN g ON g.target_table = m.target_table AND g.target = m.target) WHERE rule IS NOT NULL
                UNION ALL SELECT "table", 't8', 'target used twice' FROM m WHERE target = 't8' GROUP BY "table" HAVING count(*) > 1
                UNION ALL SELECT min("table"), target_table, 'two tables share a target' FROM (SELECT DISTINCT "table", target_table FROM m WHERE target IS NOT NULL) GROUP BY target_table HAVING count(*) > 1""",
                dict=DICTIONARY_ROWS,
                m="""SELECT "table", name, status, term, 'target of ' || regexp_replace("table", 'table (1[0-9])$', 'table 10') AS target_table, CASE position WHEN 7 THEN NULL WHEN 9 THEN 't8' ELSE 't' || position END AS target FROM dict""",
                g="""SELECT 'target of ' || "table" AS target_table, 't' || position AS target, 'http://example.org/terms/' || position AS address FROM dict WHERE position <> 5""",
            ),
        ),
        "x05_mapped_projection": (
            lambda s, d: X.mapped_projection(load(s, d, CUSTOMER), {"custkey": "identifier", "name": "label", "nationkey": "countryCode", "segment": "category"}),
            with_tables('SELECT __source_record, custkey AS identifier, name AS label, nationkey AS "countryCode", segment AS category FROM c', c=CUSTOMER),
        ),
        "x06_checksum_manifest": (
            _checksums,
            with_tables(
                """SELECT part, CAST(octet_length(encode(body)) AS BIGINT) AS bytes, sha256(body) AS sha256 FROM (
                  SELECT lpad(CAST(__source_record // 500 AS VARCHAR), 9, '0') AS part,
                    'custkey,name,nationkey,segment' || chr(10) || string_agg(custkey || ',' || name || ',' || nationkey || ',' || segment, chr(10) ORDER BY __source_record) || chr(10) AS body FROM c GROUP BY ALL)""",
                c=CUSTOMER,
            ),
        ),
    }
