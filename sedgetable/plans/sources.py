"""Scans and sinks: driver tables are written as files in the shared folder and read back."""

from __future__ import annotations

import os
from urllib.parse import urlsplit

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from sedgetable.core import literalise
from sedgetable.operators import validation as V
from sedgetable.plans.inputs import CUSTOMER, ORDERS, PARTS, SURVEY, load, with_tables
from sedgetable.scale import shared_folder
from sedgetable.sources import manifest as M
from sedgetable.sources.dbase import dbase_scan
from sedgetable.sources.delimited import lenient_scan, strict_scan
from sedgetable.sources.fixed_width import fixed_width_scan
from sedgetable.sources.markup import xml_record_paths
from sedgetable.sources.numbering import number_frame, shape_report
from sedgetable.sources.sinks import write_baseline, write_csv
from sedgetable.sources.structured import geojson_scan, json_lines_scan, json_scan, json_tables, xml_scan


def _lines(df: DataFrame, spark: SparkSession, partitions: int = 3) -> str:
    """Write one text column as ordered files; the name of each part follows the record ranges."""
    folder = shared_folder(spark)
    df.repartitionByRange(partitions, "__source_record").sortWithinPartitions("__source_record").select("line").write.text(folder)
    return folder


def headed_lines(df: DataFrame, head: str, spark: SparkSession, records: int = 5000) -> str:
    """Write one text column as files of ``records`` records in order, each below the same header."""
    folder = shared_folder(spark)
    rows = df.select(F.lpad(F.floor(F.col("__source_record") / records).cast("string"), 9, "0").alias("part"), "__source_record", "line")
    heads = rows.select("part").distinct().select("part", F.lit(-1).cast("long").alias("__source_record"), F.lit(head).alias("line"))
    rows.unionByName(heads).repartition("part").sortWithinPartitions("part", "__source_record").select("part", "line").write.partitionBy("part").text(folder)
    return folder


def listed_documents(df: DataFrame, head: str, tail: str, spark: SparkSession, items: int = 50_000, between: str = ",") -> str:
    """Write items (``at`` from 0, ``line``) as documents of many lines: ``items`` of them between a head and a tail, by default with commas between."""
    folder = shared_folder(spark)
    part = F.lpad(F.floor(F.col("at") / items).cast("string"), 9, "0")
    line = F.when(F.col("at") % items == 0, F.col("line")).otherwise(F.concat(F.lit(between), F.col("line")))
    rows = df.select(part.alias("part"), "at", line.alias("line"))
    ends = rows.select("part").distinct().select("part", F.explode(F.array(F.struct(F.lit(-1).cast("bigint").alias("at"), F.lit(head).alias("line")), F.struct(F.lit(1 << 62).cast("bigint").alias("at"), F.lit(tail).alias("line")))).alias("end")).select("part", "end.*")
    rows.unionByName(ends).repartition("part").sortWithinPartitions("part", "at").select("part", "line").write.partitionBy("part").text(folder)
    return folder


def _written_survey(s, d):
    return write_csv(load(s, d, SURVEY), shared_folder(s))


def _strict(s, d):
    return strict_scan(s, _written_survey(s, d))


def _quoted_documents(s, d):
    """Whole texts with their quotes and line breaks as quoted cells, beside cells with quotes inside."""
    docs = load(s, d, "SELECT doc_id + 1 AS __source_record, doc_id, lang, text FROM {documents}")
    text = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", F.col("doc_id").cast("string"), F.concat(F.col("lang"), F.lit(' 5" pipe')), text)
    return strict_scan(s, headed_lines(docs.select("__source_record", line.alias("line")), "doc_id,mark,text", s))


def _ragged_lines(s, d):
    rows = load(s, d, ORDERS)
    text = F.when(F.col("__source_record") % 5 == 0, F.concat_ws(",", "orderkey", "custkey")).when(
        F.col("__source_record") % 5 == 1, F.concat(F.concat_ws(",", "orderkey", "custkey", "priority"), F.lit(',"a, ""b""",x'))
    ).otherwise(F.concat_ws(",", "orderkey", "custkey", "priority"))
    body = rows.select((F.col("__source_record")).alias("__source_record"), text.alias("line"))
    head = s.range(1).select(F.lit(0).cast("long").alias("__source_record"), F.lit("orderkey,custkey,custkey").alias("line"))
    return _lines(head.unionByName(body), s)


def _lenient(s, d):
    return lenient_scan(s, _ragged_lines(s, d), multi_line=False)


def _mixed_folder(s, d):
    """Small files of several kinds, each holding the customers of one nation group."""
    folder = shared_folder(s)
    base = load(s, d, CUSTOMER)
    kind = F.col("nationkey").cast("int") % 5
    good = F.concat_ws(",", "custkey", "name", "nationkey")
    line = F.when(kind == 1, F.concat_ws(";", "custkey", "name")).when(kind == 2, F.concat(good, F.lit(",extra"))).otherwise(good)
    rows = base.select(kind.alias("kind"), "__source_record", line.alias("line"))
    heads = s.range(5).select(F.col("id").cast("int").alias("kind"), F.lit(0).cast("long").alias("__source_record"), F.when(F.col("id") == 1, "custkey;name").otherwise("custkey,name,nationkey").alias("line"))
    both = rows.unionByName(heads)
    both.repartition("kind").sortWithinPartitions("kind", "__source_record").select("kind", "line").write.partitionBy("kind").text(folder)
    return folder


def _named(manifest: DataFrame) -> DataFrame:
    """Replace generated part names by the kind folder."""
    return manifest.withColumn("file", F.regexp_extract("file", "(kind=[0-9]+)", 1))


def _manifest(s, d):
    found = _named(M.source_manifest(s, _mixed_folder(s, d)).filter("not file rlike '(^|/)[._]'"))
    return found.select("file", "bytes", "crlf", "lf", "cr", "nul", F.length("sha256").alias("hash_length"))


def _duplicates(s, d):
    folder = shared_folder(s)
    rows = load(s, d, CUSTOMER).select((F.col("nationkey").cast("int") % 3).alias("kind"), "name").orderBy("kind", "name")
    for copy in ("a", "b"):
        rows.repartition(3, "kind").sortWithinPartitions("kind", "name").withColumnRenamed("name", "line").write.partitionBy("kind").text(os.path.join(folder, copy))
    return M.duplicate_sources(M.source_manifest(s, folder).filter("not file rlike '(^|/)[._]'")).groupBy("files").agg(F.count("*").alias("contents"), F.sum("surplus").alias("surplus"))


def _integrity(s, d):
    found = _named(M.source_manifest(s, _mixed_folder(s, d)).filter("not file rlike '(^|/)[._]'"))
    expected = found.filter("file <> 'kind=0'").select(
        "file", F.when(F.col("file") == "kind=1", F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"), F.when(F.col("file") == "kind=2", F.lit("00")).otherwise(F.col("sha256")).alias("sha256")
    )
    lost = found.filter("file = 'kind=3'").select(F.lit("kind=9").alias("file"), "bytes", "sha256")
    return M.verify_integrity(expected.unionByName(lost), found)


def _declared(s, d):
    """Declarations with a wrong size, a wrong hash, an old algorithm and an absent file."""
    found = _named(M.source_manifest(s, _mixed_folder(s, d)).filter("not file rlike '(^|/)[._]'"))
    sha = F.concat(F.lit("sha256:"), F.upper("sha256"))
    declared = found.select(
        "file",
        F.when(F.col("file") == "kind=1", F.col("bytes") + 1).when(F.col("file") != "kind=3", F.col("bytes")).alias("bytes"),
        F.when(F.col("file") == "kind=2", "sha256:00").when(F.col("file") == "kind=4", "d41d8cd98f00b204e9800998ecf8427e").otherwise(sha).alias("hash"),
    )
    lost = found.filter("file = 'kind=3'").select(F.lit("kind=9").alias("file"), "bytes", sha.alias("hash"))
    return V.resource_findings(declared.unionByName(lost), found)


def _probe(s, d):
    return _named(M.probe_files(s, _mixed_folder(s, d)).filter("not file rlike '(^|/)[._]'"))


def _quarantine_rows(s, d):
    rows, _ = M.load_with_quarantine(s, _mixed_folder(s, d), ["custkey", "name", "nationkey"], suffix=".txt")
    return rows.select("custkey", "name", "nationkey")


def _quarantine_manifest(s, d):
    _, files = M.load_with_quarantine(s, _mixed_folder(s, d), ["custkey", "name", "nationkey"], suffix=".txt")
    return _named(files.filter("not file rlike '(^|/)[._]'")).select("file", "reason")


def _headers(s, d, strict: bool = True):
    """Orders under a header with outer spaces, a blank and repeated names."""
    rows = load(s, d, ORDERS).select("__source_record", F.concat_ws(",", "orderkey", "custkey", "status", "priority").alias("line"))
    path = headed_lines(rows, " orderkey ,,custkey,custkey", s)
    return strict_scan(s, path, multi_line=False) if strict else lenient_scan(s, path, multi_line=False).drop("__row_width")


def _fixed(s, d):
    rows = load(s, d, CUSTOMER).select("__source_record", F.concat(F.lpad("custkey", 9, "0"), F.rpad("name", 30, " "), F.lpad("nationkey", 3, " ")).alias("line"))
    head = s.range(1).select(F.lit(0).cast("long").alias("__source_record"), F.concat(F.rpad(F.lit("custkey"), 9, "."), F.rpad(F.lit("name"), 30, "."), F.lit("nat")).alias("line"))
    return fixed_width_scan(s, _lines(head.unionByName(rows), s), [9, 30, 3])


def _json_documents(s, d):
    """Events as documents of up to 50,000 records, each an object with an array of records and a scalar member."""
    events = load(s, d, "SELECT event_id, user_id, event_type, props FROM {events}")
    record = F.struct("event_id", F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("user"), "event_type", F.struct(F.col("user_id").alias("id"), (F.col("event_id") % 2 == 0).alias("even")).alias("nested"))
    return listed_documents(events.select(F.col("event_id").alias("at"), F.to_json(record).alias("line")), '{"title":"x","events":[', "]}", s)


def _json(s, d):
    return json_scan(s, _json_documents(s, d), "events")


def _json_lines(s, d):
    events = load(s, d, "SELECT event_id, user_id, event_type, props FROM {events}")
    text = F.to_json(F.struct("event_id", F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("user"), "event_type", F.struct(F.col("user_id").alias("id")).alias("nested")))
    return json_lines_scan(s, _lines(events.select(F.col("event_id").alias("__source_record"), text.alias("line")), s))


def _geojson(s, d):
    rows = load(s, d, "SELECT c_custkey, c_name, c_nationkey FROM {customer}")
    feature = F.concat(F.lit('{"type":"Feature","id":'), F.col("c_custkey").cast("string"), F.lit(',"geometry":{"type":"Point","coordinates":['), F.col("c_nationkey").cast("string"), F.lit(',5]},"properties":{"name":"'), "c_name", F.lit('","nation":'), F.col("c_nationkey").cast("string"), F.lit("}}"))
    return geojson_scan(s, listed_documents(rows.select(F.col("c_custkey").alias("at"), feature.alias("line")), '{"type":"FeatureCollection","features":[', "]}", s))


XML_ITEMS = 1000


def _xml_folder(s, d):
    """Documents of a thousand customers with an attribute, an optional child and a remark that holds markup as text."""
    rows = load(s, d, CUSTOMER)
    plain = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    remark = F.concat(F.lit("<remark><![CDATA[<"), "segment", F.lit("> & more]]></remark>"))
    optional = F.when(F.col("custkey").cast("bigint") % 3 == 0, remark).otherwise("")
    line = F.concat(F.lit('<record id="'), "custkey", F.lit('>"><name>'), plain(F.col("name")), F.lit("</name>"), optional, F.lit("<!-- > --><segment>"), plain(F.col("segment")), F.lit("</segment></record>"))
    items = rows.select((F.col("__source_record") - 1).alias("at"), line.alias("line"))
    return listed_documents(items, "<survey><records>", "</records></survey>", s, XML_ITEMS, "")


def _xml(s, d):
    return xml_scan(s, _xml_folder(s, d), "/survey/records/record").drop("__source_record")


def _xml_paths(s, d):
    path = F.concat(F.lit("/"), F.array_join("path", "/"))
    return xml_record_paths(s, _xml_folder(s, d)).select(path.alias("path"), "records", F.array_join("attributes", ",").alias("attributes"), "files")


DBASE_KEYS = 100_000


def _dbase(s, d):
    """Binary tables of a nation's customers within a range of keys: 32-byte header, two field descriptors, fixed records."""
    rows = load(s, d, "SELECT c_custkey, c_name, c_nationkey FROM {customer}")
    byte = lambda c: F.unhex(F.lpad(F.hex(c), 2, "0"))
    little = lambda c, n: F.concat(*[byte(F.shiftright(c, 8 * i).bitwiseAND(F.lit(255).cast("long"))) for i in range(n)])
    zeros = lambda n: F.unhex(F.lit("00" * n))
    name = lambda text: F.concat(F.encode(F.lit(text), "UTF-8"), zeros(11 - len(text)))
    descriptor = lambda text, kind, length: F.concat(name(text), F.encode(F.lit(kind), "UTF-8"), zeros(4), byte(F.lit(length)), zeros(15))
    record = F.encode(F.concat(F.when(F.col("c_custkey") % 4 == 0, "*").otherwise(" "), F.lpad(F.col("c_custkey").cast("string"), 9, " "), F.rpad("c_name", 30, " ")), "UTF-8")
    grouped = rows.groupBy("c_nationkey", F.floor(F.col("c_custkey") / DBASE_KEYS).alias("part")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("c_custkey", F.hex(record).alias("r")))).alias("records"))
    data = F.unhex(F.array_join(F.transform("records", lambda x: x["r"]), ""))
    content = F.concat(
        F.unhex(F.lit("03190101")), little(F.col("n"), 4), little(F.lit(97).cast("long"), 2), little(F.lit(40).cast("long"), 2), zeros(20),
        descriptor("KEY", "N", 9), descriptor("NAME", "C", 30), F.unhex(F.lit("0D")), data,
    )
    folder = shared_folder(s)
    # A text writer keeps bytes only where they are valid text, so files are made by the tasks themselves.
    grouped.select(F.concat_ws("-", "c_nationkey", "part").alias("name"), content.alias("content")).foreachPartition(_binary_writer(folder))
    return dbase_scan(s, folder)


def _binary_writer(folder: str):
    def write(rows) -> None:
        store, base = fs.FileSystem.from_uri(folder) if urlsplit(folder).scheme else (fs.LocalFileSystem(), folder)
        store.create_dir(base, recursive=True)
        for row in rows:
            with store.open_output_stream(f"{base}/{row['name']}.dbf") as out:
                out.write(bytes(row["content"]))

    return write


def _shape(s, d):
    return shape_report(s.read.parquet(write_baseline(_strict(s, d), shared_folder(s))))


def _numbered(s, d):
    """Number line items by an explicit order; the numbers are 1..n."""
    df = load(s, d, "SELECT CAST(l_orderkey AS STRING) AS orderkey, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM {lineitem}")
    numbered = number_frame(df, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return numbered.select("__source_record", "orderkey")


def _literal(s, d):
    return literalise(load(s, d, "SELECT CAST(event_id + 1 AS BIGINT) AS __source_record, event_id, user_id, event_type, event_id % 2 = 0 AS even, CASE WHEN event_id % 5 = 0 THEN NULL ELSE props END AS props FROM {events}"))


def entries():
    survey = with_tables("SELECT * FROM t", t=SURVEY)
    width = "CASE __source_record % 5 WHEN 0 THEN 2 WHEN 1 THEN 5 ELSE 3 END"
    kind = "CAST(nationkey AS INT) % 5"
    headline = "CASE k WHEN 1 THEN 'custkey;name' ELSE 'custkey,name,nationkey' END"
    body = "CASE k WHEN 1 THEN custkey || ';' || name WHEN 2 THEN custkey || ',' || name || ',' || nationkey || ',extra' ELSE custkey || ',' || name || ',' || nationkey END"
    files = f"""SELECT k, sum(octet_length(encode(line)) + 1) AS bytes, count(*) AS n FROM (SELECT k, {body} AS line FROM (SELECT *, {kind} AS k FROM c) UNION ALL SELECT k, {headline} FROM range(5) r(k)) GROUP BY k"""
    return {
        "src00_literal_values": (
            _literal,
            """SELECT CAST(event_id + 1 AS BIGINT) AS __source_record, CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, event_type, CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS even,
            CASE WHEN event_id % 5 = 0 THEN '' ELSE coalesce(props, '') END AS props FROM events""",
        ),
        "src01_strict_delimited_scan": (_strict, survey),
        "src01_quoted_documents": (
            _quoted_documents,
            """SELECT row_number() OVER (ORDER BY doc_id) AS __source_record, CAST(doc_id AS VARCHAR) AS doc_id, lang || ' 5" pipe' AS mark, text FROM documents""",
        ),
        "src02_lenient_delimited_scan": (
            _lenient,
            with_tables(
                f"""SELECT __source_record, {width} AS __row_width, orderkey, custkey, CASE WHEN {width} = 2 THEN '' ELSE priority END AS custkey_2, CASE WHEN {width} = 5 THEN 'a, "b"' ELSE '' END AS column_4, CASE WHEN {width} = 5 THEN 'x' ELSE '' END AS column_5 FROM o""",
                o=ORDERS,
            ),
        ),
        "src03_file_probe": (
            _probe,
            with_tables("SELECT 'kind=' || k AS file, 'utf-8' AS encoding, CASE WHEN k = 1 THEN ';' ELSE ',' END AS delimiter, true AS loadable, CASE WHEN k = 2 THEN 'delimiter uncertain' ELSE '' END AS notes FROM range(5) r(k) WHERE (SELECT count(*) FROM c) > 0", c=CUSTOMER),
        ),
        "src04_unique_headers": (_headers, with_tables("SELECT __source_record, orderkey, custkey AS column_2, status AS custkey, priority AS custkey_2 FROM o", o=ORDERS)),
        "src04_unstripped_headers": (
            lambda s, d: _headers(s, d, strict=False),
            with_tables('SELECT __source_record, orderkey AS " orderkey ", custkey AS column_2, status AS custkey, priority AS custkey_2 FROM o', o=ORDERS),
        ),
        "src05_fixed_width_scan": (
            _fixed,
            with_tables("""SELECT __source_record, lpad(custkey, 9, '0') AS "custkey..", rpad(name, 30, ' ') AS "name..........................", lpad(nationkey, 3, ' ') AS nat FROM c""", c=CUSTOMER),
        ),
        "src06_json_records_scan": (
            _json,
            """SELECT CAST(event_id + 1 AS BIGINT) AS __source_record, CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_id % 3 <> 0 THEN CAST(user_id AS VARCHAR) ELSE '' END AS "user", event_type,
            '{"id":' || user_id || ',"even":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || '}' AS nested FROM events""",
        ),
        "src06_json_tables": (lambda s, d: json_tables(s, _json_documents(s, d)), """SELECT 'events' AS "table", count(*) AS records FROM events UNION ALL SELECT 'title', 0"""),
        "src06_json_lines_scan": (
            _json_lines,
            """SELECT CAST(event_id + 1 AS BIGINT) AS __source_record, CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_id % 3 <> 0 THEN CAST(user_id AS VARCHAR) ELSE '' END AS "user", event_type, '{"id":' || user_id || '}' AS nested FROM events""",
        ),
        "src07_geojson_scan": (
            _geojson,
            """SELECT CAST(c_custkey + 1 AS BIGINT) AS __source_record, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation, CAST(c_custkey AS VARCHAR) AS _feature_id, '{"type":"Point","coordinates":[' || c_nationkey || ',5]}' AS _geometry_json FROM customer""",
        ),
        "src08_xml_scan": (
            _xml,
            with_tables("""SELECT custkey || '>' AS "@id", name, CASE WHEN CAST(custkey AS BIGINT) % 3 = 0 THEN '<' || segment || '> & more' ELSE '' END AS remark, segment FROM c""", c=CUSTOMER),
        ),
        "src08_xml_record_paths": (
            _xml_paths,
            with_tables(
                f"""SELECT path, CAST(sum(n) AS BIGINT) AS records, max(attributes) AS attributes, count(*) FILTER (n > 0) AS files FROM (
                    SELECT unnest(['/survey', '/survey/records', '/survey/records/record', '/survey/records/record/name', '/survey/records/record/remark', '/survey/records/record/segment']) AS path,
                        unnest(['', '', 'id', '', '', '']) AS attributes, unnest([1, 1, r, r, k, r]) AS n
                    FROM (SELECT (__source_record - 1) // {XML_ITEMS} AS doc, count(*) AS r, count(*) FILTER (CAST(custkey AS BIGINT) % 3 = 0) AS k FROM c GROUP BY 1)
                ) GROUP BY path""",
                c=CUSTOMER,
            ),
        ),
        "src09_fixed_record_binary_scan": (
            lambda s, d: _dbase(s, d).drop("__source_record"),
            """SELECT lpad(CAST(c_custkey AS VARCHAR), 9, ' ') AS "KEY", c_name AS "NAME", CASE WHEN c_custkey % 4 = 0 THEN 'true' ELSE 'false' END AS _dbf_deleted FROM customer""",
        ),
        "src10_source_manifest": (
            _manifest,
            with_tables(f"SELECT 'kind=' || k AS file, CAST(bytes AS BIGINT) AS bytes, 0 AS crlf, CAST(n AS INT) AS lf, 0 AS cr, 0 AS nul, 64 AS hash_length FROM ({files})", c=CUSTOMER),
        ),
        "src11_duplicate_sources": (_duplicates, "SELECT 2 AS files, count(DISTINCT c_nationkey % 3) AS contents, count(DISTINCT c_nationkey % 3) AS surplus FROM customer"),
        "src12_integrity_differences": (
            _integrity,
            "SELECT 'kind=0' AS file, 'unlisted file' AS status FROM (SELECT count(*) FROM customer) UNION ALL SELECT 'kind=1', 'byte length differs' UNION ALL SELECT 'kind=2', 'hash differs' UNION ALL SELECT 'kind=9', 'missing file'",
        ),
        "v12_declared_resources": (
            _declared,
            "SELECT 'kind=1' AS file, 'byte length differs' AS rule FROM (SELECT count(*) FROM customer) UNION ALL SELECT 'kind=2', 'hash differs' UNION ALL SELECT 'kind=4', 'checksum not supported' UNION ALL SELECT 'kind=9', 'absent resource'",
        ),
        "src13_ordered_csv_round_trip": (
            lambda s, d: strict_scan(s, write_csv(load(s, d, PARTS), shared_folder(s)), multi_line=False),
            with_tables("SELECT row_number() OVER (ORDER BY __source_record) AS __source_record, partkey, name, brand, size FROM a", a=PARTS),
        ),
        "src14_record_numbers": (
            _numbered,
            "SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS __source_record, CAST(l_orderkey AS VARCHAR) AS orderkey FROM lineitem",
        ),
        "src15_shape_report": (_shape, with_tables("SELECT count(*) AS records, 1 AS lowest, count(*) AS highest, count(*) AS distinct_numbers, true AS contiguous FROM t", t=SURVEY)),
        "src16_quarantine_rows": (_quarantine_rows, with_tables(f"SELECT custkey, name, nationkey FROM c WHERE {kind} IN (0, 3, 4)", c=CUSTOMER)),
        "src16_quarantine_manifest": (
            _quarantine_manifest,
            """SELECT 'kind=0' AS file, NULL AS reason FROM (SELECT count(*) FROM customer) UNION ALL SELECT 'kind=1', 'header differs' UNION ALL SELECT 'kind=2', 'a record has another width than the header' UNION ALL SELECT 'kind=3', NULL UNION ALL SELECT 'kind=4', NULL""",
        ),
    }
