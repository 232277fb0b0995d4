import os
import struct
import time

import pytest
from pyspark.sql import functions as F

from sedgetable.core import SRC, TableError, WIDTH
from sedgetable.plans import sources
from sedgetable.sources import manifest as M
from sedgetable.sources.dbase import dbase_scan
from sedgetable.sources.delimited import lenient_scan, strict_scan
from sedgetable.sources.fixed_width import fixed_width_scan
from sedgetable.sources.headers import unique_headers
from sedgetable.sources.numbering import guard_shape
from sedgetable.sources.sinks import checksum_manifest, write_baseline, write_csv
from sedgetable.sources.structured import geojson_scan, json_scan, json_tables, xml_scan


def rows(df):
    return [tuple(r) for r in df.orderBy(SRC).collect()]


def put(folder, name, data):
    path = os.path.join(folder, name)
    with open(path, "wb") as out:
        out.write(data if isinstance(data, bytes) else data.encode())
    return path


@pytest.mark.parametrize("multi_line", [True, False])
def test_strict_scan(spark, tmp_path, multi_line):
    path = put(tmp_path, "a.csv", ' id ,note,,note\n001,"a, ""b""",,\n , x ,NA,0\n')
    df = strict_scan(spark, path, multi_line=multi_line)
    assert df.columns[1:] == ["id", "note", "column_3", "note_2"]
    assert rows(df) == [(1, "001", 'a, "b"', "", ""), (2, " ", " x ", "NA", "0")]


@pytest.mark.parametrize("multi_line", [True, False])
@pytest.mark.parametrize("data", [b"id,name\n1\n2,b\n", b"id,name\n1,a,b\n", b"id,name\n1,\xff\n", b'id,name\n1,"open\n'])
def test_strict_scan_refuses_damage(spark, tmp_path, multi_line, data):
    with pytest.raises(TableError):
        strict_scan(spark, put(tmp_path, "a.csv", data), multi_line=multi_line)


def test_strict_scan_reads_quoted_line_breaks_and_encodings(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'id;note\n1;"café\nbar"\n'.encode("cp1252"))
    assert rows(strict_scan(spark, path, "cp1252", ";")) == [(1, "1", "café\nbar")]
    path = put(tmp_path, "b.csv", "id,note\n1,café\n".encode("cp1252"))
    assert rows(strict_scan(spark, path, "cp1252", multi_line=False)) == [(1, "1", "café")]
    path = put(tmp_path, "c.csv", "id,note\n1,café\n".encode("utf-16"))
    assert rows(strict_scan(spark, path, "utf-16", multi_line=False)) == [(1, "1", "café")]
    path = put(tmp_path, "d.csv", "id,note\n1,x\n".encode("utf-8-sig"))
    assert strict_scan(spark, path, "utf-8-sig", multi_line=False).columns == [SRC, "id", "note"]


@pytest.mark.parametrize("multi_line", [True, False])
def test_numbers_follow_files_and_lines(spark, tmp_path, multi_line):
    for f in range(3):
        put(tmp_path, f"p{f}.csv", "id\n" + "".join(f"{f}-{i}\n" for i in range(50)))
    df = strict_scan(spark, str(tmp_path), multi_line=multi_line)
    assert [r[1] for r in rows(df)] == [f"{f}-{i}" for f in range(3) for i in range(50)]
    assert [r[0] for r in rows(df)] == list(range(1, 151))


def test_numbers_hold_over_split_files(spark, tmp_path):
    path = put(tmp_path, "big.csv", "id,n\n" + "".join(f"{i},x\n" for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = strict_scan(spark, path, multi_line=False)
        assert df.rdd.getNumPartitions() > 3
        assert df.filter(F.col(SRC) != F.col("id").cast("long") + 1).count() == 0
        guard_shape(df, 20000)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("multi_line", [True, False])
def test_lenient_scan(spark, tmp_path, multi_line):
    path = put(tmp_path, "a.csv", 'skip\nid,notes\n1\n2,"x,y",z\n3,\n')
    df = lenient_scan(spark, path, header_row=2, multi_line=multi_line)
    assert df.columns == [SRC, WIDTH, "id", "notes", "column_3"]
    assert rows(df) == [(1, 1, "1", "", ""), (2, 3, "2", "x,y", "z"), (3, 2, "3", "", "")]


def test_headers():
    assert unique_headers([" a", "a", "", None]) == ["a", "a_2", "column_3", "column_4"]
    assert unique_headers([" a", "a"], strip=False, width=3) == [" a", "a", "column_3"]


def test_fixed_width(spark, tmp_path):
    path = put(tmp_path, "a.fwf", "002   1\r\n001NA 0\r\n")
    assert rows(fixed_width_scan(spark, path, [3, 3, 1], header_row=0)) == [(1, "002", "   ", "1"), (2, "001", "NA ", "0")]
    assert fixed_width_scan(spark, path, [3, 3, 1]).columns == [SRC, "002", "   ", "1"]
    with pytest.raises(TableError):
        fixed_width_scan(spark, path, [3, 3])
    path = put(tmp_path, "b.fwf", "aéb\n".encode("utf-16"))
    assert rows(fixed_width_scan(spark, path, [1, 1, 1], "utf-16", 0)) == [(1, "a", "é", "b")]


def test_json(spark, tmp_path):
    path = put(tmp_path, "a.json", '[{"b":1,"a":null},{"a":{"x":[1,true]},"c":false}]')
    df = json_scan(spark, path)
    assert df.columns == [SRC, "b", "a", "c"]
    assert rows(df) == [(1, "1", "", ""), (2, "", '{"x":[1,true]}', "false")]
    path = put(tmp_path, "b.json", '{"t":"x","one":[{"a":1.50}],"none":[]}')
    assert rows(json_scan(spark, path, "one")) == [(1, "1.5")]
    assert json_tables(spark, path).filter("`table` = 'one'").first().records == 1


def test_geojson(spark, tmp_path):
    path = put(tmp_path, "a.geojson", '{"type":"FeatureCollection","features":[{"type":"Feature","id":7,"properties":{"site":"A"},"geometry":{"type":"Point","coordinates":[1,2]}}]}')
    assert rows(geojson_scan(spark, path)) == [(1, "A", "7", '{"type":"Point","coordinates":[1,2]}')]
    path = put(tmp_path, "b.geojson", '{"type":"Feature","features":[]}')
    with pytest.raises(TableError):
        geojson_scan(spark, path)


def test_xml(spark, tmp_path):
    path = put(tmp_path, "a.xml", '<r><rec id="1"><n> x </n><m/></rec><rec id="2"><n>y</n></rec></r>')
    df = xml_scan(spark, path, "rec")
    assert {(r["@id"], r["n"]) for r in df.collect()} == {("1", " x "), ("2", "y")}
    path = put(tmp_path, "b.xml", "<r><rec><n><q>1</q></n></rec></r>")
    with pytest.raises(TableError):
        xml_scan(spark, path, "rec")


def test_dbase(spark, tmp_path):
    fields = [("SITE", b"C", 4), ("N", b"N", 3), ("MEMO", b"M", 2)]
    header = 32 + 32 * len(fields) + 1
    size = 1 + sum(f[2] for f in fields)
    data = struct.pack("<B3sIHH20s", 3, b"\0\0\0", 2, header, size, b"\0" * 20)
    data += b"".join(n.encode().ljust(11, b"\0") + k + b"\0" * 4 + bytes([length, 0]) + b"\0" * 14 for n, k, length in fields) + b"\r"
    data += b" caf\xe9  1\x01\x02" + b"*B     0\xff\x00"
    put(tmp_path, "a.dbf", data)
    assert rows(dbase_scan(spark, str(tmp_path))) == [(1, "café", "  1", "hex:0102", "false"), (2, "B", "  0", "hex:ff00", "true")]
    put(tmp_path, "a.dbf", data[:-5])
    with pytest.raises(TableError):
        dbase_scan(spark, str(tmp_path))


def test_dbase_time_grows_with_the_records(spark, tmp_path):
    n, size = 120_000, 40
    head = struct.pack("<B3sIHH20s", 3, b"\0\0\0", n, 65, size, b"\0" * 20) + b"KEY".ljust(11, b"\0") + b"N" + b"\0" * 4 + bytes([39]) + b"\0" * 15 + b"\r"
    put(tmp_path, "a.dbf", head + b"".join(b"%s%39d" % (b"*" if k % 3 == 0 else b" ", k) for k in range(n)) + b"\x1a")
    put(tmp_path, "b.dbf", head.replace(struct.pack("<I", n), struct.pack("<I", 1), 1) + b" %39d" % 7)
    start = time.perf_counter()
    found = dbase_scan(spark, str(tmp_path)).select("__source_record", F.trim("KEY").cast("int").alias("k"), "_dbf_deleted")
    told = found.agg(F.count("*"), F.count_if(F.expr("k = __source_record - 1 and (k % 3 = 0) = (_dbf_deleted = 'true')")), F.max_by("k", "__source_record")).first()
    assert tuple(told) == (n + 1, n, 7)
    assert time.perf_counter() - start < 60


def test_dbase_tables_are_bounded_by_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sources, "DBASE_KEYS", 100)
    files = []
    monkeypatch.setattr(sources, "dbase_scan", lambda s, folder: files.extend(os.listdir(folder)) or dbase_scan(s, folder))
    found = sources._dbase(spark, "/root/testdata/sf0.001")
    customers = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    assert found.count() == customers.count()
    assert sum(f.endswith(".dbf") for f in files) == customers.selectExpr("c_nationkey", "c_custkey div 100").distinct().count()



def test_manifest_probe_and_integrity(spark, tmp_path):
    put(tmp_path, "a.csv", b"x\r\ny\nz\r\0")
    put(tmp_path, "b.csv", "a;b\n1;2\n".encode("cp1252") + b"\xe9;x\n")
    put(tmp_path, "c.csv", "a\tb\n1\n".encode("utf-16"))
    put(tmp_path, "d.csv", "a\tb\n1\n".encode("utf-8-sig"))
    found = M.source_manifest(spark, str(tmp_path))
    a = found.filter("file = 'a.csv'").first()
    assert (a.bytes, a.crlf, a.lf, a.cr, a.nul) == (8, 1, 1, 1, 1)
    probe = {r.file: (r.encoding, r.delimiter, r.loadable, r.notes) for r in M.probe_files(spark, str(tmp_path)).collect()}
    assert probe["a.csv"][2] is False
    assert probe["b.csv"] == ("cp1252", ";", True, "not valid UTF-8")
    assert probe["c.csv"] == ("utf-16", "\t", True, "delimiter uncertain")
    assert probe["d.csv"][:2] == ("utf-8-sig", "\t")
    assert M.verify_integrity(found, found).count() == 0
    assert M.duplicate_sources(found).count() == 0


def test_ordered_sink_round_trip(spark, tmp_path, table):
    df = table(["a", "b"], [(" x ", 'q"u,o'), ("", "line\nbreak"), ("NA", "0")] * 20, 5)
    path = write_csv(df, str(tmp_path / "out"))
    back = strict_scan(spark, path)
    assert rows(back) == rows(df)
    assert checksum_manifest(spark, path).filter("length(sha256) <> 64").count() == 0
    lone = table(["a"], [("x",), ("",), ("y",)])
    assert rows(strict_scan(spark, write_csv(lone, str(tmp_path / "lone")))) == rows(lone)
    guard_shape(spark.read.parquet(write_baseline(df, str(tmp_path / "base"))), 60)
    with pytest.raises(TableError):
        guard_shape(df.filter(f"{SRC} <> 3"))


def test_quarantine(spark, tmp_path):
    put(tmp_path, "a.csv", "id,n\n1,x\n2,y\n")
    put(tmp_path, "b.csv", "id,n\n3\n")
    put(tmp_path, "c.csv", "id,m\n4,z\n")
    put(tmp_path, "d.bin", b"\0\1")
    table, files = M.load_with_quarantine(spark, str(tmp_path), ["id", "n"])
    assert sorted(tuple(r) for r in table.collect()) == [("a.csv", 1, "1", "x"), ("a.csv", 2, "2", "y")]
    reasons = {r.file: r.reason for r in files.collect()}
    assert reasons == {"a.csv": None, "b.csv": "a record has another width than the header", "c.csv": "header differs", "d.bin": "no tabular adapter for this suffix"}


@pytest.mark.parametrize("multi_line", [True, False])
def test_long_quoted_cell(spark, tmp_path, multi_line):
    cell = 'x "" y,' * 150_000
    path = put(tmp_path, "a.csv", f'id,note\n1,"{cell}"\n2,z\n')
    assert [(r[1], len(r[2])) for r in rows(strict_scan(spark, path, multi_line=multi_line))] == [("1", 6 * 150_000), ("2", 1)]
    lenient = lenient_scan(spark, path, multi_line=multi_line)
    assert [r[1] for r in rows(lenient)] == [2, 2]
    assert M.probe_files(spark, str(tmp_path)).first()["delimiter"] == ","


@pytest.mark.parametrize("multi_line", [True, False])
def test_strict_scan_refuses_other_headers_and_blank_lines(spark, tmp_path, multi_line):
    folder = tmp_path / "two"
    folder.mkdir()
    put(folder, "a.csv", "id,name\n1,a\n")
    put(folder, "b.csv", "id,name\n2,b\n")
    assert [r[1] for r in rows(strict_scan(spark, str(folder), multi_line=multi_line))] == ["1", "2"]
    put(folder, "b.csv", "name,id\nb,2\n")
    with pytest.raises(TableError, match="header"):
        strict_scan(spark, str(folder), multi_line=multi_line)
    path = put(tmp_path, "blank.csv", "id,name\n1,a\n\n2,b\n")
    with pytest.raises(TableError, match="width"):
        strict_scan(spark, path, multi_line=multi_line)


@pytest.mark.parametrize("multi_line", [True, False])
def test_lenient_scan_drops_repeated_headers(spark, tmp_path, multi_line):
    folder = tmp_path / "parts"
    folder.mkdir()
    for name, body in (("a.csv", "id,n\n1,x\n"), ("b.csv", "id,n\n2,y\n3\n")):
        put(folder, name, body)
    assert [(r[0], r[2]) for r in rows(lenient_scan(spark, str(folder), multi_line=multi_line))] == [(1, "1"), (2, "2"), (3, "3")]
    put(folder, "c.csv", "4,z\n")
    with pytest.raises(TableError, match="repeat"):
        lenient_scan(spark, str(folder), multi_line=multi_line)
    path = put(tmp_path, "bad.csv", b"id,n\n1,\xff\n")
    with pytest.raises(TableError, match="not valid"):
        lenient_scan(spark, path, multi_line=multi_line)


def test_fixed_width_checks_bytes_and_repeated_headers(spark, tmp_path):
    folder = tmp_path / "fixed"
    folder.mkdir()
    put(folder, "a.fwf", "idn\n01a\n")
    put(folder, "b.fwf", "idn\n02b\n")
    assert rows(fixed_width_scan(spark, str(folder), [2, 1])) == [(1, "01", "a"), (2, "02", "b")]
    with pytest.raises(TableError, match="not valid"):
        fixed_width_scan(spark, put(tmp_path, "bad.fwf", b"idn\n01\xff\n"), [2, 1])


def test_wide_tables(spark, tmp_path):
    names = ",".join(f"c{i}" for i in range(400))
    path = put(tmp_path, "wide.csv", f"{names}\n{','.join('x' * 400)}\n")
    assert len(strict_scan(spark, path).columns) == 401
    assert len(lenient_scan(spark, path).columns) == 402


def test_pages_of_a_table_with_gaps(table):
    from sedgetable.operators.search import page, sorted_positions

    df = table(["id"], [["a10"], ["x"], ["a9"], ["x"], ["a1"]]).filter("id <> 'x'")
    assert [r["id"] for r in page(df, 0, 2).collect()] == ["a10", "a9"]
    assert [r["id"] for r in page(df, 2, 2).collect()] == ["a1"]
    assert [r["id"] for r in page(df, 1, 5, "A").collect()] == ["a9", "a1"]
    assert {r["id"]: r["position"] for r in sorted_positions(df, "id").collect()} == {"a1": 1, "a9": 2, "a10": 3}


def test_long_radix_numbers(one):
    from sedgetable.functions.numbers import script_number_or_null

    values = ["0x1F", "0x" + "f" * 20, "0b" + "1" * 60, "0o777", "0xg", "0x"]
    assert one(values, script_number_or_null) == [31.0, float(16**20), float(2**60), 511.0, None, None]


def test_findings_without_fields_are_empty(table):
    from sedgetable.operators.validation import temporal_findings, unique_findings

    df = table(["id"], [["a"], ["a"]])
    assert unique_findings(df, {"fields": [{"name": "id"}]}).count() == 0
    assert temporal_findings(df, {"fields": [{"name": "id"}]}).count() == 0


def test_date_time_directives(one):
    from sedgetable.operators.validation import moment

    def at(text, fmt):
        r = one([text], lambda c: moment(c, fmt))[0]
        return None if r is None else r["at"] // 1_000_000

    assert at("05 Feb 21", "%d %b %y") == at("2021-02-05", None)
    assert at("Friday, March 05 1999 12:30 am", "%A, %B %d %Y %I:%M %p") == at("1999-03-05T00:30:00", None)
    assert at("2020/366", "%Y/%j") == at("2020-12-31", None) and at("2021/366", "%Y/%j") is None
    assert at("13 PM", "%I %p") is None and at("1 Xxx", "%d %b") is None
    with pytest.raises(TableError, match="unknown"):
        moment(F.lit("x"), "%Q")
