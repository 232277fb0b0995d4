"""XML by exact path: order, names, refusals, and documents over many splits."""

import pytest

from sedgetable.core import SRC, TableError
from sedgetable.sources.markup import xml_record_paths
from sedgetable.sources.structured import xml_scan


def put(folder, name, data):
    (folder / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(folder)


def rows(df):
    return [tuple(r) for r in df.orderBy(SRC).collect()]


def test_columns_come_in_first_seen_order_and_values_stay_literal(spark, tmp_path):
    doc = '<?xml version="1.0"?>\n<r><x><z> 007 </z><a>1 &lt; 2<!-- > -->3</a></x><x k="a>b"><b><![CDATA[<i>]]></b><a/></x><y><x><q>other path</q></x></y></r>\n'
    df = xml_scan(spark, put(tmp_path, "a.xml", doc), "/r/x")
    assert df.columns == [SRC, "z", "a", "@k", "b"]
    assert rows(df) == [(1, " 007 ", "1 < 23", "", ""), (2, "", "", "a>b", "<i>")]
    assert rows(xml_scan(spark, str(tmp_path), ["r", "y", "x"])) == [(1, "other path")]
    with pytest.raises(TableError, match="several"):
        xml_scan(spark, str(tmp_path), "x")


def test_paths_attributes_and_namespaces(spark, tmp_path):
    put(tmp_path, "a.xml", '<r xmlns:n="http://n/1"><n:p n:a="1" b="2"/><n:p c="3"/><p>t</p></r>')
    put(tmp_path, "b.xml", b"\xef\xbb\xbf<r><p>u</p></r>\n")
    found = {tuple(r["path"]): (r["records"], r["attributes"], r["files"]) for r in xml_record_paths(spark, str(tmp_path)).collect()}
    assert found == {("r",): (2, [], 2), ("r", "{http://n/1}p"): (2, ["b", "c", "{http://n/1}a"], 1), ("r", "p"): (2, [], 2)}
    assert rows(xml_scan(spark, str(tmp_path), "p")) == [(1, "t"), (2, "u")]
    spaced = xml_scan(spark, str(tmp_path), ["r", "{http://n/1}p"])
    assert spaced.columns == [SRC, "@{http://n/1}a", "@b", "#text", "@c"]
    assert rows(spaced) == [(1, "1", "2", "", ""), (2, "", "", "", "3")]


@pytest.mark.parametrize(
    "doc",
    [
        "<r><x>mixed<a>1</a></x></r>",
        "<r><x><a>1</a>tail</x></r>",
        "<r><x><a>1</a><a>2</a></x></r>",
        "<r><x><a><b>1</b></a></x></r>",
        '<r><x><a k="1">1</a></x></r>',
        '<!DOCTYPE r [<!ENTITY e "v">]><r><x>&e;</x></r>',
        "<r><x>1</x>",
        "<r><x>1</y></r>",
        "<r/>",
        "<r><x><__source_record>1</__source_record></x></r>",
    ],
)
def test_what_is_no_flat_table_is_refused(spark, tmp_path, doc):
    with pytest.raises(TableError):
        xml_scan(spark, put(tmp_path, "a.xml", doc), "/r/x")


def test_a_document_over_many_splits_keeps_its_order(spark, tmp_path):
    n = 3000
    for name, code in (("a.xml", "utf-8-sig"), ("b.xml", "utf-16")):
        body = "".join(f'<x i="{i}>"><t>é > {"w" * (i % 50)}</t></x>\n' for i in range(n))
        put(tmp_path, name, f"<r>{body}</r>".encode(code))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = xml_scan(spark, str(tmp_path), "/r/x")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        want = [(f"{i}>", f"é > {'w' * (i % 50)}") for i in range(n)]
        assert [r[1:] for r in rows(df)] == want + want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
