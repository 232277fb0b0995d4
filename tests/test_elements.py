import json
import random

import pytest

from sedgetable.core import TableError
from sedgetable.sources.elements import Level
from sedgetable.sources.structured import geojson_scan, json_scan, json_tables
from test_sources import put, rows


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def records(n, seed):
    rnd = random.Random(seed)
    text = lambda: "".join(rnd.choice('a}{][":,\\é語\n') for _ in range(rnd.randrange(15)))
    return [{"id": k, "note": text(), "deep": {"x": [{"y": text()}, {}], "z": {}}, **({"long": "}" * 3000} if k % 40 == 7 else {})} for k in range(n)]


def literal(table):
    return [(k, str(r["id"]), r["note"], json.dumps(r["deep"], ensure_ascii=False, separators=(",", ":")), r.get("long", "")) for k, r in enumerate(table, 1)]


@pytest.mark.parametrize("indent", [None, 1])
def test_one_document_over_many_splits(spark, tmp_path, small_splits, indent):
    table = records(90, 1)
    path = put(tmp_path, "a.json", "﻿ " + json.dumps(table, indent=indent, ensure_ascii=False))
    assert rows(json_scan(spark, path)) == literal(table)
    assert spark.read.text(path, lineSep="}").rdd.getNumPartitions() > 5
    doc = {"title": "a}b", "one": table[:50], "obj": {"k": {"x": [{"q": 1}]}}, "none": [], "mixed": [{"a": 1}, 2], "nested": [[{"a": 1}]], "two": table[50:]}
    path = put(tmp_path, "b.json", json.dumps(doc, indent=indent))
    assert rows(json_scan(spark, path, "one")) == literal(table[:50])
    assert [r[1:] for r in rows(json_scan(spark, path, "two"))] == [r[1:] for r in literal(table[50:])]
    found = {r["table"]: r["records"] for r in json_tables(spark, path).collect()}
    assert found == {"title": 0, "one": 50, "obj": 0, "none": 0, "mixed": 0, "nested": 0, "two": 40}


def test_features_over_many_splits(spark, tmp_path, small_splits):
    def document(f):
        features = [{"type": "Feature", "id": k, "properties": {"name": f"s{k}}}{{"}, "geometry": {"type": "Point", "coordinates": [k, f]}} for k in range(60)]
        return {"features": features, "type": "FeatureCollection"}

    for f in range(2):
        put(tmp_path, f"{f}.geojson", json.dumps(document(f), indent=f or None))
    got = rows(geojson_scan(spark, str(tmp_path)))
    assert [(r[0], r[1], r[2], json.loads(r[3])["coordinates"]) for r in got] == [(60 * f + k + 1, f"s{k}}}{{", str(k), [k, f]) for f in range(2) for k in range(60)]


def test_every_mixed_array_of_a_batch_is_no_table(spark, tmp_path):
    path = put(tmp_path, "a.json", '{"a":[1,{"x":1}],"b":[{"y":2},"2"],"c":[{"z":3}],"d":[[],{"w":4}]}')
    assert {r["table"]: r["records"] for r in json_tables(spark, path).collect()} == {"a": 0, "b": 0, "c": 1, "d": 0}


def test_elements_are_cut_once_and_their_texts_are_not_shuffled(spark, tmp_path):
    found = json_scan(spark, put(tmp_path, "a.json", '{"a":[{"x":1},{"x":2}],"b":[{"x":3}]}'), "a")
    assert rows(found) == [(1, "1"), (2, "2")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("text", ['[{"a":1}', '{"a":[{"b":"x}]}', "7"])
def test_broken_documents_are_refused(spark, tmp_path, text):
    with pytest.raises(TableError):
        json_scan(spark, put(tmp_path, "a.json", text))


def test_levels():
    data = rb'{"a\\":[{"b":"}\""},1],"c":"x"}'
    level = Level(data, False, 0)
    assert level.end == 0 and not level.ends_inside
    assert [(n, v[:1]) for _, n, v in level.members()] == [("a\\", "["), ("c", '"')]
    assert data[level.plain(2)[0] :][:1] == b"1" and len(level.plain(2)) == 1
    assert Level(b'x}","y":{', True, 1).end == 2
