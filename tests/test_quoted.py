import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from sedgetable.core import SRC, TableError, WIDTH
from sedgetable.sources.delimited import lenient_scan, strict_scan
from sedgetable.sources.quoted import Quotes
from test_sources import put, rows


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("multi_line", [True, False])
@pytest.mark.parametrize("line,cells", [('2,a"b,c"d', ("2", 'a"b', 'c"d')), ('1,5" pipe,x', ("1", '5" pipe', "x")), ('3, "x",""', ("3", ' "x"', "")), ('4,"a,""b""","c"', ("4", 'a,"b"', "c"))])
def test_a_quote_counts_only_at_the_start_of_a_cell(spark, tmp_path, multi_line, line, cells):
    path = put(tmp_path, "a.csv", f"id,note,more\n{line}\n")
    assert rows(strict_scan(spark, path, multi_line=multi_line)) == [(1, *cells)]
    assert rows(lenient_scan(spark, path, multi_line=multi_line)) == [(1, 3, *cells)]


@pytest.mark.parametrize("multi_line", [True, False])
@pytest.mark.parametrize("encoding", ["utf-8", "latin-1", "cp1252"])
@pytest.mark.parametrize("text", ['id,name\n1,"open\n2,b\n', "id,name\n1,a\n\n2,b\n", 'id,name\n1,"a"b\n', "id,name\n1,a,b\n", "id,name\n1\n"])
def test_strict_checks_hold_in_every_encoding(spark, tmp_path, multi_line, encoding, text):
    with pytest.raises(TableError):
        strict_scan(spark, put(tmp_path, "a.csv", text.encode(encoding)), encoding, multi_line=multi_line)


def test_bytes_outside_the_encoding_and_other_headers(spark, tmp_path):
    for data, encoding in ((b"id\n\xff\n", "utf-8"), (b"id\n\x81\n", "cp1252")):
        with pytest.raises(TableError):
            strict_scan(spark, put(tmp_path, "a.csv", data), encoding)
    put(tmp_path, "a.csv", 'id,"no\nte"\n1,x\n')
    put(tmp_path, "b.csv", 'id,"no\nte"\n2,y\n')
    assert rows(strict_scan(spark, str(tmp_path))) == [(1, "1", "x"), (2, "2", "y")]
    put(tmp_path, "c.csv", "id,note\n2,y\n")
    with pytest.raises(TableError):
        strict_scan(spark, str(tmp_path))


def messy(n, seed, end):
    rnd = random.Random(seed)
    table = []
    for k in range(n):
        cells = [str(k)]
        for _ in range(3):
            kind = rnd.random()
            if kind < 0.3:
                cells.append(rnd.choice(["", "x", "é語", 'in"ner', '5" pipe', " lead"]))
            elif kind < 0.9:
                cells.append("".join(rnd.choice(["a", '"', ",", "\n", "\r\n", "\r", "é", "\n\n"]) for _ in range(rnd.randrange(12))))
            else:
                cells.append("long\n" * rnd.randrange(300))
        table.append(cells)
    quoted = lambda c: '"' + c.replace('"', '""') + '"' if not c or any(x in c for x in ',\n\r') or c.startswith('"') else c
    return "id,a,b,c" + end + "".join(",".join(map(quoted, cells)) + end for cells in table), table


@pytest.mark.parametrize("seed,end", [(1, "\n"), (2, "\r\n"), (3, "\r")])
def test_one_quoted_file_is_read_by_many_tasks(spark, tmp_path, small_splits, seed, end):
    text, table = messy(150, seed, end)
    assert list(csv.reader(io.StringIO(text, newline=""), strict=True))[1:] == table
    path = put(tmp_path, "a.csv", "﻿" + text)
    df = strict_scan(spark, path)
    assert rows(df) == [(k, *cells) for k, cells in enumerate(table, 1)]
    assert spark.read.text(path, lineSep="\n").rdd.getNumPartitions() > 5
    wide = put(tmp_path, "b.csv", text + f'9,"far\n{"x" * 20000}\n",3,4,5{end}')
    with pytest.raises(TableError, match="width"):
        strict_scan(spark, wide)
    ragged = lenient_scan(spark, wide)
    assert ragged.agg(F.max(WIDTH)).first()[0] == 5 and ragged.count() == 151
    assert ragged.filter(F.col(SRC) == 151).first()["column_5"] == "5"
    with pytest.raises(TableError, match="never closed"):
        strict_scan(spark, put(tmp_path, "c.csv", text + f'9,"far{end}1,2,3,4{end}'))


def test_several_split_files_are_numbered_in_order(spark, tmp_path, small_splits):
    tables = []
    for f in range(3):
        text, table = messy(40, f, "\n")
        put(tmp_path, f"p{f}.csv", text)
        tables += table
    assert rows(strict_scan(spark, str(tmp_path))) == [(k, *cells) for k, cells in enumerate(tables, 1)]
    assert [r[2:] for r in rows(lenient_scan(spark, str(tmp_path)))] == [tuple(c) for c in tables]


def test_both_start_states():
    quotes = Quotes(",")
    for text in ('a,"b\nc",d\n', 'x"y,z\n', '"a""b",c\nd,"e', 'b",c\n"d"\n', '""\n', 'a""b",""\n'):
        for inside in (False, True):
            state, runs, at = ("in" if inside else "start"), [], 0
            for k, ch in enumerate(text):  # one character at a time
                if state == "start" and ch == '"':
                    state = "in"
                elif state == "in" and ch == '"':
                    state = "quote"
                elif state == "quote" and ch == '"':
                    state = "in"
                elif state in ("start", "field", "quote"):
                    state = "start" if ch in ",\n" else "field"
                runs.append(state)
            assert quotes.cut(text.encode(), inside)[3] == (runs[-1] == "in")
