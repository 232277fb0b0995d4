"""Strict and lenient delimited scans.

``multi_line=True`` reads quoted line breaks; splits of a file are read side by side
(:mod:`sedgetable.sources.quoted`). ``multi_line=False`` is for files whose records are
single lines, which are checked as recorded and parsed in generated code.
"""

from __future__ import annotations

import re
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sedgetable.core import SRC, TableError, WIDTH
from sedgetable.scale import shared_folder
from sedgetable.sources.headers import unique_headers
from sedgetable.sources.numbering import BLOCK, FILE, LINE, number_records, with_position
from sedgetable.sources.quoted import Quoted

DELIMITERS = (",", ";", "\t", "|")
# Encoding labels and the charset that reads them.
CHARSETS = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "utf-16": "UTF-16", "cp1252": "windows-1252", "latin-1": "ISO-8859-1"}
RAW = "__raw"


def check_format(spark: SparkSession, encoding: str, delimiter: str = ",") -> None:
    if encoding not in CHARSETS or delimiter not in DELIMITERS:
        raise TableError("unsupported encoding or delimiter")
    if encoding == "cp1252":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def text_lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """Decoded lines with their position. UTF-16 files are decoded whole, others split by bytes."""
    check_format(spark, encoding)
    if encoding == "utf-16":
        whole = spark.read.format("binaryFile").load(path)
        text = F.regexp_replace(F.decode("content", "UTF-16"), "(\r\n|\r|\n)\\z", "")
        lines = whole.select(F.col("path").alias(FILE), F.lit(0).cast("long").alias(BLOCK), F.posexplode(F.split(text, "\r\n|\r|\n", -1)).alias("__at", "value"))
        return lines.withColumn("__at", F.col("__at").cast("long"))
    lines = with_position(spark.read.text(path))
    if encoding not in ("utf-8", "utf-8-sig"):
        lines = lines.withColumn("value", F.decode(F.col("value").cast("binary"), CHARSETS[encoding]))
    return lines


def _reader(spark: SparkSession, encoding: str, delimiter: str):
    check_format(spark, encoding, delimiter)
    return spark.read.options(
        sep=delimiter, quote='"', escape='"', encoding=CHARSETS[encoding], multiLine=True, header=False,
        mode="PERMISSIVE", columnNameOfCorruptRecord=RAW, maxCharsPerColumn=-1,
    ).format("csv")


def _schema(width: int, raw: bool = True) -> T.StructType:
    cells = [T.StructField(f"c{i}", T.StringType()) for i in range(width)]
    return T.StructType([*cells, T.StructField(RAW, T.StringType())] if raw else cells)


def _bare(raw: Column, delimiter: str) -> Column:
    """The record with each whole quoted cell replaced. A quote opens only at the start of a cell and closes at its end."""
    mark = re.escape(delimiter)
    return F.regexp_replace(raw, f'(^|{mark})"[^"]*+(?:""[^"]*+)*+"(?={mark}|$)', "$1q")


def record_width(raw: Column, delimiter: str) -> Column:
    """Fields of a raw record: separators outside quoted cells plus one; a blank line has none."""
    return F.when(raw == "", 0).otherwise(F.regexp_count(_bare(raw, delimiter), F.lit(re.escape(delimiter))) + 1)


def misquoted(raw: Column, delimiter: str) -> Column:
    """Whether a quoted cell stays open or text follows its closing quote."""
    return _bare(raw, delimiter).rlike(f'(?:^|{re.escape(delimiter)})"')


def _single_lines(spark: SparkSession, path: str, encoding: str, delimiter: str) -> DataFrame:
    """Numbered lines with their raw text; a byte-order mark is taken off the first line of a file."""
    check_format(spark, encoding, delimiter)
    numbered = number_records(text_lines(spark, path, encoding))
    text = F.when(F.col(LINE) == 1, F.regexp_replace("value", "^﻿", "")).otherwise(F.col("value"))
    return numbered.withColumn(RAW, text).drop("value")


def _parsed(lines: DataFrame, width: int, delimiter: str) -> DataFrame:
    options = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}
    return lines.withColumn("__cells", F.from_csv(RAW, _schema(width, raw=False).simpleString()[7:-1].replace(":", " "), options)).select("*", "__cells.*").drop("__cells")


def _refuse(problems: DataFrame) -> None:
    bad = problems.filter("reason is not null").first()
    if bad is not None:
        raise TableError(f"{bad['reason']}: {bad['sample']!r}")


def _single_line_problems(lines: DataFrame, width: int, delimiter: str, header: str) -> DataFrame:
    reason = (
        F.when(~F.is_valid_utf8(RAW), "bytes are not valid in this encoding")
        .when(misquoted(F.col(RAW), delimiter), "a quoted value is never closed, or text follows its end")
        .when(record_width(F.col(RAW), delimiter) != width, "a record has another width than the header")
        .when((F.col(LINE) == 1) & (F.col(RAW) != header), "a file has another header than the first")
    )
    return lines.select(FILE, reason.alias("reason"), F.substring(RAW, 1, 200).alias("sample"))


def strict_scan(spark: SparkSession, path: str, encoding: str = "utf-8", delimiter: str = ",", multi_line: bool = True) -> DataFrame:
    """Quoted delimited files with one header, which every file repeats.

    A record of another width, a blank line, another header or broken text fails the
    whole load.
    """
    check_format(spark, encoding, delimiter)
    if multi_line:
        quoted = Quoted(spark, path, encoding, delimiter, shared_folder(spark))
        header = quoted.header()
    else:
        lines = _single_lines(spark, path, encoding, delimiter)
        head = lines.filter(F.col(SRC) == 1).withColumn("__w", record_width(F.col(RAW), delimiter))
        top = head.select("__w", RAW).first()
        if top is None or top["__w"] < 1:
            raise TableError("the source has no header")
        first = _parsed(head, top["__w"], delimiter).first()
        header = [first[f"c{i}"] or "" for i in range(top["__w"])]
    if not header:
        raise TableError("the source is empty")
    names = unique_headers(header)
    if multi_line:
        quoted.check(header)
        rows = quoted.records().filter(F.col(LINE) > 1).select("*", *[F.col("cells")[i].alias(f"c{i}") for i in range(len(names))])
    else:
        _refuse(_single_line_problems(lines, len(names), delimiter, top[RAW]))
        rows = _parsed(lines.filter(F.col(LINE) > 1), len(names), delimiter)
    number = F.col(SRC) - F.col("__files_before") - 1
    return rows.select(number.alias(SRC), *[F.coalesce(F.col(f"c{i}"), F.lit("")).alias(n) for i, n in enumerate(names)])


def below_header(lines: DataFrame, header_row: int, repeats: Column) -> tuple[DataFrame, Column]:
    """Lines after the header, and their numbers.

    One header heads all files, as where a table is written in parts, or every file
    repeats it in the same row; ``repeats`` is true for a line equal to the header. A
    header in some of the later files only is refused.
    """
    if not header_row:
        return lines, F.col(SRC)
    at = F.col(LINE) == header_row
    found = lines.agg(F.count_distinct(FILE).alias("files"), F.count_if(at & repeats).alias("heads")).first()
    if found["heads"] <= 1:
        return lines.filter(F.col(SRC) > header_row), F.col(SRC) - header_row
    if found["heads"] < found["files"]:
        raise TableError("some files repeat the header and some do not")
    return lines.filter(F.col(LINE) > header_row), F.col(SRC) - header_row * (F.col("__files_before") + 1)


def lenient_scan(spark: SparkSession, path: str, encoding: str = "utf-8", delimiter: str = ",", header_row: int = 1, multi_line: bool = True) -> DataFrame:
    """Ragged delimited file: short rows are padded, extra columns are kept, every row records its own width."""
    check_format(spark, encoding, delimiter)
    if multi_line:
        numbered = Quoted(spark, path, encoding, delimiter, shared_folder(spark)).records().withColumn(WIDTH, F.size("cells"))
        parse = lambda lines, width: lines.select("*", *[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(width)])
        same = lambda head: F.col("cells") == F.array(*[F.lit(c) for c in head["cells"]])
    else:
        numbered = _single_lines(spark, path, encoding, delimiter).withColumn(WIDTH, record_width(F.col(RAW), delimiter))
        parse = lambda lines, width: _parsed(lines, width, delimiter)
        same = lambda head: F.col(RAW) == head[RAW]
        broken = ~F.is_valid_utf8(RAW) | misquoted(F.col(RAW), delimiter)
        _refuse(numbered.filter(broken).select(F.substring(RAW, 1, 200).alias("sample"), F.lit("bytes are not valid in this encoding, or a quoted value has no proper end").alias("reason")))
    widest = numbered.filter(F.col(SRC) >= header_row).agg(F.max(WIDTH)).first()[0]
    if not widest:
        raise TableError("choose a header row within the table")
    head = parse(numbered.filter(F.col(SRC) == header_row), widest).first()
    header = [head[f"c{i}"] or "" for i in range(head[WIDTH])]
    names = unique_headers(header, strip=False, width=widest)
    cells = [F.coalesce(F.col(f"c{i}"), F.lit("")).alias(n) for i, n in enumerate(names)]
    body, number = below_header(numbered, header_row, same(head))
    return parse(body, widest).select(number.alias(SRC), F.col(WIDTH), *cells)
