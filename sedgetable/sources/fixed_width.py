"""Fixed-width text by reviewed character widths."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, functions as F

from sedgetable.core import SRC, TableError
from sedgetable.sources.delimited import CHARSETS, below_header, text_lines
from sedgetable.sources.headers import unique_headers
from sedgetable.sources.numbering import LINE, number_records


def fixed_width_scan(spark: SparkSession, path: str, widths: Sequence[int], encoding: str = "utf-8", header_row: int = 1) -> DataFrame:
    """Slice lines by code points. Every line from the header on must have the exact total width.

    ``header_row=0`` keeps the first line as data and names columns ``column_i``.
    """
    if not widths or any(w < 1 for w in widths):
        raise TableError("choose one or more positive widths")
    if encoding not in CHARSETS or header_row < 0:
        raise TableError("choose a known encoding and a header row of at least zero")
    lines = number_records(text_lines(spark, path, encoding))
    marked = F.when(F.col(LINE) == 1, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value"))
    numbered = lines.withColumn("value", marked).filter(F.col(SRC) >= header_row)
    reason = (
        F.when(F.contains("value", F.lit("\x00")), "the text contains NUL characters; review its encoding")
        .when(~F.is_valid_utf8("value"), "bytes are not valid in this encoding")
        .when(F.length("value") != sum(widths), "a line has another length than the reviewed widths")
    )
    bad = numbered.select(reason.alias("reason")).filter("reason is not null").first()
    if bad is not None:
        raise TableError(bad["reason"])
    starts = [1, *[1 + e for e in accumulate(widths)][:-1]]
    cells = [F.substring("value", s, w) for s, w in zip(starts, widths)]
    if header_row:
        head = numbered.filter(F.col(SRC) == header_row).select("value", *cells).first()
        if head is None:
            raise TableError("choose a header row within the file")
        names = unique_headers(list(head)[1:], strip=False)
    else:
        names = [f"column_{i + 1}" for i in range(len(widths))]
    body, number = below_header(numbered, header_row, F.col("value") == (head["value"] if header_row else ""))
    return body.select(number.alias(SRC), *[c.alias(n) for c, n in zip(cells, names)])
