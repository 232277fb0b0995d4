"""Fixed-record binary tables (dBASE layout) from many files in one job."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sedgetable.core import SRC, TableError
from sedgetable.scale import bounded_broadcast
from sedgetable.sources.delimited import CHARSETS

TEXT_KINDS = ("C", "N", "D", "L", "F")
HEADER_BYTES = 65_535  # the header's size is kept in two bytes
BATCH_BYTES = 4 << 20


def _byte(c: Column, at: Column) -> Column:
    """Unsigned byte at a 0-based offset."""
    return F.conv(F.hex(F.substring(c, at + 1, F.lit(1))), 16, 10).cast("int")


def _little_endian(c: Column, at: int, size: int) -> Column:
    return sum((_byte(c, F.lit(at + i)).cast("long") * (256**i) for i in range(size)), F.lit(0).cast("long"))


def dbase_layouts(spark: SparkSession, path: str) -> DataFrame:
    """Per file: its length, record count, header and record size, and the field descriptors."""
    # Functions over array items copy every value they name, so they get the header alone.
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.substring("content", 1, HEADER_BYTES).alias("head"))
    c = F.col("head")
    sized = files.select("path", "length", "head", _little_endian(c, 4, 4).alias("records"), _little_endian(c, 8, 2).alias("header"), _little_endian(c, 10, 2).alias("size"))
    offsets = F.filter(F.sequence(F.lit(32).cast("long"), F.greatest(F.col("header") - 2, F.lit(32)), F.lit(32).cast("long")), lambda o: o < F.col("header") - 1)

    def descriptor(o: Column) -> Column:
        raw_name = F.decode(F.substring(c, (o + 1).cast("int"), F.lit(11)), "ISO-8859-1")
        return F.struct(
            F.substring_index(raw_name, "\x00", 1).alias("name"),
            F.decode(F.substring(c, (o + 12).cast("int"), F.lit(1)), "ISO-8859-1").alias("kind"),
            _byte(c, (o + 16).cast("int")).alias("length"),
        )

    fields = F.filter(F.transform(offsets, descriptor), lambda d: ~d["name"].startswith("\r"))
    return sized.withColumn("fields", fields).drop("head")


def _records(header: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cut whole files into records. A file is walked once; its records share the file's own buffer."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BATCH_BYTES // size)
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                data = content.as_buffer()
                (count,) = struct.unpack("<I", data[4:8])
                for lo in range(0, count, step):
                    n = min(step, count - lo)
                    bounds = pa.py_buffer(np.arange(0, (n + 1) * size, size, dtype=np.int32))
                    raw = pa.Array.from_buffers(pa.binary(), n, [None, bounds, data.slice(header + lo * size, n * size)])
                    yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * n), pa.array(np.arange(lo, lo + n)), raw], ["__file", "__at", "raw"])

    return cut


def _numbered(records: DataFrame, layouts: DataFrame) -> DataFrame:
    """Records of whole files: offset of the file plus the place inside it."""
    before = F.coalesce(F.sum("records").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = layouts.select(F.col("path").alias("__file"), before.alias("__before"))
    placed = records.join(bounded_broadcast(offsets, len(layouts.inputFiles())), "__file")
    return placed.withColumn(SRC, F.col("__before") + F.col("__at") + 1)


def dbase_scan(spark: SparkSession, path: str, encoding: str = "cp1252") -> DataFrame:
    """Literal cells of all files that share one layout; text is right-trimmed, other kinds are ``hex:``."""
    if encoding == "cp1252":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    layouts = dbase_layouts(spark, path)
    checked = layouts.select("header", "size", "fields", (F.col("length") < F.col("header") + F.col("records") * F.col("size")).alias("short"))
    kinds = checked.distinct().limit(2).collect()
    if len(kinds) != 1 or kinds[0]["short"]:
        raise TableError("files are truncated or differ in their layout")
    fields = kinds[0]["fields"]
    if 1 + sum(f["length"] for f in fields) != kinds[0]["size"]:
        raise TableError("record size differs from the field lengths")
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInArrow(_records(kinds[0]["header"], kinds[0]["size"]), "__file string, __at bigint, raw binary")
    cells, at = [], 2
    for f in fields:
        part = F.substring("raw", at, f["length"])
        text = F.rtrim(F.decode(part, CHARSETS[encoding])) if f["kind"] in TEXT_KINDS else F.concat(F.lit("hex:"), F.lower(F.hex(part)))
        cells.append(text.alias(f["name"]))
        at += f["length"]
    deleted = F.when(F.substring("raw", 1, 1) == F.lit(b"*"), "true").otherwise("false")
    return _numbered(rows, layouts).select(SRC, *cells, deleted.alias("_dbf_deleted"))
