"""File manifests, probes, integrity checks and loads with quarantine."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sedgetable.core import SRC
from sedgetable.sources.delimited import DELIMITERS, RAW, _reader, _schema
from sedgetable.sources.headers import unique_headers
from sedgetable.sources.numbering import FILE, LINE, number_records, with_position


def _relative(path: Column, folder: str) -> Column:
    """Path below the folder, whose last name marks where it starts."""
    return F.substring_index(path, folder.rstrip("/").rsplit("/", 1)[-1] + "/", -1)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(_relative(F.col("path"), folder).alias("file"), "content", "length")


# Endings that Spark's text reader would decompress.
PACKED = r"\.(gz|bz2|zst|lz4|snappy|deflate)$"


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of files whose lines come in order; a file's last line feed is there if its bytes say so."""
    now, digest, seen, length = None, None, 0, 0

    def done() -> list[tuple[str, str]]:
        if now is None:
            return []
        if seen < length:
            digest.update(b"\n")
        return [(now, digest.hexdigest())]

    for batch in batches:
        rows = []
        for file, size, value in zip(*(batch.column(k) for k in range(3))):
            file, line = file.as_py(), value.as_buffer()
            if file != now:
                rows += done()
                now, digest, seen, length = file, hashlib.sha256(), 0, size.as_py()
            else:
                digest.update(b"\n")
                seen += 1
            digest.update(line)
            seen += line.size
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else ([], []))], ["file", "sha256"])
    rows = done()
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else ([], []))], ["file", "sha256"])


def source_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes, SHA-256, line-end counts and NUL count per file.

    Files are read as lines that Spark splits freely, so no file is held as a value:
    counts are added up per file, and the hash runs over a file's lines in their order,
    one file in one task but a batch at a time. Only files that the text reader would
    decompress are hashed whole. Spark does not list files without bytes, so they are
    absent.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(_relative(F.col("_metadata.file_path"), folder).alias("file"), "length")
    text = spark.read.option("recursiveFileLookup", True).text(folder, lineSep="\n")
    lines = text.select(
        _relative(F.col("_metadata.file_path"), folder).alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("value"),
    ).filter(~F.col("file").rlike(PACKED))
    order = F.struct("block", "at")
    # Bytes are compared as characters of one byte each.
    line = F.decode("value", "ISO-8859-1")
    carriage = F.endswith(line, F.lit("\r"))
    counts = lines.groupBy("file").agg(
        F.count("*").alias("lines"), F.sum(F.octet_length("value")).alias("inside"), F.count_if(carriage).alias("ends"), F.max_by(carriage, order).alias("last"),
        F.sum(F.regexp_count(line, F.lit("\r"))).alias("returns"), F.sum(F.regexp_count(line, F.lit("\x00"))).alias("nul"),
    )
    ordered = lines.repartition("file").sortWithinPartitions("file", "block", "at").select("file", "size", "value")
    found = counts.join(ordered.mapInArrow(_hashed, "file string, sha256 string"), "file")
    all_ = listed.filter(~F.col("file").rlike(PACKED)).join(found, "file", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    open_end = F.col("inside") + F.col("lines") > F.col("length")  # no line feed after the last line
    lf = zero(F.col("lines") - open_end.cast("int"))
    crlf = zero(F.col("ends") - (open_end & F.col("last")).cast("int"))
    plain = all_.select(
        "file", F.col("length").alias("bytes"), F.coalesce("sha256", F.sha2(F.lit(b""), 256)).alias("sha256"),
        crlf.cast("int").alias("crlf"), (lf - crlf).cast("int").alias("lf"), (zero(F.col("returns")) - crlf).cast("int").alias("cr"), zero(F.col("nul")).cast("int").alias("nul"),
    )
    return plain.unionByName(_whole_files(spark, folder))


def _whole_files(spark: SparkSession, folder: str) -> DataFrame:
    text = F.decode("content", "ISO-8859-1")
    crlf, lf, cr = (F.regexp_count(text, F.lit(p)) for p in ("\r\n", "\n", "\r"))
    packed = _files(spark, folder).filter(F.col("file").rlike(PACKED))
    return packed.select("file", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), crlf.alias("crlf"), (lf - crlf).alias("lf"), (cr - crlf).alias("cr"), F.regexp_count(text, F.lit("\x00")).alias("nul"))


def duplicate_sources(manifest: DataFrame) -> DataFrame:
    """Contents kept by more than one file, with the surplus."""
    return manifest.groupBy("sha256").agg(F.count("*").alias("files"), (F.count("*") - 1).alias("surplus")).filter("files > 1")


def verify_integrity(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Compare ``expected(file, bytes, sha256)`` with a fresh manifest; only differences are returned."""
    e = expected.select("file", F.col("bytes").alias("eb"), F.col("sha256").alias("eh"))
    f = found.select("file", F.col("bytes").alias("fb"), F.col("sha256").alias("fh"))
    status = (
        F.when(F.col("fh").isNull(), "missing file")
        .when(F.col("eh").isNull(), "unlisted file")
        .when(F.col("eb") != F.col("fb"), "byte length differs")
        .when(F.lower("eh") != F.col("fh"), "hash differs")
    )
    return e.join(f, "file", "full").select("file", status.alias("status")).filter("status is not null")


def probe_files(spark: SparkSession, folder: str) -> DataFrame:
    """Encoding and delimiter per file, with notes where the choice is uncertain.

    The delimiter is the one that occurs equally often in every line; otherwise
    a tab in the first line, else a comma.
    """
    c = F.col("content")
    start = F.hex(F.substring(c, 1, 3))
    encoding = (
        F.when(start.startswith("FFFE") | start.startswith("FEFF"), "utf-16")
        .when(start == "EFBBBF", "utf-8-sig")
        .when(F.is_valid_utf8(c.cast("string")), "utf-8")
        .otherwise("cp1252")
    )
    files = _files(spark, folder).withColumn("encoding", encoding)
    text = F.when(F.col("encoding") == "utf-16", F.decode(c, "UTF-16")).when(F.col("encoding") == "cp1252", F.decode(c, "ISO-8859-1")).otherwise(c.cast("string"))
    files = files.withColumn("body", F.regexp_replace(F.regexp_replace(text, "^﻿", ""), '"[^"]*+"', ""))
    lines = F.filter(F.split("body", "\r\n|\r|\n"), lambda x: x != "")
    files = files.withColumn("lines", lines)

    def consistency(delimiter: str) -> Column:
        counts = F.transform("lines", lambda x: F.length(x) - F.length(F.replace(x, F.lit(delimiter), F.lit(""))))
        return F.when((F.array_min(counts) == F.array_max(counts)) & (F.array_min(counts) > 0), F.array_min(counts)).otherwise(0)

    best = F.array_max(F.array(*[F.struct(consistency(d).alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)]))
    files = files.withColumn("best", best)
    sure = F.col("best.n") > 0
    delimiter = F.when(sure, F.col("best.d")).when(F.contains(F.get("lines", F.lit(0)), F.lit("\t")), "\t").otherwise(",")
    nul = F.contains(F.col("body"), F.lit("\x00"))
    notes = F.concat_ws(
        "; ",
        F.when(nul, "NUL bytes: not loadable as text"),
        F.when(F.col("encoding") == "cp1252", "not valid UTF-8"),
        F.when(~sure, "delimiter uncertain"),
    )
    return files.select("file", "encoding", delimiter.alias("delimiter"), (~nul).alias("loadable"), notes.alias("notes"))


def load_with_quarantine(spark: SparkSession, folder: str, header: list[str], delimiter: str = ",", suffix: str = ".csv") -> tuple[DataFrame, DataFrame]:
    """All delimited files of one header as one table, and the manifest with the reason files were set aside.

    A file with any record of another width, another header or another suffix
    contributes no rows; it stays in the manifest with its reason.
    """
    manifest = source_manifest(spark, folder).select("file", "sha256", "bytes")
    names = unique_headers(header)
    reader = _reader(spark, "utf-8", delimiter).option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}")
    rows = with_position(reader.schema(_schema(len(names))).load(folder))
    rows = rows.withColumn("file", _relative(F.col(FILE), folder))
    numbered = number_records(rows)
    first_ok = F.lit(True)
    for i, name in enumerate(header):
        first_ok = first_ok & F.coalesce(F.col(f"c{i}") == name, F.lit(name == ""))
    reason = (
        F.when(F.max(F.when(F.col(LINE) == 1, ~first_ok)), "header differs")
        .when(F.max(F.col(RAW).isNotNull()), "a record has another width than the header")
    )
    verdict = numbered.groupBy("file").agg(reason.alias("reason"), F.count("*").alias("lines"))
    other = F.when(~F.col("file").endswith(suffix), "no tabular adapter for this suffix").when(F.col("lines").isNull(), "the source is empty")
    full = manifest.join(verdict, "file", "left").withColumn("reason", F.coalesce("reason", other)).drop("lines")
    good = full.filter("reason is null").select("file")
    table = numbered.join(good, "file", "left_semi").filter(F.col(LINE) > 1)
    cells = [F.coalesce(F.col(f"c{i}"), F.lit("")).alias(n) for i, n in enumerate(names)]
    return table.select("file", (F.col(LINE) - 1).alias(SRC), *cells), full
