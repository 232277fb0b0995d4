"""Parallel scan of delimited files with quoted line breaks.

A quote opens a value only at the start of a cell and closes it where no second quote
follows; elsewhere it is a character like any other. Files are split at line feeds,
so a split begins either between records or inside a quoted value. A first pass reads
every split from both states and keeps a few numbers of each. The states of a file's
splits are then composed in order, which tells where each begins. The second pass cuts
the records at their true ends; a record over several splits is put together from its
pieces. Values are parsed by Python's ``csv`` in strict mode.
"""

from __future__ import annotations

import csv
import io
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sedgetable.core import SRC, TableError
from sedgetable.scale import BROADCAST_ROWS
from sedgetable.sources.numbering import BLOCK, FILE, LINE

BOM = b"\xef\xbb\xbf"
# Encoding labels and the codec that reads them; UTF-16 files are turned into UTF-8 first.
CODECS = {"utf-8": "utf-8", "utf-8-sig": "utf-8", "utf-16": "utf-8", "cp1252": "cp1252", "latin-1": "latin-1"}
CLOSE = re.compile(rb'[^"]*+(?:""[^"]*+)*+"')
SAMPLE = 200


def raw_lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """Bytes between line feeds with their file and split, in order within a split. UTF-16 files are decoded whole."""
    if encoding == "utf-16":
        whole = spark.read.format("binaryFile").load(path)
        text = F.regexp_replace(F.decode("content", "UTF-16"), "\n\\z", "")
        return whole.select(F.col("path").alias(FILE), F.lit(0).cast("bigint").alias(BLOCK), F.explode(F.split(text, "\n", -1)).alias("value")).withColumn("value", F.col("value").cast("binary"))
    # Without a line feed at the end of the last line nothing is lost: the reader gives the same lines.
    lines = spark.read.text(path, lineSep="\n")
    return lines.select(F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK), F.col("value").cast("binary").alias("value"))


class Quotes:
    """Where quoted values lie in whole lines."""

    def __init__(self, delimiter: str):
        self.mark = delimiter.encode()
        self.open = re.compile(rb'(?<![^\r\n' + re.escape(self.mark) + rb'])"')

    def runs(self, data: bytes, inside: bool) -> tuple[list[int], list[int], bool]:
        """Begins and ends of quoted values, and whether the last is still open. ``data`` begins at a line."""
        begins, ends, at = [], [], 0
        if inside:
            begins.append(0)
        while True:
            if not inside:
                found = self.open.search(data, at)
                if not found:
                    return begins, ends, False
                begins.append(found.start())
                at = found.end()
            found = CLOSE.match(data, at)
            if not found:
                ends.append(len(data))
                return begins, ends, True
            at, inside = found.end(), False
            ends.append(at)

    def cut(self, data: bytes, inside: bool) -> tuple[np.ndarray, np.ndarray, int, bool, bool]:
        """Places just after each record's end, delimiters before each, all delimiters, open at the end, text after a closing quote."""
        begins, ends, still = self.runs(data, inside)
        d = np.frombuffer(data, np.uint8)
        stops = np.flatnonzero((d == 10) | ((d == 13) & (np.append(d[1:], 0) != 10)))
        marks = np.flatnonzero(d == self.mark[0])
        broken = False
        if begins:
            b, e = np.array(begins), np.array(ends)
            outside = lambda x: x[np.searchsorted(b, x, "right") == np.searchsorted(e, x, "right")]
            stops, marks = outside(stops), outside(marks)
            closed = d[e[e < len(d)]]
            broken = bool(((closed != 10) & (closed != 13) & (closed != self.mark[0])).any())
        return stops + 1, np.searchsorted(marks, stops), len(marks), still, broken


@dataclass
class Walk:
    """What a split tells when it is read from one of the two states."""

    began: bool
    inside: bool
    ended: int = 0  # records that end here
    head: int = 0  # delimiters of the record that began in an earlier split and ends here
    tail: int = 0  # delimiters of the record that goes on
    low: int | None = None  # least and greatest width of whole records
    high: int | None = None
    broken: str | None = None  # where text follows a closing quote
    odd: str | None = None  # the first record, or the first of another width than that

    def take(self, quotes: Quotes, data: bytes) -> None:
        stops, before, marks, still, broken = quotes.cut(data, self.inside)
        if broken and self.broken is None:
            self.broken = shown(data)
        if len(stops):
            begins = np.append(0, stops[:-1])
            widths = np.diff(np.append(0, before)) + 1
            widths[0] += self.tail
            blank = (stops - begins == 1) | ((stops - begins == 2) & (np.frombuffer(data, np.uint8)[begins] == 13))
            blank[0] &= not self.inside
            widths[blank] = 0
            of_earlier = self.began and not self.ended
            if of_earlier:
                self.head = int(widths[0]) - 1
            own = widths[of_earlier:]
            if len(own):
                if self.low is None or self.low == self.high:
                    at = int(np.argmax(own != (own[0] if self.low is None else self.low))) + of_earlier
                    self.odd = shown(data[begins[at] : stops[at]])
                self.low, self.high = (int(f(own if x is None else np.append(own, x))) for f, x in ((np.min, self.low), (np.max, self.high)))
            self.tail = marks - int(before[-1])
        else:
            self.tail += marks
        self.ended, self.inside = self.ended + len(stops), still


def shown(data: bytes) -> str:
    return data[:SAMPLE].decode("utf-8", "replace")


def parsed(data: bytes, codec: str, delimiter: str) -> list[list[str]]:
    """Whole records."""
    csv.field_size_limit(sys.maxsize)
    return list(csv.reader(io.StringIO(data.decode(codec), newline=""), delimiter=delimiter, strict=True))


def runs_of(splits: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(np.diff(splits)) + 1).tolist(), len(splits)]
    yield from (x for x in zip(cuts, cuts[1:]) if x[0] < x[1])


def _lines(values: pa.Array) -> bytes:
    return b"\n".join(values.to_pylist()) + b"\n"


TOLD = f"split bigint, {FILE} string, {BLOCK} bigint, began boolean, inside boolean, ended bigint, head bigint, tail bigint, low bigint, high bigint, reason string, sample string, top array<string>"
PLACED = "file string, split bigint, inside boolean, first bigint, ended bigint, low bigint, high bigint, reason string, sample string, top array<string>"
KINDS = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}


def _batch(rows: list, schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def _walks(lines: DataFrame, encoding: str, delimiter: str) -> DataFrame:
    """Two rows for each split, one for each state that it may begin in."""
    codec = CODECS[encoding]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes, now, place, walks, damage, top = Quotes(delimiter), None, (), [], None, None

        def told() -> list[tuple]:
            out = []
            for w in walks:
                wrong = ("bytes are not valid in this encoding", damage) if damage else ("text follows a closing quote", w.broken) if w.broken else (None, w.odd)
                cells = top if isinstance(top, list) else None
                out.append((now, *place, w.began, w.inside, w.ended, w.head, w.tail, w.low, w.high, *wrong, cells))
            return out

        for batch in batches:
            splits, rows = batch.column(0).to_numpy(zero_copy_only=False), []
            for lo, hi in runs_of(splits):
                data = _lines(batch.column(3).slice(lo, hi - lo))
                if splits[lo] != now:
                    rows += told()
                    now, place = int(splits[lo]), (batch.column(1)[lo].as_py(), batch.column(2)[lo].as_py())
                    walks, damage, top = [Walk(False, False), Walk(True, True)], None, None
                    if not place[1]:
                        data, top = data.removeprefix(BOM) if codec == "utf-8" else data, b""
                try:
                    data.decode(codec)
                except UnicodeDecodeError:
                    damage = damage or shown(data)
                if isinstance(top, bytes):  # the file's first record is not complete yet
                    top += data
                    stops = quotes.cut(top, False)[0]
                    if len(stops):
                        top = parsed_or_none(top[: stops[0]], codec, delimiter)
                for w in walks:
                    w.take(quotes, data)
            yield _batch(rows, TOLD)
        yield _batch(told(), TOLD)

    return lines.select("split", FILE, BLOCK, "value").mapInArrow(walk, TOLD)


def parsed_or_none(data: bytes, codec: str, delimiter: str) -> list[str] | None:
    try:
        return parsed(data, codec, delimiter)[0]
    except (csv.Error, UnicodeDecodeError):
        return None


def _composed(walks: DataFrame) -> DataFrame:
    """Where each split begins: its state and how many records of its file end before it; widths; what is wrong in it."""

    def compose(table: pa.Table) -> pa.Table:
        rows = table.sort_by(BLOCK).to_pylist()  # two rows for each split of one file
        file, out, inside, line, carried = rows[0][FILE], [], False, 0, 0
        told = {(r["split"], r["began"]): r for r in rows}
        for split in dict.fromkeys(r["split"] for r in rows):
            r = told[split, inside]
            widths = [w for w in (r["low"], r["high"], carried + r["head"] + 1 if inside and r["ended"] else None) if w is not None]
            out.append([file, split, inside, line, r["ended"], min(widths, default=None), max(widths, default=None), r["reason"], r["sample"], r["top"]])
            carried = r["tail"] if r["ended"] else carried + r["tail"]
            line, inside = line + r["ended"], r["inside"]
        if inside and not any(x[7] for x in out):
            out[-1][7:9] = ["a quoted value is never closed", file]
        return pa.Table.from_batches([_batch(out, PLACED)])

    return walks.groupBy(FILE).applyInArrow(compose, PLACED)


RECORDS = f"{FILE} bigint, {SRC} bigint, {LINE} bigint, __files_before bigint, piece bigint, raw binary, cells array<string>"


def _records(lines: DataFrame, encoding: str, delimiter: str) -> DataFrame:
    codec = CODECS[encoding]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes, now, rest = Quotes(delimiter), None, b""
        for table in batches:
            splits, rows = table.column(0).to_numpy(zero_copy_only=False), []
            for lo, hi in runs_of(splits):
                data = _lines(table.column(7).slice(lo, hi - lo))
                if splits[lo] != now:
                    if rest:
                        rows.append((file, start + line, line + 1, earlier, block, rest, None))
                    now, rest = int(splits[lo]), b""
                    inside, line, file, start, earlier, block = (table.column(k)[lo].as_py() for k in range(1, 7))
                    head = inside
                    if not line and not inside and codec == "utf-8":
                        data = data.removeprefix(BOM)
                stops, _, _, inside, _ = quotes.cut(data, inside)
                if not len(stops):
                    rest += data
                    continue
                done, size = rest + data[: stops[-1]], len(rest)
                rest = data[stops[-1] :]
                if head:
                    rows.append((file, start + line, line + 1, earlier, block, done[: size + stops[0]], None))
                    done, head, line = done[size + stops[0] :], False, line + 1
                for cells in parsed(done, codec, delimiter):
                    rows.append((file, start + line, line + 1, earlier, None, None, cells))
                    line += 1
            yield _batch(rows, RECORDS)
        yield _batch([(file, start + line, line + 1, earlier, block, rest, None)] if rest else [], RECORDS)

    def glue(table: pa.Table) -> pa.Table:
        table = table.sort_by("piece")
        cells = parsed(b"".join(table["raw"].to_pylist()), codec, delimiter)
        return pa.Table.from_batches([_batch([(*[table[k][0].as_py() for k in range(4)], None, None, cells[0])], RECORDS)])

    pieces = lines.mapInArrow(read, RECORDS)
    over = pieces.filter("piece is not null").groupBy(FILE, LINE).applyInArrow(glue, RECORDS)
    return pieces.filter("piece is null").unionByName(over).drop("piece", "raw")


class Quoted:
    """A folder of quoted files whose splits have been walked; ``kept`` is a folder for one row per split."""

    def __init__(self, spark: SparkSession, path: str, encoding: str, delimiter: str, kept: str):
        self.encoding, self.delimiter = encoding, delimiter
        self.lines = raw_lines(spark, path, encoding).withColumn("split", F.xxhash64(FILE, BLOCK))
        _composed(_walks(self.lines, encoding, delimiter)).write.parquet(kept)
        self.starts = spark.read.parquet(kept)
        refuse(self.starts.filter("reason is not null").orderBy("file", "first"))

    def header(self) -> list[str]:
        """The first record of the first file."""
        top = self.starts.filter("top is not null").orderBy("file").select("top").first()
        if top is None:
            raise TableError("the source is empty, or its first record does not end in the first split")
        return top["top"]

    def check(self, header: list[str]) -> None:
        """Every record as wide as the header, which every file repeats."""
        n, other = len(header), F.col("top") != F.array(*[F.lit(c) for c in header])
        width = F.when((F.col("low") != n) | (F.col("high") != n), "a record has another width than the header")
        refuse(self.starts.select(F.coalesce(width, F.when(other, "a file has another header than the first")).alias("reason"), F.coalesce("sample", "file").alias("sample")).filter("reason is not null"))

    def records(self) -> DataFrame:
        """All records: file number, ``__source_record`` over all files and ``__line`` in the file (both from 1), files before, cells."""
        files = self.starts.groupBy("file").agg(F.sum("ended").alias("n"))
        order = Window.orderBy("file")  # one row for each file
        before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        files = files.select("file", (F.row_number().over(order) - 1).cast("bigint").alias("earlier"), (before + 1).alias("start"))
        starts = self.starts.join(files, "file").select("split", "inside", "first", F.col("earlier").alias("number"), "start", "earlier")
        lines = self.lines.select("split", BLOCK, "value")
        if starts.count() <= BROADCAST_ROWS:
            placed = lines.join(F.broadcast(starts), "split")
        else:  # a join by shuffle loses the order of lines
            placed = lines.withColumn("at", F.monotonically_increasing_id()).join(starts, "split").sortWithinPartitions("split", "at")
        return _records(placed.select("split", "inside", "first", "number", "start", "earlier", BLOCK, "value"), self.encoding, self.delimiter)


def refuse(problems: DataFrame) -> None:
    bad = problems.first()
    if bad is not None:
        raise TableError(f"{bad['reason']}: {bad['sample']!r}")
