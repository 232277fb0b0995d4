"""XML documents of any size: an inventory of element paths, and the records at one exact path.

A document is read as pieces that end at ``>``, which Spark splits freely. The pieces of
a document meet in order in one task and pass through a parser that keeps only the names
of the open elements, so neither a file nor its tree is ever held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import groupby
from operator import itemgetter
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sedgetable.core import TableError
from sedgetable.scale import shared_folder
from sedgetable.sources.numbering import BLOCK, FILE

PATHS = pa.schema([("file", pa.string()), ("path", pa.list_(pa.string())), ("records", pa.int64()), ("attributes", pa.list_(pa.string())), ("reason", pa.string())])
RECORDS = pa.schema([("file", pa.string()), ("at", pa.int64()), ("record", pa.map_(pa.string(), pa.string())), ("reason", pa.string())])
PATHS_DDL = "file string, path array<string>, records bigint, attributes array<string>, reason string"
RECORDS_DDL = "file string, at bigint, record map<string,string>, reason string"
# Paths whose counts a task holds before it sends them on.
HELD_PATHS = 10_000


class Refused(Exception):
    """A document that cannot be read as asked; the text says why."""


def _expanded(name: str) -> str:
    return "{" + name if "}" in name else name


class Walker:
    """One document, read piece by piece. ``path`` names the open elements, ``rows`` are not yet sent on."""

    def __init__(self) -> None:
        self.path: list[str] = []
        self.rows: list[tuple] = []
        self.reason: str | None = None
        self.parser = expat.ParserCreate(namespace_separator="}")
        self.parser.buffer_text = True
        self.parser.StartElementHandler = self._open
        self.parser.EndElementHandler = self._close
        self.parser.CharacterDataHandler = self.text
        self.parser.StartDoctypeDeclHandler = self._declared

    def _declared(self, *_: object) -> None:
        raise Refused("document type declarations are not read")

    def _open(self, name: str, attributes: dict[str, str]) -> None:
        self.path.append(_expanded(name))
        self.opened({_expanded(k): v for k, v in attributes.items()})

    def _close(self, name: str) -> None:
        self.closed()
        self.path.pop()

    def feed(self, data: bytes, last: bool = False) -> None:
        if self.reason is None:
            try:
                self.parser.Parse(data, last)
            except (Refused, expat.ExpatError) as problem:
                self.reason = str(problem) if isinstance(problem, Refused) else f"not well-formed XML: {problem}"

    def taken(self, last: bool = False) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows

    def opened(self, attributes: dict[str, str]) -> None: ...

    def text(self, data: str) -> None: ...

    def closed(self) -> None: ...


class Inventory(Walker):
    """Counts elements and collects attribute names per path; rows are partial counts that add up."""

    def __init__(self) -> None:
        super().__init__()
        self.found: dict[tuple[str, ...], tuple[list[int], set[str]]] = {}

    def opened(self, attributes: dict[str, str]) -> None:
        count, names = self.found.setdefault(tuple(self.path), ([0], set()))
        count[0] += 1
        names.update(attributes)

    def taken(self, last: bool = False) -> list[tuple]:
        if not last and len(self.found) < HELD_PATHS:
            return []
        rows = [(list(path), count[0], sorted(names), None) for path, (count, names) in self.found.items()]
        self.found.clear()
        return rows + ([(None, None, None, self.reason)] if last and self.reason else [])


class Records(Walker):
    """Flat records at one path: attributes as ``@name``, children by name, else the record's own ``#text``."""

    def __init__(self, target: Sequence[str]) -> None:
        super().__init__()
        self.target, self.seq = list(target), 0
        self.values: dict[str, str] | None = None
        self.own, self.child, self.children = "", "", 0

    def opened(self, attributes: dict[str, str]) -> None:
        if self.values is None:
            if self.path == self.target:
                self.values, self.own, self.children = {"@" + k: v for k, v in attributes.items()}, "", 0
            return
        if len(self.path) > len(self.target) + 1 or attributes:
            raise Refused(f"a record's child is not plain text: {self.path[-1]}")
        if self.path[-1] in self.values:
            raise Refused(f"a record repeats a child: {self.path[-1]}")
        self.values[self.path[-1]], self.child = "", ""
        self.children += 1

    def text(self, data: str) -> None:
        if self.values is None:
            return
        if len(self.path) > len(self.target):
            self.child += data
        else:
            self.own += data

    def closed(self) -> None:
        if self.values is None:
            return
        if len(self.path) > len(self.target):
            self.values[self.path[-1]] = self.child
            return
        if self.children and self.own.strip():
            raise Refused("a record mixes text with child elements")
        if not self.children:
            self.values["#text"] = self.own
        self.rows.append((self.seq, list(self.values.items()), None))
        self.seq += 1
        self.values = None

    def taken(self, last: bool = False) -> list[tuple]:
        return super().taken() + ([(None, None, self.reason)] if last and self.reason else [])


def _walked(batches: Iterator[pa.RecordBatch], make: Callable[[], Walker], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pass the pieces of each document, which come in order, through a walker of its own."""
    now, walker, seen, size = None, None, 0, 0

    def sent(rows: list[tuple]) -> list[tuple]:
        return [(now, *row) for row in rows]

    def ended() -> list[tuple]:
        if walker is None:
            return []
        # The last piece's end was a ">" if the pieces fall short by one byte, or by four where a byte order mark was skipped.
        walker.feed(b">" if size - seen in (1, 4) else b"", True)
        return sent(walker.taken(True))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for batch in batches:
        rows: list[tuple] = []
        for (file, length), run in groupby(zip(*(batch.column(k).to_pylist() for k in range(3))), itemgetter(0, 1)):
            data = b">".join(piece for _, _, piece in run)
            if file != now:
                rows += ended()
                now, walker, seen, size = file, make(), 0, length
            else:
                data = b">" + data
            seen += len(data)
            walker.feed(data)
            rows += sent(walker.taken())
        yield batch_of(rows)
    yield batch_of(ended())


def _parsed(spark: SparkSession, folder: str, make: Callable[[], Walker], schema: pa.Schema, ddl: str) -> DataFrame:
    """Rows of all documents, written once to the shared folder; a document that cannot be read is refused."""
    text = spark.read.option("recursiveFileLookup", True).text(folder, lineSep=">")
    pieces = text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), F.col("value").cast("binary").alias("value"),
    )
    ordered = pieces.repartition("file").sortWithinPartitions("file", "block", "place").select("file", "size", "value")
    kept = shared_folder(spark)
    ordered.mapInArrow(lambda batches: _walked(batches, make, schema), ddl).write.parquet(kept)
    rows = spark.read.schema(ddl).parquet(kept)
    bad = rows.filter("reason is not null").orderBy("file").first()
    if bad is not None:
        raise TableError(f"{bad['reason']}: {bad['file']}")
    return rows


def xml_record_paths(spark: SparkSession, folder: str) -> DataFrame:
    """``path, records, attributes, files`` of every element path of the documents.

    A path lists expanded names (``{namespace}name``) from the root; no record path is
    assumed. Tasks send on partial counts, which are added up per path.
    """
    found = _parsed(spark, folder, Inventory, PATHS, PATHS_DDL)
    per_file = found.groupBy("path", "file").agg(F.sum("records").alias("records"), F.flatten(F.collect_set("attributes")).alias("attributes"))
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set("attributes"))))
    return per_file.groupBy("path").agg(F.sum("records").alias("records"), names.alias("attributes"), F.count("*").alias("files"))


def chosen_path(spark: SparkSession, folder: str, record: str | Sequence[str]) -> list[str]:
    """A list of names as it is, ``/root/record`` split, and a bare name where a single path ends in it."""
    if not isinstance(record, str):
        return list(record)
    if record.startswith("/"):
        return record[1:].split("/")
    paths = xml_record_paths(spark, folder).filter(F.element_at("path", -1) == record).select("path").limit(2).collect()
    if len(paths) != 1:
        raise TableError(f"{'several' if paths else 'no'} element paths end in {record}; choose one by its exact path")
    return list(paths[0]["path"])


def xml_records(spark: SparkSession, folder: str, record: str | Sequence[str]) -> DataFrame:
    """``__file, __block, __at, record`` of every record element, in document order within a file."""
    target = chosen_path(spark, folder, record)
    rows = _parsed(spark, folder, lambda: Records(target), RECORDS, RECORDS_DDL)
    return rows.select(F.col("file").alias(FILE), F.lit(0).cast("bigint").alias(BLOCK), F.col("at").alias("__at"), "record")
