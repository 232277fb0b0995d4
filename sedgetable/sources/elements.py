"""Elements of JSON documents of any size.

Spark splits a document after closing braces, wherever they stand. A first pass walks
every split twice, as if it began outside and inside a string, and keeps how the depth
of brackets changes. Composed in order these tell the state and depth at which each
split begins. The elements, objects at depth one of a top-level array or at depth two
below a member of a top-level object, are then cut out in parallel; one that spans
splits is put together from its pieces. No document is ever held as a whole. Elements
are cut once and stored; one that stands in its split before any member's name takes
the name that the earlier splits leave open.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sedgetable.core import TableError
from sedgetable.scale import BROADCAST_ROWS, bounded_broadcast, shared_folder
from sedgetable.sources.numbering import BLOCK, FILE
from sedgetable.sources.quoted import BOM, runs_of

STEP = np.zeros(256, np.int64)
STEP[[ord("{"), ord("[")]], STEP[[ord("}"), ord("]")]] = 1, -1
BRACKET = STEP != 0
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 13, 32, ord(",")]] = True
PEEK = 64


def quotes(data: bytes, d: np.ndarray) -> np.ndarray:
    """Places of quotes that are not escaped."""
    at = np.flatnonzero(d == 34)
    keep = np.ones(len(at), bool)
    for i in np.flatnonzero(d[at - 1] == 92) if b"\\" in data else []:
        back = data[: at[i]]
        keep[i] = (len(back) - len(back.rstrip(b"\\"))) % 2 == 0
    return at[keep]


class Marks:
    """What both states of a text share: its quotes, its brackets, and whether an odd number of quotes is before each."""

    def __init__(self, data: bytes):
        self.bytes = np.frombuffer(data, np.uint8)
        self.quotes = quotes(data, self.bytes)
        self.brackets = np.flatnonzero(BRACKET[self.bytes])
        self.odd = np.searchsorted(self.quotes, self.brackets) & 1 == 1


@dataclass
class Level:
    """Brackets outside strings: where they are, and the depth after each."""

    data: bytes
    inside: bool
    depth: int
    marks: Marks | None = None

    def __post_init__(self):
        marks = self.marks or Marks(self.data)
        self.bytes, self.quotes = marks.bytes, marks.quotes
        self.at = marks.brackets[marks.odd == self.inside]
        self.step = STEP[self.bytes[self.at]]
        self.after = self.depth + np.cumsum(self.step)
        self.ends_inside = bool((len(self.quotes) + self.inside) & 1)
        self.end = int(self.after[-1]) if len(self.at) else self.depth

    def in_string(self, at: np.ndarray) -> np.ndarray:
        return (np.searchsorted(self.quotes, at) + self.inside) & 1 == 1

    def depth_at(self, at: np.ndarray) -> np.ndarray:
        """Depth just before each place."""
        return np.append(self.depth, self.after)[np.searchsorted(self.at, at)]

    def members(self) -> list[tuple[int, str, str]]:
        """Members of a top-level object: place, name, beginning of the value."""
        colons = np.flatnonzero(self.bytes == ord(":"))
        colons = colons[~self.in_string(colons)]
        out = []
        for c in colons[self.depth_at(colons) == 1].tolist():
            before = self.quotes[: np.searchsorted(self.quotes, c)]
            if len(before) < 2:
                raise ValueError("a member's name is cut by a split")
            value = self.data[c + 1 : c + 1 + PEEK].lstrip().decode("utf-8", "replace")
            out.append((c, json.loads(self.data[before[-2] : before[-1] + 1]), value))
        return out

    def plain(self, depth: int) -> np.ndarray:
        """Places at ``depth`` that belong to no object: numbers, words, strings, nested arrays."""
        change = np.zeros(len(self.bytes) + 1, np.int64)
        np.add.at(change, self.at + (self.step > 0), self.step)  # an opening bracket still lies at the outer depth
        plain = (np.cumsum(change)[:-1] + self.depth == depth) & ~BLANK[self.bytes]
        plain[self.at] = False
        plain[self.at[(self.step > 0) & (self.after == depth + 1) & (self.bytes[self.at] == ord("["))]] = True
        return np.flatnonzero(plain)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, lineSep="}")
    named = text.select(F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK), F.col("value").cast("binary").alias("value"))
    return named.withColumn("split", F.xxhash64(FILE, BLOCK))


def _joined(values: pa.Array) -> bytes:
    return b"}".join(values.to_pylist()) + b"}"


def _rows(rows: list, fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows) if rows else [[]] * len(fields), fields)], [n for n, _ in fields])


I, S, B = pa.int64(), pa.string(), pa.bool_()
NAMES = {I: "bigint", S: "string", B: "boolean"}
schema = lambda fields: ", ".join(f"{n} {NAMES[k]}" for n, k in fields)
WALK = [("split", I), (FILE, S), (BLOCK, I), ("began", B), ("inside", B), ("delta", I), ("low", I), ("top", S)]
START = [("file", S), ("split", I), (BLOCK, I), ("inside", B), ("depth", I), ("target", I), ("origin", I), ("reason", S)]
PIECE = [("split", I), (BLOCK, I), ("__at", I), ("event", S), ("member", S), ("known", B), ("plain", B), ("origin", I), ("piece", I), ("text", S)]



def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, place, states, top = None, (), [], ""

    def told() -> list[tuple]:
        return [(now, *place, bool(k), inside, depth, low, top) for k, (inside, depth, low) in enumerate(states)]

    for batch in batches:
        splits, rows = batch.column(0).to_numpy(zero_copy_only=False), []
        for lo, hi in runs_of(splits):
            data = _joined(batch.column(3).slice(lo, hi - lo))
            if splits[lo] != now:
                rows += told()
                now, place = int(splits[lo]), (batch.column(1)[lo].as_py(), batch.column(2)[lo].as_py())
                states, top = [(False, 0, 0), (True, 0, 0)], ""
                if not place[1]:
                    data = data.removeprefix(BOM)
            if not place[1] and not top:
                top = data.lstrip()[:1].decode("latin-1")
            marks = Marks(data)
            for k, (inside, depth, low) in enumerate(states):
                level = Level(data, inside, depth, marks)
                states[k] = level.ends_inside, level.end, min(low, int(level.after.min(initial=0)))
        yield _rows(rows, WALK)
    yield _rows(told(), WALK)


def _compose(table: pa.Table) -> pa.Table:
    rows = table.sort_by(BLOCK).to_pylist()  # two rows for each split of one file
    told = {(r["split"], r["began"]): r for r in rows}
    target = {"[": 1, "{": 2}.get(rows[0]["top"], 0)
    out, inside, depth, origin = [], False, 0, -1
    for split in dict.fromkeys(r["split"] for r in rows):
        r = told[split, inside]
        out.append([r[FILE], split, r[BLOCK], inside, depth, target, origin, None])
        if depth + r["low"] <= target:
            origin = r[BLOCK]
        inside, depth = r["inside"], depth + r["delta"]
    if inside or depth > 0 or not target:
        out[0][-1] = "the document is not a whole JSON array or object"
    return pa.Table.from_batches([_rows(out, START)])


def _placed(chunks: DataFrame, starts: DataFrame, columns: list[str]) -> DataFrame:
    """Chunks beside the state of their split, in order within a split."""
    if starts.count() <= BROADCAST_ROWS:
        return chunks.join(F.broadcast(starts), "split").select("split", "value", *columns)
    lines = chunks.withColumn("at", F.monotonically_increasing_id())  # a join by shuffle loses the order
    return lines.join(starts, "split").sortWithinPartitions("split", "at").select("split", "value", *columns)


def _whole(split: int, block: int, first: int, members: pa.Array, known: np.ndarray, texts: list[bytes]) -> pa.RecordBatch:
    """Elements that lie in one split, in order."""
    n = len(texts)
    same = lambda v: pa.array(np.full(n, v))
    columns = [same(split), same(block), pa.array(np.arange(first, first + n)), pa.nulls(n, S), members, pa.array(known), same(False), pa.nulls(n, I), pa.nulls(n, I), pa.array(texts, S)]
    return pa.RecordBatch.from_arrays(columns, [c for c, _ in PIECE])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements, pieces of elements and members of every split.

    Until a split names a member (``known``), all its elements are given without one.
    """
    now, open_ = None, b""

    def fragment() -> list[tuple]:
        return [(now, None, None, None, None, None, False, origin, block, open_.decode())] if now is not None and open_ else []

    for batch in batches:
        splits, rows = batch.column(0).to_numpy(zero_copy_only=False), []
        for lo, hi in runs_of(splits):
            data = _joined(batch.column(1).slice(lo, hi - lo))
            if splits[lo] != now:
                rows += fragment()
                now, seq, told, open_ = int(splits[lo]), 0, 0, b""
                inside, depth, block, target, origin = (batch.column(k)[lo].as_py() for k in range(2, 7))
                data = data if block else data.removeprefix(BOM)
                spans = depth > target  # an element of an earlier split is open
                current = ("records", True, True) if target == 1 else (None, True, False)
            level = Level(data, inside, depth)
            brace = level.bytes[level.at]
            starts = level.at[(level.step > 0) & (level.after == target + 1) & (brace == ord("{"))]
            ends = level.at[(level.step < 0) & (level.after == target) & (brace == ord("}"))] + 1
            members = level.members() if target == 2 else []
            for _, name, value in members:
                rows.append((now, block, told, value, name, None, False, None, None, None))
                told += 1
            events = [current, *((name, value.startswith("["), True) for _, name, value in members)]
            at_event = np.array([-1, *(at for at, _, _ in members)])
            array, known = (np.array([e[k] for e in events]) for k in (1, 2))
            of = lambda at: np.searchsorted(at_event, at) - 1
            for k in np.unique(of(level.plain(target))).tolist():
                if array[k]:
                    rows.append((now, block, None, None, events[k][0], events[k][2], True, None, None, None))
            if depth > target:
                stop = int(ends[0]) if len(ends) else len(data)
                open_ += data[:stop]
                if len(ends):
                    if current[1]:
                        rows.append((now, block, seq, None, current[0], current[2], False, origin if spans else None, block if spans else None, open_.decode()))
                        seq += 1
                    ends, open_, spans = ends[1:], b"", False
            which = of(starts[: len(ends)])
            kept = array[which]
            texts = [data[s:e] for s, e in zip(starts[: len(ends)][kept].tolist(), ends[kept].tolist())]
            if texts:
                which = which[kept]
                yield _whole(now, block, seq, pa.array([e[0] for e in events], S).take(pa.array(which)), known[which], texts)
                seq += len(texts)
            if len(starts) > len(ends):
                open_, origin = data[starts[-1] :], block
            inside, depth, current = level.ends_inside, level.end, events[-1]
        yield _rows(rows, PIECE)
    yield _rows(fragment(), PIECE)


class Documents:
    """A folder of JSON documents whose splits have been walked."""

    def __init__(self, spark: SparkSession, path: str):
        self.chunks = _chunks(spark, path)
        kept = shared_folder(spark)
        walks = self.chunks.select("split", FILE, BLOCK, "value").mapInArrow(_walk, schema(WALK))
        walks.groupBy(FILE).applyInArrow(_compose, schema(START)).write.parquet(kept)
        self.starts = spark.read.parquet(kept)
        bad = self.starts.filter("reason is not null").first()
        if bad is not None:
            raise TableError(f"{bad['reason']}: {bad['file']}")
        self.splits = self.starts.count()
        kept = shared_folder(spark)
        placed = _placed(self.chunks.drop(FILE, BLOCK), self.starts.select("split", "inside", "depth", BLOCK, "target", "origin"), ["inside", "depth", BLOCK, "target", "origin"])
        placed.mapInArrow(_cut, schema(PIECE)).write.parquet(kept)
        self.pieces = spark.read.parquet(kept)
        self.events = self.pieces.filter("event is not null").select("split", F.col("__at").alias("seq"), F.col("member").alias("name"), F.col("event").alias("value"))

    def members(self) -> DataFrame:
        """``file, name, value`` of every member of a top-level object; ``value`` is its first few characters."""
        return self.events.join(self.starts.select("split", "file"), "split").select("file", "name", "value")

    def elements(self) -> DataFrame:
        """``member, __file, __block, __at, text`` of every object in an array; the array of a top-level one is ``records``.

        An array that also holds something else than objects gives none.
        """
        last = self.events.groupBy("split").agg(F.max_by(F.struct("name", F.startswith("value", F.lit("[")).alias("array")), "seq").alias("last"))
        order = Window.partitionBy("file").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        held = self.starts.join(last, "split", "left").withColumn("held", F.last("last", True).over(order))
        files = self.starts.select("file").distinct().select("file", F.row_number().over(Window.orderBy("file")).cast("bigint").alias("number"))
        open_ = held.join(files, "file").select("split", "number", F.col("held.name").alias("name"), F.coalesce("held.array", F.col("target") == 1).alias("array"))
        member = F.when(F.col("known"), F.col("member")).when(~F.col("known") & F.col("array"), F.col("name"))
        placed = self.pieces.filter("event is null").join(bounded_broadcast(open_, self.splits), "split")
        pieces = placed.select("number", BLOCK, "__at", member.alias("member"), "plain", "origin", "piece", "text")
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda x: x["text"]), "")
        over = pieces.filter("piece is not null").groupBy("number", "origin").agg(F.max(BLOCK).alias(BLOCK), F.max("__at").alias("__at"), F.max("member").alias("member"), text.alias("text"))
        kept = ["number", "member", BLOCK, "__at", "text"]
        whole = pieces.filter("piece is null and not plain").select(*kept).unionByName(over.select(*kept)).filter("member is not null")
        plain = self.pieces.filter("plain").count()
        if plain:
            mixed = pieces.filter("plain and member is not null").select("number", "member").distinct()
            whole = whole.join(bounded_broadcast(mixed, plain), ["number", "member"], "left_anti")
        return whole.withColumnRenamed("number", FILE)


def numbered_elements(elements: DataFrame, splits: int = BROADCAST_ROWS + 1) -> DataFrame:
    """Elements of one member, from at most ``splits`` splits, with ``__source_record`` in document order: a place in the split plus the elements of earlier splits."""
    sizes = elements.groupBy(FILE, BLOCK).agg(F.count("*").alias("n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(FILE, BLOCK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select(FILE, BLOCK, (before - F.col("__first") + 1).alias("__shift"))  # one row for each split
    return elements.join(bounded_broadcast(shifts, splits), [FILE, BLOCK]).withColumn("__source_record", F.col("__at") + F.col("__shift"))
