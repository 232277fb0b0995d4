"""Shards of near equal bytes by k-d tree partitioning.

The root holds all documents. A node that is to give m shards is split at the
weighted median, or the m // 2 : m - m // 2 point, of its widest metadata dimension,
until each leaf has its target of bytes. All nodes of a level are split together, and
each median is exact: the bytes of every node are counted in bins between its bounds,
the bin that holds the median becomes the new bounds, and so on down to one document.
Equal coordinates are ordered by a hash of the row, equal rows by a number, so a
value that most documents share is split like any other.

Only bins travel, added up per task. The driver holds one cut for each node, of which
there are fewer than shards.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sedgetable.llm.ranks import numbered
from sedgetable.llm.words import stored

BINS, LEAST_BINS, ALL_BINS = 1024, 16, 1 << 20
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
PREFIX = 7


def coordinate(df: DataFrame, name: str) -> Column:
    """A dimension as ``bigint`` in its own order: whole numbers, dates and times as they are, texts by their first seven bytes."""
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("bigint")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("bigint")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), 1, PREFIX)), 2 * PREFIX, "0"), 16, 10).cast("bigint")
    raise ValueError(f"{name}: a dimension is a whole number, a date, a time or a text")


@dataclass
class Cut:
    """How far the search for a node's median has come: which component, between which bounds, and the bytes before them."""

    dim: int
    want: int  # bytes that should go left
    low: int
    high: int
    before: int = 0
    fixed: list[int] = field(default_factory=list)  # components found so far
    upto: bool = True  # whether the row found goes left


class Tree:
    """Nodes in the order of their making; rows go left where their components are below the cut."""

    def __init__(self, shards: int):
        self.shards, self.first = [shards], [0]
        self.left: list[int] = [-1]
        self.cuts: list[Cut | None] = [None]

    def split(self, node: int, cut: Cut) -> None:
        m = self.shards[node]
        self.cuts[node], self.left[node] = cut, len(self.shards)
        for shards, first in ((m // 2, self.first[node]), (m - m // 2, self.first[node] + m // 2)):
            self.shards.append(shards)
            self.first.append(first)
            self.left.append(-1)
            self.cuts.append(None)

    def place(self, coords: np.ndarray, tie: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Node of each row, as far down as the tree goes. ``coords`` has a row for each dimension."""
        left, cuts = np.array(self.left), self.cuts
        fixed = np.zeros((3, len(left)), np.int64)
        depth, dim, upto = (np.zeros(len(left), np.int64) for _ in range(3))
        for i, cut in enumerate(cuts):
            if cut:
                fixed[: len(cut.fixed), i] = cut.fixed
                depth[i], dim[i], upto[i] = len(cut.fixed), cut.dim, cut.upto
        node, rows = np.zeros(coords.shape[1], np.int64), np.arange(coords.shape[1])
        while True:
            rows = rows[left[node[rows]] >= 0]
            if not len(rows):
                return node
            at = node[rows]
            below, equal = np.zeros(len(rows), bool), np.ones(len(rows), bool)
            for k, value in enumerate((coords[dim[at], rows], tie[rows], number[rows])):
                used = k < depth[at]
                below |= used & equal & (value < fixed[k, at])
                equal &= ~used | (value == fixed[k, at])
            goes_left = below | (equal & (upto[at] > 0))
            node[rows] = left[at] + ~goes_left


def _columns(batch: pa.RecordBatch, least: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, coordinates with nulls as the least value, hash and number of each row."""
    take = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
    coords = [batch.column(f"c{k}").fill_null(low).to_numpy(zero_copy_only=False) for k, low in enumerate(least)]
    return take("size"), np.stack(coords) if coords else np.zeros((0, len(batch)), np.int64), take("tie"), take("number")


def _extents(rows: DataFrame, tree: Tree, open_nodes: Sequence[int], least: Sequence[int]) -> dict[int, tuple[int, list[tuple[int, int]]]]:
    """Bytes of each open node, and the bounds of each dimension in it."""
    dims = len(least)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(tree.left)
        total, low, high = np.zeros(n, np.int64), np.full((dims, n), HIGHEST), np.full((dims, n), LOWEST)
        for batch in batches:
            size, coords, tie, number = _columns(batch, least)
            node = tree.place(coords, tie, number)
            np.add.at(total, node, size)
            for k in range(dims):
                np.minimum.at(low[k], node, coords[k])
                np.maximum.at(high[k], node, coords[k])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some]), *[pa.array(x[k][some]) for k in range(dims) for x in (low, high)]], ["node", "total", *[f"{x}{k}" for k in range(dims) for x in ("low", "high")]])

    bounds = [f"{x}{k} bigint" for k in range(dims) for x in ("low", "high")]
    parts = rows.mapInArrow(measure, ", ".join(["node bigint", "total bigint", *bounds]))
    folded = [f(f"{x}{k}").alias(f"{x}{k}") for k in range(dims) for x, f in (("low", F.min), ("high", F.max))]
    found = parts.filter(F.col("node").isin(list(open_nodes))) if len(open_nodes) < 1000 else parts
    # One row for each open node, fewer than there are shards.
    return {r["node"]: (r["total"], [(r[f"low{k}"], r[f"high{k}"]) for k in range(dims)]) for r in found.groupBy("node").agg(F.sum("total").alias("total"), *folded).collect() if r["node"] in set(open_nodes)}


def _narrowed(rows: DataFrame, tree: Tree, cuts: dict[int, Cut], least: Sequence[int]) -> dict[int, tuple[int, int, int, int, int]]:
    """For each cut the bin that holds it: bytes before it and in it, rows, least and greatest component."""
    nodes = np.array(sorted(cuts))
    bins = max(LEAST_BINS, min(BINS, ALL_BINS // len(nodes)))
    low = np.array([cuts[i].low for i in nodes])
    # Offsets from the lower bound fit 64 bits without sign.
    width = np.array([(cuts[i].high - cuts[i].low) // bins + 1 for i in nodes], np.uint64)
    depth = np.array([len(cuts[i].fixed) for i in nodes])
    dim = np.array([cuts[i].dim for i in nodes])
    fixed = np.array([[*cuts[i].fixed, 0, 0][:2] for i in nodes])
    high = np.array([cuts[i].high for i in nodes])
    want = np.array([cuts[i].want - cuts[i].before for i in nodes])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size_of = len(nodes) * bins
        total, n, lowest, highest = np.zeros(size_of, np.int64), np.zeros(size_of, np.int64), np.full(size_of, HIGHEST), np.full(size_of, LOWEST)
        slot_of = np.full(len(tree.left), -1)
        slot_of[nodes] = np.arange(len(nodes))
        for batch in batches:
            size, coords, tie, number = _columns(batch, least)
            slot = slot_of[tree.place(coords, tie, number)]
            some = np.flatnonzero(slot >= 0)
            s = slot[some]
            parts = coords[dim[s], some], tie[some], number[some]
            d = depth[s]
            value = np.choose(d, parts)
            inside = (value >= low[s]) & (value <= high[s])
            for k in range(2):
                inside &= (d <= k) | (parts[k] == fixed[s, k])
            s, value, size = s[inside], value[inside], size[some][inside]
            at = s * bins + ((value.view(np.uint64) - low[s].view(np.uint64)) // width[s]).astype(np.int64)
            np.add.at(total, at, size)
            np.add.at(n, at, 1)
            np.minimum.at(lowest, at, value)
            np.maximum.at(highest, at, value)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (nodes[seen // bins], seen % bins, want[seen // bins], total[seen], n[seen], lowest[seen], highest[seen])], ["node", "bin", "want", "total", "n", "low", "high"])

    parts = rows.mapInArrow(count, "node bigint, bin bigint, want bigint, total bigint, n bigint, low bigint, high bigint")
    whole = parts.groupBy("node", "bin", "want").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    run = whole.withColumn("upto", F.sum("total").over(Window.partitionBy("node").orderBy("bin")))
    hit = run.filter((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("total") < F.col("want")))
    return {r["node"]: (r["upto"] - r["total"], r["total"], r["n"], r["low"], r["high"]) for r in hit.collect()}  # one row for each node


def grown(rows: DataFrame, shards: int, dims: int) -> tuple[Tree, list[int]]:
    """The tree for ``shards`` leaves over ``size, c0.., tie, number``, and the least coordinates."""
    bounds = rows.agg(F.lit(0), *[F.coalesce(f(f"c{k}"), F.lit(0)) for k in range(dims) for f in (F.min, F.max)]).first()
    least = [bounds[1 + 2 * k] for k in range(dims)]
    whole = [max(1, bounds[2 + 2 * k] - least[k]) for k in range(dims)]
    tree = Tree(shards)
    open_nodes = [0] if shards > 1 else []
    while open_nodes:
        extents = _extents(rows, tree, open_nodes, least)
        cuts = {}
        for node in open_nodes:
            total, spans = extents.get(node, (0, []))
            if not total:
                tree.split(node, Cut(0, 0, 0, 0, fixed=[HIGHEST]))  # nothing to part
                continue
            dim = max(range(len(spans)), key=lambda k: ((spans[k][1] - spans[k][0]) / whole[k], -k))
            m = tree.shards[node]
            cuts[node] = Cut(dim, -(-total * (m // 2) // m), *spans[dim])
        while cuts:
            found = _narrowed(rows, tree, cuts, least)
            done = []
            for node, (before, total, n, low, high) in found.items():
                cut = cuts[node]
                cut.before += before
                if low < high:
                    cut.low, cut.high = low, high
                    continue
                cut.fixed.append(low)
                if n == 1:
                    cut.upto = cut.before + total - cut.want <= cut.want - cut.before
                    done.append(node)
                else:
                    cut.low, cut.high = LOWEST, HIGHEST
            ready = {node: cuts.pop(node) for node in done}
            for node, cut in ready.items():
                tree.split(node, cut)
        open_nodes = [i for i, left in enumerate(tree.left) if left < 0 and tree.shards[i] > 1]
    return tree, least


def sharded(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, key: str = "doc_id", text: str = "text", dimensions: Sequence[str] = ("source", "lang", "n_chars", "doc_id")) -> DataFrame:
    """``key, size, text_crc32, law, shard, slot, grown_shard`` of every row of ``docs``.

    The law is ``bytes``: ``shards`` shards, or as many as ``target_bytes`` asks for,
    of near equal sums of ``size``, the UTF-8 bytes of the text plus one. At each cut
    the document on the border goes to the side that it brings nearer to its target.
    ``slot`` counts from 0 in each shard by ascending key, null first. A null text is
    empty; a null in a dimension counts as the least value. Repeated rows may part,
    and which of them goes where does not show. With fewer documents than shards some
    shards are empty. ``grown_shard`` is null, as it belongs to another law. Of
    several dimensions that are equally wide the first is taken. Other columns are
    not read.
    """
    if (shards is None) == (target_bytes is None):
        raise ValueError("give either shards or target_bytes")
    body = F.coalesce(F.col(text), F.lit(""))
    coords = [coordinate(docs, c).alias(f"c{k}") for k, c in enumerate(dimensions)]
    rows = docs.select(F.col(key).alias("id"), (F.octet_length(body).cast("bigint") + 1).alias("size"), F.crc32(body.cast("binary")).alias("crc"), *coords)
    rows = rows.withColumn("tie", F.xxhash64(*rows.columns)).withColumn("number", F.monotonically_increasing_id())
    rows = stored(rows, "sizes")
    if shards is None:
        shards = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    tree, least = grown(rows.drop("id", "crc"), shards, len(coords))
    kind = rows.schema["id"].dataType.simpleString()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.array(tree.first)
        for batch in batches:
            _, coords, tie, number = _columns(batch, least)
            shard = first[tree.place(coords, tie, number)].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "size", "crc", "tie", "number")], pa.array(shard)], ["id", "size", "crc", "tie", "number", "shard"])

    dealt = rows.mapInArrow(placed, f"id {kind}, size bigint, crc bigint, tie bigint, number bigint, shard int")
    slots = numbered(dealt, ["shard"], [F.col("id"), F.col("tie"), F.col("number")], "slot")
    return slots.select(F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
