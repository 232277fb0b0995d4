"""Repeated word windows, found by prefix-partitioned suffix trees cut at the window's length.

Every word position starts a suffix. Suffixes are split by their first words into
groups that fit a task: a group's prefix is as short as its number of suffixes
allows, and grows to 2, 4, 8 words or the whole window where many suffixes share it.
In a group the suffixes are sorted by the hash of their path down to the window's
length; equal neighbours meet in an internal node at that depth, and the node's
first leaf in document order is the occurrence that stays. Deeper nodes need no
look: a longer repeat is a run of such windows, so merging the windows of a document
gives its maximal repeats.

Texts are dealt to blocks in key order. A block sends each path once, and per path
gets back one bit: whether an earlier block holds it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sedgetable.llm.words import block_count, freed, joined, pack, portions, unpack, words_of

BLOCK_BYTES = 4 << 20
LADDER = (1, 2, 4, 8)
CLASSES = 1 << 12
GROUP = 1 << 18


def _paths(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position on (the last ``size - 1`` positions have none)."""
    powers, out, done = {1: h}, None, 0
    width = 1
    while 2 * width <= size:
        powers[2 * width] = joined(powers[width][:-width], powers[width][width:])
        width *= 2
    for width in sorted(powers, reverse=True):
        if done + width <= size:
            part = powers[width][done:]
            out = part if out is None else joined(out[: len(part)], part)
            done += width
    return out[: max(0, len(h) - size + 1)]


def _windows(texts: pa.Array | pa.ChunkedArray, size: int):
    """Words of the texts, with the start position, path and prefix classes of every window."""
    words = words_of(texts)
    h = words.hashes()
    room = words.first[1:][words.text] - np.arange(len(h)) >= size
    at = np.flatnonzero(room)
    path = _paths(h, size)[at] if len(at) else np.zeros(0, np.uint64)
    return words, h, at, path


def _prefix_classes(h: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    return (_paths(h, length)[at] >> np.uint64(52)).astype(np.int64) if len(at) else np.zeros(0, np.int64)


def _bounds(docs: DataFrame, count: int) -> np.ndarray:
    """Keys that cut the table into about ``count`` ranges; as many numbers as blocks."""
    got = docs.select("k").agg(F.percentile_approx("k", [i / count for i in range(1, count)], F.lit(10_000)).alias("q")).first()["q"] if count > 1 else []
    return np.unique(np.array(got or [], np.int64))


def _sorted(table: pa.Table) -> pa.Table:
    """Rows of a block in key order; null keys come first, and rows with one key go by text."""
    return table.sort_by([("k", "ascending"), ("text", "ascending")], null_placement="at_start") if len(table) else table


def repeated_words(docs: DataFrame, key: str, text: str, size: int, shape, schema: str) -> DataFrame:
    """Apply ``shape(table, words, removed)`` to each block, where ``removed`` marks words to go.

    ``table`` has the key as ``k``, the text as ``text``, and the other columns of
    ``docs``, whose names must differ from those and from ``block``. Both passes read
    the same exchange, so texts are shuffled once.
    """
    rest = [c for c in docs.columns if c not in (key, text)]
    source = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("text"), *rest)
    count = block_count(source, "text", BLOCK_BYTES)
    bounds = _bounds(source, count)

    @F.arrow_udf("int")
    def block_of(keys: pa.Array) -> pa.Array:
        place = np.searchsorted(bounds, keys.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), "right")
        return pa.array(place, pa.int32())

    blocks = len(bounds) + 1
    by_block = source.withColumn("block", block_of("k")).repartition(blocks, "block")

    def tally(batches):
        """Suffixes per prefix length and class: the sizes that decide each group's prefix."""
        sums = np.zeros((len(LADDER), CLASSES), np.int64)
        for batch in batches:
            for part in portions(batch.column(0)):
                _, h, at, _ = _windows(part, size)
                for row, length in enumerate(LADDER):
                    if length <= size:
                        sums[row] += np.bincount(_prefix_classes(h, at, length), minlength=CLASSES)
        row, cls = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(cls), pa.array(sums[row, cls])], ["row", "cls", "n"])

    sizes = np.zeros((len(LADDER), CLASSES), np.int64)
    for r in source.select("text").mapInArrow(tally, "row bigint, cls bigint, n bigint").groupBy("row", "cls").agg(F.sum("n").alias("n")).collect():
        sizes[r["row"], r["cls"]] = r["n"]
    total = int(sizes[0].sum())
    limit = max(GROUP, total // (4 * blocks))
    groups = max(blocks, -(-total // GROUP) // 4)

    def group_of(h: np.ndarray, at: np.ndarray, path: np.ndarray) -> np.ndarray:
        """Group of each suffix: by the shortest prefix whose class is small enough, else by the whole path."""
        code = path >> np.uint64(8)
        open_ = np.ones(len(at), bool)
        for row, length in enumerate(LADDER):
            if length <= size:
                cls = _prefix_classes(h, at, length)
                fits = open_ & (sizes[row][cls] <= limit)
                code[fits] = (cls[fits] * len(LADDER) + row).astype(np.uint64)
                open_ &= ~fits
        return (joined(code, code) % np.uint64(groups)).astype(np.int64)

    def order(table: pa.Table):
        words, h, at, path = _windows(table["text"], size)
        group = group_of(h, at, path)
        by = np.lexsort((path, group))
        first = np.ones(len(by), bool)
        first[1:] = (path[by][1:] != path[by][:-1]) | (group[by][1:] != group[by][:-1])
        return words, at, path, group, by, first

    def send(table: pa.Table) -> pa.Table:
        freed()
        block = table["block"][0].as_py()
        _, _, path, group, by, first = order(_sorted(table))
        path, group = path[by][first], group[by][first]
        names, begin = np.unique(group, return_index=True)
        blobs = [pack(p) for p in np.split(path, begin[1:])] if len(names) else []
        return pa.table({"g": pa.array(names, pa.int32()), "block": pa.array([block] * len(names), pa.int32()), "paths": pa.array(blobs, pa.binary())})

    def subtree(table: pa.Table) -> pa.Table:
        """Sort a group's suffixes by path, then block: a leaf after the first of its node repeats an earlier one."""
        freed()
        table = table.sort_by("block")
        lists = [unpack(b.as_buffer(), np.uint64) for b in table["paths"]]
        path = np.concatenate(lists)
        by = np.argsort(path, kind="stable")
        again = np.zeros(len(path), bool)
        again[by[1:]] = path[by][1:] == path[by][:-1]
        flags = np.split(again, np.cumsum([len(p) for p in lists])[:-1])
        return pa.table({"block": table["block"], "g": table["g"], "again": pa.array([pack(np.packbits(f)) for f in flags], pa.binary())})

    def answer(docs_: pa.Table, bits: pa.Table) -> pa.Table:
        freed()
        docs_ = _sorted(docs_)
        words, at, path, group, by, first = order(docs_)
        earlier = np.zeros(int(first.sum()), bool)
        firsts = group[by][first]
        for g, blob in zip(bits["g"].to_pylist(), bits["again"]):
            lo, hi = np.searchsorted(firsts, [g, g + 1])
            earlier[lo:hi] = np.unpackbits(unpack(blob.as_buffer(), np.uint8), count=hi - lo)
        node = np.cumsum(first) - 1
        repeats = np.zeros(len(at), bool)
        repeats[by] = ~first | earlier[node]  # the sort is stable, so the first of a path is its first position
        edge = np.zeros(len(words.start) + 1, np.int32)
        np.add.at(edge, at[repeats], 1)
        np.add.at(edge, at[repeats] + size, -1)
        return shape(docs_, words, np.cumsum(edge[:-1]) > 0)

    sent = by_block.groupBy("block").applyInArrow(send, "g int, block int, paths binary")
    told = sent.groupBy("g").applyInArrow(subtree, "block int, g int, again binary")
    return by_block.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(answer, schema)


def _kept_texts(words, removed: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Kept words of each text joined by one space, and the words and removed words it has."""
    n = words.per_text
    gone = np.concatenate([[0], np.cumsum(removed)])
    lost = gone[words.first[1:]] - gone[words.first[:-1]]
    data, out = words.data.tobytes(), []
    for d in range(len(n)):
        lo, hi = words.first[d], words.first[d + 1]
        if lost[d] == 0:
            out.append(b" ".join(data[words.start[lo] : words.end[hi - 1]].split()) if hi > lo else b"")
        else:
            kept = lo + np.flatnonzero(~removed[lo:hi])
            out.append(b" ".join([data[s:e] for s, e in zip(words.start[kept].tolist(), words.end[kept].tolist())]))
    return out, n, lost


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 20) -> DataFrame:
    """``key, n_words, n_removed, kept_sha256`` per row.

    A word goes if a window over it has a word sequence that starts earlier: at a
    smaller key, or before it in the same document. Null keys come before all
    others; rows with equal keys count as one after the other, in text order. Null
    and blank texts have no words. Windows are judged on the input alone.
    """

    def shape(table: pa.Table, words, removed: np.ndarray) -> pa.Table:
        kept, n, lost = _kept_texts(words, removed)
        sha = [hashlib.sha256(t).hexdigest() for t in kept]
        return pa.table({"k": table["k"], "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(lost, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    out = repeated_words(docs.select(key, text), key, text, size, shape, "k bigint, n_words bigint, n_removed bigint, kept_sha256 string")
    return out.withColumnRenamed("k", key)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 20) -> DataFrame:
    """``docs`` with repeated windows cut out of ``text``; texts without one stay byte for byte.

    All other columns and all rows stay, also where nothing is left of a text.
    """
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    at = {c: f"c{i}" for i, c in enumerate(names)}
    schema = ", ".join(f"c{i} {'bigint' if f.name == key else f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))

    def renamed(table: pa.Table, words, removed: np.ndarray) -> pa.Table:
        kept, _, lost = _kept_texts(words, removed)
        old = table["text"].to_pylist()
        new = pa.array([t.decode() if l else o for t, l, o in zip(kept, lost, old)], pa.string())
        return pa.table({c: new if c == at[text] else table["k" if c == at[key] else c] for c in at.values()})

    out = repeated_words(plain, at[key], at[text], size, renamed, schema)
    return out.select(*[F.col(f"c{i}").cast(f.dataType).alias(f.name) for i, f in enumerate(docs.schema.fields)])


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 20) -> DataFrame:
    """``key, start_word, n_words`` of every maximal run of repeated words."""

    def shape(table: pa.Table, words, removed: np.ndarray) -> pa.Table:
        doc = words.text
        cut = np.flatnonzero(removed)
        opens = cut[np.concatenate([[True], (np.diff(cut) > 1) | (np.diff(doc[cut]) > 0)])] if len(cut) else cut
        closes = cut[np.concatenate([(np.diff(cut) > 1) | (np.diff(doc[cut]) > 0), [True]])] if len(cut) else cut
        of = doc[opens]
        return pa.table({"k": table["k"].take(pa.array(of)), "start_word": pa.array(opens - words.first[of], pa.int64()), "n_words": pa.array(closes - opens + 1, pa.int64())})

    return repeated_words(docs.select(key, text), key, text, size, shape, "k bigint, start_word bigint, n_words bigint").withColumnRenamed("k", key)
