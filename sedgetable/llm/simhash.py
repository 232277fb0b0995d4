"""SimHash near-duplicates with pigeonring filtering.

A fingerprint is cut into ``bits + 1`` segments on a ring. If two fingerprints
differ in at most ``bits`` bits, some segment starts a chain in which the first l
segments together differ in at most ``l * bits / segments`` bits, for every l. So the
first segment is equal, which gives the buckets to meet in, and each longer chain
must keep its budget before the whole distance is counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from sedgetable.llm.graph import components
from sedgetable.llm.words import SPACES, portions, stored, words_of

BLANK = np.where(SPACES, 32, np.arange(256)).astype(np.uint8)
LANES = np.uint64(0x0101010101010101)
CHUNK = 1 << 16
PIECE = 8192
GROUP_ROWS = 100_000


def _shingles(texts: pa.Array, size: int) -> tuple[list[bytes] | Iterator[bytes], np.ndarray]:
    """Shingles in order, and how many each text has. A shorter text is one shingle, an empty one none."""
    words = words_of(texts, lower=True)
    n = words.per_text
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), count)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    left = words.first[:-1][doc] + within
    right = np.minimum(left + size, words.first[1:][doc]) - 1
    start, end = words.start[left], words.end[right]
    length = np.concatenate([[0], np.cumsum(words.end - words.start)])
    single = end - start == length[right + 1] - length[left] + right - left
    data = BLANK[words.data].tobytes()

    def each() -> Iterator[bytes]:
        for lo in range(0, len(left), CHUNK):
            cut = slice(lo, lo + CHUNK)
            if single[cut].all():
                yield from (data[s:e] for s, e in zip(start[cut].tolist(), end[cut].tolist()))
            else:
                yield from (b" ".join(data[s:e].split()) for s, e in zip(start[cut].tolist(), end[cut].tolist()))

    return each(), count


def _majority(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Per text the bits that more than half of its hashes have.

    One bit of each byte is added up at a time, in eight lanes of a word, over at
    most 255 hashes before a lane could overflow.
    """
    out = np.zeros(len(count), np.uint64)
    some = np.flatnonzero(count)
    if not len(some):
        return out
    ends = np.cumsum(count[some])
    starts = ends - count[some]
    cuts = np.unique(np.concatenate([starts, np.concatenate([np.arange(s, e, 255) for s, e in zip(starts[count[some] > 255], ends[count[some] > 255])] or [starts[:0]])]))
    of_text = np.searchsorted(cuts, starts)
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & LANES, cuts)
        lanes = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), of_text, axis=0)
        on = 2 * lanes > count[some][:, None]
        out[some] |= (on << (8 * np.arange(8) + bit).astype(np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(texts: pa.Array, shingle: int, seed: int) -> np.ndarray:
    out = [np.zeros(0, np.uint64)]
    for part in portions(texts):
        each, count = _shingles(part, shingle)
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(s, seed) for s in each), np.uint64, int(count.sum()))
        out.append(_majority(hashes, count))
    return np.concatenate(out)


def fingerprint(text: Column, shingle: int = 4, seed: int = 42) -> Column:
    """64-bit SimHash as ``bigint``; zero for null, empty and blank texts."""

    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(fingerprints(texts, shingle, seed).view(np.int64))

    return of(text)


def _segments(count: int) -> list[tuple[int, int]]:
    """Offset and width of each segment of 64 bits."""
    cuts = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def ring_links(cell: np.ndarray, side: np.ndarray, segment: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the rows of each cell (sorted) that differ in at most ``bits`` bits.

    Rows are compared with the d-th next row of their cell for d = 1, 2, ...; a pair
    whose rows are linked already is dropped at once, so a large group of near copies
    gives as many links as it has rows, not as many as it has pairs.
    """
    ring = _segments(bits + 1)
    masks = np.zeros((len(ring), len(ring) + 1), np.uint64)
    for s in range(len(ring)):
        width = 0
        for length in range(1, len(ring) + 1):
            width += ring[(s + length - 1) % len(ring)][1]
            masks[s, length] = (1 << width) - 1
    turn = np.array([a for a, _ in ring], np.uint64)[segment]
    back = (np.uint64(64) - turn) & np.uint64(63)
    n = len(cell)
    last = np.searchsorted(cell, cell, "right")
    first = np.searchsorted(cell, cell, "left")
    label = np.arange(n)
    near, d = np.arange(n), 0
    while True:
        d += 1
        near = near[near + d < last[near]]
        if not len(near):
            break
        i = near[(label[near] != label[near + d]) & (side[near] != side[near + d])]
        x = fp[i] ^ fp[i + d]
        x = (x >> turn[i]) | (x << back[i])
        for length in range(2, len(ring) + 1):
            keep = np.bitwise_count(x & masks[segment[i], length]) <= length * bits // len(ring)
            i, x = i[keep], x[keep]
        for k in i.tolist():
            a, b = label[k], label[k + d]
            if a != b:
                part = slice(first[k], last[k])
                label[part][label[part] == max(a, b)] = min(a, b)
    linked = np.flatnonzero(label != np.arange(n))
    return fp[linked], fp[label[linked]]


def near_links(fps: DataFrame, bits: int = 4) -> DataFrame:
    """Links ``a, b`` that join all fingerprints (column ``fp``, distinct) within ``bits`` bits.

    Buckets are (segment, value): there are at most ``(bits + 1) * 2**ceil(64 / (bits + 1))``,
    so their sizes may be broadcast. A bucket above ``PIECE`` rows is cut into
    pieces, and every two pieces meet in a cell of their own.
    """
    ring = _segments(bits + 1)
    parts = F.array(*[F.struct(F.lit(s).alias("segment"), F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << w) - 1)).alias("value")) for s, (a, w) in enumerate(ring)])
    rows = fps.select("fp", F.explode(parts).alias("p")).select("fp", "p.*")
    sizes = stored(rows.groupBy("segment", "value").agg(F.count("*").alias("n")), "buckets")
    pieces = F.ceil(F.col("n") / PIECE).cast("int")
    total = sizes.agg(F.sum(F.col("n") * pieces).alias("t")).first()["t"] or 0
    groups = max(12, -(-total // GROUP_ROWS))
    meets = rows.join(F.broadcast(sizes.filter("n > 1")), ["segment", "value"]).withColumn("k", pieces)
    meets = meets.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    cell = F.xxhash64("segment", "value", lo, hi)
    side = F.when(lo == hi, F.xxhash64("fp")).otherwise(F.col("own").cast("long"))
    cells = meets.select(F.pmod(cell, F.lit(groups)).cast("int").alias("g"), cell.alias("cell"), side.alias("side"), "segment", "fp")

    def link(table: pa.Table) -> pa.Table:
        order = np.argsort(table["cell"].to_numpy(), kind="stable")
        cell, side, segment, fp = (table[c].to_numpy()[order] for c in ("cell", "side", "segment", "fp"))
        a, b = ring_links(cell, side, segment, fp.view(np.uint64), bits)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return cells.groupBy("g").applyInArrow(link, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, seed: int = 42, bits: int = 4) -> DataFrame:
    """``key, fingerprint, component_id`` of every row of ``docs``.

    Fingerprints link at ``bits`` or fewer differing bits; ``component_id`` is the
    least key reachable over links. Equal fingerprints are compared once. Null keys
    are kept and never chosen as component, unless all keys of a component are null.
    Null and blank texts have fingerprint zero. Repeated rows stay.
    """
    marked = stored(docs.select(F.col(key).alias("k"), fingerprint(F.col(text), shingle, seed).alias("fp")), "fingerprints")
    least = marked.groupBy("fp").agg(F.min("k").alias("k"))
    roots = components(near_links(least.select("fp"), bits), "a", "b")
    rooted = least.join(roots, least["fp"] == roots["node"], "left").select(least["fp"], F.coalesce("root", "fp").alias("root"), "k")
    firsts = rooted.groupBy("root").agg(F.min("k").alias("component_id"))
    of_fp = stored(rooted.join(firsts, "root").select("fp", "component_id"), "components")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(of_fp, "fp").select(F.col("k").alias(key), digits.alias("fingerprint"), "component_id")
