"""Words of Arrow text columns as numpy arrays, n-gram hashes, and keys packed for the shuffle.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``. Those bytes never
occur inside a multi-byte UTF-8 character, so byte positions are exact.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LONG_WORD = 64

M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
S29, S32 = np.uint64(29), np.uint64(32)
LEFT = np.array([0] + [(1 << (8 * n)) - 1 for n in range(1, 8)] + [2**64 - 1], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> S32)) * M2
        h = (h ^ (h >> S29)) * M3
    return h ^ (h >> S32)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a sequence followed by another one."""
    with np.errstate(over="ignore"):
        return mix(a * M1 + b)


@dataclass
class Words:
    """Words of ``n`` texts: byte bounds in ``data``, and ``first[d]:first[d+1]`` are those of text ``d``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def per_text(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """Index of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), self.per_text)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word, eight bytes at a time."""
        size = self.end - self.start
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))
        with np.errstate(over="ignore"):
            h = size.astype(np.uint64) * M1
            some = np.flatnonzero(size <= LONG_WORD)
            for at in range(0, LONG_WORD, 8):
                some = some[size[some] > at] if at else some[size[some] > 0]
                if not len(some):
                    break
                piece = eight[self.start[some] + at] & LEFT[np.minimum(size[some] - at, 8)]
                h[some] = mix(h[some] ^ piece) * M1
        for i in np.flatnonzero(size > LONG_WORD):
            h[i] = xxhash.xxh64_intdigest(self.data[self.start[i] : self.end[i]])
        return h


def words_of(texts: pa.Array | pa.ChunkedArray, lower: bool = False, spaces: np.ndarray = SPACES) -> Words:
    """Null texts have no words. ``lower`` folds A-Z only; ``spaces`` marks the ASCII bytes between words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, values = texts.buffers()
    n = len(texts)
    at = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8) if offsets and n else np.zeros(1, np.int64)
    data = np.frombuffer(values, np.uint8)[at[0] : at[-1]] if values else np.zeros(0, np.uint8)
    at = at - at[0]
    if lower:
        data = LOWER[data]
    word = ~spaces[data]
    begins, ends = word.copy(), word.copy()
    if len(data):
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
        begins[edges] = word[edges]
        ends[edges - 1] = word[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(start, at))


def pack(values: np.ndarray) -> bytes:
    """Byte planes of a numeric array, compressed: the equal high bytes of sorted keys vanish."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes, kind: np.dtype | type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).reshape(-1)


def shard_cuts(shards: int) -> np.ndarray:
    """Inner borders that cut the 64-bit key space into equal ranges."""
    return np.array([(i << 64) // shards for i in range(1, shards)], np.uint64)


def block_count(df: DataFrame, text: str, block_bytes: int, least: int = 12) -> int:
    """How many blocks of about ``block_bytes`` the texts fill; never fewer than keep a few cores busy."""
    total = df.agg(F.sum(F.octet_length(F.col(text)).cast("long") + 1).alias("n")).first()["n"] or 0
    return max(least, -(-total // block_bytes))


def shared_path(spark: SparkSession, name: str) -> str:
    """New folder under the one that all executors share, which the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; on a cluster, whose
    machines do not share theirs, that is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="sedgetable-")
        spark.conf.set("spark.checkpoint.dir", base)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# What operators keep in a Python worker between tasks, with the call that frees it.
kept_in_worker: dict[str, Callable[[], None]] = {}


def handed_back() -> None:
    """Give free memory of this worker back to the system: workers stay through stages that run no Python."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def freed() -> None:
    """Free what other operators' tasks have left in this worker, which Spark uses again for any stage."""
    if kept_in_worker:
        for free in kept_in_worker.values():
            free()
        kept_in_worker.clear()
        gc.collect()
    handed_back()


def portions(texts: pa.Array, most: int = 2 << 20) -> list[pa.Array]:
    """Consecutive slices of about ``most`` bytes, or of one longer text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return []
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    out, lo = [], 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        out.append(texts.slice(lo, hi - lo))
        lo = hi
    return out
