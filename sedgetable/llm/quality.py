"""Quality classifier by importance resampling.

Two generative models over hashed byte n-grams, one of the labelled good texts and
one of all texts, give each document the log ratio of its probabilities. Gumbel noise
is added and the k highest keys are taken, which draws k documents without
replacement in proportion to their ratios. ``k`` is counted, not guessed: it is the
number of documents whose key lies above the cut that best tells labelled good from
labelled bad ones, so the draw takes as many documents as belong to the target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sedgetable.llm.words import freed, handed_back, portions, stored

GRAM = 4
BUCKETS = 1 << 16
# The only bounded sample: labelled rows, those of lowest hash, half to fit and half to set the cut.
LABELLED = 20_000
# Share of the labelled good rows that the cut must keep.
KEEP = 0.997
# The target model's smoothing: n-grams drawn from the raw model, and a count that every bucket has.
PRIOR, FLOOR = 5_000, 0.02
M = np.uint32(0x9E3779B1)
# Text whose n-grams are held at once.
PORTION = 1 << 19


def _buckets(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket of every n-gram of bytes, and how many n-grams each text has (none below ``GRAM`` bytes)."""
    for part in portions(texts, PORTION):
        at = np.frombuffer(part.buffers()[1], np.int64, len(part) + 1, part.offset * 8)
        data = np.frombuffer(part.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].astype(np.uint32)
        count = np.maximum(np.diff(at) - GRAM + 1, 0)
        if len(data) < GRAM:
            yield np.zeros(0, np.uint32), np.zeros(len(part), np.int64)
            continue
        key = data[: len(data) - GRAM + 1].copy()
        for k in range(1, GRAM):
            key |= data[k : len(data) - GRAM + 1 + k] << np.uint32(8 * k)
        begin = at[:-1] - at[0]
        edge = np.zeros(len(key) + 1, np.int32)
        np.add.at(edge, np.minimum(begin, len(key)), (count > 0).astype(np.int32))
        np.add.at(edge, np.minimum(begin + count, len(key)), -(count > 0).astype(np.int32))
        inside = np.cumsum(edge[:-1]) > 0
        yield ((key * M) >> np.uint32(16))[inside], count


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[np.ndarray, dict[int, int]]:
    """Log ratio of each bucket, and the labels (1 good, 0 bad) left for setting the cut.

    The raw model counts every document. The target model counts good rows of the
    labelled sample: quality 1 and not toxic. Bad are quality 0 and every toxic row.
    Counts are summed per task, then by bucket, so at most ``BUCKETS`` rows reach the driver.
    """
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    known = labels.filter(F.col(key).isNotNull() & (good | bad)).select(key, good.cast("int").alias("good"))
    # Rows of low hash are picked by a share first, so that all tasks together send on few more than the sample.
    share = min(1.0, 1.2 * LABELLED / max(1, known.count()))
    low = known.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))) if share < 1 else known
    sample = {r[0]: r[1] for r in low.orderBy(F.pmod(F.xxhash64(key), F.lit(1 << 30)), key).limit(LABELLED).collect()}
    ids = sorted(sample)
    target = np.array([i for n, i in enumerate(ids) if n % 2 == 0 and sample[i]], np.int64)
    held = {i: sample[i] for n, i in enumerate(ids) if n % 2}

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freed()
        raw, of_target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in rows:
            keys = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            is_target = np.isin(keys, target) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            lo = 0
            for bucket, n in _buckets(batch.column(1)):
                raw += np.bincount(bucket, minlength=BUCKETS)
                of_target += np.bincount(bucket[np.repeat(is_target[lo : lo + len(n)], n)], minlength=BUCKETS)
                lo += len(n)
        handed_back()
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(raw[seen]), pa.array(of_target[seen])], ["bucket", "raw", "target"])

    counted = docs.select(F.col(key).cast("bigint"), text).mapInArrow(count, "bucket bigint, raw bigint, target bigint")
    table = np.zeros((2, BUCKETS))
    for b, n_raw, n_target in counted.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).toLocalIterator():
        table[:, b] = n_raw, n_target
    raw = (table[0] + 0.5) / (table[0].sum() + 0.5 * BUCKETS)
    smooth = (table[1] + PRIOR * raw + FLOOR) / (table[1].sum() + PRIOR + FLOOR * BUCKETS)
    return np.log(smooth) - np.log(raw), held


def log_weight(text: Column, ratio: np.ndarray) -> Column:
    """Log of target over raw probability of a text; zero for null and for texts without an n-gram."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        freed()
        out = []
        for bucket, n in _buckets(texts):
            total = np.concatenate([[0.0], np.cumsum(ratio[bucket])])
            ends = np.cumsum(n)
            out.append(np.round(total[ends] - total[ends - n], 6))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return score(text)


def gumbel(key: Column, seed: int) -> Column:
    """Standard Gumbel noise that depends on the key and the seed alone."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_highest(keys: DataFrame, column: str, k: int) -> float | None:
    """The k-th highest value, exactly, by narrowing counted ranges of at most 4096 bins; None if k < 1."""
    span = keys.agg(F.count(column).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    if k < 1 or not span["n"]:
        return None
    if k >= span["n"]:
        return span["lo"]
    lo, hi, above = span["lo"], span["hi"], 0
    while lo < hi:
        width = (hi - lo) / 4096
        inside = keys.filter((F.col(column) >= lo) & (F.col(column) <= hi))
        bins = F.least(F.floor((F.col(column) - lo) / (width or 1.0)), F.lit(4095)) if width else F.lit(0)
        for r in sorted(inside.groupBy(bins.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect(), reverse=True):
            if above + r["n"] >= k:
                lo, hi = r["lo"], r["hi"]
                break
            above += r["n"]
    return lo


def classified(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", k: int | None = None, seed: int = 17) -> DataFrame:
    """``docs`` with ``log_weight``, ``gumbel_key`` and ``kept``, true for the k highest keys (ties included).

    Without ``k``, the cut on the labelled rows that were not fitted gives it. Null
    texts weigh zero, like empty ones. Repeated rows share their key and their fate.
    Without labelled good rows there is no target: every document is kept.
    """
    ratio, held = fit(docs, labels, key, text)
    weight = log_weight(F.col(text), ratio)
    noisy = docs.withColumn("log_weight", weight).withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col(key), seed))
    scores = stored(noisy.select(F.col(key).alias("k"), "gumbel_key"), "quality")
    if k is None:
        frame = docs.sparkSession.createDataFrame(list(held.items()) or [(None, None)], "k bigint, good int")
        pairs = scores.join(F.broadcast(frame), "k").select("gumbel_key", "good").collect()
        k = scores.filter(F.col("gumbel_key") >= F.lit(_cut(pairs))).count()
    least = kth_highest(scores, "gumbel_key", k)
    return noisy.withColumn("kept", F.lit(False) if least is None else F.col("gumbel_key") >= F.lit(least))


def _cut(pairs: list) -> float:
    """Cut with the best mean of both recalls, among those that keep the share ``KEEP`` of the good rows."""
    good, bad = (np.sort([p[0] for p in pairs if p[1] == g]) for g in (1, 0))
    if not len(good):
        return float("-inf")
    highest = good[min(len(good) - 1, int(np.ceil((1 - KEEP) * len(good))))]
    tries = np.unique(np.concatenate([good, bad]))
    tries = tries[tries <= highest]
    recall = 1 - np.searchsorted(good, tries) / len(good) + np.searchsorted(bad, tries) / max(1, len(bad))
    return float(tries[np.argmax(recall)])
