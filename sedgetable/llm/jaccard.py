"""Near copies by SimHash fingerprints and the Jaccard similarity of their word shingles.

Fingerprints of the shingles that differ in a few bits meet by the ring search of
:mod:`simhash`; as two texts of similarity 0.8 differ in about ten bits of 64, those that
fingerprints leave apart meet by minima as well. 128 minima over the shingles of a text give 32 buckets of four; texts meet in a bucket
and are compared by their shingles themselves, so no bucket decides a link. Two texts
of similarity 0.8 share no bucket with a chance of (1 - 0.8**4)**32, about 5e-8, and
closer ones less. A bucket's texts are first compared with its least and its highest
one; after that only texts that are not linked yet are compared with one another, so
a large group of near copies is not compared pair by pair. Of the buckets that two
texts share only the first brings them together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F

from sedgetable.llm.graph import components
from sedgetable.llm.simhash import fingerprint, near_links
from sedgetable.llm.words import M1, M2, freed, joined, mix, portions, stored, words_of

BANDS, ROWS = 32, 4
SKETCH = 16  # words of 64 bits
# Text that is held as words at once, of single texts and of pairs.
PORTION, PAIR_BYTES = 1 << 19, 1 << 20


def _grams(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every distinct shingle, sorted. A shorter text is one shingle, an empty one none."""
    words = words_of(texts, lower=True)
    n = words.per_text
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), count)
    at = words.first[:-1][doc] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    hashes = words.hashes()
    gram = np.minimum(n, size)[doc].astype(np.uint64)
    for k in range(size):
        some = np.flatnonzero(n[doc] > k)
        gram[some] = joined(gram[some], hashes[at[some] + k])
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
    return doc[new], gram[new]


def _digests(doc: np.ndarray, gram: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each text's set of shingles (zero if empty); texts that have some, and where theirs begin."""
    out = np.zeros(n, np.uint64)
    some, first = np.unique(doc, return_index=True)
    if len(some):
        out[some] = mix(np.add.reduceat(mix(gram + M1), first))
    return out, some, first


def parities(doc: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
    """Sketch of each text: bit by bit whether an odd number of its shingles hash there."""
    out = np.zeros(n * SKETCH, np.uint64)
    bit = mix(gram + M2) % np.uint64(64 * SKETCH)
    np.bitwise_xor.at(out, doc * SKETCH + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out.reshape(n, SKETCH)


def _signed(texts: pa.Array, size: int, bands: bool) -> pa.Array:
    freed()
    digests, sizes, buckets, sketches = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros((0, BANDS), np.uint64)], [np.zeros((0, SKETCH), np.uint64)]
    turn = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * M1)
    for part in portions(texts, PORTION):
        doc, gram = _grams(part, size)
        digest, some, first = _digests(doc, gram, len(part))
        digests.append(digest)
        sizes.append(np.bincount(doc, minlength=len(part)))
        if bands:
            out = np.zeros((len(part), BANDS), np.uint64)
            for b in range(BANDS if len(some) else 0):
                key = np.full(len(some), b, np.uint64)
                for k in range(b * ROWS, (b + 1) * ROWS):
                    key = joined(key, np.minimum.reduceat((gram ^ turn[2 * k]) * (turn[2 * k + 1] | np.uint64(1)), first))
                out[some, b] = key
            buckets.append(out)
            sketches.append(parities(doc, gram, len(part)))
    digest = pa.array(np.concatenate(digests).view(np.int64))
    if not bands:
        return digest
    lists = []
    for rows in (np.concatenate(buckets), np.concatenate(sketches)):
        ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
        lists.append(pa.ListArray.from_arrays(ends, pa.array(rows.reshape(-1).view(np.int64))))
    return pa.StructArray.from_arrays([digest, pa.array(np.concatenate(sizes)), *lists], ["d", "n", "buckets", "sketch"])


def similar(left: pa.Array, right: pa.Array, size: int, percent: int) -> np.ndarray:
    """Whether the shingles of each pair of texts have a Jaccard similarity of at least ``percent`` in 100."""
    out = [np.zeros(0, bool)]
    sizes = sum(pa.compute.binary_length(x).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (left, right))
    part = np.cumsum(sizes) // PAIR_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(left)]
    for lo, hi in zip(cuts, cuts[1:]):
        sides = [_grams(x.slice(lo, hi - lo), size) for x in (left, right)]
        doc, gram = (np.concatenate(x) for x in zip(*sides))
        order = np.lexsort((gram, doc))
        doc, gram = doc[order], gram[order]
        both = np.bincount(doc[1:][(doc[1:] == doc[:-1]) & (gram[1:] == gram[:-1])], minlength=hi - lo)
        out.append(100 * both >= percent * (np.bincount(doc, minlength=hi - lo) - both))
    return np.concatenate(out)


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, bits: int = 4) -> DataFrame:
    """``key, component_id`` of every row of ``docs``.

    Texts link at a Jaccard similarity of ``percent`` in 100 or more; ``component_id``
    is the least key reachable over links. Fingerprints meet at ``bits`` or fewer
    differing bits; that only proposes pairs, it decides no link. Equal sets of shingles are compared once.
    Null and blank texts have no shingle and form one group. Null keys are kept and
    never chosen as component, unless all keys of a component are null.
    """

    @F.arrow_udf("d bigint, n bigint, buckets array<bigint>, sketch array<bigint>")
    def signed(texts: pa.Array) -> pa.Array:
        return _signed(texts, shingle, True)

    @F.arrow_udf("bigint")
    def digest(texts: pa.Array) -> pa.Array:
        return _signed(texts, shingle, False)

    @F.arrow_udf("boolean")
    def near(left: pa.Array, right: pa.Array) -> pa.Array:
        freed()
        return pa.array(similar(left, right, shingle, percent))

    marked = stored(docs.select(F.col(key).alias("k"), fingerprint(F.col(text), shingle).alias("fp"), signed(F.col(text)).alias("s")).select("k", "fp", "s.*"), "shingles")
    distinct = marked.filter("d != 0").groupBy("d").agg(F.any_value("buckets").alias("buckets"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch"), F.min("fp").alias("fp"))
    # One text stands for all with its fingerprint; they meet it, and it meets those of near fingerprints.
    prints = stored(distinct.select("d", "fp"), "fingerprints")
    heads = prints.groupBy("fp").agg(F.min("d").alias("head"))
    linked = near_links(heads.select("fp"), bits).join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b")
    printed = stored(linked.select("x", "y").union(prints.join(heads, "fp").filter("d != head").select("d", "head")), "fingerprints")
    rows = stored(distinct.select("d", F.explode("buckets").alias("bucket")), "buckets")
    ends = rows.groupBy("bucket").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).filter("lo < hi")
    shared = stored(rows.join(ends, "bucket"), "buckets")
    # Texts that meet no other are not carried further; of those that do, one for each set of shingles.
    meeting = shared.select("d").union(printed.select("x")).union(printed.select("y")).distinct()
    texts = stored(docs.select(digest(F.col(text)).alias("d"), F.col(text).alias("t")).join(meeting, "d", "left_semi").groupBy("d").agg(F.min("t").alias("t")), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        sides = pairs.join(texts.select(F.col("d").alias("b"), F.col("t").alias("tb")), "b").join(texts.select(F.col("d").alias("a"), F.col("t").alias("ta")), "a")
        return stored(sides.select("a", "b", near("ta", "tb").alias("near")), "pairs")

    def both(a: Column, b: Column) -> list[Column]:
        return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]

    star = shared.select("d", F.explode(F.array("lo", "hi")).alias("end")).filter("d != end")
    tried = verified(printed.select(*both(F.col("x"), F.col("y"))).union(star.select(*both(F.col("d"), F.col("end")))).distinct())
    first = components(tried.filter("near"), "a", "b").withColumnRenamed("node", "d")
    labelled = shared.select("bucket", "d").join(first, "d", "left").select("bucket", "d", F.coalesce("root", "d").alias("root"))
    mixed = labelled.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("bucket")
    # Two texts meet in the first bucket that they share, once, and only if their sizes and sketches allow the similarity.
    traits = distinct.select("d", "buckets", "n", "sketch")
    left = stored(labelled.join(mixed, "bucket").join(traits, "d"), "unlinked")
    right = left.select(F.col("bucket").alias("met"), F.col("d").alias("e"), F.col("root").alias("other"), F.col("buckets").alias("others"), F.col("n").alias("m"), F.col("sketch").alias("drawn"))
    apart = sum((F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("drawn")[i])) for i in range(SKETCH)), F.lit(0))
    allowed = (100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("m"))
    once = (F.element_at(F.array_intersect("buckets", "others"), 1) == F.col("bucket")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    across = left.join(right, (F.col("bucket") == F.col("met")) & (F.col("root") < F.col("other")) & allowed & once).select(*both(F.col("d"), F.col("e"))).distinct()
    late = verified(across.join(tried.select("a", "b"), ["a", "b"], "left_anti"))
    roots = components(tried.filter("near").union(late.filter("near")), "a", "b")

    least = marked.groupBy("d").agg(F.min("k").alias("k"))
    rooted = least.join(roots, least["d"] == roots["node"], "left").select(least["d"], F.coalesce("root", "d").alias("root"), "k")
    firsts = rooted.groupBy("root").agg(F.min("k").alias("component_id"))
    of_digest = stored(rooted.join(firsts, "root").select("d", "component_id"), "components")
    return marked.join(of_digest, "d").select(F.col("k").alias(key), "component_id")
