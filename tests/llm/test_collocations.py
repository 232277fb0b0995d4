import random
import re
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from sedgetable.llm import collocations

FOLD = {k: k + 32 for k in range(65, 91)}


def brute(rows, least, percent, top):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, 5):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        held = set()
        for p, a in good.items():
            for size in range(2, len(p)):
                held |= {p[i : i + size] for i in range(len(p) - size + 1) if 100 * a >= percent * f[p[i : i + size]]}
        rows_ = []
        for p, a in good.items():
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            if p not in held:
                rows_.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def corpus(n=260, seed=5):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["é", "Straße", "語", "x" * 300]
    fixed = ["to be or not", "New York City hall", "a a a a a", "once upon a time"]
    rows = []
    for k in range(n):
        parts = []
        for _ in range(rnd.randrange(1, 25)):
            parts.append(rnd.choice(fixed) if rnd.random() < 0.3 else words[min(int(rnd.expovariate(0.2)), len(words) - 1)])
        text = "".join(p + rnd.choice([" ", "  ", "\t", " ", " ", ". ", ",", "\n", "\x0b", "!"]) for p in parts)
        rows.append((rnd.choice(["en", "en", "en", "fr", None, "und", ""]), text))
    return rows


@pytest.mark.parametrize("sizes,limits", [({}, (12, 50, 7)), ({"bits": 2, "head": 3, "block_bytes": 2000, "group_cells": 20}, (5, 80, 2000))])
def test_equals_brute_force(spark, sizes, limits):
    """Once as in production, once with many tiles, many small blocks and tiles cut into ranges."""
    rows = [*corpus(), ("en", None), ("en", ""), (None, " .,"), ("de", "rare words"), ("en", "b c d " * 4000), ("en", "A,A a a")]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    least, percent, top = limits
    got = sorted(tuple(r) for r in collocations.collocations(df, least=least, percent=percent, top=top, **sizes).collect())
    assert got and got == brute(rows, least, percent, top)


def test_edges(spark):
    schema = "lang string, text string, block long, tile long, word string, rank int"
    assert collocations.collocations(spark.createDataFrame([], schema)).count() == 0
    rows = [("en", "ab cd", 1, 2, "x", 3)] * 30 + [("en", "ab. cd", None, None, None, None)] * 10
    got = [tuple(r) for r in collocations.collocations(spark.createDataFrame(rows, schema)).collect()]
    assert got == [("en", 1, "ab cd", 30, 40, 40, 80, 750000)]
    assert collocations.collocations(spark.createDataFrame(rows[1:], schema)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9 * 10**14 + 7
    df = spark.createDataFrame([(big, 10**15, 3 * 10**15 + 1)], "a long, l long, r long")
    assert df.select(collocations._score("a", "l", "r")).first()[0] == 2000000 * big // (4 * 10**15 + 1)


def test_numbers_beyond_32_bits():
    u, v = np.array([2**40, 3, 2**40, 3]), np.array([1, 2**33, 1, 2])
    known, first, n = collocations.summed(collocations.pair_keys(u, v))
    assert len(known) == 3 and sorted(n.tolist()) == [1, 1, 2]
    assert collocations._looked_up(u, v, u[:2], v[:2], np.array([7, 8])).tolist() == [7, 8, 7, -1]


def test_blocks_are_the_same_by_portions():
    texts = pa.array([text for _, text in corpus()] + ["", None, " .,"], pa.large_string()).fill_null("")
    whole = collocations._coded(texts)
    for size in (1, 7, len(texts)):
        parts = collocations._merged([collocations._coded(texts.slice(at, size)) for at in range(0, len(texts), size)])
        assert all(np.array_equal(getattr(parts, c), getattr(whole, c)) for c in ("hashes", "n", "state"))
        assert parts.names == whole.names


def test_a_block_takes_a_few_times_its_text(monkeypatch):
    """Texts were held until a block was full, then coded at once: twenty-two times its bytes here, now three."""
    monkeypatch.setattr(collocations.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    rnd = random.Random(3)
    text = " ".join(f"w{rnd.randrange(3000)}" for _ in range(1000))
    batch = pa.record_batch([pa.array(["en"] * 1500), pa.array([text] * 1500)], ["lang", "text"])
    tracemalloc.start()
    made = sum(b.num_rows for b in collocations._blocks(iter([batch]), 8 << 20))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made > 0 and peak < 6 * (8 << 20), peak
