import random
import zlib
from collections import Counter

import pytest

from sedgetable.llm import kdshards

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def run(spark, rows, parts=5, **kwargs):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return [r.asDict() for r in kdshards.sharded(df, **kwargs).collect()]


def corpus(n=700, seed=4):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        size = int(rnd.paretovariate(1.1) * 40) % 6000
        source = "hot" if rnd.random() < 0.4 else f"s{rnd.randrange(20)}"
        rows.append((k, "é" * size, rnd.choice(["en", "fr", None]), source, rnd.choice([size, None])))
    return rows


def checked(rows, out, shards):
    """Every row once, gapless slots, and sums that differ by less than the largest documents."""
    sizes = lambda t: len((t or "").encode())
    expect = Counter((r[0], sizes(r[1]) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == expect
    assert {(r["law"], r["grown_shard"]) for r in out} <= {("bytes", None)}
    total = Counter()
    for s in range(shards):
        own = sorted((r["slot"], r["doc_id"] is not None, r["doc_id"] or 0) for r in out if r["shard"] == s)
        assert [x[0] for x in own] == list(range(len(own)))
        assert [x[1:] for x in own] == sorted(x[1:] for x in own)
        total[s] = sum(r["size"] for r in out if r["shard"] == s)
    assert set(r["shard"] for r in out) <= set(range(shards))
    most = max((r["size"] for r in out), default=0)
    mean = sum(total.values()) / shards
    assert all(abs(total[s] - mean) <= most for s in range(shards))
    return total


def brute(rows, shards):
    """The same tree by sorting in one place, for rows without ties."""
    dims = [lambda r: int.from_bytes((r[3].encode() + bytes(7))[:7], "big"), lambda r: r[4], lambda r: r[0]]
    whole = [max(map(f, rows)) - min(map(f, rows)) for f in dims]

    def deal(rows, m, first):
        if m == 1:
            return {r[0]: first for r in rows}
        spread = [(max(map(f, rows)) - min(map(f, rows))) / w for f, w in zip(dims, whole)]
        f = dims[max(range(3), key=lambda k: (spread[k], -k))]
        order, want = sorted(rows, key=f), -(-sum(len(r[1]) + 1 for r in rows) * (m // 2) // m)
        before = 0
        for at, r in enumerate(order):
            size = len(r[1]) + 1
            if before + size >= want:
                at += before + size - want <= want - before
                break
            before += size
        return {**deal(order[:at], m // 2, first), **deal(order[at:], m - m // 2, first + m // 2)}

    return deal(rows, shards, 0)


@pytest.mark.parametrize("shards", [16, 5])
def test_equals_brute_force_without_ties(spark, shards):
    rnd = random.Random(1)
    marks = rnd.sample(range(10**6), 400)
    rows = [(k, "x" * rnd.randrange(500), "en", f"{marks[k]:07d}", rnd.randrange(10**6) * 400 + k) for k in range(400)]
    out = run(spark, rows, shards=shards, dimensions=("source", "n_chars", "doc_id"))
    assert {r["doc_id"]: r["shard"] for r in out} == brute(rows, shards)
    checked(rows, out, shards)


def test_hot_values_and_nulls(spark):
    rows = corpus()
    out = run(spark, rows, shards=16)
    assert all(checked(rows, out, 16).values())
    again = run(spark, rows[::-1], parts=3, shards=16)
    key = lambda r: (r["doc_id"], r["shard"], r["slot"])
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_repeated_rows_long_texts_and_edges(spark):
    same = [(None, "same text", None, None, None)] * 300 + [(1, None, "en", "s", 0), (1, None, "en", "s", 0), (2, "long " * 200_000, "en", "s", 1)]
    out = run(spark, same, shards=16)
    assert Counter(r["size"] for r in out) == Counter({10: 300, 1: 2, 1_000_001: 1})
    copies = [(None, "same text", None, None, None)] * 320
    assert set(checked(copies, run(spark, copies, shards=16), 16).values()) == {200}
    few = [(k, "abc", "en", "s", 3) for k in range(3)]
    checked(few, run(spark, few, shards=16), 16)
    assert run(spark, [], shards=16) == []
    assert {r["shard"] for r in run(spark, few, target_bytes=4)} == {0, 1, 2}


def test_other_columns_do_not_clash(spark):
    df = spark.createDataFrame([(1, "a", "en", "s", 1, 9, 9, "z")], SCHEMA + ", shard int, size int, tie string")
    assert kdshards.sharded(df, shards=2).first()["size"] == 2
    with pytest.raises(ValueError):
        kdshards.sharded(df)
