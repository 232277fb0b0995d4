import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sedgetable.llm import graph, simhash, substrings, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def fingerprint(text):
    w = WORD.findall((text or "").translate(FOLD))
    shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(fps, bits=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(fps))]


def corpus(n, seed=1):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("aeiounrstlé") for _ in range(rnd.randrange(2, 8))) for _ in range(300)]
    out = []
    for k in range(n):
        text = [rnd.choice(vocabulary) for _ in range(rnd.randrange(5, 120))]
        if k % 3 and out:
            text = out[rnd.randrange(len(out))].split(" ")
            if k % 3 == 2:
                text[rnd.randrange(len(text))] = "Changed"
        out.append(" ".join(text))
    return out


def test_words_of_texts_with_odd_edges():
    import pyarrow as pa

    texts = ["", None, " a", "b ", "c", "\td\n e\x0b", "é\x85f", "x" * 300, " ", "g"]
    for source in (pa.array(texts), pa.array(["zz", *texts])[1:], pa.chunked_array([texts[:4], texts[4:]])):
        w = words.words_of(source)
        got = [[w.data[w.start[k] : w.end[k]].tobytes().decode() for k in range(w.first[d], w.first[d + 1])] for d in range(len(texts))]
        assert got == [WORD.findall(t or "") for t in texts]
        h = w.hashes()
        assert len(set(h.tolist())) == len({x for t in got for x in t})
    assert words.words_of(pa.array([], pa.string())).first.tolist() == [0]


def test_packed_arrays_come_back():
    for a in (np.sort(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64)), np.zeros(0, np.uint64), np.arange(7, dtype=np.uint32)):
        assert words.unpack(words.pack(a), a.dtype).tolist() == a.tolist()


def test_near_duplicates_equal_brute_force(spark):
    texts = [*corpus(150), "", " ", None, "one", "One", "one two", "a " * 3000]
    rows = [(k + 10, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).repartition(5)
    out = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    fps = [fingerprint(t) for t in texts]
    assert out == {k + 10: (format(fps[k], "016x"), root + 10) for k, root in enumerate(grouped(fps))}


@pytest.mark.parametrize("piece", [8192, 300])
def test_links_join_planted_fingerprints(spark, monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE", piece)
    rnd = random.Random(9)
    fps = []
    for _ in range(40):
        fps.append(rnd.getrandbits(64))
        for _ in range(3):
            fps.append(fps[-1] ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(3, 6))))
    hot = rnd.getrandbits(64)
    fps = list(dict.fromkeys(fps + [hot ^ (1 << a) ^ (1 << b) for a in range(30, 64) for b in range(a)]))
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"))
    if piece > len(fps):  # one cell per bucket gives at most a spanning tree
        assert links.count() <= 5 * len(fps)
    roots = {r["node"]: r["root"] for r in graph.components(links, "a", "b").collect()}
    expected = grouped(fps)
    got = [roots.get(s, s) for (s,) in signed]
    assert len(set(zip(got, expected))) == len(set(got)) == len(set(expected))


def test_near_duplicates_edges(spark):
    rows = [(3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (None, "q r s t u v w"), (1, None)]
    out = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert out == sorted([(3, 3), (3, 3), (None, 3), (None, None), (1, 1)], key=str)
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_path(spark):
    order = list(range(200))
    random.Random(4).shuffle(order)
    links = spark.createDataFrame([*zip(order, order[1:]), (7, 7), (None, 3), (500, 501)], "a long, b long")
    out = {r["node"]: r["root"] for r in graph.components(links, "a", "b").collect()}
    assert out == {**{k: 0 for k in range(200)}, 500: 500, 501: 500}
    assert graph.components(links.limit(0), "a", "b").count() == 0


def removed(rows, size):
    seen, out = set(), []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        w = WORD.findall(text or "")
        cut = set()
        for k in range(len(w) - size + 1):
            window = tuple(w[k : k + size])
            if window in seen:
                cut.update(range(k, k + size))
            seen.add(window)
        out.append((key, len(w), len(cut), " ".join(x for k, x in enumerate(w) if k not in cut), sorted(cut)))
    return out


@pytest.mark.parametrize(("block", "group", "size"), [(1 << 24, 1 << 18, 20), (500, 20, 20), (500, 20, 5)])
def test_repeated_windows_equal_brute_force(spark, monkeypatch, block, group, size):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", block)
    monkeypatch.setattr(substrings, "GROUP", group)
    rows = [(k, t) for k, t in enumerate(corpus(120, 5))] + [(200, "again " * 100), (201, "again\n" * 50), (202, ""), (203, None), (None, "again " * 30), (5, None), (5, corpus(1, 7)[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", F.lit("clash")).withColumn("block", F.lit(1)).repartition(4)
    got = sorted((tuple(r) for r in substrings.digests(df, size=size).collect()), key=str)
    expected = removed(rows, size)
    assert got == sorted(((k, n, m, hashlib.sha256(t.encode()).hexdigest()) for k, n, m, t, _ in expected), key=str)
    kept = substrings.without_repeats(df, size=size)
    assert kept.columns == df.columns
    assert sorted((str(r["doc_id"]), " ".join(WORD.findall(r["text"] or ""))) for r in kept.collect()) == sorted((str(k), t) for k, _, _, t, _ in expected)
    runs = sum(r["n_words"] for r in substrings.spans(df, size=size).collect())
    assert runs == sum(m for _, _, m, _, _ in expected)


def test_repeated_windows_edges(spark):
    same = " ".join(f"w{k}" for k in range(30))
    empty = substrings.digests(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0
    out = substrings.without_repeats(spark.createDataFrame([(2, same), (1, same + "\n x")], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in out} == {1: same + "\n x", 2: ""}
