import random

import corpus_pipeline
import numpy as np
import pyarrow as pa

from sedgetable.llm import jaccard
from test_duplicates import FOLD, WORD, corpus


def shingles(text):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def by_brute_force(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(sets))]


def edited(n, seed=3):
    """Texts of 200 words and chains of copies with one to ten words changed, around a similarity of 0.8."""
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        text = [f"w{rnd.randrange(5000)}" for _ in range(200)]
        out.append(" ".join(text))
        for words in (1, 3, 4, 5, 6, 10):
            copy = list(text)
            for k in rnd.sample(range(200), words):
                copy[k] = f"c{rnd.randrange(10**6)}"
            out.append(" ".join(copy))
            text = copy if words == 5 else text
    return out


def test_near_copies_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PAIR_BYTES", 3000)
    texts = [*edited(25), *corpus(60), "", " ", None, "one", "One", "one two", "a " * 3000]
    df = spark.createDataFrame([(k + 10, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    out = {r["doc_id"]: r["component_id"] for r in jaccard.near_copies(df).collect()}
    expected = by_brute_force(texts)
    assert out == {k + 10: root + 10 for k, root in enumerate(expected)}
    assert 25 < len(set(expected)) < len(texts) - 60


def test_stage_keeps_one_of_each_group(spark):
    texts = edited(10, 7)
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)] + [(None, texts[0], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(k for k in kept if k is not None) == sorted(set(by_brute_force(texts))) and kept.count(None) == 1


def test_near_copies_edges(spark):
    rows = [(3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (None, "q r s t u v w"), (1, None)]
    out = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert out == sorted([(3, 3), (3, 3), (None, 3), (None, None), (1, 1)], key=str)
    assert jaccard.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketches_never_differ_in_more_bits_than_texts_in_shingles():
    texts = [*edited(6), "", "one two", None]
    signed = jaccard._signed(pa.array(texts, pa.string()), 5, True)
    sketch = np.array(signed.field("sketch").flatten()).reshape(-1, jaccard.SKETCH).view(np.uint64)
    sets, size = [shingles(t) for t in texts], signed.field("n").to_pylist()
    pruned = 0
    for a in range(len(texts)):
        for b in range(a):
            apart = int(np.bitwise_count(sketch[a] ^ sketch[b]).sum())
            assert apart <= len(sets[a] ^ sets[b])
            pruned += 180 * apart > 20 * (size[a] + size[b])
    assert pruned > 0.8 * len(texts) * (len(texts) - 1) / 2


def test_fingerprints_propose_pairs_and_unlike_ones_are_not_joined(spark, monkeypatch):
    """A family of texts that share 60 % of their shingles: no pair passes, and no pair is compared."""
    rnd = random.Random(5)
    base, rows = [f"w{k}" for k in range(300)], []
    for k in range(60):
        copy = list(base)
        for at in rnd.sample(range(300), 20):
            copy[at] = f"c{rnd.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    rows += [(100, " ".join(base)), (101, " ".join([*base, "more"]))]
    searched, kept = [], {}
    search, store = jaccard.near_links, jaccard.stored

    def stored(df, name):
        kept.setdefault(name, []).append(store(df, name))
        return kept[name][-1]

    monkeypatch.setattr(jaccard, "near_links", lambda fps, bits: searched.append(bits) or search(fps, bits))
    monkeypatch.setattr(jaccard, "stored", stored)
    out = dict(tuple(r) for r in jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = by_brute_force([t for _, t in rows])
    assert [out[k] for k, _ in rows] == [rows[w][0] for w in want] and out[101] == 100
    assert searched == [4]
    assert kept["pairs"][1].count() < 60  # of 1,770 pairs
