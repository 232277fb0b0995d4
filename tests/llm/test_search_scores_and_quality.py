import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedgetable.llm import lm, quality, rules, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def best(rows, k=5, every=50):
    vectors = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in sorted(i for i in vectors if i % every == 0):
        scores = sorted((-sum(a * b for a, b in zip(vectors[q], vectors[c])), c) for c in vectors if c != q)
        out += [(q, n, c, -s) for n, (s, c) in enumerate(scores[:k], 1)]
    return out


@pytest.mark.parametrize(("block", "candidates", "queries"), [(256, 1 << 16, 1 << 12), (8, 50, 3)])
def test_top_k_equals_brute_force(spark, monkeypatch, block, candidates, queries):
    for name, value in (("BLOCK", block), ("CANDIDATES", candidates), ("QUERIES", queries)):
        monkeypatch.setattr(topk, name, value)
    rnd = random.Random(3)
    rows = [(k, [round(rnd.gauss(0, 1), 3) for _ in range(6)]) for k in range(400)]
    rows += [(400, [0.5] * 6), (401, [0.5] * 6), (402, [0.5] * 6), (403, None), (404, [1.0, None]), (405, [float("nan")]), (450, [float("inf")]), (406, []), (None, [9.0] * 6), (500, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash")).repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == best(single)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 512)]


def test_blocks_below_the_bound_are_not_scored(monkeypatch):
    scored = []
    plain = topk._products
    monkeypatch.setattr(topk, "_products", lambda a, b, exact: (scored.append(len(b)), plain(a, b, exact))[1])
    x = np.concatenate([np.full((topk.BLOCK, 4), 9.0), np.random.default_rng(1).integers(0, 3, (20 * topk.BLOCK, 4)).astype(float)])
    topk.search(np.array([-1]), np.ones((1, 4)), np.arange(len(x)), x, 5)
    assert sum(scored) == topk.BLOCK


def model(rows, trains, order, mu):
    counts = Counter()
    sequences = {k: ["<"] * 1 + [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(t or "")] + ["\n"] for k, t in rows}
    padded = {k: ["<"] * (order - 1) + s for k, s in sequences.items()}
    for k, s in padded.items():
        if trains[k]:
            for i in range(order - 1, len(s)):
                counts.update(tuple(s[i - n : i + 1]) for n in range(order) if i - n >= 0)
    n = sum(c for g, c in counts.items() if len(g) == 1 and g != ("<",))
    v = sum(len(g) == 1 and g != ("<",) for g in counts)
    out = {}
    for k, s in padded.items():
        base = score = known = 0
        for i in range(order, len(s)):
            p = (counts[(s[i],)] + 1) / (n + v + 1)
            base, known = base + math.log10(p), known + (counts[(s[i],)] > 0)
            for m in range(1, order):
                p = (counts[tuple(s[i - m : i + 1])] + mu * p) / (counts[tuple(s[i - m : i])] + mu)
            score += math.log10(p)
        out[k] = (len(s) - order, known, n, base, score)
    return out


@pytest.mark.parametrize(("order", "block"), [(1, 1 << 24), (2, 1 << 24), (2, 300), (3, 300)])
def test_scores_equal_brute_force(spark, monkeypatch, order, block):
    monkeypatch.setattr(lm, "BLOCK_BYTES", block)
    rnd = random.Random(6)
    rows = [(k, " ".join(rnd.choice(["The", "the", "cat", "sat", "on", "é", f"w{rnd.randrange(40)}"]) for _ in range(rnd.randrange(0, 25)))) for k in range(80)]
    rows += [(80, None), (81, " \n"), (82, "x" * 200 + " tail")]
    trains = {k: zlib.crc32(str(k).encode()) % 7 != 2 for k, _ in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("trains", F.lit("clash")).repartition(3)
    out = lm.scored(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, order=order, mu=7.0).collect()
    expected = model(rows, trains, order, 7.0)
    assert len(out) == len(rows)
    for r in out:
        tokens, known, n, base, score = expected[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not trains[r["doc_id"]], tokens, known, n)
        assert r["base_score"] == pytest.approx(base, abs=1e-9) and r["score"] == pytest.approx(score, abs=1e-9)


def test_scores_edges(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    out = lm.scored(df, F.lit(False)).collect()
    assert all(r["train_tokens"] == 0 and r["score"] == 0 for r in out) and len(out) == 3
    assert lm.scored(df.limit(0), F.lit(True)).count() == 0


def test_every_state_adds_up_to_one():
    grams, begin, _ = lm._sequences(__import__("pyarrow").chunked_array([["a b a c a b", "c"]]), 2)
    keys, counts = zip(*[lm._asked(g, np.ones(len(g), bool)) for g in grams])
    automaton = lm.Automaton(list(keys), list(counts), 9, 4, 5.0)
    p1 = {w: c + 1 for w, c in (("a", 3), ("b", 2), ("c", 2), ("end", 2), ("unseen", 0))}
    assert sum(p1.values()) == automaton.floor  # the base is a distribution; interpolation with it keeps that


def test_rules_equal_brute_force(spark):
    rnd = random.Random(8)
    texts = [None, "", " \n ", "a", "a b c a b c", "x\nx\n\ny\n x", "# * | <b> &"] + [" ".join(rnd.choice("the of and cat dog | é# un".split()) + rnd.choice([" ", "\n", ""]) for _ in range(rnd.randrange(1, 300))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    for r in rules.judged(df).collect():
        text = texts[r["doc_id"]] or ""
        w, m = WORD.findall(text), r["measures"]
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (m["n_words"], m["word_chars"], m["n_symbols"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text))
        assert (m["n_lines"], m["n_dup_lines"], m["n_repeat_words"]) == (len(lines), len(lines) - len(set(lines)), len(covered))
        assert m["n_stop_words"] == sum(x.lower() in rules.STOP_WORDS for x in w)
        assert r["base_failed"] == (len(w) < 50 or 2 * len(covered) > len(w))
        assert not (r["base_failed"] and r["kept"])
    assert rules.judged(df.limit(0)).count() == 0


def test_rules_plan_is_native(spark):
    plan = rules.judged(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan.split("== Physical Plan ==")[1])


def test_classifier_rejects_junk_and_keeps_clean(spark):
    rnd = random.Random(12)
    vocabulary = ["".join(rnd.choice(["the", "an", "or", "ti", "re", "en"]) for _ in range(rnd.randrange(1, 4))) for _ in range(200)]
    clean = [" ".join(rnd.choice(vocabulary) for _ in range(60)) for _ in range(240)]
    junk = [" ".join(rnd.choice(vocabulary).upper() + "!!" for _ in range(60)) for _ in range(40)]
    rows = [(k, t) for k, t in enumerate(clean + junk)] + [(900, None), (901, ""), (None, clean[0])]
    labels = spark.createDataFrame([(k, int(k < 240), 0) for k in range(0, 280, 2)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")).repartition(4)
    out = {r["doc_id"]: r["kept"] for r in quality.classified(df, labels).collect()}
    assert sum(out[k] for k in range(240)) >= 238
    assert sum(out[k] for k in range(240, 280)) <= 1
    assert len(out) == len(rows)
    assert sum(r["kept"] for r in quality.classified(df, labels, k=50).collect()) == 50
    assert quality.classified(df.limit(0), labels).count() == 0
    assert all(r["kept"] for r in quality.classified(df, labels.limit(0)).collect())


def test_bucket_counts_equal_plain_ones():
    import pyarrow as pa

    texts = ["", "abc", "abcd", None, "héllo wörld", "x"]
    got = [(b.tolist(), n.tolist()) for b, n in quality._buckets(pa.array(texts))]
    raw = [(t or "").encode() for t in texts]
    expected = [(int.from_bytes(t[k : k + 4], "little") * 0x9E3779B1 & 0xFFFFFFFF) >> 16 for t in raw for k in range(len(t) - 3)]
    assert sum((b for b, _ in got), []) == expected
    assert sum((n for _, n in got), []) == [max(0, len(t) - 3) for t in raw]


def test_kth_highest(spark):
    values = [1.5, 2.5, 2.5, -3.0, 1e9, 7.25, 7.25]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [quality.kth_highest(df, "x", k) for k in range(1, 8)] == sorted(values, reverse=True)
    assert quality.kth_highest(df, "x", 0) is None and quality.kth_highest(df.limit(0), "x", 3) is None
