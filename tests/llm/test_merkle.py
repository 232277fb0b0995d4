import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sedgetable.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FOLD = {k: k + 32 for k in range(65, 91)}


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    doc, text, lang, source, n = row
    return H("".join(map(part, (doc, source, lang, n, text))))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def path(levels, i):
    """(before, after) of each level with more than one node."""
    out = []
    for nodes in levels[:-1]:
        lo = i - i % 8
        out.append(("".join(nodes[lo:i]), "".join(nodes[i + 1 : lo + 8])))
        i //= 8
    return out


def brute(rows):
    langs = {}
    for row in rows:
        langs.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: levels_of([x[2] for x in sorted(langs[lang], key=lambda x: x[:3])]) for lang in order}
    top = levels_of([trees[lang][-1][0] for lang in order])
    out = []
    for at, lang in enumerate(order):
        for i, (_, _, own, row) in enumerate(sorted(langs[lang], key=lambda x: x[:3])):
            proof = path(trees[lang], i) + path(top, at)
            h = own
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[1] is not None:
                h = leaf((row[0], row[1].translate(FOLD), *row[2:]))
            for before, after in proof:
                h = H(before + h + after)
            out.append((row[0], own, trees[lang][-1][0], top[-1][0], H("".join(b + a for b, a in proof)), h, h == top[-1][0]))
    return sorted(out, key=str)


def run(spark, rows, **kwargs):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return sorted((tuple(r) for r in merkle.manifest(df, tampered, **kwargs).collect()), key=str)


def corpus(n, seed=2):
    rnd = random.Random(seed)
    langs = ["en"] * 20 + ["fr", "de", None, "", "é", *[f"l{k}" for k in range(12)]]
    rows = [(k, rnd.choice(["Abc", "abc", "Straße É", "", None, "X" * 50]), rnd.choice(langs), rnd.choice(["s", None, ""]), rnd.choice([k, None])) for k in range(n)]
    return rows + rows[:7] + [(None, "A", "en", None, 1), (None, "B", "en", None, 1), (5, "Other", "en", "s", 1), (7, "Y" * 200_000, "en", "s", 1)]


@pytest.mark.parametrize("height", [1, 4])
def test_equals_brute_force(spark, height):
    rows = corpus(900)
    assert run(spark, rows, height=height) == brute(rows)


def test_single_leaves_and_edges(spark):
    assert run(spark, []) == []
    one = [(3, "Ab", "en", "s", 2)]
    assert run(spark, one) == brute(one) and run(spark, one)[0][4] == H("")
    many = [(k, "t", f"lang{k}", "s", 1) for k in range(30)]
    assert run(spark, many, height=1) == brute(many)
    same = [(1, "Ab", "en", "s", 2)] * 40
    assert run(spark, same, height=1) == brute(same)


def test_other_columns_do_not_clash(spark):
    df = spark.createDataFrame([(1, "a", "en", "s", 1, "x", 2, "y")], SCHEMA + ", key string, index int, digest string")
    assert merkle.manifest(df, F.lit(None).cast("boolean")).first()["verified"]


def test_sweeps_agree_with_plain_trees():
    for n in (1, 2, 8, 9, 64, 65, 100, 513):
        leaves = [H(str(k)) for k in range(n)]
        levels = merkle.forward(leaves)
        assert levels == levels_of(leaves)
        proofs = dict(merkle.backward(levels, None))
        assert [list(zip(*merkle.listed(proofs[k]))) for k in range(n)] == [path(levels, k) for k in range(n)]
        assert all(merkle.folded(leaves[k], proofs[k]) == levels[-1][0] for k in range(n))
        assert list(merkle.backward(levels, None))[0][0] == n - 1


@pytest.mark.parametrize("n", [1, 8, 70])
def test_every_leaf_is_folded_with_its_siblings(n):
    """A root that the leaves do not give is refused for all of them, changed or not."""
    leaves = [H(str(k)) for k in range(n)]
    root = H("a" + levels_of(leaves)[-1][0] + "b")
    changed = [H("x") if k % 3 == 0 else None for k in range(n)]
    for told in (root, H("another root")):
        digests, roots, verified = merkle.checked(leaves, changed, None, ("a", "b", None), told)
        assert [r == root for r in roots] == [k % 3 != 0 for k in range(n)]
        assert verified == [told == root and k % 3 != 0 for k in range(n)]
        assert digests == [H("".join(b + a for b, a in [*path(levels_of(leaves), k), ("a", "b")])) for k in range(n)]
