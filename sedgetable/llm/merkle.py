"""Merkle manifest of a dataset by time-forward processing.

Nodes are labelled by the last leaf below them and their level, so that a sweep over
the leaves in order meets every node right after the last of its children. A priority
queue ordered by label delivers the children's digests to their parent; it never
holds more than a run for each level. A second sweep in reversed order delivers to
each node the proof of its parent, to which it adds its own siblings.

A task sweeps an aligned range of ``8**height`` leaves. What leaves a range is one
message, the digest of its highest node, which Spark's sorted shuffle carries to the
next round; the proof of that node comes back to the range on the way down.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sedgetable.llm.ranks import numbered
from sedgetable.llm.words import stored

FAN, HEIGHT = 8, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Siblings before and after a node, then those of its ancestors: (before, after, rest) or None above the root.
Proof = tuple[str, str, "Proof"] | None


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def heights(n: int, height: int | None, fan: int = FAN) -> int:
    """Levels above ``n`` leaves: ``height`` of them, or up to the single node."""
    if height is not None:
        return height
    levels = 0
    while n > 1:
        n, levels = -(-n // fan), levels + 1
    return levels


def forward(leaves: Sequence[str], height: int | None = None, fan: int = FAN) -> list[list[str]]:
    """Digests of all nodes, level by level from the leaves, up to ``height`` or to the single node."""
    n, top = len(leaves), heights(len(leaves), height, fan)
    levels: list[list[str]] = [list(leaves), *[[] for _ in range(top)]]
    queue: list[tuple[int, int, int, str]] = []  # last leaf below the parent, its level, place among its children, digest

    def send(level: int, place: int, digest: str) -> None:
        if level < top:
            last = min((place // fan + 1) * fan ** (level + 1), n) - 1
            heapq.heappush(queue, (last, level + 1, place, digest))

    for leaf, digest in enumerate(leaves):
        send(0, leaf, digest)
        while queue and queue[0][0] == leaf:
            level, children = queue[0][1], []
            while queue and queue[0][:2] == (leaf, level):
                children.append(heapq.heappop(queue)[3])
            levels[level].append(sha("".join(children)))
            send(level, len(levels[level]) - 1, levels[level][-1])
    return levels


def backward(levels: list[list[str]], proof: Proof, fan: int = FAN) -> Iterator[tuple[int, Proof]]:
    """Each leaf's place and proof, from the last leaf to the first; ``proof`` is that of the highest node."""
    if not levels[0]:
        return
    n = len(levels[0])
    queue = [(-(n - 1), -(len(levels) - 1), 0, proof)]
    while queue:
        _, level, place, proof = heapq.heappop(queue)
        level = -level
        if not level:
            yield place, proof
            continue
        first = place * fan
        children = levels[level - 1][first : first + fan]
        for k in range(len(children)):
            own = ("".join(children[:k]), "".join(children[k + 1 :]), proof)
            last = min((first + k + 1) * fan ** (level - 1), n) - 1
            heapq.heappush(queue, (-last, 1 - level, first + k, own))


def listed(proof: Proof) -> tuple[list[str], list[str]]:
    before, after = [], []
    while proof:
        before.append(proof[0])
        after.append(proof[1])
        proof = proof[2]
    return before, after


def linked(before: Sequence[str], after: Sequence[str]) -> Proof:
    proof: Proof = None
    for pair in zip(reversed(before), reversed(after)):
        proof = (*pair, proof)
    return proof


def siblings(proof: Proof) -> str:
    """All siblings of a proof, level by level, left to right."""
    return "".join(x for pair in zip(*listed(proof)) for x in pair)


def folded(leaf: str, proof: Proof) -> str:
    """The root that a leaf and its siblings give."""
    while proof:
        leaf = sha(proof[0] + leaf + proof[1])
        proof = proof[2]
    return leaf


def checked(leaves: Sequence[str], changed: Sequence[str | None], height: int | None, proof: Proof, root: str, fan: int = FAN) -> tuple[list[str], list[str], list[bool]]:
    """Digest of each leaf's siblings, the root folded from the leaf and them, and whether it is ``root``.

    ``proof`` is that of the leaves' highest node. Every leaf is folded on its own, level
    by level: a changed one from its changed digest, any other from its own.
    """
    n = len(leaves)
    digests, roots = [""] * n, [""] * n
    parent, rest, started = None, "", False
    for place, own in backward(forward(leaves, height, fan), proof, fan):
        above = own[2] if own else None
        if not started or above is not parent:  # leaves of a run follow one another
            parent, rest, started = above, siblings(above), True
        digests[place] = sha((own[0] + own[1] if own else "") + rest)
        roots[place] = folded(leaves[place] if changed[place] is None else changed[place], own)
    return digests, roots, [r == root for r in roots]


def digest_text(columns: Sequence[Column]) -> Column:
    """``-`` for a null, else the number of UTF-8 bytes, ``:`` and the value, column after column."""
    texts = [c.cast("string") for c in columns]
    return F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def _ranges(level: DataFrame, height: int, fan: int) -> DataFrame:
    return level.withColumn("range", F.floor(F.col("index") / fan**height).cast("bigint"))


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by("index")


def _up(level: DataFrame, height: int, fan: int) -> DataFrame:
    """The highest node of each range: a group within one range ends at its single node, others at ``height``."""
    size = fan**height

    def sweep(table: pa.Table) -> pa.Table:
        table = _ordered(table)
        n = table["n"][0].as_py()
        levels = forward(table["digest"].to_pylist(), height if n > size else None, fan)
        return pa.table({"key": table["key"][:1], "index": table["range"][:1], "n": pa.array([-(-n // size)], pa.int64()), "digest": pa.array(levels[-1], pa.string())})

    slim = _ranges(level.select("key", "index", "n", "digest"), height, fan)
    return slim.groupBy("key", "range").applyInArrow(sweep, "key string, index bigint, n bigint, digest string")


def rounds(level: DataFrame, height: int, fan: int) -> list[DataFrame]:
    """``level`` and what each round of sweeps leaves of it, until every group has one node."""
    levels = [level]
    most = level.agg(F.max("n")).first()[0] or 1
    while most > 1:
        levels.append(stored(_up(levels[-1], height, fan), "nodes"))
        most = -(-most // fan**height)
    return levels


PROOFS = "key string, index bigint, before array<string>, after array<string>, subroot string, root string"


def _down(level: DataFrame, above: DataFrame, height: int, fan: int) -> DataFrame:
    """Proofs of the nodes of a level from those of its ranges' highest nodes."""
    size = fan**height

    def sweep(table: pa.Table, told: pa.Table) -> pa.Table:
        table, told = _ordered(table), told.to_pylist()[0]
        levels = forward(table["digest"].to_pylist(), height if table["n"][0].as_py() > size else None, fan)
        proofs = dict(backward(levels, linked(told["before"], told["after"]), fan))
        before, after = zip(*[listed(proofs[k]) for k in range(len(table))])
        same = lambda c: pa.array([told[c]] * len(table), pa.string())
        texts = pa.list_(pa.string())
        return pa.table({"key": table["key"], "index": table["index"], "before": pa.array(before, texts), "after": pa.array(after, texts), "subroot": same("subroot"), "root": same("root")})

    slim = _ranges(level.select("key", "index", "n", "digest"), height, fan)
    told = above.select(F.col("key").alias("key"), F.col("index").alias("range"), "before", "after", "subroot", "root")
    return slim.groupBy("key", "range").cogroup(told.groupBy("key", "range")).applyInArrow(sweep, PROOFS)


def descend(levels: list[DataFrame], proofs: DataFrame, height: int, fan: int) -> DataFrame:
    """Proofs of the lowest level but for its own range, from those of the single nodes."""
    for level in reversed(levels[1:-1] if len(levels) > 1 else []):
        proofs = stored(_down(level, proofs, height, fan), "proofs")
    return proofs


def manifest(docs: DataFrame, tampered: Column, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id", group: str = "lang", text: str = "text", height: int = HEIGHT, fan: int = FAN) -> DataFrame:
    """``key, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row of ``docs``.

    A leaf is the SHA-256 of ``columns``; leaves of a group ascend by ``key``, null
    first, ties by leaf, so equal rows give equal sets of results whatever their
    order. Every ``fan`` consecutive nodes have a parent until one is left, and the
    groups' roots, null first, then by UTF-8 bytes, go on in the same way. Where
    ``tampered`` holds (null: it does not), the text's A-Z are folded before the
    proof is checked. An empty table has no rows. Other columns are not read.
    """
    size = fan**height
    altered = [F.translate(F.col(c), UPPER, LOWER) if c == text else F.col(c) for c in columns]
    name = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    leaves = docs.select(
        F.col(key).alias("id"), name.alias("key"), F.sha2(digest_text([F.col(c) for c in columns]), 256).alias("digest"),
        F.when(tampered, F.sha2(digest_text(altered), 256)).alias("changed"), F.monotonically_increasing_id().alias("spread"),
    )
    kind = leaves.schema["id"].dataType.simpleString()
    ordered = numbered(stored(leaves, "leaves"), ["key"], [F.col("id"), F.col("digest"), F.xxhash64("spread")], total="n")
    levels = rounds(stored(ordered.drop("spread"), "leaves"), height, fan)

    tops = numbered(levels[-1].select(F.col("key").alias("name"), "digest", F.lit("").alias("key")), ["key"], [F.col("name")], total="n")
    upper = rounds(stored(tops, "subroots"), height, fan)
    none = F.array().cast("array<string>")
    proofs = upper[-1].select("key", "index", none.alias("before"), none.alias("after"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    proofs = descend(upper, proofs, height, fan)
    if len(upper) > 1:
        proofs = stored(_down(upper[0], proofs, height, fan), "proofs")
    of_group = upper[0].select(F.col("name"), F.col("index").alias("at"), F.col("digest").alias("own")).join(proofs, F.col("at") == F.col("index"))
    start = of_group.select(F.col("name").alias("key"), F.lit(0).cast("bigint").alias("index"), "before", "after", F.col("own").alias("subroot"), "root")
    told = descend(levels, start, height, fan)

    def check(table: pa.Table, told: pa.Table) -> pa.Table:
        table, told = _ordered(table), told.to_pylist()[0]
        leaves, changed = table["digest"].to_pylist(), table["changed"].to_pylist()
        proof = linked(told["before"], told["after"])
        digests, roots, verified = checked(leaves, changed, height if table["n"][0].as_py() > size else None, proof, told["root"], fan)
        same = lambda c: pa.array([told[c]] * len(leaves), pa.string())
        return pa.table({"id": table["id"], "leaf": table["digest"], "subroot": same("subroot"), "root": same("root"), "proof_sha256": pa.array(digests, pa.string()), "folded_root": pa.array(roots, pa.string()), "verified": pa.array(verified, pa.bool_())})

    out = _ranges(levels[0], height, fan).groupBy("key", "range").cogroup(told.select(F.col("key").alias("key"), F.col("index").alias("range"), "before", "after", "subroot", "root").groupBy("key", "range"))
    return out.applyInArrow(check, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean").withColumnRenamed("id", key)
