"""Language-model scores from a weighted backoff automaton.

States are word histories. A state has an arc for every word that followed its
history in training, and a failure arc to the history without its first word. An
arc's probability is smoothed by the lower order (Dirichlet prior of weight ``mu``)::

    p_k(w | h) = (c(h w) + mu * p_{k-1}(w | h')) / (c(h) + mu)      arc
                 mu / (c(h) + mu) * p_{k-1}(w | h')                 failure arc
    p_1(w)     = (c(w) + 1) / (N + V + 1)

so every state's probabilities, unseen words included, add up to one. The automaton
of a corpus grows with it and is never in one place: texts are dealt to blocks, a
block asks for the counts of the histories and words that it holds, key ranges of
the n-gram hashes are counted in shards, and each block traverses its texts over
the part of the automaton that it got back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sedgetable.llm.words import block_count, joined, mix, pack, shard_cuts, unpack, words_of

BLOCK_BYTES = 16 << 20
BEGIN, END = np.uint64(1), np.uint64(2)


def _sequences(texts: pa.ChunkedArray, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """n-gram hash of every position for each order, the position of each text's begin mark, and the texts' words.

    A text is its begin mark, its words and its end. An n-gram that would reach
    before the begin mark repeats the mark.
    """
    words = words_of(texts, lower=True)
    n = words.per_text
    begin = words.first[:-1] + 2 * np.arange(len(n))
    token = np.full(len(words.start) + 2 * len(n), END, np.uint64)
    token[begin] = BEGIN
    token[np.arange(len(words.start)) + 2 * words.text + 1] = words.hashes() | np.uint64(4)
    grams, mark = [mix(token)], mix(BEGIN.reshape(1))
    for _ in range(1, order):
        gram = np.empty_like(token)
        gram[1:] = joined(grams[-1][:-1], token[1:])
        mark = joined(mark, BEGIN.reshape(1))
        gram[begin] = mark
        grams.append(gram)
    return grams, begin, n


def _asked(gram: np.ndarray, trains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a block in order, with their training counts."""
    keys = np.unique(gram)
    seen = np.sort(gram[trains])
    return keys, (np.searchsorted(seen, keys, "right") - np.searchsorted(seen, keys, "left")).astype(np.uint32)


class Automaton:
    """The part of the backoff automaton that one block of texts can reach."""

    def __init__(self, keys: list[np.ndarray], counts: list[np.ndarray], tokens: int, distinct: int, mu: float):
        self.keys, self.counts, self.mu = keys, counts, mu
        self.tokens, self.floor = tokens, tokens + distinct + 1

    def count(self, level: int, gram: np.ndarray) -> np.ndarray:
        return self.counts[level][np.searchsorted(self.keys[level], gram)].astype(np.float64)

    def traverse(self, grams: list[np.ndarray], begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per position log10 of the base and of the model's probability, and whether the token is known.

        All texts move left to right together: position i enters from the state of
        its history at i - 1. Where the longest history has no arc for the token,
        its failure arc is taken, then that of the next shorter one.
        """
        seen = self.count(0, grams[0])
        p = base = (seen + 1) / self.floor
        for level in range(1, len(grams)):
            history = np.concatenate([[0.0], self.count(level - 1, grams[level - 1])[:-1]])
            arc = self.count(level, grams[level])
            fail = self.mu / (history + self.mu)
            p = np.where(arc > 0, (arc + self.mu * p) / (history + self.mu), fail * p)
        base, p = np.log10(base), np.log10(p)
        base[begin], p[begin] = 0, 0
        known = seen > 0
        known[begin] = False
        return base, p, known


def scored(docs: DataFrame, trains: Column, key: str = "doc_id", text: str = "text", order: int = 2, mu: float = 100.0) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    ``trains`` says which rows the model learns from; null counts as yes. Words are
    runs outside white space with A-Z folded, and one end follows, which is a token.
    Null and blank texts are just the end. Repeated rows count and are scored each.
    """
    source = docs.select(F.col(key).alias("k"), F.col(text).alias("text"), F.coalesce(trains, F.lit(True)).alias("trains"))
    kind = source.schema["k"].dataType.simpleString()
    blocks = block_count(source, "text", BLOCK_BYTES)
    cuts = shard_cuts(blocks)
    by_block = source.withColumn("block", F.pmod(F.xxhash64("k", F.octet_length("text")), F.lit(blocks)).cast("int")).repartition(blocks, "block")

    def ask(table: pa.Table) -> pa.Table:
        grams, begin, n = _sequences(table["text"], order)
        trains_ = np.repeat(table["trains"].to_numpy(), n + 2)
        rows = []
        for level, gram in enumerate(grams):
            keys, counts = _asked(gram, trains_)
            at = np.searchsorted(keys, cuts)
            for shard, (ks, cs) in enumerate(zip(np.split(keys, at), np.split(counts, at))):
                if len(ks) or level == 0:  # every block hears of every shard's words, for N and V
                    rows.append((shard, level, pack(ks), pack(cs)))
        shard, level, keys, counts = zip(*rows)
        return pa.table({"shard": pa.array(shard, pa.int32()), "block": pa.array([table["block"][0].as_py()] * len(rows), pa.int32()), "level": pa.array(level, pa.int32()), "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        out = []
        for level in range(order):
            some = table.filter(pa.array(table["level"].to_numpy() == level))
            if not len(some):
                continue
            keys = [unpack(b.as_buffer(), np.uint64) for b in some["keys"]]
            counts = [unpack(b.as_buffer(), np.uint32) for b in some["counts"]]
            names, at = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.bincount(at, np.concatenate(counts), len(names)).astype(np.uint64)
            words = names != mix(BEGIN.reshape(1))[0]
            tokens, distinct = (int(sums[words].sum()), int((sums[words] > 0).sum())) if level == 0 else (0, 0)
            answers = [pack(a) for a in np.split(sums[at], np.cumsum([len(k) for k in keys])[:-1])]
            out.append(pa.table({"block": some["block"], "shard": some["shard"], "level": some["level"], "sums": pa.array(answers, pa.binary()), "tokens": pa.array([tokens] * len(some), pa.int64()), "known": pa.array([distinct] * len(some), pa.int64())}))
        return pa.concat_tables(out)

    def traverse(docs_: pa.Table, told: pa.Table) -> pa.Table:
        grams, begin, n = _sequences(docs_["text"], order)
        told = told.sort_by([("level", "ascending"), ("shard", "ascending")])
        levels = told["level"].to_numpy()
        sums = [unpack(b.as_buffer(), np.uint64) for b in told["sums"]]
        counts = [np.concatenate([s for s, at in zip(sums, levels) if at == level]) for level in range(order)]
        tokens, known = (int(told[c].to_numpy().sum()) for c in ("tokens", "known"))
        base, p, seen = Automaton([np.unique(g) for g in grams], counts, tokens, known, mu).traverse(grams, begin)
        add = lambda x: np.add.reduceat(x, begin)
        return pa.table({"k": docs_["k"], "held_out": pa.array(~docs_["trains"].to_numpy()), "n_tokens": pa.array(n + 1, pa.int64()), "n_known": pa.array(add(seen.astype(np.int64))), "train_tokens": pa.array(np.full(len(n), tokens)), "base_score": pa.array(add(base)), "score": pa.array(add(p))})

    asked = by_block.groupBy("block").applyInArrow(ask, "shard int, block int, level int, keys binary, counts binary")
    told = asked.groupBy("shard").applyInArrow(count, "block int, shard int, level int, sums binary, tokens bigint, known bigint")
    schema = f"k {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return by_block.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(traverse, schema).withColumnRenamed("k", key)
