"""Exact top-k by inner product with block-at-a-time pruning.

Vectors are documents, dimensions are terms. Candidates are sorted by id and cut
into blocks of consecutive ids; a block keeps its forward index (one row of term
weights per document) and, per term, its highest and lowest weight. For a query a
block's bound is the sum of its term maxima under the query's weights. Blocks are
visited from the highest bound down, and a query stops when the next bound is below
its k-th score; equal bounds are still scored, as a tie may go to a smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F

from sedgetable.llm.words import stored
from sedgetable.scale import top_rows

BLOCK = 256
# Rows of candidates, and of queries, that meet in one task.
CANDIDATES, QUERIES = 1 << 16, 1 << 12
SATURATED = 1 << 31


def quantised(vector: Column) -> Column:
    """``array<bigint>`` of floor(256 * x), x as double, held within 32 bits; null where any component is null or not finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    value = F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * 256), F.lit(SATURATED - 1)), F.lit(-SATURATED)).cast("bigint"))
    return F.when(F.coalesce(good, F.lit(False)), value)


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows padded with zeros to ``width``, which leaves inner products as they are."""
    rows = vectors.combine_chunks()
    rows = pa.concat_arrays(rows.chunks) if isinstance(rows, pa.ChunkedArray) else rows
    sizes = pa.compute.list_value_length(rows).to_numpy()
    out = np.zeros((len(rows), width))
    at = np.repeat(np.arange(len(rows)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[at] = rows.flatten().to_numpy()
    return out


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products: in doubles where no sum can pass 2**53, else in 64-bit integers."""
    return (a @ b.T).astype(np.int64) if exact else a.astype(np.int64) @ b.astype(np.int64).T


def search(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best ``k`` of ``ids`` (sorted) for every query: (query row, id, score), own id left out."""
    largest = max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(x).max(initial=0)) * max(1, x.shape[1])
    exact = largest < 2**53
    starts = np.arange(0, len(ids), BLOCK)
    high, low = np.maximum.reduceat(x, starts), np.minimum.reduceat(x, starts)
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T  # per query and block
    bound += np.abs(bound) * 1e-9
    visits = np.argsort(-bound, axis=1, kind="stable")
    best = np.full((len(q), k), np.iinfo(np.int64).min)
    who = np.full((len(q), k), np.iinfo(np.int64).max)
    have = np.zeros((len(q), k), bool)
    active = np.arange(len(q))
    for turn in range(len(starts)):
        block = visits[active, turn]
        go = (bound[active, block] >= best[active, -1]) | ~have[active, -1]
        active, block = active[go], block[go]
        if not len(active):
            break
        order = np.argsort(block, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            rows, b = active[part], starts[block[part[0]]]
            some = slice(b, b + BLOCK)
            score = _products(q[rows], x[some], exact)
            own = q_ids[rows][:, None] != ids[some][None, :]
            all_score = np.concatenate([best[rows], score], axis=1)
            all_who = np.concatenate([who[rows], np.broadcast_to(ids[some], score.shape)], axis=1)
            all_have = np.concatenate([have[rows], own], axis=1)
            pick = np.lexsort((all_who, -all_score, ~all_have), axis=1)[:, :k]
            best[rows], who[rows], have[rows] = (np.take_along_axis(a, pick, 1) for a in (all_score, all_who, all_have))
    row, at = np.nonzero(have)
    return row, who[row, at], best[row, at]


def top_k(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` highest integer inner products per query row.

    Candidates are all rows but those with the query's own id. Vectors that are null
    or hold null or non-finite components take no part; shorter vectors count as
    padded with zeros. Rows without id take no part. Ties go to the smaller id.
    Every candidate range meets every range of queries once, and sends on at most
    ``k`` rows per query.
    """
    rows = vectors.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), quantised(F.col(vector)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).filter("v is not null")
    rows = stored(rows, "vectors")
    size = rows.agg(F.count("*").alias("n"), F.count_if("q").alias("q"), F.max(F.size("v")).alias("width")).first()
    width = max(1, size["width"] or 0)
    parts = max(6, -(-size["n"] // CANDIDATES))
    chunks = max(1, -(-size["q"] // QUERIES))
    cuts = rows.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], F.lit(10_000)).alias("c")).first()["c"] or []
    bounds = np.unique(np.array(cuts, np.int64))

    @F.arrow_udf("int")
    def part_of(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, ids.to_numpy(zero_copy_only=False), "right"), pa.int32())

    every = F.sequence(F.lit(0), F.lit(chunks - 1))
    all_parts = F.sequence(F.lit(0), F.lit(len(bounds)))
    chunk = F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")
    candidates = rows.select(part_of("id").alias("part"), F.explode(every).alias("chunk"), "id", "v")
    asks = rows.filter("q").select(F.explode(all_parts).alias("part"), chunk.alias("chunk"), "id", "v")

    def meet(x: pa.Table, q: pa.Table) -> pa.Table:
        empty = np.zeros(0, np.int64)
        if not len(x) or not len(q):
            return pa.table({"query_id": empty, "vec_id": empty, "score": empty})
        x = x.sort_by("id")
        q_ids = q["id"].to_numpy()
        row, who, score = search(q_ids, _matrix(q["v"], width), x["id"].to_numpy(), _matrix(x["v"], width), k)
        return pa.table({"query_id": q_ids[row], "vec_id": who, "score": score})

    met = candidates.groupBy("part", "chunk").cogroup(asks.groupBy("part", "chunk")).applyInArrow(meet, "query_id bigint, vec_id bigint, score bigint")
    top = top_rows(met, ["query_id"], [F.desc("score"), F.asc("vec_id")], k)
    return top.select("query_id", "rank", "vec_id", "score")
