"""Skew-safe building blocks: salting of heavy keys, first rows, digests, shared folders."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sedgetable.core import SRC, TableError, data_columns

# A key is heavy when it holds more than 1/HEAVY_SHARE of the rows, so there are
# fewer than HEAVY_SHARE heavy keys whatever the table size.
HEAVY_SHARE = 200
SALTS = 64


def heavy_keys(df: DataFrame, keys: Sequence[str]) -> Column:
    """Scalar array of key hashes that hold an outsized share of the rows.

    One mergeable heavy-hitter sketch per task, no shuffle of the keys. The list
    only routes rows, so its approximation never touches a result.
    """
    hashed = df.select(F.xxhash64(*[F.col(f"`{k}`") for k in keys]).alias("h"))
    top = hashed.agg(F.expr("approx_top_k(h, 256, 20000)").alias("top"), F.count("*").alias("n"))
    heavy = F.transform(F.filter("top", lambda x: x["count"] * HEAVY_SHARE > F.col("n")), lambda x: x["item"])
    return top.select(F.coalesce(heavy, F.array().cast("array<bigint>")).alias("heavy")).scalar()


def salted_join(big: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left", spread_by: Sequence[str] = ()) -> DataFrame:
    """Equi join whose left side may have heavy keys: those keys are spread over ``SALTS`` buckets.

    Only the lookup rows of heavy keys are repeated. Works for inner, left,
    left_semi and left_anti because each left row still sees all its matches.
    """
    heavy = heavy_keys(big, keys)
    is_heavy = F.array_contains(heavy, F.xxhash64(*[F.col(f"`{k}`") for k in keys]))
    seed = list(spread_by) or ([SRC] if SRC in big.columns else list(big.columns))
    salt = F.when(is_heavy, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in seed]), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    every = F.when(is_heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = big.withColumn("__salt", salt)
    right = lookup.withColumn("__salt", F.explode(every))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def key_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: number of rows and first record. Combined before the shuffle."""
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count("*").alias("__n"), F.min(SRC).alias("__first"))


def non_first(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that repeat the key of an earlier record."""
    groups = key_groups(df, keys).filter("__n > 1").select(*[F.col(f"`{k}`") for k in keys], "__first")
    return salted_join(df, groups, keys, "inner").filter(F.col(SRC) > F.col("__first")).drop("__first")


def first_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep the first record of every key. Joined on the record number, which cannot be skewed."""
    firsts = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.min(SRC).alias(SRC)).select(SRC)
    return df.join(firsts, SRC, "left_semi")


def top_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each group.

    The filter on ``row_number`` lets Spark cut every group to ``k`` rows per
    task before the shuffle, so a group never travels whole.
    """
    window = Window.partitionBy(*group).orderBy(*order) if group else Window.partitionBy(F.lit(1)).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


DIGEST_FAN = 10_000


def cells_digest(df: DataFrame) -> Column:
    """SHA-256 of the cells of a row, without its number: equal rows have equal digests."""
    parts = [F.concat(F.length(F.col(f"`{c}`")).cast("string"), F.lit(":"), F.col(f"`{c}`")) for c in data_columns(df)]
    return F.sha2(F.concat(*parts), 256)


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of one record; every value carries its length, so cell borders cannot shift."""
    parts = [F.concat(F.length(F.col(f"`{c}`")).cast("string"), F.lit(":"), F.col(f"`{c}`")) for c in data_columns(df)]
    return F.sha2(F.concat(F.col(SRC).cast("string"), F.lit("|"), *parts), 256)


def table_digest(df: DataFrame) -> DataFrame:
    """One SHA-256 over all records in record order.

    A fixed tree: at most ``DIGEST_FAN`` hashes meet in one group on each of the
    four levels, which covers 10^16 records and does not depend on partitioning.
    """
    return keyed_digest(df.select(SRC, row_digest(df).alias("h")), SRC, "h")


def shared_folder(spark: SparkSession) -> str:
    """New subfolder of the folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a local
    session gets a temporary folder; on a cluster, whose machines do not share
    theirs, that is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise TableError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="sedgetable-")
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return os.path.join(base, f"sedgetable-{uuid.uuid4().hex}")


BROADCAST_ROWS = 200_000


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a frame known to hold at most ``rows`` short rows; beyond the bound Spark joins by shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


CHUNK = 1_000_000


def previous_value(df: DataFrame, group: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """Value of the preceding row of each group, for an ``order`` of unique whole numbers.

    Two levels: a group is cut into ranges of ``order`` that hold at most
    ``CHUNK`` rows, and only the last value of each range is carried forward. No
    task ever sorts a whole group.
    """
    cut = df.withColumn("__chunk", F.floor(F.col(order) / CHUNK).cast("long"))
    within = Window.partitionBy(*group, "__chunk").orderBy(order)
    ends = cut.groupBy(*group, "__chunk").agg(F.max_by(F.struct(F.col(value).alias("v")), F.col(order)).alias("__end"))
    across = Window.partitionBy(*group).orderBy("__chunk") if group else Window.orderBy("__chunk")
    carried = ends.withColumn("__carried", F.lag("__end").over(across)).drop("__end")
    out = cut.withColumn("__near", F.lag(F.struct(F.col(value).alias("v"))).over(within)).join(carried, [*group, "__chunk"])
    return out.withColumn(name, F.coalesce("__near", "__carried")["v"]).drop("__chunk", "__near", "__carried")


def highest_before(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Highest ``value`` among all rows with a smaller ``order``, in the same two levels."""
    cut = df.withColumn("__chunk", F.floor(F.col(order) / CHUNK).cast("long"))
    within = Window.partitionBy("__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ends = cut.groupBy("__chunk").agg(F.max(value).alias("__end"))
    across = Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("__carried", F.max("__end").over(across)).drop("__end")
    out = cut.withColumn("__near", F.max(value).over(within)).join(carried, "__chunk")
    return out.withColumn(name, F.greatest("__near", "__carried")).drop("__chunk", "__near", "__carried")


def number_rows(df: DataFrame, order: Sequence[str], name: str, start: int = 1) -> DataFrame:
    """Contiguous numbers in the given order, without sorting in one task.

    The range-partitioned rows are checkpointed once, because range bounds are
    sampled anew on every run; then each partition only needs the count of the
    partitions before it.
    """
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None):
        shared_folder(df.sparkSession)
    ordered = df.repartitionByRange(*[F.col(f"`{c}`") for c in order]).sortWithinPartitions(*order)
    ordered = ordered.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()).checkpoint()
    sizes = ordered.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("__base"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", "__base", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    out = ordered.join(bounded_broadcast(offsets, ordered.rdd.getNumPartitions()), "__part")
    return out.withColumn(name, F.col("__offset") + F.col("__at") - F.col("__base") + start).drop("__part", "__at", "__base", "__offset")


def keyed_digest(df: DataFrame, key: str, digest: str) -> DataFrame:
    """One SHA-256 over rows with unique ``key``, as the tree of :func:`table_digest`."""
    level = df.select(F.col(key).alias("b"), F.col(digest).alias("h"))
    for _ in range(4):
        level = (
            level.select(F.col("b").alias("o"), F.floor(F.col("b") / DIGEST_FAN).cast("long").alias("b"), "h")
            .groupBy("b")
            .agg(F.sha2(F.expr("listagg(h, '') within group (order by o)"), 256).alias("h"))
        )
    return level.select(F.col("h").alias("digest"))
