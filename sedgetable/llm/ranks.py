"""Gapless numbers in a given order within groups, without a sort in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sedgetable.llm.words import stored

SHORT_ROWS = 100_000


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str = "index", total: str | None = None) -> DataFrame:
    """``df`` with a number from 0 in ``order`` within each ``group`` (columns without nulls); ``total`` names the group's size.

    The rows are sorted into ranges and written once, as range borders are sampled
    anew on every run; a row's number is then its place in its range plus the rows
    of the group in the ranges before it. So a group may span any number of tasks.
    Rows equal in ``order`` are numbered in any order among themselves.
    """
    by = [*[F.col(c) for c in group], *order]
    ordered = df.repartitionByRange(*by).sortWithinPartitions(*by)
    rows = stored(ordered.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "ranges")
    sizes = rows.groupBy(*group, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__base"))
    span = Window.partitionBy(*group)
    before = F.coalesce(F.sum("__n").over(span.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select(*group, "__part", (before - F.col("__base")).alias("__shift"), F.sum("__n").over(span).alias("__total"))
    shifts = stored(shifts, "shifts")  # one row for each group in each range
    if shifts.count() <= SHORT_ROWS:
        shifts = F.broadcast(shifts)
    out = rows.join(shifts, [*group, "__part"]).withColumn(name, F.col("__at") + F.col("__shift"))
    return (out.withColumn(total, F.col("__total")) if total else out).drop("__part", "__at", "__shift", "__total")
