"""Record numbers in file order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sedgetable.core import SRC, TableError, WIDTH
from sedgetable.scale import bounded_broadcast, number_rows

FILE, BLOCK, LINE = "__file", "__block", "__line"


def with_position(df: DataFrame) -> DataFrame:
    """File and split start of each row, next to a number that grows within the split."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias("__at"),
    )


def number_records(df: DataFrame) -> DataFrame:
    """Contiguous 1-based ``__source_record`` in file and line order.

    ``df`` comes from :func:`with_position`. A split is read by one task from top
    to bottom, so a row's place is its offset in the split plus the rows of the
    splits before it. Only one row per split meets in the running sum, and the
    table itself is not shuffled. ``__line`` counts within the file and
    ``__files_before`` counts the files that come first.
    """
    blocks = df.groupBy(FILE, BLOCK).agg(F.count("*").alias("n"), F.min("__at").alias("__first_at"))
    order = Window.orderBy(FILE, BLOCK)
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.select(FILE, BLOCK, "__first_at", before.alias("__before"), (F.dense_rank().over(Window.orderBy(FILE)) - 1).alias("__files_before"))
    offsets = placed.withColumn("__file_start", F.min("__before").over(Window.partitionBy(FILE)))
    # One row per file split: a partition packs splits of different files or holds a single one.
    splits = df.rdd.getNumPartitions() + len(df.inputFiles())
    out = df.join(bounded_broadcast(offsets, splits), [FILE, BLOCK])
    number = F.col("__before") + F.col("__at") - F.col("__first_at") + 1
    return out.withColumn(SRC, number).withColumn(LINE, F.col(SRC) - F.col("__file_start")).drop("__at", "__first_at", "__before", "__file_start")


def number_frame(df: DataFrame, order: list[str]) -> DataFrame:
    """Record numbers for a table without file order, by explicit columns."""
    return number_rows(df, order, SRC)


def shape_report(df: DataFrame) -> DataFrame:
    """Records, bounds and distinct numbers of a stored table, and whether they are exactly 1..n."""
    whole = df.agg(F.count("*").alias("records"), F.min(SRC).alias("lowest"), F.max(SRC).alias("highest"), F.count_distinct(SRC).alias("distinct_numbers"))
    exact = (F.col("records") == 0) | ((F.col("lowest") == 1) & (F.col("highest") == F.col("records")) & (F.col("distinct_numbers") == F.col("records")))
    return whole.withColumn("contiguous", exact)


def guard_shape(df: DataFrame, records: int | None = None, width: int | None = None) -> DataFrame:
    """Refuse a table whose numbers are not 1..n or whose size or widths differ from what was recorded."""
    found = shape_report(df).first()
    if not found["contiguous"] or (records is not None and found["records"] != records):
        raise TableError("record numbers are not 1..n of the recorded count")
    if width is not None and WIDTH in df.columns and df.filter(F.col(WIDTH) != width).limit(1).count():
        raise TableError("a record has another width than the header")
    return df
