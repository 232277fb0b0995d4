"""Equality of two tables, and where they differ: signed sums over row digests, each table read once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sedgetable.core import SRC, TableError

RANGE_RECORDS = 1000
# A digest of 256 bits is summed in eight lanes of 32; a range of up to 2^31 rows fits a long.
LANES = 8
NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def _value(field: T.StructField) -> Column:
    """Text of a value with its length before it; null has none."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.BinaryType):
        column = F.hex(column)
    elif isinstance(field.dataType, NESTED):
        column = F.to_json(F.struct(column), {"ignoreNullFields": "false"})
    else:
        column = column.cast("string")
    return F.coalesce(F.concat(F.length(column).cast("string"), F.lit(":"), column), F.lit("-"))


def signed_digests(left: DataFrame, right: DataFrame, *keep: str) -> DataFrame:
    """``keep, digest, sign`` of every row of both tables: 1 on the left, -1 on the right.

    Columns are matched by name and take the types of a union. Nulls equal nulls; equal
    values are those of equal text.
    """
    if sorted(left.columns) != sorted(right.columns):
        raise TableError("the tables have other columns")
    sides = [df.select(*[F.col(f"`{c}`") for c in left.columns], F.lit(sign).alias("__sign")) for df, sign in ((left, 1), (right, -1))]
    both = sides[0].unionAll(sides[1])
    values = [_value(f) for f in both.schema.fields if f.name != "__sign"]
    return both.select(*keep, F.unhex(F.sha2(F.concat(*values), 256)).alias("digest"), F.col("__sign").alias("sign"))


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row counts and multiset differences of two tables; all zero differences means equal.

    Both tables meet in one grouping by digest, combined before the shuffle, so each is
    evaluated once and its rows do not travel.
    """
    net = signed_digests(left, right).groupBy("digest").agg(F.count_if(F.col("sign") > 0).alias("l"), F.count_if(F.col("sign") < 0).alias("r"))
    total = lambda column: F.coalesce(F.sum(column), F.lit(0).cast("bigint"))
    over = lambda a, b: total(F.greatest(F.col(a) - F.col(b), F.lit(0).cast("bigint")))
    return net.agg(total("l").alias("left_rows"), total("r").alias("right_rows"), over("l", "r").alias("left_only"), over("r", "l").alias("right_only"))


def differing_ranges(left: DataFrame, right: DataFrame, records: int = RANGE_RECORDS) -> DataFrame:
    """``first_record, last_record, left_rows, right_rows`` of the ranges of ``records`` record numbers whose rows differ.

    A range's rows are one signed sum per lane of their digests, whatever their order, and
    sums add up in every task: a thousand records travel as one row, and equal tables give
    no row. Rows without a record number form the range of null.
    """
    digests = signed_digests(left, right, SRC).withColumn("range", F.floor((F.col(SRC) - 1) / F.lit(records)).cast("bigint"))
    lane = lambda i: F.conv(F.hex(F.substring("digest", 4 * i + 1, 4)), 16, 10).cast("bigint")
    lanes = [F.sum(lane(i) * F.col("sign")).alias(f"lane{i}") for i in range(LANES)]
    sums = digests.groupBy("range").agg(F.count_if(F.col("sign") > 0).alias("left_rows"), F.count_if(F.col("sign") < 0).alias("right_rows"), *lanes)
    differs = F.col("left_rows") != F.col("right_rows")
    for i in range(LANES):
        differs = differs | (F.col(f"lane{i}") != 0)
    first = F.col("range") * records + 1
    return sums.filter(differs).select(first.alias("first_record"), (first + records - 1).alias("last_record"), "left_rows", "right_rows")


def _within(placed: DataFrame, ranges: DataFrame) -> DataFrame:
    names = ranges.withColumnRenamed("__range", "__differing")
    return placed.join(names, F.equal_null("__range", "__differing"), "left_semi").drop("__range")


def differing_records(left: DataFrame, right: DataFrame, records: int = RANGE_RECORDS) -> DataFrame:
    """``__source_record, left_only, right_only``: how many rows of a record one table holds beyond the other.

    Only rows of differing ranges are grouped; the others are dropped beside the ranges, before any shuffle where those are few.
    """
    ranges = differing_ranges(left, right, records).select(F.col("first_record").alias("__range"))
    start = lambda df: df.withColumn("__range", F.floor((F.col(SRC) - 1) / F.lit(records)).cast("bigint") * records + 1)
    within = [_within(start(df), ranges) for df in (left, right)]
    net = signed_digests(*within, SRC).groupBy(SRC, "digest").agg(F.sum("sign").alias("net"))
    over = lambda sign: F.sum(F.greatest(F.lit(sign) * F.col("net"), F.lit(0).cast("bigint")))
    return net.filter("net <> 0").groupBy(SRC).agg(over(1).alias("left_only"), over(-1).alias("right_only"))
