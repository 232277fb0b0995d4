"""One-pass column profiles. Everything counts through map-side combined aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sedgetable.core import SRC, require, unpivot_cells
from sedgetable.functions.numbers import record_number_or_null, script_number_or_null, type_class
from sedgetable.functions.text import RECORD_SPACE, is_blank, trim_space
from sedgetable.scale import top_rows

TYPE_CLASSES = ("integer", "number", "date-like", "boolean", "text")


def import_profile(df: DataFrame) -> DataFrame:
    """Per column: empty, outer whitespace, length range and finite-number range."""
    v, number = F.col("value"), record_number_or_null(F.col("value"))
    return unpivot_cells(df).groupBy("column").agg(
        F.count("*").alias("rows"),
        F.count_if(v == "").alias("empty"),
        F.count_if(v != trim_space(v, RECORD_SPACE)).alias("whitespace"),
        F.min(F.length(v)).alias("min_length"),
        F.max(F.length(v)).alias("max_length"),
        F.count(number).alias("numeric_count"),
        F.min(number).alias("numeric_min"),
        F.max(number).alias("numeric_max"),
    )


def value_frequencies(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column and distinct value: count and first record. The one wide shuffle of the profiles."""
    return unpivot_cells(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"), F.min(SRC).alias("first_record"))


def first_samples(df: DataFrame, k: int = 5, cut: int = 200) -> DataFrame:
    """First ``k`` distinct nonempty values per column, cut to ``cut`` characters."""
    freq = value_frequencies(df).filter(F.col("value") != "")
    return top_rows(freq, ["column"], [F.asc("first_record")], k).select("column", "rank", F.substring("value", 1, cut).alias("sample"))


def classify_values(df: DataFrame, column: str) -> DataFrame:
    require(df, [column])
    c = F.col(f"`{column}`")
    return df.select(SRC, c.alias("value"), type_class(c).alias("type_class"))


def column_profile(freq: DataFrame) -> DataFrame:
    """Per column: missing, distinct, type histogram, dominant type, number range, identifier test."""
    v, n = F.col("value"), F.col("n")
    blank = is_blank(v)
    typed = freq.withColumn("kind", type_class(v)).withColumn("blank", blank)
    aggregates = [
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("blank"), n)), F.lit(0)).alias("missing"),
        F.count_if(~F.col("blank")).alias("unique"),
        F.coalesce(F.sum(F.when(v != trim_space(v), n)), F.lit(0)).alias("whitespace"),
        F.min(F.when(~F.col("blank"), script_number_or_null(v))).alias("low"),
        F.max(F.when(~F.col("blank"), script_number_or_null(v))).alias("high"),
    ]
    for kind in TYPE_CLASSES:
        aggregates.append(F.coalesce(F.sum(F.when(F.col("kind") == kind, n)), F.lit(0)).alias(f"n_{kind}"))
        aggregates.append(F.min(F.when(F.col("kind") == kind, F.col("first_record"))).alias(f"f_{kind}"))
    wide = typed.groupBy("column").agg(*aggregates)
    both = (F.col("n_integer") > 0) & (F.col("n_number") > 0)
    wide = wide.withColumn("n_number", F.when(both, F.col("n_number") + F.col("n_integer")).otherwise(F.col("n_number"))).withColumn(
        "n_integer", F.when(both, F.lit(0)).otherwise(F.col("n_integer"))
    )
    ranked = F.array(*[F.struct((-F.col(f"n_{k}")).alias("c"), F.col(f"f_{k}").alias("f"), F.lit(k).alias("k")) for k in TYPE_CLASSES])
    present = F.filter(ranked, lambda x: x["c"] < 0)
    dominant = F.coalesce(F.array_min(present)["k"], F.lit("empty"))
    numeric = F.col("type").isin("integer", "number")
    return wide.withColumn("type", dominant).select(
        "column",
        "rows",
        "missing",
        (F.col("missing") / F.col("rows") * 100).alias("null_percent"),
        "unique",
        "type",
        *[F.col(f"n_{k}").alias(f"{k.replace('-', '_')}_count") for k in TYPE_CLASSES],
        "whitespace",
        F.when(numeric, F.col("low")).alias("numeric_min"),
        F.when(numeric, F.col("high")).alias("numeric_max"),
        ((F.col("missing") == 0) & (F.col("unique") == F.col("rows"))).alias("candidate_identifier"),
    )


def examples(freq: DataFrame, k: int = 3) -> DataFrame:
    """First ``k`` distinct nonblank values per column."""
    return top_rows(freq.filter(~is_blank(F.col("value"))), ["column"], [F.asc("first_record")], k).select("column", "rank", "value")


def common_values(freq: DataFrame, k: int = 8) -> DataFrame:
    """Most frequent values per column; ties by first record."""
    return top_rows(freq, ["column"], [F.desc("n"), F.asc("first_record")], k).select("column", "rank", "value", "n")


def candidate_identifiers(freq: DataFrame) -> DataFrame:
    """Columns without blanks whose values are all distinct, with a name-based confidence."""
    found = column_profile(freq).filter("candidate_identifier and rows > 0")
    return found.select("column", F.when(F.col("column").rlike("(?i)id|key|code"), "High").otherwise("Low").alias("confidence"))


def key_statistics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, rows with an empty key part, repeated rows and distinct tuples of a composite key."""
    require(df, keys)
    groups = df.groupBy(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("n"))
    empty = F.lit(False)
    for i in range(len(keys)):
        empty = empty | (F.col(f"k{i}") == "")
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(empty, F.col("n"))), F.lit(0)).alias("blanks"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
        F.count("*").alias("distinct_tuples"),
    )


def approximate_distinct(df: DataFrame, error: float = 0.02) -> DataFrame:
    """Labelled approximate distinct nonblank counts: one sketch per column, no wide shuffle."""
    v = F.when(~is_blank(F.col("value")), F.col("value"))
    return unpivot_cells(df).groupBy("column").agg(F.approx_count_distinct(v, error).alias("approximate_unique"))


def status_rollup(dictionary: DataFrame) -> DataFrame:
    """Number of fields per interpretation status."""
    return dictionary.groupBy("status").agg(F.count("*").alias("fields"))


def finding_rollup(findings: DataFrame) -> DataFrame:
    """Number of findings per layer and severity."""
    return findings.groupBy("layer", "severity").agg(F.count("*").alias("findings"))
