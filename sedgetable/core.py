"""The literal table contract: string columns plus technical ``__`` columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field as dataclass_field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sedgetable.functions.text import number_text

SRC = "__source_record"
WIDTH = "__row_width"

# Interpretation states, declared types and row outcomes.
STATUSES = ("Confirmed", "Inferred", "Unknown", "Conflicting", "Not Applicable")
DATA_TYPES = ("string", "integer", "number", "boolean", "date")
OUTCOMES = ("converted", "unchanged", "unresolved", "conflicting", "empty")


class TableError(ValueError):
    """A guard refused the whole operation; nothing was changed."""


@dataclass
class Field:
    """One dictionary row of one table, kept on the driver (a table has at most 250)."""

    name: str
    original_name: str = ""
    description: str = ""
    data_type: str = "string"
    unit: str = ""
    allowed: list[str] = dataclass_field(default_factory=list)
    missing_token: str = ""
    term: str = ""
    status: str = "Unknown"
    rationale: str = ""
    evidence: list[str] = dataclass_field(default_factory=list)
    reviewer: str = ""
    sensitive: bool = False
    source_index: int | None = None
    operation: str = ""
    source_fields: list[str] = dataclass_field(default_factory=list)
    outcome_field: str = ""


DICTIONARY = T.StructType(
    [
        T.StructField("table", T.StringType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("original_name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("data_type", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("allowed", T.ArrayType(T.StringType())),
        T.StructField("term", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("rationale", T.StringType()),
        T.StructField("reviewer", T.StringType()),
        T.StructField("sensitive", T.BooleanType()),
    ]
)


def data_columns(df: DataFrame) -> list[str]:
    """Recorded and derived columns, without the technical ones."""
    return [name for name in df.columns if not name.startswith("__")]


def require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise TableError(f"absent columns: {missing}")


def default_fields(df: DataFrame) -> list[Field]:
    return [Field(name, name, source_index=i) for i, name in enumerate(data_columns(df))]


def dictionary_frame(spark, table: str, fields: Sequence[Field]) -> DataFrame:
    rows = [
        (table, i, f.name, f.original_name, f.description, f.data_type, f.unit, list(f.allowed), f.term, f.status, f.rationale, f.reviewer, f.sensitive)
        for i, f in enumerate(fields)
    ]
    return spark.createDataFrame(rows, DICTIONARY)


def literal_text(df: DataFrame, name: str) -> Column:
    """Text of one typed column: null is blank, nested values are compact JSON."""
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        c = F.to_json(c)
    elif isinstance(kind, T.BinaryType):
        c = F.concat(F.lit("base64:"), F.base64(c))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        c = number_text(c.cast("double"))
    elif not isinstance(kind, T.StringType):
        c = c.cast("string")
    return F.coalesce(c, F.lit(""))


def literalise(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Turn typed columns into literal text; technical columns pass through."""
    chosen = list(columns) if columns is not None else data_columns(df)
    technical = [name for name in df.columns if name.startswith("__")]
    return df.select(*[F.col(name) for name in technical], *[literal_text(df, name).alias(name) for name in chosen])


def unpivot_cells(df: DataFrame, columns: Sequence[str] | None = None, keep: Sequence[str] = (SRC,)) -> DataFrame:
    """Narrow ``(…, column, value)`` form: one row per cell and no shuffle."""
    chosen = list(columns) if columns is not None else data_columns(df)
    return df.unpivot([F.col(k) for k in keep], [F.col(f"`{c}`") for c in chosen], "column", "value")


TESTS_PER_STEP = 3


def explode_marks(df: DataFrame, keep: Sequence[Column | str], tests: Sequence[Column]) -> DataFrame:
    """One row per test that holds, with the test's index as ``mark``; rows without any are dropped first.

    The tests are folded into one bit mask, a few per step: one step becomes one
    generated method, and a method with all tests would be too long to be
    compiled. Each step goes through a one-element array, which keeps the steps
    apart and the filter on the mask from being evaluated twice.
    """
    if len(tests) > 62:
        raise ValueError("at most 62 tests fit one mask")
    masked = df.withColumn("__mask", F.lit(0).cast("long"))
    for start in range(0, len(tests), TESTS_PER_STEP):
        mask = F.col("__mask")
        for i, test in enumerate(tests[start : start + TESTS_PER_STEP], start):
            mask = mask + F.when(test, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
        masked = masked.select(*df.columns, mask.alias("__mask")).select(*df.columns, F.explode(F.array("__mask")).alias("__mask"))
    marked = masked.filter(F.col("__mask") > 0).select(*keep, "__mask")
    every = F.array(*[F.lit(i) for i in range(len(tests))])
    return marked.withColumn("mark", F.explode(every)).filter(F.expr("shiftright(__mask, mark) & 1L = 1")).drop("__mask")
