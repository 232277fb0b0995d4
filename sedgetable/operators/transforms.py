"""Spec-driven table operations. Each keeps the record number and never edits its input.

Strict operations refuse as a whole when one value does not fit; the check is
one aggregate and happens before the result is handed out.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from sedgetable.core import DATA_TYPES, SRC, Field, TableError, data_columns, require, unpivot_cells
from sedgetable.functions.coordinates import degrees_or_null
from sedgetable.functions.dates import strict_date
from sedgetable.functions.numbers import decimal_or_null, fits_declared_type
from sedgetable.functions.text import number_text, trim_space
from sedgetable.operators.findings import PLACE_NAME, PLACE_TERMS
from sedgetable.scale import first_rows, salted_join


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _refuse_if(df: DataFrame, bad: Column, message: str) -> None:
    if df.filter(bad).limit(1).count():
        raise TableError(message)


def trim_column(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, trim_space(_col(column)))


def change_case(df: DataFrame, column: str, upper: bool) -> DataFrame:
    return df.withColumn(column, F.upper(_col(column)) if upper else F.lower(_col(column)))


def replace_value(df: DataFrame, column: str, match: str, value: str) -> DataFrame:
    return df.withColumn(column, F.when(_col(column) == match, value).otherwise(_col(column)))


def normalise_missing(df: DataFrame, column: str, token: str) -> DataFrame:
    if not token:
        raise TableError("name the missing-value token")
    return replace_value(df, column, token, "")


def map_codes(df: DataFrame, column: str, mapping: Mapping[str, str] | DataFrame) -> DataFrame:
    """Replace codes by their meaning; codes outside the mapping stay.

    A mapping is a small dict, or a ``(code, meaning)`` table of any size with
    one row per code.
    """
    require(df, [column])
    if isinstance(mapping, DataFrame):
        lookup = mapping.select(F.col("code").alias(column), F.col("meaning").alias("__meaning"))
        out = salted_join(df, lookup, [column])
        return out.withColumn(column, F.coalesce("__meaning", _col(column))).select(*df.columns)
    if not mapping:
        return df
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return df.withColumn(column, F.coalesce(F.try_element_at(pairs, _col(column)), _col(column)))


def replace_cell(df: DataFrame, record: int, column: str, value: str) -> DataFrame:
    return df.withColumn(column, F.when(F.col(SRC) == record, value).otherwise(_col(column)))


def rename_column(df: DataFrame, column: str, name: str) -> DataFrame:
    name = name.strip()
    if not name or (name != column and name in df.columns):
        raise TableError("the new name is blank or taken")
    require(df, [column])
    return df.withColumnRenamed(column, name)


def rename_field(fields: Sequence[Field], column: str, name: str) -> list[Field]:
    """Carry a rename through names, derivations and outcome links."""
    swap = lambda n: name if n == column else n
    return [replace(f, name=swap(f.name), source_fields=[swap(s) for s in f.source_fields], outcome_field=swap(f.outcome_field)) for f in fields]


def reorder_column(df: DataFrame, column: str, position: int) -> DataFrame:
    """Move a column to a one-based position among the data columns."""
    names = data_columns(df)
    require(df, [column])
    if not 1 <= position <= len(names):
        raise TableError("position outside the table")
    names.remove(column)
    names.insert(position - 1, column)
    return df.select(*[c for c in df.columns if c.startswith("__")], *[_col(c) for c in names])


def drop_repeats(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Remove rows that repeat an earlier row in the chosen columns."""
    keys = list(keys) or data_columns(df)
    require(df, keys)
    return first_rows(df, keys)


def _derive(df: DataFrame, name: str, value: Column) -> DataFrame:
    name = name.strip()
    if not name or name in df.columns:
        raise TableError("the derived name is blank or taken")
    return df.withColumn(name, value)


def derive_copy(df: DataFrame, column: str, name: str) -> DataFrame:
    require(df, [column])
    return _derive(df, name, _col(column))


def split_column(df: DataFrame, column: str, separator: str, part: int, name: str) -> DataFrame:
    """The ``part``-th piece between literal separators; blank where there is none."""
    if not separator or part < 1:
        raise TableError("a separator and a part of at least 1 are needed")
    return _derive(df, name, F.split_part(_col(column), F.lit(separator), F.lit(part)))


def merge_columns(df: DataFrame, column: str, other: str, name: str, separator: str = " ") -> DataFrame:
    require(df, [column, other])
    return _derive(df, name, F.concat(_col(column), F.lit(separator), _col(other)))


def _strict(df: DataFrame, column: str, name: str, value: Column, message: str) -> DataFrame:
    out = _derive(df, name, value)
    _refuse_if(out, _col(name).isNull(), message)
    return out


def convert_by_factor(df: DataFrame, column: str, name: str, factor: float, offset: float = 0.0) -> DataFrame:
    number = decimal_or_null(_col(column)) * F.lit(float(factor)) + F.lit(float(offset))
    value = F.when(_col(column) == "", "").otherwise(number_text(F.when(F.abs(number) < F.lit(float("inf")), number)))
    return _strict(df, column, name, value, "a value is not a finite number")


def parse_dates(df: DataFrame, column: str, name: str, fmt: str, far: bool = False) -> DataFrame:
    """Dates of one confirmed format. Serial numbers end with the year 9999, unless ``far`` allows later ones."""
    return _strict(df, column, name, strict_date(_col(column), fmt, far), "a value is not a date of the confirmed format")


def convert_coordinates(df: DataFrame, column: str, name: str, axis: str) -> DataFrame:
    return _strict(df, column, name, degrees_or_null(_col(column), axis), "a value is not a coordinate of this axis")


def declare_type(df: DataFrame, fields: Sequence[Field], column: str, data_type: str) -> list[Field]:
    """Change a declaration after every nonempty value was found to fit; stored text is untouched."""
    if data_type not in DATA_TYPES:
        raise TableError(f"unknown type: {data_type}")
    require(df, [column])
    _refuse_if(df, (_col(column) != "") & ~F.coalesce(fits_declared_type(_col(column), data_type), F.lit(False)), "a value does not fit the type")
    return [replace(f, data_type=data_type) if f.name == column else f for f in fields]


def inherits_sensitivity(fields: Sequence[Field], sources: Sequence[str]) -> bool:
    """A derived field is sensitive when a source is flagged, mapped or named as a place."""
    import re

    by_name = {f.name: f for f in fields}
    return any(re.search(PLACE_NAME, s) or (s in by_name and (by_name[s].sensitive or by_name[s].term in PLACE_TERMS)) for s in sources)


def derived_field(fields: Sequence[Field], name: str, operation: str, sources: Sequence[str], confirmed: bool = False, reason: str = "", unit: str = "") -> Field:
    return Field(
        name,
        name,
        description=f"{operation} of {sources[0]}",
        unit=unit,
        status="Confirmed" if confirmed else "Inferred",
        rationale=reason,
        operation=operation,
        source_fields=list(sources),
        sensitive=inherits_sensitivity(fields, sources),
    )


# Preview, batches and recipes.

Spec = dict
_OPERATIONS: dict[str, Callable[..., DataFrame]] = {
    "trim whitespace": lambda df, s: trim_column(df, s["column"]),
    "uppercase": lambda df, s: change_case(df, s["column"], True),
    "lowercase": lambda df, s: change_case(df, s["column"], False),
    "replace value": lambda df, s: replace_value(df, s["column"], s["match"], s["value"]),
    "normalize missing": lambda df, s: normalise_missing(df, s["column"], s["value"]),
    "map codes": lambda df, s: map_codes(df, s["column"], s["mapping"]),
    "replace cell": lambda df, s: replace_cell(df, s["record"], s["column"], s["value"]),
    "rename column": lambda df, s: rename_column(df, s["column"], s["value"]),
    "reorder column": lambda df, s: reorder_column(df, s["column"], s["position"]),
    "remove duplicate rows": lambda df, s: drop_repeats(df, s.get("keys", ())),
    "derive field": lambda df, s: derive_copy(df, s["column"], s["name"]),
    "parse dates": lambda df, s: parse_dates(df, s["column"], s["name"], s["format"], s.get("far", False)),
    "convert coordinates": lambda df, s: convert_coordinates(df, s["column"], s["name"], s["axis"]),
    "convert units": lambda df, s: convert_by_factor(df, s["column"], s["name"], s["factor"], s.get("offset", 0.0)),
    "split column": lambda df, s: split_column(df, s["column"], s["separator"], s["part"], s["name"]),
    "merge columns": lambda df, s: merge_columns(df, s["column"], s["other"], s["name"], s.get("separator", " ")),
}
# Operations that interpret values need an explicit confirmation in their spec.
_CONFIRMED = {"parse dates", "convert coordinates", "convert units", "normalize missing", "map codes"}


def transform(df: DataFrame, spec: Spec) -> DataFrame:
    """Apply one operation spec. ``{"op": …, "column": …}``"""
    op = spec.get("op")
    if op not in _OPERATIONS:
        raise TableError(f"unknown operation: {op}")
    if op in _CONFIRMED and not spec.get("confirmed"):
        raise TableError(f"{op} needs confirmation")
    if "column" in spec:
        require(df, [spec["column"]])
    return _OPERATIONS[op](df, spec)


def preview(before: DataFrame, after: DataFrame, column: str, changed_column: str | None = None, k: int = 5) -> DataFrame:
    """First ``k`` changed cells with the number of all changed cells."""
    a = before.select(SRC, _col(column).alias("before"))
    b = after.select(SRC, _col(changed_column or column).alias("after"))
    changed = a.join(b, SRC).filter("before <> after")
    total = changed.agg(F.count("*")).scalar()
    return changed.orderBy(SRC).limit(k).withColumn("affected", total)


def trim_preview(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Affected cells per column of a trim, in one scan."""
    v = F.col("value")
    return unpivot_cells(df, columns).groupBy("column").agg(F.count_if(v != trim_space(v)).alias("affected"))


def mechanical_batch(tables: Mapping[str, DataFrame], targets: Sequence[tuple[str, str]]) -> dict[str, DataFrame]:
    """Trim up to 100 distinct (table, column) targets; one projection per table, all or nothing."""
    if not 1 <= len(targets) <= 100 or len(set(targets)) != len(targets):
        raise TableError("choose one to 100 distinct targets")
    for table, column in targets:
        if table not in tables:
            raise TableError(f"absent table: {table}")
        require(tables[table], [column])
    out = dict(tables)
    for table in {t for t, _ in targets}:
        columns = {c for t, c in targets if t == table}
        out[table] = tables[table].withColumns({c: trim_space(_col(c)) for c in columns})
    return out


@dataclass(frozen=True)
class Recipe:
    """Ordered specs with the source they were reviewed against."""

    source_sha256: str
    source_bytes: int
    headers: tuple[str, ...]
    steps: tuple[Spec, ...]
    schema_version: int = 1


def replay(baseline: DataFrame, recipe: Recipe, source_sha256: str, source_bytes: int, schema_version: int = 1) -> DataFrame:
    """Rebuild a working table from its baseline; refuses when the source or header differs."""
    if (source_sha256, source_bytes) != (recipe.source_sha256, recipe.source_bytes):
        raise TableError("the source is not the one of the recipe")
    if tuple(data_columns(baseline)) != recipe.headers or schema_version != recipe.schema_version:
        raise TableError("the table definition is not the one of the recipe")
    return reduce(transform, recipe.steps, baseline)


