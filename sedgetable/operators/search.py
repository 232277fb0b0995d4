"""Search, filter, sort, paging, provenance and derivation traces."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sedgetable.core import SRC, WIDTH, Field, TableError, data_columns, require
from sedgetable.functions.numbers import script_number_or_null
from sedgetable.functions.text import contains_folded, is_blank, numeric_sort_key
from sedgetable.scale import number_rows


def _any(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def search_rows(df: DataFrame, text: str) -> DataFrame:
    """Rows with the literal text inside any cell, ignoring case."""
    if text == "":
        return df
    return df.filter(_any([contains_folded(F.col(f"`{c}`"), text) for c in data_columns(df)]))


def filter_rows(df: DataFrame, any_column: str = "", per_column: Mapping[str, str] | None = None) -> DataFrame:
    """Any-column search and per-column substrings, all of which must hold."""
    wanted = {c: v for c, v in (per_column or {}).items() if v}
    require(df, list(wanted))
    out = search_rows(df, any_column)
    for column, text in wanted.items():
        out = out.filter(contains_folded(F.col(f"`{column}`"), text))
    return out


def sort_rows(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Sort with digit runs compared by value; ties keep record order."""
    require(df, [column])
    key = numeric_sort_key(F.col(f"`{column}`"))
    return df.orderBy(key.asc() if ascending else key.desc(), F.col(SRC).asc())


def sorted_positions(df: DataFrame, column: str) -> DataFrame:
    """The order of :func:`sort_rows` as a column ``position``; no task sorts the whole table."""
    require(df, [column])
    keyed = df.withColumn("__key", numeric_sort_key(F.col(f"`{column}`")))
    return number_rows(keyed, ["__key", SRC], "position").drop("__key")


def page(df: DataFrame, offset: int = 0, limit: int = 50, text: str = "") -> DataFrame:
    """Rows ``offset + 1`` to ``offset + limit`` of those that match, in record order, whatever their numbers."""
    if limit < 1 or offset < 0:
        raise TableError("a page has at least one row and an offset of at least zero")
    return search_rows(df, text).orderBy(SRC).offset(offset).limit(limit)


def page_total(df: DataFrame, text: str = "") -> DataFrame:
    return search_rows(df, text).agg(F.count("*").alias("total"))


def rows_of_finding(df: DataFrame, findings: DataFrame) -> DataFrame:
    """Records named by a finding."""
    return df.join(findings.select(SRC).filter(F.col(SRC).isNotNull()).distinct(), SRC, "left_semi")


def cell_provenance(baseline: DataFrame, working: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """Per cell: recorded value, working value and whether it changed.

    The recorded value is null for derived cells and for cells that only exist
    because a short source row was padded.
    """
    originals = data_columns(baseline)
    recorded = []
    for f in fields:
        if f.source_index is None or f.source_index >= len(originals):
            recorded.append(F.lit(None).cast("string"))
            continue
        cell = F.col(f"b.`{originals[f.source_index]}`")
        recorded.append(F.when(F.lit(f.source_index) < F.col(f"b.{WIDTH}"), cell) if WIDTH in baseline.columns else cell)
    cells = F.array(
        *[
            F.struct(F.lit(f.name).alias("column"), original.alias("original"), F.col(f"w.`{f.name}`").alias("working"), F.lit(bool(f.operation)).alias("derived"))
            for f, original in zip(fields, recorded)
        ]
    )
    joined = working.alias("w").join(baseline.alias("b"), SRC, "left")
    changed = F.col("original").isNotNull() & (F.col("original") != F.col("working"))
    return joined.select(SRC, F.explode(cells).alias("cell")).select(SRC, "cell.*").withColumn("changed", changed)


def field_context(df: DataFrame, column: str, top: int = 12) -> DataFrame:
    """Most common values of one field with the field's blank, distinct and row counts."""
    require(df, [column])
    freq = df.groupBy(F.col(f"`{column}`").alias("value")).agg(F.count("*").alias("n"), F.min(SRC).alias("first_record"))
    whole = freq.agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("value") == "", F.col("n"))), F.lit(0)).alias("blanks"),
        F.count("*").alias("distinct_values"),
    ).select(F.struct("rows", "blanks", "distinct_values").alias("w")).scalar()
    best = freq.orderBy(F.desc("n"), F.asc("first_record")).limit(top)
    return best.select("value", "n", "first_record", whole.getField("rows").alias("rows"), whole.getField("blanks").alias("blanks"), whole.getField("distinct_values").alias("distinct_values"))


def plot_points(df: DataFrame, latitude: str, longitude: str) -> DataFrame:
    """Rows whose two coordinates are numbers in range."""
    require(df, [latitude, longitude])
    a, b = F.col(f"`{latitude}`"), F.col(f"`{longitude}`")
    points = df.filter(~is_blank(a) & ~is_blank(b)).select(SRC, script_number_or_null(a).alias("lat"), script_number_or_null(b).alias("lon"))
    return points.filter((F.abs("lat") <= 90) & (F.abs("lon") <= 180))


def derivation_paths(fields: Sequence[Field], source: str) -> dict[str, list[str]]:
    """Derived field name to the path of names leading to it from ``source``."""
    by_name = {f.name: f for f in fields}

    def paths(name: str, active: tuple[str, ...]) -> dict[str, list[str]]:
        if name in active:
            raise TableError(f"derivation cycle at {name}")
        if name not in by_name:
            raise TableError(f"derivation names an absent field: {name}")
        field = by_name[name]
        if field.source_index is not None or not field.operation:
            return {name: [name]}
        if not field.source_fields:
            raise TableError(f"derived field without sources: {name}")
        found: dict[str, list[str]] = {}
        for parent in field.source_fields:
            for root, path in paths(parent, (*active, name)).items():
                found.setdefault(root, [*path, name])
        return found

    root = next(iter(paths(source, ())))
    out = {}
    for field in fields:
        path = paths(field.name, ()).get(root)
        if field.operation and path and len(path) > 1:
            out[field.name] = path
    return out


def derivation_trace(df: DataFrame, fields: Sequence[Field], source: str) -> DataFrame:
    """Per record and derived field: value, outcome, trace of names and input values."""
    by_name = {f.name: f for f in fields}
    root = source
    items = []
    for name, path in derivation_paths(fields, source).items():
        field, root = by_name[name], path[0]
        items.append(
            F.struct(
                F.lit(name).alias("derived"),
                F.col(f"`{name}`").alias("value"),
                (F.col(f"`{field.outcome_field}`") if field.outcome_field else F.lit(None).cast("string")).alias("outcome"),
                F.lit(" > ".join(path)).alias("trace"),
                F.to_json(F.struct(*[F.col(f"`{s}`").alias(s) for s in field.source_fields])).alias("inputs"),
            )
        )
    if not items:
        raise TableError(f"no field is derived from {source}")
    return df.select(SRC, F.col(f"`{root}`").alias("recorded"), F.explode(F.array(*items)).alias("d")).select(SRC, "recorded", "d.*")
