"""Redacted copies, descriptors, term-mapped projections and star exports."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from sedgetable.core import Field, TableError, data_columns
from sedgetable.functions.numbers import record_number_or_null
from sedgetable.functions.text import number_text
from sedgetable.operators.findings import PLACE_NAME, PLACE_TERMS
from sedgetable.operators.validation import star_findings
from sedgetable.scale import salted_join

# Fixed value: address of bare term names.
TERM_BASE = "http://rs.tdwg.org/dwc/terms/"


def is_sensitive(field: Field) -> bool:
    return bool(re.search(PLACE_NAME, f"{field.name} {field.original_name}")) or field.term in PLACE_TERMS or field.sensitive


def public_table(df: DataFrame, fields: Sequence[Field], mode: str, precision: int = 1) -> DataFrame:
    """Blank sensitive columns, or round confirmed decimal coordinates.

    Rounding is half-even on the decimal text of the number.
    """
    if mode not in ("redact", "generalize") or not 0 <= precision <= 3:
        raise TableError("choose redact or generalize with 0 to 3 decimals")
    changes = {}
    for f in fields:
        if not is_sensitive(f):
            continue
        c = F.col(f"`{f.name}`")
        decimal = f.term in ("decimalLatitude", "decimalLongitude") and f.status == "Confirmed"
        if mode == "generalize" and decimal and not f.sensitive:
            rounded = F.bround(record_number_or_null(c), precision)
            plain = number_text(rounded)
            plain = F.when(plain.contains("."), plain).otherwise(F.concat(plain, F.lit(".0")))
            # Only texts with an exponent are written anew.
            changes[f.name] = F.coalesce(F.when(rounded.cast("string").contains("E"), plain).otherwise(rounded.cast("string")), F.lit(""))
        else:
            changes[f.name] = F.lit("")
    return df.withColumns(changes) if changes else df


def term_address(term):
    return F.when(term.rlike("^https?://"), term).otherwise(F.concat(F.lit(TERM_BASE), term))


def field_descriptors(dictionary: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Published field rows: type, unit, status, vocabulary and the term only when confirmed."""
    settled = (F.col("term") != "") & (F.col("status") == "Confirmed")
    out = dictionary.select(
        "table",
        "position",
        "name",
        F.col("data_type").alias("type"),
        "description",
        "unit",
        "status",
        F.when(F.size("allowed") > 0, F.to_json("allowed")).otherwise("").alias("enum"),
        F.when(settled, term_address(F.col("term"))).otherwise("").alias("term_address"),
    )
    if keys is None:
        return out
    marked = keys.select("table", "name").distinct().withColumn("primary_key", F.lit(True))
    return out.join(marked, ["table", "name"], "left").withColumn("primary_key", F.coalesce("primary_key", F.lit(False)))


def mapping_findings(dictionary: DataFrame, mapping: DataFrame, targets: DataFrame) -> DataFrame:
    """Why tables cannot be projected onto a target schema.

    ``mapping(table, name, target_table, target)``, ``targets(target_table,
    target, term_address)``; every source column needs one distinct target whose
    term is the column's confirmed term.
    """
    own = dictionary.select("table", "name", "status", "term")
    joined = salted_join(own.join(mapping, ["table", "name"], "left"), targets, ["target_table", "target"])
    rule = (
        F.when(F.col("target").isNull(), "column not mapped")
        .when(F.col("term_address").isNull(), "target field unknown")
        .when((F.col("status") != "Confirmed") | (F.col("term") == "") | (term_address(F.col("term")) != F.col("term_address")), "term not confirmed for target")
    )
    one = joined.select("table", "name", rule.alias("rule")).filter("rule is not null")
    twice = mapping.groupBy("table", "target").agg(F.count("*").alias("n")).filter("n > 1").select("table", F.col("target").alias("name"), F.lit("target used twice").alias("rule"))
    merged = mapping.select("table", "target_table").distinct().groupBy("target_table").agg(F.count("*").alias("n"), F.min("table").alias("table"))
    clash = merged.filter("n > 1").select("table", F.col("target_table").alias("name"), F.lit("two tables share a target").alias("rule"))
    return one.unionByName(twice).unionByName(clash)


def mapped_projection(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename every data column to its reviewed, distinct target field."""
    names = data_columns(df)
    if set(mapping) != set(names) or len(set(mapping.values())) != len(names):
        raise TableError("every column needs one distinct target field")
    return df.select(*[F.col(c) for c in df.columns if c.startswith("__")], *[F.col(f"`{c}`").alias(mapping[c]) for c in names])


def star_export(core: DataFrame, core_id: str, extensions: Mapping[str, tuple[DataFrame, str]], folder: str) -> dict[str, str]:
    """Write core and extension tables after the star check passed; returns their folders."""
    from sedgetable.sources.sinks import write_csv

    first = star_findings(core, core_id, extensions).first()
    if first is not None:
        raise TableError(f"star export refused: {first['rule']} in {first['table']}")
    out = {"core": os.path.join(folder, "core")}
    write_csv(core, out["core"])
    for name, (df, _) in extensions.items():
        out[name] = os.path.join(folder, name)
        write_csv(df, out[name])
    return out
