"""Literal comparison of two tables or two versions of one table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from sedgetable.core import SRC, TableError, data_columns, require
from sedgetable.operators.equality import same_rows
from sedgetable.operators.relationships import any_empty
from sedgetable.scale import salted_join, table_digest


def _side(df: DataFrame, side: str, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    cells = F.struct(*[F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(fields)])
    return df.select(
        *[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)],
        F.lit(side).alias("side"),
        F.col(SRC).alias("record"),
        cells.alias("cells"),
    )


def compare_tables(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], fields: Sequence[tuple[str, str]]) -> DataFrame:
    """Key-aligned comparison: one row per pair or per record without a single counterpart.

    Both sides meet in one grouping on the key, combined before the shuffle.
    Pairs and lone records come straight from the groups; only records of
    repeated keys are looked up again, with heavy keys spread.
    """
    for pairs, most in ((keys, 5), (fields, 100)):
        if not 1 <= len(pairs) <= most or len(set(pairs)) != len(pairs):
            raise TableError(f"choose one to {most} distinct column pairs")
    require(left, [p[0] for p in (*keys, *fields)])
    require(right, [p[1] for p in (*keys, *fields)])
    names = [f"k{i}" for i in range(len(keys))]
    rows = _side(left, "left", [k[0] for k in keys], [f[0] for f in fields]).unionByName(_side(right, "right", [k[1] for k in keys], [f[1] for f in fields]))
    is_left = F.col("side") == "left"
    empty = any_empty(names)

    groups = (
        rows.filter(~empty)
        .groupBy(*names)
        .agg(
            F.count_if(is_left).alias("lc"),
            F.count_if(~is_left).alias("rc"),
            F.min(F.when(is_left, F.col("record"))).alias("left_record"),
            F.min(F.when(~is_left, F.col("record"))).alias("right_record"),
            F.first(F.when(is_left, F.col("cells")), ignorenulls=True).alias("a"),
            F.first(F.when(~is_left, F.col("cells")), ignorenulls=True).alias("b"),
        )
    )
    single = (F.col("lc") <= 1) & (F.col("rc") <= 1)
    changed = F.array_compact(F.array(*[F.when(F.col(f"a.f{i}") != F.col(f"b.f{i}"), F.lit(i)) for i in range(len(fields))]))
    paired = (F.col("lc") == 1) & (F.col("rc") == 1)
    status = F.when(paired, F.when(F.size(changed) > 0, "different").otherwise("equal")).when(F.col("rc") == 0, "leftOnly").otherwise("rightOnly")
    nothing = F.array().cast("array<int>")
    lone = groups.filter(single).select(
        status.alias("status"),
        F.col("left_record").alias("left_record"),
        F.col("right_record").alias("right_record"),
        "lc",
        "rc",
        F.when(paired, changed).otherwise(nothing).alias("changed_fields"),
    )

    repeated = groups.filter(~single).select(*names, "lc", "rc")
    again = salted_join(rows.filter(~empty).select(*names, "side", "record"), repeated, names, "inner", spread_by=["record", "side"])
    group_status = F.when((F.col("lc") > 0) & (F.col("rc") > 0), "ambiguous").when(is_left, "leftOnly").otherwise("rightOnly")
    left_record, right_record = F.when(is_left, F.col("record")), F.when(~is_left, F.col("record"))
    many = again.select(group_status.alias("status"), left_record.alias("left_record"), right_record.alias("right_record"), "lc", "rc", nothing.alias("changed_fields"))

    zero = F.lit(0).cast("long")
    no_key = rows.filter(empty).select(
        F.when(is_left, "leftMissingKey").otherwise("rightMissingKey").alias("status"),
        left_record.alias("left_record"),
        right_record.alias("right_record"),
        zero.alias("lc"),
        zero.alias("rc"),
        nothing.alias("changed_fields"),
    )
    out = lone.unionByName(many).unionByName(no_key)
    return out.withColumnsRenamed({"lc": "left_multiplicity", "rc": "right_multiplicity"})


def comparison_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("status").agg(F.count("*").alias("records"))


def duplicate_key_groups(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """Number of keys that occur more than once, per side."""
    parts = []
    for df, side, i in ((left, "left", 0), (right, "right", 1)):
        names = [k[i] for k in keys]
        require(df, names)
        groups = df.filter(~any_empty(names)).groupBy(*[F.col(f"`{n}`") for n in names]).agg(F.count("*").alias("n"))
        parts.append(groups.agg(F.count_if(F.col("n") > 1).alias("duplicate_key_groups")).select(F.lit(side).alias("side"), "duplicate_key_groups"))
    return reduce(DataFrame.unionByName, parts)


def version_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows added and removed as a multiset, and the columns that differ.

    Each side is counted per distinct row and the counts are subtracted, so
    repeated rows travel once.
    """
    before, after = data_columns(old), data_columns(new)
    parts = []
    for df, names, delta in ((new, after, 1), (old, before, -1)):
        row = F.to_json(F.array(*[F.col(f"`{c}`") for c in names]))
        parts.append(df.select(row.alias("row"), F.lit(delta).alias("d")))
    net = parts[0].unionAll(parts[1]).groupBy("row").agg(F.sum("d").alias("d"))
    return net.agg(
        F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("d"))), F.lit(0)).alias("added_rows"),
        F.coalesce(F.sum(F.when(F.col("d") < 0, -F.col("d"))), F.lit(0)).alias("removed_rows"),
    ).select(
        "added_rows",
        "removed_rows",
        F.lit(",".join(c for c in after if c not in before)).alias("added_columns"),
        F.lit(",".join(c for c in before if c not in after)).alias("removed_columns"),
    )


def dictionary_changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Dictionary rows that appear in one version only."""
    gone = old.exceptAll(new).select("table", "name", F.lit("removed").alias("change"))
    return gone.unionByName(new.exceptAll(old).select("table", "name", F.lit("added").alias("change")))


def verify_comparison(report: DataFrame, left: DataFrame, right: DataFrame, keys, fields) -> DataFrame:
    """Recompute a delivered comparison and compare every record."""
    text = lambda df: df.withColumn("changed_fields", F.to_json("changed_fields"))
    return same_rows(text(report), text(compare_tables(left, right, keys, fields)))


def check_fingerprint(df: DataFrame, expected: str) -> DataFrame:
    """Digest of the table and whether it is the expected one."""
    return table_digest(df).withColumn("matches", F.col("digest") == expected)


def guard_fingerprint(df: DataFrame, expected: str) -> DataFrame:
    """Refuse to go on when the table is not the one that was reviewed."""
    if table_digest(df).first()["digest"] != expected:
        raise TableError("the table changed since it was reviewed")
    return df
