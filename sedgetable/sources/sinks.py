"""Ordered CSV output and checksum manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sedgetable.core import SRC, data_columns
from sedgetable.sources.manifest import source_manifest


def write_csv(df: DataFrame, path: str) -> str:
    """Header and rows in record order: part files follow the record ranges and each is sorted inside."""
    names = data_columns(df)
    ordered = df.repartitionByRange(F.col(SRC)).sortWithinPartitions(SRC).select(*[F.col(f"`{c}`") for c in names])
    ordered.write.options(
        header=True, quote='"', escape='"', lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        # A lone blank cell would otherwise be a blank line, which readers drop.
        emptyValue='""' if len(names) == 1 else "",
    ).mode("errorifexists").csv(path)
    return path


def write_baseline(df: DataFrame, path: str) -> str:
    """Immutable columnar copy, clustered by record so record ranges prune row groups."""
    df.repartitionByRange(F.col(SRC)).sortWithinPartitions(SRC).write.mode("errorifexists").parquet(path)
    return path


def checksum_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """File, bytes and SHA-256 of an output folder, without Spark's own bookkeeping files."""
    return source_manifest(spark, folder).filter(~F.col("file").rlike("(^|/)[._]")).select("file", "bytes", "sha256")
