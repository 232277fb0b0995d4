"""Streaming jobs. Each takes and returns a streaming DataFrame; ``run_available`` drains one into Parquet."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sedgetable.core import SRC, Field
from sedgetable.operators.findings import cell_findings
from sedgetable.operators.relationships import key_index
from sedgetable.scale import SALTS, shared_folder


def stream_cell_findings(stream: DataFrame, fields: Sequence[Field] | None = None, rules: Sequence[str] | None = None) -> DataFrame:
    """Row-local findings on arriving records: the batch expressions, without state."""
    return cell_findings(stream, fields, rules)


def link_arrivals(stream: DataFrame, parent: DataFrame, child_keys: Sequence[str], parent_keys: Sequence[str]) -> DataFrame:
    """Link outcome of arriving child records against a static parent.

    Heavy keys are spread by a salt on every arriving row; only parent keys are
    repeated, never parent rows. The index of the parent's keys is written once to
    the shared folder, so micro-batches read it instead of building it again.
    """
    names = [f"__k{i}" for i in range(len(child_keys))]
    found = key_index(parent.select(SRC, *[F.col(f"`{k}`").alias(n) for k, n in zip(parent_keys, names)]), names)
    kept = shared_folder(parent.sparkSession)
    found.write.parquet(kept)
    index = parent.sparkSession.read.schema(found.schema).parquet(kept)
    salts = 8
    spread = index.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keyed = stream.select(SRC, *[F.col(f"`{k}`").alias(n) for k, n in zip(child_keys, names)])
    keyed = keyed.withColumn("__salt", F.pmod(F.xxhash64(SRC), F.lit(salts)).cast("int"))
    empty = F.lit(False)
    for n in names:
        empty = empty | (F.col(n) == "")
    joined = keyed.join(spread, [*names, "__salt"], "left")
    status = F.when(empty, "missing").when(F.col("occurrences").isNull(), "unmatched").when(F.col("occurrences") != 1, "conflicting").otherwise("linked")
    joined = joined.withColumn("__link_status", status)
    return joined.select(SRC, "__link_status", F.when(F.col("__link_status") == "linked", F.col("sole_record")).alias("__parent_source_record"))


_SEEN = T.StructType([T.StructField("identifiers", T.ArrayType(T.StringType())), T.StructField("newest", T.ArrayType(T.LongType()))])
_FLAGGED = T.StructType([T.StructField("identifier", T.StringType()), T.StructField(SRC, T.LongType()), T.StructField("at", T.TimestampType()), T.StructField("repeat", T.BooleanType())])
# State groups of a stage. A group keeps the sightings of all its identifiers, so a batch costs calls by groups and not by identifiers.
GROUPS = 2048


def _flag(horizon_ms: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        kept = zip(*state.get) if state.exists else ()
        newest = {k: at for k, at in kept if at + horizon_ms > now}
        for batch in () if state.hasTimedOut else batches:
            if batch.empty:
                continue
            seen = batch["identifier"].isin(set(newest)) if newest else False
            flags = batch["identifier"].duplicated() | seen
            for k, at in batch.groupby("identifier", sort=False, dropna=False)["at"].max().items():
                k = None if pd.isna(k) else k
                newest[k] = max(newest.get(k, 0), now if pd.isna(at) else int(at.timestamp() * 1000))
            yield pd.DataFrame({"identifier": batch["identifier"], SRC: batch[SRC], "at": batch["at"], "repeat": flags})
        if not newest:
            if state.exists:
                state.remove()
            return
        state.update((list(newest), list(newest.values())))
        state.setTimeoutTimestamp(max(min(newest.values()) + horizon_ms, now + 1))

    return run


def _flag_groups(stream: DataFrame, keys: Sequence[str], horizon: str, horizon_ms: int) -> DataFrame:
    """Repeats of an identifier among the rows that share a group; rows that agree in ``keys`` do."""
    timed = stream.withWatermark("at", horizon).withColumn("group", F.pmod(F.xxhash64(*keys), F.lit(GROUPS)))
    return timed.groupBy("group").applyInPandasWithState(_flag(horizon_ms), _FLAGGED, _SEEN, "append", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, folder: str, name: str) -> str:
    """Drain what has arrived into a Parquet folder, with its own checkpoint beside it."""
    target = os.path.join(folder, name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", os.path.join(folder, f"{name}-checkpoint"))
        .trigger(availableNow=True)
        .outputMode("append")
        .start()
    )
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return target


def flag_repeats(spark: SparkSession, stream: DataFrame, folder: str, horizon: str = "1 hour", horizon_ms: int = 3_600_000) -> DataFrame:
    """Flag repeats of an identifier; ``stream(identifier, __source_record, at)``.

    State lives until the watermark passes the newest sighting plus the horizon.
    Rows that come later than the watermark cannot be compared with state; they
    are kept with a null flag, so nothing that arrived is lost. Two stages keep a
    hot identifier from filling one task: rows are first flagged in groups of
    (identifier, salt), and only the first row of an identifier in each group reaches
    the stage whose groups hold identifiers alone. The source is read twice, as files and logs can be.
    """
    arrived = run_available(stream.select("identifier", SRC, "at"), folder, "arrived")
    salted = stream.withColumn("salt", F.pmod(F.xxhash64(SRC), F.lit(SALTS)).cast("int"))
    first = run_available(_flag_groups(salted, ["identifier", "salt"], horizon, horizon_ms), folder, "salted")
    local = spark.read.schema(_FLAGGED).parquet(first)
    heads = spark.readStream.schema(_FLAGGED).parquet(first).filter("not repeat").select("identifier", SRC, "at")
    second = run_available(_flag_groups(heads, ["identifier"], horizon, horizon_ms), folder, "whole")
    flagged = local.filter("repeat").unionByName(spark.read.schema(_FLAGGED).parquet(second))
    late = spark.read.schema(_FLAGGED).parquet(arrived).join(flagged.select(SRC), SRC, "left_anti")
    return flagged.unionByName(late.select("identifier", SRC, "at", F.lit(None).cast("boolean").alias("repeat")))
