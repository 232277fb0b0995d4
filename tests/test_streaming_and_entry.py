import os
import re

from pyspark.sql import functions as F

import __spark_entry__ as contract
from sedgetable.core import SRC
from sedgetable.operators import relationships as R
from sedgetable.scale import number_rows, salted_join
from sedgetable.streaming import flag_repeats, link_arrivals, run_available

SF = "/root/testdata/sf0.001"


def test_every_query_has_a_callable_and_known_sql():
    names = set(contract.queries())
    assert set(contract.oracle_sql()) <= names
    for wanted in [f"f{i:02d}" for i in range(1, 37)] + [f"r{i:02d}" for i in range(1, 14)] + [f"q{i:02d}" for i in range(1, 10)]:
        assert any(n.startswith(wanted + "_") for n in names), wanted


def test_flagship_keeps_every_order(spark):
    df = contract.entry(spark)
    assert df.count() == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_stream_links_match_the_batch_result(spark, table, tmp_path):
    parent = table(["k", "v"], [("1", "a"), ("2", "b"), ("2", "c")])
    child = table(["k"], [("1",), ("2",), ("3",), ("",)] * 5)
    child.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(child.schema).parquet(str(tmp_path / "in"))
    out = spark.read.parquet(run_available(link_arrivals(stream, parent, ["k"], ["k"]), str(tmp_path), "out"))
    batch = R.link_status(child, parent, ["k"], ["k"]).select(SRC, "__link_status", "__parent_source_record")
    assert out.exceptAll(batch).count() == 0 and batch.exceptAll(out).count() == 0


def test_stream_repeats_split_a_hot_identifier(spark, tmp_path):
    rows = [("hot" if i % 3 == 0 else f"id{i % 50}", i, 1_600_000_000 + i) for i in range(600)]
    df = spark.createDataFrame(rows, f"identifier string, {SRC} long, s long").withColumn("at", F.timestamp_seconds("s")).drop("s")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    flagged = flag_repeats(spark, stream, str(tmp_path / "out"))
    got = {r.identifier: (r.f, r.n) for r in flagged.groupBy("identifier").agg(F.count_if(~F.col("repeat")).alias("f"), F.count("*").alias("n")).collect()}
    assert got == {k: (1, n) for k, n in {r.identifier: r.n for r in df.groupBy("identifier").agg(F.count("*").alias("n")).collect()}.items()}


def test_late_stream_rows_are_kept(spark, tmp_path):
    import time

    for n, (key, minute) in enumerate([("a", 0), ("b", 300), ("b", 301), ("b", 302), ("a", 5)]):
        row = spark.createDataFrame([(key, n, 1_600_000_000 + 60 * minute)], f"identifier string, {SRC} long, s long")
        row.withColumn("at", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken by age
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    flagged = flag_repeats(spark, stream, str(tmp_path / "out"), "1 minute", 60_000)
    got = {r[SRC]: r["repeat"] for r in flagged.collect()}
    assert got == {0: False, 1: False, 2: True, 3: True, 4: None}


def test_stream_state_is_kept_for_groups_of_identifiers(spark, tmp_path):
    """State follows identifiers over batches, nulls included, but its rows are as few as the groups."""
    import time

    for n in range(2):
        df = spark.range(6000).select(F.when(F.col("id") < 5999, F.concat(F.lit("id"), F.col("id"))).alias("identifier"), (F.col("id") + 6000 * n).alias(SRC), F.timestamp_seconds(F.lit(1_600_000_000) + n).alias("at"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    flagged = flag_repeats(spark, stream, str(tmp_path / "out"))
    by = flagged.groupBy("identifier").agg(F.count_if(~F.col("repeat")).alias("f"), F.count_if("repeat").alias("r"))
    assert by.filter("f = 1 and r = 1").count() == by.count() == 6000
    states = spark.read.format("statestore").option("path", str(tmp_path / "out" / "whole-checkpoint")).load()
    assert 0 < states.count() <= 2048


def test_salting_spreads_a_heavy_key(spark, table):
    big = table(["k"], [("hot",)] * 400 + [(str(i),) for i in range(50)], 4)
    small = spark.createDataFrame([("hot", 1), ("7", 2)], "k string, x int")
    for how, expected in (("left", 450), ("inner", 401), ("left_semi", 401), ("left_anti", 49)):
        assert salted_join(big, small, ["k"], how).count() == expected
    plan = salted_join(big, small, ["k"])._jdf.queryExecution().toString()
    assert "approx_top_k" in plan


def test_numbering_is_contiguous_over_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v")).repartition(9)
    numbered = number_rows(df, ["v"], "n")
    assert numbered.filter(F.col("n") != F.col("v") + 1).count() == 0


def test_sources_name_no_forbidden_shortcuts():
    root = os.path.join(os.path.dirname(__file__), "..", "sedgetable")
    for folder, _, files in os.walk(root):
        for name in files:
            if name.endswith(".py"):
                text = open(os.path.join(folder, name), encoding="utf-8").read()
                assert not re.search(r"localCheckpoint|crossJoin|CROSS JOIN|toPandas\(", text), name
