import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("sedgetable-tests")
        .config("spark.sql.shuffle.partitions", "3")
        .config("spark.driver.extraJavaOptions", "-XX:TieredStopAtLevel=1")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """Literal table from header and rows, numbered in order and spread over partitions."""
    from pyspark.sql import types as T

    def make(header, rows, partitions=3):
        schema = T.StructType([T.StructField("__source_record", T.LongType())] + [T.StructField(h, T.StringType()) for h in header])
        data = [(i, *row) for i, row in enumerate(rows, 1)]
        return spark.createDataFrame(data, schema).repartition(partitions)

    return make


@pytest.fixture
def one(spark):
    """Evaluate a column expression builder over a list of texts."""
    from pyspark.sql import functions as F

    def run(values, build):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        return [r["r"] for r in df.select("i", build(F.col("v")).alias("r")).orderBy("i").collect()]

    return run
