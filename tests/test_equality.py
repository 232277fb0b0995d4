"""Equality by signed digests: multisets, nulls, types, and the ranges and records that differ."""

import pytest

from sedgetable.core import SRC, TableError
from sedgetable.operators.equality import differing_ranges, differing_records, same_rows

SCHEMA = f"{SRC} bigint, a string, b string"


def test_counts_are_those_of_multisets(spark):
    left = spark.createDataFrame([(1, "x", None), (1, "x", None), (2, "1:", "2"), (3, "", "-")], SCHEMA)
    right = spark.createDataFrame([(1, "x", None), (2, "1", ":2"), (3, "", "-"), (3, "", "-"), (4, None, "x")], SCHEMA)
    assert tuple(same_rows(left, right).first()) == (4, 5, 2, 3)
    assert tuple(same_rows(left, left.select("b", "a", SRC).repartition(3)).first()) == (4, 4, 0, 0)
    assert tuple(same_rows(left.limit(0), right.limit(0)).first()) == (0, 0, 0, 0)
    with pytest.raises(TableError):
        same_rows(left, right.drop("b"))


def test_types_meet_as_in_a_union_and_nested_values_count(spark):
    left = spark.sql("SELECT 1 AS n, array('a', null) AS v, X'FF' AS x, map('k', 1) AS m")
    assert tuple(same_rows(left, spark.sql("SELECT 1L AS n, array('a', null) AS v, X'FF' AS x, map('k', 1) AS m")).first()) == (1, 1, 0, 0)
    assert tuple(same_rows(left, spark.sql("SELECT 1 AS n, array('a', 'null') AS v, X'FF' AS x, map('k', 1) AS m")).first()) == (1, 1, 1, 1)
    assert tuple(same_rows(left, spark.sql("SELECT 1 AS n, array('a', null) AS v, X'FE' AS x, map('k', 1) AS m")).first()) == (1, 1, 1, 1)


def test_ranges_and_records_that_differ(spark):
    rows = [(i, f"v{i}", None if i % 3 else "w") for i in range(1, 101)]
    later = [(i, a + "!" if i == 20 else a, b) for i, a, b in rows if i != 41] + [(55, "v55", "w" if 55 % 3 == 0 else None), (250, "new", ""), (None, "n", "")]
    left, right = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(later, SCHEMA).repartition(5)
    found = differing_ranges(left, right, 10)
    assert {tuple(r) for r in found.collect()} == {(11, 20, 10, 10), (41, 50, 10, 9), (51, 60, 10, 11), (241, 250, 0, 1), (None, None, 0, 1)}
    assert {tuple(r) for r in differing_records(left, right, 10).collect()} == {(20, 1, 1), (41, 1, 0), (55, 0, 1), (250, 0, 1), (None, 0, 1)}
    # Two rows of one range that change places between records differ, although the values are the same.
    swapped = [(2, *rows[0][1:]), (1, *rows[1][1:]), *rows[2:]]
    assert [tuple(r) for r in differing_ranges(left, spark.createDataFrame(swapped, SCHEMA), 10).collect()] == [(1, 10, 10, 10)]
    assert differing_ranges(left, left.repartition(4), 10).count() == 0
    plan = same_rows(left, right)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 2
