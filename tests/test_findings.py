import random

from sedgetable.core import SRC, Field, default_fields
from sedgetable.operators import findings as N, profiles as P
from sedgetable.plans.inputs import load  # noqa: F401  (the planted inputs import cleanly)


def hits(df, rule, fields=None):
    return sorted((r["column"], r[SRC]) for r in N.cell_findings(df, fields, [rule]).collect())


def test_small_rules(table):
    df = table(["id", "latitude", "count"], [("001", " 53 ", "0"), ("002", "153", "NA"), ("002", "153", "NA")])
    assert hits(df, "latitude range") == [("latitude", 2), ("latitude", 3)]
    assert hits(df, "outer whitespace") == [("latitude", 1)]
    assert hits(df, "missing tokens") == [("count", 2), ("count", 3)]
    assert hits(df, "count not whole") == [("count", 2), ("count", 3)]
    assert [r[SRC] for r in N.duplicate_rows(df).collect()] == [3]
    assert [r["column"] for r in N.leading_zeros(df).collect()] == ["id"]


def test_formula_encoding_and_dates(table):
    df = table(["note", "event_date"], [("=1", "2008"), ("-5", "2008-02-30"), ("-5.x", "43831"), ("Ã©", "7/2008"), ("ok", "04/05/08"), ("-", " 2008 ")])
    assert hits(df, "formula-like text") == [("note", 1), ("note", 3), ("note", 6)]
    assert hits(df, "encoding damage") == [("note", 4)]
    assert hits(df, "partial dates") == [("event_date", 1), ("event_date", 4)]
    assert hits(df, "serial dates") == [("event_date", 3)]
    assert hits(df, "impossible dates") == [("event_date", 2)]
    assert hits(df, "ambiguous numeric dates") == [("event_date", 5)]
    assert hits(df, "screened day or month first") == [("event_date", 5)]


def test_types_vocabulary_and_identifiers(spark, table):
    df = table(["site_id", "n"], [("a", "1"), ("a", "x"), ("", "9007199254740993"), ("b", "")])
    fields = [Field("site_id"), Field("n", data_type="integer")]
    assert sorted(r[SRC] for r in N.declared_type_mismatch(df, fields).collect()) == [2, 3]
    allowed = spark.createDataFrame([("site_id", "a")], "column string, value string")
    assert [r[SRC] for r in N.outside_vocabulary(df, allowed, ["site_id"]).collect()] == [4]
    assert sorted((r["rule"], r[SRC]) for r in N.repeated_identifiers(df).collect()) == [("identifier blank", 3), ("identifier repeat", 2)]


def test_coordinates_against_brute_force(table):
    rng = random.Random(5)
    points = [(f"{rng.uniform(-90, 90):.5f}", f"{rng.uniform(-180, 180):.7f}") for _ in range(401)] + [("0", "0x0"), ("120", "10"), ("x", "1"), ("", "2")]
    df = table(["lat", "lon"], points, 5)
    valid = [(i, float(a), 0.0 if b == "0x0" else float(b)) for i, (a, b) in enumerate(points, 1) if a not in ("x", "") and abs(float(a)) <= 90]
    a, b = sorted(v[1] for v in valid)[len(valid) // 2], sorted(v[2] for v in valid)[len(valid) // 2]
    expected = sorted(i for i, x, y in valid if abs(x - a) > 10 or abs(y - b) > 10)
    assert sorted(r[SRC] for r in N.geographic_outliers(df, "lat", "lon").collect()) == expected
    assert [r[SRC] for r in N.zero_coordinates(df, "lat", "lon").collect()] == [402]
    assert [r[SRC] for r in N.swapped_coordinates(df, "lat", "lon").collect()] == [403]
    assert N.coordinate_columns(default_fields(df)) == ("lat", "lon")
    assert N.geographic_outliers(df.limit(0), "lat", "lon").count() == 0


def test_upper_median_takes_the_upper_middle(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "v double")
    assert N.upper_medians(df, ["v"]) == {"v": 3.0}


def test_queue_ignores_closed_items(spark):
    items = spark.createDataFrame([("b", "unit"), ("a", "unit"), ("c", "meaning"), ("d", "odd")], "id string, kind string")
    decisions = spark.createDataFrame([("c", "Accepted", 1), ("c", "Needs review", 2), ("a", "Needs review", 1), ("a", "Rejected", 3)], "key string, state string, at int")
    assert [r.id for r in N.review_queue(items, decisions).orderBy("priority", "id").collect()] == ["c", "b", "d"]


def test_profile(table):
    df = table(["v"], [("1",), ("1.5",), ("",), (" ",), ("x",), ("1",), ("2020-01-01",)])
    freq = P.value_frequencies(df)
    row = P.column_profile(freq).first()
    assert (row.rows, row.missing, row.unique, row.type, row.whitespace) == (7, 2, 4, "number", 1)
    assert (row.integer_count, row.number_count, row.text_count, row.date_like_count) == (0, 3, 1, 1)
    assert (row.numeric_min, row.numeric_max, row.candidate_identifier) == (1.0, 1.5, False)
    assert [r.value for r in P.examples(freq).orderBy("rank").collect()] == ["1", "1.5", "x"]
    assert [(r.value, r.n) for r in P.common_values(freq).orderBy("rank").limit(2).collect()] == [("1", 2), ("1.5", 1)]
    assert [r["column"] for r in N.mixed_types(P.column_profile(freq)).collect()] == ["v"]


def test_import_profile_and_samples(table):
    df = table(["v"], [("1_0",), (" 2 ",), ("nan",), ("",), ("é" * 300,)])
    row = P.import_profile(df).first()
    assert (row.rows, row.empty, row.whitespace, row.min_length, row.max_length, row.numeric_count, row.numeric_min, row.numeric_max) == (5, 1, 1, 0, 300, 2, 2.0, 10.0)
    assert [len(r.sample) for r in P.first_samples(df).orderBy("rank").collect()] == [3, 3, 3, 200]


def test_approximate_distinct_is_close(table):
    df = table(["v"], [(str(i % 900),) for i in range(3000)])
    assert abs(P.approximate_distinct(df).first().approximate_unique - 900) < 90


def test_key_statistics(table):
    df = table(["a", "b"], [("1", "x"), ("1", "x"), ("1", ""), ("", "")])
    assert tuple(P.key_statistics(df, ["a", "b"]).first()) == (4, 2, 1, 3)
