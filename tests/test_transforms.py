import pytest
from pyspark.sql import functions as F

from sedgetable.core import SRC, Field, TableError, default_fields
from sedgetable.operators import reviewed as V, transforms as T


def column(df, name):
    return [r[name] for r in df.orderBy(SRC).collect()]


def test_values_and_columns(table):
    df = table(["a", "b"], [(" x ", "1"), ("NA", "2"), ("x-y", "3")])
    assert column(T.transform(df, {"op": "trim whitespace", "column": "a"}), "a") == ["x", "NA", "x-y"]
    assert column(T.transform(df, {"op": "split column", "column": "a", "separator": "-", "part": 2, "name": "p"}), "p") == ["", "", "y"]
    assert column(T.transform(df, {"op": "merge columns", "column": "a", "other": "b", "name": "m"}), "m") == [" x  1", "NA 2", "x-y 3"]
    assert T.transform(df, {"op": "reorder column", "column": "b", "position": 1}).columns == [SRC, "b", "a"]
    with pytest.raises(TableError):
        T.transform(df, {"op": "normalize missing", "column": "a", "value": "NA"})
    assert column(T.transform(df, {"op": "normalize missing", "column": "a", "value": "NA", "confirmed": True}), "a") == [" x ", "", "x-y"]
    with pytest.raises(TableError):
        T.transform(df, {"op": "rename column", "column": "a", "value": "b"})
    renamed = T.rename_field([Field("c", source_fields=["a"], outcome_field="a")], "a", "z")[0]
    assert (renamed.source_fields, renamed.outcome_field) == (["z"], "z")


def test_strict_operations_refuse_as_a_whole(table):
    df = table(["a"], [("1",), ("x",)])
    for spec in (
        {"op": "convert units", "column": "a", "name": "n", "factor": 2},
        {"op": "parse dates", "column": "a", "name": "n", "format": "ISO"},
        {"op": "convert coordinates", "column": "a", "name": "n", "axis": "latitude"},
    ):
        with pytest.raises(TableError):
            T.transform(df, {**spec, "confirmed": True})
    with pytest.raises(TableError):
        T.declare_type(df, default_fields(df), "a", "integer")


def test_repeats_keep_the_first(table):
    df = table(["k", "v"], [("a", "1"), ("b", "2"), ("a", "3"), ("b", "2")], 4)
    assert column(T.drop_repeats(df, ["k"]), "v") == ["1", "2"]
    assert column(T.drop_repeats(df), "v") == ["1", "2", "3"]


def test_recipe_replay_checks_its_source(table):
    df = table(["a"], [(" x ",)])
    recipe = T.Recipe("s", 3, ("a",), ({"op": "trim whitespace", "column": "a"}, {"op": "uppercase", "column": "a"}))
    assert column(T.replay(df, recipe, "s", 3), "a") == ["X"]
    for sha, size in (("t", 3), ("s", 4)):
        with pytest.raises(TableError):
            T.replay(df, recipe, sha, size)


def test_sensitivity_is_inherited():
    fields = [Field("lat"), Field("note"), Field("spot", sensitive=True)]
    assert T.inherits_sensitivity(fields, ["lat"]) and T.inherits_sensitivity(fields, ["spot"])
    assert not T.inherits_sensitivity(fields, ["note"])


def outcomes(df, name):
    return [(r[name], r[f"{name}__review"]) for r in df.orderBy(SRC).collect()]


def test_reviewed_chain(table):
    df = table(["sp", "temp", "unit", "n"], [("A", "32", "F", "-999"), ("B", "0", "C", "0"), ("Z", "10", "unknown", "NA"), ("", "", "C", "")])
    book = table(["code", "meaning"], [("A", "ash"), ("A", "ash"), ("B", "birch"), ("B", "beech"), ("", "none"), ("Z", "")])
    coded = V.review_codes(df, "sp", "taxon", book, "code", "meaning")
    assert outcomes(coded, "taxon") == [("ash", "converted"), ("B", "conflicting"), ("Z", "unresolved"), ("", "empty")]
    chained = V.review_missing(coded, "taxon", "final", ["ash"], upstream="taxon__review")
    assert outcomes(chained, "final") == [("", "converted"), ("B", "conflicting"), ("Z", "unresolved"), ("", "empty")]
    assert outcomes(V.review_units(df, "temp", "c", "C", unit_column="unit"), "c") == [("0", "converted"), ("0", "unchanged"), ("10", "unresolved"), ("", "empty")]
    assert {r.outcome: r.rows for r in V.outcome_coverage(coded, "taxon").collect()} == {"converted": 1, "unchanged": 0, "unresolved": 1, "conflicting": 1, "empty": 1}
    assert V.coverage_status(coded, "taxon").first().status == "Inferred"
    with pytest.raises(TableError):
        V.review_missing(df.withColumn("odd", F.lit("?")), "n", "m", ["NA"], upstream="odd")


def test_reviewed_dates_keep_literals(table):
    df = table(["d", "t"], [("04/05/2008", "12:30"), ("31/04/2008", "09:00"), ("2008", "NA"), ("", "")])
    assert outcomes(V.review_dates(df, "d", "day", "DMY"), "day")[:2] == [("2008-05-04", "converted"), ("31/04/2008", "unresolved")]
    got = outcomes(V.review_datetimes(df, "d", "m", "DMY", "t", assumed_offset="-06:00"), "m")
    assert got == [("2008-05-04T12:30-06:00", "converted"), ("31/04/2008", "unresolved"), ("2008", "unresolved"), ("", "empty")]


def test_reviewed_taxonomy(table):
    obs = table(["name"], [("one",), ("two",), ("gone",), ("half",), (" one",), ("NA",), ("",), ("same",)])
    ref = table(["recorded", "target", "id"], [("one", "Uno", "t1"), ("one", "Uno", "t1"), ("two", "Dos", "t2"), ("two", "Dos", "t3"), ("half", "Mitad", ""), ("NA", "Native", "t4"), ("", "x", "y"), ("same", "same", "t5")])
    got = [(r.taxon, r.taxon__taxon_id, r.taxon__review) for r in V.review_taxonomy(obs, "name", "taxon", ref, "recorded", "target", "id").orderBy(SRC).collect()]
    assert got == [
        ("Uno", "t1", "converted"), ("two", "", "conflicting"), ("gone", "", "unresolved"), ("half", "", "unresolved"),
        (" one", "", "unresolved"), ("Native", "t4", "converted"), ("", "", "empty"), ("same", "t5", "converted"),
    ]
    assert V.taxonomy_candidates(ref, "recorded", "target", "id").filter("recorded = 'two'").count() == 2


def test_reviewed_coordinate_pair(table):
    rows = [("222638.981586547", "6274861.394006576"), ("0", "0"), ("NA", "12"), ("", "12"), ("", ""), ("20037509", "0"), (" 0", "0")]
    df = table(["x", "y"], rows)
    got = [(r.p_latitude, r.p_longitude, r.p__review) for r in V.review_coordinate_pair(df, "x", "y", "p", "EPSG:3857").orderBy(SRC).collect()]
    assert abs(float(got[0][0]) - 49) < 1e-12 and abs(float(got[0][1]) - 2) < 1e-12
    assert got[1] == ("0", "0", "converted")
    assert [g[2] for g in got] == ["converted", "converted", "unresolved", "unresolved", "empty", "unresolved", "unresolved"]
    assert all(g[:2] == ("", "") for g in got[2:])
    with pytest.raises(TableError):
        V.review_coordinate_pair(df, "x", "y", "p", "EPSG:32612")
