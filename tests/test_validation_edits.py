import pytest
from pyspark.sql import functions as F

import sedgetable.scale as scale
from sedgetable.core import SRC, Field, TableError
from sedgetable.operators import edits as H, publishing as X, validation as V


def test_value_findings(table):
    schema = {
        "fields": [
            {"name": "id", "type": "string", "constraints": {"required": True, "unique": True}},
            {"name": "n", "type": "integer", "constraints": {"minimum": 0, "enum": [1, 2, -3]}},
            {"name": "at", "type": "datetime", "format": "%Y-%m-%dT%H:%M:%S%z"},
        ]
    }
    df = table(["id", "n", "at"], [("a", "1", "2020-01-02T03:04:05Z"), ("", "x", "2020-02-30T00:00:00Z"), ("a", "-3", "2020-01-02"), ("b", "7", "2020-01-02T03:04:05+0130")])
    got = sorted((r.rule, r["column"], r[SRC]) for r in V.value_findings(df, schema).collect())
    assert got == [("minimum", "n", 3), ("required", "id", 2), ("type", "at", 2), ("type", "at", 3), ("type", "n", 2), ("vocabulary", "n", 4)]
    assert [r[SRC] for r in V.unique_findings(df, schema).collect()] == [3]


def test_start_after_end_needs_comparable_texts(table):
    df = table(["eventStart", "eventEnd"], [("2020-01-02T01:00+01:00", "2020-01-01T23:59Z"), ("2020-01-02", "2020-01-01"), ("2020-01-02T00:00Z", "2020-01-01"), ("x", "2020")])
    schema = {"fields": [{"name": "eventStart", "type": "datetime"}, {"name": "eventEnd", "type": "datetime"}]}
    assert sorted(r[SRC] for r in V.temporal_findings(df, schema).collect()) == [1, 2]


def test_star_identifiers_are_literal(table):
    core = table(["id"], [("001",), ("1",)])
    assert V.star_findings(core, "id", {"e": (table(["k"], [("001",), ("001",), ("1",)]), "k")}).count() == 0
    found = V.star_findings(core, "id", {"e": (table(["k"], [("0001",), (" ",)]), "k")})
    assert sorted((r.rule, r[SRC]) for r in found.collect()) == [("blank core link", 2), ("unmatched core link", 1)]


def test_star_export_is_refused_on_findings(table, tmp_path):
    with pytest.raises(TableError):
        X.star_export(table(["id"], [("1",), ("1",)]), "id", {}, str(tmp_path / "o"))


def test_declared_keys(table):
    child = table(["a", "b"], [("1", "x"), ("", "x"), ("1", "y"), ("NA", "q")])
    schemas = {"t": {"primaryKey": ["a", "b"], "missingValues": ["", "NA"], "foreignKeys": [{"fields": ["a", "b"], "reference": {"resource": "", "fields": ["a", "b"]}}], "fields": []}}
    got = sorted((r.rule, r[SRC]) for r in V.declared_key_findings({"t": child}, schemas).collect())
    assert got == [("primary key missing", 2), ("primary key missing", 4)]


def test_public_copies(table):
    df = table(["id", "latitude", "longitude"], [("001", "53.54123", "-113.4978"), ("002", "x", "")])
    fields = [Field("id"), Field("latitude", term="decimalLatitude", status="Confirmed"), Field("longitude")]
    rounded = [tuple(r)[1:] for r in X.public_table(df, fields, "generalize", 1).orderBy(SRC).collect()]
    assert rounded == [("001", "53.5", ""), ("002", "", "")]
    long = table(["latitude"], [("12345678.26",), ("90000000",)])
    assert [r.latitude for r in X.public_table(long, fields[1:2], "generalize", 1).orderBy(SRC).collect()] == ["12345678.3", "90000000.0"]
    assert {r.latitude for r in X.public_table(df, fields, "redact").collect()} == {""}
    with pytest.raises(TableError):
        X.public_table(df, fields, "generalize", 4)


def test_batch_trim_and_limits(table):
    df = table(["id", "note", "count"], [(" 001 ", " A ", "0"), ("002", " B ", "NA")])
    changes = H.trim_changes(df, ["id", "note", "count"])
    assert sorted((r[SRC], r["column"], r.after) for r in changes.collect()) == [(1, "id", "001"), (1, "note", "A"), (2, "note", "B")]
    summary = H.change_summary(df, changes).first()
    assert (summary.changed_cells, summary.records_scanned, summary.within_review_limit) == (3, 2, True)
    assert H.change_summary(df, changes, limit=2).first().within_review_limit is False
    assert H.changes_digest(changes).first().digest == H.changes_digest(changes.repartition(5)).first().digest
    done = H.apply_edits(df, changes)
    assert [tuple(r)[1:] for r in done.orderBy(SRC).collect()] == [("001", "A", "0"), ("002", "B", "NA")]
    back = changes.select(SRC, "column", F.col("after").alias("before"), F.col("before").alias("after"))
    assert H.apply_edits(done, back).exceptAll(df).count() == 0


def test_edits_are_all_or_nothing(spark, table):
    df = table(["a"], [("x",), ("y",)])
    make = lambda *rows: spark.createDataFrame(list(rows), f"{SRC} long, column string, before string, after string")
    for bad in (make((1, "a", "z", "q")), make((1, "a", "x", "x")), make((9, "a", "x", "q")), make((1, "b", "x", "q")), make((1, "a", "x", "q"), (1, "a", "x", "r"))):
        with pytest.raises(TableError):
            H.apply_edits(df, bad)


@pytest.fixture
def history(spark):
    rows = [(1, 1, "a", "x", "y", "edit", None), (2, 1, "a", "y", "z", "edit", None), (3, 1, "a", "z", "y", "undo", 2), (4, 2, "a", "p", "q", "edit", None), (5, 2, "a", "q", "p", "undo", 4)]
    return spark.createDataFrame(rows, f"sequence long, {SRC} long, column string, before string, after string, action string, reference long")


def test_replay(table, history, monkeypatch):
    base = table(["a"], [("x",), ("p",)])
    for chunk in (1_000_000, 2, 1):
        monkeypatch.setattr(scale, "CHUNK", chunk)
        report = H.replay_report(base, history, table(["a"], [("y",), ("p",)])).first()
        assert (report.contiguous, report.chain_breaks, report.verified) == (True, 0, True)
        assert H.chain_breaks(history.withColumn("before", F.when(F.col("sequence") == 3, "?").otherwise(F.col("before")))).count() == 1
    assert H.replay_report(base, history, base).first().verified is False
    assert [r.a for r in H.table_as_of(base, history, 2).orderBy(SRC).collect()] == ["z", "p"]
    assert {r.edit: r.state for r in H.edit_states(history).collect()} == {1: "active", 2: "discarded", 4: "redoable"}


def test_batch_groups(spark, history, monkeypatch):
    groups = spark.createDataFrame([(1, 3, 3), (3, 4, 2), (9, 9, 2)], "first_sequence long, last_sequence long, changed_cells long")
    log = history.withColumn("action", F.lit("batch-trim"))
    for chunk in (1_000_000, 2):
        monkeypatch.setattr(scale, "CHUNK", chunk)
        got = {(r.first_sequence, r.rule) for r in H.batch_group_findings(groups, log).collect()}
        assert got == {(3, "overlaps an earlier group"), (9, "not contiguous"), (9, "log rows differ")}


def test_events_are_numbered_on(table):
    df = table(["a", "b"], [(" x", "y "), ("z", " q")], 4)
    events = H.edit_events(H.trim_changes(df, ["a", "b"]), 7, "batch-trim", "why", "me")
    assert [(r.sequence, r[SRC], r["column"]) for r in events.orderBy("sequence").collect()] == [(8, 1, "a"), (9, 1, "b"), (10, 2, "b")]
    with pytest.raises(TableError):
        H.edit_events(df, 0, "edit", " ", "me")


def test_undo_and_redo_steps(spark):
    import pytest
    from sedgetable.core import TableError
    from sedgetable.operators.edits import step_events

    schema = "sequence long, __source_record long, `column` string, before string, after string, action string, reference long, rationale string, reviewer string"
    log = spark.createDataFrame([(1, 1, "a", "x", "y", "edit", None, "r", "w"), (2, 2, "a", "p", "q", "batch-trim", None, "r", "w"), (3, 3, "a", "p", "q", "batch-trim", None, "r", "w")], schema)
    groups = spark.createDataFrame([(2, 3)], "first_sequence long, last_sequence long")
    steps = []
    for action in ("undo", "undo", "redo", "redo"):
        new = step_events(log, action, "r", "w", groups)
        steps.append(sorted((r["sequence"], r["before"], r["after"], r["action"], r["reference"]) for r in new.collect()))
        log = spark.createDataFrame(log.unionByName(new).collect(), schema)
    assert steps == [
        [(4, "q", "p", "batch-undo", 2), (5, "q", "p", "batch-undo", 3)],
        [(6, "y", "x", "undo", 1)],
        [(7, "x", "y", "redo", 1)],
        [(8, "p", "q", "batch-redo", 2), (9, "p", "q", "batch-redo", 3)],
    ]
    with pytest.raises(TableError, match="nothing"):
        step_events(log, "redo", "r", "w", groups)


def test_layout_joins_headers_as_whole_rows(spark):
    headers = spark.createDataFrame([("f", "t", 0, "b"), ("f", "t", 1, "a"), ("f", "t", 2, "a"), ("g", "u", 0, "a")], "resource string, table string, position int, name string")
    declared = spark.createDataFrame([("t", 0, "a"), ("t", 1, "b"), ("t", 2, "c"), ("v", 0, "a")], "table string, position int, name string")
    out = V.layout_findings(headers, declared)
    assert sorted(tuple(r) for r in out.collect()) == sorted([("field order", "f", "t", "a")] * 2 + [("field order", "f", "t", "b"), ("absent field", "f", "t", "c"), ("absent table", "", "v", "")])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.lstrip(" :+-!").startswith("Join") for line in plan.splitlines()) == 2
