import re

import pytest

from sedgetable.core import SRC, TableError
from sedgetable.operators import relationships as R

PARENT = [("001", "2020", "one"), ("001", "2021", "two"), ("A", "2020", "first"), ("A", "2020", "second"), ("0", "2020", "zero"), ("NA", "2020", "literal"), ("", "2020", "none")]
CHILD = [("001", "2020", "0"), ("001", "2021", "1"), ("A", "2020", "2"), (" 001 ", "2020", "3"), ("0", "2020", "0"), ("NA", "2020", "4"), ("", "2020", "5"), ("009", "2020", "6")]


@pytest.fixture
def pair(table):
    return table(["site", "period", "count"], CHILD), table(["site", "period", "note"], PARENT)


def test_key_index_counts(pair):
    row = R.key_index_counts(pair[1], ["site", "period"]).first()
    assert tuple(row) == (7, 1, 1, 2)


def test_link_counts_and_examples(pair):
    status = R.link_status(*pair, ["site", "period"], ["site", "period"])
    expected = {"linked": 4, "missing": 1, "unmatched": 2, "conflicting": 1}
    assert {r[0]: r[1] for r in R.link_counts(status).collect()} == expected
    assert {r[0]: r[1] for r in R.link_counts_by_key(*pair, ["site", "period"], ["site", "period"]).collect()} == expected
    shown = R.link_examples(status).filter("__link_status = 'unmatched' and rank = 1").first()
    assert (shown[SRC], shown["k0"], shown["preview_truncated"]) == (4, " 001 ", False)


def test_join_keeps_every_child(pair):
    joined = R.literal_left_join(*pair, ["site", "period"], ["site", "period"])
    rows = [tuple(r) for r in joined.orderBy("__child_source_record").collect()]
    assert len(rows) == 8
    assert rows[0] == (1, 1, "linked", "001", "2020", "0", "001", "2020", "one")
    assert rows[2][1:3] == (None, "conflicting") and rows[2][-3:] == ("", "", "")
    assert [r[2] for r in rows] == ["linked", "linked", "conflicting", "unmatched", "linked", "linked", "missing", "unmatched"]
    check = R.verify_join(joined, *pair, ["site", "period"], ["site", "period"]).first()
    assert (check.left_rows, check.right_rows, check.left_only, check.right_only) == (8, 8, 0, 0)


def test_key_declarations_are_checked(pair):
    for child_keys, parent_keys in ((["site"], ["site", "period"]), (["site", "site"], ["site", "period"]), ([], []), (["x"], ["site"])):
        with pytest.raises(TableError):
            R.link_status(*pair, child_keys, parent_keys)


def test_heavy_key_is_spread_without_losing_rows(table):
    child = table(["k"], [("hot",)] * 300 + [(str(i),) for i in range(100)])
    parent = table(["k", "note"], [("hot", "h")] + [(str(i), "n") for i in range(0, 100, 2)])
    joined = R.literal_left_join(child, parent, ["k"], ["k"])
    assert joined.count() == 400
    assert joined.filter("__link_status = 'linked'").count() == 350
    assert joined.filter("__link_status = 'unmatched'").count() == 50


def test_composite_orphans(table):
    child = table(["x", "y"], [("1", "A"), ("1", "B"), ("", ""), ("", "A")])
    parent = table(["x", "y"], [("1", "A")])
    assert sorted(r[SRC] for r in R.composite_orphans(child, parent, ["x", "y"], ["x", "y"]).collect()) == [2, 4]


def test_primary_and_foreign_keys(table):
    child = table(["k"], [("1",), ("1",), ("",), ("9",)])
    parent = table(["k"], [("1",), ("2",), ("2",)])
    assert sorted((r.rule, r[SRC]) for r in R.primary_key_findings(child, ["k"]).collect()) == [("duplicate primary keys", 2), ("missing primary keys", 3)]
    found = {(r.rule, r[SRC]) for r in R.foreign_key_findings(child, parent, "k", "k").collect()}
    assert found == {("missing referenced records", 4), ("unreferenced parent records", 2), ("unreferenced parent records", 3), ("relationship target is not unique", None)}


def test_suggestions(table):
    tables = {"events": table(["event_id", "site"], [("e1", "a"), ("e2", "b")]), "obs": table(["event_id", "n"], [("e1", "1"), ("e1", "2"), ("zz", "3")])}
    best = R.relationship_candidates(tables).collect()
    assert [(r.child, r.parent, r.matched, r.total) for r in best] == [("obs", "events", 2, 3)]
    assert R.relationship_suggestions(tables).count() == 2


def test_inclusions_of_all_pairs_at_once(table):
    tables = {
        "a": table(["id", "key"], [("1", "x"), ("2", "x"), ("", "y"), ("4", " ")]),
        "b": table(["ID", "k"], [("1", "x"), ("2", "z"), ("3", "y")]),
        "c": table(["id", "Key"], [("1", "x"), ("1", "q")]),
    }
    pairs = list(R._same_named(tables))
    found = R.inclusions(tables, pairs)
    got = {(r.child, r.child_column, r.parent): tuple(r)[4:] for r in found.collect()}
    for child, column, parent, target in pairs:
        mine = [r[column] for r in tables[child].collect() if r[column] != ""]
        every = [r[target] for r in tables[parent].collect()]
        theirs = [v for v in every if v != ""]
        matched = sum(v in theirs for v in mine)
        unique = len(set(theirs)) == len(theirs)
        identifies = len(set(every)) == len(every) and all(v.strip() for v in every)
        assert got[child, column, parent] == (len(mine), matched, len(mine) - matched, unique, identifies)
    empty = {n: df.limit(0) for n, df in tables.items()}
    assert R.relationship_candidates(empty).count() == 0 and R.relationship_suggestions(empty).count() == 0


def test_codebooks_and_mentions(spark, table):
    obs = table(["code", "n"], [("A", "1"), ("B", "2"), ("", "A")])
    books = spark.createDataFrame([("x", "A", "ash"), ("x", "A", "alder"), ("x", "B", "birch"), ("y", "B", "beech")], "codebook string, code string, meaning string")
    found = {(r.column, r.codebook): (r.matched_codes, r.conflicting_codes, r.cross_conflicts) for r in R.codebook_matches(obs, books).collect()}
    assert found == {("code", "x"): (2, 1, 2), ("code", "y"): (1, 0, 1), ("n", "x"): (1, 1, 1)}
    texts = spark.createDataFrame([(1, "n is a count\r\nno mention\nsee [n]"), (2, "nn")], "doc long, text string")
    assert [(r.doc, r.line_number) for r in R.evidence_mentions(texts, ["n"]).orderBy("rank").collect()] == [(1, 1), (1, 3)]


def test_all_mentions_equal_a_pattern_per_name(spark):
    names = ["n", "N2", "water temp", "温度", "a.b", "x_1", "absent", "Kab", "ab"]
    lines = ["N2 and n", "the WATER Temp, waterxtemp", "温度: 3", "a.b axb", "x_1 x_12", "\u212aab", "", "n n n"]
    texts = spark.createDataFrame([(1, "\n".join(lines)), (2, "n\r\nab"), (3, None)], "doc long, text string")
    want = set()
    for doc, text in ((1, "\n".join(lines)), (2, "n\nab")):
        for at, line in enumerate(text.split("\n"), 1):
            for name in names:
                if re.search(f"(?i)(?a:(^|[^a-zA-Z0-9_]){re.escape(name)}($|[^a-zA-Z0-9_]))", line, re.ASCII):
                    want.add((name, doc, at, line))
    got = [tuple(r) for r in R.mentions(texts, [*names, "n"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    totals = {r["field"]: (r["lines"], r["docs"]) for r in R.mention_totals(texts, names).collect()}
    assert totals["n"] == (3, 2) and totals["absent"] == (0, 0) and totals["温度"] == (1, 1) and totals["ab"] == (2, 2)


def test_mentions_shuffle_no_line_with_its_words(spark):
    texts = spark.createDataFrame([(1, "n is a count"), (2, "a.b and n")], "doc long, text string").repartition(2)
    plan = R.mentions(texts, ["n", "a.b"])._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
