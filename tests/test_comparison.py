import pytest

from sedgetable.core import TableError
from sedgetable.operators import comparison as C
from sedgetable.scale import table_digest

HEADER = ["key", "part", "value"]
SPEC = dict(keys=[("key", "key")], fields=[("value", "value")])


def counts(left, right, **spec):
    return {r[0]: r[1] for r in C.comparison_counts(C.compare_tables(left, right, **spec)).collect()}


def test_literal_comparison(table):
    a = table(HEADER, [("001", "x", ""), ("0", "x", "0"), ("NA", "x", "NA"), (" ", "x", "spaced"), ("1", "x", "value"), ("", "x", "blank")])
    b = table(HEADER, [("0", "x", "0"), ("001", "x", ""), ("NA", "x", "na"), (" ", "x", "spaced"), ("01", "x", "value"), ("", "x", "blank")])
    assert counts(a, b, **SPEC) == {"equal": 3, "different": 1, "leftOnly": 1, "rightOnly": 1, "leftMissingKey": 1, "rightMissingKey": 1}
    changed = C.compare_tables(a, b, **SPEC).filter("status = 'different'").first()
    assert (changed.left_record, changed.right_record, changed.changed_fields) == (3, 3, [0])


def test_repeated_keys_stay_ambiguous(table):
    a = table(HEADER, [("A", "", "one"), ("A", "", "two"), ("B", "", "three"), ("D", "", "four")])
    b = table(HEADER, [("A", "", "one"), ("B", "", "three"), ("B", "", "other"), ("C", "", "five")])
    assert counts(a, b, **SPEC) == {"ambiguous": 6, "leftOnly": 1, "rightOnly": 1}
    assert {r.side: r.duplicate_key_groups for r in C.duplicate_key_groups(a, b, SPEC["keys"]).collect()} == {"left": 1, "right": 1}


def test_composite_keys_do_not_collide(table):
    a = table(HEADER, [("a|b", "c", "one"), ("a", "b|c", "two")])
    b = table(HEADER, [("a", "b|c", "two"), ("a|b", "c", "one")])
    assert counts(a, b, keys=[("key", "key"), ("part", "part")], fields=[("value", "value")]) == {"equal": 2}


def test_selection_is_checked(table):
    a = table(HEADER, [("1", "", "0")])
    for spec in (dict(SPEC, keys=[]), dict(SPEC, fields=[]), dict(SPEC, fields=[("x", "x")]), dict(SPEC, fields=[("value", "value")] * 2)):
        with pytest.raises(TableError):
            C.compare_tables(a, a, **spec)


def test_verification_sees_tampering(table):
    a, b = table(HEADER, [("1", "", "0"), ("2", "", "1")]), table(HEADER, [("1", "", "0"), ("2", "", "9")])
    report = C.compare_tables(a, b, **SPEC)
    assert C.verify_comparison(report, a, b, **SPEC).first().left_only == 0
    assert C.verify_comparison(report.filter("status = 'equal'"), a, b, **SPEC).first().right_only == 1


def test_version_difference(table):
    old, new = table(["x"], [("a",), ("b",), ("b",)]), table(["x"], [("b",), ("c",), ("c",), ("a",)])
    assert tuple(C.version_difference(old, new).first()) == (2, 1, "", "")


def test_digest_ignores_partitions_and_sees_changes(table):
    rows = [(str(i), f"v{i % 7}") for i in range(500)]
    digest = lambda df: table_digest(df).first().digest
    first = digest(table(["a", "b"], rows, 1))
    assert first == digest(table(["a", "b"], rows, 7))
    assert first != digest(table(["a", "b"], rows[:-1] + [("x", "y")], 3))
    assert digest(table(["a", "b"], [("1", "23")])) != digest(table(["a", "b"], [("12", "3")]))
    with pytest.raises(TableError):
        C.guard_fingerprint(table(["a", "b"], rows), "0" * 64)
