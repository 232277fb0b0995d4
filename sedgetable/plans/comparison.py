"""Key-aligned comparison, version differences and fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedgetable.operators import comparison as C, equality as E
from sedgetable.plans.inputs import DICTIONARY_ROWS, NEW_PARTS, PART_COLUMNS, PARTS, dictionary, load, with_tables
from sedgetable.scale import table_digest

KEYS = [("partkey", "partkey")]
FIELDS = [("name", "name"), ("brand", "brand"), ("size", "size")]


# A later version: some rows changed, gone, repeated or added, none of them in most ranges of a hundred.
LATER_PARTS = """
SELECT CAST(p_partkey + 1 AS BIGINT) AS __source_record, CASE WHEN p_partkey % 40 = 9 THEN '' ELSE CAST(p_partkey AS STRING) END AS partkey,
  CASE WHEN p_partkey % 700 = 5 THEN p_name || '!' ELSE p_name END AS name, p_brand AS brand, CAST(p_size AS STRING) AS size
FROM {part} WHERE p_partkey % 900 <> 3
UNION ALL
SELECT CAST(p_partkey + 1 AS BIGINT), CASE WHEN p_partkey % 40 = 9 THEN '' ELSE CAST(p_partkey AS STRING) END, p_name, p_brand, CAST(p_size AS STRING) FROM {part} WHERE p_partkey % 1100 = 8
UNION ALL
SELECT CAST(10000000000 + p_partkey AS BIGINT), CAST(p_partkey AS STRING), p_name, p_brand, CAST(p_size AS STRING) FROM {part} WHERE p_partkey % 500 = 4"""
ONE_SIDED = """SELECT *, 'l' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'r' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)"""


def _later(s, d):
    return load(s, d, LATER_PARTS)


def _old(s, d):
    return load(s, d, PARTS)


def _new(s, d):
    return load(s, d, NEW_PARTS)


def _compared(s, d):
    return C.compare_tables(_old(s, d), _new(s, d), KEYS, FIELDS)


RECORDS = """ka AS (SELECT partkey AS k, count(*) AS n, min(__source_record) AS r FROM a WHERE partkey <> '' GROUP BY partkey),
  kb AS (SELECT partkey AS k, count(*) AS n, min(__source_record) AS r FROM b WHERE partkey <> '' GROUP BY partkey),
  report AS (
  SELECT CASE WHEN x.name <> y.name OR x.brand <> y.brand OR x.size <> y.size THEN 'different' ELSE 'equal' END AS status, x.__source_record AS left_record, y.__source_record AS right_record,
    1 AS left_multiplicity, 1 AS right_multiplicity,
    '[' || concat_ws(',', CASE WHEN x.name <> y.name THEN '0' END, CASE WHEN x.brand <> y.brand THEN '1' END, CASE WHEN x.size <> y.size THEN '2' END) || ']' AS changed_fields
  FROM a x JOIN b y ON x.partkey = y.partkey JOIN ka ON ka.k = x.partkey JOIN kb ON kb.k = x.partkey WHERE ka.n = 1 AND kb.n = 1
  UNION ALL SELECT CASE WHEN kb.k IS NULL THEN 'leftOnly' ELSE 'ambiguous' END, x.__source_record, NULL, ka.n, coalesce(kb.n, 0), '[]' FROM a x JOIN ka ON ka.k = x.partkey LEFT JOIN kb ON kb.k = x.partkey WHERE kb.k IS NULL OR ka.n > 1 OR kb.n > 1
  UNION ALL SELECT CASE WHEN ka.k IS NULL THEN 'rightOnly' ELSE 'ambiguous' END, NULL, y.__source_record, coalesce(ka.n, 0), kb.n, '[]' FROM b y JOIN kb ON kb.k = y.partkey LEFT JOIN ka ON ka.k = y.partkey WHERE ka.k IS NULL OR ka.n > 1 OR kb.n > 1
  UNION ALL SELECT 'leftMissingKey', __source_record, NULL, 0, 0, '[]' FROM a WHERE partkey = '' UNION ALL SELECT 'rightMissingKey', NULL, __source_record, 0, 0, '[]' FROM b WHERE partkey = '')"""


def _report(select: str) -> str:
    return with_tables("@", a=PARTS, b=NEW_PARTS).replace(" @", f", {RECORDS} {select}")


def _digest_sql(columns: list[str]) -> str:
    row = " || ".join(f"CAST(length({c}) AS VARCHAR) || ':' || {c}" for c in columns)
    sql = f"l0 AS (SELECT __source_record AS b, sha256(CAST(__source_record AS VARCHAR) || '|' || {row}) AS h FROM a)"
    for i in range(4):
        sql += f", l{i + 1} AS (SELECT CAST(floor(b / 10000) AS BIGINT) AS b, sha256(string_agg(h, '' ORDER BY l{i}.b)) AS h FROM l{i} GROUP BY CAST(floor(b / 10000) AS BIGINT))"
    return sql


def entries():
    return {
        "c01_key_aligned_comparison": (lambda s, d: _compared(s, d).withColumn("changed_fields", F.to_json("changed_fields")), _report("SELECT * FROM report")),
        "c02_comparison_counts": (lambda s, d: C.comparison_counts(_compared(s, d)), _report("SELECT status, count(*) AS records FROM report GROUP BY status")),
        "c02_duplicate_key_groups": (
            lambda s, d: C.duplicate_key_groups(_old(s, d), _new(s, d), KEYS),
            _report("SELECT 'left' AS side, count(*) AS duplicate_key_groups FROM ka WHERE n > 1 UNION ALL SELECT 'right', count(*) FROM kb WHERE n > 1"),
        ),
        "c03_version_difference": (
            lambda s, d: C.version_difference(_old(s, d), _new(s, d)),
            with_tables(
                """SELECT (SELECT count(*) FROM (SELECT partkey, name, brand, size FROM b EXCEPT ALL SELECT partkey, name, brand, size FROM a)) AS added_rows,
                (SELECT count(*) FROM (SELECT partkey, name, brand, size FROM a EXCEPT ALL SELECT partkey, name, brand, size FROM b)) AS removed_rows, '' AS added_columns, '' AS removed_columns""",
                a=PARTS, b=NEW_PARTS,
            ),
        ),
        "c03_dictionary_changes": (
            lambda s, d: C.dictionary_changed(dictionary(s, d), dictionary(s, d).withColumn("unit", F.when(F.col("position") == 3, "C").otherwise(F.col("unit")))),
            with_tables("""SELECT "table", name, 'removed' AS change FROM dict WHERE position = 3 UNION ALL SELECT "table", name, 'added' FROM dict WHERE position = 3""", dict=DICTIONARY_ROWS),
        ),
        "c04_comparison_verification": (
            lambda s, d: C.verify_comparison(_compared(s, d).filter("status <> 'different' or left_record % 100 <> 1"), _old(s, d), _new(s, d), KEYS, FIELDS),
            _report(
                """SELECT (SELECT count(*) FROM report WHERE status <> 'different' OR left_record % 100 <> 1) AS left_rows, (SELECT count(*) FROM report) AS right_rows,
                CAST(0 AS BIGINT) AS left_only, (SELECT count(*) FROM report WHERE status = 'different' AND left_record % 100 = 1) AS right_only"""
            ),
        ),
        "c04_differing_ranges": (
            lambda s, d: E.differing_ranges(_old(s, d), _later(s, d), 100),
            with_tables(
                f"""SELECT g * 100 + 1 AS first_record, g * 100 + 100 AS last_record, (SELECT count(*) FROM a WHERE (__source_record - 1) // 100 = g) AS left_rows, (SELECT count(*) FROM b WHERE (__source_record - 1) // 100 = g) AS right_rows
                FROM (SELECT DISTINCT (__source_record - 1) // 100 AS g FROM ({ONE_SIDED}))""",
                a=PARTS, b=LATER_PARTS,
            ),
        ),
        "c04_differing_records": (
            lambda s, d: E.differing_records(_old(s, d), _later(s, d), 100),
            with_tables(f"SELECT __source_record, count(*) FILTER (side = 'l') AS left_only, count(*) FILTER (side = 'r') AS right_only FROM ({ONE_SIDED}) GROUP BY 1", a=PARTS, b=LATER_PARTS),
        ),
        "c05_table_fingerprint": (
            lambda s, d: table_digest(_old(s, d)),
            with_tables("@", a=PARTS).replace(" @", f", {_digest_sql(PART_COLUMNS)} SELECT h AS digest FROM l4"),
        ),
    }
