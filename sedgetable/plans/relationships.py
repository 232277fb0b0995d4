"""Keys, links and relationships."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedgetable.operators import relationships as R
from sedgetable.plans.inputs import CUSTOMER, CUSTOMER_COLUMNS, LINES, ORDERS, ORDERS_COLUMNS, cells, dictionary, lines, load, with_tables, DICTIONARY_ROWS

KEY = ["orderkey"]
_STATUS = """status AS (SELECT o.__source_record, CASE WHEN o.orderkey = '' THEN 'missing' WHEN i.n IS NULL THEN 'unmatched' WHEN i.n > 1 THEN 'conflicting' ELSE 'linked' END AS __link_status, o.orderkey
  FROM o LEFT JOIN (SELECT orderkey, count(*) AS n FROM l WHERE orderkey <> '' GROUP BY orderkey) i ON o.orderkey = i.orderkey)"""


def _orders(s, d):
    return load(s, d, ORDERS)


def _customers(s, d):
    return load(s, d, CUSTOMER)


def _named(s, d):
    """Three tables that share column names."""
    customers = _customers(s, d).select("__source_record", "custkey", "nationkey")
    orders = _orders(s, d).select("__source_record", "custkey", "orderkey")
    order_lines = lines(s, d).select("__source_record", "orderkey", "partkey")
    return {"customers": customers, "orders": orders, "lines": order_lines}


def _mentions(s, d):
    texts = load(s, d, "SELECT doc_id AS doc, text FROM {documents}")
    return R.evidence_mentions(texts, ["data", "count", "license"])


FIELD_NAMES = ["data", "count", "license", "text", "source", "name", "part", "year", "data, set", "no such field"]
MENTION_TOTALS = f"""WITH names AS (SELECT unnest({FIELD_NAMES}) AS field),
  split AS (SELECT doc_id AS doc, string_split_regex(text, '\r?\n') AS parts FROM documents),
  numbered AS (SELECT doc, unnest(parts) AS line FROM split),
  hits AS (SELECT field, doc FROM names JOIN numbered ON contains(lower(line), lower(field)) AND regexp_matches(line, '(^|[^a-zA-Z0-9_])' || regexp_escape(field) || '($|[^a-zA-Z0-9_])', 'i'))
  SELECT field, count(hits.field) AS lines, count(DISTINCT doc) AS docs FROM names LEFT JOIN hits USING (field) GROUP BY field"""


def _mention_totals(s, d):
    texts = load(s, d, "SELECT doc_id AS doc, text FROM {documents}")
    return R.mention_totals(texts, FIELD_NAMES)


def _mention_sql():
    parts = []
    for name in ("data", "count", "license"):
        parts.append(f"""SELECT '{name}' AS field, doc, line_number, line FROM numbered WHERE regexp_matches(line, '(^|[^a-zA-Z0-9_]){name}($|[^a-zA-Z0-9_])', 'i')""")
    return f"""WITH split AS (SELECT doc_id AS doc, string_split_regex(text, '\r?\n') AS parts FROM documents),
      numbered AS (SELECT doc, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_number FROM split),
      hits AS ({' UNION ALL '.join(parts)}),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY doc, line_number) AS rank FROM hits)
      SELECT field, rank, doc, line_number, substring(line, 1, 400) AS excerpt FROM ranked WHERE rank <= 20"""


def _codebooks(s, d):
    books = load(
        s, d,
        """SELECT 'nations' AS codebook, CAST(n_nationkey AS STRING) AS code, n_name AS meaning FROM {nation}
        UNION ALL SELECT 'nations', CAST(n_nationkey AS STRING), 'twice' FROM {nation} WHERE n_nationkey % 5 = 0
        UNION ALL SELECT 'customers', CAST(c_custkey AS STRING), c_name FROM {customer}""",
    )
    return R.codebook_matches(_customers(s, d).select("__source_record", "custkey", "nationkey"), books)


def _derived_dictionary(s, d):
    both = dictionary(s, d)
    return R.join_dictionary(both.filter("`table` = 'table 1'"), both.filter("`table` <> 'table 1'"))


def entries():
    o_l = dict(o=ORDERS, l=LINES)
    o_c = dict(o=ORDERS, c=CUSTOMER)
    link = ("""CASE WHEN o.custkey = '' THEN 'missing' WHEN c.custkey IS NULL THEN 'unmatched' ELSE 'linked' END""")
    joined_cells = ", ".join([f'o.{c} AS "child:{c}"' for c in ORDERS_COLUMNS] + [f"""CASE WHEN c.custkey IS NOT NULL THEN c.{c} ELSE '' END AS "parent:{c}" """ for c in CUSTOMER_COLUMNS])
    overlap = lambda ct, cc, pt, pc: f"""SELECT '{ct}' AS child, '{cc}' AS child_column, '{pt}' AS parent, '{pc}' AS parent_column,
        count(*) AS total, count(p.v) AS matched, count(*) - count(p.v) AS orphans,
        (SELECT coalesce(max(n), 0) <= 1 FROM (SELECT count(*) AS n FROM {pt} WHERE {pc} <> '' GROUP BY {pc})) AS parent_unique
        FROM {ct} ch LEFT JOIN (SELECT DISTINCT {pc} AS v FROM {pt} WHERE {pc} <> '') p ON ch.{cc} = p.v WHERE ch.{cc} <> ''"""
    pairs = [("customers", "custkey", "orders", "custkey"), ("orders", "custkey", "customers", "custkey"), ("orders", "orderkey", "lines", "orderkey"), ("lines", "orderkey", "orders", "orderkey")]
    named = dict(customers=CUSTOMER, orders_=ORDERS, lines_=LINES)
    union_pairs = " UNION ALL ".join(overlap(*p) for p in pairs)
    for short, real in (("orders", "orders_"), ("lines", "lines_")):
        union_pairs = union_pairs.replace(f"FROM {short} ", f"FROM {real} ")
    return {
        "r01_parent_key_index": (
            lambda s, d: R.key_index(lines(s, d), KEY).select("orderkey", "occurrences"),
            with_tables("SELECT orderkey, count(*) AS occurrences FROM l WHERE orderkey <> '' GROUP BY orderkey", l=LINES),
        ),
        "r01_parent_key_counts": (
            lambda s, d: R.key_index_counts(_orders(s, d), ["custkey"]),
            with_tables(
                """SELECT CAST(sum(n) AS BIGINT) AS parent_records, CAST(coalesce(sum(CASE WHEN custkey = '' THEN n END), 0) AS BIGINT) AS missing_parent_keys,
                count(CASE WHEN custkey <> '' AND n > 1 THEN 1 END) AS duplicate_parent_keys, CAST(coalesce(sum(CASE WHEN custkey <> '' AND n > 1 THEN n END), 0) AS BIGINT) AS duplicate_parent_records
                FROM (SELECT custkey, count(*) AS n FROM o GROUP BY custkey)""",
                o=ORDERS,
            ),
        ),
        "r02_link_status": (
            lambda s, d: R.link_status(_orders(s, d), lines(s, d), KEY, KEY).select("__source_record", "__link_status"),
            with_tables("SELECT __source_record, __link_status FROM status", **o_l).replace(" SELECT __source_record, __link_status FROM status", ", " + _STATUS + " SELECT __source_record, __link_status FROM status"),
        ),
        "r02_link_counts": (
            lambda s, d: R.link_counts_by_key(_orders(s, d), lines(s, d), KEY, KEY),
            with_tables("@", **o_l).replace(" @", ", " + _STATUS + " SELECT __link_status, count(*) AS records FROM status GROUP BY __link_status"),
        ),
        "r02_link_examples": (
            lambda s, d: R.link_examples(R.link_status(_orders(s, d), lines(s, d), KEY, KEY)).drop("__parent_source_record"),
            with_tables("@", **o_l).replace(
                " @",
                ", " + _STATUS + """ SELECT __link_status, rank, __source_record, substring(orderkey, 1, 500) AS k0, length(orderkey) > 500 AS preview_truncated
                FROM (SELECT *, row_number() OVER (PARTITION BY __link_status ORDER BY __source_record) AS rank FROM status) WHERE rank <= 10""",
            ),
        ),
        "r03_literal_left_join": (
            lambda s, d: R.literal_left_join(_orders(s, d), _customers(s, d), ["custkey"], ["custkey"]),
            with_tables(
                f"""SELECT o.__source_record AS __child_source_record, c.__source_record AS __parent_source_record, {link} AS __link_status, {joined_cells}
                FROM o LEFT JOIN c ON o.custkey = c.custkey AND o.custkey <> ''""",
                **o_c,
            ),
        ),
        "r03_literal_left_join_repeated_parents": (
            lambda s, d: R.literal_left_join(_orders(s, d).select("__source_record", "orderkey"), lines(s, d), KEY, KEY).drop("__parent_source_record"),
            with_tables(
                """SELECT o.__source_record AS __child_source_record, CASE WHEN o.orderkey = '' THEN 'missing' WHEN i.n IS NULL THEN 'unmatched' WHEN i.n > 1 THEN 'conflicting' ELSE 'linked' END AS __link_status,
                o.orderkey AS "child:orderkey" """
                + "".join(f""", CASE WHEN i.n = 1 THEN i.{c} ELSE '' END AS "parent:{c}" """ for c in ("orderkey", "linenumber", "partkey", "returnflag", "linestatus"))
                + """ FROM o LEFT JOIN (SELECT orderkey, count(*) AS n, min(linenumber) AS linenumber, min(partkey) AS partkey, min(returnflag) AS returnflag, min(linestatus) AS linestatus
                FROM l WHERE orderkey <> '' GROUP BY orderkey) i ON o.orderkey = i.orderkey""",
                **o_l,
            ),
        ),
        "r04_join_dictionary": (
            _derived_dictionary,
            with_tables(
                """SELECT '__child_source_record' AS name, 'technical' AS role, 'integer' AS data_type, 'Confirmed' AS status, '' AS unit, 'number of the left record' AS description
                UNION ALL SELECT '__parent_source_record', 'technical', 'integer', 'Confirmed', '', 'number of the only right record with the same key; null if there is none or more than one'
                UNION ALL SELECT '__link_status', 'technical', 'string', 'Confirmed', '', 'result of comparing keys: missing, unmatched, conflicting or linked'
                UNION ALL SELECT CASE WHEN "table" = 'table 1' THEN 'child:' ELSE 'parent:' END || name, CASE WHEN "table" = 'table 1' THEN 'child' ELSE 'parent' END, data_type, status, unit, description FROM dict""",
                dict=DICTIONARY_ROWS,
            ),
        ),
        "r05_join_verification": (
            lambda s, d: R.verify_join(
                R.literal_left_join(_orders(s, d), _customers(s, d), ["custkey"], ["custkey"]).withColumn(
                    "__link_status", F.when(F.col("__child_source_record") % 100 == 0, "linked").otherwise(F.col("__link_status"))
                ),
                _orders(s, d), _customers(s, d), ["custkey"], ["custkey"],
            ),
            with_tables(
                """SELECT count(*) AS left_rows, count(*) AS right_rows, count(CASE WHEN __source_record % 100 = 0 AND custkey = '' THEN 1 END) AS left_only,
                count(CASE WHEN __source_record % 100 = 0 AND custkey = '' THEN 1 END) AS right_only FROM o""",
                o=ORDERS,
            ),
        ),
        "r06_relationship_candidates": (
            lambda s, d: R.relationship_candidates(_named(s, d)),
            with_tables(
                f"""SELECT * FROM ({union_pairs}) WHERE total > 0 AND matched >= 0.5 * total AND parent = 'customers'""",
                **named,
            ),
        ),
        "r07_primary_key_findings": (
            lambda s, d: R.primary_key_findings(_orders(s, d), ["custkey", "status"]),
            with_tables(
                """SELECT 'duplicate primary keys' AS rule, 'Error' AS severity, __source_record FROM (SELECT *, row_number() OVER (PARTITION BY custkey, status ORDER BY __source_record) AS rn FROM o) WHERE rn > 1
                UNION ALL SELECT 'missing primary keys', 'Error', __source_record FROM o WHERE custkey = '' OR status = ''""",
                o=ORDERS,
            ),
        ),
        "r08_foreign_key_findings": (
            lambda s, d: R.foreign_key_findings(_customers(s, d), _orders(s, d), "custkey", "custkey"),
            with_tables(
                """SELECT 'missing referenced records' AS rule, 'Error' AS severity, __source_record FROM c WHERE custkey <> '' AND custkey NOT IN (SELECT custkey FROM o)
                UNION ALL SELECT 'unreferenced parent records', 'Information', __source_record FROM o WHERE custkey NOT IN (SELECT custkey FROM c WHERE custkey <> '')
                UNION ALL SELECT 'relationship target is not unique', 'Error', CAST(NULL AS BIGINT) WHERE (SELECT count(*) - count(DISTINCT custkey) FROM o) > 0""",
                **o_c,
            ),
        ),
        "r09_composite_orphans": (
            lambda s, d: R.composite_orphans(_orders(s, d), _orders(s, d).filter("__source_record % 3 = 0"), ["custkey", "priority"], ["custkey", "priority"]),
            with_tables(
                """SELECT 'composite reference missing' AS rule, 'Error' AS severity, a.__source_record FROM o a WHERE NOT (a.custkey = '' AND a.priority = '')
                AND NOT EXISTS (SELECT 1 FROM o b WHERE b.__source_record % 3 = 0 AND b.custkey = a.custkey AND b.priority = a.priority)""",
                o=ORDERS,
            ),
        ),
        "r10_key_set_comparison": (
            lambda s, d: R.compare_key_sets(_orders(s, d), lines(s, d), "orderkey", "orderkey"),
            with_tables(
                """SELECT coalesce(a.k, b.k) AS value, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'shared' WHEN b.k IS NULL THEN 'left only' ELSE 'right only' END AS side
                FROM (SELECT DISTINCT orderkey AS k FROM o WHERE orderkey <> '') a FULL OUTER JOIN (SELECT DISTINCT orderkey AS k FROM l WHERE orderkey <> '') b ON a.k = b.k""",
                **o_l,
            ),
        ),
        "r10_key_set_summary": (
            lambda s, d: R.key_set_summary(_orders(s, d), lines(s, d), "orderkey", "orderkey"),
            with_tables(
                """SELECT side, count(*) AS n FROM (SELECT CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'shared' WHEN b.k IS NULL THEN 'left only' ELSE 'right only' END AS side
                FROM (SELECT DISTINCT orderkey AS k FROM o WHERE orderkey <> '') a FULL OUTER JOIN (SELECT DISTINCT orderkey AS k FROM l WHERE orderkey <> '') b ON a.k = b.k) GROUP BY side
                UNION ALL SELECT 'left empty rows', count(*) FROM o WHERE orderkey = '' UNION ALL SELECT 'right empty rows', count(*) FROM l WHERE orderkey = ''""",
                **o_l,
            ),
        ),
        "r11_relationship_suggestions": (
            lambda s, d: R.relationship_suggestions(_named(s, d)),
            with_tables(f"SELECT * FROM ({union_pairs}) WHERE matched > 0", **named),
        ),
        "r12_codebook_token_match": (
            _codebooks,
            with_tables(
                f"""SELECT t."column", b.codebook, count(*) AS matched_codes, count(CASE WHEN b.m > 1 THEN 1 END) AS conflicting_codes, count(CASE WHEN x.m > 1 THEN 1 END) AS cross_conflicts
                FROM (SELECT DISTINCT "column", value FROM ({cells('c', ['custkey', 'nationkey'])}) WHERE value <> '') t
                JOIN (SELECT codebook, code, count(DISTINCT meaning) AS m FROM books GROUP BY codebook, code) b ON b.code = t.value
                JOIN (SELECT code, count(DISTINCT meaning) AS m FROM books GROUP BY code) x ON x.code = t.value GROUP BY t."column", b.codebook""",
                c=CUSTOMER,
                books="""SELECT 'nations' AS codebook, CAST(n_nationkey AS STRING) AS code, n_name AS meaning FROM {nation}
                UNION ALL SELECT 'nations', CAST(n_nationkey AS STRING), 'twice' FROM {nation} WHERE n_nationkey % 5 = 0
                UNION ALL SELECT 'customers', CAST(c_custkey AS STRING), c_name FROM {customer}""",
            ),
        ),
        "r13_evidence_mentions": (_mentions, _mention_sql()),
        "r13_mention_totals": (_mention_totals, MENTION_TOTALS),
    }


def flagship(spark, sf_dir):
    """Orders joined literally to the single line item they name, with every outcome kept."""
    return R.literal_left_join(_orders(spark, sf_dir), lines(spark, sf_dir), KEY, KEY)


