"""Checks against declared schemas."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedgetable.core import Field
from sedgetable.operators import findings as N, validation as V
from sedgetable.plans.inputs import CUSTOMER, DECIMAL, DICTIONARY_ROWS, INTEGER, ORDERS, SURVEY, cells, dictionary, load, matches, with_tables
from sedgetable.plans.findings import RULES, _cells_cte, _fields, rule_sql

# Line items as text with planted breaks: blanks, odd flags, words and long texts.
CHECKED = """SELECT CAST(o_orderkey + 1 AS BIGINT) AS __source_record, CASE WHEN o_orderkey % 50 = 0 THEN '' WHEN o_orderkey % 50 = 7 THEN CAST(o_orderkey + 1 AS STRING) ELSE CAST(o_orderkey AS STRING) END AS id,
  CASE o_orderkey % 9 WHEN 0 THEN 'x' WHEN 1 THEN '-3' WHEN 2 THEN 'NA' WHEN 3 THEN '1e1' ELSE CAST(o_orderkey % 130 AS STRING) END AS quantity,
  CASE o_orderkey % 8 WHEN 0 THEN '.5' WHEN 1 THEN 'half' WHEN 2 THEN '' ELSE CAST(o_custkey % 300 AS STRING) || '.25' END AS share,
  CASE o_orderkey % 6 WHEN 0 THEN 'yes' WHEN 1 THEN 'TRUE' WHEN 2 THEN '0' ELSE 'false' END AS flag, o_orderpriority AS priority, o_orderstatus AS status,
  CAST(1990 + o_orderkey % 40 AS STRING) || '-' || lpad(CAST(1 + o_orderkey % 13 AS STRING), 2, '0') || '-05T' || lpad(CAST(o_orderkey % 25 AS STRING), 2, '0') || ':00:00Z' AS eventStart,
  CAST(1990 + o_orderkey % 37 AS STRING) || '-' || lpad(CAST(1 + o_orderkey % 12 AS STRING), 2, '0') || '-05T12:00:00Z' AS eventEnd,
  CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE CAST(o_custkey + o_orderkey % 2 * 100000000 AS STRING) END AS customer
FROM {orders}"""
SCHEMA = {
    "missingValues": ["", "NA"],
    "primaryKey": ["id"],
    "foreignKeys": [{"fields": "customer", "reference": {"resource": "customers", "fields": "custkey"}}, {"fields": "status", "reference": {"resource": "customers", "fields": "name"}}],
    "fields": [
        {"name": "id", "type": "string", "constraints": {"required": True, "unique": True}},
        {"name": "quantity", "type": "integer", "constraints": {"minimum": 0, "maximum": 100}},
        {"name": "share", "type": "number", "constraints": {"maximum": 250}},
        {"name": "flag", "type": "boolean", "constraints": {"enum": [False]}},
        {"name": "priority", "type": "string", "constraints": {"pattern": "^[1-3]-", "maxLength": 8, "minLength": 6}},
        {"name": "status", "type": "string", "constraints": {"enum": ["O", "F"]}},
        {"name": "eventStart", "type": "datetime", "format": "%Y-%m-%dT%H:%M:%S%z"},
        {"name": "eventEnd", "type": "datetime"},
    ],
}
CUSTOMER_SCHEMA = {"primaryKey": "custkey", "fields": [{"name": "custkey", "type": "string"}]}
# Field descriptors of many tables, derived from the dictionary rows.
DESCRIPTORS = """SELECT "table", CASE WHEN position = 14 THEN 'species' ELSE name END AS name, CASE WHEN position % 4 = 0 THEN '' ELSE original_name END AS title, description, data_type AS type,
  CASE WHEN term = '' THEN '' WHEN term LIKE 'http%' THEN term ELSE 'http://example.org/terms/' || term END AS term FROM ({rows})"""
_PRESENT = "id quantity share flag priority status eventStart eventEnd".split()


def _checked(s, d):
    return load(s, d, CHECKED)


def _descriptors(s, d):
    return load(s, d, DESCRIPTORS.replace("{rows}", DICTIONARY_ROWS))


_DESCRIPTOR_SQL = DESCRIPTORS.replace("{rows}", DICTIONARY_ROWS)
_REFERENCE_SQL = f"""SELECT "table", name, CASE WHEN name = 'n' THEN 'changed' ELSE title END AS title, description, type, term, name = 'count' OR name = 'extra' AS required FROM ({_DESCRIPTOR_SQL}) WHERE name NOT IN ('lat', 'species')
UNION ALL SELECT 'table 2', 'extra', 'x', 'x', 'string', '', true FROM {{region}} WHERE r_regionkey = 0"""
_CHANGES = """SELECT "table", CASE WHEN position = 14 THEN 'nowhere' ELSE name END AS name, CASE WHEN position % 3 = 0 THEN description ELSE '' END AS description, unit, data_type,
  CASE position % 5 WHEN 0 THEN 'Confirmed' WHEN 1 THEN 'Certain' WHEN 2 THEN status ELSE 'Confirmed' END AS status, reviewer FROM ({rows})""".replace("{rows}", DICTIONARY_ROWS)


def _layout(s, d):
    headers = load(s, d, "SELECT c_custkey FROM {customer}").select(
        F.concat(F.lit("file "), F.col("c_custkey").cast("string")).alias("resource"),
        F.concat(F.lit("table "), (F.col("c_custkey") % 1000).cast("string")).alias("table"),
        F.posexplode(
            F.when(F.col("c_custkey") % 7 == 3, F.array(F.lit("id"), F.lit("odd"), F.lit("note")))
            .when(F.col("c_custkey") % 5 == 1, F.array(F.lit("name"), F.lit("id"), F.lit("note")))
            .otherwise(F.array(F.lit("id"), F.lit("name"), F.lit("note")))
        ).alias("position", "name"),
    )
    declared = load(s, d, "SELECT c_custkey FROM {customer}").select(
        F.concat(F.lit("table "), F.col("c_custkey").cast("string")).alias("table"), F.posexplode(F.array(F.lit("id"), F.lit("name"), F.lit("note"))).alias("position", "name")
    )
    return V.layout_findings(headers, declared)


_LAYOUT_SQL = """WITH files AS (SELECT 'file ' || c_custkey AS resource, 'table ' || (c_custkey % 1000) AS "table", CASE WHEN c_custkey % 7 = 3 THEN ['id', 'odd', 'note'] WHEN c_custkey % 5 = 1 THEN ['name', 'id', 'note'] ELSE ['id', 'name', 'note'] END AS names FROM customer),
  declared AS (SELECT 'table ' || c_custkey AS "table" FROM customer)
  SELECT CASE WHEN NOT list_contains(names, f.name) THEN 'absent field' ELSE 'field order' END AS rule, resource, x."table", f.name FROM files x JOIN declared USING ("table"), (VALUES ('id', 1), ('name', 2), ('note', 3)) f(name, place)
    WHERE NOT list_contains(names, f.name) OR list_position(names, f.name) <> f.place
  UNION ALL SELECT 'repeated table', '', "table", '' FROM files GROUP BY "table" HAVING count(*) > 1
  UNION ALL SELECT 'absent table', '', "table", '' FROM declared WHERE "table" NOT IN (SELECT "table" FROM files)"""


def _star(s, d):
    core = load(s, d, CUSTOMER).withColumn("custkey", F.when(F.col("__source_record") % 90 == 0, " ").when(F.col("__source_record") % 70 == 0, "1").otherwise(F.col("custkey")))
    orders = load(s, d, ORDERS)
    padded = orders.withColumn("custkey", F.when(F.col("__source_record") % 13 == 0, F.concat(F.lit("0"), "custkey")).otherwise(F.col("custkey")))
    return V.star_findings(core, "custkey", {"orders": (padded, "custkey")})


def entries():
    v = "value"
    checked_cells = cells("t", _PRESENT)
    iso_start = "TRY_STRPTIME(eventStart, '%Y-%m-%dT%H:%M:%SZ')"
    iso_end = "TRY_STRPTIME(eventEnd, '%Y-%m-%dT%H:%M:%SZ')"
    boolean_ok = f"{v} IN ('true', 'True', 'TRUE', '1', 'false', 'False', 'FALSE', '0')"
    start_ok = f"TRY_STRPTIME({v}, '%Y-%m-%dT%H:%M:%SZ') IS NOT NULL"
    present = f"{v} NOT IN ('', 'NA')"
    col = lambda c: f""""column" = '{c}'"""
    rules = {
        "required": f"{col('id')} AND {v} IN ('', 'NA')",
        "type": f"{present} AND (({col('quantity')} AND NOT {matches(v, INTEGER)}) OR ({col('share')} AND NOT {matches(v, DECIMAL)}) OR ({col('flag')} AND NOT {boolean_ok}) OR (\"column\" IN ('eventStart', 'eventEnd') AND NOT {start_ok}))",
        "vocabulary": f"({col('flag')} AND {boolean_ok} AND {v} IN ('true', 'True', 'TRUE', '1')) OR ({col('status')} AND {present} AND {v} NOT IN ('O', 'F'))",
        "pattern": f"{col('priority')} AND {present} AND NOT {matches(v, '^[1-3]-')}",
        "minimum": f"{col('quantity')} AND CASE WHEN {matches(v, INTEGER)} THEN CAST({v} AS INT) < 0 ELSE false END",
        "maximum": f"({col('quantity')} AND CASE WHEN {matches(v, INTEGER)} THEN CAST({v} AS INT) > 100 ELSE false END) OR ({col('share')} AND CASE WHEN {matches(v, DECIMAL)} THEN CAST({v} AS DOUBLE) > 250 ELSE false END)",
        "minLength": f"{col('priority')} AND {present} AND length({v}) < 6",
        "maxLength": f"{col('priority')} AND {present} AND length({v}) > 8",
    }
    one = lambda rule: f"""SELECT '{rule}' AS rule, "column", __source_record, value FROM ({checked_cells}) WHERE {rules[rule]}"""
    found = lambda *names: with_tables(" UNION ALL ".join(one(n) for n in names), t=CHECKED)
    named = lambda *names: (lambda s, d: V.value_findings(_checked(s, d), SCHEMA).filter(F.col("rule").isin(*names)))
    return {
        "v01_record_width": (
            lambda s, d: V.width_findings(_checked(s, d).withColumn("__row_width", F.when(F.col("__source_record") % 13 == 0, 8).otherwise(9)), 9),
            with_tables("SELECT 'width' AS rule, __source_record, '8' AS value FROM t WHERE __source_record % 13 = 0", t=CHECKED),
        ),
        "v02_layout": (_layout, _LAYOUT_SQL),
        "v03_required_values": (named("required"), found("required")),
        "v04_types": (named("type"), found("type")),
        "v05_vocabulary": (named("vocabulary"), found("vocabulary")),
        "v06_pattern": (named("pattern"), found("pattern")),
        "v07_ranges_and_lengths": (named("minimum", "maximum", "minLength", "maxLength"), found("minimum", "maximum", "minLength", "maxLength")),
        "v08_unique_values": (
            lambda s, d: V.unique_findings(_checked(s, d), SCHEMA),
            with_tables("""SELECT 'unique' AS rule, 'id' AS "column", __source_record, id AS value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY __source_record) AS rn FROM t WHERE id <> '') WHERE rn > 1""", t=CHECKED),
        ),
        "v09_start_after_end": (
            lambda s, d: V.temporal_findings(_checked(s, d), SCHEMA),
            with_tables(f"SELECT 'eventStart after eventEnd' AS rule, __source_record FROM t WHERE {iso_start} > {iso_end}", t=CHECKED),
        ),
        "v10_foreign_key_orphans": (
            lambda s, d: V.foreign_key_orphans(_checked(s, d), load(s, d, CUSTOMER), "customer", "custkey"),
            with_tables("SELECT 'foreign key' AS rule, __source_record, customer AS value FROM t WHERE customer <> '' AND customer NOT IN (SELECT custkey FROM c)", t=CHECKED, c=CUSTOMER),
        ),
        "v11_declared_keys": (
            lambda s, d: V.declared_key_findings({"records": _checked(s, d), "customers": load(s, d, CUSTOMER)}, {"records": SCHEMA, "customers": CUSTOMER_SCHEMA}),
            with_tables(
                """SELECT 'primary key missing' AS rule, 'records' AS "table", __source_record FROM t WHERE id = ''
                UNION ALL SELECT 'primary key repeated', 'records', __source_record FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY __source_record) AS rn FROM t WHERE id <> '') WHERE rn > 1
                UNION ALL SELECT 'foreign key orphan', 'records', __source_record FROM t WHERE customer <> '' AND customer NOT IN (SELECT custkey FROM c)
                UNION ALL SELECT 'foreign key target', 'records', NULL""",
                t=CHECKED, c=CUSTOMER,
            ),
        ),
        "v13_field_descriptors": (
            lambda s, d: V.descriptor_findings(_descriptors(s, d)),
            with_tables(
                """SELECT "table", name, 'field needs title' AS rule FROM x WHERE trim(title) = '' UNION ALL SELECT "table", name, 'field needs description' FROM x WHERE trim(description) = ''
                UNION ALL SELECT "table", name, 'field needs a term address' FROM x WHERE term = '' UNION ALL SELECT "table", name, 'repeated field name' FROM x GROUP BY "table", name HAVING count(*) > 1""",
                x=_DESCRIPTOR_SQL,
            ),
        ),
        "v14_reference_schema": (
            lambda s, d: V.reference_schema_findings(_descriptors(s, d), load(s, d, _REFERENCE_SQL)),
            with_tables(
                """SELECT 'unknown field' AS rule, "table", name FROM x WHERE NOT EXISTS (SELECT 1 FROM y WHERE y."table" = x."table" AND y.name = x.name)
                UNION ALL SELECT 'required field absent', "table", name FROM y WHERE required AND "table" IN (SELECT "table" FROM x) AND NOT EXISTS (SELECT 1 FROM x WHERE y."table" = x."table" AND y.name = x.name)
                UNION ALL SELECT 'descriptor differs', x."table", x.name FROM x JOIN y ON y."table" = x."table" AND y.name = x.name WHERE x.title <> y.title OR x.description <> y.description OR x.type <> y.type OR x.term <> y.term""",
                x=_DESCRIPTOR_SQL, y=_REFERENCE_SQL,
            ),
        ),
        "v14_undeclared_keys": (
            lambda s, d: V.undeclared_keys(_declared_keys(s, d), _declared_keys(s, d).filter("`key` <> 'species' and kind = 'primary'")),
            with_tables("""SELECT "table", kind, "key" FROM (SELECT "table", 'primary' AS kind, name AS "key" FROM dict WHERE position < 3 UNION ALL SELECT "table", 'foreign', name FROM dict WHERE position = 3) WHERE "key" = 'species' OR kind = 'foreign'""", dict=DICTIONARY_ROWS),
        ),
        "v15_star_check": (
            _star,
            with_tables(
                """SELECT 'core' AS "table", 'blank identifier' AS rule, __source_record FROM core WHERE trim(id) = ''
                UNION ALL SELECT 'core', 'repeated identifier', __source_record FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY __source_record) AS rn FROM core) WHERE rn > 1
                UNION ALL SELECT 'orders', 'blank core link', __source_record FROM ext WHERE trim(id) = ''
                UNION ALL SELECT 'orders', 'unmatched core link', __source_record FROM ext WHERE trim(id) <> '' AND id NOT IN (SELECT id FROM core)""",
                c=CUSTOMER, o=ORDERS,
                core="SELECT __source_record, CASE WHEN __source_record % 90 = 0 THEN ' ' WHEN __source_record % 70 = 0 THEN '1' ELSE custkey END AS id FROM c",
                ext="SELECT __source_record, CASE WHEN __source_record % 13 = 0 THEN '0' || custkey ELSE custkey END AS id FROM o",
            ),
        ),
        "v16_dictionary_fit": (
            lambda s, d: V.dictionary_fit(_checked(s, d), _DECLARED),
            with_tables(
                f"""SELECT * FROM (SELECT 'quantity' AS "column", 'integer' AS data_type, bool_or(quantity <> '' AND NOT {matches('quantity', INTEGER)}) AS type_mismatch, false AS unexpected_category FROM t
                UNION ALL SELECT 'share', 'number', bool_or(share <> '' AND NOT {matches('share', DECIMAL)}), false FROM t UNION ALL SELECT 'flag', 'boolean', bool_or(flag <> '' AND lower(flag) NOT IN ('true', 'false')), false FROM t
                UNION ALL SELECT 'status', 'string', false, bool_or(status <> '' AND status NOT IN ('O', 'F')) FROM t UNION ALL SELECT 'priority', 'string', false, false FROM t) WHERE type_mismatch OR unexpected_category""",
                t=CHECKED,
            ),
        ),
        "v17_dictionary_changes": (
            lambda s, d: V.dictionary_change_findings(dictionary(s, d), load(s, d, _CHANGES)),
            with_tables(
                """SELECT "table", name, rule FROM (SELECT ch."table", ch.name, unnest(list_filter([CASE WHEN dict.status IS NULL THEN 'unknown field' END,
                CASE WHEN ch.status NOT IN ('Confirmed', 'Inferred', 'Unknown', 'Conflicting', 'Not Applicable') THEN 'unknown status' END, CASE WHEN ch.data_type NOT IN ('string', 'integer', 'number', 'boolean', 'date') THEN 'unknown type' END,
                CASE WHEN ch.status = 'Confirmed' AND trim(ch.reviewer) = '' THEN 'confirmed without reviewer' END, CASE WHEN ch.status = 'Confirmed' AND trim(ch.description) = '' THEN 'confirmed without description' END,
                CASE WHEN ch.description = dict.description AND ch.unit = dict.unit AND ch.data_type = dict.data_type AND ch.status = dict.status THEN 'nothing changes' END], lambda x: x IS NOT NULL)) AS rule
                FROM ch LEFT JOIN dict ON dict."table" = ch."table" AND dict.name = ch.name)""",
                dict=DICTIONARY_ROWS, ch=_CHANGES,
            ),
        ),
        "v18_validation_summary": (
            lambda s, d: V.validation_summary(N.cell_findings(load(s, d, SURVEY), _fields(s, d)), load(s, d, SURVEY)),
            _cells_cte(
                f"""SELECT count(CASE WHEN severity = 'Error' THEN 1 END) AS errors, count(CASE WHEN severity = 'Warning' THEN 1 END) AS warnings, count(CASE WHEN severity = 'Information' THEN 1 END) AS notes,
                (SELECT count(*) FROM t) AS records_checked, count(CASE WHEN severity = 'Error' THEN 1 END) = 0 AS passed FROM ({' UNION ALL '.join(rule_sql(k) for k in RULES)})"""
            ),
        ),
    }


def _declared_keys(s, d):
    rows = dictionary(s, d)
    primary = rows.filter("position < 3").select("table", F.lit("primary").alias("kind"), F.col("name").alias("key"))
    return primary.unionByName(rows.filter("position = 3").select("table", F.lit("foreign").alias("kind"), F.col("name").alias("key")))


_DECLARED = [Field("quantity", data_type="integer"), Field("share", data_type="number"), Field("flag", data_type="boolean"), Field("status", allowed=["O", "F"]), Field("priority")]
