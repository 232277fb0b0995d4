"""Table operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedgetable.core import SRC, default_fields
from sedgetable.operators import transforms as T
from sedgetable.plans.inputs import CUSTOMER, ORDERS, SURVEY, cells, load, trim, with_tables

# Texts that every strict operation accepts in full, so the operation goes through.
STRICT = """SELECT CAST(o_orderkey + 1 AS BIGINT) AS __source_record, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE CAST(o_orderkey % 5000 AS STRING) || '.25' END AS amount,
  lpad(CAST(1 + o_orderkey % 28 AS STRING), 2, '0') || '/' || CAST(1 + o_orderkey % 12 AS STRING) || '-' || CAST(1990 + o_orderkey % 40 AS STRING) AS day,
  CAST(o_orderkey % 90 AS STRING) || ' ' || CAST(o_orderkey % 4 * 15 AS STRING) || ' 0″ S' AS south, CAST(61 + o_orderkey AS STRING) AS serial FROM {orders}"""
NATION_CODES = "SELECT CAST(n_nationkey AS STRING) AS code, n_name AS meaning FROM {nation} WHERE n_nationkey % 3 <> 0"


def _customers(s, d):
    return load(s, d, CUSTOMER)


def _strict(s, d):
    return load(s, d, STRICT)


def _op(load_table, **spec):
    return lambda s, d: T.transform(load_table(s, d), {**spec, "confirmed": True})


def _recipe(s, d):
    base = _customers(s, d)
    steps = (
        {"op": "trim whitespace", "column": "segment"},
        {"op": "lowercase", "column": "segment"},
        {"op": "rename column", "column": "name", "value": "customer"},
        {"op": "split column", "column": "customer", "separator": "#", "part": 2, "name": "serial"},
        {"op": "merge columns", "column": "segment", "other": "nationkey", "name": "place", "separator": "/"},
    )
    recipe = T.Recipe("a" * 64, 1, ("custkey", "name", "nationkey", "segment"), steps)
    return T.replay(base, recipe, "a" * 64, 1)


def _batch(s, d):
    tables = {"customers": _customers(s, d), "survey": load(s, d, SURVEY)}
    out = T.mechanical_batch(tables, [("customers", "segment"), ("survey", "site"), ("survey", "event_date")])
    a = out["customers"].select(F.lit("customers").alias("source"), SRC, F.col("segment").alias("text"))
    return a.unionByName(out["survey"].select(F.lit("survey").alias("source"), SRC, F.concat_ws("|", "site", "event_date").alias("text")))


def _declared(s, d):
    df = _strict(s, d)
    fields = T.declare_type(df, default_fields(df), "amount", "number")
    kind = next(f.data_type for f in fields if f.name == "amount")
    return df.groupBy(F.lit("amount").alias("column"), F.lit(kind).alias("data_type")).agg(F.count("*").alias("records"))


def entries():
    c = lambda sql: with_tables(sql, c=CUSTOMER)
    t = lambda sql: with_tables(sql, t=STRICT)
    return {
        "t01_trim_whitespace": (_op(_customers, op="trim whitespace", column="segment"), c(f"SELECT * REPLACE ({trim('segment')} AS segment) FROM c")),
        "t02_uppercase": (_op(_customers, op="uppercase", column="name"), c("SELECT * REPLACE (upper(name) AS name) FROM c")),
        "t02_lowercase": (_op(_customers, op="lowercase", column="name"), c("SELECT * REPLACE (lower(name) AS name) FROM c")),
        "t03_replace_value": (_op(_customers, op="replace value", column="nationkey", match="7", value="seven"), c("SELECT * REPLACE (CASE WHEN nationkey = '7' THEN 'seven' ELSE nationkey END AS nationkey) FROM c")),
        "t04_normalise_missing": (_op(_customers, op="normalize missing", column="segment", value="BUILDING"), c("SELECT * REPLACE (CASE WHEN segment = 'BUILDING' THEN '' ELSE segment END AS segment) FROM c")),
        "t05_map_codes": (
            _op(_customers, op="map codes", column="nationkey", mapping={"0": "zero", "1": "one", "2": ""}),
            c("SELECT * REPLACE (CASE nationkey WHEN '0' THEN 'zero' WHEN '1' THEN 'one' WHEN '2' THEN '' ELSE nationkey END AS nationkey) FROM c"),
        ),
        "t05_map_codes_table": (
            lambda s, d: T.map_codes(_customers(s, d), "nationkey", load(s, d, NATION_CODES)),
            with_tables("SELECT c.* REPLACE (coalesce(m.meaning, c.nationkey) AS nationkey) FROM c LEFT JOIN m ON m.code = c.nationkey", c=CUSTOMER, m=NATION_CODES),
        ),
        "t06_replace_cell": (
            _op(_customers, op="replace cell", record=5, column="name", value="reviewed"),
            c("SELECT * REPLACE (CASE WHEN __source_record = 5 THEN 'reviewed' ELSE name END AS name) FROM c"),
        ),
        "t07_rename_column": (_op(_customers, op="rename column", column="name", value=" customer "), c("SELECT __source_record, custkey, name AS customer, nationkey, segment FROM c")),
        "t08_reorder_column": (_op(_customers, op="reorder column", column="segment", position=1), c("SELECT __source_record, segment, custkey, name, nationkey FROM c")),
        "t09_remove_duplicate_rows": (
            lambda s, d: T.drop_repeats(load(s, d, ORDERS), ["custkey", "status"]),
            with_tables("SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY custkey, status ORDER BY __source_record) AS rn FROM o) WHERE rn = 1", o=ORDERS),
        ),
        "t10_derive_field": (_op(_customers, op="derive field", column="name", name="copy"), c("SELECT *, name AS copy FROM c")),
        "t11_split_column": (_op(_customers, op="split column", column="name", separator="#", part=2, name="serial"), c("SELECT *, split_part(name, '#', 2) AS serial FROM c")),
        "t12_merge_columns": (_op(_customers, op="merge columns", column="name", other="nationkey", name="both"), c("SELECT *, name || ' ' || nationkey AS \"both\" FROM c")),
        "t13_convert_by_factor": (
            _op(_strict, op="convert units", column="amount", name="scaled", factor=4, offset=3),
            t("SELECT *, CASE WHEN amount = '' THEN '' ELSE CAST(CAST(CAST(amount AS DOUBLE) * 4 + 3 AS BIGINT) AS VARCHAR) END AS scaled FROM t"),
        ),
        "t14_parse_dates": (
            _op(_strict, op="parse dates", column="day", name="iso", format="DMY"),
            t("SELECT *, split_part(day, '-', 2) || '-' || lpad(split_part(split_part(day, '-', 1), '/', 2), 2, '0') || '-' || split_part(day, '/', 1) AS iso FROM t"),
        ),
        "t14_parse_serial_dates": (
            _op(_strict, op="parse dates", column="serial", name="iso", format="excel1900", far=True),  # record numbers have no upper end
            t("SELECT *, strftime(DATE '1899-12-31' + CAST(CAST(serial AS BIGINT) - 1 AS INT), '%Y-%m-%d') AS iso FROM t"),
        ),
        "t15_convert_coordinates": (
            _op(_strict, op="convert coordinates", column="south", name="latitude", axis="latitude"),
            t(
                """SELECT *, CASE WHEN split_part(south, ' ', 1) = '0' AND split_part(south, ' ', 2) = '0' THEN '0' ELSE '-' || split_part(south, ' ', 1) ||
                CASE split_part(south, ' ', 2) WHEN '0' THEN '' WHEN '15' THEN '.25' WHEN '30' THEN '.5' ELSE '.75' END END AS latitude FROM t"""
            ),
        ),
        "t16_declare_type": (_declared, t("SELECT 'amount' AS \"column\", 'number' AS data_type, count(*) AS records FROM t")),
        "t01_preview_of_a_trim": (
            lambda s, d: T.preview(_customers(s, d), T.trim_column(_customers(s, d), "segment"), "segment"),
            c(
                f"""SELECT __source_record, segment AS before, {trim('segment')} AS after, (SELECT count(*) FROM c WHERE segment <> {trim('segment')}) AS affected FROM c
                WHERE segment <> {trim('segment')} ORDER BY __source_record LIMIT 5"""
            ),
        ),
        "t29_mechanical_batch_preview": (
            lambda s, d: T.trim_preview(load(s, d, SURVEY), ["site", "event_date"]),
            with_tables(f"""SELECT "column", count(CASE WHEN value <> {trim('value')} THEN 1 END) AS affected FROM ({cells('t', ['site', 'event_date'])}) GROUP BY "column" """, t=SURVEY),
        ),
        "t29_mechanical_batch": (
            _batch,
            with_tables(f"SELECT 'customers' AS source, __source_record, {trim('segment')} AS text FROM c UNION ALL SELECT 'survey', __source_record, {trim('site')} || '|' || {trim('event_date')} FROM t", c=CUSTOMER, t=SURVEY),
        ),
        "t30_recipe_replay": (
            _recipe,
            c(f"SELECT __source_record, custkey, name AS customer, nationkey, lower({trim('segment')}) AS segment, split_part(name, '#', 2) AS serial, lower({trim('segment')}) || '/' || nationkey AS place FROM c"),
        ),
    }
