"""Cell edits, history and replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedgetable.operators import comparison as C, edits as H
from sedgetable.plans.inputs import CUSTOMER, CUSTOMER_COLUMNS, EDITS, SURVEY, cells, load, trim_record, with_tables
from sedgetable.scale import table_digest

TARGETS = ["site", "event_date"]
# A log whose every row continues the one before it: an edit and, for even keys, an edit of the same cell.
CLEAN = """SELECT CAST(c_custkey * 2 + 1 AS BIGINT) AS sequence, CAST(c_custkey + 1 AS BIGINT) AS __source_record, 'name' AS "column", c_name AS before, c_name || ' (checked)' AS after, 'edit' AS action, CAST(NULL AS BIGINT) AS reference FROM {customer}
UNION ALL SELECT CAST(c_custkey * 2 + 2 AS BIGINT), CAST(c_custkey + 1 AS BIGINT), CASE WHEN c_custkey % 2 = 0 THEN 'name' ELSE 'nationkey' END,
  CASE WHEN c_custkey % 2 = 0 THEN c_name || ' (checked)' ELSE CAST(c_nationkey AS STRING) END, CASE WHEN c_custkey % 2 = 0 THEN c_name || ' (twice)' ELSE 'N' || CAST(c_nationkey AS STRING) END, 'edit', CAST(NULL AS BIGINT) FROM {customer}"""
GROUPS = """SELECT CAST(c_custkey * 12 + 1 AS BIGINT) AS first_sequence, CAST(c_custkey * 12 + 1 + CASE WHEN c_custkey % 10 = 3 THEN 14 ELSE 3 END AS BIGINT) AS last_sequence, CAST(CASE WHEN c_custkey % 7 = 2 THEN 5 ELSE 4 END AS BIGINT) AS changed_cells FROM {customer}"""
# A log in which records 12n+1 .. 12n+4 are batch trims.
BATCHES = """SELECT CAST(o_orderkey AS BIGINT) AS sequence, CAST(o_orderkey + 1 AS BIGINT) AS __source_record, 'site' AS "column", ' ' || o_orderstatus AS before, o_orderstatus AS after,
  CASE WHEN o_orderkey % 12 BETWEEN 1 AND 4 THEN 'batch-trim' ELSE 'edit' END AS action, CAST(NULL AS BIGINT) AS reference FROM {orders}"""
HISTORY = """SELECT 'table ' || CAST(CAST(floor(p_partkey / 15) AS BIGINT) AS STRING) AS "table", CAST(p_partkey AS BIGINT) AS sequence, CASE WHEN p_partkey % 20 = 8 THEN 'other' ELSE 'state ' || CAST(p_partkey AS STRING) END AS before,
  CASE WHEN p_partkey % 33 = 4 THEN 'state ' || CAST(p_partkey AS STRING) ELSE 'state ' || CAST(p_partkey + 1 AS STRING) END AS after, CAST(p_partkey - CASE WHEN p_partkey % 17 = 5 THEN 9 ELSE 0 END AS BIGINT) AS working_revision FROM {part}"""


def _survey(s, d):
    return load(s, d, SURVEY)


def _customers(s, d):
    return load(s, d, CUSTOMER)


def _applied(s, d):
    changes = H.trim_changes(_survey(s, d), TARGETS)
    return H.apply_edits(_survey(s, d), changes)


def _events(s, d):
    return H.edit_events(H.trim_changes(_survey(s, d), TARGETS), 100, "batch-trim", "outer whitespace", "curator")


def _batch_step(action: str):
    """The trim batch as one group, undone, and for a redo done again."""

    def run(s, d):
        log = _events(s, d)
        group = log.agg(F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"))
        undone = H.step_events(log, "undo", "not wanted", "curator", group)
        return undone if action == "undo" else H.step_events(log.unionByName(undone), "redo", "wanted", "curator", group)

    return run


def _step_sql(action: str) -> str:
    """Every change of the batch again, behind as many steps as came before."""
    steps, cells, why = (1, "after AS before, before AS after", "not wanted") if action == "undo" else (2, "before, after", "wanted")
    return _changes_sql(
        f"""SELECT 100 + {steps} * (SELECT count(*) FROM changes) + n AS sequence, __source_record, "column", {cells}, 'batch-{action}' AS action, 100 + n AS reference, '{why}' AS rationale, 'curator' AS reviewer
        FROM (SELECT *, row_number() OVER (ORDER BY __source_record, "column") AS n FROM changes)"""
    )


def _conflicts(s, d):
    edits = load(s, d, EDITS).filter("action <> 'redo'").select("__source_record", "column", "before", "after")
    more = _customers(s, d).filter("__source_record % 50 = 0").select(F.col("__source_record") + 100000000, F.lit("name"), F.lit("x"), F.lit("y"))
    odd = _customers(s, d).filter("__source_record % 60 = 0").select("__source_record", F.lit("height"), F.lit("x"), F.lit("y"))
    return H.edit_conflicts(_customers(s, d), edits.union(more).union(odd))


def _replayed(s, d):
    base, log = _customers(s, d), load(s, d, CLEAN)
    working = H.table_as_of(base, log, 1 << 60)
    altered = working.withColumn("name", F.when(F.col("__source_record") % 400 == 1, "tampered").otherwise(F.col("name")))
    return H.replay_report(base, log, altered)


def _guarded(s, d):
    """The trim batch again, after both reads of the table gave the same fingerprint."""
    before = table_digest(_survey(s, d)).first()["digest"]
    return H.trim_changes(C.guard_fingerprint(_survey(s, d), before), TARGETS)


def _changes_sql(select: str) -> str:
    body = f"""changes AS (SELECT __source_record, "column", value AS before, {trim_record('value')} AS after FROM ({cells('t', TARGETS)}) WHERE value <> {trim_record('value')})"""
    return with_tables("@", t=SURVEY).replace(" @", f", {body} {select}")


def _digest_sql() -> str:
    parts = ", ".join(f"CAST(sum(CAST('0x' || substring(h, {1 + 8 * i}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8))
    return with_tables(
        f"""SELECT first_sequence, count(*) AS cells, sha256(concat_ws('-', {parts})) AS digest FROM (SELECT first_sequence,
        sha256('["' || sequence || '","' || __source_record || '","' || "column" || '","' || before || '","' || after || '"]') AS h FROM g JOIN log ON sequence BETWEEN first_sequence AND last_sequence) GROUP BY first_sequence""",
        g=GROUPS, log=BATCHES,
    )


def _half_way(s, d):
    """The customers after half of the log."""
    log = load(s, d, EDITS)
    return H.table_as_of(_customers(s, d), log, log.agg(F.floor(F.max("sequence") / 2)).first()[0])


def entries():
    as_of = lambda n: with_tables(
        f"""SELECT c.__source_record, custkey, coalesce(n.after, name) AS name, coalesce(k.after, nationkey) AS nationkey, segment FROM c
        LEFT JOIN (SELECT __source_record, arg_max(after, sequence) AS after FROM log WHERE "column" = 'name' AND sequence <= {n} GROUP BY __source_record) n ON n.__source_record = c.__source_record
        LEFT JOIN (SELECT __source_record, arg_max(after, sequence) AS after FROM log WHERE "column" = 'nationkey' AND sequence <= {n} GROUP BY __source_record) k ON k.__source_record = c.__source_record""",
        c=CUSTOMER, log=EDITS,
    )
    current = "CASE u.\"column\" " + " ".join(f"WHEN '{c}' THEN c.{c}" for c in CUSTOMER_COLUMNS) + " END"
    return {
        "h01_batch_trim_changes": (lambda s, d: H.trim_changes(_survey(s, d), TARGETS), _changes_sql("SELECT * FROM changes")),
        "h01_batch_trim_examples": (
            lambda s, d: H.change_examples(H.trim_changes(_survey(s, d), TARGETS)),
            _changes_sql('SELECT * FROM changes ORDER BY __source_record, "column" LIMIT 10'),
        ),
        "h01_batch_trim_summary": (
            lambda s, d: H.change_summary(_survey(s, d), H.trim_changes(_survey(s, d), TARGETS)).drop("digest"),
            _changes_sql("SELECT (SELECT count(*) FROM changes) AS changed_cells, (SELECT count(*) FROM t) AS records_scanned, (SELECT count(*) > 0 AND count(*) <= 50000 FROM changes) AS within_review_limit"),
        ),
        "h02_apply_edits": (_applied, with_tables(f"SELECT * REPLACE ({trim_record('site')} AS site, {trim_record('event_date')} AS event_date) FROM t", t=SURVEY)),
        "h02_edit_conflicts": (
            _conflicts,
            with_tables(
                f"""SELECT __source_record, "column", reason FROM (SELECT u.__source_record, u."column", CASE WHEN n > 1 THEN 'repeated cell' WHEN u."column" = 'height' THEN 'absent column' WHEN c.__source_record IS NULL THEN 'absent record'
                WHEN before = after THEN 'nothing changes' WHEN {current} <> before THEN 'other value recorded' END AS reason FROM
                (SELECT __source_record, "column", count(*) AS n, min(before) AS before, min(after) AS after FROM (
                  SELECT __source_record, "column", before, after FROM log WHERE action <> 'redo' UNION ALL SELECT __source_record + 100000000, 'name', 'x', 'y' FROM c WHERE __source_record % 50 = 0
                  UNION ALL SELECT __source_record, 'height', 'x', 'y' FROM c WHERE __source_record % 60 = 0) GROUP BY __source_record, "column") u LEFT JOIN c ON c.__source_record = u.__source_record) WHERE reason IS NOT NULL""",
                c=CUSTOMER, log=EDITS,
            ),
        ),
        "h03_edit_events": (
            _events,
            _changes_sql(
                """SELECT 100 + row_number() OVER (ORDER BY __source_record, "column") AS sequence, __source_record, "column", before, after, 'batch-trim' AS action, CAST(NULL AS BIGINT) AS reference, 'outer whitespace' AS rationale, 'curator' AS reviewer FROM changes"""
            ),
        ),
        "h05_batch_undo_events": (_batch_step("undo"), _step_sql("undo")),
        "h05_batch_redo_events": (_batch_step("redo"), _step_sql("redo")),
        "h04_table_as_of": (_half_way, as_of("(SELECT max(sequence) // 2 FROM log)")),
        "h05_edit_states": (
            lambda s, d: H.edit_states(load(s, d, EDITS)),
            with_tables(
                """SELECT edit, last_action, last_sequence, CASE WHEN last_action NOT IN ('undo', 'batch-undo') THEN 'active' WHEN last_sequence > (SELECT max(sequence) FROM log WHERE action IN ('edit', 'batch-trim')) THEN 'redoable' ELSE 'discarded' END AS state
                FROM (SELECT coalesce(reference, sequence) AS edit, arg_max(action, sequence) AS last_action, max(sequence) AS last_sequence FROM log GROUP BY coalesce(reference, sequence))""",
                log=EDITS,
            ),
        ),
        "h06_replay_report": (
            _replayed,
            with_tables(
                """SELECT true AS contiguous, CAST(0 AS BIGINT) AS chain_breaks, count(*) AS left_only, count(*) AS right_only, count(*) = 0 AS verified FROM c WHERE __source_record % 400 = 1""",
                c=CUSTOMER,
            ),
        ),
        "h06_chain_breaks": (
            lambda s, d: H.chain_breaks(load(s, d, EDITS)),
            with_tables(
                """SELECT sequence, __source_record, "column", before, previous FROM (SELECT *, lag(after) OVER (PARTITION BY __source_record, "column" ORDER BY sequence) AS previous FROM log) WHERE previous IS NOT NULL AND before <> previous""",
                log=EDITS,
            ),
        ),
        "h06_first_edit_breaks": (
            lambda s, d: H.first_edit_breaks(_customers(s, d).withColumn("name", F.when(F.col("__source_record") % 90 == 0, "x").otherwise(F.col("name"))), load(s, d, EDITS)),
            with_tables("""SELECT __source_record, 'name' AS "column", name AS before FROM c WHERE __source_record % 90 = 0""", c=CUSTOMER),
        ),
        "h07_batch_group_findings": (
            lambda s, d: H.batch_group_findings(load(s, d, GROUPS), load(s, d, BATCHES)),
            with_tables(
                """SELECT first_sequence, 'not contiguous' AS rule FROM g WHERE last_sequence - first_sequence + 1 <> changed_cells
                UNION ALL SELECT first_sequence, 'overlaps an earlier group' FROM (SELECT *, max(last_sequence) OVER (ORDER BY first_sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM g) WHERE reached >= first_sequence
                UNION ALL SELECT first_sequence, 'log rows differ' FROM g WHERE (SELECT count(*) FROM log WHERE action = 'batch-trim' AND sequence BETWEEN g.first_sequence AND g.last_sequence) <> changed_cells""",
                g=GROUPS, log=BATCHES,
            ),
        ),
        "h07_batch_group_digests": (lambda s, d: H.batch_group_digests(load(s, d, BATCHES), load(s, d, GROUPS)), _digest_sql()),
        "h08_metadata_history": (
            lambda s, d: H.metadata_history_findings(load(s, d, HISTORY)),
            with_tables(
                """SELECT "table", sequence, 'before differs from previous after' AS rule FROM x WHERE before <> pa UNION ALL SELECT "table", sequence, 'nothing changes' FROM x WHERE before = after UNION ALL SELECT "table", sequence, 'revision falls' FROM x WHERE working_revision < pr""",
                h=HISTORY, x="""SELECT *, lag(after) OVER (PARTITION BY "table" ORDER BY sequence) AS pa, lag(working_revision) OVER (PARTITION BY "table" ORDER BY sequence) AS pr FROM h""",
            ),
        ),
        "h09_guarded_batch_trim": (_guarded, _changes_sql("SELECT * FROM changes")),
    }
