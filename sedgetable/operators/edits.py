"""Reviewed cell edits, their append-only log, and replay from the log.

Log columns: sequence, __source_record, column, before, after, action,
reference, rationale, reviewer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sedgetable.core import SRC, TableError, data_columns, require, unpivot_cells
from sedgetable.functions.text import RECORD_SPACE, trim_space
from sedgetable.operators.equality import same_rows
from sedgetable.scale import highest_before, keyed_digest, number_rows, previous_value

REVIEW_LIMIT = 50_000
NEW_ACTIONS = ("edit", "batch-trim")
UNDO_ACTIONS = ("undo", "batch-undo")
LOG_COLUMNS = ["sequence", SRC, "column", "before", "after", "action", "reference", "rationale", "reviewer"]


def trim_changes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cells a trim would change, with both texts."""
    require(df, columns)
    cells = unpivot_cells(df, columns)
    after = trim_space(F.col("value"), RECORD_SPACE)
    return cells.select(SRC, "column", F.col("value").alias("before"), after.alias("after")).filter("before <> after")


def change_examples(changes: DataFrame, k: int = 10) -> DataFrame:
    return changes.orderBy(SRC, "column").limit(k)


def changes_digest(changes: DataFrame) -> DataFrame:
    """One SHA-256 over all changes; a record first folds its own cells (at most 250)."""
    part = F.to_json(F.array("column", "before", "after"))
    per_record = changes.groupBy(SRC).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(part)), "\n"), 256).alias("h"))
    keyed = per_record.select(SRC, F.sha2(F.concat(F.col(SRC).cast("string"), F.lit("|"), "h"), 256).alias("h"))
    return keyed_digest(keyed, SRC, "h")


def change_summary(df: DataFrame, changes: DataFrame, limit: int = REVIEW_LIMIT) -> DataFrame:
    """Changed cells, scanned records, digest and whether one review may cover them."""
    n = changes.agg(F.count("*")).scalar()
    digest = changes_digest(changes).select("digest").scalar()
    return df.agg(F.count("*").alias("records_scanned")).select(
        n.alias("changed_cells"), "records_scanned", digest.alias("digest"), ((n > 0) & (n <= limit)).alias("within_review_limit")
    )


def _per_record(edits: DataFrame, value: Column) -> DataFrame:
    """Edits of a record as one map from column to value; a record has at most 250 columns."""
    return edits.groupBy(SRC).agg(F.map_from_entries(F.collect_list(F.struct(F.col("column"), value.alias("v")))).alias("__edits"))


def _overlay(df: DataFrame, per_record: DataFrame) -> DataFrame:
    joined = df.join(per_record, SRC, "left")
    cells = {c: F.coalesce(F.try_element_at("__edits", F.lit(c)), F.col(f"`{c}`")) for c in data_columns(df)}
    return joined.withColumns(cells).select(*[F.col(f"`{c}`") for c in df.columns])


def edit_conflicts(df: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits that cannot be applied: repeated cell, absent record or column, no change, or another value there."""
    names = data_columns(df)
    repeated = edits.groupBy(SRC, "column").agg(F.count("*").alias("n"), F.min("before").alias("before"), F.min("after").alias("after"))
    joined = repeated.join(df, SRC, "left")
    current = F.coalesce(*[F.when(F.col("column") == c, F.col(f"`{c}`")) for c in names])
    reason = (
        F.when(F.col("n") > 1, "repeated cell")
        .when(~F.col("column").isin(*names), "absent column")
        .when(current.isNull(), "absent record")
        .when(F.col("before") == F.col("after"), "nothing changes")
        .when(current != F.col("before"), "other value recorded")
    )
    return joined.select(SRC, "column", reason.alias("reason")).filter("reason is not null")


def apply_edits(df: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply a batch ``(__source_record, column, before, after)``, all or nothing."""
    first = edit_conflicts(df, edits).first()
    if first is not None:
        raise TableError(f"edit refused: {first['reason']} at record {first[SRC]}, column {first['column']}")
    return _overlay(df, _per_record(edits, F.col("after")))


def edit_events(changes: DataFrame, last_sequence: int, action: str, rationale: str, reviewer: str) -> DataFrame:
    """New log rows, numbered on from the last sequence in record and column order."""
    if not rationale.strip():
        raise TableError("an edit needs a rationale")
    numbered = number_rows(changes, [SRC, "column"], "sequence", last_sequence + 1)
    return numbered.select(
        "sequence", SRC, "column", "before", "after", F.lit(action).alias("action"), F.lit(None).cast("long").alias("reference"), F.lit(rationale.strip()).alias("rationale"), F.lit(reviewer.strip()).alias("reviewer")
    )


def table_as_of(baseline: DataFrame, log: DataFrame, sequence: int) -> DataFrame:
    """The table after the first ``sequence`` log rows."""
    last = log.filter(F.col("sequence") <= sequence).groupBy(SRC, "column").agg(F.max_by("after", "sequence").alias("after"))
    return _overlay(baseline, _per_record(last, F.col("after")))


def edit_states(log: DataFrame) -> DataFrame:
    """Per original edit: active, undone but redoable, or discarded by a later edit."""
    newest = log.filter(F.col("action").isin(*NEW_ACTIONS)).agg(F.max("sequence")).scalar()
    latest = log.groupBy(F.coalesce("reference", "sequence").alias("edit")).agg(F.max_by("action", "sequence").alias("last_action"), F.max("sequence").alias("last_sequence"))
    undone = F.col("last_action").isin(*UNDO_ACTIONS)
    state = F.when(~undone, "active").when(F.col("last_sequence") > newest, "redoable").otherwise("discarded")
    return latest.select("edit", "last_action", "last_sequence", state.alias("state"))


def step_events(log: DataFrame, action: str, rationale: str, reviewer: str, groups: DataFrame | None = None) -> DataFrame:
    """Log rows that undo the newest active edit, or redo the oldest one that can be redone.

    Where that edit lies in one of ``groups(first_sequence, last_sequence)``, whose
    sequences are contiguous, the whole group is one step. A cell that does not hold
    what the step starts from fails the result.
    """
    if action not in ("undo", "redo"):
        raise TableError("a step is an undo or a redo")
    if not rationale.strip():
        raise TableError("an edit needs a rationale")
    states = edit_states(log)
    edge = F.max(F.when(F.col("state") == "active", F.col("edit"))) if action == "undo" else F.min(F.when(F.col("state") == "redoable", F.col("edit")))
    edit = states.agg(edge).first()[0]
    if edit is None:
        raise TableError(f"nothing to {action}")
    group = None if groups is None else groups.filter(F.lit(edit).between(F.col("first_sequence"), F.col("last_sequence"))).first()
    first, last = (edit, edit) if group is None else (group["first_sequence"], group["last_sequence"])
    end = log.agg(F.max("sequence")).first()[0]
    latest = log.groupBy(SRC, "column").agg(F.max_by("after", "sequence").alias("__now"))
    rows = log.filter(F.col("sequence").between(first, last) & F.col("action").isin(*NEW_ACTIONS)).join(latest, [SRC, "column"])
    start, to = ("after", "before") if action == "undo" else ("before", "after")
    held = F.when(F.col("__now") == F.col(start), F.col(start)).otherwise(F.raise_error(F.lit(f"{action} refused: a cell holds another value")))
    return rows.select(
        (F.lit(end + 1 - first) + F.col("sequence")).alias("sequence"), SRC, "column", held.alias("before"), F.col(to).alias("after"),
        F.lit(action if group is None else f"batch-{action}").alias("action"), F.col("sequence").alias("reference"), F.lit(rationale.strip()).alias("rationale"), F.lit(reviewer.strip()).alias("reviewer"),
    )


def chain_breaks(log: DataFrame) -> DataFrame:
    """Log rows whose ``before`` is not the ``after`` of the previous edit of the same cell."""
    with_previous = previous_value(log, [SRC, "column"], "sequence", "after", "previous")
    return with_previous.filter("previous is not null and before <> previous").select("sequence", SRC, "column", "before", "previous")


def first_edit_breaks(baseline: DataFrame, log: DataFrame) -> DataFrame:
    """First edits of a cell that do not start from the baseline value."""
    firsts = log.groupBy(SRC, "column").agg(F.min_by("before", "sequence").alias("before"))
    joined = firsts.join(baseline, SRC, "left")
    current = F.coalesce(*[F.when(F.col("column") == c, F.col(f"`{c}`")) for c in data_columns(baseline)])
    return joined.filter(current.isNull() | (current != F.col("before"))).select(SRC, "column", "before")


def replay_report(baseline: DataFrame, log: DataFrame, working: DataFrame) -> DataFrame:
    """Does the baseline plus the log give the working table exactly?"""
    sequence = log.agg(F.count("*").alias("n"), F.count_distinct("sequence").alias("d"), F.min("sequence").alias("lo"), F.max("sequence").alias("hi"))
    contiguous = sequence.select(((F.col("n") == F.col("d")) & (F.col("hi") - F.col("lo") + 1 == F.col("n")) & (F.col("lo") == 1)) | (F.col("n") == 0)).scalar()
    breaks = chain_breaks(log).agg(F.count("*")).scalar() + first_edit_breaks(baseline, log).agg(F.count("*")).scalar()
    last = log.groupBy(SRC, "column").agg(F.max_by("after", "sequence").alias("after"))
    replayed = _overlay(baseline, _per_record(last, F.col("after")))
    compared = same_rows(replayed, working)
    return compared.select(
        contiguous.alias("contiguous"), breaks.alias("chain_breaks"), "left_only", "right_only", (contiguous & (breaks == 0) & (F.col("left_only") == 0) & (F.col("right_only") == 0)).alias("verified")
    )


def batch_group_findings(groups: DataFrame, log: DataFrame) -> DataFrame:
    """``groups(first_sequence, last_sequence, changed_cells)`` that are not contiguous, overlap or miss log rows."""
    ordered = highest_before(groups, "first_sequence", "last_sequence", "reached")
    batch = log.filter(F.col("action") == "batch-trim").select("sequence")
    # A range join in bounded steps: both sides are cut into ranges of the sequence.
    step = 10_000
    ranges = groups.select("first_sequence", "last_sequence", F.explode(F.sequence(F.floor(F.col("first_sequence") / step), F.floor(F.col("last_sequence") / step))).alias("r"))
    inside = batch.withColumn("r", F.floor(F.col("sequence") / step)).join(ranges, "r").filter(F.col("sequence").between(F.col("first_sequence"), F.col("last_sequence")))
    held = inside.groupBy("first_sequence").agg(F.count("*").alias("held"))
    joined = ordered.join(held, "first_sequence", "left")
    rules = F.array_compact(
        F.array(
            F.when(F.col("last_sequence") - F.col("first_sequence") + 1 != F.col("changed_cells"), F.lit("not contiguous")),
            F.when(F.col("reached") >= F.col("first_sequence"), F.lit("overlaps an earlier group")),
            F.when(F.coalesce("held", F.lit(0)) != F.col("changed_cells"), F.lit("log rows differ")),
        )
    )
    return joined.select("first_sequence", F.explode(rules).alias("rule"))


def batch_group_digests(log: DataFrame, groups: DataFrame) -> DataFrame:
    """Cells and an order-free digest per batch group: hashes are summed, so no group is collected."""
    step = 10_000
    ranges = groups.select("first_sequence", "last_sequence", F.explode(F.sequence(F.floor(F.col("first_sequence") / step), F.floor(F.col("last_sequence") / step))).alias("r"))
    rows = log.withColumn("r", F.floor(F.col("sequence") / step)).join(ranges, "r").filter(F.col("sequence").between(F.col("first_sequence"), F.col("last_sequence")))
    text = F.sha2(F.to_json(F.array(F.col("sequence").cast("string"), F.col(SRC).cast("string"), "column", "before", "after")), 256)
    parts = [F.sum(F.conv(F.substring(text, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(8)]
    return rows.groupBy("first_sequence").agg(F.count("*").alias("cells"), F.sha2(F.concat_ws("-", *parts), 256).alias("digest"))


def metadata_history_findings(history: DataFrame) -> DataFrame:
    """``history(table, sequence, before, after, working_revision)``: broken chains and falling revisions."""
    chained = previous_value(history, ["table"], "sequence", "after", "previous_after")
    chained = previous_value(chained, ["table"], "sequence", "working_revision", "previous_revision")
    rules = F.array_compact(
        F.array(
            F.when(F.col("before") != F.col("previous_after"), F.lit("before differs from previous after")),
            F.when(F.col("before") == F.col("after"), F.lit("nothing changes")),
            F.when(F.col("working_revision") < F.col("previous_revision"), F.lit("revision falls")),
        )
    )
    return chained.select("table", "sequence", F.explode(rules).alias("rule"))


def guard_revision(current: int, expected: int) -> None:
    if current != expected:
        raise TableError("the revision changed since it was read")


