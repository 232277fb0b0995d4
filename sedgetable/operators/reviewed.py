"""Reviewed translations: a derived column with a per-row outcome beside it.

Outcomes are converted, unchanged, unresolved, conflicting and empty. Rows that
cannot be read keep their recorded text, and an unresolved or conflicting input
passes its outcome on.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from sedgetable.core import OUTCOMES, SRC, Field, TableError, require
from sedgetable.functions.coordinates import degrees_or_null, inverse_mercator
from sedgetable.functions.dates import date_hypotheses, reviewed_date, reviewed_datetime
from sedgetable.functions.units import DIMENSION, convert_unit
from sedgetable.operators.transforms import inherits_sensitivity
from sedgetable.scale import salted_join, top_rows

OPEN_OUTCOMES = ("unresolved", "conflicting")


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _fresh(df: DataFrame, names: Sequence[str]) -> None:
    if any(not n.strip() or n in df.columns for n in names):
        raise TableError(f"derived names are blank or taken: {list(names)}")


def outcome_name(name: str) -> str:
    return f"{name}__review"


def _upstream(df: DataFrame, outcome: str | None) -> Column:
    """Outcome inherited from the input column, or null."""
    if outcome is None:
        return F.lit(None).cast("string")
    require(df, [outcome])
    if df.filter(~_col(outcome).isin(*OUTCOMES)).limit(1).count():
        raise TableError(f"{outcome} holds something other than an outcome")
    return F.when(_col(outcome).isin(*OPEN_OUTCOMES), _col(outcome))


def _translate(df: DataFrame, column: str, name: str, read: Column, upstream: str | None = None, blocked: Column | None = None) -> DataFrame:
    """Attach ``read`` with its outcome. A null reading is unresolved and keeps the recorded text."""
    require(df, [column])
    _fresh(df, [name, outcome_name(name)])
    before, inherited = _col(column), _upstream(df, upstream)
    refused = F.lit(False) if blocked is None else F.coalesce(blocked, F.lit(False))
    out = df.withColumns({"__read": read, "__inherited": inherited, "__refused": refused})
    state = (
        F.when(before == "", "empty")
        .when(F.col("__inherited").isNotNull(), F.col("__inherited"))
        .when(F.col("__refused") | F.col("__read").isNull(), "unresolved")
        .when(F.col("__read") != before, "converted")
        .otherwise("unchanged")
    )
    settled = F.when(_col(outcome_name(name)) == "converted", F.col("__read")).otherwise(before)
    return out.withColumn(outcome_name(name), state).select(*[_col(c) for c in df.columns], settled.alias(name), _col(outcome_name(name)))


def review_dates(df: DataFrame, column: str, name: str, fmt: str, century: int | None = None, upstream: str | None = None) -> DataFrame:
    return _translate(df, column, name, reviewed_date(_col(column), fmt, century), upstream)


def unresolved_date_hypotheses(df: DataFrame, column: str, name: str) -> DataFrame:
    """Calendar readings of the values a date review left unresolved."""
    rows = df.filter(_col(outcome_name(name)) == "unresolved").select(SRC, _col(column).alias("value"))
    return rows.select(SRC, "value", F.explode(date_hypotheses(F.col("value"))).alias("h")).select(SRC, "value", "h.*")


def review_datetimes(
    df: DataFrame,
    column: str,
    name: str,
    fmt: str,
    time_column: str | None = None,
    century: int | None = None,
    assumed_offset: str = "",
    upstream: str | None = None,
    time_upstream: str | None = None,
) -> DataFrame:
    """Date-time with an explicit offset; nothing is moved to another zone."""
    if time_column is not None:
        require(df, [time_column])
        if time_column == column or fmt == "ISO-datetime":
            raise TableError("a separate time column goes with a date column")
    clock = None if time_column is None else F.when(_col(time_column) != "", _col(time_column))
    blocked = _upstream(df, time_upstream).isNotNull() if time_upstream else None
    return _translate(df, column, name, reviewed_datetime(_col(column), fmt, clock, century, assumed_offset), upstream, blocked)


def review_units(df: DataFrame, column: str, name: str, target: str, source: str | None = None, unit_column: str | None = None, upstream: str | None = None) -> DataFrame:
    """Convert to ``target`` from one reviewed unit or from the unit recorded per row."""
    if target not in DIMENSION or (unit_column is None and source not in DIMENSION):
        raise TableError("choose reviewed units of one dimension")
    if unit_column is not None:
        require(df, [unit_column])
    unit = _col(unit_column) if unit_column is not None else F.lit(source)
    return _translate(df, column, name, convert_unit(_col(column), unit, target), upstream)


def codebook_entries(codebook: DataFrame, code: str, meaning: str) -> DataFrame:
    """Per code: number of distinct meanings and the meaning when there is one."""
    require(codebook, [code, meaning])
    pairs = codebook.select(_col(code).alias("__code"), _col(meaning).alias("m")).filter("__code <> '' and m <> ''")
    return pairs.groupBy("__code").agg(F.min("m").alias("__low"), F.max("m").alias("__high"))


def review_codes(df: DataFrame, column: str, name: str, codebook: DataFrame, code: str, meaning: str, upstream: str | None = None) -> DataFrame:
    """Codebook lookup: no meaning is unresolved, several meanings are conflicting."""
    require(df, [column])
    _fresh(df, [name, outcome_name(name)])
    inherited = _upstream(df, upstream)
    entries = codebook_entries(codebook, code, meaning)
    joined = salted_join(df.withColumn("__code", _col(column)).withColumn("__inherited", inherited), entries, ["__code"])
    before = _col(column)
    state = (
        F.when(before == "", "empty")
        .when(F.col("__inherited").isNotNull(), F.col("__inherited"))
        .when(F.col("__low").isNull(), "unresolved")
        .when(F.col("__low") != F.col("__high"), "conflicting")
        .when(F.col("__low") != before, "converted")
        .otherwise("unchanged")
    )
    value = F.when(state == "converted", F.col("__low")).otherwise(before)
    return joined.select(*[_col(c) for c in df.columns], value.alias(name), state.alias(outcome_name(name)))


def review_missing(df: DataFrame, column: str, name: str, tokens: Sequence[str], upstream: str | None = None) -> DataFrame:
    if not tokens or any(not t for t in tokens):
        raise TableError("list the reviewed missing-value tokens")
    return _translate(df, column, name, F.when(_col(column).isin(*tokens), "").otherwise(_col(column)), upstream)


def review_coordinates(df: DataFrame, column: str, name: str, axis: str, datum: str, upstream: str | None = None) -> DataFrame:
    if not datum.strip():
        raise TableError("name the datum of the coordinates")
    return _translate(df, column, name, degrees_or_null(_col(column), axis), upstream)


def _taxon_candidates(reference: DataFrame, recorded: str, target: str, identifier: str | None) -> DataFrame:
    ident = _col(identifier) if identifier else F.lit("")
    return reference.select(_col(recorded).alias("__recorded"), _col(target).alias("taxon"), ident.alias("taxon_id"), F.col(SRC)).filter("__recorded <> ''")


def review_taxonomy(df: DataFrame, column: str, name: str, reference: DataFrame, recorded: str, target: str, identifier: str | None = None, upstream: str | None = None) -> DataFrame:
    """Literal name lookup in a reviewed reference table; adds name, identifier and outcome."""
    require(df, [column])
    require(reference, [c for c in (recorded, target, identifier) if c])
    id_name = f"{name}__taxon_id"
    _fresh(df, [name, id_name, outcome_name(name)])
    pair = F.struct("taxon", "taxon_id")
    per_name = _taxon_candidates(reference, recorded, target, identifier).groupBy("__recorded").agg(F.min(pair).alias("__low"), F.max(pair).alias("__high"))
    joined = salted_join(df.withColumn("__recorded", _col(column)).withColumn("__inherited", _upstream(df, upstream)), per_name, ["__recorded"])
    before, taxon, taxon_id = _col(column), F.col("__low.taxon"), F.col("__low.taxon_id")
    incomplete = (taxon == "") | (taxon_id == "") if identifier else taxon == ""
    state = (
        F.when(before == "", "empty")
        .when(F.col("__inherited").isNotNull(), F.col("__inherited"))
        .when(F.col("__low").isNull(), "unresolved")
        .when(F.col("__low") != F.col("__high"), "conflicting")
        .when(incomplete, "unresolved")
        .when((taxon != before) | (taxon_id != ""), "converted")
        .otherwise("unchanged")
    )
    settled = state == "converted"
    return joined.select(
        *[_col(c) for c in df.columns],
        F.when(settled, taxon).otherwise(before).alias(name),
        F.when(settled, taxon_id).otherwise("").alias(id_name),
        state.alias(outcome_name(name)),
    )


def taxonomy_candidates(reference: DataFrame, recorded: str, target: str, identifier: str | None = None, k: int = 5) -> DataFrame:
    """First ``k`` distinct candidates per recorded name, with how many reference rows give each."""
    pairs = _taxon_candidates(reference, recorded, target, identifier).groupBy(F.col("__recorded").alias("recorded"), "taxon", "taxon_id")
    counted = pairs.agg(F.count("*").alias("reference_records"), F.min(SRC).alias("first_record"))
    return top_rows(counted, ["recorded"], [F.asc("first_record")], k).select("recorded", "rank", "taxon", "taxon_id", "reference_records")


def review_coordinate_pair(df: DataFrame, easting: str, northing: str, name: str, source_crs: str, upstream: Sequence[str | None] = (None, None)) -> DataFrame:
    """Projected metres to degrees for a reviewed EPSG:3857 pair; an unknown system resolves nothing."""
    if source_crs not in ("unknown", "EPSG:3857"):
        raise TableError("the source system is unknown or EPSG:3857")
    require(df, [easting, northing])
    lat_name, lon_name, state_name = f"{name}_latitude", f"{name}_longitude", outcome_name(name)
    _fresh(df, [lat_name, lon_name, state_name])
    x, y = _col(easting), _col(northing)
    first, second = (_upstream(df, u) for u in upstream)
    inherited = F.when((first == "conflicting") | (second == "conflicting"), "conflicting").when(first.isNotNull() | second.isNotNull(), "unresolved")
    latitude, longitude = inverse_mercator(x, y)
    readable = latitude.isNotNull() & longitude.isNotNull() if source_crs == "EPSG:3857" else F.lit(False)
    state = F.when((x == "") & (y == ""), "empty").when(inherited.isNotNull(), inherited).when(readable, "converted").otherwise("unresolved")
    out = df.withColumn(state_name, state)
    ok = _col(state_name) == "converted"
    return out.withColumn(lat_name, F.when(ok, latitude).otherwise("")).withColumn(lon_name, F.when(ok, longitude).otherwise("")).select(*df.columns, lat_name, lon_name, state_name)


def outcome_coverage(df: DataFrame, name: str) -> DataFrame:
    """Rows per outcome; every outcome is listed."""
    state = _col(outcome_name(name))
    counts = df.agg(*[F.count_if(state == o).alias(o) for o in OUTCOMES])
    return counts.unpivot([], list(OUTCOMES), "outcome", "rows")


def coverage_status(df: DataFrame, name: str) -> DataFrame:
    """Inferred while any row is unresolved or conflicting, else Confirmed."""
    open_rows = F.count_if(_col(outcome_name(name)).isin(*OPEN_OUTCOMES))
    return df.agg(open_rows.alias("open_rows")).select("open_rows", F.when(F.col("open_rows") > 0, "Inferred").otherwise("Confirmed").alias("status"))


def reviewed_field(fields: Sequence[Field], name: str, operation: str, sources: Sequence[str], status: str, reviewer: str, reason: str, **extra) -> list[Field]:
    """Dictionary rows of a reviewed translation: the derived field and its outcome field."""
    if not reviewer.strip() or not reason.strip():
        raise TableError("a review names its reviewer and reason")
    derived = Field(
        name,
        name,
        description=f"{operation} of {sources[0]} under a review",
        status=status,
        rationale=reason,
        reviewer=reviewer,
        operation=operation,
        source_fields=list(sources),
        outcome_field=outcome_name(name),
        sensitive=inherits_sensitivity(fields, sources) or operation in ("coordinate", "coordinate-pair"),
        **extra,
    )
    outcome = Field(outcome_name(name), outcome_name(name), description="How each record's value was arrived at, or why it was not.", status="Confirmed", allowed=list(OUTCOMES), rationale=reason)
    return [*fields, derived, outcome]


def inherited_sensitivity(dictionary: DataFrame, lineage: DataFrame) -> DataFrame:
    """Sensitivity along one derivation step for many tables. ``lineage(table, derived, source)``"""
    from sedgetable.operators.findings import PLACE_NAME, PLACE_TERMS

    flagged = F.col("sensitive") | F.col("term").isin(*PLACE_TERMS) | F.col("name").rlike(PLACE_NAME)
    sources = dictionary.select("table", F.col("name").alias("source"), flagged.alias("flag"))
    found = lineage.join(sources, ["table", "source"], "left")
    return found.groupBy("table", "derived").agg(F.coalesce(F.max("flag"), F.lit(False)).alias("sensitive"))


def review_meanings(dictionary: DataFrame, changes: DataFrame) -> DataFrame:
    """Confirm field meanings: ``changes(table, name, description, unit, term, reviewer, rationale)``.

    Changes without a description or reviewer are left out; values are untouched.
    """
    usable = changes.filter("trim(description) <> '' and trim(reviewer) <> ''").select("table", "name", *[F.col(c).alias(f"__{c}") for c in ("description", "unit", "term", "reviewer", "rationale")])
    joined = dictionary.join(usable, ["table", "name"], "left")
    hit = F.col("__description").isNotNull()
    updated = {c: F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)) for c in ("description", "unit", "term", "reviewer", "rationale")}
    updated["status"] = F.when(hit, "Confirmed").otherwise(F.col("status"))
    return joined.withColumns(updated).select(*dictionary.columns)


def confirm_field(fields: Sequence[Field], name: str, description: str, reviewer: str, reason: str, unit: str = "", term: str = "") -> list[Field]:
    if not description.strip() or not reviewer.strip():
        raise TableError("a confirmed meaning has a description and a reviewer")
    return [replace(f, description=description.strip(), unit=unit, term=term, status="Confirmed", rationale=reason, reviewer=reviewer) if f.name == name else f for f in fields]
