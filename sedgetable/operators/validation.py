"""Checks against declared table schemas.

A schema is a plain dict: ``fields`` (name, type, format, constraints),
``missingValues``, ``primaryKey`` and ``foreignKeys``. All value checks of a
table run in one scan; key checks are aggregates and anti joins.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sedgetable.core import DATA_TYPES, SRC, STATUSES, WIDTH, Field, TableError, explode_marks, require, unpivot_cells
from sedgetable.functions.dates import is_iso_day, iso_or_null
from sedgetable.functions.numbers import DECIMAL, INTEGER, record_number_or_null
from sedgetable.functions.text import RECORD_SPACE, bind, is_blank
from sedgetable.scale import non_first, salted_join

# Accepted texts of declared types and of absolute term addresses.
TRUE_VALUES = ("true", "True", "TRUE", "1")
FALSE_VALUES = ("false", "False", "FALSE", "0")
TERM_ADDRESS = r"^https?://[^\s]+\z"
START_END = (("deploymentStart", "deploymentEnd"), ("eventStart", "eventEnd"))
# What the directives of date-time formats stand for.
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
_DIRECTIVES = {
    "Y": "([0-9]{4})",
    "y": "([0-9]{2})",
    "m": "([0-9]{1,2})",
    "b": "((?i:" + "|".join(m[:3] for m in _MONTHS) + "))",
    "B": "((?i:" + "|".join(_MONTHS) + "))",
    "d": "([0-9]{1,2})",
    "j": "([0-9]{1,3})",
    "a": "((?i:" + "|".join(d[:3] for d in _DAYS) + "))",
    "A": "((?i:" + "|".join(_DAYS) + "))",
    "H": "([0-9]{1,2})",
    "I": "([0-9]{1,2})",
    "p": "((?i:am|pm))",
    "M": "([0-9]{1,2})",
    "S": "([0-9]{1,2})",
    "f": "([0-9]{1,6})",
    "z": "(Z|[+-][0-9]{2}:?[0-9]{2})",
}
_PARTS = {"Y": "year", "m": "month", "d": "day", "H": "hour", "M": "minute", "S": "second", "f": "fraction", "z": "zone"}
_ISO_MOMENT = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})(?:[T ]([0-9]{2})(?::([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]{1,9}))?)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?\z"


def moment(c: Column, fmt: str | None = None) -> Column:
    """Struct (zoned, at) of a date-time text, or null when it does not follow the format.

    A two-digit year from 69 on belongs to the 1900s. Names of weekdays are read
    and not compared with the day.
    """
    if fmt and fmt != "default":
        pattern, groups = "^", {}
        for literal, directive in re.findall(r"([^%]*)(?:%(.))?", fmt):
            pattern += re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", literal)
            if directive == "%":
                pattern += "%"
            elif directive:
                if directive not in _DIRECTIVES or directive in groups:
                    raise TableError(f"date-time format {fmt!r}: %{directive} is unknown or repeated")
                groups[directive] = len(groups) + 1
                pattern += _DIRECTIVES[directive]
        pattern += r"\z"
    else:
        pattern, groups = _ISO_MOMENT, {d: i for i, d in enumerate("YmdHMSfz", 1)}
    part = lambda d: F.regexp_extract(c, pattern, groups[d]) if d in groups else F.lit("")
    texts = {name: part(d) for d, name in _PARTS.items()}
    if "y" in groups:
        texts["year"] = (part("y").cast("int") + F.when(part("y") >= "69", 1900).otherwise(2000)).cast("string")
    if "b" in groups or "B" in groups:
        short = F.lower(F.substring(part("b" if "b" in groups else "B"), 1, 3))
        texts["month"] = ((F.instr(F.lit("".join(m[:3] for m in _MONTHS)), short) + 2) / 3).cast("int").cast("string")
    if "I" in groups:
        half = F.when(F.lower(part("p")) == "pm", 12).otherwise(0)
        texts["hour"] = F.when(part("I").cast("int").between(1, 12), part("I").cast("int") % 12 + half).otherwise(99).cast("string")
    parts = F.struct(*[text.alias(name) for name, text in texts.items()], part("j").alias("yearday"))

    def read(p: Column) -> Column:
        number = lambda name, default: F.coalesce(p[name].try_cast("int"), F.lit(default))
        hour, minute, second, offset = number("hour", 0), number("minute", 0), number("second", 0), p["zone"]
        day = iso_or_null(number("year", 1900), number("month", 1), number("day", 1))
        if "j" in groups:
            counted = F.date_add(F.make_date(number("year", 1900), F.lit(1), F.lit(1)), number("yearday", 0) - 1)
            day = F.when(F.year(counted) == number("year", 1900), counted.cast("string"))
        shift = F.when(offset.isin("", "Z"), F.lit(0)).otherwise(
            F.when(offset.startswith("-"), -1).otherwise(1) * (F.substring(offset, 2, 2).try_cast("int") * 60 + F.substring(offset, -2, 2).try_cast("int"))
        )
        seconds = lambda d: F.unix_date(d.try_cast("date")) * F.lit(86400).cast("long") + hour * 3600 + minute * 60 + second - shift * 60
        fraction = F.coalesce(F.rpad(p["fraction"], 6, "0").try_cast("long"), F.lit(0))
        in_range = (hour < 24) & (minute < 60) & (second < 60)
        whole = lambda d: F.when(d.isNotNull() & in_range, F.struct((offset != "").alias("zoned"), (seconds(d) * 1000000 + fraction).alias("at")))
        return bind(day, whole)

    return F.when(c.rlike(pattern), bind(parts, read))


def _typed_ok(c: Column, field: Mapping) -> Column:
    kind = field.get("type", "string")
    if kind in ("string", "any"):
        return F.lit(True)
    if kind == "integer":
        return c.rlike(INTEGER)
    if kind == "number":
        return c.rlike(DECIMAL) & (F.abs(c.try_cast("double")) < F.lit(float("inf")))
    if kind == "boolean":
        return c.isin(*field.get("trueValues", TRUE_VALUES), *field.get("falseValues", FALSE_VALUES))
    if kind == "datetime":
        return moment(c, field.get("format")).isNotNull()
    return F.lit(False)


def _in_enum(c: Column, field: Mapping, enum: Sequence) -> Column:
    kind = field.get("type", "string")
    if kind in ("integer", "number"):
        return c.try_cast("double").isin(*[float(e) for e in enum])
    if kind == "boolean":
        truth = c.isin(*field.get("trueValues", TRUE_VALUES))
        return reduce(lambda a, b: a | b, [truth if e else ~truth for e in enum], F.lit(False))
    return c.isin(*enum)


def value_findings(df: DataFrame, schema: Mapping) -> DataFrame:
    """Required, type, vocabulary, pattern, range and length findings in one scan."""
    fields = [f for f in schema["fields"] if f["name"] in df.columns]
    missing_values = schema.get("missingValues", [""])
    v, column = F.col("value"), F.col("column")
    missing = v.isin(*missing_values)
    tests: dict[str, Column] = {}

    def add(rule: str, field: Mapping, test: Column) -> None:
        tests[rule] = tests.get(rule, F.lit(False)) | ((column == field["name"]) & test)

    for field in fields:
        limits = field.get("constraints", {})
        ok = F.coalesce(_typed_ok(v, field), F.lit(False))
        if limits.get("required"):
            add("required", field, missing)
        if field.get("type", "string") not in ("string", "any"):
            add("type", field, ~missing & ~ok)
        usable = ~missing & ok
        if "enum" in limits:
            add("vocabulary", field, usable & ~F.coalesce(_in_enum(v, field, limits["enum"]), F.lit(False)))
        if "pattern" in limits:
            add("pattern", field, usable & ~v.rlike(limits["pattern"]))
        if field.get("type") in ("integer", "number"):
            number = v.try_cast("double")
            if "minimum" in limits:
                add("minimum", field, usable & (number < float(limits["minimum"])))
            if "maximum" in limits:
                add("maximum", field, usable & (number > float(limits["maximum"])))
        if "minLength" in limits:
            add("minLength", field, usable & (F.length(v) < limits["minLength"]))
        if "maxLength" in limits:
            add("maxLength", field, usable & (F.length(v) > limits["maxLength"]))
    cells = unpivot_cells(df, [f["name"] for f in fields])
    if not tests:
        return cells.select(F.lit("").alias("rule"), "column", SRC, "value").filter(F.lit(False))
    hits = explode_marks(cells, ["column", SRC, "value"], list(tests.values()))
    return hits.select(F.get(F.array(*[F.lit(r) for r in tests]), F.col("mark")).alias("rule"), "column", SRC, "value")


def width_findings(df: DataFrame, expected: int) -> DataFrame:
    return df.filter(F.col(WIDTH) != expected).select(F.lit("width").alias("rule"), F.col(SRC), F.col(WIDTH).cast("string").alias("value"))


def layout_findings(headers: DataFrame, declared: DataFrame) -> DataFrame:
    """Absent fields, order differences and repeated tables.

    ``headers(resource, table, position, name)`` are found headers of many files,
    ``declared(table, position, name)`` the schemas.
    """
    # A header travels as one row with its names, and a schema as one row with its fields.
    resources = headers.groupBy("resource", "table").agg(F.collect_list(F.struct("name", "position")).alias("found"))
    schemas = declared.groupBy("table").agg(F.collect_list(F.struct("name", "position")).alias("fields"))
    repeated = resources.groupBy("table").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("repeated table").alias("rule"), F.lit("").alias("resource"), "table", F.lit("").alias("name"))
    absent_table = declared.select("table").distinct().join(resources.select("table").distinct(), "table", "left_anti").select(F.lit("absent table").alias("rule"), F.lit("").alias("resource"), "table", F.lit("").alias("name"))
    wanted = salted_join(resources, schemas, ["table"], "inner", ["resource"]).select("resource", "table", "found", F.explode("fields").alias("field"))
    same = F.filter("found", lambda x: x["name"] == F.col("field.name"))
    matched = wanted.select("resource", "table", "field.name", "field.position", F.explode_outer(same).alias("hit"))
    rule = F.when(F.col("hit").isNull(), "absent field").when(F.col("hit.position") != F.col("position"), "field order")
    fields = matched.select(rule.alias("rule"), "resource", "table", "name").filter("rule is not null")
    return fields.unionByName(repeated).unionByName(absent_table)


def unique_findings(df: DataFrame, schema: Mapping) -> DataFrame:
    """Non-first repeats in fields declared unique; missing and mistyped values are skipped."""
    fields = [f for f in schema["fields"] if f.get("constraints", {}).get("unique") and f["name"] in df.columns]
    if not fields:
        return df.limit(0).select(F.lit("unique").alias("rule"), F.lit("").alias("column"), SRC, F.lit("").alias("value"))
    cells = unpivot_cells(df, [f["name"] for f in fields]).filter(~F.col("value").isin(*schema.get("missingValues", [""])))
    ok = reduce(lambda a, b: a | b, [(F.col("column") == f["name"]) & F.coalesce(_typed_ok(F.col("value"), f), F.lit(False)) for f in fields])
    return non_first(cells.filter(ok), ["column", "value"]).select(F.lit("unique").alias("rule"), "column", SRC, "value")


def temporal_findings(df: DataFrame, schema: Mapping, pairs: Sequence[tuple[str, str]] = START_END) -> DataFrame:
    """Warnings where a start is after its end; texts that cannot be compared are skipped."""
    formats = {f["name"]: f.get("format") for f in schema["fields"]}
    branches = []
    for start, end in pairs:
        if start in df.columns and end in df.columns:
            a, b = moment(F.col(f"`{start}`"), formats.get(start)), moment(F.col(f"`{end}`"), formats.get(end))
            late = (a.getField("zoned") == b.getField("zoned")) & (a.getField("at") > b.getField("at"))
            branches.append(F.when(late, F.lit(f"{start} after {end}")))
    rules = F.array_compact(F.array(*branches)).cast("array<string>")
    return df.select(SRC, F.explode(rules).alias("rule")).select("rule", SRC)


def resource_findings(declared: DataFrame, found: DataFrame) -> DataFrame:
    """Findings on ``declared(file, bytes, hash)`` against a file manifest; nulls declare nothing.

    A hash may name its algorithm before a colon. Only SHA-256 can be compared; any
    other one is a warning.
    """
    f = found.select("file", F.col("bytes").alias("__bytes"), F.col("sha256").alias("__sha"))
    algorithm = F.when(F.contains("hash", F.lit(":")), F.lower(F.substring_index("hash", ":", 1))).otherwise("md5")
    value = F.lower(F.substring_index("hash", ":", -1))
    other = ~algorithm.isin("sha256", "sha-256")
    rules = F.array(
        F.when(F.col("__sha").isNull(), "absent resource"),
        F.when(F.col("bytes") != F.col("__bytes"), "byte length differs"),
        F.when(F.col("hash").isNotNull() & other, "checksum not supported"),
        F.when(~other & (value != F.col("__sha")), "hash differs"),
    )
    return declared.join(f, "file", "left").select(F.explode(F.array_compact(rules)).alias("rule"), "file")


def foreign_key_orphans(df: DataFrame, parent: DataFrame, column: str, parent_column: str) -> DataFrame:
    """Nonempty references without a parent record."""
    require(df, [column])
    require(parent, [parent_column])
    child = df.select(SRC, F.col(f"`{column}`").alias("value")).filter("value <> ''")
    known = parent.select(F.col(f"`{parent_column}`").alias("value")).distinct()
    return salted_join(child, known, ["value"], "left_anti").select(F.lit("foreign key").alias("rule"), SRC, "value")


def _any_missing(names: Sequence[str], missing: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(n).isin(*missing) for n in names])


def declared_key_findings(tables: Mapping[str, DataFrame], schemas: Mapping[str, Mapping]) -> DataFrame:
    """Primary keys that are missing or repeated, wrong key targets and orphan references of a package."""
    parts = []
    aslist = lambda k: [k] if isinstance(k, str) else list(k or [])
    for name, df in tables.items():
        schema = schemas[name]
        missing = schema.get("missingValues", [""])
        keys = aslist(schema.get("primaryKey"))
        spark = df.sparkSession
        if any(k not in df.columns for k in keys):
            parts.append(spark.createDataFrame([("primary key absent", name, None)], f"rule string, table string, {SRC} long"))
            continue
        if keys:
            named = df.select(SRC, *[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)])
            ids = [f"k{i}" for i in range(len(keys))]
            none = _any_missing(ids, missing)
            parts.append(named.filter(none).select(F.lit("primary key missing").alias("rule"), F.lit(name).alias("table"), SRC))
            parts.append(non_first(named.filter(~none), ids).select(F.lit("primary key repeated").alias("rule"), F.lit(name).alias("table"), SRC))
        for fk in schema.get("foreignKeys", []):
            local, target = aslist(fk["fields"]), fk["reference"].get("resource") or name
            remote = aslist(fk["reference"]["fields"])
            usable = local and len(local) == len(remote) and all(k in df.columns for k in local) and target in tables
            if not usable or aslist(schemas[target].get("primaryKey")) != remote:
                parts.append(spark.createDataFrame([("foreign key target", name, None)], f"rule string, table string, {SRC} long"))
                continue
            ids = [f"k{i}" for i in range(len(local))]
            child = df.select(SRC, *[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(local)])
            parent = tables[target].select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(remote)]).distinct()
            orphan = salted_join(child.filter(~_any_missing(ids, missing)), parent, ids, "left_anti")
            parts.append(orphan.select(F.lit("foreign key orphan").alias("rule"), F.lit(name).alias("table"), SRC))
    return reduce(DataFrame.unionByName, parts)


def descriptor_findings(descriptors: DataFrame) -> DataFrame:
    """``descriptors(table, name, title, description, type, term)``: incomplete fields and repeated names."""
    rules = [F.when(F.coalesce(is_blank(F.col(c)), F.lit(True)), F.lit(f"field needs {c}")) for c in ("name", "title", "description", "type")]
    rules.append(F.when(~F.coalesce(F.col("term").rlike(TERM_ADDRESS), F.lit(False)), F.lit("field needs a term address")))
    one = descriptors.select("table", "name", F.explode(F.array_compact(F.array(*rules))).alias("rule"))
    repeated = descriptors.groupBy("table", "name").agg(F.count("*").alias("n")).filter("n > 1").select("table", "name", F.lit("repeated field name").alias("rule"))
    return one.unionByName(repeated)


def reference_schema_findings(descriptors: DataFrame, reference: DataFrame) -> DataFrame:
    """Compare field descriptors with a chosen reference: unknown, differing and absent required fields.

    Both hold ``(table, name, title, description, type, term)``; the reference adds ``required``.
    """
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "description", "type", "term")]
    ours = descriptors.select("table", "name", F.struct(*[p.alias(f"d{i}") for i, p in enumerate(parts)]).alias("ours"))
    theirs = reference.select("table", "name", "required", F.struct(*[p.alias(f"d{i}") for i, p in enumerate(parts)]).alias("theirs"))
    both = ours.join(theirs, ["table", "name"], "full")
    known = descriptors.select("table").distinct().withColumn("present", F.lit(True))
    rule = (
        F.when(F.col("theirs").isNull(), "unknown field")
        .when(F.col("ours").isNull(), F.when(F.col("required") & F.col("present"), "required field absent"))
        .when(F.col("ours") != F.col("theirs"), "descriptor differs")
    )
    return both.join(known, "table", "left").select(rule.alias("rule"), "table", "name").filter("rule is not null")


def undeclared_keys(declared: DataFrame, reference: DataFrame) -> DataFrame:
    """``(table, kind, key)`` key declarations that the reference schema does not make."""
    return declared.join(reference.select("table", "kind", "key").distinct(), ["table", "kind", "key"], "left_anti")


def star_findings(core: DataFrame, core_id: str, extensions: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Blank or repeated core identifiers and extension rows without an exact core match."""
    none = lambda df, key: df.select(SRC, F.col(f"`{key}`").alias("id"))
    c = none(core, core_id)
    blank = is_blank(F.col("id"), RECORD_SPACE)
    out = c.filter(blank).select(F.lit("core").alias("table"), F.lit("blank identifier").alias("rule"), SRC)
    out = out.unionByName(non_first(c, ["id"]).select(F.lit("core").alias("table"), F.lit("repeated identifier").alias("rule"), SRC))
    ids = c.select("id").distinct()
    for name, (df, key) in extensions.items():
        e = none(df, key)
        out = out.unionByName(e.filter(blank).select(F.lit(name).alias("table"), F.lit("blank core link").alias("rule"), SRC))
        lost = salted_join(e.filter(~blank), ids, ["id"], "left_anti")
        out = out.unionByName(lost.select(F.lit(name).alias("table"), F.lit("unmatched core link").alias("rule"), SRC))
    return out


def dictionary_fit(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """One error per column whose nonempty values do not all fit its declared type or vocabulary."""
    aggregates = []
    for f in fields:
        c = F.col(f"`{f.name}`")
        fits = {
            "string": F.lit(True),
            "integer": c.rlike(INTEGER),
            "number": record_number_or_null(c).isNotNull(),
            "boolean": F.lower(c).isin("true", "false"),
            "date": is_iso_day(c) & (F.substring(c, 1, 4) != "0000"),
        }.get(f.data_type)
        bad_type = F.lit(True) if fits is None else F.coalesce(F.max((c != "") & ~fits), F.lit(False))
        bad_word = F.coalesce(F.max((c != "") & ~c.isin(*f.allowed)), F.lit(False)) if f.allowed else F.lit(False)
        aggregates.append(F.struct(F.lit(f.name).alias("column"), F.lit(f.data_type).alias("data_type"), bad_type.alias("type_mismatch"), bad_word.alias("unexpected_category")))
    verdicts = df.agg(F.array(*aggregates).alias("v")).select(F.explode("v").alias("v")).select("v.*")
    return verdicts.filter("type_mismatch or unexpected_category")


def dictionary_change_findings(dictionary: DataFrame, changes: DataFrame) -> DataFrame:
    """Refused changes. ``changes(table, name, description, unit, data_type, status, reviewer)``"""
    now = dictionary.select("table", "name", *[F.col(c).alias(f"old_{c}") for c in ("description", "unit", "data_type", "status")])
    joined = changes.join(now, ["table", "name"], "left")
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"old_{c}") for c in ("description", "unit", "data_type", "status")])
    rules = F.array_compact(
        F.array(
            F.when(F.col("old_status").isNull(), F.lit("unknown field")),
            F.when(~F.col("status").isin(*STATUSES), F.lit("unknown status")),
            F.when(~F.col("data_type").isin(*DATA_TYPES), F.lit("unknown type")),
            F.when((F.col("status") == "Confirmed") & is_blank(F.col("reviewer")), F.lit("confirmed without reviewer")),
            F.when((F.col("status") == "Confirmed") & is_blank(F.col("description")), F.lit("confirmed without description")),
            F.when(F.coalesce(same, F.lit(False)), F.lit("nothing changes")),
        )
    )
    return joined.select("table", "name", F.explode(rules).alias("rule"))


def validation_summary(findings: DataFrame, records: DataFrame) -> DataFrame:
    """Severity counts with the records checked and whether no error was found."""
    errors = F.count_if(F.col("severity") == "Error")
    counted = findings.agg(errors.alias("errors"), F.count_if(F.col("severity") == "Warning").alias("warnings"), F.count_if(F.col("severity") == "Information").alias("notes"))
    checked = records.agg(F.count("*")).scalar()
    return counted.select("errors", "warnings", "notes", checked.alias("records_checked"), (F.col("errors") == 0).alias("passed"))


