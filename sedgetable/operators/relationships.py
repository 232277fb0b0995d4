"""Literal keys and links. Keys are compared exactly; duplicates are reported, not resolved."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sedgetable.core import SRC, TableError, data_columns, require, unpivot_cells
from sedgetable.functions.text import folded_name
from sedgetable.operators.equality import same_rows
from sedgetable.scale import bounded_broadcast, key_groups, non_first, salted_join, top_rows

PREVIEW_LENGTH = 500


def _key_pairs(child: DataFrame, parent: DataFrame, child_keys: Sequence[str], parent_keys: Sequence[str]) -> list[str]:
    for df, keys in ((child, child_keys), (parent, parent_keys)):
        if not 1 <= len(keys) <= 5 or len(set(keys)) != len(keys):
            raise TableError("a key has one to five distinct columns")
        require(df, keys)
    if len(child_keys) != len(parent_keys):
        raise TableError("both sides need the same number of key columns")
    return [f"__k{i}" for i in range(len(child_keys))]


def _with_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select("*", *[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)])


def any_empty(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(f"`{k}`") == "" for k in keys])


def key_index(parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per complete key: occurrences and, when it occurs once, its record."""
    require(parent, keys)
    groups = key_groups(parent.filter(~any_empty(keys)), keys)
    return groups.select(*[F.col(f"`{k}`") for k in keys], F.col("__n").alias("occurrences"), F.when(F.col("__n") == 1, F.col("__first")).alias("sole_record"))


def key_index_counts(parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Records, missing keys, duplicated keys and the records that carry them."""
    require(parent, keys)
    groups = parent.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count("*").alias("n"))
    missing = any_empty(keys)
    repeated = ~missing & (F.col("n") > 1)
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("parent_records"),
        F.coalesce(F.sum(F.when(missing, F.col("n"))), F.lit(0)).alias("missing_parent_keys"),
        F.count_if(repeated).alias("duplicate_parent_keys"),
        F.coalesce(F.sum(F.when(repeated, F.col("n"))), F.lit(0)).alias("duplicate_parent_records"),
    )


def _status(keys: Sequence[str]) -> Column:
    return F.when(any_empty(keys), "missing").when(F.col("occurrences").isNull(), "unmatched").when(F.col("occurrences") != 1, "conflicting").otherwise("linked")


def link_status(child: DataFrame, parent: DataFrame, child_keys: Sequence[str], parent_keys: Sequence[str]) -> DataFrame:
    """Per child record: outcome and the record of its unique parent."""
    names = _key_pairs(child, parent, child_keys, parent_keys)
    index = key_index(_with_keys(parent, parent_keys), names)
    keyed = _with_keys(child, child_keys).select(SRC, *names)
    joined = salted_join(keyed, index, names)
    parent_record = F.when(F.col("__link_status") == "linked", F.col("sole_record"))
    return joined.withColumn("__link_status", _status(names)).select(SRC, *names, "__link_status", parent_record.alias("__parent_source_record"))


def link_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("__link_status").agg(F.count("*").alias("records"))


def link_counts_by_key(child: DataFrame, parent: DataFrame, child_keys: Sequence[str], parent_keys: Sequence[str]) -> DataFrame:
    """Outcome counts alone: both sides shrink to one row per key first, so heavy keys cost one row."""
    names = _key_pairs(child, parent, child_keys, parent_keys)
    index = key_index(_with_keys(parent, parent_keys), names)
    groups = _with_keys(child, child_keys).groupBy(*names).agg(F.count("*").alias("n"))
    joined = groups.join(index, names, "left").withColumn("__link_status", _status(names))
    return joined.groupBy("__link_status").agg(F.sum("n").alias("records"))


def link_examples(status: DataFrame, k: int = 10) -> DataFrame:
    """First ``k`` child records per outcome with shortened key parts."""
    names = [c for c in status.columns if c.startswith("__k")]
    best = top_rows(status, ["__link_status"], [F.asc(SRC)], k)
    long_part = reduce(lambda a, b: a | b, [F.length(c) > PREVIEW_LENGTH for c in names])
    shown = [F.substring(c, 1, PREVIEW_LENGTH).alias(c.strip("_")) for c in names]
    return best.select("__link_status", "rank", SRC, "__parent_source_record", *shown, long_part.alias("preview_truncated"))


def literal_left_join(child: DataFrame, parent: DataFrame, child_keys: Sequence[str], parent_keys: Sequence[str]) -> DataFrame:
    """Every child record with the cells of its unique parent; blank unless linked.

    The parent is grouped once on its key. A key that occurs once carries its
    cells through the grouping, so the parent is shuffled a single time.
    """
    names = _key_pairs(child, parent, child_keys, parent_keys)
    cells = data_columns(parent)
    complete = _with_keys(parent, parent_keys).filter(~any_empty(names))
    index = complete.groupBy(*names).agg(
        F.count("*").alias("occurrences"),
        F.min(SRC).alias("sole_record"),
        F.first(F.struct(*[F.col(f"`{c}`").alias(f"p{i}") for i, c in enumerate(cells)])).alias("__parent"),
    )
    index = index.withColumn("__parent", F.when(F.col("occurrences") == 1, F.col("__parent")))
    joined = salted_join(_with_keys(child, child_keys), index, names).withColumn("__link_status", _status(names))
    linked = F.col("__link_status") == "linked"
    return joined.select(
        F.col(SRC).alias("__child_source_record"),
        F.when(linked, F.col("sole_record")).alias("__parent_source_record"),
        "__link_status",
        *[F.col(f"`{c}`").alias(f"child:{c}") for c in data_columns(child)],
        *[F.when(linked, F.col(f"__parent.p{i}")).otherwise("").alias(f"parent:{c}") for i, c in enumerate(cells)],
    )


def join_dictionary(child_dictionary: DataFrame, parent_dictionary: DataFrame) -> DataFrame:
    """Dictionary of a derived join: technical rows, then the fields of both sides."""
    technical = {
        "__child_source_record": ("integer", "number of the left record"),
        "__parent_source_record": ("integer", "number of the only right record with the same key; null if there is none or more than one"),
        "__link_status": ("string", "result of comparing keys: missing, unmatched, conflicting or linked"),
    }
    spark = child_dictionary.sparkSession
    rows = [(name, "technical", kind, "Confirmed", "", text) for name, (kind, text) in technical.items()]
    out = spark.createDataFrame(rows, "name string, role string, data_type string, status string, unit string, description string")
    for role, dictionary in (("child", child_dictionary), ("parent", parent_dictionary)):
        out = out.unionByName(dictionary.select(F.concat(F.lit(role + ":"), "name").alias("name"), F.lit(role).alias("role"), "data_type", "status", "unit", "description"))
    return out


def verify_join(joined: DataFrame, child: DataFrame, parent: DataFrame, child_keys: Sequence[str], parent_keys: Sequence[str]) -> DataFrame:
    """Recompute a delivered join and compare every row."""
    return same_rows(joined, literal_left_join(child, parent, child_keys, parent_keys))


def _same_named(tables: dict[str, DataFrame]):
    for child_name, child in tables.items():
        for parent_name, parent in tables.items():
            if child_name == parent_name:
                continue
            for column in data_columns(child):
                target = next((c for c in data_columns(parent) if folded_name(c) == folded_name(column)), None)
                if target:
                    yield child_name, column, parent_name, target


def inclusions(tables: dict[str, DataFrame], pairs: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """For each pair of columns: nonempty child rows, those whose value the parent holds, and whether the parent's values are unique.

    Every table is read once, whatever the number of pairs: its cells are counted per
    value, the columns that hold a value meet in one group, and the group adds its
    counts to each of its pairs of columns. Only the sums, fewer than pairs of columns,
    are looked up at the end. ``parent_identifies`` is true where each of the parent's
    rows has a value of its own and none is blank.
    """
    columns = sorted({side for p in pairs for side in (p[:2], p[2:])})
    number = {side: i for i, side in enumerate(columns)}
    name = {side: folded_name(side[1]) for side in columns}
    counted = []
    for table, df in tables.items():
        own = [side for side in columns if side[0] == table]
        if own:
            cells = F.array(*[F.struct(F.lit(name[s]).alias("name"), F.lit(number[s]).alias("i"), F.col(f"`{s[1]}`").alias("value")) for s in own])
            counted.append(df.select(F.explode(cells).alias("c")).groupBy("c.name", "c.value", "c.i").agg(F.count("*").alias("n")))
    holders = reduce(DataFrame.unionByName, counted).groupBy("name", "value").agg(F.collect_list(F.struct("i", "n")).alias("held"))
    filled = F.col("value") != ""
    alone = F.transform("held", lambda x: F.struct(x["i"].alias("i"), F.lit(-1).alias("j"), x["n"].alias("n")))
    met = F.flatten(F.transform("held", lambda x: F.transform("held", lambda y: F.struct(x["i"].alias("i"), y["i"].alias("j"), x["n"].alias("n")))))
    rows = holders.select(filled.alias("filled"), (F.trim("value") == "").alias("blank"), F.explode(F.concat(alone, F.when(filled, met).otherwise(F.slice(met, 1, 0)))).alias("p")).select("filled", "blank", "p.*")
    sums = rows.groupBy("i", "j").agg(
        F.sum(F.when(F.col("filled"), F.col("n")).otherwise(0)).alias("n"),
        F.max(F.when(F.col("filled"), F.col("n")).otherwise(0)).alias("most"),
        F.max("n").alias("repeats"),
        F.max("blank").alias("blank"),
    )
    facts = sums.agg(F.collect_list(F.struct("i", "j", "n", "most", "repeats", "blank"))).scalar()
    spark = next(iter(tables.values())).sparkSession
    rows = [(*p, number[p[:2]], number[p[2:]]) for p in pairs]
    asked = spark.createDataFrame(rows, "child string, child_column string, parent string, parent_column string, i int, j int").withColumn("facts", facts)
    fact = lambda i, j: F.get(F.filter("facts", lambda x: (x["i"] == i) & (x["j"] == j)), F.lit(0))
    found = asked.select("child", "child_column", "parent", "parent_column", fact(F.col("i"), F.lit(-1)).alias("c"), fact(F.col("j"), F.lit(-1)).alias("p"), fact(F.col("i"), F.col("j")).alias("m"))
    total, matched = F.coalesce("c.n", F.lit(0)), F.coalesce("m.n", F.lit(0))
    return found.select(
        "child", "child_column", "parent", "parent_column", total.alias("total"), matched.alias("matched"), (total - matched).alias("orphans"),
        (F.coalesce("p.most", F.lit(0)) <= 1).alias("parent_unique"), F.coalesce((F.col("p.repeats") == 1) & ~F.col("p.blank"), F.lit(False)).alias("parent_identifies"),
    )


def relationship_candidates(tables: dict[str, DataFrame], share: float = 0.5) -> DataFrame:
    """Same-named pairs whose parent column identifies its rows and covers enough child values."""
    pairs = list(_same_named(tables))
    if not pairs:
        raise TableError("no two tables share a column name")
    found = inclusions(tables, pairs)
    return found.filter((F.col("total") > 0) & (F.col("matched") >= share * F.col("total")) & F.col("parent_identifies")).drop("parent_identifies")


def relationship_suggestions(tables: dict[str, DataFrame]) -> DataFrame:
    """Same-named key-like columns with at least one shared value."""
    pairs = [p for p in _same_named(tables) if re.search("id|key|code|^site$|^sp$", p[1], re.I)]
    if not pairs:
        raise TableError("no two tables share a key-like column name")
    return inclusions(tables, pairs).filter("matched > 0").drop("parent_identifies")


def _issue(df: DataFrame, rule: str, severity: str = "Error") -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col(SRC))


def primary_key_findings(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Non-first repeats and empty parts of a declared key."""
    if any(k not in df.columns for k in keys):
        spark = df.sparkSession
        return spark.createDataFrame([("primary key field missing", "Error", None)], f"rule string, severity string, {SRC} long")
    narrow = df.select(SRC, *[F.col(f"`{k}`") for k in keys])
    blank = _issue(narrow.filter(any_empty(keys)), "missing primary keys")
    return _issue(non_first(narrow, keys), "duplicate primary keys").unionByName(blank)


def foreign_key_findings(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Orphan children, unreferenced parents and a target that is not unique."""
    if child_key not in child.columns or parent_key not in parent.columns:
        spark = child.sparkSession
        return spark.createDataFrame([("relationship field missing", "Error", None)], f"rule string, severity string, {SRC} long")
    c = child.select(SRC, F.col(f"`{child_key}`").alias("k"))
    p = parent.select(SRC, F.col(f"`{parent_key}`").alias("k"))
    used = c.filter("k <> ''").groupBy("k").agg(F.count("*").alias("n")).select("k")
    known = p.groupBy("k").agg(F.count("*").alias("n"))
    orphans = _issue(salted_join(c.filter("k <> ''"), known.select("k"), ["k"], "left_anti"), "missing referenced records")
    unused = _issue(salted_join(p, used, ["k"], "left_anti"), "unreferenced parent records", "Information")
    repeated = known.agg(F.sum(F.col("n") - 1).alias("extra")).filter("extra > 0")
    target = repeated.select(F.lit("relationship target is not unique").alias("rule"), F.lit("Error").alias("severity"), F.lit(None).cast("long").alias(SRC))
    return orphans.unionByName(unused).unionByName(target)


def composite_orphans(child: DataFrame, parent: DataFrame, child_keys: Sequence[str], parent_keys: Sequence[str]) -> DataFrame:
    """Child records whose full tuple is absent; skipped only when every part is empty."""
    names = _key_pairs(child, parent, child_keys, parent_keys)
    c = _with_keys(child, child_keys).select(SRC, *names)
    p = _with_keys(parent, parent_keys).select(*names).distinct()
    all_empty = reduce(lambda a, b: a & b, [F.col(n) == "" for n in names])
    return _issue(salted_join(c.filter(~all_empty), p, names, "left_anti"), "composite reference missing")


def compare_key_sets(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Every distinct nonempty value with the side it occurs on."""
    require(left, [left_key])
    require(right, [right_key])
    a = left.filter(F.col(f"`{left_key}`") != "").select(F.col(f"`{left_key}`").alias("value"), F.lit(1).alias("l"), F.lit(0).alias("r"))
    b = right.filter(F.col(f"`{right_key}`") != "").select(F.col(f"`{right_key}`").alias("value"), F.lit(0).alias("l"), F.lit(1).alias("r"))
    both = a.unionAll(b).groupBy("value").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    side = F.when((F.col("l") == 1) & (F.col("r") == 1), "shared").when(F.col("l") == 1, "left only").otherwise("right only")
    return both.select("value", side.alias("side"))


def key_set_summary(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Distinct values per side of the comparison and the empty rows left out of it."""
    sides = compare_key_sets(left, right, left_key, right_key).groupBy("side").agg(F.count("*").alias("n"))
    empties = []
    for df, key, label in ((left, left_key, "left empty rows"), (right, right_key, "right empty rows")):
        empties.append(df.agg(F.count_if(F.col(f"`{key}`") == "").alias("n")).select(F.lit(label).alias("side"), "n"))
    return reduce(DataFrame.unionByName, [sides, *empties])


def codebook_matches(df: DataFrame, codebooks: DataFrame) -> DataFrame:
    """Per column and codebook: tokens found and codes with several meanings.

    ``codebooks(codebook, code, meaning)`` holds all codebooks; tokens are
    reduced to distinct values before they meet the codes.
    """
    tokens = unpivot_cells(df).filter(F.col("value") != "").select("column", F.col("value").alias("code")).distinct()
    usable = codebooks.filter("code <> '' and meaning <> ''").distinct()
    books = usable.groupBy("codebook", "code").agg(F.count("*").alias("meanings"))
    shared = tokens.join(books, "code")
    across = usable.select("code", "meaning").distinct().groupBy("code").agg(F.count("*").alias("all_meanings"))
    return shared.join(across, "code").groupBy("column", "codebook").agg(
        F.count("*").alias("matched_codes"),
        F.count_if(F.col("meanings") > 1).alias("conflicting_codes"),
        F.count_if(F.col("all_meanings") > 1).alias("cross_conflicts"),
    )


WORD = "[A-Za-z0-9_]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _name_pattern(name: str) -> str:
    return "(?i)(?:^|[^a-zA-Z0-9_])" + re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", name) + "(?:$|[^a-zA-Z0-9_])"


def mentions(texts: DataFrame, names: Sequence[str]) -> DataFrame:
    """``field, doc, line_number, line`` of every line that holds a field name as a whole word; A-Z match either case.

    Names are indexed by their longest word, and the distinct words of a line look up that
    index, so a line's cost does not grow with the number of names; only names that share
    a word with the line are matched whole. The index goes to every task, so that no line is
    shuffled with each of its words. Names without such a word are matched one by one.
    """
    lines = texts.select("doc", F.posexplode(F.split("text", "\r?\n")).alias("i", "line"))
    lines = lines.select("doc", (F.col("i") + 1).alias("line_number"), "line")
    words = {name: re.findall(WORD, name) for name in dict.fromkeys(names)}
    index = [(max(found, key=len).translate(str.maketrans(UPPER, LOWER)), name, _name_pattern(name)) for name, found in words.items() if found]
    tokens = F.array_distinct(F.regexp_extract_all(F.translate("line", UPPER, LOWER), F.lit(f"({WORD})"), 1))
    named = texts.sparkSession.createDataFrame(index, "word string, field string, pattern string")
    met = lines.select("*", F.explode(tokens).alias("word")).join(bounded_broadcast(named, len(index)), "word").filter(F.regexp_like("line", "pattern"))
    found = met.select("field", "doc", "line_number", "line")
    for name in (n for n, w in words.items() if not w):
        found = found.unionByName(lines.filter(F.contains("line", F.lit(name)) & F.col("line").rlike(_name_pattern(name))).withColumn("field", F.lit(name)))
    return found


def mention_totals(texts: DataFrame, names: Sequence[str]) -> DataFrame:
    """``field, lines, docs`` of every name: lines that mention it and documents that hold one, zero where none does."""
    per_doc = mentions(texts, names).groupBy("field", "doc").agg(F.count("*").alias("n"))
    totals = per_doc.groupBy("field").agg(F.sum("n").alias("lines"), F.count("*").alias("docs"))
    every = texts.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(names)], "field string")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return every.join(totals, "field", "left").select("field", zero("lines"), zero("docs"))


def evidence_mentions(texts: DataFrame, names: Sequence[str], k: int = 20, excerpt: int = 400) -> DataFrame:
    """First ``k`` lines per field name that hold it as a whole word, of the hits of :func:`mentions`. ``texts(doc, text)`` are whole texts."""
    hits = mentions(texts, names).select("field", "doc", "line_number", F.substring("line", 1, excerpt).alias("excerpt"))
    best = top_rows(hits, ["field"], [F.asc("doc"), F.asc("line_number")], k)
    return best.select("field", "rank", "doc", "line_number", "excerpt")
