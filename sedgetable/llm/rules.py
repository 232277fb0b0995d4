"""Quality rules: a threshold table compiled into one projection of native expressions.

``MEASURES`` names what is measured of a text, ``RULES`` bounds ratios of measures.
:func:`verdict` turns the table into one condition; no user function runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
# Frequent function words of English, French, German and Spanish.
STOP_WORDS = "a an and as at be by for from in is it of on that the this to was with de des en et la le les un une der den die das und zu el los las que y".split()

# Measure, and the measure it is divided by (None: as it is), with the lowest and highest allowed value.
RULES: list[tuple[str, str | None, float | None, float | None]] = [
    ("n_words", None, 50, None),
    ("n_repeat_words", "n_words", None, 0.5),
    ("word_chars", "n_words", 2.0, 15.0),
    ("n_symbols", "n_words", None, 0.1),
    ("n_stop_words", "n_words", 0.05, None),
    ("n_dup_lines", "n_lines", None, 0.5),
]
BASE = RULES[:2]


def _words(text: Column) -> Column:
    """Words of a text; a leading or trailing separator leaves no empty word."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAK), "")


def _repeat_words(hashes: Column) -> Column:
    """Words inside 3-word windows that the text holds twice or more.

    Windows are hashed to 64 bits and sorted as plain numbers; only where two are
    equal are (hash, position) pairs sorted, and the positions of repeated windows
    merged: each covers its three words, less what the next one covers.
    """
    none = F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(-1).alias("i"))

    def windows(h: Column) -> Column:
        n = F.greatest(F.size(h) - 2, F.lit(0))
        three = F.arrays_zip(*[F.slice(h, k, n).alias(c) for k, c in ((1, "a"), (2, "b"), (3, "c"))])
        return F.transform(three, lambda w: F.xxhash64(w["a"], w["b"], w["c"]))

    def repeated(placed: Column) -> Column:
        before = F.concat(F.array(none), F.slice(placed, 1, F.size(placed) - 1))
        after = F.concat(F.slice(placed, 2, F.size(placed) - 1), F.array(none))
        near = F.arrays_zip(placed.alias("p"), before.alias("b"), after.alias("a"))
        twice = F.filter(near, lambda x: F.coalesce(x["p"]["h"] == x["b"]["h"], F.lit(False)) | F.coalesce(x["p"]["h"] == x["a"]["h"], F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["p"]["i"]))

    def covered(at: Column) -> Column:
        steps = F.zip_with(at, F.slice(at, 2, F.size(at) - 1), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda s, x: s + x)

    def count(w: Column) -> Column:
        placed = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(_bound(_bound(placed, repeated), covered))

    return _bound(_bound(hashes, windows), count)


def _bound(value: Column, build) -> Column:
    """Evaluate ``value`` once for all its uses in ``build``."""
    return F.transform(F.array(value), build)[0]


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``measures``: lengths, symbols, stop words, lines and repeats, all ``bigint``.

    Null texts measure as empty ones: all zero.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    words = _words(F.col(text))
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    parts = docs.withColumn("__words", words).withColumn("__lines", lines)
    parts = parts.withColumn("__repeats", _repeat_words(F.transform("__words", lambda w: F.xxhash64(w))))
    measures = {
        "n_words": F.size("__words"),
        "word_chars": F.length(F.array_join("__words", "")),
        "n_symbols": F.length(body) - F.length(F.regexp_replace(body, f"[{SYMBOLS}]+", "")),
        "n_lines": F.size("__lines"),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": F.col("__repeats"),
        "n_stop_words": F.size(F.filter("__words", lambda w: F.lower(w).isin(STOP_WORDS))),
    }
    out = F.struct(*[c.cast("bigint").alias(k) for k, c in measures.items()])
    return parts.withColumn("measures", out).drop("__words", "__lines", "__repeats")


def verdict(rules=RULES, measures: str = "measures") -> Column:
    """True where every rule of the table holds; a ratio over nothing holds."""
    ok = F.lit(True)
    for name, over, low, high in rules:
        value = F.col(f"{measures}.{name}").cast("double")
        base = F.lit(1.0) if over is None else F.col(f"{measures}.{over}").cast("double")
        for bound, holds in ((low, lambda v, b: v >= b), (high, lambda v, b: v <= b)):
            if bound is not None:
                ok = ok & ((base == 0) | holds(value, F.lit(float(bound)) * base))
    return ok


def judged(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """``docs`` with ``measures``, ``base_failed`` and ``kept``. Rows and columns stay as they are."""
    marked = measured(docs, text)
    failed = (F.col("measures.n_words") < 50) | (100 * F.col("measures.n_repeat_words") > 50 * F.col("measures.n_words"))
    return marked.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules))
