"""Registered queries of the package, with production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sedgetable.llm import bpe, collocations, kdshards, lm, merkle, packing, quality, rules, simhash, substrings, topk, warc, wrappers

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    digests = bpe.round_trip(F.col("text"), public_tokenizers.path("byte_bpe_50k.json"))
    return docs.select("doc_id", digests.alias("r")).select("doc_id", "r.*")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_texts(_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return lm.scored(_table(spark, sf_dir, "documents", "doc_id", "text"), ~held_out)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    return quality.classified(docs, labels).select("doc_id", "log_weight", "gumbel_key", "kept")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rules.judged(_table(spark, sf_dir, "documents", "doc_id", "text"))
    named = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words")
    return docs.select("doc_id", *[f"measures.{c}" for c in named], "base_failed", "kept")


OP2_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP6_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS last FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM m
"""

OP5_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 19], ' ')) AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) AS n FROM g) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r),
x AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
p AS (SELECT doc_id, word, i FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w)),
k AS (
  SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS kept
  FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.i = c.i WHERE c.i IS NULL GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN x ON w.doc_id = x.doc_id LEFT JOIN k ON w.doc_id = k.doc_id
"""


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS body,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1)
  GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    CAST(len(list_filter(words, lambda x: list_contains(string_split('STOP_WORDS', ' '), lower(x)))) AS BIGINT) AS n_stop_words
  FROM w LEFT JOIN r ON w.doc_id IS NOT DISTINCT FROM r.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND word_chars BETWEEN 2 * n_words AND 15 * n_words
    AND 10 * n_symbols <= n_words AND 20 * n_stop_words >= n_words AND 2 * n_dup_lines <= n_lines AS kept
FROM m
""".replace("STOP_WORDS", " ".join(rules.STOP_WORDS))


def op10_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents", "text", "lang"))


OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p),
t AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, size, array_to_string(words[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS size))),
f AS (SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY lang, size, phrase),
c AS (SELECT *, string_split(phrase, ' ') AS words FROM f WHERE size > 1 AND a >= 30),
k AS (SELECT *, unnest(range(1, size)) AS k FROM c),
s AS (
  SELECT k.lang, k.phrase, k.a, k.k, l.a AS l, r.a AS r, CAST(2000000 * CAST(k.a AS HUGEINT) // (l.a + r.a) AS BIGINT) AS score
  FROM k JOIN f AS l ON k.lang = l.lang AND array_to_string(k.words[:k.k], ' ') = l.phrase
  JOIN f AS r ON k.lang = r.lang AND array_to_string(k.words[k.k + 1:], ' ') = r.phrase),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
h AS (
  SELECT lang, array_to_string(words[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, words, a, m, unnest(range(1, size - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < size)
  GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, t.n, score
FROM b JOIN t ON b.lang = t.lang LEFT JOIN h ON b.lang = h.lang AND b.phrase = h.phrase
WHERE h.longer IS NULL OR 100 * h.longer < 80 * b.a
QUALIFY row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) <= 2000
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.manifest(_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars"), tampered)


def _tree_sql(name: str, first: str, levels: int) -> str:
    """Levels ``{name}0`` to ``{name}{levels}`` above the nodes ``first(g, i, h)``, each with its siblings."""
    run = "PARTITION BY g, i // 8 ORDER BY i"
    out, source = [], first
    for j in range(levels + 1):
        out.append(f"""{name}{j} AS (SELECT *, count(*) OVER (PARTITION BY g) AS n,
  coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM ({source}))""")
        source = f"SELECT g, i // 8 AS i, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}{j} GROUP BY g, i // 8"
    return ",\n".join(out)


def _op12_sql(levels: int = 7, top_levels: int = 4) -> str:
    """Up to 8**levels documents of a language, and 8**top_levels languages."""
    part = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    folded = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = """list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
  lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, (x & 1) * 3988292384) END)"""
    joins = []
    for name, depth, key, at in (("t", levels, "x.g", "x.i"), ("u", top_levels, "0", "x.top")):
        for j in range(depth):
            node = f"{name}{j}"
            joins.append(f"JOIN {node} ON {node}.g = {key} AND {node}.i = {at} // {8**j}")
    # Each step of the fold is a column of its own, as a nested one would repeat itself.
    steps = []
    for k, join in enumerate(joins):
        node = join.split()[1]
        steps.append(f"f{k} AS (SELECT x.* EXCLUDE (changed, siblings), CASE WHEN n = 1 THEN x.changed ELSE sha256({node}.before || x.changed || {node}.after) END AS changed, x.siblings || {node}.before || {node}.after AS siblings FROM {f'f{k - 1}' if k else 'd'} AS x {join})")
    return f"""WITH b AS (
  SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN xor({crc}, 4294967295) % 3 = 0 THEN {leaf(folded)} END AS changed FROM documents),
l AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT lang FROM documents)),
e AS (SELECT doc_id, leaf, coalesce(changed, leaf) AS changed, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM b JOIN l ON b.lang IS NOT DISTINCT FROM l.lang),
{_tree_sql('t', 'SELECT g, i, leaf AS h FROM e', levels)},
{_tree_sql('u', f'SELECT 0 AS g, g AS i, h FROM t{levels}', top_levels)},
d AS (SELECT doc_id, leaf, changed, '' AS siblings, g, i, g AS top FROM e),
{",".join(steps)}
SELECT doc_id, leaf, t{levels}.h AS subroot, u{top_levels}.h AS root, sha256(siblings) AS proof_sha256, changed AS folded_root, changed = u{top_levels}.h AS verified
FROM f{len(joins) - 1} AS x JOIN t{levels} ON t{levels}.g = x.g JOIN u{top_levels} ON true
"""


def op13_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdshards.sharded(_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars"), shards=16)


def entries() -> dict[str, tuple[Query, str | None]]:
    return {
        "op1_bpe_round_trip": (op1_bpe_round_trip, None),
        "op2_exact_top_k": (op2_exact_top_k, OP2_SQL),
        "op6_warc_round_trip": (op6_warc_round_trip, OP6_SQL),
        "op3_lm_scores": (op3_lm_scores, None),
        "op5_substring_dedup": (op5_substring_dedup, OP5_SQL),
        "op4_quality_classifier": (op4_quality_classifier, None),
        "op7_simhash_near_dedup": (op7_simhash_near_dedup, None),
        "op8_quality_rules": (op8_quality_rules, OP8_SQL),
        "op9_html_main_text": (op9_html_main_text, None),
        "op10_retrieval_packing": (op10_retrieval_packing, None),
        "op11_phrase_collocations": (op11_phrase_collocations, OP11_SQL),
        "op12_merkle_manifest": (op12_merkle_manifest, _op12_sql()),
        "op13_kd_shards": (op13_kd_shards, None),
    }
