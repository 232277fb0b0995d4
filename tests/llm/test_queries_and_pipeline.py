import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from sedgetable.llm import quality, rules, substrings
from test_near_copies import by_brute_force

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages"):
        con.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", ["op2_exact_top_k", "op5_substring_dedup", "op6_warc_round_trip", "op8_quality_rules", "op11_phrase_collocations", "op12_merkle_manifest"])
def test_queries_equal_their_sql(spark, duck, name):
    found = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    rows = sorted((tuple(r) for r in found.fetchall()), key=str)
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == rows


def test_all_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1


def test_stages_take_effect_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "simhash_near_dedup", "substring_dedup", "retrieval_packing"]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    by = [f for _, f in corpus_pipeline.STAGES]

    kept = by[0](spark, docs, SF)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {r["doc_id"] for r in quality.classified(docs, labels).filter("kept").collect()}

    kept = by[1](spark, docs, SF)
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == docs.columns and ids == {r["doc_id"] for r in rules.judged(docs).filter("kept").collect()}

    kept = by[2](spark, docs, SF)
    ids = sorted(texts)
    groups = {ids[root] for root in by_brute_force([texts[k] for k in ids])}
    assert sorted(kept.columns) == sorted(docs.columns)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(groups)

    cut = by[3](spark, docs, SF).collect()
    removed = {r["doc_id"]: r["n_removed"] for r in substrings.digests(docs).collect()}
    for r in cut:
        assert r["n_chars"] == len(r["text"])
        assert (r["text"] == texts[r["doc_id"]]) == (removed[r["doc_id"]] == 0)

    rows = corpus_pipeline.run(spark, SF).collect()
    covered = {}
    for r in rows:
        covered[r["doc_id"]] = covered.get(r["doc_id"], 0) + r["length"]
    assert all(covered[r["doc_id"]] == r["doc_tokens"] for r in rows)


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
