from sedgetable.llm import warc


def test_rows_of_one_id_with_unequal_payloads(spark):
    rows = [(1, "u", "one"), (1, "u", "two"), (1, "u", "three"), (5, "u", "one"), (6, "u", "three")]
    out = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in out)
    assert len({r["payload_digest"] for r in out if r["record_type"] == "response"}) == 3
    assert got == [(1, 3, "response", 0), (1, 3, "revisit", 5), (1, 5, "revisit", 6), (5, 3, "response", 0), (6, 5, "response", 0)]
