from sedgetable.llm import quality


def test_toxic_rows_are_bad_whatever_their_quality(spark):
    docs = spark.createDataFrame([(k, f"text number {k}") for k in range(40)], "doc_id long, text string")
    given = {k: [(1, 0), (1, 1), (0, 0), (0, 1), (1, None), (None, 1), (None, 0), (0, None)][k % 8] for k in range(40)}
    labels = spark.createDataFrame([(k, *v) for k, v in given.items()], "doc_id long, quality int, toxic int")
    known = sorted(k for k, v in given.items() if v != (None, 0))
    _, held = quality.fit(docs, labels)
    assert held == {k: int(given[k] in ((1, 0), (1, None))) for n, k in enumerate(known) if n % 2}
