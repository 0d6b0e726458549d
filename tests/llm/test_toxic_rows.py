from folioforge.llm import toxicity


def test_each_row_goes_by_its_own_text(spark):
    """A toxic row without doc_id goes, and a clean row stays though a toxic one has its doc_id."""
    bad, fine = "vile filth slur", "quiet garden bench"
    rows = [(i, f"{bad} a{i}" if i % 2 else f"{fine} b{i}") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    odd = [(None, f"{bad} alone"), (None, f"{fine} alone"), (900, f"{bad} twice"), (900, f"{fine} twice"), (901, None)]
    docs = spark.createDataFrame([*rows, *odd], "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in toxicity.drop_toxic(docs, labels).collect()]
    want = [r for r in [*rows, *odd] if not (r[1] or "").startswith(bad)]
    key = lambda r: (r[0] or -1, r[1] or "")
    assert sorted(got, key=key) == sorted(want, key=key)
