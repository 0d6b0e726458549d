from folioforge.llm import jaccard


def test_the_last_round_pairs_what_hubs_were_too_short_for(spark):
    """The only link is between two long texts, and each n-gram of theirs is a short document as well, so all hubs are short."""
    words = [f"w{i}" for i in range(60)]
    windows = [" ".join(words[i : i + 5]) for i in range(56)]
    texts = [" ".join(words), " ".join([*words[:57], "x", "y", "z"]), *windows]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_components(docs).collect()}
    assert got == {i: 0 if i < 2 else i for i in range(len(texts))}
