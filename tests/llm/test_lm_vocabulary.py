import math

from folioforge.llm import lmscore


def test_words_past_the_65535_most_frequent_are_scored_by_their_own_counts(spark):
    """Rare words of the target follow 66,000 words that occur more often."""
    filler = " ".join(f"w{i}" for i in range(66_000))
    docs = spark.createDataFrame([(0, " ".join([filler] * 3)), (1, "rare other"), (2, "rare thing"), (3, "rare"), (4, "absent"), (5, "one more")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in lmscore.score_documents(docs, labels).collect()}
    v = 66_000 + 6  # all words, and no entry besides them
    assert got[0].n_words == 198_000
    # Of the target's 4 words 2 are "rare", both at text starts; the background has 4 words too, so neither is thinned.
    word = (2 + 1) / (4 + v)
    assert math.isclose(got[3].target_loss, -math.log(lmscore.BIGRAM * 2 / 2 + (1 - lmscore.BIGRAM) * word), abs_tol=1e-6)
    # "absent" was never seen there: it has no count of text starts or of unknown words.
    assert math.isclose(got[4].target_loss, -math.log((1 - lmscore.BIGRAM) / (4 + v)), abs_tol=1e-6)


def test_own_words_after_other_predecessors_are_taken_out(spark):
    """A name 50 times after 50 predecessors in one target document, and nowhere else, counts 0 while that document is scored."""
    words = [x for i in range(50) for x in (f"p{i}", "name")]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(f"q{i}" for i in range(100)))], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in lmscore.score_documents(docs, labels).collect()}
    # The only target document: without it the model is empty, so every word has 1 of 100 + 65,536.
    assert math.isclose(got[1].target_loss, math.log(100 + lmscore.LEAST_WORDS + 1), abs_tol=1e-6)
