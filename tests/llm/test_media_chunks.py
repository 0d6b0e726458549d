import random

from folioforge.llm import media


def test_texts_of_usual_length_share_the_chunks_of_a_passage(spark):
    """Two texts of about 5 KB, under the former least chunk, with one passage of 4 KB at different places."""
    draw = random.Random(7)
    words = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    passage = words(4000)
    docs = spark.createDataFrame([(1, words(300) + passage), (2, words(900) + passage + words(100))], "doc_id long, text string")
    store = media.ChunkStore.of(docs)
    assert 0 < store.chunks.count() < store.references.count()
    rows = media.media_features(docs).collect()
    assert len(rows) == 2 and all(r.verified and r.n_chunks > 1 for r in rows)
