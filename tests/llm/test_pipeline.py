"""The pipeline's stages against brute force, each on what the one before it kept."""

import re
from collections import Counter

import corpus_pipeline as pipeline
import pytest
from folioforge.llm import mixing, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def rows_of():
    """Clean and toxic texts, exact and near copies, nulls, an empty and a long text, a repeated row, and two sources."""
    fine = [" ".join(f"w{(i * 31 + k * 7) % 997}" for k in range(40)) for i in range(80)]
    rows = [(i, t + (" vile filth slur" if i % 4 == 0 else ""), "en", "a" if i % 3 else "b", 1) for i, t in enumerate(fine)]
    rows += [(100 + i, fine[i * 4 + 1], "en", "a", 1) for i in range(6)] + [(200 + i, fine[i * 4 + 2] + " tail", "en", "b", 1) for i in range(6)]
    return [*rows, (300, None, None, None, None), (301, "", "en", "b", 0), (302, " ".join(f"z{i}" for i in range(20_000)), "en", "b", 1), rows[3], (None, fine[3], "en", "a", 1)]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows_of(), SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def content(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


def test_every_stage_equals_brute_force(spark, sf_dir):
    tiktoken, public_tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    stages = dict(pipeline.STAGES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")

    kept = stages["toxicity"](spark, docs, sf_dir)
    texts = {r.doc_id: r.text for r in docs.collect()}
    bad = {texts[r.doc_id] or "" for r in toxicity.score_toxicity(docs, labels).where("predicted = 1").collect()}
    want = Counter({k: n for k, n in content(docs).items() if (k[1] or "") not in bad})
    assert content(kept) == want and len(bad) == 20 and all("vile" in t for t in bad)

    unique = stages["exact_dedup"](spark, kept, sf_dir)
    best = {}
    for k in want:
        if (k[1] or "") not in best or (k[0] if k[0] is not None else -1) > (best[k[1] or ""][0] if best[k[1] or ""][0] is not None else -1):
            best[k[1] or ""] = k
    want = Counter(best.values())
    assert content(unique) == want and unique.columns == docs.columns

    near = stages["ngram_jaccard_join"](spark, unique, sf_dir)
    ids = sorted(want, key=lambda k: k[0])
    sets, top = [shingles(k[1]) for k in ids], list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                low, high = sorted((top[i], top[j]))
                top = [low if t == high else t for t in top]
    want = Counter(k for i, k in enumerate(ids) if top[i] == i)
    assert content(near) == want and len(want) < len(ids) and near.columns == docs.columns

    mixed = stages["mixing"](spark, near, sf_dir)
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix(near).collect()}
    times = Counter(r.doc_id for r in mixed.collect())
    assert set(content(mixed)) <= set(want) and mixed.columns == docs.columns
    assert all(abs(times[d] - (t / s if s else 0)) < 1 for d, (t, s) in taken.items() if s)

    ranks = pipeline.bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = Counter((r.doc_id, tuple(memoryview(bytes(r.ids)).cast("I"))) for r in stages["byte_bpe"](spark, mixed, sf_dir).collect())
    assert got == Counter((r.doc_id, tuple(known.encode_ordinary(r.text or ""))) for r in mixed.collect())


def test_empty_documents_come_through(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
