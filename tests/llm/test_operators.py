import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import bpe, exactdedup, jaccard, linededup, lmscore, media, mixing, sharding, toxicity, warc

SCHEMA = "doc_id long, text string, source string, lang string, size string, digest string, node string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sample():
    """Nulls, empty, short, long and repeated texts, repeated rows, and columns with clashing names."""
    long_text = " ".join(WORDS[i * 7 % 20] + str(i) for i in range(3000))
    base = " ".join(WORDS * 3)
    texts = ["", None, "one", "one two three four", base, base, base.replace("mu", "MU"), base + " extra", " ".join(WORDS[:10] * 4), long_text, long_text + " tail", "a\nthis line is repeated often enough\nb", "THIS line is repeated often enough  \nc", "\tthis line is repeated often enough\n\n", "été 中文 \U0001f600 it's 123 \x85 x", "x" * 300]
    rows = [(i, t, "s" if i % 3 else None, "en", "q", "d", "n") for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, base, "t", None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_equals_the_library_and_comes_back(spark, docs, empty):
    public_tokenizers, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks).collect()
    want = sorted((known.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in sample())
    assert sorted((list(memoryview(r.ids).cast("I")), bytes(r.decoded)) for r in got) == want
    assert bpe.encode(empty, ranks, public_tokenizers.PATTERN).count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_jaccard_equals_brute_force(spark, docs, empty):
    rows = sample()
    sets = [shingles(r[1]) for r in rows]
    top = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = top[i], top[j]
                top = [min(a, b) if t in (a, b) else t for t in top]
    name = {}
    for r, t in zip(rows, top):
        if r[0] is not None:
            name[t] = min(name.get(t, r[0]), r[0])
    want = sorted(repr((r[0], len(s), name.get(t) if s else r[0])) for r, s, t in zip(rows, sets, top))
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in jaccard.near_components(docs).collect()) == want
    assert jaccard.near_components(empty).count() == 0


def test_exact_dedup_with_colliding_digests(spark, docs, empty):
    groups = {}
    for r in sample():
        groups.setdefault(r[1] or "", []).append(r[0])
    want = sorted(repr((i, max((x for x in ids if x is not None), default=None), len(ids))) for ids in groups.values() for i in ids)
    for digest in (exactdedup.sha256, lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 1))):
        got = exactdedup.exact_dedup(docs, digest).collect()
        assert sorted(repr((r.doc_id, r.keep_id, r.group_size)) for r in got) == want
    assert exactdedup.exact_dedup(empty).count() == 0
    assert exactdedup.drop_copies(docs).count() == len(groups)


def test_mixing_takes_each_budget_exactly(spark, docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(sample())
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        t = by.setdefault(r.source, [0, r.target, r.source_size])
        t[0] += r.taken
    assert all(abs(t[0] - t[1]) <= 0.5 and t[1] <= 3 * t[2] for t in by.values())
    assert abs(sum(t[1] for t in by.values()) - sum(r.size for r in rows)) < 1e-6
    assert mixing.mix(empty).count() == 0
    assert mixing.apply_mix(docs).columns == docs.columns


def test_sharding_is_minimax(spark, docs, empty):
    rows = sharding.shard(docs, shards=4).collect()
    sizes = {}
    for r in rows:
        assert r.size == len((next(x[1] for x in sample() if hashlib.sha256((x[1] or "").encode()).hexdigest() == r.text_sha256) or "").encode()) + 16
        sizes[r.text_sha256] = sizes.get(r.text_sha256, 0) + r.size
    order = [sizes[k] for k in sorted(sizes)]

    def fits(capacity):
        used, load = 1, 0
        for s in order:
            if s > capacity:
                return False
            used, load = (used, load + s) if load + s <= capacity else (used + 1, s)
        return used <= 4

    best = next(c for c in range(max(order), sum(order) + 1) if fits(c))
    loads, slots, groups = {}, {}, {}
    for r in rows:
        loads[r.shard] = loads.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
        groups.setdefault(r.text_sha256, set()).add(r.shard)
    assert max(loads.values()) == best
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(g) == 1 for g in groups.values())
    assert sharding.shard(empty).count() == 0


def test_line_dedup_equals_brute_force(spark, docs, empty):
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(strip))
    holders = {}
    for r in sample():
        for line in (r[1] or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(r[0])
    top = {k: max((x for x in v if x is not None), default=None) for k, v in holders.items() if len(v) >= 3}
    want = []
    for r in sample():
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if key(x) not in top or top[key(x)] == r[0]]
        want.append(repr((r[0], "\n".join(kept), len(lines), len(lines) - len(kept))))
    got = linededup.dedup_lines(docs).collect()
    assert sorted(repr((r.doc_id, r.kept, r.n_lines, r.n_dropped)) for r in got) == sorted(want)
    assert linededup.dedup_lines(empty).count() == 0


def test_media_round_trip(spark, docs, empty):
    for r in media.media_features(docs).collect():
        texts = [x[1] or "" for x in sample() if x[0] == r.doc_id]
        data = media.payload_of(texts[0])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.verified) == (len(texts[0].encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), True)
        assert r.feature == media.feature_of(data)
        ends = media.gear_cuts(data)
        frames = [zlib.compress(data[a:b], media.LEVEL) for a, b in zip([0, *ends], ends)]
        stored = b"".join(len(f).to_bytes(4, "little") + f for f in frames)
        assert (r.media_bytes, r.media_sha256, r.n_chunks) == (len(stored), hashlib.sha256(stored).hexdigest(), len(frames))
    assert media.media_features(empty).count() == 0


def test_cuts_follow_the_content():
    import numpy as np

    data = np.random.default_rng(3).integers(0, 256, 400_000, dtype=np.uint8).tobytes()
    cuts = media.gear_cuts(data)
    shifted = media.gear_cuts(b"prefix" + data)
    assert cuts[-1] == len(data) and all(b - a <= media.MAX_CHUNK for a, b in zip([0, *cuts], cuts))
    assert len({c + 6 for c in cuts} & set(shifted)) > len(cuts) // 2


def test_warc_round_trip(spark):
    """Copies, repeated rows, nulls, a long page, text that looks like record ends, clashing columns, and an empty table."""
    page, long_page = "<html>" + "x" * 120 + "</html>", "".join(f"{i} " for i in range(400_000))
    rows = [(1, "http://www.Example.com:80/a?b=1#f", page), (2, "https://example.com/a?b=1", page), (3, None, None), (4, "http://e.org", "small"), (5, "http://e.org", "small"), (6, "http://h.net/p\r\n", "a\r\n\r\nb" * 50)]
    rows += [(7, "http://l.org/", long_page), (8, "http://d.org/", page + "d"), (8, "http://d.org/", page + "d"), (None, "http://n.org/", page + "n"), (9, "http://n.org/", page + "n")]
    schema = "page_id long, url string, html string, digest string, file string, place string, record_type string"
    pages = spark.createDataFrame([(*r, "d", "f", "p", "t") for r in rows], schema)
    found = warc.archived_pages(pages).collect()
    got = {r.page_id: r for r in found if r.page_id != 8}
    want = {1: ("response", None), 2: ("revisit", 1), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None), None: ("response", None), 9: ("revisit", None)}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == want
    assert sorted((r.record_type, r.refers_to or 0) for r in found if r.page_id == 8) == [("response", 0), ("revisit", 8)]
    for i, _, html in rows:
        for r in found:
            if r.page_id == i:
                assert (r.payload_bytes, r.payload_digest) == (len((html or "").encode()), hashlib.sha256((html or "").encode()).hexdigest())
    assert got[1].url_key == "com,example)/a?b=1"
    assert warc.archived_pages(spark.createDataFrame([], schema)).count() == 0


def test_one_key_is_found_by_range_reads(spark, tmp_path):
    """Only the block that the directory names is read, and keys that are not there are not found."""
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.org/{i % 50}", f"page {i}") for i in range(3000)], "page_id long, url string, html string")
    index = warc.archive(pages, f"file://{tmp_path}/w")
    asked = spark.createDataFrame([("org,h3)/3", 3), ("org,h3)/3", 353), ("org,none)/", 3)], "url_key string, page_id long")
    assert sorted((r.page_id, r.payload_digest) for r in index.lookup(asked).collect()) == sorted((i, hashlib.sha256(f"page {i}".encode()).hexdigest()) for i in (3, 353))


def test_nearest_examples_are_exact(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    vectors = [{int(t): int(rng.integers(1, 4)) for t in rng.choice(12, rng.integers(1, 5), replace=False)} for _ in range(400)]
    index = toxicity.BlockMaxIndex(list(range(400)), [i % 2 for i in range(400)], vectors, np.linspace(1, 3, 12))
    for query in vectors[:60]:
        unit = index.unit(query)
        cosines = sorted(((round(sum(w * index.unit(v).get(t, 0) for t, w in unit.items()), 9), -i) for i, v in enumerate(vectors)), reverse=True)
        places, found = index.nearest(query, 10)
        assert np.allclose(found, [c for c, _ in cosines[:10]], atol=1e-8)


def test_toxicity_equals_brute_force(spark):
    """Terms, frequencies, cosines, neighbours and votes over a small table; the score is one logistic curve of the vote."""
    rng = np.random.default_rng(5)
    words = [f"{a}{b}x" for a in "abcdefg" for b in "hijkl"]
    toxic = {i: int(rng.random() < 0.4) for i in range(160)}
    pick = lambda i: [*rng.choice(words, 6), *(rng.choice(["vile", "foul", "slur", "bane"], 2) if toxic.get(i, i % 2) and rng.random() < 0.9 else [])]
    texts = {i: " ".join(pick(i)) for i in range(200)} | {200: "", 201: "a1 b2"}
    texts[7] = texts[6]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, t) for i, t in toxic.items()], "doc_id long, toxic int")
    known = {i: t for i, t in toxic.items() if zlib.crc32(str(i).encode()) % 5}
    counts = {i: Counter(re.findall(r"[^\W\d_]+", t.lower())) for i, t in texts.items()}
    n, bad = len(known), sum(known.values())
    terms = []
    for w in sorted({w for i in known for w in counts[i]}):
        a = sum(known[i] for i in known if w in counts[i])
        b = sum(1 - known[i] for i in known if w in counts[i])
        chi2 = (a * (n - bad - b) - b * (bad - a)) ** 2 * n / (bad * (n - bad) * (a + b) * max(0.5, n - a - b))
        if a + b >= 4 and a / bad > b / (n - bad) and chi2 >= toxicity.MIN_CHI2:
            terms.append(w)
    assert len(terms) >= 2
    idf = {w: math.log((1 + len(texts)) / (1 + sum(w in c for c in counts.values()))) + 1 for w in terms}

    def unit(i):
        v = {w: (1 + math.log(counts[i][w])) * idf[w] for w in terms if w in counts[i]}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    points = []
    for i in texts:
        found = [(round(sum(x * unit(j).get(w, 0) for w, x in unit(i).items()), 12), j) for j in known if texts[j] != texts[i]]
        found = sorted((x for x in found if x[0] > 0), key=lambda x: (-x[0], x[1]))[: toxicity.NEIGHBOURS]
        assert got[i].neighbour_ids == [j for _, j in found] and np.allclose(got[i].cosines, [c for c, _ in found], atol=1e-8)
        assert got[i].predicted == int(got[i].score >= 0.5) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        if found:
            vote = (sum(c * known[j] for c, j in found) + 0.5 * bad / n) / (sum(c for c, _ in found) + 0.5)
            points.append((math.log(vote / (1 - vote)), math.log(got[i].score / (1 - got[i].score))))
    (x0, y0), (x1, y1) = min(points), max(points)
    slope = (y1 - y0) / (x1 - x0)
    assert slope > 0 and all(abs(y0 + slope * (x - x0) - y) < 1e-4 for x, y in points)


def test_toxicity_held_out_accuracy(spark):
    path = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{path}/labels.parquet")
    scored = toxicity.score_toxicity(spark.read.parquet(f"{path}/documents.parquet"), labels)
    rows = scored.where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.95


def test_toxicity_and_lm_on_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (8, None, 1), (9, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score_toxicity(docs, labels).where("score between 0 and 1").count() == len(sample())
    assert toxicity.score_toxicity(empty, labels).count() == 0
    assert lmscore.score_documents(docs, labels).where("score is not null").count() >= len(sample())
    assert lmscore.score_documents(empty, labels).count() == 0


def test_lm_scores_equal_brute_force(spark, docs):
    """All words are in the vocabulary here, so bigrams can be counted by the words themselves."""
    labels = [(4, 1), (9, 1), (8, 0)]
    texts = [(r[0], re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))) for r in sample()]
    draws = {(r.doc_id, r.text): r.draw / lmscore.DRAWS for r in docs.select("doc_id", "text", F.pmod(F.xxhash64(F.xxhash64("doc_id", "text")), F.lit(lmscore.DRAWS)).alias("draw")).collect()}
    good = dict(labels)
    sides = {True: [], False: []}
    for row, (doc_id, words) in zip(sample(), texts):
        if doc_id not in good or good[doc_id]:
            sides[doc_id in good].append((draws[(doc_id, row[1])], doc_id, words))
    least = min(sum(len(w) for _, _, w in s) for s in sides.values())
    models = []
    for side in (True, False):
        total = sum(len(w) for _, _, w in sides[side])
        picked = [(d, w) for share, d, w in sides[side] if share < least / total]
        models.append((picked, Counter(x for _, w in picked for x in w), Counter(x for _, w in picked for x in ["", *w[:-1]] if w), Counter(p for _, w in picked for p in zip(["", *w[:-1]], w))))
    want = []
    for doc_id, words in texts:
        losses = []
        for picked, one, head, two in models:
            inside = (doc_id, words) in picked
            own, own_one, own_head = (Counter(x) if inside else Counter() for x in (zip(["", *words[:-1]], words), words, ["", *words[:-1]] if words else []))
            total, loss = sum(one.values()), 0.0
            for a, b in zip(["", *words[:-1]], words):
                mine = own[(a, b)]
                word = (one[b] - own_one[b] + 1) / (total + lmscore.MAX_WORDS + 1)
                left = head[a] - own_head[a]
                loss -= math.log(lmscore.BIGRAM * ((two[(a, b)] - mine) / left if left else word) + (1 - lmscore.BIGRAM) * word)
            losses.append(round(loss / max(1, len(words)), 5))
        want.append((-1 if doc_id is None else doc_id, len(words), *losses))
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_words, r.target_loss, r.background_loss) for r in lmscore.score_documents(docs, spark.createDataFrame([(a, b) for a, b in labels], "doc_id long, quality int")).collect()]
    assert np.allclose(sorted(got), sorted(want), atol=2e-5)
