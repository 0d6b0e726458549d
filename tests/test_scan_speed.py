"""The quick forms of folding, tagging and near pairing against the plain ones, over odd texts; and that each step is planned once."""

import hashlib
import random
import re
import unicodedata
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from folioforge.functions import rules as R
from folioforge.functions import text as X
from folioforge.operators import scan
from folioforge.plans import edit_queries, scan_queries

PARTS = (
    *("abc", "Ps", "WWW.", "x.COM", "a@b.io", " ", "\t", "\x1c", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u205f", "　", "…", "ＷＷＷ．ｘ．ｃｎ", "３", "12", "é", "·", "①", "ﬁ", "𝟗", "𠀀", "İ", "Σ"),
    *("点", "。", "笔趣阁", "uu看书", "九霄小说", "69书吧", "搜书", "整理组", "本书由某某手打", "转自", "来源：某论坛", "求收藏", "打赏", "第三章", "一二三", "QQ群:12345", "微信abcd", "欢迎捧场", "下载地址", "仅供学习交流", "://", "“", "”"),
)


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(7)
    texts = ["", " ", *PARTS, *("".join(r.choice(PARTS) for _ in range(r.randint(1, 9))) for _ in range(1500))]
    return spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4).cache()


def test_quick_folds_are_the_plain_ones(odd):
    def plain(x):
        x = re.sub(rf"([A-Za-z0-9]){WS}*(?:点|點|．|。){WS}*([A-Za-z0-9])", r"\1.\2", unicodedata.normalize("NFKC", x))
        return re.sub(rf"{WS}+", "", x)

    WS = re.sub(r"\\x\{([0-9a-f]{4})\}", lambda m: "\\u" + m[1], R.WS)
    folded = X.match_fold(F.col("t"))
    key = F.lower(F.regexp_replace(F.regexp_replace("f", rf"{R.WS}+", ""), "[0-9零〇一二两三四五六七八九十百千万]+", "#"))
    rows = odd.select("t", X.strip(F.col("t")).alias("s"), X.strip_left(F.col("t")).alias("l"), folded.alias("f")).withColumn("k", X.repetition_key(F.col("f"))).withColumn("want_k", key).collect()
    for r in rows:
        assert r.s == re.sub(rf"^{WS}+|{WS}+\Z", "", r.t) and r.l == re.sub(rf"^{WS}+", "", r.t)
        assert r.f.lower() == r.f and (r.f == plain(r.t).lower() or not {"İ", "Σ"}.isdisjoint(r.t))
        assert r.k == r.want_k


def test_signals_need_a_trace(odd):
    folded = odd.select(X.match_fold(F.col("t")).alias("f"))
    sites = F.exists(X.site_entities(F.col("f")), lambda e: ~F.startswith(e, F.lit("domain:")))
    plain = F.array_compact(F.array(*[F.when(F.col("f").rlike(p), k) for k, p in R.SIGNALS], F.when(sites & ~F.col("f").rlike(R.SIGNALS[5][1]), "reader_site")))
    rows = folded.select("f", X.signals(F.col("f")).alias("got"), plain.alias("want")).collect()
    assert all(r.got == r.want for r in rows)
    assert {s for r in rows for s in r.got} == {k for k, _ in R.SIGNALS} and any(not r.got for r in rows)


def test_blocks_fold_each_line_once(spark, odd):
    lines = odd.select((F.col("i") % 9).cast("long").alias("book_id"), F.col("i").cast("long").alias("line_no"), F.col("t").alias("raw"), (F.col("i") * 1000).cast("long").alias("start"))
    plan = scan.blocks(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_nfkc(") == 1
    assert scan.blocks(lines).count() > 0


def test_simhash_and_near_pairs_by_brute_force(spark):
    r = random.Random(3)
    stock = ["".join(r.choice("abcdefg 中文#") for _ in range(60)) for _ in range(6)]
    keys = ["", "a", "ab", "abc", "\x00", "a\x00", "𠀀𠀁", "aaaa", *stock, *(s[:i] + "x" + s[i + 1 :] for s in stock for i in (3, 20, 41, 58)), *(s + s[:n] for s in stock for n in (5, 15, 30))]

    def grams(k):
        return ({k} if len(k) <= 3 else {k[i : i + 3] for i in range(len(k) - 2)}) if k else set()

    def simhash(k):
        votes = [sum(int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest()) >> b & 1 for g in grams(k)) for b in range(64)]
        return sum(1 << b for b in range(64) if votes[b] * 2 > len(grams(k)))

    table = spark.createDataFrame([(1, i, k) for i, k in enumerate(keys)], "book_id long, start_offset long, key string")
    sims = {r.start_offset: r.s % 2**64 for r in table.select("start_offset", X.simhash(F.col("key")).alias("s")).collect()}
    assert sims == {i: simhash(k) for i, k in enumerate(keys)}
    want = set()
    for a, b in combinations(range(len(keys)), 2):
        shared = any(sims[a] >> 16 * k & 0xFFFF == sims[b] >> 16 * k & 0xFFFF for k in range(4))
        g, h = grams(keys[a]), grams(keys[b])
        if shared and ((sims[a] ^ sims[b]).bit_count() <= R.SIMHASH_DISTANCE or g and h and len(g & h) / len(g | h) > R.NEAR_JACCARD):
            want.add((a, b))
    got = [(r.start_offset, r.o_start_offset) for r in scan.near_pairs(table).collect()]
    assert set(got) == want and len(got) == len(want) > 20


def test_operations_are_built_from_candidates_made_once(spark):
    """The candidates are not scanned for again by each step that reads them."""
    made = edit_queries.applied(spark, "/root/testdata/sf0.001")[2]
    assert "Window" not in made._jdf.queryExecution().optimizedPlan().toString()
    plan = scan_queries.taken(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_nfkc(") == 1 and " Join " not in plan
