"""Near repetitions of which more share a SimHash band than one tile or one page holds, against brute force."""

import hashlib
import random
from itertools import combinations

import pytest

from folioforge.functions import rules as R
from folioforge.operators import scan
from folioforge.plans import scan_queries

STOCK = "the lamp in the harbour house burned through the whole of that long winter night and nobody came to put it out"


def grams(k):
    return ({k} if len(k) <= 3 else {k[i : i + 3] for i in range(len(k) - 2)}) if k else set()


def simhash(k):
    votes = [0] * 64
    for g in grams(k):
        digest = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest())
        for b in range(64):
            votes[b] += digest >> b & 1
    return sum(1 << b for b in range(64) if votes[b] * 2 > len(grams(k)))


def links(keys):
    """The pairs of keys that share a band and are alike, and the most keys that share one."""
    sims, sets = [simhash(k) for k in keys], [grams(k) for k in keys]
    bands = [[s >> 16 * b & 0xFFFF for b in range(4)] for s in sims]
    most = max(sum(x[b] == y[b] for x in bands) for y in bands for b in range(4))
    found = set()
    for i, j in combinations(range(len(keys)), 2):
        if any(x == y for x, y in zip(bands[i], bands[j])) and ((sims[i] ^ sims[j]).bit_count() <= R.SIMHASH_DISTANCE or len(sets[i] & sets[j]) > R.NEAR_JACCARD * len(sets[i] | sets[j])):
            found.add((i, j))
    return found, most


@pytest.fixture(scope="module")
def keys():
    """Variants of one line, from one letter to a third of it, among lines that are not like it."""
    r = random.Random(5)
    made = dict.fromkeys(STOCK + a + b for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst")
    for _ in range(150):
        at, n = r.randrange(60), r.randrange(1, 40)
        made[STOCK[:at] + "".join(r.choice("xyz") for _ in range(n)) + STOCK[at + n :]] = None
    for _ in range(40):
        made["".join(r.choice("abcdefgh ") for _ in range(r.randrange(20, 200)))] = None
    made = list(made)
    r.shuffle(made)
    return made


@pytest.mark.parametrize("tile", [None, 7])
def test_all_links_of_a_band_are_found(spark, monkeypatch, keys, tile):
    if tile:
        monkeypatch.setattr(scan, "TILE", tile)
    want, most = links(keys)
    rows = [(1, i, k) for i, k in enumerate(keys)] + [(2, 5, keys[0]), (2, 9, keys[1])]
    got = [(r.book_id, r.start_offset, r.o_start_offset) for r in scan.near_pairs(spark.createDataFrame(rows, "book_id long, start_offset long, key string")).collect()]
    assert most > 200 and len(got) == len(set(got))
    assert {g[1:] for g in got if g[0] == 1} == want and {g for g in got if g[0] == 2} <= {(2, 5, 9)}


def test_copies_are_members_of_their_first(spark):
    """300 copies of two lines that are alike: each copy is linked to the first of its key, and the two firsts to each other."""
    rows = [(1, 10 * i, STOCK + "ab"[i % 2]) for i in range(600)] + [(2, 3, STOCK + "a")]
    table = spark.createDataFrame(rows, "book_id long, start_offset long, key string").repartition(4)
    got = {(r.start_offset, r.o_start_offset, r.link) for r in scan.near_pairs(table).collect()}
    assert got == {(0, 10, "near"), *((10 * (i % 2), 10 * i, "copy") for i in range(2, 600))}
    assert {(r.book_id, r.start_offset, r.root) for r in scan.components(scan.near_pairs(table)).collect()} == {(1, 10 * i, 0) for i in range(600)}


def test_lsh_pairs_has_a_band_of_more_than_200(spark, tmp_path):
    lines = [f"{STOCK} {a}{b}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"]
    spark.createDataFrame([(0, "\n".join(lines), "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = scan_queries.QUERIES["lsh_pairs"](spark, str(tmp_path)).where("link = 'near'").collect()
    want, most = links([(STOCK + a + b).replace(" ", "") for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"])
    assert most > 200 and len(rows) == len(want) > 20_000
