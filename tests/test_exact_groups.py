"""Exact repetition names the members of its groups, in order."""

import glob

import pytest

from folioforge.operators import scan, structure
from folioforge.plans import scan_queries


def test_groups_hold_all_members_in_order(spark):
    again, twice = "the same words again and again", "words that stand here two times"
    text = "\n".join([again, "other words of this book here", again.upper(), twice, *[again] * 5, twice])
    lines = structure.lines_of_texts(spark.createDataFrame([(1, text), (2, again)], "book_id long, text string"))
    starts = [i for i in range(len(text)) if text[i:].lower().startswith(again)]
    want = [(a, a + len(again), text[:a].count("\n") + 1) for a in starts]
    rows = scan.exact_groups(scan.blocks(lines)).collect()
    assert [(r.book_id, r.n, r.first_start, [tuple(m) for m in r.members]) for r in rows] == [(1, 7, 0, want)]


def test_l1_exact_equals_sql(spark):
    con = pytest.importorskip("duckdb").connect()
    for path in glob.glob("/root/testdata/sf0.001/documents.parquet"):
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    found = con.execute(scan_queries.SQL["l1_exact"])
    names = [d[0] for d in found.description]
    want = sorted(found.fetchall())
    got = sorted(tuple(r) for r in scan_queries.QUERIES["l1_exact"](spark, "/root/testdata/sf0.001").select(*names).collect())
    assert got == want and "members" in names and all(r[names.index("members")].count("-") == r[names.index("n")] for r in got)
