"""The queries that their SQL cannot follow, against brute force over a small table."""

import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from folioforge.functions import text as X
from folioforge.plans import edit_queries, scan_queries
from folioforge.plans.corpus import book_lines

NEAR = "the lamp in the harbour house burned through the whole of that long winter night and nobody came to put it ou"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Three lines that differ in their last letter, without signals, far apart in one book, among 40 others."""
    lines = [f"{chr(97 + i % 26) * 3} {i * 7919} {chr(98 + i % 24) * 2}" for i in range(40)]
    texts = ["\n".join([NEAR + "t", *lines[:20]]), "\n".join([NEAR + "d", *lines[20:]]), NEAR + "r"]
    path = str(tmp_path_factory.mktemp("small"))
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    return path


def test_all_lines_of_a_book_are_paired(spark, table):
    rows = scan_queries.folded(spark, table).select("book_id", "line_no", X.repetition_key(F.col("folded")).alias("key")).collect()
    grams = {(r.book_id, r.line_no): {r.key} if len(r.key) <= 3 else {r.key[i : i + 3] for i in range(len(r.key) - 2)} for r in rows if r.key}
    want = {}
    for a, b in combinations(sorted(grams), 2):
        if a[0] == b[0] and grams[a] & grams[b]:
            want[(*a, b[1])] = round(len(grams[a] & grams[b]) / len(grams[a] | grams[b]), 6)
    got = {(r.book_id, r.line_no, r.other_line): round(r.jaccard, 6) for r in scan_queries.QUERIES["ngrams_jaccard_whole"](spark, table).collect()}
    assert got == want
    assert any(b - a > 30 for _, a, b in got) and any(len(r.key) > 40 for r in rows)


def test_near_repetitions_are_ranked(spark, table):
    rows = scan_queries.QUERIES["candidate_rank_whole"](spark, table).where("layer = 'L2'").collect()
    assert [(r.occurrence_count, r.sample) for r in rows] == [(3, NEAR + "t")]
    paged = scan_queries.QUERIES["page_manifest_whole"](spark, table).agg(F.sum("record_count")).first()[0]
    assert paged == scan_queries.QUERIES["candidate_rank"](spark, table).count() + 1


def test_operators_run_over_the_whole_table(spark, table):
    lines = {(r.book_id, r.line_no): r.raw for r in book_lines(spark, table).collect()}
    marks = {",": "，", ".": "。", "!": "！", "?": "？", ":": "：", ";": "；"}
    got = {(r.book_id, r.line_no): r.line for r in edit_queries.QUERIES["safe_punctuation"](spark, table).collect()}
    assert got.keys() == lines.keys()
    for k, raw in lines.items():
        assert len(got[k]) == len(raw) and all(a == b or marks.get(a) == b for a, b in zip(raw, got[k]))
    kept, before = {}, {}
    for k, raw in sorted(lines.items()):
        blank = not raw.strip()
        if not (blank and before.get(k[0])):
            kept[k] = "" if blank else raw
        before[k[0]] = blank
    assert {(r.book_id, r.line_no): r.raw for r in edit_queries.QUERIES["blank_collapse"](spark, table).collect()} == kept
    numbers = scan_queries.QUERIES["cn_number"](spark, table).collect()
    assert len(numbers) == scan_queries.QUERIES["heading_match"](spark, table).count() > 0
    assert all(r.number == int(r.numeral) for r in numbers if re.fullmatch("[0-9]+", r.numeral or ""))


def test_reviews_and_operations_of_the_whole_table(spark, table):
    ranks = [(r.book_id, r.candidate_id) for r in scan_queries.ranked_whole(spark, table).where("rank % 7 = 0").collect()]
    got = edit_queries.QUERIES["review_violations_whole"](spark, table).collect()
    assert sorted((r.book_id, r.candidate_id) for r in got) == sorted(ranks) and all(r.violations == "verdict" for r in got)
    operations = edit_queries.QUERIES["op_build_whole"](spark, table).collect()
    want = [a for a in operations if any(b.book_id == a.book_id and (b.op_start, b.op_end, b.candidate_id) < (a.op_start, a.op_end, a.candidate_id) and b.op_end > a.op_start for b in operations)]
    assert edit_queries.QUERIES["overlap_check_whole"](spark, table).count() == len(want)
