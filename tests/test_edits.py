from pyspark.sql import functions as F

from folioforge.functions import text as X
from folioforge.operators import edits, layout, structure


def test_overlap_blocks_the_whole_book(spark):
    texts = spark.createDataFrame([(1, "abcdefghij"), (2, "abcdefghij"), (3, "same")], "book_id long, text string")
    ops = spark.createDataFrame([(1, "A", 2, 4, "cd", ""), (1, "B", 6, 7, "g", "\n"), (2, "A", 2, 5, "cde", ""), (2, "B", 4, 6, "ef", "")], "book_id long, candidate_id string, op_start long, op_end long, original string, replacement string")
    got = {r.book_id: r.text for r in edits.apply_operations(texts, ops).collect()}
    assert got == {1: "abef\nhij", 2: "abcdefghij", 3: "same"}
    assert all(r.replayed for r in edits.replay(texts, ops, edits.apply_operations(texts, ops)).collect())


def test_fold_and_heading(spark):
    rows = spark.createDataFrame([("ＡＢ　c 点 com",), ("第十二章　起风了",), ("Chapter 7: Rain",), ("“第三章”他说",), ("1、开始",), ("第三章。结束",), (None,)], "line string")
    got = rows.select(X.match_fold(F.col("line")).alias("f"), X.heading(F.col("line")).alias("h")).collect()
    assert got[0].f == "abc.com"
    assert [(r.h.label, r.h.number, r.h.rest) if r.h else None for r in got] == [None, ("第十二章", "十二", "起风了"), ("Chapter7", "7", "Rain"), None, ("1、", "1", "开始"), None, None]


def test_empty_tables(spark):
    lines = spark.createDataFrame([], "book_id long, line_no long, raw string, start long")
    assert structure.chapters(lines).count() == 0
    assert structure.slices(lines).count() == 0
    assert layout.collapse_blank(lines).count() == 0
