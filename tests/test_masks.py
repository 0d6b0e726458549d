"""Spans of masks and separated words, with rows written by hand."""

from folioforge.operators import layout


def spans(spark, rows, **limits):
    lines = spark.createDataFrame(rows, "book_id long, line_no long, raw string, start long, extra string")
    found = layout.mask_spans(lines, **limits)
    assert found.columns == ["book_id", "line_no", "id", "mask_type", "start", "end", "original", "prefix", "suffix"]
    return [tuple(r)[1:] for r in found.orderBy("book_id", "id").collect()]


def test_masks_come_before_separators_and_contexts_cross_lines(spark):
    rows = [(1, 1, "他是人·类", 0, "x"), (1, 2, "", 6, "x"), (1, 3, "那个*人**了", 7, "x"), (1, 4, None, 15, "x")]
    assert spans(spark, rows) == [
        (3, "BW-0001", "mask_chars", 9, 10, "*", "他是人·类\n\n那个", "人**了\n"),
        (3, "BW-0002", "mask_chars", 11, 13, "**", "是人·类\n\n那个*人"[-10:], "了\n"),
        (1, "BW-0003", "word_separator", 2, 5, "人·类", "他是", "\n\n那个*人**了\n"[:10]),
    ]


def test_a_mask_that_is_a_character_too(spark):
    got = spans(spark, [(1, 1, "人X口X人口X", 0, None)])
    assert [(a, b, c) for _, _, _, a, b, c, _, _ in got] == [(1, 2, "X"), (2, 4, "口X"), (5, 7, "口X")]


def test_the_limit_counts_by_book_and_empty_tables_are_empty(spark):
    rows = [(b, 1, "一**二xx三.四", 0, None) for b in (1, 2)]
    assert [(r[1], r[5]) for r in spans(spark, rows, most=2)] == [("BW-0001", "**"), ("BW-0002", "xx")] * 2
    assert spans(spark, []) == []
