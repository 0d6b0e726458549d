"""Slices and drafts look at the lines as often as they need to and no more, with the same parts and neighbours."""

import random

from folioforge.functions import rules as R
from folioforge.operators import scan, structure
from folioforge.plans import draft_queries
from folioforge.plans.corpus import book_lines


def test_slices_are_made_of_an_outline(spark):
    """Neither the headings nor the sizes are looked for in the lines again."""
    plan = structure.slices(book_lines(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" not in plan and "LogicalRDD" in plan


def test_slices_of_odd_books(spark):
    """Blank lines around, a book without headings, a blank one, and a long one with little confidence."""
    plain = "\n".join("plain words of a long book without chapters" for _ in range(3000))
    texts = {1: "\n front \n\n第1章 a\nwords\n\n第2章 b\n\n \n", 2: "no heading here\n\n", 3: "\n", 4: plain, 5: "第1章 a"}
    lines = structure.lines_of_texts(spark.createDataFrame(list(texts.items()), "book_id long, text string"))
    parts = structure.slices(lines)
    valid = {r.book_id: r.valid for r in structure.tiling_check(parts, structure.book_sizes(lines)).collect()}
    assert len(plain) >= R.FALLBACK_TEXT and valid == dict.fromkeys(texts, True)
    kinds = {}
    for r in parts.orderBy("book_id", "slice_start").collect():
        kinds.setdefault(r.book_id, []).append(r.kind)
    assert set(kinds.pop(4)) == {"fallback_chunk"}
    assert kinds == {1: ["front_matter", "chapter", "chapter"], 2: ["body"], 3: ["body"], 5: ["chapter"]}
    found = {(r.book_id, r.chapter_index): (r.start_offset, r.chapter_end, r.size) for r in structure.chapters(lines).collect()}
    first, second = texts[1].index("第1"), texts[1].index("第2")
    assert found == {(1, 1): (first, second, len("第1章 a\nwords")), (1, 2): (second, len(texts[1]), len("第2章 b")), (5, 1): (0, 5, 5)}


def test_features_scan_for_blocks_once(spark, monkeypatch):
    calls, plain = [], structure.line_offsets
    monkeypatch.setattr(structure, "line_offsets", lambda lines: calls.append(1) or plain(lines))
    draft_queries.featured(spark, "/root/testdata/sf0.001")
    assert len(calls) == 2  # for blocks, and for the outline


def test_neighbours_by_brute_force(spark):
    r = random.Random(11)
    pick = ("", " ", "a plain line of words", "请访问www.biquge.com阅读最新章节", "加入QQ群:88481234获取更新通知", "第1章 a", "求收藏求推荐")
    lines = structure.lines_of_texts(spark.createDataFrame([(b, "\n".join(r.choice(pick) for _ in range(150))) for b in range(4)], "book_id long, text string")).cache()
    found, parts = scan.blocks_in_order(lines).cache(), structure.slices(lines).cache()
    rows = {(x.book_id, x.line_no): x for x in found.collect()}
    blank = {(x.book_id, x.line_no) for x in lines.collect() if not x.raw.strip()}
    own = lambda x: next((p.slice_index for p in tiles if p.book_id == x.book_id and p.slice_start <= x.start_offset < p.slice_end), -1)
    tiles = parts.collect()
    want = set()
    for (b, n), x in rows.items():
        for d in (1, 2):
            y = rows.get((b, n + d))
            if y and x.signals and y.signals and own(x) == own(y) and set(R.NEIGHBOR) & {*x.signals, *y.signals} and (d == 1 or (b, n + 1) in blank):
                want.add((b, n, n + d, d, y.stripped))
    got = [(x.book_id, x.line_no, x.n_line_no, x.distance, x.n_stripped) for x in scan.neighbour_pairs(found, parts).collect()]
    assert set(got) == want and len(got) == len(want) and {d for *_, d, _ in want} == {1, 2}
    assert found.drop("nth").exceptAll(scan.blocks(lines)).isEmpty()
