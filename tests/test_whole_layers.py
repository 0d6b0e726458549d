"""The queries over all four layers, on a book with more near lines than one page, one SimHash band or the anchors of the SQL queries once held."""

import functools
import hashlib
from string import ascii_lowercase

import pytest
from pyspark.sql import functions as F

from folioforge.functions import rules as R
from folioforge.operators import scan, structure
from folioforge.plans import edit_queries, scan_queries
from folioforge.plans.corpus import book_lines

LINE = "请访问www.biquge.com阅读最新章节 the lamp in the harbour house burned through the whole of that long winter night and nobody came "
TAIL = "to put it out until the keeper of the old mill had walked along the frozen river and called the others from their warm beds to see what it meant "
LETTERS = "abcdefghijklmnopqrst"
NEAR = [LINE + a + b for a in LETTERS for b in LETTERS]


def written(spark, path, lines):
    spark.createDataFrame([(0, "\n".join(lines), "s"), (1, "words", "s")], "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("near"), NEAR)


@pytest.fixture(scope="module")
def plain(spark, tmp_path_factory):
    """The same book without the near lines."""
    return written(spark, tmp_path_factory.mktemp("plain"), ["w"])


def rows_of(spark, path, name):
    return scan_queries.QUERIES[name](spark, path).collect()


def test_pages_hold_one_candidate_for_all_near_lines(spark, table, plain):
    """F8: page_integrity_whole, and all anchors of the group."""
    n = len(rows_of(spark, plain, "candidate_rank_whole")) + 1
    assert len(rows_of(spark, table, "page_integrity_whole")) == -(-n // 10)
    group = scan_queries.ranked_whole(spark, table).where("layer = 'L2'").collect()
    assert [(len(g.anchors), g.occurrence_count, g.anchors_truncated) for g in group] == [(len(NEAR), len(NEAR), False)] and len(NEAR) > R.MAX_ANCHORS


def test_ids_of_more_than_four_digits_differ(spark, monkeypatch):
    taken = spark.range(10_010).selectExpr("0L book_id", "'L3' layer", "cast(id as string) `group`", "id start_offset", "id + 1 end_offset", "id line_no", "lpad(id, 6, '0') stripped", "array('watermark') signals", "cast(null as string) mutation_guard")
    monkeypatch.setattr(scan, "cascade", lambda lines: taken)
    ids = scan_queries.ranked_whole(spark, "/root/testdata/sf0.001").agg(F.countDistinct("candidate_id"), F.max(F.length("candidate_id"))).first()
    assert tuple(ids) == (10_010, 8)


@pytest.fixture(scope="module")
def cached(spark, tmp_path_factory):
    """The ranked candidates of a book in which 676 near lines share their bands, its text, and where those lines lie."""
    near = [LINE + TAIL + a + b for a in ascii_lowercase for b in ascii_lowercase]
    path = written(spark, tmp_path_factory.mktemp("bands"), near)
    rows = scan_queries.ranked_whole(spark, path).cache()
    lines = {r.line_no: r for r in structure.line_offsets(book_lines(spark, path)).collect()}
    return path, rows, lines, {n for n, r in lines.items() if r.stripped in set(near)}


def run(spark, cached, name):
    """The rows of a query's `_whole` form over the candidates at hand."""
    f = (scan_queries.QUERIES | edit_queries.QUERIES)[f"{name}_whole"]
    return (f.func if isinstance(f, functools.partial) else f)(spark, cached[0], layers=lambda *_: cached[1]).collect()


def spliced(cached, but=()):
    """The book without what deletes take, by hand; and its operations."""
    _, rows, lines, _ = cached
    text = "\n".join(lines[n].raw for n in sorted(lines))
    ops = []
    for r in rows.collect():
        if r.rank % 5 and r.strength == "strong" and r.risk == "low" and r.candidate_id not in but:
            for a in r.anchors:
                x = lines[a.line_no]
                more = a.line_no < len(lines)
                ops.append((x.start, x.start + len(x.raw) + more, "") if r.rank % 3 == 1 else (a.start_offset, a.end_offset, "\n" if r.rank % 3 == 2 else ""))
    for s, e, new in sorted(ops, reverse=True):
        text = text[:s] + new + text[e:]
    return text, ops


def group(cached):
    """The one candidate that holds all near lines."""
    found = [r for r in cached[1].collect() if r.layer == "L2"]
    assert [{a.line_no for a in r.anchors} for r in found] == [cached[3]] and len(cached[3]) == 676
    return found[0]


def test_f1_apply_splice(spark, cached):
    group(cached)
    text, ops = spliced(cached)
    got = run(spark, cached, "apply_splice")
    assert [(r.md5, r.n_chars) for r in got] == [(hashlib.md5(text.encode()).hexdigest(), len(text))] and LINE not in text and len(ops) >= 676


def test_f2_candidate_rank(spark, cached):
    assert [(r.occurrence_count, r.rank) for r in run(spark, cached, "candidate_rank") if r.layer == "L2"] == [(676, group(cached).rank)]


def test_f3_compile_decisions(spark, cached):
    got = {r.candidate_id: (r.occurrence_count, r.verdict) for r in run(spark, cached, "compile_decisions")}
    assert got[group(cached).candidate_id] == (676, "delete") and len(got) == cached[1].count()


def test_f6_offset_remap(spark, cached):
    group(cached)
    _, ops = spliced(cached)
    got = {r.line_no: r.new_offset for r in run(spark, cached, "offset_remap")}
    for n, x in cached[2].items():
        hit = any(s < x.end_offset and e > x.start_offset for s, e, _ in ops)
        assert got[n] == (None if hit else x.start_offset + sum(len(new) - e + s for s, e, new in ops if e <= x.start_offset))
    assert all(got[n] is None for n in cached[3])


def test_f7_overlap_check(spark, cached, monkeypatch):
    """None as they are; and by hand if each operation is stretched by 40 characters, as overlap_check does."""
    name = group(cached).candidate_id
    monkeypatch.setattr(edit_queries, "ranked_whole", lambda *_: cached[1])
    assert edit_queries.overlap_check_whole(spark, cached[0]).isEmpty()
    ops = sorted((s, e + 40) for s, e, _ in spliced(cached)[1])
    want = [(s, max(e for _, e in ops[:i])) for i, (s, _) in enumerate(ops) if i and s < max(e for _, e in ops[:i])]
    got = edit_queries.overlap_check(spark, cached[0], layers=lambda *_: cached[1]).collect()
    assert sorted((r.op_start, r.reach) for r in got) == want and sum(r.candidate_id == name for r in got) > 600


def test_f9_page_manifest(spark, cached):
    ranks = sorted(cached[1].collect(), key=lambda r: r.rank)
    group(cached)
    want = {i // 10 + 1: hashlib.sha256("\n".join(f"{r.candidate_id}|{r.sample}" for r in ranks[i : i + 10]).encode()).hexdigest() for i in range(0, len(ranks), 10)}
    assert {r.page: r.page_sha256 for r in run(spark, cached, "page_manifest")} == want


def test_f10_review_coverage(spark, cached):
    group(cached)
    want = [(f"AD-{n:04d}", "missing" if n % 11 == 0 else "duplicate") for n in range(1, cached[1].count() + 1) if n % 11 == 0 or n % 13 == 0]
    assert sorted((r.candidate_id, r.problem) for r in run(spark, cached, "review_coverage")) == sorted([*want, ("AD-none", "unexpected")])


def test_f11_rollback_point(spark, cached):
    group(cached)
    text, _ = spliced(cached, but=("AD-0001",))
    assert [r.md5 for r in run(spark, cached, "rollback_point")] == [hashlib.md5(text.encode()).hexdigest()]
