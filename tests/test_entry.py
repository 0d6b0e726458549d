import glob
import os

import pytest

DATA = "/root/testdata/sf0.001"
FAST = ["line_offsets", "repetition_key", "heading_match", "cn_number", "slices", "slice_tiling_check", "structure_confidence", "newline_normalize", "bracket_issues", "blank_collapse", "safe_punctuation", "layout_normalize", "markdown_export", "review_violations", "overlap_check", "wilson", "corpus_rollup"]


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, duck, name):
    import __spark_entry__ as entry

    got = entry.queries()[name](spark, DATA)
    want = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, want.fetchall())


def test_names_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
