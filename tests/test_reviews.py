"""Rows written by hand for the review and export operators."""

from pyspark.sql import functions as F

from folioforge.operators import exports, reviews

NAMES = {
    "con": "_con",
    "CON.txt": "_CON.txt",
    "Com1 . x": "_Com1 . x",
    "console": "console",
    'a/b:c*?"<>|d': "a_b_c_d",
    "  two \t\n words .. ": "two _ words",
    " . ": "novel",
    "": "novel",
    "café": "café",
    "章" * 31: "章" * 30,
    "a" + "章" * 31: "a" + "章" * 29,
    "x" * 95: "x" * 90,
}


def test_safe_names(spark):
    rows = spark.createDataFrame([*[(n,) for n in NAMES], (None,)], "name string")
    got = {r["name"]: r["safe"] for r in exports.safe_name(rows, "name").collect()}
    assert got == NAMES | {None: None}


def test_cutting_lays_a_reserved_name_bare(spark):
    rows = spark.createDataFrame([("con x",)], "name string")
    assert exports.safe_name(rows, "name", 4).first()["safe"] == "_con"


def test_names_that_clash_are_numbered_without_case(spark):
    rows = spark.createDataFrame([(1, "Book"), (2, "book"), (3, "BOOK"), (4, "other")], "id int, safe string")
    assert {r["id"]: r["placed"] for r in exports.unique_names(rows, "id").collect()} == {1: "Book", 2: "book-2", 3: "BOOK-3", 4: "other"}


def test_export_identity(spark):
    columns = "book_id int, source string, explicit_title string, profile_title string, about string, characters array<string>, opening string"
    books = [
        (1, "raw name", None, None, None, None, None),
        (2, "raw name", " Set Title ", "Other", "", [], ""),
        (3, "长夜行（改版）", None, "夜色渐深", "", [], "夜色渐深"),
        (4, "夜色渐深", None, "夜色渐深记", "", [], "夜色渐深记"),
        (5, "book", None, "夜色渐深", "", [], "《夜色【渐深》"),
        (6, "book", None, "夜色渐深", "", [" 林某 "], "林某来了"),
        (7, "www.x.com", None, "夜色渐深", "", [], ""),
        (8, "book", None, "夜色渐深", "", ["林"], "林某来了"),
    ]
    got = {r["book_id"]: (r["title"], r["rename_applied"], r["reason"]) for r in exports.export_identity(spark.createDataFrame(books, columns)).collect()}
    assert got == {
        1: ("raw name", False, "no_title"),
        2: ("Set Title", True, "explicit"),
        3: ("长夜行（改版）", False, "variant"),
        4: ("夜色渐深", False, "close"),
        5: ("夜色渐深", True, "verified"),
        6: ("夜色渐深", True, "verified"),
        7: ("夜色渐深", True, "verified"),
        8: ("book", False, "unsupported"),
    }


def test_pages_are_filled_in_order(spark):
    sized = spark.createDataFrame([(1, 1, 60), (1, 2, 40), (1, 3, 1), (1, 4, 200), (1, 5, 5), (2, 1, 200)], "book_id int, rank int, bytes int")
    got = {(r["book_id"], r["rank"]): (r["page"], r["oversize"]) for r in reviews.pages(sized, 100).collect()}
    assert got == {(1, 1): (1, False), (1, 2): (1, False), (1, 3): (2, False), (1, 4): (3, True), (1, 5): (4, False), (2, 1): (1, True)}


def test_verdicts_of_groups_reach_only_members_that_are_unchanged(spark):
    member = "array<struct<candidate_id: string, fingerprint: string>>"
    found = spark.createDataFrame([(1, "g1", True, [("a", "f1"), ("b", "f2")]), (1, "g2", False, [("c", "f3")]), (1, "g3", True, [("b", "f2")])], f"book_id int, group_id string, delete_allowed boolean, members {member}")
    candidates = spark.createDataFrame([(1, "a", "f1"), (1, "b", "f2"), (1, "c", "changed")], "book_id int, candidate_id string, fingerprint string")
    verdicts = spark.createDataFrame([(1, "g1", "delete"), (1, "g2", "keep"), (1, "g3", "keep")], "book_id int, group_id string, verdict string")
    assert [tuple(r) for r in reviews.expand(found, verdicts, candidates).select("candidate_id", "verdict").collect()] == [("a", "delete")]
    refused = spark.createDataFrame([(1, "g2", "delete")], "book_id int, group_id string, verdict string")
    assert reviews.expand(found, refused, candidates.withColumn("fingerprint", F.lit("f3"))).isEmpty()


def test_residuals_count_each_kept_text_once(spark):
    found = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "x")], "book_id int, text string")
    kept = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "book_id int, text string")
    got = sorted((r["book_id"], r["residual"]) for r in reviews.residuals(found, kept).collect())
    assert got == [(1, 1), (2, 1)]
