"""The state of books: stages and what a change invalidates, terminal status, latest attempts, and rollbacks of a chapter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.operators import scan

# The stages in the order in which they run, and those that only follow the texts before layout.
STAGES = ("0_preprocess", "1_parse_structure", "2_ads", "3_titles", "4_blocked_words", "5_layout", "6_verify", "7_export", "dry_run", "review")
BEFORE_LAYOUT = ("dry_run",)


def downstream(stage: str) -> list[str]:
    """The stages that a change of `stage` makes stale: all after it, but from the layout on not those that follow the texts before it."""
    if stage.startswith("rollback_all"):
        return list(STAGES)
    if stage.startswith("rollback_ads"):
        return list(STAGES[2:])
    if stage not in STAGES[:8]:
        return []
    at = STAGES.index(stage)
    return [s for s in STAGES[at + 1 :] if at < STAGES.index("5_layout") or s not in BEFORE_LAYOUT]


def invalidated(changes: DataFrame) -> DataFrame:
    """changes: book_id, stage. Every stage of a book that any of its changes makes stale."""
    names = (*STAGES[:8], "rollback_all", "rollback_ads")
    targets = F.create_map(*[x for s in names for x in (F.lit(s), F.array(*[F.lit(t) for t in downstream(s)]))])
    return changes.select("book_id", F.explode(F.try_element_at(targets, F.col("stage"))).alias("stale")).distinct()


def terminal_status(unchanged: Column, preprocess: Column, verify: Column, warnings: Column, ads: Column, titles: Column, blocked: Column) -> Column:
    """How a book's work ended, by the first rule that fits. The arguments are the stages' statuses, null for pending."""
    or_pending = lambda c: F.coalesce(c, F.lit("pending"))
    bad = ("blocked", "failed")
    report = or_pending(titles).isin("candidates_ready", "done") | or_pending(blocked).isin("candidates_ready", "done")
    return (
        F.when(~unchanged | or_pending(preprocess).isin(*bad) | or_pending(verify).isin(*bad), "blocked")
        .when(or_pending(verify) == "incomplete", "incomplete")
        .when(warnings > 0, "needs_review")
        .when(or_pending(verify) == "passed", "completed")
        .when(or_pending(ads).isin("pending", "skipped") & report, "report_only")
        .otherwise("needs_review")
    )


def latest(attempts: DataFrame) -> DataFrame:
    """attempts: book_id, attempt, status. The last attempt of each book, and its last success (null without one)."""
    done = F.when(F.col("status") == "completed", F.col("attempt"))
    return attempts.groupBy("book_id").agg(F.max("attempt").alias("latest_attempt"), F.max_by("status", "attempt").alias("latest_status"), F.max(done).alias("latest_success"))


def without_chapter(operations: DataFrame, parts: DataFrame, chapter: int) -> DataFrame:
    """The operations that stay when those in one chapter are rolled back."""
    rows = scan.with_slice(operations.withColumn("start_offset", F.col("op_start")), parts)
    inside = (F.col("slice.kind") == "chapter") & (F.col("slice.slice_index") == chapter)
    return rows.where(~F.coalesce(inside, F.lit(False))).select(*operations.columns)
