"""Registered queries of the catalog operators, with DuckDB SQL. Books' changes, statuses and attempts are made of their numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.operators import catalog, edits, structure
from folioforge.plans.edit_queries import DECIDED, applied
from folioforge.plans.scan_queries import q

QUERIES: dict = {}
SQL: dict[str, str] = {}
_CHANGED = (*catalog.STAGES[:8], "rollback_all", "rollback_ads")
_VERIFY = ("passed", "blocked", "incomplete", "pending", "failed")
_ADS = ("pending", "done", "skipped")


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _pick(values, number):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


_LIST = lambda values: "[" + ", ".join(q(v) for v in values) + "]"
_ORDER = ", ".join(f"({i}, {q(s)})" for i, s in enumerate(catalog.STAGES))


@register("invalidation", f"""WITH o AS (SELECT * FROM (VALUES {_ORDER}) AS t(i, s)), c AS (SELECT doc_id AS book_id, ({_LIST(_CHANGED)})[doc_id % {len(_CHANGED)} + 1] AS stage FROM documents)
SELECT book_id, o.s AS stale FROM c LEFT JOIN o AS own ON own.s = c.stage JOIN o ON CASE c.stage WHEN 'rollback_all' THEN true WHEN 'rollback_ads' THEN o.i >= 2 ELSE o.i > own.i AND NOT (own.i >= 5 AND o.s = 'dry_run') END""")
def invalidation(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("book_id"), _pick(_CHANGED, F.col("doc_id")).alias("stage"))
    return catalog.invalidated(rows)


@register("terminal_status", f"""WITH s AS (SELECT doc_id AS book_id, doc_id % 11 <> 0 AS same, CASE WHEN doc_id % 13 = 0 THEN 'blocked' ELSE 'done' END AS pre, ({_LIST(_VERIFY)})[doc_id % 5 + 1] AS ver, doc_id % 17 = 0 AS warned,
  ({_LIST(_ADS)})[doc_id % 3 + 1] AS ads, doc_id % 2 = 0 AS titled FROM documents)
SELECT book_id, CASE WHEN NOT same OR pre = 'blocked' OR ver IN ('blocked', 'failed') THEN 'blocked' WHEN ver = 'incomplete' THEN 'incomplete' WHEN warned THEN 'needs_review' WHEN ver = 'passed' THEN 'completed'
  WHEN ads <> 'done' AND titled THEN 'report_only' ELSE 'needs_review' END AS status FROM s""")
def terminal_status(spark, sf_dir):
    n = F.col("doc_id")
    status = catalog.terminal_status(n % 11 != 0, F.when(n % 13 == 0, "blocked").otherwise("done"), _pick(_VERIFY, n), F.when(n % 17 == 0, 2).otherwise(0), _pick(_ADS, n), F.when(n % 2 == 0, "candidates_ready"), F.lit(None).cast("string"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(n.alias("book_id"), status.alias("status"))


@register("latest_pointers", """WITH a AS (SELECT doc_id // 20 AS book_id, doc_id AS attempt, CASE doc_id % 7 WHEN 3 THEN 'completed' WHEN 4 THEN 'blocked' ELSE 'needs_review' END AS status FROM documents)
SELECT book_id, max(attempt) AS latest_attempt, arg_max(status, attempt) AS latest_status, max(attempt) FILTER (WHERE status = 'completed') AS latest_success FROM a GROUP BY book_id""")
def latest_pointers(spark, sf_dir):
    n = F.col("doc_id")
    status = F.when(n % 7 == 3, "completed").when(n % 7 == 4, "blocked").otherwise("needs_review")
    return catalog.latest(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.floor(n / 20).alias("book_id"), n.alias("attempt"), status.alias("status")))


@register("rollback_chapter", f"""{DECIDED}, k AS (SELECT op.* FROM op WHERE NOT EXISTS (SELECT 1 FROM sl WHERE sl.book_id = op.book_id AND kind = 'chapter' AND slice_index = 2 AND op_start >= slice_start AND op_start < slice_end)),
r AS (SELECT k.*, coalesce(lag(op_end) OVER (PARTITION BY book_id ORDER BY op_start), 0) AS kept_from FROM k)
SELECT book_id, md5(coalesce((SELECT string_agg(substring(text, kept_from + 1, op_start - kept_from) || replacement, '' ORDER BY op_start) || substring(text, max(op_end) + 1) FROM r WHERE r.book_id = tx.book_id), text)) AS md5 FROM tx""")
def rollback_chapter(spark, sf_dir):
    lines, _, operations = applied(spark, sf_dir)
    rest = catalog.without_chapter(operations, structure.slices(lines), 2)
    return edits.apply_operations(structure.texts_of_lines(lines), rest).select("book_id", F.md5("text").alias("md5"))
