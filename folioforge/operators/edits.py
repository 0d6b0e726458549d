"""Decisions over candidates, operations, atomic application, replay, accounting and rollback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import rules as R
from folioforge.functions import text as X

STRATEGIES = ("exact", "fallback_newline", "remove_paragraph")
OPERATION = ("book_id", "candidate_id", "op_start", "op_end", "original", "replacement")


def review_violations(reviews: DataFrame) -> DataFrame:
    """Reviews (candidate_id, verdict, confidence, reason) that break the contract, each with all its violations."""
    checks = [
        F.when(F.col("verdict").isNull() | ~F.col("verdict").isin("delete", "keep", "uncertain"), "verdict"),
        F.when(F.col("confidence").isNull() | F.isnan("confidence") | ~F.col("confidence").between(0, 1), "confidence"),
        F.when(F.length(F.coalesce(X.strip(F.col("reason")), F.lit(""))) == 0, "reason"),
    ]
    return reviews.withColumn("violations", F.array_compact(F.array(*checks))).where(F.size("violations") > 0)


def coverage(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """Candidates without review, reviews without candidate, and candidates reviewed more than once."""
    key = ["book_id", "candidate_id"]
    missing = candidates.join(reviews, key, "left_anti").select(*key, F.lit("missing").alias("problem"))
    extra = reviews.join(candidates, key, "left_anti").select(*key, F.lit("unexpected").alias("problem")).distinct()
    twice = reviews.groupBy(*key).count().where("count > 1").select(*key, F.lit("duplicate").alias("problem"))
    return missing.unionByName(extra).unionByName(twice)


def compile_decisions(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """Formal decisions of the books whose candidates are all reviewed exactly once and without violations."""
    bad = coverage(candidates, reviews).select("book_id").union(review_violations(reviews).select("book_id")).distinct()
    sound = candidates.join(bad, "book_id", "left_anti")
    return sound.join(reviews.select("book_id", "candidate_id", "verdict", "confidence", "reason", "strategy"), ["book_id", "candidate_id"])


def build_operations(decisions: DataFrame, lines: DataFrame) -> DataFrame:
    """One operation per anchor of a delete: the anchor, or its whole line with the line end, and what takes its place."""
    anchors = decisions.where("verdict = 'delete' and not anchors_truncated").select("book_id", "candidate_id", "strategy", F.explode("anchors").alias("a"))
    whole = lines.select("book_id", F.col("line_no").alias("__line"), F.length("raw").alias("__length"), "start", F.lead("line_no").over(Window.partitionBy("book_id").orderBy("line_no")).isNotNull().alias("__more"))
    rows = anchors.join(whole.withColumnRenamed("book_id", "__book"), (F.col("book_id") == F.col("__book")) & (F.col("a.line_no") == F.col("__line")))
    paragraph = F.col("strategy") == "remove_paragraph"
    end = F.col("start") + F.col("__length") + F.when(F.col("__more"), 1).otherwise(0)
    return rows.select(
        "book_id",
        "candidate_id",
        F.when(paragraph, F.col("start")).otherwise(F.col("a.start_offset")).cast("long").alias("op_start"),
        F.when(paragraph, end).otherwise(F.col("a.end_offset")).cast("long").alias("op_end"),
        F.col("a.original").alias("original"),
        F.when(F.col("strategy") == "fallback_newline", "\n").otherwise("").alias("replacement"),
    )


def overlaps(operations: DataFrame) -> DataFrame:
    """Operations that begin before the end of one before them. A book with any of them is not changed."""
    order = Window.partitionBy("book_id").orderBy("op_start", "op_end", "candidate_id").rowsBetween(Window.unboundedPreceding, -1)
    return operations.withColumn("reach", F.max("op_end").over(order)).where("op_start < reach").select("book_id", "candidate_id", "op_start", "reach")


def apply_operations(texts: DataFrame, operations: DataFrame) -> DataFrame:
    """book_id, text: all operations of a book or, where two overlap, none. Kept pieces are the gaps between operations."""
    ready = operations.join(overlaps(operations).select("book_id").distinct(), "book_id", "left_anti")
    ops = ready.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("op_start", "op_end", "replacement"))).alias("ops"))
    rows = texts.join(ops, "book_id", "left")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("ops", lambda o: o["op_end"]))
    ends = F.concat(F.transform("ops", lambda o: o["op_start"]), F.array(F.length("text").cast("long")))
    put = F.concat(F.transform("ops", lambda o: o["replacement"]), F.array(F.lit("")))
    pieces = F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e"), put.alias("r")), lambda p: F.concat(F.substring("text", p["s"].cast("int") + 1, (p["e"] - p["s"]).cast("int")), p["r"]))
    return rows.select("book_id", F.when(F.col("ops").isNull(), F.col("text")).otherwise(F.array_join(pieces, "")).alias("text"))


def replay(texts: DataFrame, operations: DataFrame, after: DataFrame) -> DataFrame:
    """Whether the ledger turns each text into what was written."""
    made = apply_operations(texts, operations).select("book_id", F.sha2("text", 256).alias("made"))
    return made.join(after.select("book_id", F.sha2("text", 256).alias("kept")), "book_id", "full_outer").select("book_id", F.col("made").eqNullSafe(F.col("kept")).alias("replayed"))


def accounting(decisions: DataFrame, operations: DataFrame) -> DataFrame:
    """Per book: anchors that deletes ask for, operations there are, and those missing, unexpected or double."""
    asked = decisions.where("verdict = 'delete'").select("book_id", "candidate_id", F.explode("anchors.original").alias("original")).groupBy("book_id", "candidate_id").agg(F.count(F.lit(1)).alias("asked"))
    done = operations.groupBy("book_id", "candidate_id").agg(F.count(F.lit(1)).alias("done"), F.countDistinct("op_start").alias("places"))
    rows = asked.join(done, ["book_id", "candidate_id"], "full_outer").na.fill(0, ["asked", "done", "places"])
    return rows.groupBy("book_id").agg(
        F.sum("asked").alias("asked"),
        F.sum("done").alias("done"),
        F.sum(F.greatest(F.lit(0), F.col("asked") - F.col("done"))).alias("missing"),
        F.sum(F.greatest(F.lit(0), F.col("done") - F.col("asked"))).alias("unexpected"),
        F.sum(F.col("done") - F.col("places")).alias("double"),
    )


def remap(rows: DataFrame, operations: DataFrame) -> DataFrame:
    """rows (book_id, line_no, start_offset, end_offset) with new_offset: the place after the operations; null inside one."""
    change = operations.select("book_id", F.col("op_start").alias("s"), F.col("op_end").alias("e"), (F.length("replacement") - F.col("op_end") + F.col("op_start")).alias("delta"))
    per_book = change.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("s", "e", "delta"))).alias("ops"))
    joined = rows.join(per_book, "book_id", "left")
    before = F.aggregate(F.filter("ops", lambda o: o["e"] <= F.col("start_offset")), F.lit(0).cast("long"), lambda acc, o: acc + o["delta"])
    hit = F.exists("ops", lambda o: (o["s"] < F.col("end_offset")) & (o["e"] > F.col("start_offset")))
    moved = F.when(F.col("ops").isNull(), F.col("start_offset")).when(~hit, F.col("start_offset") + before)
    return joined.select("book_id", "line_no", moved.cast("long").alias("new_offset"))


def deletion_ratio(before: DataFrame, after: DataFrame) -> DataFrame:
    rows = before.select("book_id", F.length("text").alias("n_before")).join(after.select("book_id", F.length("text").alias("n_after")), "book_id")
    ratio = (F.col("n_before") - F.col("n_after")) / F.greatest(F.lit(1), F.col("n_before"))
    return rows.select("book_id", (F.col("n_before") - F.col("n_after")).cast("long").alias("removed"), F.round(ratio, 9).alias("ratio"), (ratio <= R.DELETION_LIMIT).alias("within_limit"))


def without_point(operations: DataFrame, point: Column) -> DataFrame:
    """The operations that stay when the ones that fit `point` are rolled back; applying them gives the new head."""
    return operations.where(~point)


def wilson(n: Column, of: Column, z: float = 1.959963984540054) -> Column:
    """struct(low, high): the 95 % score interval; null without trials."""
    p = n / of
    middle, spread = p + z * z / (2 * of), z * F.sqrt((p * (1 - p) + z * z / (4 * of)) / of)
    under = 1 + z * z / of
    return F.when(of > 0, F.struct(F.round(F.greatest(F.lit(0.0), (middle - spread) / under), 9).alias("low"), F.round(F.least(F.lit(1.0), (middle + spread) / under), 9).alias("high")))
