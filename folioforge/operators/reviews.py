"""Identity of candidates, groups and pages for review, verdicts of groups handed to members, residual findings, and counts of a module."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: bytes at which a page is full.
PAGE_BYTES = 32 * 1024


def fingerprints(candidates: DataFrame) -> DataFrame:
    """candidates with `fingerprint`: the SHA-256 of their canonical JSON (keys sorted, nothing that names the candidate)."""
    anchors = F.transform("anchors", lambda a: F.struct(a["end_offset"].alias("end"), a["start_offset"].alias("offset"), a["original"].alias("original")))
    shape = F.struct(
        anchors.alias("anchors"),
        F.coalesce("mutation_guard", F.lit("")).alias("guard"),
        F.col("layer").alias("layer"),
        F.col("occurrence_count").cast("long").alias("occurrences"),
        "risk",
        F.array_sort("signals").alias("signals"),
        "strength",
    )
    return candidates.withColumn("fingerprint", F.sha2(F.to_json(shape), 256))


def anchor_ids(fingerprinted: DataFrame) -> DataFrame:
    """book_id, candidate_id, ordinal (from 1), anchor_id: an anchor's name follows its candidate's fingerprint, its place and its text."""
    rows = fingerprinted.select("book_id", "candidate_id", "fingerprint", F.posexplode("anchors").alias("pos", "a"))
    rows = rows.withColumn("ordinal", F.col("pos") + 1)
    return rows.select("book_id", "candidate_id", "ordinal", F.concat(F.lit("AN-"), F.sha2(F.concat_ws("|", "fingerprint", "ordinal", "a.start_offset", "a.original"), 256)).alias("anchor_id"))


def candidate_sets(fingerprinted: DataFrame) -> DataFrame:
    """book_id, candidates, set_sha256: a book's candidates whatever their order."""
    joined = F.array_join(F.array_sort(F.collect_list("fingerprint")), "\n")
    return fingerprinted.groupBy("book_id").agg(F.count(F.lit(1)).alias("candidates"), F.sha2(joined, 256).alias("set_sha256"))


def groups(drafted: DataFrame) -> DataFrame:
    """drafted: fingerprinted candidates with verdict and strategy. One row per book and group: candidates that may be deleted go by shape,
    the others by layer, signals, scope and verdict; group_id follows the members and their fingerprints."""
    allowed = (F.col("verdict") == "delete") & ~F.col("anchors_truncated") & F.col("mutation_guard").isNull()
    scope = F.when(F.col("mutation_guard").isNotNull(), "segment").otherwise("whole")
    signals = F.array_join(F.array_sort("signals"), ",")
    kind = F.when(allowed, "delete_exact").when(F.col("verdict") == "keep", "keep_review").otherwise("uncertain_review")
    key = F.when(allowed, F.concat_ws("|", "strategy", scope, "layer")).otherwise(F.concat_ws("|", "layer", signals, scope, "verdict"))
    rows = drafted.withColumn("kind", kind).withColumn("reason_code", F.sha2(F.concat_ws("|", "kind", key), 256))
    members = F.array_sort(F.collect_list(F.struct("candidate_id", "fingerprint")))
    found = rows.groupBy("book_id", "kind", "reason_code").agg(members.alias("members"))
    covered = F.sha2(F.array_join(F.transform("members", lambda m: F.concat_ws(":", m["candidate_id"], m["fingerprint"])), "\n"), 256)
    found = found.withColumn("coverage_sha256", covered)
    name = F.concat(F.lit("RG-"), F.substring(F.sha2(F.concat_ws("|", "kind", "coverage_sha256"), 256), 1, 20))
    return found.withColumn("group_id", name).withColumn("delete_allowed", F.col("kind") == "delete_exact")


def expand(found: DataFrame, verdicts: DataFrame, candidates: DataFrame) -> DataFrame:
    """verdicts: book_id, group_id, verdict. A review for every member whose fingerprint is still its candidate's; a delete only where the
    group allows it. Candidates that get more than one verdict get none."""
    ready = found.join(verdicts, ["book_id", "group_id"]).where((F.col("verdict") != "delete") | F.col("delete_allowed"))
    rows = ready.select("book_id", "group_id", "verdict", F.explode("members").alias("m")).select("book_id", "group_id", "verdict", "m.*")
    rows = rows.join(candidates.select("book_id", "candidate_id", "fingerprint"), ["book_id", "candidate_id", "fingerprint"])
    per = rows.groupBy("book_id", "candidate_id").agg(F.count_distinct("verdict").alias("k"), F.min("verdict").alias("verdict"), F.min("group_id").alias("group_id"))
    return per.where("k = 1").drop("k")


def pages(sized: DataFrame, most: int = PAGE_BYTES) -> DataFrame:
    """sized: book_id, rank, bytes. book_id, rank, page (from 1), oversize: records in order, a new page where one does not fit behind those
    before it; one larger than a page stands alone. Only numbers travel, those of a book in one group."""

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        def numbers() -> Iterator[int]:
            page, used = 1, 0
            for size in rows["bytes"]:
                if used and used + size > most:
                    page, used = page + 1, 0
                used += size
                yield page

        rows = rows.sort_values("rank")
        return pd.DataFrame({"book_id": rows["book_id"], "rank": rows["rank"], "page": list(numbers()), "oversize": rows["bytes"] > most})

    light = sized.select(F.col("book_id").cast("long"), F.col("rank").cast("long"), F.col("bytes").cast("long"))
    return light.groupBy("book_id").applyInPandas(fill, "book_id long, rank long, page long, oversize boolean")


def residuals(found: DataFrame, kept: DataFrame) -> DataFrame:
    """Of found texts (book_id, text) those that no kept one accounts for, each kept text for one: book_id, text_sha256, residual."""
    one = lambda rows, n: rows.select("book_id", F.sha2("text", 256).alias("text_sha256"), F.lit(n).cast("long").alias("n"))
    return one(found, 1).union(one(kept, -1)).groupBy("book_id", "text_sha256").agg(F.sum("n").alias("residual")).where("residual > 0")


def module_summary(decisions: DataFrame) -> DataFrame:
    """Per book: candidates, anchors, truncated ones, those that change the text, and those that wait for a person."""
    changes = (F.col("verdict") == "delete") & ~F.col("anchors_truncated")
    return decisions.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.sum(F.size("anchors")).cast("long").alias("anchors"),
        F.count_if("anchors_truncated").alias("truncated"),
        F.count_if(changes).alias("mutating"),
        F.count_if((F.col("verdict") == "uncertain") | F.col("mutation_guard").isNotNull()).alias("manual"),
    )


def authoritative_counts(decisions: DataFrame, operations: DataFrame) -> DataFrame:
    """Per book: decisions by verdict, operations, and characters that these take out."""
    verdicts = decisions.groupBy("book_id").agg(*[F.count_if(F.col("verdict") == v).alias(f"{v}s") for v in ("delete", "keep", "uncertain")])
    gone = F.col("op_end") - F.col("op_start") - F.length("replacement")
    done = operations.groupBy("book_id").agg(F.count(F.lit(1)).alias("operations"), F.sum(gone).cast("long").alias("removed"))
    return verdicts.join(done, "book_id", "left").na.fill(0, ["operations", "removed"])
