"""Rule drafts over candidates: features of their own and neighbouring text, families, the automatic gate, seeds, and who may delete."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import rules as R
from folioforge.functions import text as X

GROUP = ("book_id", "layer", "group")


def own_text(anchors: Column) -> Column:
    """The distinct texts of the anchors in order, without what is around them."""
    return F.array_join(F.array_distinct(F.transform(anchors, lambda a: a["original"])), "\n")


def features(candidates: DataFrame, taken: DataFrame, spans: DataFrame) -> DataFrame:
    """candidates with own, folded, sites, intents, domains, template, and of the neighbours of their blocks n_sites, n_signals, n_intents and
    coverage: the share of anchors that have a neighbour."""
    near = spans.select("book_id", F.col("source_offset").alias("start_offset"), X.match_fold(F.col("original")).alias("n_folded"), F.col("signals").alias("n_sig"))
    near = near.withColumn("n_site", X.site_entities(F.col("n_folded"))).withColumn("n_int", X.intents(F.col("n_folded")))
    blocks = taken.select(*GROUP, "start_offset").join(near, ["book_id", "start_offset"])
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    around = blocks.groupBy(*GROUP).agg(union("n_site").alias("n_sites"), union("n_sig").alias("n_signals"), union("n_int").alias("n_intents"), F.countDistinct("start_offset").alias("n_sources"))
    rows = candidates.join(around, list(GROUP), "left").withColumn("own", own_text(F.col("anchors"))).withColumn("folded", X.match_fold(F.col("own")))
    none = F.array().cast("array<string>")
    for name in ("n_sites", "n_signals", "n_intents"):
        rows = rows.withColumn(name, F.coalesce(name, none))
    rows = rows.withColumn("sites", X.site_entities(F.col("folded"))).withColumn("intents", X.intents(F.col("folded"))).withColumn("domains", X.domains(F.col("folded")))
    rows = rows.withColumn("template", X.family_template(F.col("sample")))
    return rows.withColumn("coverage", F.least(F.lit(1.0), F.coalesce("n_sources", F.lit(0)) / F.size("anchors")))


def cluster_key(rows: DataFrame) -> DataFrame:
    """rows (of features) with cluster_key and cluster_id: by sites and the first intent, or by signals and template."""
    sites, intents = F.array_sort(F.array_union("sites", "n_sites")), F.array_sort(F.array_union("intents", "n_intents"))
    by_site = F.concat(F.lit("site="), F.array_join(sites, ","), F.lit("|intent="), F.coalesce(F.try_element_at(intents, F.lit(1)), F.lit("source")))
    by_signal = F.concat(F.lit("signal="), F.when(F.size("signals") > 0, F.array_join(F.array_sort("signals"), ",")).otherwise("repetition"), F.lit("|template="), F.col("template"))
    rows = rows.withColumn("all_sites", sites).withColumn("all_intents", intents).withColumn("cluster_key", F.when(F.size(sites) > 0, by_site).otherwise(by_signal))
    return rows.withColumn("cluster_id", F.concat(F.lit("ADF-"), F.substring(F.sha1("cluster_key"), 1, 12)))


def profile_terms(terms: Sequence[str]) -> list[str]:
    """A book's protection terms in match form: of two characters or more, without words that any book has."""
    folded = {"".join(re.sub(r"([A-Za-z0-9])\s*[点點．。]\s*([A-Za-z0-9])", r"\1.\2", unicodedata.normalize("NFKC", t)).split()).lower() for t in terms}
    return sorted(t for t in folded if len(t) >= 2 and t not in R.TERM_STOPWORDS)


def protected_hits(folded: Column, terms: Sequence[str]) -> Column:
    """Which of profile_terms() a candidate's own text, in match form, holds."""
    return F.array_compact(F.array(*[F.when(F.contains(folded, F.lit(t)), F.lit(t)) for t in terms], F.lit(None).cast("string")))


def safety_blocked(hits: Column) -> Column:
    return (F.size(hits) > 0) | F.col("anchors_truncated") | F.col("mutation_guard").isNotNull() | (F.size("anchors") == 0)


def watermark_collision() -> Column:
    """Only a watermark, in ordinary wording."""
    bare = (F.size("sites") == 0) & (F.size("n_sites") == 0) & (F.size("domains") == 0) & (F.size("intents") == 0)
    return (F.array_join("signals", ",") == "watermark") & bare & F.forall("anchors", lambda a: a["original"].rlike(R.NARRATIVE_WATERMARK))


def gate() -> Column:
    """The confidence of an automatic delete, 0.97 by a candidate's own locator and intent or 0.95 with its neighbours', else null."""
    core = X.any_of(F.col("signals"), R.LOCATOR) | (F.size("domains") > 0) | (F.size("sites") > 0)
    near = X.any_of(F.col("n_signals"), R.LOCATOR) | (F.size("n_sites") > 0)
    own, other = F.size("intents") > 0, F.size("n_intents") > 0
    refused = [
        F.coalesce(F.col("mutation_guard") == "long_line_mixed_content", F.lit(False)),
        X.narrative(F.col("own")),
        ~(core | near) | ~(own | other),
        core & (F.array_join("intents", ",") == "visit") & ~X.bound_visit(F.col("folded")),
        ~(core & own) & (F.col("coverage") < 0.5),
    ]
    return F.when(reduce(lambda a, b: a | b, refused), None).when(core & own, F.lit(0.97)).otherwise(F.lit(0.95))


def seed_matches(rows: DataFrame, seeds: Column, open_: Column) -> DataFrame:
    """Of open candidates with sites and intents, each that is like a seed of a shared site: the most alike seed, the least id among
    equals. Seeds are as they were before any match, so that nothing is handed on."""
    known = rows.withColumn("grams", X.ngrams(F.col("template")))
    seed = known.where(seeds).select("book_id", F.explode("all_sites").alias("site"), F.col("candidate_id").alias("seed_id"), F.col("grams").alias("seed_grams"))
    asked = known.where(open_ & (F.size("all_sites") > 0) & (F.size("all_intents") > 0)).select("book_id", F.explode("all_sites").alias("site"), "candidate_id", "grams")
    pairs = asked.join(seed, ["book_id", "site"]).where("candidate_id <> seed_id").dropDuplicates(["book_id", "candidate_id", "seed_id"])
    pairs = pairs.withColumn("similarity", X.jaccard(F.col("grams"), F.col("seed_grams"))).where(F.col("similarity") >= R.FAMILY_JACCARD)
    best = F.row_number().over(Window.partitionBy("book_id", "candidate_id").orderBy(F.col("similarity").desc(), "seed_id"))
    return pairs.withColumn("nth", best).where("nth = 1").select("book_id", "candidate_id", "seed_id", "similarity")


def drafts(rows: DataFrame, terms: Sequence[str]) -> DataFrame:
    """book_id, candidate_id, verdict, confidence, cluster_id, promoted_from: the rule draft of every candidate (rows of features)."""
    rows = cluster_key(rows).withColumn("hits", protected_hits(F.col("folded"), profile_terms(terms)))
    blocked = safety_blocked(F.col("hits"))
    rows = rows.withColumn("blocked", blocked).withColumn("gate", F.when(~blocked & ~watermark_collision(), gate()))
    rows = rows.withColumn("collides", ~blocked & ~X.narrative(F.col("own")) & watermark_collision())
    found = seed_matches(rows, F.col("gate").isNotNull(), F.col("gate").isNull() & ~F.col("blocked") & ~F.col("collides"))
    rows = rows.join(found, ["book_id", "candidate_id"], "left")
    verdict = F.when(F.col("collides"), "keep").when(F.col("gate").isNotNull() | F.col("seed_id").isNotNull(), "delete").otherwise("uncertain")
    kept = F.when(F.col("mutation_guard").isNotNull(), 0.15).when(F.col("anchors_truncated"), 0.2).when(F.size("hits") > 0, 0.3)
    plain = F.when(F.col("strength") == "strong", 0.5).otherwise(0.45)
    confidence = F.when(F.col("collides"), 0.98).when(F.col("gate").isNotNull(), F.col("gate")).when(F.col("seed_id").isNotNull(), 0.94)
    confidence = F.coalesce(confidence, kept, F.when(X.narrative(F.col("own")), 0.25), plain)
    return rows.select("book_id", "candidate_id", verdict.alias("verdict"), confidence.alias("confidence"), "cluster_id", F.col("seed_id").alias("promoted_from"), "blocked")


def eligibility(protected: Column) -> Column:
    """Why a candidate may not be deleted as a whole, in order; empty if it may."""
    none = F.size("anchors") == 0
    blockers = [
        F.when(none, "zero_anchor"),
        F.when(F.col("anchors_truncated"), "anchors_truncated").when(F.col("occurrence_count") != F.size("anchors"), "occurrence_coverage_incomplete"),
        F.when(protected, "protection_conflict"),
        F.when(F.col("mutation_guard") == "long_line_mixed_content", "mixed_whole_block").when(F.col("mutation_guard").isNotNull(), "mutation_guard"),
    ]
    return F.array_compact(F.array(*blockers))


def families(made: DataFrame) -> DataFrame:
    """Per book and cluster: members, the first of them, and how many are seeds, promoted or blocked."""
    seed = (F.col("verdict") == "delete") & F.col("promoted_from").isNull()
    return made.groupBy("book_id", "cluster_id").agg(
        F.count(F.lit(1)).alias("member_count"),
        F.min("candidate_id").alias("representative"),
        F.count_if(seed).alias("seeds"),
        F.count_if(F.col("promoted_from").isNotNull()).alias("promoted"),
        F.count_if("blocked").alias("blocked"),
    )
