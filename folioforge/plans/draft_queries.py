"""Registered queries of the draft operators: features, families, the automatic gate, seeds, eligibility and counts, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.checkpoints import cut
from folioforge.functions import rules as R
from folioforge.functions import text as X
from folioforge.operators import drafts, scan, structure
from folioforge.plans.corpus import book_lines
from folioforge.plans.scan_queries import _GRAMS, _NAMES, _TEMPLATE, DOMAINS, FULL, HALF, INTENTS, PAIR_CTE, RANKED, SITES, VISIT, WS, q, ranked, taken_of

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Terms of a book's profile; the last two are dropped, as too general and too short.
TERMS = ("最新章节", "飘天", "房间", "小说", "他")


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def featured(spark, sf_dir):
    lines = book_lines(spark, sf_dir)
    rows = cut(taken_of(scan.blocks_in_order(lines)))  # with all blocks that have signals, so that neighbours are among them
    spans = scan.neighbour_spans(scan.neighbour_pairs(rows, structure.slices(lines)))
    return cut(drafts.features(scan.candidates(rows), rows, spans))


_EXT = lambda c: f"regexp_replace(replace(translate({c}, {q(FULL)}, {q(HALF)}), '…', '...'), {q(rf'([A-Za-z0-9]){WS}*(?:点|點|．|。){WS}*([A-Za-z0-9])')}, '\\1.\\2', 'g')"
_FOLD = lambda c: f"lower(regexp_replace({_EXT(c)}, {q(WS + '+')}, '', 'g'))"
_TERMS = "[" + ", ".join(q(t) for t in sorted(TERMS[:3])) + "]"
_LOCATOR = lambda c: f"len(list_intersect({c}, {_NAMES(R.LOCATOR)})) > 0"
_ALL = lambda a, b: f"list_sort(list_distinct(list_concat({a}, {b})))"
FEATURED = f"""{RANKED}, {PAIR_CTE},
sp AS (SELECT book_id, start_offset, n_stripped AS original, n_line_no AS of FROM pr UNION ALL SELECT book_id, n_start_offset, stripped, line_no FROM pr),
nf AS (SELECT sp.book_id, sp.start_offset, {_FOLD('sp.original')} AS folded, kd.signals FROM sp JOIN kd ON kd.book_id = sp.book_id AND kd.line_no = sp.of),
ns AS (SELECT book_id, start_offset, signals, {SITES} AS sites, {INTENTS} AS intents FROM nf),
ar AS (SELECT tk.book_id, layer, grp, list_sort(list_distinct(flatten(list(ns.sites)))) AS n_sites, list_sort(list_distinct(flatten(list(ns.signals)))) AS n_signals,
  list_sort(list_distinct(flatten(list(ns.intents)))) AS n_intents, count(DISTINCT ns.start_offset) AS n_sources FROM tk JOIN ns ON ns.book_id = tk.book_id AND ns.start_offset = tk.start_offset GROUP BY ALL),
ow AS (SELECT book_id, layer, grp, string_agg(stripped, chr(10) ORDER BY m) AS own, bool_and(regexp_matches(stripped, {q(R.NARRATIVE_WATERMARK)})) AS odd FROM
  (SELECT book_id, layer, grp, stripped, min(start_offset) AS m FROM (SELECT *, row_number() OVER (PARTITION BY book_id, layer, grp ORDER BY start_offset) AS nth FROM tk) WHERE nth <= {R.MAX_ANCHORS} GROUP BY ALL) GROUP BY ALL),
f0 AS (SELECT ck.*, 'AD-' || lpad(rank::VARCHAR, 4, '0') AS candidate_id, own, odd, {_FOLD('own')} AS folded, {_EXT('sample')} AS ext, coalesce(n_sites, []) AS n_sites, coalesce(n_signals, []) AS n_signals,
  coalesce(n_intents, []) AS n_intents, least(1.0, coalesce(n_sources, 0) / least({R.MAX_ANCHORS}, occurrence_count)::DOUBLE) AS coverage
  FROM ck JOIN ow ON ow.book_id = ck.book_id AND ow.layer = ck.layer AND ow.grp = ck.grp LEFT JOIN ar ON ar.book_id = ck.book_id AND ar.layer = ck.layer AND ar.grp = ck.grp),
f1 AS (SELECT *, {SITES} AS sites, {INTENTS} AS intents, {DOMAINS} AS domains, {_TEMPLATE} AS template FROM f0),
f2 AS (SELECT *, {_ALL('sites', 'n_sites')} AS all_sites, {_ALL('intents', 'n_intents')} AS all_intents, list_filter({_TERMS}, lambda t: contains(folded, t)) AS hits,
  ({_LOCATOR('signals')} OR len(domains) > 0 OR len(sites) > 0) AS core, ({_LOCATOR('n_signals')} OR len(n_sites) > 0) AS near,
  ({' OR '.join(f'regexp_matches(own, {q(p)})' for p in R.NARRATIVE)}) AS story, {VISIT} AS bound FROM f1),
f3 AS (SELECT *, CASE WHEN len(all_sites) > 0 THEN 'site=' || array_to_string(all_sites, ',') || '|intent=' || coalesce(all_intents[1], 'source')
    ELSE 'signal=' || CASE WHEN len(signals) > 0 THEN array_to_string(signals, ',') ELSE 'repetition' END || '|template=' || template END AS cluster_key,
  len(hits) > 0 OR occurrence_count > {R.MAX_ANCHORS} OR guard IS NOT NULL AS blocked,
  array_to_string(signals, ',') = 'watermark' AND len(all_sites) = 0 AND len(domains) = 0 AND len(intents) = 0 AND odd AS collision FROM f2),
f4 AS (SELECT *, 'ADF-' || substr(sha1(cluster_key), 1, 12) AS cluster_id, CASE WHEN blocked OR collision OR guard IS NOT NULL OR story OR NOT (core OR near) OR NOT (len(intents) > 0 OR len(n_intents) > 0)
    OR (core AND array_to_string(intents, ',') = 'visit' AND NOT bound) OR (NOT (core AND len(intents) > 0) AND coverage < 0.5) THEN NULL WHEN core AND len(intents) > 0 THEN 0.97 ELSE 0.95 END::DOUBLE AS gate,
  NOT blocked AND NOT story AND collision AS collides FROM f3),
g1 AS (SELECT *, {_GRAMS.replace('key', 'template')} AS grams FROM f4),
sm AS (SELECT DISTINCT a.book_id, a.candidate_id, s.candidate_id AS seed_id, len(list_intersect(a.grams, s.grams)) / nullif(len(a.grams) + len(s.grams) - len(list_intersect(a.grams, s.grams)), 0)::DOUBLE AS similarity
  FROM g1 a JOIN g1 s ON a.book_id = s.book_id AND a.candidate_id <> s.candidate_id AND len(list_intersect(a.all_sites, s.all_sites)) > 0
  WHERE s.gate IS NOT NULL AND a.gate IS NULL AND NOT a.blocked AND NOT a.collides AND len(a.all_intents) > 0),
sb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id, candidate_id ORDER BY similarity DESC, seed_id) AS nth FROM sm WHERE similarity >= {R.FAMILY_JACCARD}) WHERE nth = 1),
dr AS (SELECT f4.*, seed_id, similarity, CASE WHEN collides THEN 'keep' WHEN gate IS NOT NULL OR seed_id IS NOT NULL THEN 'delete' ELSE 'uncertain' END AS verdict,
  CASE WHEN collides THEN 0.98 WHEN gate IS NOT NULL THEN gate WHEN seed_id IS NOT NULL THEN 0.94 WHEN guard IS NOT NULL THEN 0.15 WHEN occurrence_count > {R.MAX_ANCHORS} THEN 0.2 WHEN len(hits) > 0 THEN 0.3
    WHEN story THEN 0.25 WHEN strength = 'strong' THEN 0.5 ELSE 0.45 END::DOUBLE AS confidence FROM f4 LEFT JOIN sb ON sb.book_id = f4.book_id AND sb.candidate_id = f4.candidate_id)
"""


def made(spark, sf_dir):
    return drafts.drafts(featured(spark, sf_dir), TERMS)


@register("candidate_features", f"{FEATURED} SELECT book_id, candidate_id, array_to_string(sites, ',') AS sites, array_to_string(intents, ',') AS intents, array_to_string(domains, ',') AS domains, array_to_string(n_sites, ',') AS n_sites, array_to_string(n_intents, ',') AS n_intents, template, round(coverage, 6) AS coverage FROM f4")
def candidate_features(spark, sf_dir):
    joined = [F.array_join(c, ",").alias(c) for c in ("sites", "intents", "domains", "n_sites", "n_intents")]
    return featured(spark, sf_dir).select("book_id", "candidate_id", *joined, "template", F.round("coverage", 6).alias("coverage"))


@register("auto_delete_gate", f"{FEATURED} SELECT book_id, candidate_id, gate FROM f4 WHERE gate IS NOT NULL")
def auto_delete_gate(spark, sf_dir):
    rows = featured(spark, sf_dir).withColumn("hits", drafts.protected_hits(F.col("folded"), drafts.profile_terms(TERMS)))
    rows = rows.where(~drafts.safety_blocked(F.col("hits")) & ~drafts.watermark_collision())
    return rows.select("book_id", "candidate_id", drafts.gate().alias("gate")).where("gate is not null")


@register("rule_drafts", f"{FEATURED} SELECT book_id, candidate_id, verdict, confidence, cluster_id, seed_id AS promoted_from, blocked FROM dr")
def rule_drafts(spark, sf_dir):
    return made(spark, sf_dir)


@register("seed_match", f"{FEATURED} SELECT book_id, candidate_id, seed_id, round(similarity, 9) AS similarity FROM sb")
def seed_match(spark, sf_dir):
    """Seeds here are all that the gate lets through; candidates without own evidence are matched to them."""
    rows = drafts.cluster_key(featured(spark, sf_dir)).withColumn("hits", drafts.protected_hits(F.col("folded"), drafts.profile_terms(TERMS)))
    blocked, collision = drafts.safety_blocked(F.col("hits")), drafts.watermark_collision()
    rows = rows.withColumn("blocked", blocked).withColumn("gate", F.when(~blocked & ~collision, drafts.gate())).withColumn("collides", ~blocked & ~X.narrative(F.col("own")) & collision)
    found = drafts.seed_matches(rows, F.col("gate").isNotNull(), F.col("gate").isNull() & ~F.col("blocked") & ~F.col("collides"))
    return found.select("book_id", "candidate_id", "seed_id", F.round("similarity", 9).alias("similarity"))


@register("family_clusters", f"{FEATURED} SELECT book_id, cluster_id, count(*) AS member_count, min(candidate_id) AS representative, count(*) FILTER (WHERE verdict = 'delete' AND seed_id IS NULL) AS seeds, count(*) FILTER (WHERE seed_id IS NOT NULL) AS promoted, count(*) FILTER (WHERE blocked) AS blocked FROM dr GROUP BY ALL")
def family_clusters(spark, sf_dir):
    return drafts.families(made(spark, sf_dir))


@register("delete_eligibility", f"{RANKED}, p AS (SELECT book_id, 'AD-' || lpad(rank::VARCHAR, 4, '0') AS candidate_id, array_to_string(list_filter([CASE WHEN occurrence_count > {R.MAX_ANCHORS} THEN 'anchors_truncated' END, CASE WHEN contains(sample, '最新章节') THEN 'protection_conflict' END, CASE WHEN guard IS NOT NULL THEN 'mixed_whole_block' END], lambda x: x IS NOT NULL), ',') AS blockers FROM ck) SELECT *, blockers = '' AS allowed FROM p")
def delete_eligibility(spark, sf_dir):
    blockers = F.array_join(drafts.eligibility(F.contains(F.col("sample"), F.lit("最新章节"))), ",")
    return ranked(spark, sf_dir).select("book_id", "candidate_id", blockers.alias("blockers"), (blockers == "").alias("allowed"))


@register("count_by", f"{RANKED} SELECT book_id, coalesce(nullif(strength, 'none'), 'unknown') AS value, count(*) AS n FROM ck GROUP BY ALL")
def count_by(spark, sf_dir):
    """Candidates by strength, an empty one as unknown."""
    value = F.coalesce(F.nullif("strength", F.lit("none")), F.lit("unknown"))
    return ranked(spark, sf_dir).groupBy("book_id", value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


@register("first_page", f"{RANKED} SELECT book_id, rank, 'AD-' || lpad(rank::VARCHAR, 4, '0') AS candidate_id FROM ck WHERE rank <= 300")
def first_page(spark, sf_dir):
    return ranked(spark, sf_dir).where("rank <= 300").select("book_id", "rank", "candidate_id")
