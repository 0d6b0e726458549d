"""Registered queries of the review and export operators, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.checkpoints import cut
from folioforge.functions import rules as R
from folioforge.operators import edits, exports, reviews
from folioforge.plans.corpus import book_lines
from folioforge.plans.edit_queries import DECIDED, applied, reviewed
from folioforge.plans.scan_queries import BASE, FULL, HALF, WS, q, ranked

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


FINGERPRINTED = f"""{DECIDED},
an AS (SELECT dc.book_id, candidate_id, tk.start_offset, tk.end_offset, stripped, row_number() OVER (PARTITION BY dc.book_id, candidate_id ORDER BY tk.start_offset) AS ordinal
  FROM dc JOIN tk ON tk.book_id = dc.book_id AND tk.layer = dc.layer AND tk.grp = dc.grp),
aj AS (SELECT book_id, candidate_id, count(*) AS n_anchors, list(struct_pack("end" := end_offset, "offset" := start_offset, original := stripped) ORDER BY ordinal) AS anchors FROM an WHERE ordinal <= {R.MAX_ANCHORS} GROUP BY ALL),
fg AS (SELECT dc.*, n_anchors, sha256(to_json(struct_pack(anchors := anchors, guard := coalesce(guard, ''), layer := dc.layer, occurrences := occurrence_count::BIGINT, risk := risk, signals := list_sort(signals), strength := strength))::VARCHAR) AS fingerprint
  FROM dc JOIN aj USING (book_id, candidate_id))
"""


def fingerprinted(spark, sf_dir):
    return reviews.fingerprints(ranked(spark, sf_dir))


def drafted(spark, sf_dir):
    candidates, made = reviewed(spark, sf_dir)
    return reviews.fingerprints(edits.compile_decisions(candidates, made))


@register("candidate_fingerprint", f"{FINGERPRINTED} SELECT book_id, candidate_id, fingerprint FROM fg")
def candidate_fingerprint(spark, sf_dir):
    return fingerprinted(spark, sf_dir).select("book_id", "candidate_id", "fingerprint")


@register("anchor_ids", f"{FINGERPRINTED} SELECT an.book_id, an.candidate_id, ordinal::INT AS ordinal, 'AN-' || sha256(fingerprint || '|' || ordinal || '|' || start_offset || '|' || stripped) AS anchor_id FROM an JOIN fg USING (book_id, candidate_id) WHERE ordinal <= {R.MAX_ANCHORS}")
def anchor_ids(spark, sf_dir):
    return reviews.anchor_ids(fingerprinted(spark, sf_dir))


@register("candidate_sets", f"{FINGERPRINTED} SELECT book_id, count(*) AS candidates, sha256(string_agg(fingerprint, chr(10) ORDER BY fingerprint)) AS set_sha256 FROM fg GROUP BY book_id")
def candidate_sets(spark, sf_dir):
    return reviews.candidate_sets(fingerprinted(spark, sf_dir))


GROUPED = f"""{FINGERPRINTED},
gk AS (SELECT *, array_to_string(list_sort(signals), ',') AS marks, CASE WHEN guard IS NULL THEN 'whole' ELSE 'segment' END AS scope, verdict = 'delete' AND occurrence_count <= {R.MAX_ANCHORS} AND guard IS NULL AS allowed FROM fg),
gr AS (SELECT *, CASE WHEN allowed THEN 'delete_exact' WHEN verdict = 'keep' THEN 'keep_review' ELSE 'uncertain_review' END AS kind,
  CASE WHEN allowed THEN strategy || '|' || scope || '|' || layer ELSE layer || '|' || marks || '|' || scope || '|' || verdict END AS k FROM gk),
gc AS (SELECT book_id, kind, k, count(*) AS members, sha256(string_agg(candidate_id || ':' || fingerprint, chr(10) ORDER BY candidate_id)) AS covered FROM gr GROUP BY book_id, kind, k),
gm AS (SELECT book_id, kind, k, members, 'RG-' || substr(sha256(kind || '|' || covered), 1, 20) AS group_id FROM gc)
"""


@register("review_groups", f"{GROUPED} SELECT book_id, group_id, kind, members, kind = 'delete_exact' AS delete_allowed FROM gm")
def review_groups(spark, sf_dir):
    return reviews.groups(drafted(spark, sf_dir)).select("book_id", "group_id", "kind", F.size("members").cast("long").alias("members"), "delete_allowed")


@register("group_expand", f"{GROUPED} SELECT gr.book_id, candidate_id, group_id, CASE kind WHEN 'delete_exact' THEN 'delete' WHEN 'keep_review' THEN 'keep' ELSE 'uncertain' END AS verdict FROM gr JOIN gm USING (book_id, kind, k)")
def group_expand(spark, sf_dir):
    """Each group's verdict is what its kind suggests."""
    rows = cut(drafted(spark, sf_dir))
    found = reviews.groups(rows)
    verdict = F.when(F.col("kind") == "delete_exact", "delete").when(F.col("kind") == "keep_review", "keep").otherwise("uncertain")
    return reviews.expand(found, found.select("book_id", "group_id", verdict.alias("verdict")), rows)


#: Bytes of a candidate in a page: its sample, and a fixed frame around each anchor.
_FRAME = 900


@register("review_pages", f"""{DECIDED.replace('WITH ', 'WITH RECURSIVE ', 1)},
zz AS (SELECT book_id, rank, strlen(sample) + {_FRAME} * least(occurrence_count, {R.MAX_ANCHORS}) AS bytes FROM ck),
pg AS (SELECT book_id, rank, 1::BIGINT AS page, bytes AS used FROM zz WHERE rank = 1
  UNION ALL SELECT zz.book_id, zz.rank, CASE WHEN used + bytes > {reviews.PAGE_BYTES} THEN page + 1 ELSE page END, CASE WHEN used + bytes > {reviews.PAGE_BYTES} THEN bytes ELSE used + bytes END FROM pg JOIN zz ON zz.book_id = pg.book_id AND zz.rank = pg.rank + 1)
SELECT pg.book_id, pg.rank, page, bytes > {reviews.PAGE_BYTES} AS oversize FROM pg JOIN zz ON zz.book_id = pg.book_id AND zz.rank = pg.rank""")
def review_pages(spark, sf_dir):
    size = F.octet_length("sample") + _FRAME * F.size("anchors")
    return reviews.pages(ranked(spark, sf_dir).select("book_id", "rank", size.alias("bytes")))


@register("residual_suppress", f"""{FINGERPRINTED}, u AS (SELECT an.book_id, sha256(stripped) AS text_sha256, CASE WHEN verdict = 'keep' THEN 0 ELSE 1 END AS n FROM an JOIN dc USING (book_id, candidate_id) WHERE ordinal <= {R.MAX_ANCHORS})
SELECT book_id, text_sha256, sum(n)::BIGINT AS residual FROM u GROUP BY ALL HAVING sum(n) > 0""")
def residual_suppress(spark, sf_dir):
    """A second scan of the same books finds every anchor again; the kept ones account for theirs."""
    candidates, made = reviewed(spark, sf_dir)
    rows = edits.compile_decisions(candidates, made).select("book_id", "verdict", F.explode("anchors.original").alias("text"))
    return reviews.residuals(rows.select("book_id", "text"), rows.where("verdict = 'keep'").select("book_id", "text"))


@register("module_summary", f"""{FINGERPRINTED} SELECT book_id, count(*) AS candidates, sum(n_anchors)::BIGINT AS anchors, count(*) FILTER (WHERE occurrence_count > {R.MAX_ANCHORS}) AS truncated,
count(*) FILTER (WHERE verdict = 'delete' AND occurrence_count <= {R.MAX_ANCHORS}) AS mutating, count(*) FILTER (WHERE verdict = 'uncertain' OR guard IS NOT NULL) AS manual FROM fg GROUP BY book_id""")
def module_summary(spark, sf_dir):
    return reviews.module_summary(drafted(spark, sf_dir))


@register("authoritative_counts", f"""{DECIDED}, v AS (SELECT book_id, count(*) FILTER (WHERE verdict = 'delete') AS deletes, count(*) FILTER (WHERE verdict = 'keep') AS keeps, count(*) FILTER (WHERE verdict = 'uncertain') AS uncertains FROM dc GROUP BY book_id),
o AS (SELECT book_id, count(*) AS operations, sum(op_end - op_start - length(replacement))::BIGINT AS removed FROM op GROUP BY book_id)
SELECT v.*, coalesce(operations, 0) AS operations, coalesce(removed, 0) AS removed FROM v LEFT JOIN o USING (book_id)""")
def authoritative_counts(spark, sf_dir):
    _, decisions, operations = applied(spark, sf_dir)
    return reviews.authoritative_counts(decisions, operations)


_RESERVED = "[" + ", ".join(q(x) for x in exports.RESERVED) + "]"
_BARE = lambda c: f"lower(regexp_replace(string_split({c}, '.')[1], '[ .]+$', '')) IN ({', '.join(q(x) for x in exports.RESERVED)})"
_TRIM = lambda c, ends: f"coalesce(nullif(regexp_replace({c}, {q(ends)}, '', 'g'), ''), {q(exports.NAMELESS)})"
_CUT = lambda c: f"CASE WHEN strlen({c}) <= 90 THEN {c} ELSE substring({c}, 1, list_max(list_filter(range(0, least(length({c}), 90) + 1), lambda i: strlen(substring({c}, 1, i)) <= 90))) END"


@register("export_names", f"""WITH n0 AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN ({_RESERVED})[page_id % {len(exports.RESERVED)} + 1] || CASE page_id % 4 WHEN 0 THEN '' ELSE '.txt' END WHEN 1 THEN '  ' || url || ' ..' WHEN 2 THEN url || repeat('章节', 40) WHEN 3 THEN ' . ' ELSE url END AS name FROM pages),
n1 AS (SELECT page_id, {_TRIM(f"regexp_replace(regexp_replace(nfc_normalize(name), {q(exports.FORBIDDEN)}, '_', 'g'), {q(WS + '+')}, ' ', 'g')", '^[ .]+|[ .]+$')} AS s FROM n0),
n2 AS (SELECT page_id, CASE WHEN {_BARE('s')} THEN '_' || s ELSE s END AS s FROM n1),
n3 AS (SELECT page_id, {_TRIM(_CUT('s'), '[ .]+$')} AS s FROM n2)
SELECT page_id, s || CASE WHEN nth = 1 THEN '' ELSE '-' || nth END AS placed FROM (SELECT *, row_number() OVER (PARTITION BY lower(s) ORDER BY page_id) AS nth FROM n3)""")
def export_names(spark, sf_dir):
    n = F.col("page_id")
    device = F.element_at(F.array(*[F.lit(x) for x in exports.RESERVED]), (n % len(exports.RESERVED) + 1).cast("int"))
    name = F.when(n % 6 == 0, F.concat(device, F.when(n % 4 == 0, "").otherwise(".txt"))).when(n % 6 == 1, F.concat(F.lit("  "), "url", F.lit(" .."))).when(n % 6 == 2, F.concat("url", F.lit("章节" * 40))).when(n % 6 == 3, " . ").otherwise(F.col("url"))
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", name.alias("name"))
    return exports.unique_names(exports.safe_name(rows, "name"), "page_id").select("page_id", "placed")


_SOURCES = ("夜色 www.biquge.com 全本", "夜色渐深（改版）", "夜色渐深 精校版", "长夜行", "book")
_TITLES = ("", "夜色渐深", "长夜行记")
_PICK = lambda values: f"([{', '.join(q(v) for v in values)}])[book_id % {len(values)} + 1]"
_KEY = lambda c: f"regexp_replace(regexp_replace(lower(replace(translate({c}, {q(FULL)}, {q(HALF)}), '…', '...')), {q(exports.PLAIN_WORDS)}, '', 'g'), '[^0-9a-z\\x{{4e00}}-\\x{{9fff}}]+', '', 'g')"


@register("export_identity", f"""{BASE}, b0 AS (SELECT book_id, substring(string_agg(raw, chr(10) ORDER BY line_no), 1, {exports.OPENING_NAMES}) AS opening FROM bl WHERE start < {exports.OPENING_NAMES} GROUP BY book_id),
b1 AS (SELECT *, {_PICK(_SOURCES)} AS source, CASE WHEN book_id % 7 = 0 THEN '定本' END AS explicit, nullif({_PICK(_TITLES)}, '') AS verified, book_id % 11 = 0 AS fan, CASE WHEN book_id % 2 = 0 THEN '收进抽屉' ELSE '无名氏' END AS person FROM b0),
b2 AS (SELECT *, coalesce(explicit, verified) AS wanted, {_KEY('source')} AS ks, {_KEY('coalesce(explicit, verified)')} AS kw, regexp_matches(source, {q(exports.NOISY)}) AS noisy FROM b1),
b3 AS (SELECT *, coalesce(ks <> '' AND kw <> '' AND (ks = kw OR (least(length(ks), length(kw)) >= 3 AND (contains(ks, kw) OR contains(kw, ks)))), false) AS near, coalesce(length(kw) >= 3 AND contains({_KEY(f'substring(opening, 1, {exports.OPENING_TITLE})')}, kw), false) AS named, contains(opening, person) AS known FROM b2),
b4 AS (SELECT *, CASE WHEN wanted IS NULL THEN 'no_title' WHEN explicit IS NOT NULL THEN 'explicit' WHEN fan OR regexp_matches(source, {q(exports.VARIANT)}) THEN 'variant' WHEN near AND NOT noisy THEN 'close'
  WHEN verified IS NOT NULL AND (noisy OR named OR known) THEN 'verified' ELSE 'unsupported' END AS reason FROM b3)
SELECT book_id, CASE WHEN reason IN ('explicit', 'verified') THEN wanted ELSE source END AS title, reason IN ('explicit', 'verified') AND kw <> ks AS rename_applied, reason,
  CASE WHEN reason IN ('no_title', 'variant') THEN '' WHEN reason = 'explicit' THEN 'explicit_config' ELSE array_to_string(list_filter([CASE WHEN verified IS NOT NULL THEN 'verified_profile' END, CASE WHEN noisy THEN 'noisy_source_name' END,
  CASE WHEN near THEN 'source_title_overlap' END, CASE WHEN named THEN 'title_in_opening_text' END, CASE WHEN known THEN 'profile_character_in_text' END], lambda x: x IS NOT NULL), ',') END AS signals FROM b4""")
def export_identity(spark, sf_dir):
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("book_id") % len(values) + 1).cast("int"))
    books = exports.openings(book_lines(spark, sf_dir)).select(
        "book_id",
        "opening",
        pick(_SOURCES).alias("source"),
        F.when(F.col("book_id") % 7 == 0, "定本").alias("explicit_title"),
        pick(_TITLES).alias("profile_title"),
        F.when(F.col("book_id") % 11 == 0, "同人").otherwise("").alias("about"),
        F.array(F.lit("他"), F.when(F.col("book_id") % 2 == 0, "收进抽屉").otherwise("无名氏")).alias("characters"),
    )
    return exports.export_identity(books).withColumn("signals", F.array_join("signals", ","))
