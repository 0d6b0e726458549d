"""Registered queries of the text, structure and scan operators, each with DuckDB SQL for the same rows."""

from __future__ import annotations

import functools
import inspect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import rules as R
from folioforge.functions import text as X
from folioforge.operators import scan, structure
from folioforge.plans.corpus import LINES_CTE, NUMERALS, book_lines

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = structure.line_offsets(book_lines(spark, sf_dir)).where(F.length("stripped") > 0)
    return rows.withColumn("folded", X.match_fold(F.col("stripped")))


WS = R.WS
FULL, HALF = X._FULL, X._HALF
#: The supplied texts need no NFKC beyond the full-width forms, so that translate() is NFKC on them.
FOLD_CTE = f"""
st AS (SELECT *, regexp_replace(raw, {q(f'^{WS}+|{WS}+$')}, '', 'g') AS stripped,
  (start + length(raw) - length(regexp_replace(raw, {q(f'^{WS}+')}, '')))::BIGINT AS start_offset FROM bl),
fx AS (SELECT *, regexp_replace(replace(translate(stripped, {q(FULL)}, {q(HALF)}), '…', '...'), {q(rf'([A-Za-z0-9]){WS}*(?:点|點|．|。){WS}*([A-Za-z0-9])')}, '\\1.\\2', 'g') AS ext FROM st WHERE length(stripped) > 0),
fo AS (SELECT *, lower(regexp_replace(ext, {q(WS + '+')}, '', 'g')) AS folded FROM fx)
"""
BASE = f"WITH {LINES_CTE}, {FOLD_CTE}"

DOMAINS = f"list_sort(list_distinct(list_concat(regexp_extract_all(folded, {q(R.DOMAIN_RE2)}, 1), regexp_extract_all(folded, {q(R.EMAIL_HOST)}, 1))))"
KNOWN = "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(folded, {q(a)})" for a in al) + f" THEN {q(k)} END" for k, al, _, _ in R.SITES) + "], lambda x: x IS NOT NULL)"
_STEM = "CASE " + " ".join(f"WHEN contains(split_part(d, '.', 1), {q(f)}) THEN {q(k)}" for k, _, fs, _ in R.SITES for f in fs) + " ELSE 'domain:' || d END"
SITES = f"list_sort(list_distinct(list_concat({KNOWN}, list_transform({DOMAINS}, lambda d: {_STEM}))))"
INTENTS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(folded, {q(p)}) THEN {q(k)} END" for k, p in R.INTENTS) + "], lambda x: x IS NOT NULL)"
SIGNALS = (
    "list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(folded, {q(p)}) THEN {q(k)} END" for k, p in R.SIGNALS)
    + f", CASE WHEN NOT regexp_matches(folded, {q(R.SIGNALS[5][1])}) AND len(list_filter({SITES}, lambda e: NOT starts_with(e, 'domain:'))) > 0 THEN 'reader_site' END], lambda x: x IS NOT NULL)"
)
KEY = "lower(regexp_replace(folded, '[0-9零〇一二两三四五六七八九十百千万]+', '#', 'g'))"
_NAMES = lambda names: "[" + ", ".join(q(n) for n in names) + "]"
STRENGTH = f"CASE WHEN len(list_intersect(signals, {_NAMES(R.STRONG)})) > 0 THEN 'strong' WHEN len(signals) > 0 THEN 'weak' ELSE 'none' END"
_TRAP = f"length(stripped) BETWEEN 1 AND {R.HEADING_CHARS} AND NOT (stripped[1:1] IN ({', '.join(q(c) for c in R.OPENING_QUOTES)})) AND NOT regexp_matches(stripped, {q(R.CATALOG)})"
_HEAD = lambda what: "CASE " + " ".join(f"WHEN regexp_matches(raw, {q(p)}) THEN {what(p, a, b, c)}" for p, a, b, c in R.HEADINGS) + " END"
CN_SQL = f"CASE WHEN regexp_matches(num, '^[0-9]+$') THEN num::BIGINT ELSE nullif(list_position([{', '.join(q(n) for n in NUMERALS)}], num), 0)::BIGINT END"
HEAD_CTE = f"""
h0 AS (SELECT *, {_HEAD(lambda p, a, b, c: f"regexp_replace(regexp_extract(raw, {q(p)}, {a}), {q(WS + '+')}, '', 'g')")} AS label,
  {_HEAD(lambda p, a, b, c: f"regexp_extract(raw, {q(p)}, {b})" if b else 'NULL')} AS num,
  {_HEAD(lambda p, a, b, c: f"regexp_replace(regexp_extract(raw, {q(p)}, {c}), {q(f'^{WS}+|{WS}+$')}, '', 'g')")} AS rest
  FROM st WHERE {_TRAP}),
hd AS (SELECT *, {CN_SQL} AS number FROM h0 WHERE label IS NOT NULL AND length(rest) <= {R.HEADING_REST} AND NOT regexp_matches(rest, {q(R.SENTENCE_MARK)})),
sz AS (SELECT book_id, max(start + length(raw))::BIGINT AS text_length FROM bl GROUP BY book_id),
pe AS (SELECT book_id, line_no, lag(e) OVER (PARTITION BY book_id ORDER BY line_no) AS text_before, max(e) OVER (PARTITION BY book_id) AS text_end
  FROM (SELECT book_id, line_no, (start_offset + length(stripped))::BIGINT AS e FROM st WHERE length(stripped) > 0)),
ch AS (SELECT hd.book_id, hd.line_no, start AS start_offset, start_offset AS title_start, (start_offset + length(stripped))::BIGINT AS title_end, least(start + length(raw) + 1, text_length)::BIGINT AS heading_end,
  stripped AS title, label, number, rest AS title_tail, text_length,
  row_number() OVER w AS chapter_index, coalesce(lead(start) OVER w, text_length) AS chapter_end,
  coalesce(lead(text_before) OVER w, text_end) - start_offset AS size
  FROM hd JOIN sz USING (book_id) JOIN pe ON pe.book_id = hd.book_id AND pe.line_no = hd.line_no WINDOW w AS (PARTITION BY hd.book_id ORDER BY hd.line_no)),
sl AS (SELECT book_id, chapter_index AS slice_index, 'chapter' AS kind, title, start_offset AS slice_start, heading_end, chapter_end AS slice_end FROM ch
  UNION ALL SELECT book_id, 0, 'front_matter', '前置内容', 0, 0, min(start_offset) FROM ch GROUP BY book_id HAVING min(start_offset) > 0
  UNION ALL SELECT book_id, 1, 'body', '正文', 0, 0, text_length FROM sz WHERE book_id NOT IN (SELECT book_id FROM ch))
"""
HEADED = f"{BASE}, {HEAD_CTE}"
_SHORT_SITE = "(" + " OR ".join(f"contains(folded, {q(a)})" for a in sorted({a for _, al, _, s in R.SITES if s for a in al})) + ")"
BLOCK_CTE = f"""
tg AS (SELECT fo.*, {SIGNALS} AS signals, EXISTS (SELECT 1 FROM hd WHERE hd.book_id = fo.book_id AND hd.line_no = fo.line_no) AS is_heading FROM fo),
kd AS (SELECT *, (start_offset + length(stripped))::BIGINT AS end_offset, {STRENGTH} AS strength, {KEY} AS key,
  CASE WHEN length(stripped) BETWEEN 12 AND {R.BLOCK_CHARS} AND NOT is_heading AND length(regexp_replace(stripped, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) >= 6 THEN 'regular'
       WHEN length(stripped) <= {R.BLOCK_CHARS} AND NOT is_heading AND (len(list_intersect(signals, {_NAMES(R.SHORT)})) > 0 OR {_SHORT_SITE}) THEN 'short_external'
       WHEN length(stripped) > {R.BLOCK_CHARS} AND (len(list_intersect(signals, {_NAMES(R.STRONG)})) > 0 OR {_SHORT_SITE}) THEN 'long_external' END AS kind FROM tg),
bk AS (SELECT * FROM kd WHERE kind IS NOT NULL)
"""
BLOCKED = f"{HEADED}, {BLOCK_CTE}"


@register("line_offsets", f"{BASE} SELECT book_id, line_no, start, start_offset, (start_offset + length(stripped))::BIGINT AS end_offset, md5(stripped) AS md5 FROM st")
def line_offsets(spark, sf_dir):
    rows = structure.line_offsets(book_lines(spark, sf_dir))
    return rows.select("book_id", "line_no", "start", "start_offset", "end_offset", F.md5("stripped").alias("md5"))


@register("repetition_key", f"{BASE}, k AS (SELECT book_id, {KEY} AS key FROM fo) SELECT book_id, substr(sha1(key), 1, 16) AS key_hash, count(*) AS n FROM k GROUP BY ALL")
def repetition_key(spark, sf_dir):
    rows = folded(spark, sf_dir).withColumn("key_hash", X.stable_hash(X.repetition_key(F.col("folded"))))
    return rows.groupBy("book_id", "key_hash").agg(F.count(F.lit(1)).alias("n"))


@register("signal_tags", f"{BASE}, t AS (SELECT book_id, line_no, {SIGNALS} AS signals FROM fo) SELECT book_id, line_no, array_to_string(signals, ',') AS signals, {STRENGTH} AS strength FROM t WHERE len(signals) > 0")
def signal_tags(spark, sf_dir):
    rows = folded(spark, sf_dir).withColumn("signals", X.signals(F.col("folded"))).where(F.size("signals") > 0)
    return rows.select("book_id", "line_no", F.array_join("signals", ",").alias("signals"), X.strength(F.col("signals")).alias("strength"))


@register("site_entities", f"{BASE}, t AS (SELECT book_id, unnest({SITES}) AS site FROM fo) SELECT book_id, site, count(*) AS n FROM t GROUP BY ALL")
def site_entities(spark, sf_dir):
    rows = folded(spark, sf_dir).select("book_id", F.explode(X.site_entities(F.col("folded"))).alias("site"))
    return rows.groupBy("book_id", "site").agg(F.count(F.lit(1)).alias("n"))


@register("promotion_intents", f"{BASE}, t AS (SELECT book_id, line_no, {INTENTS} AS intents FROM fo) SELECT book_id, line_no, array_to_string(intents, ',') AS intents FROM t WHERE len(intents) > 0")
def promotion_intents(spark, sf_dir):
    rows = folded(spark, sf_dir).select("book_id", "line_no", X.intents(F.col("folded")).alias("intents")).where(F.size("intents") > 0)
    return rows.withColumn("intents", F.array_join("intents", ","))


@register("domain_tokens", f"{BASE}, t AS (SELECT book_id, line_no, unnest({DOMAINS}) AS domain FROM fo) SELECT * FROM t")
def domain_tokens(spark, sf_dir):
    return folded(spark, sf_dir).select("book_id", "line_no", F.explode(X.domains(F.col("folded"))).alias("domain"))


_TEMPLATE = "lower(ext)"
_TEMPLATE = f"regexp_replace({_TEMPLATE}, {q(R.EMAIL)}, '{{email}}', 'g')"
#: RE2 has no look-around; a domain's neighbours are kept by groups.
_TEMPLATE = f"regexp_replace({_TEMPLATE}, {q(rf'(^|[^a-z0-9_-])(?:www\.)?{R.DOMAIN_NAME}($|[^a-z0-9_-])')}, '\\1{{domain}}\\2', 'g')"
_TEMPLATE = f"regexp_replace({_TEMPLATE}, {q(WS + '+')}, '', 'g')"
for _key, _aliases, _, _ in R.SITES:
    for _alias in _aliases:
        _TEMPLATE = f"replace({_TEMPLATE}, {q(_alias)}, {q('{site:' + _key + '}')})"
_TEMPLATE = f"regexp_replace(regexp_replace(regexp_replace({_TEMPLATE}, {q(R.AUTHOR_PHRASE)}, '{{author}}', 'g'), '[0-9]+', '#', 'g'), '[^0-9a-z\\x{{4e00}}-\\x{{9fff}}{{}}:#]+', '', 'g')[1:240]"


@register("family_template", f"{BASE} SELECT book_id, line_no, {_TEMPLATE} AS template FROM fo")
def family_template(spark, sf_dir):
    return folded(spark, sf_dir).select("book_id", "line_no", X.family_template(F.col("stripped")).alias("template"))


@register("narrative_guard", f"{BASE} SELECT book_id, line_no FROM fo WHERE " + " OR ".join(f"regexp_matches(stripped, {q(p)})" for p in R.NARRATIVE))
def narrative_guard(spark, sf_dir):
    return folded(spark, sf_dir).where(X.narrative(F.col("stripped"))).select("book_id", "line_no")


@register("source_marker", f"{BASE} SELECT book_id, line_no, regexp_matches(folded, {q('(?i)' + R.SOURCE_MARKER)}) AS marked, regexp_matches(folded, {q(R.BARE_COPY_MARKER)}) AS bare FROM fo WHERE marked OR bare")
def source_marker(spark, sf_dir):
    rows = folded(spark, sf_dir).select("book_id", "line_no", F.col("folded").rlike("(?i)" + R.SOURCE_MARKER).alias("marked"), F.col("folded").rlike(R.BARE_COPY_MARKER).alias("bare"))
    return rows.where("marked or bare")


VISIT = "(" + " OR ".join(f"regexp_matches(folded, {q(p)})" for p in X.visit_patterns("(?:$|[^a-z0-9_-])")) + ")"


@register("bound_visit", f"{BASE} SELECT book_id, line_no, stripped FROM fo WHERE {VISIT}")
def bound_visit(spark, sf_dir):
    return folded(spark, sf_dir).where(X.bound_visit(F.col("folded"))).select("book_id", "line_no", "stripped")


_GRAMS = "CASE WHEN length(key) = 0 THEN [] WHEN length(key) <= 3 THEN [key] ELSE list_distinct(list_transform(range(1, length(key) - 1), lambda i: substring(key, i, 3))) END"


@register(
    "ngrams_jaccard",
    f"""{BASE}, k AS (SELECT book_id, line_no, {KEY} AS key FROM fo WHERE length(stripped) <= 40), g AS (SELECT book_id, line_no, {_GRAMS} AS g FROM k)
    SELECT a.book_id, a.line_no, b.line_no AS other_line, round(len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))::DOUBLE, 9) AS jaccard
    FROM g a JOIN g b ON a.book_id = b.book_id AND a.line_no < b.line_no AND b.line_no - a.line_no <= 30
    WHERE len(list_intersect(a.g, b.g)) > 0 AND len(a.g) > 0 AND len(b.g) > 0""",
)
def ngrams_jaccard(spark, sf_dir):
    rows = folded(spark, sf_dir).where(F.length("stripped") <= 40).select("book_id", "line_no", X.ngrams(X.repetition_key(F.col("folded"))).alias("g"))
    other = rows.select("book_id", F.col("line_no").alias("other_line"), F.col("g").alias("h"))
    near = rows.join(other, "book_id").where((F.col("line_no") < F.col("other_line")) & (F.col("other_line") - F.col("line_no") <= 30))
    return near.select("book_id", "line_no", "other_line", F.round(X.jaccard(F.col("g"), F.col("h")), 9).alias("jaccard")).where("jaccard > 0")


def gram_pairs(rows: DataFrame) -> DataFrame:
    """Of book_id, line_no, g: all pairs of a book's lines that share a gram, and their similarity, by an equi-join on the grams."""
    posted = rows.select("book_id", "line_no", F.size("g").alias("n"), F.explode("g").alias("gram"))
    other = posted.select("book_id", "gram", F.col("line_no").alias("other_line"), F.col("n").alias("m"))
    shared = posted.join(other, ["book_id", "gram"]).where(F.col("line_no") < F.col("other_line"))
    shared = shared.groupBy("book_id", "line_no", "other_line", "n", "m").agg(F.count(F.lit(1)).alias("k"))
    return shared.select("book_id", "line_no", "other_line", F.round(F.col("k") / (F.col("n") + F.col("m") - F.col("k")), 9).alias("jaccard"))


@register("ngrams_jaccard_whole")
def ngrams_jaccard_whole(spark, sf_dir):
    """ngrams_jaccard without the limits of its SQL: lines of every length, and however far apart in their book."""
    return gram_pairs(folded(spark, sf_dir).select("book_id", "line_no", X.ngrams(X.repetition_key(F.col("folded"))).alias("g")))


@register("simhash")
def simhash(spark, sf_dir):
    rows = folded(spark, sf_dir).withColumn("key", X.repetition_key(F.col("folded"))).where(F.length("key").between(*R.NEAR_KEY))
    return rows.select("book_id", "line_no", X.simhash(F.col("key")).alias("simhash"))


@register("heading_match", f"{HEADED} SELECT book_id, line_no, label, number, rest AS title_tail FROM hd")
def heading_match(spark, sf_dir):
    return structure.headings(book_lines(spark, sf_dir)).select("book_id", "line_no", "label", "number", "title_tail")


@register("cn_number", f"{HEADED} SELECT book_id, line_no, num AS numeral, number FROM hd")
def cn_number(spark, sf_dir):
    """The numbers of all headings."""
    rows = book_lines(spark, sf_dir).withColumn("heading", X.heading(F.col("raw"))).where("heading is not null")
    return rows.select("book_id", "line_no", F.col("heading.number").alias("numeral"), X.cn_number(F.col("heading.number")).alias("number"))


@register("chapters", f"{HEADED} SELECT book_id, chapter_index, title, number, start_offset, chapter_end, size FROM ch")
def chapters(spark, sf_dir):
    return structure.chapters(book_lines(spark, sf_dir)).select("book_id", "chapter_index", "title", "number", "start_offset", "chapter_end", "size")


_NON = "SELECT book_id, chapter_index, label, number, previous FROM (SELECT *, lag(number) OVER (PARTITION BY book_id ORDER BY start_offset) AS previous FROM ch WHERE number IS NOT NULL) WHERE number < previous"


@register("non_monotonic", f"{HEADED} {_NON}")
def non_monotonic(spark, sf_dir):
    return structure.non_monotonic(structure.chapters(book_lines(spark, sf_dir)))


@register("slices", f"{HEADED} SELECT * FROM sl")
def slices(spark, sf_dir):
    return structure.slices(book_lines(spark, sf_dir))


@register(
    "slice_tiling_check",
    f"""{HEADED}, g AS (SELECT *, slice_start - coalesce(lag(slice_end) OVER (PARTITION BY book_id ORDER BY slice_start, slice_index), 0) AS gap FROM sl)
    SELECT g.book_id, count(*) AS n_slices, bool_and(gap = 0 AND heading_end BETWEEN slice_start AND slice_end) AND max(slice_end) = any_value(text_length) AS valid
    FROM g JOIN sz USING (book_id) GROUP BY g.book_id""",
)
def slice_tiling_check(spark, sf_dir):
    lines = book_lines(spark, sf_dir)
    return structure.tiling_check(structure.slices(lines), structure.book_sizes(lines))


@register("duplicate_titles", f"{HEADED} SELECT book_id, title, count(*) AS n FROM ch GROUP BY ALL HAVING count(*) > 1")
def duplicate_titles(spark, sf_dir):
    return structure.duplicate_titles(structure.chapters(book_lines(spark, sf_dir)))


@register(
    "structure_confidence",
    f"""{HEADED}, c AS (SELECT book_id, count(*) AS n_chapters, count(*) FILTER (WHERE size < 200) AS very_short, count(*) FILTER (WHERE size > 20000) AS very_long FROM ch GROUP BY book_id),
    d AS (SELECT book_id, count(*) AS duplicates FROM (SELECT book_id, title FROM ch GROUP BY ALL HAVING count(*) > 1) GROUP BY book_id),
    m AS (SELECT book_id, count(*) AS non_monotonic FROM ({_NON}) GROUP BY book_id),
    r AS (SELECT sz.book_id, text_length, coalesce(n_chapters, 0) AS n_chapters, coalesce(very_short, 0) AS very_short, coalesce(very_long, 0) AS very_long, coalesce(duplicates, 0) AS duplicates, coalesce(non_monotonic, 0) AS non_monotonic
      FROM sz LEFT JOIN c USING (book_id) LEFT JOIN d USING (book_id) LEFT JOIN m USING (book_id)),
    s AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN n_chapters = 0 THEN 0.05::DOUBLE ELSE 0.35::DOUBLE + 0.45::DOUBLE * least(1.0::DOUBLE, n_chapters / (CASE WHEN text_length < 120000 THEN 1 ELSE greatest(3, text_length // 100000) END)::DOUBLE)
      + CASE WHEN n_chapters >= 20 THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN n_chapters >= 100 THEN 0.08::DOUBLE ELSE 0 END END
      - least(0.2::DOUBLE, duplicates / greatest(1, n_chapters)::DOUBLE * 0.6) - least(0.25::DOUBLE, non_monotonic / greatest(1, n_chapters)::DOUBLE * 0.8)
      - CASE WHEN n_chapters > 0 AND very_long / greatest(1, n_chapters)::DOUBLE > 0.25 THEN 0.15::DOUBLE ELSE 0 END)) AS sc FROM r)
    SELECT book_id, text_length, n_chapters, very_short, very_long, duplicates, non_monotonic, round(sc, 4) AS score, CASE WHEN sc >= 0.78 THEN 'high' WHEN sc >= 0.45 THEN 'medium' ELSE 'low' END AS level FROM s""",
)
def structure_confidence(spark, sf_dir):
    return structure.structure_report(book_lines(spark, sf_dir))


_CUT = lambda c: f"coalesce((SELECT max(e) FROM le WHERE le.book_id = r.book_id AND e > {c} + {R.FALLBACK_CHUNK // 2 + 1} AND e <= {c} + {R.FALLBACK_CHUNK + 1}), (SELECT min(e) FROM le WHERE le.book_id = r.book_id AND e >= {c} + {R.FALLBACK_CHUNK + 1}), total)"


@register(
    "fallback_chunks",
    f"""WITH RECURSIVE {LINES_CTE}, le AS (SELECT b.book_id, b.start + length(b.raw) + 1 AS e FROM bl b), tt AS (SELECT book_id, max(start + length(raw))::BIGINT AS total FROM bl GROUP BY book_id),
    r AS (SELECT book_id, total, 0::BIGINT AS chunk_index, 0::BIGINT AS chunk_start, 0::BIGINT AS chunk_end FROM tt
      UNION ALL SELECT r.book_id, total, chunk_index + 1, r.chunk_end, CASE WHEN r.chunk_end + {R.FALLBACK_CHUNK} >= total THEN total ELSE least(total, {_CUT('r.chunk_end')}) END FROM r WHERE r.chunk_end < total)
    SELECT book_id, chunk_index, chunk_start, chunk_end FROM r WHERE chunk_index > 0""",
)
def fallback_chunks(spark, sf_dir):
    return structure.fallback_chunks(book_lines(spark, sf_dir))


@register("blocks", f"{BLOCKED} SELECT book_id, line_no, start_offset, end_offset, kind, strength, md5(key) AS key_md5 FROM bk")
def blocks(spark, sf_dir):
    return scan.blocks(book_lines(spark, sf_dir)).select("book_id", "line_no", "start_offset", "end_offset", "kind", "strength", F.md5("key").alias("key_md5"))


PAIR_CTE = f"""
bs AS (SELECT b.*, coalesce((SELECT max(slice_index) FROM sl WHERE sl.book_id = b.book_id AND slice_start <= b.start_offset AND slice_end > b.start_offset), -1) AS slice_index FROM bk b WHERE len(signals) > 0),
pr AS (SELECT a.book_id, a.line_no, b.line_no AS n_line_no, a.start_offset, b.start_offset AS n_start_offset, a.stripped, b.stripped AS n_stripped, (b.line_no - a.line_no)::INT AS distance
  FROM bs a JOIN bs b ON a.book_id = b.book_id AND b.line_no - a.line_no IN (1, 2) AND a.slice_index = b.slice_index
  WHERE (len(list_intersect(a.signals, {_NAMES(R.NEIGHBOR)})) > 0 OR len(list_intersect(b.signals, {_NAMES(R.NEIGHBOR)})) > 0)
    AND NOT (b.line_no - a.line_no = 2 AND EXISTS (SELECT 1 FROM fo m WHERE m.book_id = a.book_id AND m.line_no = a.line_no + 1)))
"""


@register(
    "neighbor_spans",
    f"""{BLOCKED}, {PAIR_CTE} SELECT book_id, line_no AS source_line, n_line_no AS neighbor_line, 'after' AS direction, distance AS line_distance, n_stripped AS original FROM pr
    UNION ALL SELECT book_id, n_line_no, line_no, 'before', distance, stripped FROM pr""",
)
def neighbor_spans(spark, sf_dir):
    lines = book_lines(spark, sf_dir)
    spans = scan.neighbour_spans(scan.neighbour_pairs(scan.blocks_in_order(lines), structure.slices(lines)))
    return spans.select("book_id", "source_line", "neighbor_line", "direction", "line_distance", "original")


_EDGE = "(SELECT min(least(abs(b.start_offset - slice_start), abs(b.start_offset - slice_end))) FROM sl WHERE sl.book_id = b.book_id)"


@register("nearest_boundary", f"{BLOCKED} SELECT book_id, line_no, {_EDGE}::BIGINT AS boundary_distance FROM bk b")
def nearest_boundary(spark, sf_dir):
    lines = book_lines(spark, sf_dir)
    return scan.boundary_distance(scan.blocks(lines), structure.slices(lines)).select("book_id", "line_no", "boundary_distance")


@register("anchor_chapter", f"{BLOCKED} SELECT b.book_id, b.line_no, slice_index, sl.kind, title FROM bk b LEFT JOIN sl ON sl.book_id = b.book_id AND slice_start <= b.start_offset AND b.start_offset < slice_end")
def anchor_chapter(spark, sf_dir):
    lines = book_lines(spark, sf_dir)
    rows = scan.with_slice(scan.blocks(lines).select("book_id", "line_no", "start_offset"), structure.slices(lines))
    return rows.select("book_id", "line_no", F.col("slice.slice_index").alias("slice_index"), F.col("slice.kind").alias("kind"), F.col("slice.title").alias("title"))


@register(
    "l1_exact",
    f"""{BLOCKED} SELECT book_id, md5(key) AS key_md5, count(*) AS n, min(start_offset) AS first_start,
    string_agg(start_offset || '-' || end_offset, ',' ORDER BY start_offset) AS members FROM bk GROUP BY book_id, key HAVING count(*) >= 3""",
)
def l1_exact(spark, sf_dir):
    spans = F.transform("members", lambda m: F.concat_ws("-", m["start_offset"].cast("string"), m["end_offset"].cast("string")))
    return scan.exact_groups(scan.blocks(book_lines(spark, sf_dir))).select("book_id", F.md5("key").alias("key_md5"), "n", "first_start", F.array_join(spans, ",").alias("members"))


@register("l3_groups", f"{BLOCKED} SELECT book_id, CASE WHEN strength = 'strong' THEN 'strong:' ELSE 'weak:' END || substr(sha1(key), 1, 16) AS \"group\", count(*) AS n FROM bk WHERE len(signals) > 0 GROUP BY ALL")
def l3_groups(spark, sf_dir):
    rows = scan.blocks(book_lines(spark, sf_dir)).where(F.size("signals") > 0)
    named = F.concat(F.when(F.col("strength") == "strong", "strong:").otherwise("weak:"), X.stable_hash(F.col("key")))
    return rows.groupBy("book_id", named.alias("group")).agg(F.count(F.lit(1)).alias("n"))


@register("l4_structural", f"{BLOCKED} SELECT book_id, line_no FROM bk b WHERE len(signals) > 0 AND length(stripped) <= {R.L4_CHARS} AND {_EDGE} <= {R.L4_RADIUS}")
def l4_structural(spark, sf_dir):
    lines = book_lines(spark, sf_dir)
    return scan.structural(scan.blocks(lines), structure.slices(lines)).select("book_id", "line_no")


@register("lsh_pairs")
def lsh_pairs(spark, sf_dir):
    rows = scan.blocks(book_lines(spark, sf_dir)).where(F.length("key").between(*R.NEAR_KEY))
    return scan.near_pairs(rows)


@register("components")
def components(spark, sf_dir):
    rows = scan.blocks(book_lines(spark, sf_dir)).where(F.length("key").between(*R.NEAR_KEY))
    return scan.components(scan.near_pairs(rows))


@register("candidate_pool")
def candidate_pool(spark, sf_dir):
    return scan.cascade(book_lines(spark, sf_dir)).groupBy("book_id", "layer", "group").agg(F.count(F.lit(1)).alias("n"))


#: Without the near layer, whose SimHash DuckDB does not have: exact repetition, then patterns.
RANK_CTE = f"""
x1 AS (SELECT book_id, key FROM bk GROUP BY book_id, key HAVING count(*) >= 3),
tk AS (SELECT bk.*, 'L1' AS layer, bk.key AS grp FROM bk JOIN x1 USING (book_id, key)
  UNION ALL SELECT bk.*, 'L3', CASE WHEN strength = 'strong' THEN 'strong:' ELSE 'weak:' END || substr(sha1(key), 1, 16) FROM bk WHERE len(signals) > 0 AND (book_id, key) NOT IN (SELECT book_id, key FROM x1)),
cg AS (SELECT book_id, layer, grp, count(*) AS occurrence_count, min(start_offset) AS first_start, arg_min(stripped, start_offset) AS sample,
  list_sort(list_distinct(flatten(list(signals)))) AS signals, min(CASE WHEN kind = 'long_external' THEN 'long_line_mixed_content' END) AS guard FROM tk GROUP BY ALL),
cs AS (SELECT *, {STRENGTH} AS strength, len(list_intersect(signals, {_NAMES(R.STRONG)})) > 0 AS st FROM cg),
cr AS (SELECT *, CASE WHEN st THEN 'high' ELSE 'medium' END AS priority, CASE WHEN guard IS NOT NULL THEN 'high' WHEN st THEN 'low' ELSE 'medium' END AS risk FROM cs),
ck AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY CASE strength WHEN 'strong' THEN 0 WHEN 'weak' THEN 1 ELSE 2 END, CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END,
  CASE risk WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, CASE layer WHEN 'L3' THEN 0 WHEN 'L1' THEN 1 ELSE 2 END, -occurrence_count, sample, first_start) AS rank FROM cr)
"""
RANKED = f"{BLOCKED}, {RANK_CTE}"


def taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that the exact and pattern layers take."""
    return taken_of(scan.blocks(book_lines(spark, sf_dir)))


def taken_of(blocks: DataFrame) -> DataFrame:
    found = scan.with_repeats(blocks.drop("folded"))
    exact = F.col("repeats") >= 3
    named = F.concat(F.when(F.col("strength") == "strong", "strong:").otherwise("weak:"), X.stable_hash(F.col("key")))
    rows = found.where(exact | (F.size("signals") > 0)).withColumn("layer", F.when(exact, "L1").otherwise("L3"))
    return rows.withColumn("group", F.when(exact, F.col("key")).otherwise(named)).drop("repeats")


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the exact and pattern layers."""
    return scan.candidates(taken(spark, sf_dir))


def ranked_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of all four layers with all their anchors, and ids that do not end at four digits. DuckDB has no SimHash, so the queries over
    these have no SQL."""
    rows = scan.candidates(scan.cascade(book_lines(spark, sf_dir)), max_anchors=None)
    return rows.withColumn("candidate_id", F.format_string("AD-%04d", "rank"))


@register("candidate_rank", f"{RANKED} SELECT book_id, rank, 'AD-' || lpad(rank::VARCHAR, 4, '0') AS candidate_id, layer, occurrence_count, strength, priority, risk, sample FROM ck")
def candidate_rank(spark, sf_dir, layers=ranked):
    return layers(spark, sf_dir).select("book_id", "rank", "candidate_id", "layer", "occurrence_count", "strength", "priority", "risk", "sample")


@register(
    "page_manifest",
    f"""{RANKED} SELECT book_id, ((rank - 1) // 10 + 1)::BIGINT AS page, count(*) AS record_count,
    sha256(string_agg('AD-' || lpad(rank::VARCHAR, 4, '0') || '|' || sample, chr(10) ORDER BY rank)) AS page_sha256 FROM ck GROUP BY ALL""",
)
def page_manifest(spark, sf_dir, layers=ranked):
    return scan.pages(layers(spark, sf_dir), 10)


@register(
    "page_integrity",
    f"""{RANKED}, p AS (SELECT book_id, ((rank - 1) // 10 + 1)::BIGINT AS page, count(*) AS n FROM ck GROUP BY ALL)
    SELECT book_id, page, CASE WHEN book_id % 5 = 1 AND page = 1 THEN 'missing' WHEN book_id % 5 = 2 AND page = 1 THEN 'extra' WHEN book_id % 5 = 3 AND page = 1 THEN 'changed' ELSE 'ok' END AS state FROM p""",
)
def page_integrity(spark, sf_dir, layers=ranked):
    """Pages with one loss, one stray page and one changed page planted in every five books."""
    whole = scan.pages(layers(spark, sf_dir), 10)
    planted = lambda k: (F.col("book_id") % 5 == k) & (F.col("page") == 1)
    declared = whole.where(~planted(2)).withColumn("page_sha256", F.when(planted(3), F.lit("0")).otherwise(F.col("page_sha256")))
    return scan.page_integrity(declared, whole.where(~planted(1)))


def register_whole(queries: dict) -> None:
    """Each of the queries over ranked() again over all four layers, with `_whole` after its name; their SQL holds for ranked() only."""
    for name, f in list(queries.items()):
        if "layers" in inspect.signature(f).parameters:
            queries[f"{name}_whole"] = functools.partial(f, layers=ranked_whole)


register_whole(QUERIES)
