"""Registered queries of the title, mask, layout, decision, edit, verification and export operators, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.checkpoints import cut
from folioforge.functions import rules as R
from folioforge.functions import text as X
from folioforge.operators import edits, layout, structure
from folioforge.plans.corpus import book_lines
from folioforge.plans.scan_queries import BASE, HEADED, RANKED, q, ranked, ranked_whole, register_whole

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@register("newline_normalize", r"""WITH t AS (SELECT doc_id, coalesce(text, '') || chr(13) || chr(10) || 'a' || chr(13) || chr(8203) || 'b' || chr(8232) || chr(65279) AS t FROM documents)
SELECT doc_id, md5(translate(regexp_replace(t, '\r\n|\r|\x{2028}|\x{2029}', chr(10), 'g'), chr(65279) || chr(8203) || chr(8204) || chr(8205) || chr(8288), '')) AS md5 FROM t""")
def newline_normalize(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", F.md5(layout.normalize_newlines(F.concat(F.coalesce("text", F.lit("")), F.lit("\r\na\r\u200bb\u2028\ufeff")))).alias("md5"))


_PAIRS = ("（）", "()", "[]", "{}", "【】", "《》", "「」", "『』")
_COUNT = lambda ch: f"(length(title) - length(replace(title, {q(ch)}, '')))"


@register("bracket_issues", f"{HEADED}, i AS (SELECT book_id, line_no, array_to_string(list_filter([{', '.join(f'CASE WHEN {_COUNT(p[0])} <> {_COUNT(p[1])} THEN {q(p)} END' for p in _PAIRS)}], lambda x: x IS NOT NULL), ',') AS issues FROM ch) SELECT * FROM i WHERE issues <> ''")
def bracket_issues(spark, sf_dir):
    rows = structure.headings(book_lines(spark, sf_dir)).select("book_id", "line_no", layout.bracket_issues(F.col("title")).alias("issues"))
    return rows.where(F.size("issues") > 0).withColumn("issues", F.array_join("issues", ","))


@register("broken_title", f"""{HEADED}, r AS (SELECT fo.book_id, fo.line_no, fo.stripped, ch.title, ch.title_tail, lead(fo.stripped) OVER w AS nx, lead(ch.title IS NOT NULL) OVER w AS nh
  FROM fo LEFT JOIN ch ON fo.book_id = ch.book_id AND fo.line_no = ch.line_no WINDOW w AS (PARTITION BY fo.book_id ORDER BY fo.line_no))
SELECT book_id, line_no, title || ' ' || nx AS proposed FROM r WHERE title IS NOT NULL AND title_tail = '' AND NOT nh AND length(nx) <= 30 AND NOT regexp_matches(nx, '[。！？!?]$')""")
def broken_title(spark, sf_dir):
    lines = book_lines(spark, sf_dir)
    return layout.broken_titles(lines, structure.headings(lines))


@register("pseudo_title", f"{HEADED} SELECT book_id, line_no FROM bl WHERE regexp_matches(raw, {q(layout.MENTION)}) AND (book_id, line_no) NOT IN (SELECT book_id, line_no FROM ch)")
def pseudo_title(spark, sf_dir):
    lines = book_lines(spark, sf_dir)
    return layout.pseudo_titles(lines, structure.headings(lines))


@register("mask_counts", f"""{BASE}, m AS (SELECT book_id, line_no, (len(regexp_extract_all(raw, {q(layout.MASK_RUN)})) + len(regexp_extract_all(regexp_replace(raw, {q(layout.MASK_RUN)}, '#', 'g'), '[\\x{{4e00}}-\\x{{9fff}}][\\*＊×Xx□■口][\\x{{4e00}}-\\x{{9fff}}]')))::INT AS masks,
  len(regexp_extract_all(raw, {q(layout.SEPARATOR)}))::INT AS separators FROM bl) SELECT * FROM m WHERE masks + separators > 0""")
def mask_counts(spark, sf_dir):
    return layout.mask_counts(book_lines(spark, sf_dir))


# A run of masks with the CJK character among them would be cut by its neighbours, which this SQL does not do; the test does.
@register("mask_spans", f"""{BASE}, whole AS (SELECT book_id, string_agg(raw, chr(10) ORDER BY line_no) AS book FROM bl GROUP BY 1),
ch AS (SELECT book_id, line_no, start, raw, unnest(range(1, length(raw) + 1)) AS i FROM bl WHERE regexp_matches(raw, '[\\*＊×Xx□■口]')),
ma AS (SELECT *, i - row_number() OVER (PARTITION BY book_id, line_no ORDER BY i) AS run FROM ch WHERE regexp_matches(substring(raw, i, 1), '[\\*＊×Xx□■口]')),
ru AS (SELECT book_id, line_no, start, raw, min(i) AS a, max(i) AS b FROM ma GROUP BY book_id, line_no, start, raw, run),
mk AS (SELECT 0 AS rank, 'mask_chars' AS mask_type, book_id, line_no, start + a - 1 AS s, start + b AS e FROM ru
  WHERE b > a OR (a > 1 AND regexp_matches(substring(raw, a - 1, 1), '[\\x{{4e00}}-\\x{{9fff}}]') AND regexp_matches(substring(raw, b + 1, 1), '[\\x{{4e00}}-\\x{{9fff}}]'))),
sp AS (SELECT book_id, line_no, start, regexp_extract_all(raw, {q(layout.SEPARATOR)}) AS f, string_split_regex(raw, {q(layout.SEPARATOR)}) AS t FROM bl WHERE regexp_matches(raw, {q(layout.SEPARATOR)})),
si AS (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM sp),
sa AS (SELECT *, start + length(array_to_string(t[1:i], '')) + length(array_to_string(f[1:i - 1], '')) AS s FROM si),
al AS (SELECT * FROM mk UNION ALL SELECT 1, 'word_separator', book_id, line_no, s, s + length(f[i]) FROM sa),
nu AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY rank, s) AS n FROM al)
SELECT book_id, line_no, printf('BW-%04d', n) AS id, mask_type, s::BIGINT AS start, e::BIGINT AS "end", substring(book, s + 1, e - s) AS original,
  substring(book, greatest(s - 10, 0) + 1, least(s, 10)) AS prefix, substring(book, e + 1, 10) AS suffix
FROM nu JOIN whole USING (book_id) WHERE n <= 500""")
def mask_spans(spark, sf_dir):
    return layout.mask_spans(book_lines(spark, sf_dir))


def punctuated(c: str) -> str:
    """SQL of safe_punctuation: RE2 has no look-around, and a mark's next character may be the one before the next mark, hence twice."""
    for half, full in layout.PUNCTUATION.items():
        for _ in range(2):
            c = f"regexp_replace({c}, {q(f'([{R.CJK}])[{half}]($|[{R.WS[1:-1]}{R.CJK}' + chr(34) + chr(39) + '”’」』）】》])')}, {q(chr(92) + '1' + full + chr(92) + '2')}, 'g')"
    return c


@register("safe_punctuation", f"{BASE} SELECT book_id, line_no, {punctuated('raw')} AS line FROM bl")
def safe_punctuation(spark, sf_dir):
    return book_lines(spark, sf_dir).select("book_id", "line_no", layout.safe_punctuation(F.col("raw")).alias("line"))


@register("squeeze_spaces")
def squeeze_spaces(spark, sf_dir):
    return book_lines(spark, sf_dir).select("book_id", "line_no", layout.squeeze_spaces(F.col("raw")).alias("line"))


def _collapsed(raw: str, source: str) -> str:
    """SQL of collapse_blank over `source`, as the common table expression cb."""
    blank = f"regexp_replace({raw}, {q(R.WS + '+')}, '', 'g') = ''"
    return f"""g0 AS (SELECT book_id, line_no, {raw} AS raw, {blank} AS blank, sum(CASE WHEN {blank} THEN 0 ELSE 1 END) OVER (PARTITION BY book_id ORDER BY line_no) AS run FROM {source}),
cb AS (SELECT book_id, line_no, CASE WHEN blank THEN '' ELSE raw END AS raw FROM (SELECT *, row_number() OVER (PARTITION BY book_id, run, blank ORDER BY line_no) AS nth FROM g0) WHERE NOT blank OR nth <= 1)"""


@register("blank_collapse", f"{BASE}, {_collapsed('raw', 'bl')} SELECT * FROM cb")
def blank_collapse(spark, sf_dir):
    return layout.collapse_blank(book_lines(spark, sf_dir))


@register("layout_normalize", f"""{HEADED}, b AS (SELECT bl.book_id, bl.line_no, {punctuated(f"regexp_replace(bl.raw, '[ {chr(9)}　]+$', '')")} AS s, ch.title IS NOT NULL AS h FROM bl LEFT JOIN ch ON bl.book_id = ch.book_id AND bl.line_no = ch.line_no),
i AS (SELECT book_id, line_no, CASE WHEN h OR regexp_replace(s, {q(R.WS + '+')}, '', 'g') = '' THEN s ELSE '　　' || regexp_replace(s, '^[ {chr(9)}　]+', '') END AS line FROM b), {_collapsed('line', 'i')}
SELECT book_id, md5(CASE WHEN ends_with(t, chr(10)) THEN t ELSE t || chr(10) END) AS md5 FROM (SELECT book_id, string_agg(raw, chr(10) ORDER BY line_no) AS t FROM cb GROUP BY book_id)""")
def layout_normalize(spark, sf_dir):
    lines = book_lines(spark, sf_dir)
    return layout.normalize_layout(lines, structure.headings(lines)).select("book_id", F.md5("text").alias("md5"))


@register("markdown_export", f"""{HEADED}, tx AS (SELECT book_id, string_agg(raw, chr(10) ORDER BY line_no) AS text FROM bl GROUP BY book_id)
SELECT sl.book_id, md5(string_agg(CASE WHEN kind = 'chapter' THEN '{layout.MARKER}' || chr(10) || '## ' ELSE '' END || substring(text, slice_start + 1, slice_end - slice_start), '' ORDER BY slice_start)) AS md5, true AS restored
FROM sl JOIN tx USING (book_id) GROUP BY sl.book_id""")
def markdown_export(spark, sf_dir):
    lines = book_lines(spark, sf_dir)
    texts = structure.texts_of_lines(lines)
    made = layout.markdown(texts, structure.slices(lines)).join(texts, "book_id")
    return made.select("book_id", F.md5("markdown").alias("md5"), (layout.text_of_markdown(F.col("markdown")) == F.col("text")).alias("restored"))


def reviewed(spark, sf_dir, layers=ranked):
    """Candidates with a review each, made by rule; those of the exact and pattern layers unless told otherwise."""
    rows = cut(layers(spark, sf_dir))
    verdict = F.when(F.col("rank") % 5 == 0, "keep").when((F.col("strength") == "strong") & (F.col("risk") == "low"), "delete").otherwise("uncertain")
    strategy = F.when(F.col("rank") % 3 == 0, "exact").when(F.col("rank") % 3 == 1, "remove_paragraph").otherwise("fallback_newline")
    reviews = rows.select("book_id", "candidate_id", verdict.alias("verdict"), F.lit(0.9).alias("confidence"), F.lit("rule").alias("reason"), strategy.alias("strategy"))
    return rows, reviews


DECIDED = f"""{RANKED},
dc AS (SELECT ck.*, 'AD-' || lpad(rank::VARCHAR, 4, '0') AS candidate_id, CASE WHEN rank % 5 = 0 THEN 'keep' WHEN strength = 'strong' AND risk = 'low' THEN 'delete' ELSE 'uncertain' END AS verdict,
  CASE rank % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'remove_paragraph' ELSE 'fallback_newline' END AS strategy FROM ck),
mx AS (SELECT book_id, max(line_no) AS last_line FROM bl GROUP BY book_id),
op AS (SELECT dc.book_id, candidate_id, tk.stripped AS original, CASE WHEN strategy = 'remove_paragraph' THEN tk.start ELSE tk.start_offset END AS op_start,
  CASE WHEN strategy = 'remove_paragraph' THEN tk.start + length(tk.raw) + CASE WHEN tk.line_no < last_line THEN 1 ELSE 0 END ELSE tk.end_offset END::BIGINT AS op_end,
  CASE WHEN strategy = 'fallback_newline' THEN chr(10) ELSE '' END AS replacement
  FROM dc JOIN tk ON dc.book_id = tk.book_id AND dc.layer = tk.layer AND dc.grp = tk.grp JOIN mx ON mx.book_id = dc.book_id WHERE verdict = 'delete' AND occurrence_count <= {R.MAX_ANCHORS}),
tx AS (SELECT book_id, string_agg(raw, chr(10) ORDER BY line_no) AS text FROM bl GROUP BY book_id),
pc AS (SELECT op.*, coalesce(lag(op_end) OVER (PARTITION BY book_id ORDER BY op_start), 0) AS kept_from FROM op),
ap AS (SELECT tx.book_id, coalesce((SELECT string_agg(substring(text, kept_from + 1, op_start - kept_from) || replacement, '' ORDER BY op_start) || substring(text, max(op_end) + 1) FROM pc WHERE pc.book_id = tx.book_id), text) AS after, text FROM tx)
"""


def applied(spark, sf_dir, layers=ranked):
    lines = book_lines(spark, sf_dir)
    candidates, reviews = reviewed(spark, sf_dir, layers)
    decisions = edits.compile_decisions(candidates, reviews)
    return lines, decisions, cut(edits.build_operations(decisions, lines))


@register("compile_decisions", f"{DECIDED} SELECT book_id, candidate_id, verdict, strategy, occurrence_count FROM dc")
def compile_decisions(spark, sf_dir, layers=ranked):
    candidates, reviews = reviewed(spark, sf_dir, layers)
    return edits.compile_decisions(candidates, reviews).select("book_id", "candidate_id", "verdict", "strategy", "occurrence_count")


@register("review_coverage", f"""{DECIDED} SELECT book_id, candidate_id, 'missing' AS problem FROM dc WHERE rank % 11 = 0
UNION ALL SELECT book_id, candidate_id, 'duplicate' FROM dc WHERE rank % 13 = 0 AND rank % 11 <> 0 UNION ALL SELECT DISTINCT book_id, 'AD-none', 'unexpected' FROM dc WHERE rank = 1""")
def review_coverage(spark, sf_dir, layers=ranked):
    candidates, reviews = reviewed(spark, sf_dir, layers)
    number = F.substring("candidate_id", 4, 20).cast("int")
    kept = reviews.where(number % 11 != 0)
    return edits.coverage(candidates, kept.unionByName(kept.where(number % 13 == 0)).unionByName(reviews.where(number == 1).withColumn("candidate_id", F.lit("AD-none"))))


@register("review_violations", f"{DECIDED} SELECT book_id, candidate_id, CASE WHEN rank % 7 = 0 AND rank % 10 = 0 THEN 'verdict,confidence' WHEN rank % 7 = 0 THEN 'verdict' WHEN rank % 10 = 0 THEN 'confidence' ELSE 'reason' END AS violations FROM dc WHERE rank % 7 = 0 OR rank % 10 = 0 OR rank % 17 = 0")
def review_violations(spark, sf_dir, layers=ranked):
    """Over the reviews of all candidates, with wrong verdicts, confidences and reasons planted by rank."""
    _, reviews = reviewed(spark, sf_dir, layers)
    number = F.substring("candidate_id", 4, 20).cast("int")
    reviews = reviews.withColumn("verdict", F.when(number % 7 == 0, "drop").otherwise(F.col("verdict"))).withColumn("confidence", F.when(number % 10 == 0, 1.5).otherwise(F.col("confidence")))
    reviews = reviews.withColumn("reason", F.when((number % 17 == 0) & (number % 7 != 0) & (number % 10 != 0), " ").otherwise(F.col("reason")))
    return edits.review_violations(reviews).select("book_id", "candidate_id", F.array_join("violations", ",").alias("violations"))


@register("overlap_check", f"""{DECIDED}, w AS (SELECT book_id, candidate_id, op_start, op_end + 40 AS op_end FROM op)
SELECT book_id, candidate_id, op_start, reach FROM (SELECT *, max(op_end) OVER (PARTITION BY book_id ORDER BY op_start, op_end, candidate_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w) WHERE op_start < reach""")
def overlap_check(spark, sf_dir, layers=ranked):
    """Over all operations, each stretched by 40 characters so that some overlap."""
    return edits.overlaps(applied(spark, sf_dir, layers)[2].withColumn("op_end", F.col("op_end") + 40))


@register("replay_check", f"{DECIDED} SELECT book_id, book_id % 3 <> 0 AS replayed FROM ap")
def replay_check(spark, sf_dir, layers=ranked):
    """Against what was written, with one book in three changed after it."""
    lines, _, operations = applied(spark, sf_dir, layers)
    texts = structure.texts_of_lines(lines)
    after = edits.apply_operations(texts, operations)
    return edits.replay(texts, operations, after.withColumn("text", F.when(F.col("book_id") % 3 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))))


@register("op_build", f"{DECIDED} SELECT book_id, candidate_id, op_start, op_end, original, replacement FROM op")
def op_build(spark, sf_dir, layers=ranked):
    return applied(spark, sf_dir, layers)[2]


@register("apply_splice", f"{DECIDED} SELECT book_id, md5(after) AS md5, length(after) AS n_chars FROM ap")
def apply_splice(spark, sf_dir, layers=ranked):
    lines, _, operations = applied(spark, sf_dir, layers)
    return edits.apply_operations(structure.texts_of_lines(lines), operations).select("book_id", F.md5("text").alias("md5"), F.length("text").cast("long").alias("n_chars"))


@register("op_accounting", f"""{DECIDED}, a AS (SELECT book_id, candidate_id, least(occurrence_count, {R.MAX_ANCHORS}) AS asked FROM dc WHERE verdict = 'delete'),
d AS (SELECT book_id, candidate_id, count(*) AS done, count(DISTINCT op_start) AS places FROM op GROUP BY ALL)
SELECT book_id, sum(asked)::BIGINT AS asked, coalesce(sum(done), 0)::BIGINT AS done, sum(greatest(0, asked - coalesce(done, 0)))::BIGINT AS missing, sum(greatest(0, coalesce(done, 0) - asked))::BIGINT AS unexpected, coalesce(sum(done - places), 0)::BIGINT AS double
FROM a LEFT JOIN d USING (book_id, candidate_id) GROUP BY book_id""")
def op_accounting(spark, sf_dir, layers=ranked):
    _, decisions, operations = applied(spark, sf_dir, layers)
    return edits.accounting(decisions, operations)


@register("offset_remap", f"""{DECIDED} SELECT st.book_id, st.line_no, CASE WHEN EXISTS (SELECT 1 FROM op WHERE op.book_id = st.book_id AND op_start < st.start_offset + length(stripped) AND op_end > st.start_offset) THEN NULL
  ELSE (st.start_offset + coalesce((SELECT sum(length(replacement) - op_end + op_start) FROM op WHERE op.book_id = st.book_id AND op_end <= st.start_offset), 0))::BIGINT END AS new_offset FROM st""")
def offset_remap(spark, sf_dir, layers=ranked):
    lines, _, operations = applied(spark, sf_dir, layers)
    return edits.remap(structure.line_offsets(lines).select("book_id", "line_no", "start_offset", "end_offset"), operations)


@register("deletion_ratio", f"{DECIDED} SELECT book_id, (length(text) - length(after))::BIGINT AS removed, round((length(text) - length(after)) / greatest(1, length(text))::DOUBLE, 9) AS ratio, (length(text) - length(after)) / greatest(1, length(text))::DOUBLE <= {R.DELETION_LIMIT} AS within_limit FROM ap")
def deletion_ratio(spark, sf_dir, layers=ranked):
    lines, _, operations = applied(spark, sf_dir, layers)
    texts = structure.texts_of_lines(lines)
    return edits.deletion_ratio(texts, edits.apply_operations(texts, operations))


@register("rollback_point", f"""{DECIDED}, r AS (SELECT op.*, coalesce(lag(op_end) OVER (PARTITION BY book_id ORDER BY op_start), 0) AS kept_from FROM op WHERE candidate_id <> 'AD-0001')
SELECT book_id, md5(coalesce((SELECT string_agg(substring(text, kept_from + 1, op_start - kept_from) || replacement, '' ORDER BY op_start) || substring(text, max(op_end) + 1) FROM r WHERE r.book_id = tx.book_id), text)) AS md5 FROM tx""")
def rollback_point(spark, sf_dir, layers=ranked):
    lines, _, operations = applied(spark, sf_dir, layers)
    rest = edits.without_point(operations, F.col("candidate_id") == "AD-0001")
    return edits.apply_operations(structure.texts_of_lines(lines), rest).select("book_id", F.md5("text").alias("md5"))


@register("chapter_identity", f"""{DECIDED}, gone AS (SELECT DISTINCT ch.book_id, ch.line_no FROM ch JOIN op ON op.book_id = ch.book_id AND op_start < ch.title_end AND op_end > ch.title_start)
SELECT book_id, count(*) AS chapters, (count(*) - (SELECT count(*) FROM gone WHERE gone.book_id = ch.book_id))::BIGINT AS kept FROM ch GROUP BY book_id""")
def chapter_identity(spark, sf_dir, layers=ranked):
    lines, _, operations = applied(spark, sf_dir, layers)
    moved = edits.remap(structure.headings(lines).select("book_id", "line_no", "start_offset", "end_offset"), operations)
    return moved.groupBy("book_id").agg(F.count(F.lit(1)).alias("chapters"), F.count("new_offset").alias("kept"))


@register("protected_hits", f"{RANKED} SELECT book_id, candidate_id, term FROM (SELECT book_id, 'AD-' || lpad(rank::VARCHAR, 4, '0') AS candidate_id, sample FROM ck) c, (VALUES ('最新章节'), ('整理'), ('房间')) AS t(term) WHERE contains(sample, term)")
def protected_hits(spark, sf_dir, layers=ranked):
    terms = F.array(F.lit("最新章节"), F.lit("整理"), F.lit("房间"))
    return layers(spark, sf_dir).select("book_id", "candidate_id", F.explode(F.filter(terms, lambda t: F.contains(F.col("sample"), t))).alias("term"))


@register("wilson", """WITH z AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE lang = 'en') AS k, 1.959963984540054::DOUBLE AS z FROM documents GROUP BY source)
SELECT source, k, n, round(greatest(0.0, (k / n::DOUBLE + z * z / (2 * n) - z * sqrt((k / n::DOUBLE * (1 - k / n::DOUBLE) + z * z / (4 * n)) / n)) / (1 + z * z / n)), 9) AS low,
  round(least(1.0, (k / n::DOUBLE + z * z / (2 * n) + z * sqrt((k / n::DOUBLE * (1 - k / n::DOUBLE) + z * z / (4 * n)) / n)) / (1 + z * z / n)), 9) AS high FROM z""")
def wilson(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang") == "en").alias("k"))
    return rows.withColumn("w", edits.wilson(F.col("k"), F.col("n"))).select("source", "k", "n", "w.low", "w.high")


@register("corpus_rollup", f"{BASE} SELECT count(*) AS books, sum(n)::BIGINT AS chars, max(n) AS most, min(n) AS least FROM (SELECT book_id, max(start + length(raw))::BIGINT AS n FROM bl GROUP BY book_id)")
def corpus_rollup(spark, sf_dir):
    sizes = structure.book_sizes(book_lines(spark, sf_dir))
    return sizes.agg(F.count(F.lit(1)).alias("books"), F.sum("text_length").alias("chars"), F.max("text_length").alias("most"), F.min("text_length").alias("least"))


register_whole(QUERIES)


@register("review_violations_whole")
def review_violations_whole(spark, sf_dir):
    """Over the reviews of all candidates, with a verdict that is not known planted in one of seven."""
    _, reviews = reviewed(spark, sf_dir, ranked_whole)
    planted = F.substring("candidate_id", 4, 20).cast("int") % 7 == 0
    reviews = reviews.withColumn("verdict", F.when(planted, "drop").otherwise(F.col("verdict")))
    return edits.review_violations(reviews).select("book_id", "candidate_id", F.array_join("violations", ",").alias("violations"))


@register("overlap_check_whole")
def overlap_check_whole(spark, sf_dir):
    return edits.overlaps(applied(spark, sf_dir, ranked_whole)[2])
