"""Line-end normalisation, layout, title and mask findings, Markdown export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import rules as R
from folioforge.functions import text as X

MARKER = "<!-- chapter -->"
MENTION = r"第[0-9零〇一二两三四五六七八九十百千万]+[章节卷集部篇回]"
MASK_RUN = r"[\*＊×Xx□■口]{2,}"
#: Java only: a single mask between CJK characters.
MASK_ONE = r"(?<=[\x{4e00}-\x{9fff}])[\*＊×Xx□■口](?=[\x{4e00}-\x{9fff}])"
SEPARATOR = r"[\x{4e00}-\x{9fff}][·•・.．]{1,2}[\x{4e00}-\x{9fff}]"
PROTECTED = r"`[^`\n]*`|https?://[^\s]+|www\.[^\s]+|[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}|[A-Za-z]:\\[^\s]+"
PUNCTUATION = {",": "，", ".": "。", "?": "？", "!": "！", ":": "：", ";": "；"}


def normalize_newlines(c: Column) -> Column:
    """CRLF, CR, U+2028 and U+2029 become LF; the five zero-width characters go."""
    return F.translate(F.regexp_replace(c, r"\r\n|\r|\x{2028}|\x{2029}", "\n"), R.ZERO_WIDTH, "")


def blocked_text(c: Column) -> Column:
    """Whether a text must not go on: replacement characters, or control characters but tab, LF and CR."""
    return c.rlike(r"[\x{FFFD}\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")


def bracket_issues(title: Column) -> Column:
    """The pairs whose two sides differ in number."""
    count = lambda ch: F.length(title) - F.length(F.replace(title, F.lit(ch), F.lit("")))
    return F.array_compact(F.array(*[F.when(count(p[0]) != count(p[1]), F.lit(p)) for p in ("（）", "()", "[]", "{}", "【】", "《》", "「」", "『』")]))


def broken_titles(lines: DataFrame, headings: DataFrame) -> DataFrame:
    """Headings without a rest before a line of up to 30 characters that may be their continuation."""
    marks = headings.select("book_id", "line_no", F.lit(True).alias("is_heading"), "title", "title_tail")
    rows = lines.withColumn("stripped", X.strip(F.col("raw"))).where(F.length("stripped") > 0).join(marks, ["book_id", "line_no"], "left")
    order = Window.partitionBy("book_id").orderBy("line_no")
    rows = rows.withColumn("next", F.lead("stripped").over(order)).withColumn("next_heading", F.lead(F.coalesce("is_heading", F.lit(False))).over(order))
    fits = F.col("is_heading") & (F.col("title_tail") == "") & ~F.col("next_heading") & (F.length("next") <= 30) & ~F.col("next").rlike(r"[。！？!?]$")
    return rows.where(fits).select("book_id", "line_no", F.concat_ws(" ", "title", "next").alias("proposed"))


def pseudo_titles(lines: DataFrame, headings: DataFrame) -> DataFrame:
    """Body lines that mention a chapter."""
    body = lines.join(headings.select("book_id", "line_no"), ["book_id", "line_no"], "left_anti")
    return body.where(F.col("raw").rlike(MENTION)).select("book_id", "line_no")


def mask_counts(lines: DataFrame) -> DataFrame:
    """Masked characters and separated words per line."""
    masks = F.regexp_count("raw", F.lit(rf"{MASK_ONE}|{MASK_RUN}"))
    return lines.select("book_id", "line_no", masks.alias("masks"), F.regexp_count("raw", F.lit(SEPARATOR)).alias("separators")).where("masks + separators > 0")


def mask_spans(lines: DataFrame, most: int = 500, around: int = 10) -> DataFrame:
    """book_id, line_no, id, mask_type, start, end (code points in the book), original, prefix, suffix of masked characters and separated words.

    Ids count a book's masks by place and then its separators; `most` of them are kept, which is the feature's own limit. Prefix and suffix are
    `around` characters and may reach into other lines. A null line is empty. Lines without a span stay out before anything is exploded.
    """
    text = F.coalesce("raw", F.lit(""))
    order = Window.partitionBy("book_id").orderBy("line_no")
    # A line has at least its line break, so that `around` lines hold as many characters; of each only so many are kept.
    rows = lines.select(
        "book_id",
        "line_no",
        F.col("start").alias("line_start"),
        text.alias("raw"),
        F.collect_list(F.right(text, F.lit(around))).over(order.rowsBetween(-around, -1)).alias("above"),
        F.collect_list(F.left(text, F.lit(around))).over(order.rowsBetween(1, around)).alias("below"),
    )
    parts = []
    for rank, (kind, pattern) in enumerate((("mask_chars", rf"{MASK_ONE}|{MASK_RUN}"), ("word_separator", SEPARATOR))):
        found, between = F.regexp_extract_all("raw", F.lit(pattern), F.lit(0)), F.split("raw", pattern, -1)
        # A span starts after all that lies between spans so far and after the former spans.
        gone = F.aggregate(F.slice(between, F.lit(1), F.col("i") + 1), F.lit(0), lambda n, x: n + F.length(x))
        gone = F.aggregate(F.slice("found", F.lit(1), F.col("i")), gone, lambda n, x: n + F.length(x))
        part = rows.where(F.col("raw").rlike(pattern)).select("*", found.alias("found"))
        part = part.select("*", F.posexplode("found").alias("i", "original")).withColumn("at", gone)
        parts.append(part.select("*", F.lit(rank).alias("rank"), F.lit(kind).alias("mask_type")).drop("found", "i"))
    spans = parts[0].unionByName(parts[1])
    after = F.col("at") + F.length("original")
    before_line = F.when(F.size("above") > 0, F.concat(F.array_join("above", "\n"), F.lit("\n"))).otherwise("")
    after_line = F.when(F.size("below") > 0, F.concat(F.lit("\n"), F.array_join("below", "\n"))).otherwise("")
    number = F.row_number().over(Window.partitionBy("book_id").orderBy("rank", "line_no", "at"))
    spans = spans.withColumn("number", number).where(F.col("number") <= most)
    return spans.select(
        "book_id",
        "line_no",
        F.format_string("BW-%04d", "number").alias("id"),
        "mask_type",
        (F.col("line_start") + F.col("at")).alias("start"),
        (F.col("line_start") + after).alias("end"),
        "original",
        F.right(F.concat(before_line, F.left("raw", F.col("at"))), F.lit(around)).alias("prefix"),
        F.left(F.concat(F.substring("raw", after + 1, F.length("raw")), after_line), F.lit(around)).alias("suffix"),
    )


def safe_punctuation(c: Column) -> Column:
    """Full-width marks after a CJK character and before an end, a space, a CJK character or a closing quote."""
    for half, full in PUNCTUATION.items():
        c = F.regexp_replace(c, rf"(?<=[{R.CJK}])[{half}](?=\z|[{R.WS[1:-1]}{R.CJK}\"'”’」』）】》])", full)
    return c


def collapse_blank(lines: DataFrame, most: int = 1) -> DataFrame:
    """lines without those that come after `most` blank lines in a row; blank lines become empty."""
    blank = X.strip(F.col("raw")) == ""
    order = Window.partitionBy("book_id").orderBy("line_no")
    rows = lines.withColumn("blank", blank).withColumn("run", F.sum(F.when(blank, 0).otherwise(1)).over(order))
    nth = F.row_number().over(Window.partitionBy("book_id", "run", "blank").orderBy("line_no"))
    return rows.withColumn("nth", nth).where(~F.col("blank") | (F.col("nth") <= most)).select("book_id", "line_no", F.when(F.col("blank"), "").otherwise(F.col("raw")).alias("raw"))


def squeeze_spaces(c: Column) -> Column:
    """Runs of spaces and tabs become one space, but in code spans, addresses, mails and drive paths."""
    tokens = F.regexp_extract_all(c, F.lit(rf"(?is)(?:{PROTECTED})|[ \t]+|."), F.lit(0))
    joined = F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(r"^[ \t]+$"), " ").otherwise(t)), "")
    return F.when(c.rlike(r"[ \t]{2}|\t"), joined).otherwise(c)


def normalize_line(c: Column, is_heading: Column, squeeze: bool = False) -> Column:
    """Space, tab and ideographic space go at the end, marks become full-width; lines that are no headings begin with two ideographic spaces."""
    c = F.regexp_replace(c, "[ \t　]+$", "")
    c = safe_punctuation(squeeze_spaces(c) if squeeze else c)
    body = (X.strip(c) != "") & ~is_heading
    return F.when(body, F.concat(F.lit("　　"), F.regexp_replace(c, "^[ \t　]+", ""))).otherwise(c)


def normalize_layout(lines: DataFrame, headings: DataFrame, most: int = 1, squeeze: bool = False) -> DataFrame:
    """book_id, text: every line normalised, then blank runs cut; the text ends with a line end."""
    marks = headings.select("book_id", "line_no", F.lit(True).alias("h"))
    rows = lines.join(marks, ["book_id", "line_no"], "left")
    rows = collapse_blank(rows.withColumn("raw", normalize_line(F.col("raw"), F.coalesce("h", F.lit(False)), squeeze)), most)
    listed = F.array_sort(F.collect_list(F.struct("line_no", "raw")))
    whole = F.array_join(F.transform(listed, lambda x: x["raw"]), "\n")
    return rows.groupBy("book_id").agg(whole.alias("text")).select("book_id", F.when(F.endswith("text", F.lit("\n")), F.col("text")).otherwise(F.concat("text", F.lit("\n"))).alias("text"))


def markdown(texts: DataFrame, slices: DataFrame) -> DataFrame:
    """book_id, markdown: every chapter behind a marker and as a second-level heading, other parts as they are."""
    rows = slices.join(texts, "book_id")
    part = F.expr("substring(text, cast(slice_start as int) + 1, cast(slice_end - slice_start as int))")
    rows = rows.withColumn("part", F.when(F.col("kind") == "chapter", F.concat(F.lit(f"{MARKER}\n## "), part)).otherwise(part))
    listed = F.array_sort(F.collect_list(F.struct("slice_start", "part")))
    return rows.groupBy("book_id").agg(F.array_join(F.transform(listed, lambda x: x["part"]), "").alias("markdown"))


def text_of_markdown(c: Column) -> Column:
    """The text that markdown() was made of."""
    return F.replace(c, F.lit(f"{MARKER}\n## "), F.lit(""))
