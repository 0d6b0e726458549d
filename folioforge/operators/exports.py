"""Names of exported books: portable names, numbers behind names that clash, and the title that a book goes by."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioforge.functions import rules as R
from folioforge.functions import text as X

# Characters that no name may have, names that some systems keep for devices, the name of what has none, marks of
# variants and of noise in a source's name, words that say nothing of a title, and how much of a text is its opening.
FORBIDDEN = r'[\\/:*?"<>|\x00-\x1f\x7f]+'
RESERVED = ("con", "prn", "aux", "nul", *(f"{port}{n}" for port in ("com", "lpt") for n in range(1, 10)))
NAMELESS = "novel"
VARIANT = r"(?i)(?:改版|修改|改\d*|同人|二创|番外|外传|续写|衍生|魔改)"
NOISY = r"(?i)(?:https?|www\.|\.com|\.net|\.cn|\.org|\.cc|\.vip|@|下载|全本|txt|epub|soushu|cihetxt|biquge|xbiquge|9xiaoxs)"
PLAIN_WORDS = "小说|txt|epub|精校版|完结版|全本|下载"
OPENING_TITLE, OPENING_NAMES = 20_000, 60_000
#: Texts of these characters only are in NFC.
_COMPOSED = r"^[\x00-\x{2FF}\x{3000}-\x{3029}\x{4E00}-\x{9FFF}\x{FF01}-\x{FF5E}“”‘’—…]*$"


@F.pandas_udf(StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(c: Column) -> Column:
    """NFC; only texts that may not be in it go through Python."""
    return F.coalesce(_nfc(F.when(~c.rlike(_COMPOSED), c)), c)


def _trimmed(c: Column, ends: str = "^[ .]+|[ .]+$") -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(c, ends, ""), F.lit("")), F.lit(NAMELESS))


def _cut(c: Column, most: int) -> Column:
    """The longest beginning of at most that many bytes of UTF-8."""
    fits = F.filter(F.sequence(F.lit(0), F.least(F.length(c), F.lit(most))), lambda i: F.octet_length(F.substring(c, F.lit(1), i)) <= most)
    return F.when(F.octet_length(c) <= most, c).otherwise(F.substring(c, F.lit(1), F.array_max(fits)))


def _unreserved(c: Column) -> Column:
    stem = F.lower(F.regexp_replace(F.substring_index(c, ".", 1), "[ .]+$", ""))
    return F.when(stem.isin(*RESERVED), F.concat(F.lit("_"), c)).otherwise(c)


def safe_name(rows: DataFrame, column: str, most: int = 90) -> DataFrame:
    """rows with `safe`, the portable form of a name: null stays null, and one of nothing but blanks and dots is NAMELESS."""
    rows = rows.withColumn("safe", F.regexp_replace(nfc(F.col(column)), FORBIDDEN, "_"))
    rows = rows.withColumn("safe", F.when(F.col("safe").isNotNull(), _trimmed(F.regexp_replace("safe", f"{R.WS}+", " "))))
    rows = rows.withColumn("safe", _unreserved(F.col("safe")))
    rows = rows.withColumn("safe", F.when(F.col("safe").isNotNull(), _trimmed(_cut(F.col("safe"), most), "[ .]+$")))
    # Cutting may lay a reserved name bare.
    again = _trimmed(_cut(F.concat(F.lit("_"), F.col("safe")), most), "[ .]+$")
    return rows.withColumn("safe", F.when(_unreserved(F.col("safe")) != F.col("safe"), again).otherwise(F.col("safe")))


def unique_names(rows: DataFrame, order: str) -> DataFrame:
    """rows (with `safe`) with `placed`: a number from 2 on behind a name that another has before it, names compared without case."""
    key = F.lower(F.regexp_replace("safe", "[ .]+$", ""))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("placed", F.when(nth == 1, F.col("safe")).otherwise(F.concat("safe", F.lit("-"), nth.cast("string"))))


def name_key(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(X.nfkc(c)), PLAIN_WORDS, ""), r"[^0-9a-z\x{4e00}-\x{9fff}]+", "")


def close_names(a: Column, b: Column) -> Column:
    """Whether two name keys are the same, or one of three characters or more lies in the other."""
    short, long_ = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (a != "") & (b != "") & ((a == b) | ((F.length(short) >= 3) & F.contains(long_, short)))


def openings(lines: DataFrame) -> DataFrame:
    """book_id, opening: the first OPENING_NAMES characters of each book, from the lines that begin in them."""
    rows = lines.where(F.col("start") < OPENING_NAMES).groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "raw"))).alias("rows"))
    return rows.select("book_id", F.substring(F.array_join(F.transform("rows", lambda x: x["raw"]), "\n"), 1, OPENING_NAMES).alias("opening"))


def export_identity(books: DataFrame) -> DataFrame:
    """books: book_id, source, explicit_title, profile_title (verified; null or empty for none), about (the profile's other words),
    characters (array), opening. The title that each goes by, whether that renames it, why, and the signals seen.

    An explicit title wins; a variant keeps its source's name; a verified title needs a noisy source, itself in the opening, or one of its
    characters there, and gives way to a source that is close to it already."""
    blank = lambda c: F.nullif(X.strip(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    rows = books.withColumn("explicit", blank("explicit_title")).withColumn("verified", blank("profile_title"))
    rows = rows.withColumn("wanted", F.coalesce("explicit", "verified"))
    for name, of in (("k_source", "source"), ("k_wanted", "wanted")):
        rows = rows.withColumn(name, name_key(F.col(of)))
    rows = rows.withColumn("k_opening", name_key(F.substring("opening", 1, OPENING_TITLE)))
    rows = rows.withColumn("noisy", F.col("source").rlike(NOISY)).withColumn("close", F.coalesce(close_names(F.col("k_source"), F.col("k_wanted")), F.lit(False)))
    rows = rows.withColumn("named", F.coalesce((F.length("k_wanted") >= 3) & F.contains("k_opening", F.col("k_wanted")), F.lit(False)))
    known = F.exists("characters", lambda n: (F.length(X.strip(n)) >= 2) & F.contains(F.col("opening"), X.strip(n)))
    rows = rows.withColumn("known", F.coalesce(known, F.lit(False)))
    variant = F.concat_ws(" ", "source", "about").rlike(VARIANT)
    supported = F.col("verified").isNotNull() & (F.col("noisy") | F.col("named") | F.col("known"))
    reason = (
        F.when(F.col("wanted").isNull(), "no_title")
        .when(F.col("explicit").isNotNull(), "explicit")
        .when(variant, "variant")
        .when(F.col("close") & ~F.col("noisy"), "close")
        .when(supported, "verified")
        .otherwise("unsupported")
    )
    seen = [("verified_profile", F.col("verified").isNotNull()), ("noisy_source_name", F.col("noisy")), ("source_title_overlap", F.col("close")), ("title_in_opening_text", F.col("named")), ("profile_character_in_text", F.col("known"))]
    signals = F.array_compact(F.array(*[F.when(c, F.lit(s)) for s, c in seen]))
    rows = rows.withColumn("reason", reason).withColumn("renames", F.col("reason").isin("explicit", "verified"))
    found = F.when(F.col("reason").isin("no_title", "variant"), F.array().cast("array<string>")).when(F.col("reason") == "explicit", F.array(F.lit("explicit_config"))).otherwise(signals)
    title = F.when(F.col("renames"), F.col("wanted")).otherwise(F.col("source"))
    return rows.select("book_id", title.alias("title"), (F.col("renames") & (F.col("k_wanted") != F.col("k_source"))).alias("rename_applied"), "reason", found.alias("signals"))
