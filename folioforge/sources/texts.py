"""Sources of books: raw bytes, byte-order marks, strict decoding with quality scores, and JSON lines."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

# Byte-order marks in the order they are tried, the encodings tried without one, and the thresholds.
MARKS = (("0000FEFF", "utf-32-be"), ("FFFE0000", "utf-32-le"), ("EFBBBF", "utf-8-sig"), ("FFFE", "utf-16-le"), ("FEFF", "utf-16-be"))
TRIED = ("utf-8", "gb18030", "big5")
LEAST_SCORE, LEAST_GAP, LEAST_BYTES, LEAST_CONFIDENCE = 70.0, 12.0, 8, 0.7
MOJIBAKE = ("锟斤拷", "烫烫烫", "鈥", "銆")

DECODED = StructType(
    [
        StructField("text", StringType()),
        StructField("encoding", StringType()),
        StructField("reason", StringType()),
        StructField("confidence", DoubleType()),
        StructField("blocked", BooleanType()),
        StructField("blocked_reason", StringType()),
    ]
)


def raw_books(spark: SparkSession, folder: str, least: int = 1, most: int = 40_000_000) -> DataFrame:
    """Every .txt file below a folder: book_id, path, name, content, size_bytes, sha256."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(folder)
    rows = files.where(F.col("length").between(least, most))
    sha = F.sha2("content", 256)
    book = F.concat_ws("-", F.substring(sha, 1, 12), F.substring(F.sha2("path", 256), 1, 6))
    return rows.select(book.alias("book_id"), "path", F.element_at(F.split("path", "/"), -1).alias("name"), "content", F.col("length").alias("size_bytes"), sha.alias("sha256"))


def byte_order_mark(content: Column) -> Column:
    """The encoding that the first bytes name, else null."""
    out = None
    for mark, encoding in MARKS:
        hit = F.hex(F.substring(content, 1, len(mark) // 2)) == mark
        out = F.when(hit, encoding) if out is None else out.when(hit, encoding)
    return out


@lru_cache(maxsize=1 << 16)
def _class_of(ch: str) -> str:
    """control, invalid, odd punctuation, kana or bopomofo, punctuation, letter or number, space, or other."""
    code, category = ord(ch), unicodedata.category(ch)
    if category == "Cc":
        return "space" if ch in "\n\r\t" else "control"
    if category in ("Cn", "Cs"):
        return "invalid"
    if 0xFE10 <= code <= 0xFE6F or code in (0xA7, 0xAD):
        return "odd-punctuation" if category[0] == "P" else "odd"
    if 0x3040 <= code <= 0x30FF or 0x3100 <= code <= 0x312F or 0x31A0 <= code <= 0x31BF:
        return "script-text" if category[0] in "LN" else "script-punctuation" if category[0] == "P" else "script"
    return "punctuation" if category[0] == "P" else "text" if category[0] in "LN" else "space" if ch.isspace() else "other"


def text_quality(text: str) -> tuple[float, bool]:
    """A score from 0 to 100, and whether nothing forbids the text."""
    counts: dict[str, int] = {}
    for ch in set(text):
        kind = _class_of(ch)
        counts[kind] = counts.get(kind, 0) + text.count(ch)
    of = lambda *kinds: sum(counts.get(k, 0) for k in kinds)
    n = max(1, len(text))
    broken = text.count("�")
    readable = of("text", "script-text") > 0
    losses = (
        min(100.0, 100.0 * broken),
        min(100.0, 100.0 * of("control")),
        min(100.0, 800.0 * of("invalid") / n),
        min(60.0, 300.0 * of("odd", "odd-punctuation") / n),
        min(45.0, 180.0 * of("script", "script-text", "script-punctuation") / n),
        min(60.0, 500.0 * sum(text.count(m) for m in MOJIBAKE) / n),
        200.0 * max(0.0, of("punctuation", "odd-punctuation", "script-punctuation") / n - 0.35),
    )
    score = round(min(100.0, max(0.0, 100.0 - sum(losses))), 3) if readable else 0.0
    return score, readable and not broken and not of("control", "invalid")


def decode_one(raw: bytes) -> tuple:
    """One row of DECODED. A mark decides; else UTF-8 where it decodes; else the healthiest of the other encodings, if it clearly is."""
    refused = lambda why: (None, None, None, 0.0, True, why)
    marked = next((e for m, e in MARKS if raw.startswith(bytes.fromhex(m))), None)
    if marked and marked.startswith("utf-32"):
        return refused("unsupported_bom")
    found = []
    for encoding in (marked,) if marked else TRIED:
        try:
            text = raw.decode(encoding).removeprefix("﻿")
        except UnicodeError:
            continue
        found.append((encoding, text, *text_quality(text)))
        if encoding == "utf-8":
            break  # UTF-8 that decodes is never given up for another encoding
    if not found:
        return refused("no_strict_decoder")
    blockers = {"replacement_character" if "�" in t else "disallowed_control_character" if any(_class_of(c) == "control" for c in set(t)) else None for _, t, _, _ in found}
    if len(blockers) == 1 and None not in blockers:
        return refused(blockers.pop())
    healthy = sorted((f for f in found if f[3] and f[2] >= LEAST_SCORE), key=lambda f: -f[2])
    if not healthy:
        return refused("low_text_quality")
    encoding, text, score, _ = healthy[0]
    if marked or encoding == "utf-8":
        return text, encoding, "bom" if marked else "strict_utf8", 1.0 if marked else round(score / 100, 3), False, None
    rivals = [f[2] for f in healthy[1:] if f[1] != text]
    if (len(raw) < LEAST_BYTES and len({f[1] for f in found}) > 1) or (rivals and score - rivals[0] < LEAST_GAP):
        return refused("ambiguous_strict_decoding")
    confidence = min(score / 100, (score - rivals[0]) / 25 if rivals else 4.0)
    if confidence < LEAST_CONFIDENCE:
        return refused("low_text_quality")
    return text, encoding, "quality_score", round(confidence, 3), False, None


@F.pandas_udf(DECODED)
def decoded(content: pd.Series) -> pd.DataFrame:
    rows = [decode_one(bytes(raw)) if raw is not None else (None, None, None, 0.0, True, "no_strict_decoder") for raw in content]
    return pd.DataFrame(rows, columns=DECODED.names)


def json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Records of a JSON-lines file; lines that are no object of the schema are kept in _corrupt_record."""
    whole = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    return spark.read.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
