"""Books made of the supplied documents: 20 consecutive documents are the chapters of one book, each behind a heading line and
with one of the template lines that the rules are about."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOOK_DOCS = 20
NUMERALS = ("一", "二", "三", "四", "五", "六", "七", "八", "九", "十", "十一", "十二", "十三", "十四", "十五", "十六", "十七", "十八", "十九", "二十")

#: Inserted by doc_id; two lines are parted by a vertical bar.
TEMPLATES = (
    "请访问www.biquge.com阅读最新章节",
    "加入QQ群:88481234获取更新通知",
    "他把那封信读完，折好收进抽屉。",
    "本书由飘天整理组校对",
    "欢迎访问 uukanshu 点 com 在线阅读",
    "更多内容请联系 admin@soushu.net",
    "更新最快的笔趣阁|www.xbiquge.cc 无弹窗",
    "线索写在旧日志里：没有访问过www.example.com这个地址。",
    "第三章的故事还在继续，他想起了昨天",
    "电子书下载地址见书包网",
    "求收藏求推荐，作者的话：谢谢捧场",
    "这是被屏蔽的*字和***句子，还有特·殊分隔",
    "手机用户请访问m.69shu.com",
    "他整理好行李，扫描了一遍房间。",
    "转自飘天文学网",
    "夜色【渐深，他没有回头",
)
COMMON = "本章未完，请点击下一页继续阅读"


def book_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id, line_no (from 1), raw, start: where the line begins in its book."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    k = F.col("doc_id") % BOOK_DOCS
    number = k + 1
    numeral = F.element_at(F.array(*[F.lit(x) for x in NUMERALS]), number.cast("int"))
    heading = (
        F.when(k % 7 == 6, F.concat(F.lit("第"), (number - 2).cast("string"), F.lit("章 "), "source"))
        .when(k % 5 == 3, F.concat(F.lit("Chapter "), number.cast("string"), F.lit(" "), "source"))
        .when(k % 5 == 4, F.concat(F.lit("第"), numeral, F.lit("章")))
        .otherwise(F.concat(F.lit("第"), number.cast("string"), F.lit("章 （"), "source"))
    )
    templates = F.array(*[F.lit(x) for x in TEMPLATES])
    template = F.split(F.element_at(templates, (F.col("doc_id") % len(TEMPLATES) + 1).cast("int")), r"\|")
    common = F.when(k % 3 == 0, F.array(F.lit(COMMON))).otherwise(F.array().cast("array<string>"))
    text = F.split(F.coalesce("text", F.lit("")), "\n")
    lines = F.concat(F.array(heading), F.slice(text, 1, 1), template, common, F.when(F.size(text) > 1, F.slice(text, F.lit(2), F.greatest(F.size(text) - 1, F.lit(0)))).otherwise(F.array().cast("array<string>")))
    rows = docs.select(F.floor(F.col("doc_id") / BOOK_DOCS).alias("book_id"), "doc_id", F.posexplode(lines).alias("pos", "raw"))
    order = Window.partitionBy("book_id").orderBy("doc_id", "pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        "book_id",
        F.row_number().over(order).cast("long").alias("line_no"),
        "raw",
        F.coalesce(F.sum(F.length("raw") + 1).over(before), F.lit(0)).cast("long").alias("start"),
    )


def _quoted(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


#: DuckDB: the same lines, as the common table expressions dl and bl.
LINES_CTE = f"""
dl AS (SELECT doc_id // {BOOK_DOCS} AS book_id, doc_id,
  list_concat(list_concat(list_concat(
    [CASE WHEN (doc_id % {BOOK_DOCS}) % 7 = 6 THEN '第' || (doc_id % {BOOK_DOCS} - 1) || '章 ' || source
          WHEN (doc_id % {BOOK_DOCS}) % 5 = 3 THEN 'Chapter ' || (doc_id % {BOOK_DOCS} + 1) || ' ' || source
          WHEN (doc_id % {BOOK_DOCS}) % 5 = 4 THEN '第' || ({_quoted(NUMERALS)})[doc_id % {BOOK_DOCS} + 1] || '章'
          ELSE '第' || (doc_id % {BOOK_DOCS} + 1) || '章 （' || source END],
    (string_split(coalesce(text, ''), chr(10)))[1:1]),
    list_concat(string_split(({_quoted(TEMPLATES)})[doc_id % {len(TEMPLATES)} + 1], '|'),
                CASE WHEN (doc_id % {BOOK_DOCS}) % 3 = 0 THEN ['{COMMON}'] ELSE [] END)),
    (string_split(coalesce(text, ''), chr(10)))[2:]) AS ls FROM documents),
ex AS (SELECT book_id, doc_id, unnest(ls) AS raw, unnest(range(1, len(ls) + 1)) AS pos FROM dl),
bl AS (SELECT book_id, row_number() OVER w AS line_no, raw,
  coalesce(sum(length(raw) + 1) OVER (PARTITION BY book_id ORDER BY doc_id, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM ex WINDOW w AS (PARTITION BY book_id ORDER BY doc_id, pos))
"""
