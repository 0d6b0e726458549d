"""Line dedup over levelled sorted runs of line hashes.

Rows arrive in batches (by hash of doc_id). A run is a table bucketed and sorted by line hash with, per hash, the number of
documents and the largest doc_id of the batch that brought it. A batch is merge-anti-joined to the runs without moving them:
hashes that no run holds are added as the batch's own run at level 0, and what is left of the batch goes to the repeats. A level
that holds FAN_OUT runs is merged into one sorted run of the next level; no hash is in two runs. Runs and repeats together give
the documents and the largest doc_id of every line, and so which lines go.

Defined cases: a null or empty text is one empty line; rows with one doc_id count as one document; a null doc_id counts as one
document, smaller than all others; repeated rows and lines each lose the lines that go; an empty table gives an empty result;
other columns are not read. A key is compared by its 128-bit MD5.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import WHITE_SPACE, ascii_lower, scratch, text_of, written

BATCHES = 4
FAN_OUT = 2


def lines_of(column: Column) -> Column:
    return F.split(column, "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(WHITE_SPACE)))


def line_hash(line: Column, min_chars: int) -> Column:
    """16 bytes, or null for a key that is too short to count."""
    key = line_key(line)
    return F.when(F.char_length(key) >= min_chars, F.unhex(F.md5(key)))


class LevelledRuns:
    """Sorted runs of (line, n_docs, max_doc) by level, and the repeats of lines that a run held already."""

    def __init__(self, spark: SparkSession, fan_out: int = FAN_OUT):
        self.spark, self.fan_out = spark, fan_out
        self.levels: list[list[DataFrame]] = []
        self.repeats: list[DataFrame] = []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _run(self, df: DataFrame) -> DataFrame:
        name = f"folioforge_run_{uuid.uuid4().hex}"
        df = df.select("line", "n_docs", "max_doc").repartition(self.buckets, "line")
        df.write.bucketBy(self.buckets, "line").sortBy("line").option("path", scratch(self.spark, "run")).saveAsTable(name)
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> None:
        """batch: line, doc_id, each pair once."""
        own = batch.groupBy("line").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc"))
        fresh = own
        for run in self.runs():
            fresh = fresh.join(run.hint("merge"), "line", "left_anti")
        held = self.runs()
        added = self._run(fresh)
        if held:
            self.repeats.append(written(own.join(added.hint("merge"), "line", "left_anti"), "repeats"))
        self._put(0, added)

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_out:
            runs, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._run(reduce(DataFrame.unionByName, runs)))

    def all(self) -> DataFrame:
        """One row per line: line, n_docs, max_doc."""
        both = reduce(DataFrame.unionByName, [*self.runs(), *self.repeats])
        return both.groupBy("line").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = BATCHES) -> DataFrame:
    """doc_id, kept (the text that stays), n_lines, n_dropped."""
    spark = docs.sparkSession
    lines = lines_of(text_of())
    hashes = F.array_distinct(F.filter(F.transform(lines, lambda x: line_hash(x, min_chars)), lambda x: x.isNotNull()))
    held = written(
        docs.select("doc_id", F.explode(hashes).alias("line"), F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch")),
        "line-hashes",
        ["batch"],
    )
    runs = LevelledRuns(spark)
    for batch in range(batches):
        runs.add(held.where(F.col("batch") == batch).select("line", "doc_id").distinct())
    common = runs.all().where(F.col("n_docs") >= min_docs).select("line", "max_doc")
    losing = held.join(common, "line").where(~F.col("doc_id").eqNullSafe(F.col("max_doc")))
    losing = written(losing.groupBy("doc_id").agg(F.collect_set("line").alias("losing")), "losing").withColumnRenamed("doc_id", "of")
    rows = docs.select("doc_id", text_of().alias("text")).join(losing, F.col("doc_id").eqNullSafe(F.col("of")), "left")
    split = lines_of(F.col("text"))
    stays = F.filter(split, lambda x: ~F.coalesce(F.array_contains(F.col("losing"), line_hash(x, min_chars)), F.lit(False)))
    rows = rows.select("doc_id", "losing", F.size(split).cast("long").alias("n_lines"), F.when(F.col("losing").isNull(), split).otherwise(stays).alias("lines"))
    kept = F.array_join("lines", "\n")
    return rows.select("doc_id", kept.alias("kept"), "n_lines", (F.col("n_lines") - F.size("lines")).cast("long").alias("n_dropped"))


#: DuckDB SQL for the digests of the same rows.
LINES_SQL = r"""
WITH ln AS (SELECT doc_id, u.i AS i, u.line AS line,
         translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(list_zip(string_split(coalesce(text, ''), chr(10)), range(1, len(string_split(coalesce(text, ''), chr(10))) + 1))) AS z FROM documents),
       LATERAL (SELECT z[1] AS line, z[2] AS i) u),
com AS (SELECT key, max(doc_id) AS max_doc FROM ln WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
mark AS (SELECT ln.*, com.key IS NOT NULL AND ln.doc_id <> com.max_doc AS gone FROM ln LEFT JOIN com ON ln.key = com.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM mark GROUP BY doc_id
"""
