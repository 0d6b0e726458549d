"""Exact dedup as a stateful stream over disk-backed keyed state.

A feed of (digest, stable identifier, content locator) is read as a stream in several micro-batches. RocksDB keeps, per digest
and without expiry, the row with the largest doc_id (its doc_id and locator: the file and the place in it where its text lies) and the
number of rows seen; each batch appends the states that it changed to a log, whose largest count per digest is the state at the end.

Full bytes are checked on hits, which are digests of more than one row. A bitmap of the hits is broadcast (see rowfilter), so that only
texts of hits are looked at; equal texts are brought together where they lie before any of them moves, and every digest must be left
with the one text that the state's doc_id and locator name. A digest that covers other texts too is grouped by the text itself.

Defined cases: a null text counts as empty; very long texts are hashed and compared whole; of equal texts the row with the largest doc_id
stays, a null doc_id being smaller than any; of repeated rows with that doc_id `kept` is true for each; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import scratch, settings, text_of, written
from folioforge.llm.rowfilter import bitmap, key_hash, marked, staying

MICRO_BATCHES = 3
#: Rows of the feed per state store. Every RocksDB store takes 4 MB of disk for its manifest alone, so that there are
#: as many stores as the feed needs, up to the number of shuffle partitions.
STORE_ROWS = 20_000
#: A group with more than one of this many rows is hot; there are fewer such groups than this, so that they can be broadcast.
HOT = 1000
#: Bounded native memory for all state stores of an executor.
STATE = {
    "spark__sql__streaming__stateStore__providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark__sql__streaming__stateStore__rocksdb__boundedMemoryUsage": "true",
    "spark__sql__streaming__stateStore__rocksdb__maxMemoryUsageMB": "200",
    "spark__sql__streaming__stateStore__rocksdb__changelogCheckpointing__enabled": "true",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _located(docs: DataFrame, digest: Callable[[Column], Column], *more: Column) -> DataFrame:
    """doc_id, digest, locator, and what else is asked for."""
    locator = F.concat(F.input_file_name(), F.lit("#"), F.input_file_block_start().cast("string"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(text_of()).alias("digest"), locator.alias("locator"), *more)


def located(docs: DataFrame) -> DataFrame:
    """docs, or a table of its rows in the shared folder if they come from several places, so that a locator can name where a row lies."""
    try:
        docs.select(F.input_file_name())
    except AnalysisException:
        return written(docs, "dedup-docs")
    return docs


def stream_states(feed: DataFrame, files: int, rows: int) -> DataFrame:
    """digest, top (doc_id, locator), group_size: the state after the whole feed."""
    spark = feed.sparkSession
    stores = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(spark.sparkContext.defaultParallelism, -(-rows // STORE_ROWS)))
    source = feed.inputFiles()[0].rsplit("/", 1)[0]
    log = scratch(spark, "dedup-log")
    with settings(spark, **STATE, spark__sql__streaming__internal__stateStore__partitions=str(stores)):
        stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", max(1, -(-files // MICRO_BATCHES))).parquet(source)
        states = stream.groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("top"), F.count(F.lit(1)).alias("group_size"))

        def append(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{log}/epoch={epoch}")

        query = states.writeStream.outputMode("update").option("checkpointLocation", scratch(spark, "dedup-state")).foreachBatch(append).trigger(availableNow=True).start()
        query.awaitTermination()
    changed = spark.read.schema("digest binary, top struct<doc_id:bigint,locator:string>, group_size long, epoch int").parquet(log)
    return changed.groupBy("digest").agg(F.max("top").alias("top"), F.max("group_size").alias("group_size"))


def _joined(rows: DataFrame, hits: DataFrame, n: int) -> DataFrame:
    """rows with the hit of their digest, by a broadcast of the hot ones and a shuffle of the others."""
    hit = F.struct("keep_id", "group_size")
    large = F.col("group_size") > max(1, n // HOT)
    hot = hits.where(large).select(F.col("digest").alias("__of"), hit.alias("__hot"))  # fewer than HOT rows
    first = rows.join(F.broadcast(hot), rows["digest"] == hot["__of"], "left").drop("__of")
    rest = hits.where(~large).select("digest", hit.alias("__hit"))
    done = first.where("__hot is not null").withColumnRenamed("__hot", "__hit")
    return done.unionByName(first.where("__hot is null").drop("__hot").join(rest.hint("merge"), "digest", "left"))


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest: one row per row of docs."""
    docs = located(docs)
    feed = written(_located(docs, digest), "dedup-feed")
    n = feed.count()
    out = ("doc_id", "keep_id", "group_size", "kept", "digest")
    if not n:
        return feed.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    states = stream_states(feed, len(feed.inputFiles()), n)
    hits = written(states.where("group_size > 1"), "dedup-hits")
    seen = bitmap(hits.select(key_hash("digest").alias("h")), hits.count())
    # On hits the texts themselves: each digest with the one text of the row that its state names.
    texts = marked(_located(docs, digest, text_of().alias("text")), key_hash("digest"), seen, "hit").where("hit")
    texts = texts.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "locator")).alias("row"))
    named = hits.select(F.col("digest").alias("__of"), "top")
    strange = texts.drop("text").join(named.hint("merge"), F.col("digest") == F.col("__of")).where(F.col("row") != F.col("top"))
    unequal = written(strange.select("digest").distinct(), "dedup-unequal")
    light = marked(feed.select("doc_id", "digest"), key_hash("digest"), seen, "hit")
    found = _joined(light.where("hit").drop("hit"), hits.select("digest", F.col("top.doc_id").alias("keep_id"), "group_size"), n)
    found = light.where("not hit").drop("hit").withColumn("__hit", F.lit(None).cast(found.schema["__hit"].dataType)).unionByName(found)
    alone = F.col("__hit").isNull()
    rows = found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("__hit.keep_id")).alias("keep_id"),
        F.when(alone, F.lit(1).cast("long")).otherwise(F.col("__hit.group_size")).alias("group_size"),
        "digest",
    )
    if not unequal.isEmpty():
        again = _located(docs, digest, text_of().alias("text")).join(unequal, "digest", "left_semi")
        by_text = again.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        exact = again.select("doc_id", "digest", "text").join(by_text, ["digest", "text"]).withColumn("digest", sha256(F.col("text")))
        rows = rows.join(unequal, "digest", "left_anti").unionByName(exact.select(*rows.columns))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(*out)


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs with one row per text: that with the largest doc_id (null being smallest), and one of them where that doc_id is repeated.

    Defined cases as above; other columns stay with their row, and texts are not moved unless a verdict is in doubt (see rowfilter)."""
    docs = located(docs)
    found = exact_dedup(docs)
    verdicts = found.groupBy("digest", "doc_id").agg(F.max("kept").alias("stays"), (F.max("kept") & (F.count(F.lit(1)) > 1)).alias("once"))
    return staying(docs, [sha256(text_of()), F.col("doc_id").cast("long")], verdicts)


#: DuckDB SQL for the same rows.
EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
