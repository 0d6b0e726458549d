"""Mixing sources to target weights.

Every row gets a hash-random key. Rows are dealt by ranges of that key within their source, prefix sums of word counts are
taken range by range and carried over by the ranges' own sums, and a source is cut at the word where its budget ends.
A budget above the source's size first takes whole epochs of it.

Targets are the water level of the capped shares: every source gets its weight times one level, and at most max_epochs times
its size. Resharing the excess by weight until none is above its cap ends at that level.

Defined cases: a null text has size 0 and takes 0; a null source is a source of its own and comes last; of repeated rows
each one counts; a source without words has target 0; an empty table gives an empty result; other columns are not read.
Rows that agree in doc_id, text hash and size are interchangeable, so that ties in the key do not make reruns differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import WORD, text_of, written

#: Rows that one range of a source holds on average, and the most hex digits that name a range. More rows per range than
#: this only appear beyond 16 ** MAX_DIGITS * RANGE_ROWS rows in one source.
RANGE_ROWS = 4096
MAX_DIGITS = 4


def word_count(column: Column) -> Column:
    return F.size(F.regexp_extract_all(column, F.lit(WORD), F.lit(0))).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """One row per source: source_size, source_rows, weight, target. sized: source, size."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("weight", weight).withColumn("cap", (max_epochs * F.col("source_size")).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        ranked.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("weights", F.sum("weight").over(everything).cast("double"))
        .withColumn("place", F.row_number().over(by_ratio))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("share", F.col("weights") - F.coalesce(F.sum("weight").over(before).cast("double"), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("share"))
        .withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
        .withColumn("level", F.min_by(F.when(~F.col("capped"), F.col("level")), F.when(~F.col("capped"), F.col("place"))).over(everything))
    )
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("level") * F.col("weight"))
    return level.select("source", "source_size", "source_rows", "weight", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, and key: the place in the source's random order."""
    text = text_of()
    sized = written(
        docs.select(
            "doc_id",
            "source",
            word_count(text).alias("size"),
            F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"))).alias("key"),
            F.xxhash64(text).alias("tie"),
        ),
        "mix-sizes",
    )
    targets = source_targets(sized, weights, max_epochs)
    digits = F.least(F.lit(MAX_DIGITS), F.greatest(F.lit(0), F.ceil(F.log(F.col("source_rows") / RANGE_ROWS) / F.log(F.lit(16.0))))).cast("int")
    budget = F.round("target").cast("long")
    targets = written(
        targets.withColumn("digits", digits)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", budget - F.col("epochs") * F.col("source_size")),
        "mix-targets",
    ).withColumnRenamed("source", "of")
    rows = sized.join(targets, sized["source"].eqNullSafe(targets["of"])).drop("of")
    rows = rows.withColumn("range", F.expr("substring(key, 1, digits)"))
    in_order = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        rows.groupBy("source", "range")
        .agg(F.sum("size").alias("range_size"))
        .withColumn("start", F.coalesce(F.sum("range_size").over(in_order), F.lit(0)))
        .select(F.col("source").alias("of"), F.col("range").alias("at"), "start")
    )
    rows = rows.join(ranges, rows["source"].eqNullSafe(ranges["of"]) & (rows["range"] == ranges["at"])).drop("of", "at")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return rows.withColumn("before", before).select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "key", "tie")


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """docs with every row as often as the mix takes it, rounded up to whole texts; rows that it never takes go."""
    decided = mix(docs, **options).where("taken > 0")
    times = decided.select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("tie").alias("__t"), F.ceil(F.col("taken") / F.col("size")).cast("int").alias("__times"))
    times = times.withColumn("__of", F.row_number().over(Window.partitionBy("__d", "__s", "__t").orderBy(F.col("__times").desc())))
    same_row = Window.partitionBy("doc_id", "source", "__tie").orderBy(F.lit(1))
    rows = docs.withColumn("__tie", F.xxhash64(text_of())).withColumn("__nth", F.row_number().over(same_row))
    same = rows["doc_id"].eqNullSafe(times["__d"]) & rows["source"].eqNullSafe(times["__s"]) & (rows["__tie"] == times["__t"]) & (rows["__nth"] == times["__of"])
    copies = F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("__copy")
    return rows.join(times, same).select(*[rows[c] for c in docs.columns], copies).drop("__copy")


#: DuckDB SQL for the same rows.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix|' || doc_id) AS key FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size,
               [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM sized GROUP BY source),
lev AS (SELECT *, 3.0::DOUBLE * source_size AS cap,
  (sum(source_size) OVER ())::DOUBLE - coalesce(sum(3.0::DOUBLE * source_size) OVER w, 0.0) AS left_over,
  (sum(weight) OVER ())::DOUBLE - coalesce(sum(weight) OVER w, 0)::DOUBLE AS share,
  row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST) AS place FROM src
  WINDOW w AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capd AS (SELECT *, left_over / share AS level, left_over / share * weight >= cap AS capped FROM lev),
targ AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE
  (SELECT arg_min(level, place) FROM capd WHERE NOT capped) * weight END AS target FROM capd),
bud AS (SELECT *, round(target)::BIGINT AS budget,
  CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM targ),
run AS (SELECT doc_id, size, source_size, target, epochs, budget - epochs * source_size AS rest,
  coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN bud b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM run
"""
