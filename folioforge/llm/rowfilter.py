"""Keeps or drops rows by a table of verdicts without moving the rows.

Verdicts are light rows (key columns and `stays`). A bitmap of the hashes of all keys that go is joined by broadcast; a row whose bit
is not set stays where it lies. A second bitmap holds the keys that stay although their bit is set; a row with the first bit and
without the second goes where it lies. Only rows with both bits, a few per cent where the bitmaps are as large as they want to be, are
joined to the verdicts exactly. A bitmap has at most MOST_BITS bits, so that 64 MB are broadcast at most; with more keys than that
allows the bitmaps let more rows through to the exact join, and the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import written

BITS_PER_KEY = 32
#: Bits of one row of a bitmap as Spark builds it, and of all its rows.
ROW_BITS = 32_768
MOST_BITS = 1 << 29


def key_hash(*columns: Column | str) -> Column:
    return F.xxhash64(*columns)


def _slot(key: Column, bits: int) -> Column:
    return F.pmod(key, F.lit(bits)) + 1


def bitmap(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Of keys (h: a long), about n of them: rows (bucket, bits) and how many bits there are in all."""
    bits = min(MOST_BITS, max(1, -(-n * BITS_PER_KEY // ROW_BITS)) * ROW_BITS)
    slot = _slot(F.col("h"), bits)
    rows = keys.groupBy(F.bitmap_bucket_number(slot).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("__bits"))
    return written(rows, "bitmap"), bits


def marked(rows: DataFrame, key: Column, made: tuple[DataFrame, int], name: str) -> DataFrame:
    """rows with the boolean column `name`, which is false only for keys that are not in the bitmap."""
    table, bits = made
    slot = _slot(key, bits)
    place = F.bitmap_bit_position(slot).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("__at", F.bitmap_bucket_number(slot)).join(F.broadcast(table), F.col("__at") == F.col("__bucket"), "left")
    bit = F.shiftright(byte, 0).bitwiseAND(F.expr("shiftleft(1, cast(pmod(__place, 8) as int))")) != 0
    return found.withColumn("__place", place).withColumn(name, F.coalesce(bit, F.lit(False))).drop("__at", "__bucket", "__bits", "__place")


#: A key with more than one of this many rows is hot; there are fewer such keys than this.
HOT = 1000


def hot_join(rows: DataFrame, table: DataFrame, key: str, n: int) -> DataFrame:
    """The inner join of n rows to a table with one row per key. The rows of hot keys, of which there are fewer than HOT, are joined by a
    broadcast of their HOT rows of the table at most, so that none of them comes to one task; the others by a shuffle."""
    hot = rows.groupBy(F.col(key).alias("__hot")).agg(F.count(F.lit(1)).alias("__k")).where(F.col("__k") > max(HOT, n // HOT)).select("__hot")
    hot = written(hot, "hot-keys")
    if hot.isEmpty():
        return rows.join(table.hint("merge"), key)
    few = table.join(F.broadcast(hot), table[key] == hot["__hot"])
    first = rows.join(F.broadcast(hot), rows[key] == hot["__hot"], "left")
    rest = first.where("__hot is null").drop("__hot").join(table.hint("merge"), key)
    return rest.unionByName(first.where("__hot is not null").drop("__hot").join(F.broadcast(few.drop("__hot")), key).select(*rest.columns))


def staying(rows: DataFrame, key: list[Column], verdicts: DataFrame) -> DataFrame:
    """The rows that stay. key: the expressions over rows that equal the verdicts' columns besides `stays` (a boolean) and, where
    there is one, `once` (a boolean: of the rows with this key only one stays). Every key of rows has a verdict."""
    names = [c for c in verdicts.columns if c not in ("stays", "once")]
    if "once" not in verdicts.columns:
        verdicts = verdicts.withColumn("once", F.lit(False))
    verdicts = written(verdicts.select(*names, "stays", "once", key_hash(*names).alias("h")), "verdicts")
    gone = verdicts.where("not stays or once").select("h")
    n = gone.count()
    if not n:
        return rows
    first = bitmap(gone, n)
    doubtful = written(marked(verdicts.where("stays"), F.col("h"), first, "__hit").where("__hit").select(*names, "once", "h").distinct(), "doubtful")
    second = bitmap(doubtful.select("h"), doubtful.count())
    columns = rows.columns
    seen = rows.withColumn("__h", key_hash(*key))
    seen = marked(marked(seen, F.col("__h"), first, "__first"), F.col("__h"), second, "__second")
    sure = seen.where("not __first").select(*columns)
    keyed = seen.where("__first and __second").withColumns({f"__key{i}": k for i, k in enumerate(key)})
    exact = doubtful.select(F.col("h").alias("__dh"), F.col("once").alias("__once"), *[F.col(n).alias(f"__v{i}") for i, n in enumerate(names)])
    same = F.col("__h") == F.col("__dh")
    for i in range(len(names)):
        same = same & F.col(f"__key{i}").eqNullSafe(F.col(f"__v{i}"))
    keyed = keyed.join(exact.hint("merge"), same)
    plain = keyed.where("not __once").select(*columns)
    nth = F.row_number().over(Window.partitionBy("__h", *[f"__v{i}" for i in range(len(names))]).orderBy(F.lit(1)))
    single = keyed.where("__once").withColumn("__nth", nth).where("__nth = 1").select(*columns)
    return sure.unionByName(plain).unionByName(single)
