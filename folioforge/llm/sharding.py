"""Minimax contiguous partition of ordered atomic groups into shards of near-equal bytes.

Groups are rows with equal texts, in the order of their SHA-256. Prefix sums of bytes and rows are taken block by block (a block
is a range of digests) and carried over by the blocks' sums. The smallest feasible capacity is searched by sections: each
round checks SECTIONS capacities at once, greedily: a check jumps from cut to cut, and a jump reads, for each capacity, the one
block that holds the next cut. The driver only holds the block directory, at most 16 ** MAX_DIGITS rows.

Defined cases: a null text counts as empty (size: the overhead); a null doc_id comes first in its group; repeated rows are
rows of one group, each with a slot of its own; a group larger than the mean shard fills one alone if need be, and then some
shards may stay empty; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import text_of, written

SECTIONS = 512
MAX_DIGITS = 4
#: Groups that a block holds on average, up to 16 ** MAX_DIGITS blocks.
BLOCK_GROUPS = 16
#: Parts of a group, so that one huge group's rows are numbered in many tasks.
PARTS = 4096


class _Search:
    def __init__(self, groups: DataFrame, blocks: list, shards: int):
        """groups: block, group_ends (an array). blocks: rows of block, bytes, first byte, in order."""
        self.groups, self.shards = groups, shards
        self.names = [b["block"] for b in blocks]
        self.starts = [b["block_start"] for b in blocks]
        self.ends = [b["block_start"] + b["block_bytes"] for b in blocks]
        self.total = self.ends[-1]
        self.spark = groups.sparkSession

    def coarse(self, capacity: int) -> bool:
        """Whether the blocks, taken as atoms, fit; then the groups fit too."""
        at = 0
        for _ in range(self.shards):
            k = bisect_right(self.ends, at + capacity)
            at = self.ends[k - 1] if k and self.ends[k - 1] > at else at
        return at >= self.total

    def jump(self, limits: dict[int, int]) -> dict[int, int]:
        """For each limit the largest group end that is not beyond it: within the limit's block, or the block's start."""
        found, ask = {}, []
        for i, x in limits.items():
            k = bisect_right(self.ends, x)
            if k == len(self.ends):
                found[i] = self.total
            else:
                found[i] = self.starts[k]
                ask.append((i, self.names[k], x))
        if ask:
            values = ",".join(f"({i},'{name}',{x}L)" for i, name, x in ask)
            wanted = self.spark.sql(f"SELECT * FROM VALUES {values} AS t(i, at, x)")
            near = self.groups.where(F.col("block").isin(sorted({name for _, name, _ in ask})))
            hits = near.join(F.broadcast(wanted), near["block"] == wanted["at"])  # SECTIONS rows at most
            last = F.array_max(F.filter("group_ends", lambda e: e <= F.col("x")))
            for row in hits.select("i", last.alias("e")).where("e is not null").collect():
                found[row["i"]] = max(found[row["i"]], row["e"])
        return found

    def cuts(self, capacities: list[int]) -> list[list[int]]:
        """The ends of the shards that the greedy check makes for each capacity."""
        at = {i: 0 for i in range(len(capacities))}
        made: list[list[int]] = [[] for _ in capacities]
        for _ in range(self.shards):
            going = {i: x + capacities[i] for i, x in at.items() if x < self.total}
            if not going:
                break
            for i, end in self.jump(going).items():
                end = max(end, at[i])
                made[i].append(end)
                at[i] = end
        return made

    def best(self, largest: int) -> list[int]:
        low = max(largest, -(-self.total // self.shards))
        high, step = low, 1
        while not self.coarse(high):
            high, step = low + step, step * 2
        plan = None
        while plan is None or low < high:
            sections = sorted({low + (high - low) * k // (SECTIONS - 1) for k in range(SECTIONS)})
            made = self.cuts(sections)
            fits = [k for k, ends in enumerate(made) if ends and ends[-1] >= self.total]
            first = fits[0]
            plan, high = made[first], sections[first]
            low = high if first == 0 else sections[first - 1] + 1
        return plan


def shard(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """doc_id, text_sha256, size, text_crc32, shard, slot."""
    text = text_of()
    rows = written(
        docs.select(
            "doc_id",
            F.sha2(text, 256).alias("text_sha256"),
            (F.octet_length(text) + overhead).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int").alias("part"),
        ),
        "shard-rows",
    )
    n = rows.count()
    if n == 0:
        return rows.select("doc_id", "text_sha256", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    digits = 1
    while digits < MAX_DIGITS and n > BLOCK_GROUPS * 16**digits:
        digits += 1
    cells = rows.groupBy("text_sha256", "part").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
    cells = written(cells.withColumn("block", F.substring("text_sha256", 1, digits)), "shard-cells")
    in_order = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cells.groupBy("block").agg(F.sum("bytes").alias("block_bytes"), F.sum("rows").alias("block_rows"))
    blocks = written(
        blocks.withColumn("block_start", F.coalesce(F.sum("block_bytes").over(in_order), F.lit(0)))
        .withColumn("block_row", F.coalesce(F.sum("block_rows").over(in_order), F.lit(0))),
        "shard-blocks",
    )
    inside = Window.partitionBy("block").orderBy("text_sha256", "part").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy("block", "text_sha256")
    placed = (
        cells.join(blocks.select("block", "block_start", "block_row"), "block")
        .withColumn("start", F.col("block_start") + F.coalesce(F.sum("bytes").over(inside), F.lit(0)))
        .withColumn("row", F.col("block_row") + F.coalesce(F.sum("rows").over(inside), F.lit(0)))
        .withColumn("group_start", F.min("start").over(group))
        .withColumn("group_end", F.max(F.col("start") + F.col("bytes")).over(group))
        .select("block", "text_sha256", "part", "row", "group_start", "group_end")
    )
    placed = written(placed, "shard-placed")
    largest = placed.agg(F.max(F.col("group_end") - F.col("group_start"))).first()[0]
    directory = placed.groupBy("block").agg(F.collect_set("group_end").alias("group_ends"))
    directory = written(directory.repartitionByRange("block").sortWithinPartitions("block"), "shard-directory")
    ends = _Search(directory, blocks.orderBy("block").collect(), shards).best(largest)
    cuts = F.array(*[F.lit(e).cast("long") for e in ends])
    number = F.size(F.filter(cuts, lambda e: e <= F.col("group_start")))
    cells = placed.select("text_sha256", "part", "row", number.alias("shard"))
    first = cells.groupBy("shard").agg(F.min("row").alias("first"))
    cells = cells.join(F.broadcast(first), "shard")  # a row per shard
    within = Window.partitionBy("text_sha256", "part").orderBy("doc_id")
    return (
        rows.join(cells, ["text_sha256", "part"])
        .withColumn("slot", (F.col("row") - F.col("first") + F.row_number().over(within) - 1).cast("long"))
        .select("doc_id", "text_sha256", "size", "text_crc32", "shard", "slot")
    )
