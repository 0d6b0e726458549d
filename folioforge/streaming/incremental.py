"""Books that arrive over time: each micro-batch of new line tables is scanned and its repeated lines are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from folioforge.operators import scan


def scan_new_books(lines: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """lines: a stream of book_id, line_no, raw, start, whole books per file. A batch that is run again overwrites its own output."""

    def append(batch: DataFrame, epoch: int) -> None:
        scan.exact_groups(scan.blocks(batch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return lines.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
