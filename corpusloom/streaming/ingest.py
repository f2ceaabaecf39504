"""Resumable ingestion with Structured Streaming: sources that end (availableNow), exact offsets, deduplication by state."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_files(spark: SparkSession, path: str, schema, form: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(form).load(path)


def run_to_end(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Write all that is there now and stop; a second run takes only what came since, as the offsets are in the checkpoint."""
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def without_seen(df: DataFrame, text_col: str = "text") -> DataFrame:
    """A stream without texts that came before. Which of two equal rows stays doesn't matter here; where it does, see dedup.first_wins."""
    return df.withColumn("digest", F.sha2(F.trim(text_col), 256)).dropDuplicates(["digest"])


def first_wins_batches(spark: SparkSession, table: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends rows whose digest the table doesn't hold, the first of each batch by order."""
    from corpusloom.operators.dedup import first_rows

    def add(batch: DataFrame, _: int) -> None:
        new = first_rows(batch, ["digest"], order)
        if batch.sparkSession.catalog.tableExists(table):
            new = new.join(batch.sparkSession.table(table).select("digest"), "digest", "left_anti")
        new.write.mode("append").saveAsTable(table)

    return add


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """An addition of Spark's own: counts and sums by time window and type, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def with_retries(action: Callable[[], object], attempts: int = 5, base: float = 5.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """Runs an action again after transient errors, waiting base, 2 * base, ... seconds, at most `most`."""
    for k in range(attempts):
        try:
            return action()
        except (OSError, TimeoutError):
            if k == attempts - 1:
                raise
            sleep(min(most, base * 2**k))
    return None


def cursor_slice(order: DataFrame, position: int, batch: int, rank: int, world: int) -> DataFrame:
    """Rows of one rank's share of a global batch that begins at a position: a cursor is (epoch, position)."""
    at = F.col("position")
    return order.where((at >= position) & (at < position + batch * world) & ((at - position) % world == rank))
