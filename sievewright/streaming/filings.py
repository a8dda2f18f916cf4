"""The filing scan over a stream of listing files.

Receipts are deduplicated within a watermark by the stream's state; each micro-batch
is then scored against the state table (seen receipts, recent events) and upserted
into it. A batch that is retried finds its receipts seen, so its effect is once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import ymd
from ..operators.state import StateTable
from ..plans.filings import scan

KEPT = ("rcept_no", "rcept_dt", "corp_code", "category", "subtype", "confirmed_pivot", "attention_score", "financing_risk_score", "band", "cluster_tags")


def deduplicated(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """Each receipt once; filings later than ``delay`` behind the newest are dropped."""
    timed = stream.withColumn("filed_at", ymd(F.col("rcept_dt")).cast("timestamp"))
    return timed.withWatermark("filed_at", delay).dropDuplicatesWithinWatermark(["rcept_no"])


def process_batch(spark: SparkSession, batch: DataFrame, state: StateTable, batch_id: int, lookback_days: int = 30) -> DataFrame:
    """Score a batch against the state and save it; the scored rows."""
    seen, stored = state.seen(), state.read()
    found = scan(batch.drop("filed_at"), seen=seen, stored=stored, lookback_days=lookback_days).candidates
    rows = found.select(*KEPT).withColumn("updated_at", F.lit(batch_id))
    state.save(rows)
    return rows


def start(spark: SparkSession, listing_dir: str, schema, state_dir: str, checkpoint: str, *, delay: str = "7 days", lookback_days: int = 30, files_per_batch: int = 100, available_now: bool = True) -> StreamingQuery:
    """Run over the parquet files of a folder: all that are there, or for ever."""
    state = StateTable(spark, state_dir)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(listing_dir)

    def each(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():  # a batch that only moves the watermark changes no state
            process_batch(batch.sparkSession, batch, state, batch_id, lookback_days)

    writer = deduplicated(stream, delay).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def event_rates(events: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling event-time window and type, for streams and batches."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("at", delay)
    rows = timed.groupBy(F.window("at", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
