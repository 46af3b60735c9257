"""Incremental ingestion and event-time bars on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.joins import upsert
from tidemark.sources import versions
from tidemark.sources.scratch import delete, scratch_path


def bars_of_events(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Open, high, low, close and count of events (event_id, ts, event_type, value) by type and window of event time; works on streams and tables alike."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    bars = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(
        F.min_by("value", "event_id").alias("Open"), F.max("value").alias("High"), F.min("value").alias("Low"), F.max_by("value", "event_id").alias("Close"), F.count("*").cast("double").alias("Volume"),
    )
    return bars.select(F.col("event_type").alias("symbol"), F.col("w.start").alias("dt"), "Open", "High", "Low", "Close", "Volume")


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: tuple[str, ...] = ("symbol", "dt"), every: str | None = None) -> StreamingQuery:
    """Takes up all new files of ``source`` as ``take_up`` does."""
    return take_up(spark.readStream.schema(schema).parquet(source), target, checkpoint, keys, every)


def take_up(stream: DataFrame, target: str, checkpoint: str, keys: tuple[str, ...] = ("symbol", "dt"), every: str | None = None) -> StreamingQuery:
    """Upserts a stream with a column dt into the table ``target`` (see ``sources.versions``), partitioned by month; what was taken is kept in ``checkpoint``.

    ``every`` (such as "60 seconds") polls until it is stopped; without it the query ends when nothing is new. A batch is written aside once, then reads and replaces the months that it has rows of, and no others. Readers see
    a batch's months all at once; a batch that is run again after a failure counts once.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in stream.dtypes)

    def take(batch: DataFrame, number: int) -> None:
        spark, month = batch.sparkSession, F.date_format("dt", "yyyy-MM")
        # the source is read once a batch: a fetch is dear, and may not be asked twice
        arrived = scratch_path(spark, "arrived")
        batch.write.parquet(arrived)
        batch = spark.read.schema(batch.schema).parquet(arrived)
        months = [r[0] for r in batch.select(month).distinct().collect()]
        if months:
            before = versions.version(spark, target)
            merged = upsert(versions.read(spark, target, schema, months, before), batch, list(keys))
            versions.write(merged, target, month, token=(versions.stream_id(spark, checkpoint), number), seen=before)
        delete(spark, arrived)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def current(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """The table as it is, empty before the first batch."""
    return versions.read(spark, target, schema)
