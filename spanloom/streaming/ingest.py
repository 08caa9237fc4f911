"""Streams into a store and out to listeners."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.operators.filters import Filters, where
from spanloom.sources.otlp import decode_json
from spanloom.sources.schema import text
from spanloom.sources.store import SpanStore


def payload_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Requests that land as files of a folder: body."""
    return spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", max_files).load(folder).withColumnRenamed("value", "body")


def ingest(payloads: DataFrame, store: SpanStore, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Writes each micro-batch's spans as blocks named by the batch, so that a
    repeated batch replaces itself. interval: a trigger like '1 second'; without
    it the query ends when what is there has been read (a drain)."""

    def write(batch: DataFrame, no: int) -> None:
        store.append(decode_json(batch), name=f"batch-{no:012d}")

    w = payloads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)
    return w.start()


def tail(spans: DataFrame, filters: Filters, deliver: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Live tail: spans of a stream that meet the conditions go to deliver, batch
    by batch, before and apart from any store. Stop the query to unsubscribe."""
    w = where(spans, filters).writeStream.outputMode("append").foreachBatch(deliver).option("checkpointLocation", checkpoint)
    w = w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)
    return w.start()


def shard(spans: DataFrame, n: int) -> DataFrame:
    """Adds shard, 0 .. n - 1, by trace_id, else the attributes' service, else name, else the whole span."""
    service = text(F.col("attributes")["service.name"])
    key = F.coalesce(F.nullif("trace_id", F.lit("")), service, F.nullif("name", F.lit("")), F.to_json(F.struct("span_id", "start_time", "end_time")))
    return spans.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
