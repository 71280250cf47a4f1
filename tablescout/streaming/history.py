"""Structured Streaming forms of the interaction log and the embedding backfill."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from tablescout.functions import text
from tablescout.operators.backfill import Embedder, embed_texts, pending
from tablescout.operators.history import valid_events


def stream_history(events: DataFrame, path: str, checkpoint: str, dedup_key: str | None = None,
                   lateness: str = "1 hour") -> StreamingQuery:
    """Append accepted events to the log at ``path``.

    Repeats are kept unless ``dedup_key`` names an event key; then a repeat within the watermark is dropped.
    """
    log = valid_events(events.withColumn("interaction_time", F.col("interaction_time").cast("timestamp")))
    if dedup_key:
        log = log.withWatermark("interaction_time", lateness).dropDuplicatesWithinWatermark([dedup_key])
    writer = log.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(path)


def stream_backfill(places: DataFrame, embedder: Embedder, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Embed catalog rows as they arrive without a vector; ``(id, embedding)`` is written per micro-batch.

    A micro-batch owns its folder and overwrites it when it is repeated, so no vector is written
    twice; rows whose batch failed have no vector and stay pending.
    """
    def write(rows: DataFrame, batch: int) -> None:
        documents = pending(rows).select("id", text.place_document().alias("document"))
        vectors = embed_texts(documents, "id", "document", embedder, **options)
        vectors.where(F.col("embedding").isNotNull()).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = places.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
