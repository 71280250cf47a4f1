"""The embedding backfill as a stream that remembers failed texts and tries them again after doubling pauses.

A batch of texts whose call fails waits in the state of its bucket, with the number of calls it has
had and the time of the next one, so a pause blocks no task and outlives a restart of the query.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tablescout import fixed_values as V
from tablescout.functions import text
from tablescout.operators.backfill import Embedder, pending

#: Groups of ids whose failed texts share a state. A state holds the failed texts of its bucket only, so
#: take as many buckets as keep that small while the embedder is away.
BUCKETS = 64


def _tried(embedder: Embedder, batch_size: int, attempts: int, pause_ms: float) -> Callable:
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        waiting = list(zip(*state.get)) if state.exists else []  # (id, document, calls so far, time of the next)
        due = [w[:3] for w in waiting if w[3] <= now]
        later = [w for w in waiting if w[3] > now]
        for frame in frames:
            due += [(i, document, 0) for i, document in zip(frame["id"].tolist(), frame["document"].tolist())]
        for start in range(0, len(due), batch_size):
            part = due[start : start + batch_size]
            try:
                vectors = [np.asarray(v, dtype=np.float32) for v in embedder([document for _, document, _ in part])]
            except Exception:
                later += [(i, document, calls + 1, now + max(1, int(pause_ms * 2**calls)))
                          for i, document, calls in part if calls + 1 < attempts]
            else:
                yield pd.DataFrame({"id": [i for i, _, _ in part], "embedding": vectors})
        if later:
            state.update(tuple(list(column) for column in zip(*later)))
            state.setTimeoutDuration(max(1, min(due_ms for *_, due_ms in later) - now))
        elif state.exists:
            state.remove()

    return step


def stream_retried_backfill(places: DataFrame, embedder: Embedder, path: str, checkpoint: str,
                            batch_size: int = V.EMBEDDING_BATCH_SIZE, attempts: int = V.EMBEDDING_ATTEMPTS,
                            backoff_s: float = V.EMBEDDING_BACKOFF_SECONDS, buckets: int = BUCKETS,
                            every_s: float = 1.0) -> StreamingQuery:
    """Append ``(id, embedding)`` of catalog rows that arrive without a vector to ``path``.

    A row appears once its batch succeeds. After ``attempts`` failed calls it leaves the state without
    a vector and stays pending in the catalog. The query runs until it is stopped (see ``finish``);
    its state is partitioned by ``spark.sql.shuffle.partitions`` of the first start.
    """
    id_type = places.schema["id"].dataType.simpleString()
    documents = pending(places).select("id", text.place_document().alias("document"),
                                       F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket"))
    tried = documents.groupBy("bucket").applyInPandasWithState(
        _tried(embedder, batch_size, attempts, backoff_s * 1000), f"id {id_type}, embedding array<float>",
        f"ids array<{id_type}>, documents array<string>, calls array<int>, due_ms array<long>", "append",
        GroupStateTimeout.ProcessingTimeTimeout)
    writer = tried.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=f"{every_s} seconds").start(path)


def finish(query: StreamingQuery, poll_s: float = 0.2) -> None:
    """Wait until all rows that have arrived have a vector or are given up, then stop the query.

    A query that finds no new rows at its start does nothing until some arrive, and neither does this wait.
    """
    while query.isActive:
        batches = query.recentProgress
        # The first batch of a run may be one that a stop cut off; a later one has looked for new rows.
        if len(batches) > 1 and not batches[-1]["numInputRows"] and not any(s["numRowsTotal"] for s in batches[-1]["stateOperators"]):
            break
        if not batches and query.status["message"] == "Waiting for data to arrive":
            break
        time.sleep(poll_s)
    if query.exception():
        raise query.exception()
    query.stop()
