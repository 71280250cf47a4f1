"""Text to vector: pending places, batched embedding with retries, cached query vectors."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tablescout import fixed_values as V
from tablescout.functions import text
from tablescout.session import materialize

Embedder = Callable[[list[str]], Sequence[Sequence[float]]]

#: Distinct query texts are broadcast with their vectors up to this many bytes of vector data.
BROADCAST_BYTES = 64 * 1024 * 1024


def pending(places: DataFrame) -> DataFrame:
    """Places still lacking a vector."""
    return places.where(F.col("embedding").isNull())


def embed_texts(df: DataFrame, key: str, text_col: str, embedder: Embedder, out_col: str = "embedding",
                batch_size: int = V.EMBEDDING_BATCH_SIZE, attempts: int = V.EMBEDDING_ATTEMPTS,
                backoff_s: float = V.EMBEDDING_BACKOFF_SECONDS) -> DataFrame:
    """``(key, vector)`` for every row, ``batch_size`` texts per embedder call.

    A failing call is repeated with doubling pauses; rows of a batch that never succeeds get a
    NULL vector while the other batches go on, and a later run picks them up.
    """
    def vectors(batch: list[str]) -> list:
        for attempt in range(attempts):
            try:
                return [np.asarray(v, dtype=np.float32) for v in embedder(batch)]
            except Exception:
                if attempt + 1 < attempts:
                    time.sleep(backoff_s * 2**attempt)
        return [None] * len(batch)

    def embed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start : start + batch_size]
                yield pd.DataFrame({key: part[key], out_col: vectors(part[text_col].tolist())})

    key_type = df.schema[key].dataType.simpleString()
    return df.select(*dict.fromkeys((key, text_col))).mapInPandas(embed, f"{key} {key_type}, {out_col} array<float>")


def write_vectors(places: DataFrame, vectors: DataFrame) -> DataFrame:
    """Places with the vectors filled in by id; an id without a new vector keeps what it has."""
    fresh = vectors.select("id", F.col("embedding").alias("_fresh"))
    return places.join(fresh, "id", "left").withColumn("embedding", F.coalesce("_fresh", "embedding")).drop("_fresh")


def pending_vectors(places: DataFrame, embedder: Embedder, **options) -> DataFrame:
    """``(id, embedding)`` of the pending places."""
    documents = pending(places).select("id", text.place_document().alias("document"))
    return embed_texts(documents, "id", "document", embedder, **options)


def backfill(places: DataFrame, embedder: Embedder, **options) -> DataFrame:
    """Places with every missing vector computed; rows that have one are left alone.

    The vectors are written to the shared folder first, so a lost executor repeats no calls
    that already succeeded.
    """
    return write_vectors(places, materialize(pending_vectors(places, embedder, **options), "vectors"))


def embed_distinct(requests: DataFrame, embedder: Embedder, **options) -> DataFrame:
    """Requests with ``query_text`` and its vector; each distinct text is embedded once.

    The text table is broadcast only when its measured size allows; otherwise the join on the
    text shuffles and the adaptive skew join splits very common texts. A text that cannot be
    embedded leaves a NULL vector, so the request is answered by distance.
    """
    asked = requests.drop("query_vector").withColumn("query_text", text.query_text())
    texts = asked.select("query_text").distinct()
    vectors = materialize(embed_texts(texts, "query_text", "query_text", embedder, out_col="query_vector", **options),
                          "query-vectors")
    size = vectors.agg(F.sum(F.length("query_text") + 4 * F.coalesce(F.size("query_vector"), F.lit(0)))).first()[0] or 0
    return asked.join(F.broadcast(vectors) if size <= BROADCAST_BYTES else vectors, "query_text")
