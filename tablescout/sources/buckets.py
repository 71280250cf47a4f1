"""The catalog bucketed by id: joins on the id move the other side only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

#: Rows per bucket that the number of buckets aims at.
BUCKET_ROWS = 250_000


def save_bucketed(places: DataFrame, table: str, path: str, buckets: int | None = None) -> DataFrame:
    """Write ``places`` as ``table`` with a file per bucket, sorted by id; returns the table."""
    spark = places.sparkSession
    if buckets is None:
        buckets = max(spark.sparkContext.defaultParallelism, math.ceil(places.count() / BUCKET_ROWS))
    # Spark deals rows to shuffle partitions and to buckets by the same hash, so a task writes one bucket.
    places.repartition(buckets, "id").write.mode("overwrite").bucketBy(buckets, "id").sortBy("id").option("path", path).saveAsTable(table)
    return spark.table(table)


def matching(places: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of a bucketed table whose ``id`` is among ``ids``: the ids come to the buckets, each once."""
    return places.join(ids.select("id").distinct().hint("shuffle_hash"), "id", "left_semi")
