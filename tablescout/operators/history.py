"""The interaction log in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablescout import fixed_values as V


def _time(df: DataFrame):
    """The given time, else now."""
    now = F.current_timestamp()
    return F.coalesce(F.col("interaction_time").cast("timestamp"), now) if "interaction_time" in df.columns else now


def _event(df: DataFrame):
    """The event's own number, NULL where the source has none: batch and stream write one schema."""
    return (F.col("event_id").cast("long") if "event_id" in df.columns else F.lit(None).cast("long")).alias("event_id")


def visits(df: DataFrame) -> DataFrame:
    """Log rows for visits; repeats are kept."""
    return df.select(_event(df), "user_id", "restaurant_id", F.lit(V.VISITED).alias("interaction_type"),
                     F.lit(None).cast("double").alias("rating_given"), _time(df).alias("interaction_time"))


def ratings(df: DataFrame) -> DataFrame:
    """Log rows for ratings; the rating is not range-checked."""
    return df.select(_event(df), "user_id", "restaurant_id", F.lit(V.RATED).alias("interaction_type"),
                     F.col("rating_given").cast("double").alias("rating_given"), _time(df).alias("interaction_time"))


def valid_events(df: DataFrame) -> DataFrame:
    """Events the log accepts: keys present and a known interaction type."""
    return df.where(F.col("user_id").isNotNull() & F.col("restaurant_id").isNotNull()
                    & F.col("interaction_type").isin(V.VISITED, V.RATED))


def append_history(df: DataFrame, path: str) -> None:
    valid_events(df).write.mode("append").parquet(path)


#: Places named in a lookup up to this number reach the scan as values, beyond it as a join.
LISTED_IDS = 10


def write_history(df: DataFrame, path: str, distinct_places: int | None = None) -> None:
    """Rewrite the log clustered by user; the time in the range key spreads a very active user over files.

    The second access path, by place, are Bloom filters: each row group can tell that it does not
    hold a place. ``distinct_places`` is how many a row group may hold.
    """
    ordered = df.repartitionByRange("user_id", "interaction_time").sortWithinPartitions("user_id", "interaction_time")
    writer = ordered.write.mode("overwrite").option("parquet.bloom.filter.enabled#restaurant_id", "true")
    if distinct_places:
        writer = writer.option("parquet.bloom.filter.expected.ndv#restaurant_id", str(distinct_places))
    writer.parquet(path)


def place_events(history: DataFrame, ids: list[int]) -> DataFrame:
    """Log rows of a few places; the ids are values of the scan's filter, so row groups without them are not read."""
    if len(ids) > LISTED_IDS:
        raise ValueError(f"at most {LISTED_IDS} places; use history_by_place")
    return history.where(F.col("restaurant_id").isin(*ids))


def history_by_user(history: DataFrame, users: DataFrame) -> DataFrame:
    """All log rows of the given users (column ``user_id``)."""
    return history.join(users.select("user_id"), "user_id", "left_semi")


def history_by_place(history: DataFrame, ids: DataFrame) -> DataFrame:
    """All log rows of the given places (column ``restaurant_id``)."""
    return history.join(ids.select("restaurant_id"), "restaurant_id", "left_semi")


def fetch_places(places: DataFrame, ids: DataFrame) -> DataFrame:
    """Catalog rows of the given ids (column ``id``)."""
    return places.join(ids.select("id"), "id", "left_semi")
