"""Normalising and validating request tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablescout import fixed_values as V

_POSITION = ("latitude", "longitude")
#: Column, name used in messages.
_BODY = (
    ("max_distance_km", "maxDistanceInKm"),
    ("preferred_price_range", "preferredPriceRange"),
    ("minimum_rating", "minimumRating"),
)


def _number(name: str) -> Column:
    return F.col(name).try_cast("double")


def _whole(name: str) -> Column:
    """The number without its fraction; NULL if there is none or no integer can hold it."""
    return _number(name).try_cast("int")


def _parameter_error(column: str, name: str, required: bool, value: Column | None = None) -> Column:
    """Missing or unreadable value; NULL when fine."""
    missing = F.when(F.col(column).isNull(), F.lit(V.TEXT_MISSING.format(name))) if required else F
    return missing.when(
        F.col(column).isNotNull() & (_number(column) if value is None else value).isNull(), F.lit(V.TEXT_WRONG_TYPE.format(name)))


def _limits(field: str, value: Column, low: Column, high: int) -> list[Column]:
    at_least = V.TEXT_POSITIVE if field == "maxDistanceInKm" else V.TEXT_AT_LEAST.format(0)
    return [
        F.when(~low, F.lit(f"{field}: {at_least}")),
        F.when(~(value <= high), F.lit(f"{field}: {V.TEXT_AT_MOST.format(high)}")),
    ]


def check_requests(df: DataFrame) -> DataFrame:
    """Typed request columns plus ``message``: the rejection text, NULL when accepted.

    Absent numbers of the body count as 0, so an absent distance is rejected. Ratings and
    prices are truncated to whole numbers (3.5 becomes 3); what no integer can hold is of the wrong
    type, as text is. Columns may hold text.
    """
    distance = F.coalesce(_number("max_distance_km"), F.lit(0.0))
    price, rating = (F.coalesce(_whole(n), F.lit(0)) for n in ("preferred_price_range", "minimum_rating"))
    violations = [
        *_limits("maxDistanceInKm", distance, (distance > 0) & ~F.isnan(distance), V.MAX_DISTANCE_KM),
        *_limits("preferredPriceRange", price, price >= 0, V.MAX_PRICE),
        *_limits("minimumRating", rating, rating >= 0, V.MAX_RATING),
    ]
    broken = F.filter(F.array(*violations), lambda x: x.isNotNull())
    joined = F.array_join(broken, "; ")
    body = F.when(F.size(broken) > 0, F.when(F.trim(joined) == "", F.lit(V.TEXT_REJECTED)).otherwise(joined))
    message = F.coalesce(
        *(_parameter_error(n, n, True) for n in _POSITION),
        _parameter_error(*_BODY[0], False),
        *(_parameter_error(column, name, False, _whole(column)) for column, name in _BODY[1:]),
        body,
    )
    typed = {
        "latitude": _number("latitude"), "longitude": _number("longitude"),
        "max_distance_km": distance, "preferred_price_range": price, "minimum_rating": rating,
    }
    return df.select("*", message.alias("message")).withColumns(typed)


def validate_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted requests, and one error record per rejected request."""
    checked = check_requests(df)
    accepted = checked.where(F.col("message").isNull()).drop("message")
    rejected = checked.where(F.col("message").isNotNull()).select(
        "qid", F.current_timestamp().alias("rejected_at"), F.lit(400).alias("status"),
        F.lit("Validation Failed").alias("error"), "message",
    )
    return accepted, rejected
