"""Cleaning, flattening and upserting catalog rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablescout import fixed_values as V
from tablescout import schemas
from tablescout.functions import text
from tablescout.sources import catalog, store

_RENAMED = {
    "priceRange": "price_range", "overallRating": "overall_rating",
    "numberOfRatings": "number_of_ratings", "websiteUrl": "website_url",
}


def valid_places(df: DataFrame) -> DataFrame:
    """Rows with an id, a non-blank name and a position."""
    return df.where(
        F.col("id").isNotNull() & text.not_blank(F.col("name"))
        & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def to_places(df: DataFrame) -> DataFrame:
    """Flat JSON records as catalog rows, without an embedding."""
    renamed = df.withColumnsRenamed(_RENAMED)
    return renamed.withColumns({c: text.null_safe_array(F.col(c)) for c in ("cuisines", "features")})


def parse_merchants(df: DataFrame, column: str) -> DataFrame:
    """Raw merchant records held as JSON text."""
    return df.withColumn("record", F.from_json(column, schemas.RAW_MERCHANT)).select("*", "record.*").drop("record")


def usable(df: DataFrame) -> DataFrame:
    """Exactly two numeric coordinates, non-blank name and description."""
    return df.where(is_usable())


def is_usable() -> Column:
    point = F.col("geoLocation.coordinates")
    complete = (F.size(point) == 2) & ~F.exists(point, lambda x: x.isNull())
    named = (text.strip(F.col("name")) != "") & (text.strip(F.col("description")) != "")
    return F.coalesce(complete & named, F.lit(False))


def flatten_features(features: Column, cap: int = V.FEATURE_CAP) -> Column:
    """All type texts in order: trimmed, without blanks and placeholders, first occurrence kept, at most ``cap``."""
    empty = F.array().cast("array<string>")
    lists = F.transform(F.coalesce(features, F.array()), lambda f: F.coalesce(f["types"], empty))
    trimmed = F.transform(text.null_safe_array(F.flatten(lists)), text.strip)
    kept = F.filter(trimmed, lambda t: (t != "") & (F.lower(t) != V.FEATURE_PLACEHOLDER))
    return F.slice(F.array_distinct(kept), 1, cap)


def pick_address() -> dict[str, Column]:
    """City and state of the address, else of the location; an empty text counts as absent."""
    def either(field: str) -> Column:
        return F.coalesce(F.nullif(F.col(f"location.address.{field}"), F.lit("")), F.col(f"location.{field}"))

    return {"neighborhood": F.col("location.neighborhood"), "city": either("city"), "state": either("state")}


def flatten_merchants(df: DataFrame) -> DataFrame:
    """Raw merchant rows in the flat JSON shape; coordinates come as longitude, latitude."""
    address = pick_address()
    position = [c for c in df.columns if c == "input_pos"]
    return df.select(
        F.col("_id").alias("id"), text.strip(F.col("name")).alias("name"),
        text.strip(F.col("description")).alias("description"),
        F.coalesce("cuisines", F.array().cast("array<string>")).alias("cuisines"), "priceRange",
        F.col("rating.overallRating").alias("overallRating"), F.col("rating.numberOfRatings").alias("numberOfRatings"),
        F.col("geoLocation.coordinates")[1].alias("latitude"), F.col("geoLocation.coordinates")[0].alias("longitude"),
        *(column.alias(name) for name, column in address.items()),
        "phone", "websiteUrl", flatten_features(F.col("features")).alias("features"),
        *position,
    )


def upsert_places(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` updated by ``new`` on id, in one join.

    The later input row wins inside one load (a repeated id is reduced before the shuffle), and
    a row that already has a vector keeps it even if its text changed.
    """
    if "input_pos" not in new.columns:
        new = new.withColumn("input_pos", F.monotonically_increasing_id())
    last = Window.partitionBy("id").orderBy(F.desc("input_pos"))
    new = new.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "input_pos")
    o, n = old.alias("o"), new.alias("n")
    columns = [F.coalesce("n.id", "o.id").alias("id")]
    for name in (c for c in old.columns if c != "id"):
        if name == "embedding" or name not in new.columns:
            columns.append(F.col(f"o.{name}"))
        else:
            columns.append(F.when(F.col("n.id").isNotNull(), F.col(f"n.{name}")).otherwise(F.col(f"o.{name}")).alias(name))
    return o.join(n, F.col("o.id") == F.col("n.id"), "full").select(*columns)


def ingest(spark: SparkSession, source: str, root: str, only_if_empty: bool = True, multi_line: bool = True) -> bool:
    """Load a flat JSON catalog into the table at ``root``; True when rows were written.

    A first load writes the base files, a later one only the rows it brings.
    """
    if only_if_empty and not catalog.load_places(spark, root).isEmpty():
        return False
    loaded = to_places(valid_places(catalog.read_catalog(spark, source, multi_line)))
    empty = spark.createDataFrame([], schemas.PLACES)
    return store.load_if_empty(upsert_places(empty, loaded), root) or store.upsert(loaded, root) > 0
