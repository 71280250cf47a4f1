"""Catalog files: flat and raw JSON in, JSON and a table with a log of changes out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablescout import fixed_values as V
from tablescout import schemas
from tablescout.sources import json_array, store


def _input_position() -> Column:
    """Order of the input: by file name, place of the split in its file, place of the row in its split.

    Spark reads large files first, so the order in which rows are met says nothing about the files.
    """
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                    F.monotonically_increasing_id().alias("row"))


def read_catalog(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Flat catalog records with their input position; unknown fields are ignored, any parse error fails the load."""
    reader = spark.read.schema(schemas.CATALOG_JSON).option("multiLine", multi_line).option("mode", "FAILFAST")
    return reader.json(path).withColumn("input_pos", _input_position())


def read_raw_merchants(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Nested merchant export; values of the wrong type become NULL for the usability check to drop.

    Spark reads a file that is one JSON array in one task; :func:`read_raw_array` reads it in many.
    """
    reader = spark.read.schema(schemas.RAW_MERCHANT).option("multiLine", multi_line).option("mode", "PERMISSIVE")
    return reader.json(path).withColumn("input_pos", _input_position())


def read_raw_array(spark: SparkSession, path: str) -> DataFrame:
    """Nested merchant export whose files are JSON arrays, each read by as many tasks as it has splits."""
    return json_array.read_json_array(spark, path, schemas.RAW_MERCHANT)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; NULL fields are written so that every record has every key."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def personas(spark: SparkSession) -> DataFrame:
    """The benchmark requests with the terms expected in their answers."""
    names = ("name", "latitude", "longitude", "preferred_cuisine", "max_distance_km", "prioritize_rating",
             "preferred_price_range", "minimum_rating", "expected_cuisines", "min_expected_results")
    rows = [(position, *persona) for position, persona in enumerate(V.PERSONAS, 1)]
    schema = ("qid bigint, name string, latitude double, longitude double, preferred_cuisine string, "
              "max_distance_km double, prioritize_rating boolean, preferred_price_range int, minimum_rating int, "
              "expected_cuisines array<string>, min_expected_results int")
    return spark.createDataFrame(rows, schema).select("qid", *names)


def load_places(spark: SparkSession, root: str) -> DataFrame:
    """The catalog as last committed; an empty table when there is none."""
    return store.read(spark, root)


def save_places(df: DataFrame, root: str, files: int | None = None) -> None:
    """Publish ``df`` as the whole catalog; readers see the old one until the write has committed."""
    store.replace_all(df, root, files)
