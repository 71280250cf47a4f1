"""Catalog files in the order of a space-filling curve, with a manifest that tells which files a box can reach.

Every place stores its position on a Z-order curve (``curve``, 20 bits per axis). Files are ranges of the curve and
sorted by it, so places close to each other share files and row groups. A manifest keeps the ends
of each file, another one the files of each city. A box is covered by a few squares of the grid,
each of which is one range of the curve; the ranges choose the files that are read at all, and reach
their scan as a filter that skips row groups.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablescout import schemas
from tablescout.functions import geo
from tablescout.operators import blocks
from tablescout.session import materialize

BITS = 20
#: Rows and bytes (as text, before compression) per file that the number of files aims at; a file is one task's input.
FILE_ROWS, FILE_BYTES = 1_000_000, 128e6
#: Squares that cover all boxes together, and ranges they are merged into: both are held by the driver and the plan.
MOST_SQUARES, MOST_RANGES = 4096, 128

Ranges = list[tuple[int, int]]


def _spread(bits: Column) -> Column:
    """The bits of a number at every other place."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        bits = bits.bitwiseOR(F.shiftleft(bits, shift)).bitwiseAND(F.lit(mask))
    return bits


def _interleaved(y: Column, x: Column) -> Column:
    return F.shiftleft(_spread(y), 1).bitwiseOR(_spread(x))


def _axis(degrees: Column, low: float, span: float) -> Column:
    """Step of a coordinate; what lies outside counts as the first or last step, so the order of values is kept."""
    step = F.floor((degrees - F.lit(low)) / F.lit(span) * F.lit(float(1 << BITS)))
    return F.least(F.greatest(step, F.lit(0)), F.lit((1 << BITS) - 1)).cast("long")


def _steps(lat: Column, lon: Column) -> tuple[Column, Column]:
    return _axis(lat, -90.0, 180.0), _axis(lon, -180.0, 360.0)


def curve_key(lat: Column, lon: Column) -> Column:
    """Position on the curve; NULL for places without a position, which no box contains."""
    return F.when(geo.has_position(lat, lon), _interleaved(*_steps(lat, lon)))


def _row_bytes(places: DataFrame) -> Column:
    """About the bytes of a row: its texts, lists and vectors."""
    width = F.lit(8 * len(places.columns))
    for field in places.schema.fields:
        if isinstance(field.dataType, T.StringType):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(field.dataType, T.ArrayType):
            texts = isinstance(field.dataType.elementType, T.StringType)
            one = F.octet_length(F.array_join(field.name, "  ")) if texts else 8 * F.size(field.name)
            width = width + F.coalesce(one, F.lit(0))
    return width


def write_layout(places: DataFrame, path: str, files: int | None = None) -> int:
    """Write ``places`` along the curve, and the manifests below ``path`` (where readers of the data ignore them);
    returns the number of rows. The range key ends in the id, so a crowded point spreads over files."""
    spark = places.sparkSession
    if files is None:
        places = materialize(places, "unordered")  # read for its size, for samples of its keys, and for its rows
        size = places.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(_row_bytes(places)), F.lit(0)).alias("bytes")).first()
        files = max(1, math.ceil(size["rows"] / FILE_ROWS), math.ceil(size["bytes"] / FILE_BYTES))
    keyed = places.withColumn("curve", curve_key(F.col("latitude"), F.col("longitude")))
    keyed.repartitionByRange(files, "curve", "id").sortWithinPartitions("curve", "id").write.mode("overwrite").parquet(path)
    stored = spark.read.schema(keyed.schema).parquet(path)
    own = F.col("_metadata.file_name").alias("file")
    manifest = stored.select("curve", own).groupBy("file").agg(
        F.min("curve").alias("low"), F.max("curve").alias("high"), F.count(F.lit(1)).alias("rows"))
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/_files")
    cities = stored.select("city", "state", own).groupBy("city", "state", "file").agg(F.count(F.lit(1)).alias("rows"))
    cities.sortWithinPartitions("state", "city").write.mode("overwrite").parquet(f"{path}/_cities")
    return spark.read.parquet(f"{path}/_files").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]


def _merged(ranges: Ranges, most: int) -> Ranges:
    """Overlapping and neighbouring ranges as one, then those with the smallest gaps between them, until few are left."""
    merged: Ranges = []
    for low, high in sorted(ranges):
        if merged and low <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(merged[-1][1], high))
        else:
            merged.append((low, high))
    gaps = sorted(range(1, len(merged)), key=lambda i: merged[i][0] - merged[i - 1][1])
    closed = set(gaps[: max(0, len(merged) - most)])
    result: Ranges = []
    for i, (low, high) in enumerate(merged):
        if i in closed:
            result[-1] = (result[-1][0], high)
        else:
            result.append((low, high))
    return result


def box_ranges(requests: DataFrame, most_squares: int = MOST_SQUARES, most_ranges: int = MOST_RANGES) -> Ranges:
    """Ranges of the curve that hold every place in any request's box.

    A box takes up to five squares a side on the grid that fits it. If all requests together need too
    many squares, coarser grids are used: the ranges grow, but nothing is lost.
    """
    low_y, low_x = _steps(F.col("lat_min"), F.col("lon_min"))
    high_y, high_x = _steps(F.col("lat_max"), F.col("lon_max"))
    boxes = blocks.prepare_requests(requests, False).select(
        low_y.alias("y0"), high_y.alias("y1"), low_x.alias("x0"), high_x.alias("x1")).where("y0 <= y1 and x0 <= x1").distinct()
    span = F.greatest(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))
    boxes = boxes.withColumn("fits", F.greatest(F.length(F.bin(span)) - 2, F.lit(0)))
    for coarsest in range(0, BITS + 1, 2):
        shift = F.col("shift")
        rows = boxes.withColumn("shift", F.greatest("fits", F.lit(coarsest)))
        rows = rows.withColumn("y", F.explode(F.expr("sequence(shiftright(y0, shift), shiftright(y1, shift))")))
        rows = rows.withColumn("x", F.explode(F.expr("sequence(shiftright(x0, shift), shiftright(x1, shift))")))
        squares = rows.select(_interleaved(F.col("y"), F.col("x")).alias("square"), shift).distinct().limit(most_squares + 1).collect()
        if len(squares) <= most_squares or coarsest == BITS:
            break
    return _merged([(r["square"] << 2 * r["shift"], ((r["square"] + 1) << 2 * r["shift"]) - 1) for r in squares], most_ranges)


def _any(conditions: list[Column]) -> Column:
    """One condition of many, as a balanced tree."""
    if len(conditions) <= 2:
        return reduce(or_, conditions)
    half = len(conditions) // 2
    return _any(conditions[:half]) | _any(conditions[half:])


def _read(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    schema = T.StructType([*schemas.PLACES.fields, T.StructField("curve", T.LongType())])
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/{f}" for f in files))


def _files(spark: SparkSession, path: str, ranges: Ranges) -> DataFrame:
    """The manifest's rows of the files that hold a part of a range."""
    manifest = spark.read.parquet(f"{path}/_files")
    if not ranges:
        return manifest.limit(0)
    return manifest.where(_any([(F.col("low") <= high) & (F.col("high") >= low) for low, high in ranges]))


def places_in_boxes(spark: SparkSession, path: str, requests: DataFrame, **options: int) -> DataFrame:
    """Catalog rows that some request's box may contain: all that are in one, and few others."""
    ranges = box_ranges(requests, **options)
    files = [r["file"] for r in _files(spark, path, ranges).select("file").collect()]  # names, no more than files
    found = _read(spark, path, files)
    if ranges:
        found = found.where(_any([F.col("curve").between(low, high) for low, high in ranges]))
    return found.drop("curve")


def read_share(spark: SparkSession, path: str, requests: DataFrame, **options: int) -> DataFrame:
    """One row: files and rows of the catalog, files read for the requests, and rows their ranges keep."""
    ranges = box_ranges(requests, **options)
    every = spark.read.parquet(f"{path}/_files").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    read = _files(spark, path, ranges).agg(F.count(F.lit(1)).alias("files_read"))
    kept = places_in_boxes(spark, path, requests, **options).agg(F.count(F.lit(1)).alias("rows_read"))
    one = F.lit(1).alias("one")  # all three are a single row
    return every.select("*", one).join(read.select("*", one), "one").join(kept.select("*", one), "one").drop("one")


def places_in_city(spark: SparkSession, path: str, city: str | None, state: str | None) -> DataFrame:
    """Catalog rows of one city, from the files that hold any; a missing name is a value like any other."""
    own = F.col("city").eqNullSafe(F.lit(city)) & F.col("state").eqNullSafe(F.lit(state))
    files = [r["file"] for r in spark.read.parquet(f"{path}/_cities").where(own).select("file").distinct().collect()]
    return _read(spark, path, files).where(own).drop("curve")
