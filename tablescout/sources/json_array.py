"""A JSON array of objects read by many tasks.

Spark reads a file that is one array as one row of one task. Here the text reader cuts the bytes at
every ``}``, in as many splits as the file has. What a piece means depends on what comes before it, of
which two numbers tell everything: the number of quotes (odd: the piece starts inside a string) and the
depth of brackets. Both are prefix sums: of the pieces inside a split, and of the splits' totals. An
object of the array ends where a bracket outside strings brings the depth back to 1; the pieces of an object
are put together and parsed.

The elements must be objects; the encoding is UTF-8. No task holds more than a split, or an object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tablescout.session import materialize


_PLACE = ["file", "start", "row"]


def _running(column: str, of: DataFrame) -> DataFrame:
    """Add ``<column>_before``: the sum of a column over all earlier pieces of the file. ``of`` is a written table."""
    totals = of.groupBy("file", "start").agg(F.sum(column).alias("_total"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("file", "start", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))  # a row per split
    inside = Window.partitionBy("file", "start").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    summed = of.withColumn("_inside", F.coalesce(F.sum(column).over(inside), F.lit(0)))
    return summed.join(offsets, ["file", "start"]).withColumn(f"{column}_before", F.col("_offset") + F.col("_inside")).drop("_offset", "_inside")


def _count(text: Column, marks: str) -> Column:
    return F.length(text) - F.length(F.translate(text, marks, ""))


def array_texts(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, row, json``: the text of every object of the arrays, and where its first piece stands."""
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"), "value")
    # Escapes only stand in strings, and no split or piece ends inside one: a bracket cannot be escaped.
    plain = F.regexp_replace("value", r"\\.", "")
    pieces = materialize(pieces.withColumn("quotes", _count(plain, '"').cast("long")), "pieces")
    # What follows a file's last bracket ends with the file instead of a bracket.
    last = pieces.groupBy("file").agg(F.max(F.struct("start", "row")).alias("last"))
    state = _running("quotes", pieces).join(last, "file")
    outside = F.regexp_replace(F.when(F.col("quotes_before") % 2 == 1, F.concat(F.lit('"'), plain)).otherwise(plain), r'"[^"]*("|$)', "")
    closes = ((F.col("quotes_before") + F.col("quotes")) % 2 == 0) & (F.struct("start", "row") != F.col("last"))
    depth = _count(outside, "{[") - _count(outside, "]") - closes.cast("int")
    state = materialize(state.select(*_PLACE, closes.alias("closes"), depth.cast("long").alias("depth")), "depths")
    ends = F.col("closes") & (F.col("depth_before") + F.col("depth") == 1)
    state = materialize(_running("depth", state).select(*_PLACE, ends.cast("long").alias("ends")), "ends")
    numbered = pieces.join(_running("ends", state), _PLACE)
    part = F.struct("start", "row", F.concat("value", F.lit("}")).alias("text"))
    objects = numbered.groupBy("file", "ends_before").agg(
        F.array_sort(F.collect_list(part)).alias("parts"), F.max("ends").alias("whole")).where("whole = 1")  # one object's pieces
    text = F.array_join(F.col("parts.text"), "")
    return objects.select("file", F.col("parts")[0]["start"].alias("start"), F.col("parts")[0]["row"].alias("row"),
                          F.regexp_replace(text, r"^[\s,\[]+", "").alias("json"))


def read_json_array(spark: SparkSession, path: str, schema: T.StructType, mode: str = "PERMISSIVE") -> DataFrame:
    """The objects of the arrays at ``path`` with their ``input_pos``; ``mode`` as in Spark's own reader."""
    texts = array_texts(spark, path)
    return texts.select(F.from_json("json", schema, {"mode": mode}).alias("record"),
                        F.struct("file", "start", "row").alias("input_pos")).select("record.*", "input_pos")
