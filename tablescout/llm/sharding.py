"""Shards of nearly equal bytes by sampled splitters.

A row's size is the UTF-8 bytes of its text and eight. Rows are ordered by the hash of their text.
Equal texts are one unit and stay in one shard, unless they make up more than ``WHOLE`` of a shard;
then each row is a unit.

1. Units above a small part of a shard are few by their size (no more than ``shards * PART``); the
   largest goes first, each to the shard with the least bytes so far. The shards' remaining room is
   what fills all of them to one level.
2. Of the other units' rows a sample is drawn, each row with a chance in proportion to its size, and the
   sample's quantiles are the splitters of ranges of about equal bytes. Rows are partitioned by
   range; a range that comes out overfull is subdivided. Splitters only deal out the work: no
   result depends on them.
3. The ranges' measured sizes give every unit its exact place in the order; the middle of a unit
   decides which shard's room it falls into. Places inside a shard come from sums of the same kind.

Defined results: NULL text has no bytes. Rows that repeat a ``doc_id`` are rows of their own. A NULL
``doc_id`` stays NULL. Other columns are ignored. ``grown_shard`` is NULL: the law is ``bytes``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablescout.llm.common import as_identifier, identifier, small_side
from tablescout.session import materialize

SHARDS = 24
#: A unit above this part of a shard is placed by itself.
PART = 128
#: Equal texts stay together up to this share of a shard.
WHOLE = 1.0
#: Rows of a range, most ranges, and sampled rows per range.
RANGE_ROWS = 20_000
MOST_RANGES = 4096
SAMPLES = 16
_BIN = 54  # the upper 10 bits of a hash are its bin


def _chance(*values: Column) -> Column:
    """A number below 1 that is fixed for a unit."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(11), *values), 11).cast("double") * 2.0**-53


def _balanced(units: DataFrame, shards: int) -> DataFrame:
    """``key, sub, bytes, n, shard`` of the large units: each in turn to the shard with the least bytes.

    One row holds all of them; there are no more than ``shards * PART``.
    """
    listed = units.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "key", "sub", "n"))).alias("units"))
    state = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<int>").alias("chosen"))

    def place(s: Column, unit: Column) -> Column:
        shard = F.array_position(s["loads"], F.array_min(s["loads"])).cast("int") - 1
        loads = F.transform(s["loads"], lambda x, i: F.when(i == shard, x - unit["minus"]).otherwise(x))
        return F.struct(loads.alias("loads"), F.concat(s["chosen"], F.array(shard)).alias("chosen"))

    dealt = listed.withColumn("chosen", F.aggregate("units", state, place)["chosen"])
    both = dealt.select(F.explode(F.arrays_zip("units", "chosen")).alias("x"))
    return both.select("x.units.key", "x.units.sub", (-F.col("x.units.minus")).alias("bytes"), "x.units.n", F.col("x.chosen").alias("shard"))


def _room(large: DataFrame, rest: int, shards: int) -> list[int]:
    """Bytes of small rows that end before each shard's room does, summed up over the shards."""
    every = large.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    loads = every.join(large.groupBy("shard").agg(F.sum("bytes").alias("load")), "shard", "left").fillna(0, ["load"])
    order = Window.orderBy("load", "shard").rowsBetween(Window.unboundedPreceding, 0)
    levels = loads.withColumn("level", (F.lit(rest) + F.sum("load").over(order)) / F.count(F.lit(1)).over(order))
    level = F.min("level").over(Window.partitionBy())
    room = levels.withColumn("room", F.greatest(F.lit(0.0), level - F.col("load")))
    ends = room.withColumn("end", F.sum("room").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)))
    return [int(r["end"]) for r in ends.orderBy("shard").collect()]  # one number per shard


def shard(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` per row of ``documents(doc_id, text)``, and
    whether its text is ``divided``: held by more rows than fit into a shard."""
    spark = documents.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(documents.select(
        identifier().alias("did"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("key")), "sizes")
    # Rows that repeat an identifier and text are told apart by their number of copies, not one by one.
    rows = rows.groupBy("did", "size", "crc", "key").agg(F.count(F.lit(1)).alias("copies"))
    rows = materialize(rows.select("did", "size", "crc", "key", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")), "rows")
    whole = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    quota = whole["bytes"] / shards
    limit = max(quota / PART, 8.0)

    # Groups that must be divided, and units that are placed by themselves, are few by their size.
    divided = rows.groupBy("key").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > quota * WHOLE).select("key", F.lit(True).alias("divided"))
    rows = rows.join(F.broadcast(divided), "key", "left").withColumn(
        "sub", F.when(F.col("divided"), F.xxhash64("did", "copy")).otherwise(F.lit(0).cast("long"))).drop("divided")
    units = rows.groupBy("key", "sub").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    large = materialize(_balanced(units.where(F.col("bytes") > limit), shards), "large")
    chosen = F.broadcast(large.select("key", "sub", "n", "shard"))
    units = rows.join(F.broadcast(large.select("key", "sub")), ["key", "sub"], "left_anti")
    rest = whole["bytes"] - (large.agg(F.sum("bytes").alias("bytes")).first()["bytes"] or 0)
    ends = _room(large, rest, shards)

    ranges = int(min(MOST_RANGES, whole["n"] // RANGE_ROWS + spark.sparkContext.defaultParallelism))
    chance = F.col("size") * F.lit(ranges * SAMPLES / max(rest, 1))
    drawn = units.where(_chance("key", "sub", "did", "copy") < chance).select("key", "sub")
    order = Window.orderBy("key", "sub")
    cut = drawn.withColumn("place", F.row_number().over(order)).where(F.col("place") % SAMPLES == 0).select("key", "sub").distinct()
    first = spark.range(1).select(F.lit(-(2**63)).alias("key"), F.lit(-(2**63)).alias("sub"))
    low = first.unionByName(cut).withColumn("at", F.struct("key", "sub"))
    splitters = materialize(low.select("at", F.row_number().over(Window.orderBy("at")).alias("range"), F.lead("at").over(Window.orderBy("at")).alias("next")), "splitters")
    last_bin = F.shiftright(F.coalesce(F.col("next.key"), F.lit(2**63 - 1)), _BIN)
    listed = splitters.withColumn("bin", F.explode(F.sequence(F.shiftright(F.col("at.key"), _BIN), last_bin)))
    # A row per splitter and bin: bounded by MOST_RANGES and the number of bins.
    own = F.struct("key", "sub")
    placed = units.withColumn("bin", F.shiftright("key", _BIN)).join(F.broadcast(listed), "bin").where(
        (own >= F.col("at")) & (F.col("next").isNull() | (own < F.col("next"))))

    mean = rest / ranges
    sums = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.min("key").alias("key_low"), F.max("key").alias("key_high"),
                                       F.min("sub").alias("sub_low"), F.max("sub").alias("sub_high"))
    parts = materialize(sums.select("range", F.ceil(F.col("bytes") / max(2 * mean, 1.0)).alias("parts"),
                                    "key_low", "key_high", "sub_low", "sub_high"), "parts")

    def share(name: str) -> Column:
        """How far a row lies into its range."""
        span = F.col(f"{name}_high").cast("double") - F.col(f"{name}_low").cast("double")
        return F.when(span > 0, (F.col(name).cast("double") - F.col(f"{name}_low").cast("double")) / span).otherwise(F.lit(0.0))

    inner = F.when(F.col("key_low") == F.col("key_high"), share("sub")).otherwise(share("key"))
    placed = placed.join(F.broadcast(parts), "range").withColumn(
        "part", F.least(F.floor(inner * F.col("parts")), F.col("parts") - 1)).select(
        "range", "part", "key", "sub", "did", "copy", "size", "crc")
    task = ["range", "part"]
    totals = placed.groupBy(*task).agg(F.sum("size").alias("bytes"))
    before = Window.orderBy(*task).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*task, F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*task).orderBy("key", "sub", "did", "copy")
    unit = Window.partitionBy(*task, "key", "sub")
    exact = placed.withColumn("end", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    exact = exact.withColumn("middle", (F.max("end").over(unit) + F.min(F.col("end") - F.col("size")).over(unit)) / 2)
    exact = exact.join(F.broadcast(offsets), task)
    middle = F.col("base") + F.col("middle")
    number = reduce(lambda a, b: a + b, ((middle >= e).cast("int") for e in ends[:-1]), F.lit(0))
    exact = materialize(exact.withColumn("shard", number).select("shard", *task, "key", "sub", "did", "copy", "size", "crc"), "placed")

    in_large = rows.join(chosen, ["key", "sub"]).withColumns({
        "range": F.lit(0), "part": F.pmod(F.xxhash64("did", "copy"), F.floor(F.col("n") / RANGE_ROWS) + 1)}).drop("n")
    columns = ["shard", "range", "part", "key", "sub", "did", "copy", "size", "crc"]
    every = in_large.select(*columns).unionByName(exact.select(*columns))
    # Large units number their rows unit by unit, the others range by range (ranges count from 1).
    of_unit = {c: F.when(F.col("range") == 0, F.col(c)).otherwise(F.lit(0)) for c in ("key", "sub")}
    every = every.withColumns({f"{c}_run": v for c, v in of_unit.items()})
    run = ["shard", "range", "part", "key_run", "sub_run"]
    runs = every.groupBy(*run).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy(*run[1:]).rowsBetween(Window.unboundedPreceding, -1)
    runs = materialize(runs.select(*run, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), "runs")
    place = F.row_number().over(Window.partitionBy(*run).orderBy("key", "sub", "did", "copy"))
    numbered = every.withColumn("place", place).join(small_side(runs), run).withColumn("slot", F.col("base") + F.col("place") - 1)
    return numbered.select(
        as_identifier("did").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), (F.col("sub") != 0).alias("divided"))
