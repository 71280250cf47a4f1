"""Whole seats by the highest quotients (Sainte-Laguë), as joins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def apportion(parties: DataFrame, group: list[str], party: list[str]) -> DataFrame:
    """``group, party, seats``: the seats of each group's parties.

    ``parties`` has one row per party with ``votes`` (0 or more) and its group's ``total`` seats. A seat
    goes to the highest of the quotients ``votes / (2 k + 1)``; equal ones to the first party.

    Not all quotients are made. The divisor ``d`` at which rounding ``votes / d`` fills ``H`` seats for
    ``n`` parties lies between ``V / (H + n/2)`` and ``V / (H - n/2)``, so all but about four seats a
    party are certain; only those are contested, a few rows for each party.
    """
    own = Window.partitionBy(*group)
    sums = parties.where("votes > 0").withColumns({"_sum": F.sum("votes").over(own), "_n": F.count(F.lit(1)).over(own)})
    share = F.col("votes") / F.col("_sum")
    bounds = sums.withColumns({
        "_low": F.greatest(F.lit(0), F.floor(share * (F.col("total") - F.col("_n") / 2) - 0.5) - 1).cast("long"),
        "_high": F.ceil(share * (F.col("total") + F.col("_n") / 2) + 0.5).cast("long") + 1})
    bounds = bounds.withColumn("_open", F.col("total") - F.sum("_low").over(own))
    seats = bounds.withColumn("_k", F.explode(F.sequence("_low", "_high")))
    ranked = seats.withColumn("_place", F.row_number().over(
        own.orderBy((F.col("votes") / (2 * F.col("_k") + 1)).desc(), *party, "_k")))
    won = F.count_if(F.col("_place") <= F.col("_open"))
    return ranked.groupBy(*dict.fromkeys([*group, *party])).agg((F.first("_low") + won).alias("seats"))
