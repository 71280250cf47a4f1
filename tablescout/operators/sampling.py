"""Stratified catalog sample around the densest metro."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tablescout import fixed_values as V
from tablescout.operators.ingest import is_usable


def pool_sizes(raw: DataFrame) -> DataFrame:
    return raw.agg(F.count(F.lit(1)).alias("total"), F.count_if(is_usable()).alias("usable"))


def metro_histogram(places: DataFrame, position: str = "id") -> DataFrame:
    """Places per (city, state), NULL being a value; ``first_pos`` is the first input position of the group."""
    return places.groupBy("city", "state").agg(
        F.count(F.lit(1)).alias("n"), F.min(position).alias("first_pos"))


def densest_metro(places: DataFrame, position: str = "id") -> DataFrame:
    """One row; ties go to the group seen first."""
    return metro_histogram(places, position).orderBy(F.desc("n"), F.asc("first_pos")).limit(1)


def centroid(places: DataFrame, position: str = "id") -> DataFrame:
    """Mean position of the densest metro, from one pass over the places."""
    return places.groupBy("city", "state").agg(
        F.count(F.lit(1)).alias("n"), F.min(position).alias("first_pos"),
        F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"),
    ).orderBy(F.desc("n"), F.asc("first_pos")).limit(1).drop("first_pos")


def sample_catalog(places: DataFrame, size: int = V.SAMPLE_SIZE, seed: int = V.SAMPLE_SEED,
                   position: str = "id") -> DataFrame:
    """``size`` rows without replacement, a third of them (400 at least) from the densest metro.

    Rows are taken in the order of a seeded hash, so the sample does not depend on the
    partitioning; ``sample_order`` is a second hash to read the sample in shuffled order.
    """
    top = densest_metro(places, position).first()
    if top is None:
        return places.withColumns({"densest": F.lit(False), "sample_order": F.lit("")})
    n_top = min(top["n"], max(size // 3, V.SAMPLE_TOP_FLOOR))
    n_rest = max(size - n_top, 0)

    def code(purpose: str):
        return F.md5(F.concat(F.lit(f"{seed}-{purpose}-"), F.coalesce(F.col("id").cast("string"), F.lit(""))))

    in_top = F.col("city").eqNullSafe(F.lit(top["city"])) & F.col("state").eqNullSafe(F.lit(top["state"]))
    def first_rows(rows: DataFrame, quota: int) -> DataFrame:
        """Rows whose hash starts low enough to hold the quota, so that only these are ordered."""
        start = F.substring(code("pick"), 1, 4)
        counts = rows.groupBy(start.alias("start")).agg(F.count(F.lit(1)).alias("n"))  # 65,536 rows at most
        upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("start"))).where(F.col("upto") >= quota)
        last = upto.agg(F.min("start").alias("last")).first()["last"]
        return (rows if last is None else rows.where(start <= last)).orderBy(code("pick"), "id").limit(quota)

    strata = [
        first_rows(places.where(condition), quota).withColumn("densest", F.lit(flag))
        for condition, quota, flag in ((in_top, n_top, True), (~in_top, n_rest, False))
    ]
    return strata[0].unionByName(strata[1]).withColumn("sample_order", code("shuffle"))
