"""Scoring stored recommendations against constraints, grounding, relevance and latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablescout import fixed_values as V
from tablescout.functions import text
from tablescout.operators.orderstats import order_statistics

_COUNTERS = ("total_recommendations", "distance_violations", "rating_violations", "price_matches",
             "grounded_rationales", "semantic_matches")


def _falsy_text(name: str) -> Column:
    return F.coalesce(name, F.lit(""))


def is_grounded() -> Column:
    """The rationale is not blank and names a cuisine, the place, a known word, or is long enough."""
    rationale = _falsy_text("justification")
    lowered = F.lower(rationale)
    mentioned = F.exists(text.null_safe_array(F.col("cuisines")), lambda c: F.contains(lowered, F.lower(c)))
    mentioned |= F.contains(lowered, F.lower(_falsy_text("restaurant_name")))
    for word in V.GROUNDING_WORDS:
        mentioned |= F.contains(lowered, F.lit(word))
    return (text.strip(rationale) != "") & (mentioned | (F.length(rationale) > V.GROUNDING_MIN_CHARS))


def is_semantic_hit() -> Column:
    """Any expected term occurs in name, cuisines or rationale; nothing expected, no hit."""
    parts = (_falsy_text("restaurant_name"), F.array_join(text.null_safe_array(F.col("cuisines")), " "),
             _falsy_text("justification"))
    shown = F.lower(F.concat_ws(" ", *parts))
    return F.exists(text.null_safe_array(F.col("expected_cuisines")), lambda e: F.contains(shown, F.lower(e)))


def score_recommendations(recs: DataFrame, requests: DataFrame) -> DataFrame:
    """Counters per request; requests carry the limits and ``expected_cuisines``."""
    limits = requests.select("qid", "max_distance_km", "minimum_rating", "preferred_price_range", "expected_cuisines")
    answered = F.col("position").isNotNull()
    distance = F.coalesce("distance", F.lit(0.0))
    rating = F.coalesce("overall_rating", F.lit(0.0))
    wanted = F.col("preferred_price_range")
    checks = {
        "total_recommendations": answered,
        "distance_violations": answered & (distance > F.col("max_distance_km") + V.EVAL_TOLERANCE),
        "rating_violations": answered & (F.col("minimum_rating") > 0) & (rating < F.col("minimum_rating") - V.EVAL_TOLERANCE),
        "price_matches": answered & (wanted > 0) & (F.col("price_range") == wanted),
        "grounded_rationales": answered & is_grounded(),
        "semantic_matches": answered & is_semantic_hit(),
    }
    counts = limits.join(recs, "qid", "left").groupBy("qid").agg(
        *(F.count_if(condition).alias(name) for name, condition in checks.items()))
    grounded = F.try_divide("grounded_rationales", "total_recommendations") * 100.0
    return counts.withColumn("grounded_pct", F.coalesce(grounded, F.lit(100.0)))


def _rate(part: Column, total: Column, empty: float) -> Column:
    return F.coalesce(F.try_divide(part, total) * F.lit(100.0), F.lit(empty))


def eval_metrics(scores: DataFrame, runs: DataFrame) -> DataFrame:
    """One row of run metrics. Counters and latencies count runs with status 200 only."""
    joined = runs.join(scores, "qid", "left")
    ok = F.col("status") == 200
    totals = joined.agg(
        F.count(F.lit(1)).alias("total_queries"), F.count_if(ok).alias("successful_queries"),
        F.coalesce(F.avg(F.when(ok, F.col("latency_ms"))), F.lit(0.0)).alias("latency_mean_ms"),
        *(F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).alias(c) for c in _COUNTERS),
    )
    latencies = order_statistics(
        runs.where(ok), "latency_ms", {"latency_p50_ms": None, "latency_p90_ms": 0.9, "latency_p99_ms": 0.99})
    total = F.col("total_recommendations")
    one = F.lit(1).alias("one")  # both sides are a single row
    return totals.select("*", one).join(latencies.select("*", one), "one").select(
        "total_queries", "successful_queries",
        _rate(F.col("successful_queries"), F.col("total_queries"), 0.0).alias("success_rate_pct"),
        "total_recommendations", "latency_mean_ms", "latency_p50_ms", "latency_p90_ms", "latency_p99_ms",
        _rate(total - F.col("distance_violations"), total, 100.0).alias("distance_adherence_pct"),
        _rate(total - F.col("rating_violations"), total, 100.0).alias("rating_adherence_pct"),
        _rate(F.col("grounded_rationales"), total, 100.0).alias("rationale_groundedness_pct"),
        _rate(F.col("semantic_matches"), total, 0.0).alias("semantic_relevance_pct"),
    )


def quality_gates(metrics: DataFrame) -> DataFrame:
    """``metric, target, achieved, status``, one row per gate."""
    rows = []
    for metric, target, threshold in V.GATES:
        value = F.col(metric)
        if metric == "success_rate_pct":
            passed, otherwise = value == threshold, "WARN"
        elif metric.startswith("latency"):
            passed, otherwise = value < threshold, "SLOW"
        else:
            passed, otherwise = value >= threshold, "FAIL" if "adherence" in metric else "WARN"
        rows.append(F.struct(
            F.lit(metric).alias("metric"), F.lit(target).alias("target"), value.alias("achieved"),
            F.when(passed, "PASS").otherwise(otherwise).alias("status")))
    return metrics.select(F.inline(F.array(*rows)))


def kpis(recs: DataFrame) -> DataFrame:
    """Answer size, closest distance and best rating per request."""
    return recs.groupBy("qid").agg(
        F.count(F.lit(1)).alias("recommendations"),
        F.min(F.coalesce("distance", F.lit(0.0))).alias("closest_km"),
        F.max(F.coalesce("overall_rating", F.lit(0.0))).alias("top_rating"))


def sample_rows(recs: DataFrame, per_request: int = 2) -> DataFrame:
    """The first recommendations of every request as a report shows them."""
    rationale = _falsy_text("justification")
    short = F.when(F.length(rationale) > V.RATIONALE_CHARS,
                   F.concat(F.left(rationale, F.lit(V.RATIONALE_CHARS)), F.lit("..."))).otherwise(rationale)
    return recs.where(F.col("position") <= per_request).select(
        "qid", "position", _falsy_text("restaurant_name").alias("name"),
        F.coalesce("overall_rating", F.lit(0.0)).alias("rating"),
        F.bround(F.coalesce("distance", F.lit(0.0)), 2).alias("distance"), "cuisines", short.alias("rationale"))
