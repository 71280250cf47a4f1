"""The evaluation job over stored recommendations."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from tablescout.operators import evaluate
from tablescout.session import materialize


class Report(NamedTuple):
    scores: DataFrame
    metrics: DataFrame
    gates: DataFrame
    samples: DataFrame


def evaluate_recommendations(recs: DataFrame, requests: DataFrame, runs: DataFrame) -> Report:
    """Counters per request, run metrics, gates, and the first rows of every answer.

    ``runs`` holds ``qid, status, latency_ms``; ``requests`` the limits and ``expected_cuisines``.
    The counters (a few numbers per request) are written once and feed the metrics.
    """
    scores = materialize(evaluate.score_recommendations(recs, requests), "scores")
    metrics = materialize(evaluate.eval_metrics(scores, runs), "metrics")
    return Report(scores, metrics, evaluate.quality_gates(metrics), evaluate.sample_rows(recs))
