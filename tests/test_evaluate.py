import random
import statistics

import numpy as np
import pytest

from tablescout.operators import evaluate
from tablescout.operators.orderstats import from_bits, order_statistics, ordered_bits
from tablescout.plans import evaluation

RECS = ("qid long, position int, restaurant_name string, justification string, distance double, overall_rating double, "
        "price_range int, cuisines array<string>")
ASKED = "qid long, max_distance_km double, minimum_rating int, preferred_price_range int, expected_cuisines array<string>"
WANTED = {"p50": None, "p90": 0.9, "p99": 0.99}


def plain(values):
    ordered = sorted(values)
    if not ordered:
        return {"p50": 0.0, "p90": 0.0, "p99": 0.0}
    return {"p50": statistics.median(ordered), "p90": ordered[int(len(ordered) * 0.9)], "p99": ordered[int(len(ordered) * 0.99)]}


@pytest.mark.parametrize("n", [0, 1, 2, 9, 10, 11, 100, 5000])
def test_order_statistics(spark, n):
    rng = random.Random(n)
    values = [rng.choice([3.0, rng.lognormvariate(3, 2), -rng.random(), 0.0, -0.0, 5e-324]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "ms double")
    assert order_statistics(df, "ms", WANTED).first().asDict() == pytest.approx(plain(values))


def test_bits_keep_the_order_of_numbers():
    values = [float("-inf"), -1e300, -2.0, -5e-324, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300, float("inf")]
    bits = ordered_bits(np.array(values))
    assert sorted(bits.tolist()) == bits.tolist() and [from_bits(int(b)) for b in bits] == values
    assert ordered_bits(np.array([-0.0]))[0] == ordered_bits(np.array([0.0]))[0]
    nan = ordered_bits(np.array([float("nan"), -float("nan")]))
    assert nan[0] == nan[1] > bits[-1]


def test_order_statistics_of_many_rows(spark):
    """Many rows, a third of them equal."""
    df = spark.range(300_000).selectExpr("case when id % 3 = 0 then 7.0D else cast(hash(id) as double) / 1e6 end as ms")
    assert order_statistics(df, "ms", WANTED).first().asDict() == pytest.approx(plain([r[0] for r in df.collect()]))


def test_counters(spark):
    recs = spark.createDataFrame([
        (1, 1, "Zen", "Fresh fish close by, worth it", 5.04, 3.96, 2, ["Sushi"]),
        (1, 2, "Tony", "  ", 5.06, 3.94, 1, ["Italian"]),
        (1, 3, None, None, None, None, None, None),
        (1, 4, "Bar", "4 km", 1.0, 5.0, 2, []),
        (1, 5, "Far", "short", 1.0, 5.0, 2, ["Thai"]),
        (2, 1, "A", "A!", 1.0, 0.0, 0, ["B"]),
    ], RECS)
    asked = spark.createDataFrame(
        [(1, 5.0, 4, 2, ["SUSHI", "tony"]), (2, 5.0, 0, 0, []), (3, 5.0, 0, 0, ["x"])], ASKED)
    rows = {r["qid"]: r.asDict() for r in evaluate.score_recommendations(recs, asked).collect()}
    assert rows[1] == {"qid": 1, "total_recommendations": 5, "distance_violations": 1, "rating_violations": 2,
                       "price_matches": 3, "grounded_rationales": 2, "semantic_matches": 2, "grounded_pct": 40.0}
    assert rows[2]["grounded_rationales"] == 1 and rows[2]["semantic_matches"] == 0
    assert rows[3]["total_recommendations"] == 0 and rows[3]["grounded_pct"] == 100.0


SCORES = ("qid long, total_recommendations long, distance_violations long, rating_violations long, price_matches long, "
          "grounded_rationales long, semantic_matches long")
RUNS = "qid long, status int, latency_ms double"


def test_metrics_count_successful_runs_only(spark):
    scores = spark.createDataFrame([(1, 10, 1, 0, 0, 10, 5), (2, 10, 0, 5, 0, 9, 10), (3, 10, 10, 10, 10, 0, 0)], SCORES)
    runs = spark.createDataFrame([(1, 200, 10.0), (2, 200, 30.0), (3, 503, 9999.0), (4, 200, 20.0)], RUNS)
    row = evaluate.eval_metrics(scores, runs).first()
    assert (row["total_queries"], row["successful_queries"], row["success_rate_pct"]) == (4, 3, 75.0)
    assert (row["total_recommendations"], row["latency_mean_ms"], row["latency_p50_ms"]) == (20, 20.0, 20.0)
    assert (row["latency_p90_ms"], row["latency_p99_ms"]) == (30.0, 30.0)
    assert (row["distance_adherence_pct"], row["rating_adherence_pct"]) == (95.0, 75.0)
    assert (row["rationale_groundedness_pct"], row["semantic_relevance_pct"]) == (95.0, 75.0)
    gates = {r["metric"]: r["status"] for r in evaluate.quality_gates(evaluate.eval_metrics(scores, runs)).collect()}
    assert gates == {"success_rate_pct": "WARN", "distance_adherence_pct": "FAIL", "rating_adherence_pct": "FAIL",
                     "rationale_groundedness_pct": "PASS", "semantic_relevance_pct": "PASS",
                     "latency_p50_ms": "PASS", "latency_p90_ms": "PASS"}


def test_evaluation_job(spark):
    recs = spark.createDataFrame([(1, 1, "Zen", "Zen is 1 km away", 1.0, 5.0, 2, ["Sushi"])], RECS)
    asked = spark.createDataFrame([(1, 5.0, 4, 2, ["sushi"])], ASKED)
    report = evaluation.evaluate_recommendations(recs, asked, spark.createDataFrame([(1, 200, 5.0)], RUNS))
    assert {r["status"] for r in report.gates.collect()} == {"PASS"}
    assert report.scores.count() == report.samples.count() == 1
    assert report.metrics.first()["semantic_relevance_pct"] == 100.0


def test_metrics_of_no_runs(spark):
    row = evaluate.eval_metrics(spark.createDataFrame([], SCORES), spark.createDataFrame([], RUNS)).first().asDict()
    assert row == {
        "total_queries": 0, "successful_queries": 0, "success_rate_pct": 0.0, "total_recommendations": 0,
        "latency_mean_ms": 0.0, "latency_p50_ms": 0.0, "latency_p90_ms": 0.0, "latency_p99_ms": 0.0,
        "distance_adherence_pct": 100.0, "rating_adherence_pct": 100.0, "rationale_groundedness_pct": 100.0,
        "semantic_relevance_pct": 0.0}


def test_slow_gates(spark):
    runs = spark.createDataFrame([(i, 200, 4000.0) for i in range(10)], RUNS)
    gates = evaluate.quality_gates(evaluate.eval_metrics(spark.createDataFrame([], SCORES), runs))
    assert {r["metric"]: r["status"] for r in gates.collect()}["latency_p90_ms"] == "SLOW"
    assert gates.columns == ["metric", "target", "achieved", "status"]


def test_kpis_and_samples(spark):
    recs = spark.createDataFrame([
        (1, 1, "A", "x" * 121, 0.125, None, 1, ["c"]), (1, 2, None, None, None, 4.5, 1, None),
        (1, 3, "C", "y", 9.0, 1.0, 1, [])], RECS)
    assert evaluate.kpis(recs).first().asDict() == {"qid": 1, "recommendations": 3, "closest_km": 0.0, "top_rating": 4.5}
    first, second = evaluate.sample_rows(recs).orderBy("position").collect()
    assert (first["rationale"], first["distance"], first["rating"]) == ("x" * 120 + "...", 0.12, 0.0)
    assert (second["name"], second["rationale"], second["rating"]) == ("", "", 4.5)
