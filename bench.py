"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs twice; ``queries`` holds the second run, ``first_run`` the one that also warms up.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablescout.plans.queries import QUERIES  # noqa: E402
from tablescout.session import get_session  # noqa: E402

HEADLINE = (
    "q05_distance_topk_batch", "q06_vector_topk_batch", "q07_hybrid_batch", "q08_semantic_fallback",
    "q13_prompt", "q15_generated_or_template", "q18_upsert_catalog", "q19_history_by_user",
    "q21_metro_histogram", "q22_densest_metro_centroid", "q23_stratified_sample", "q26_request_validation",
    "q28_eval_metrics", "q31_ivf_topk", "q32_embed_backfill", "q33_stream_history", "q35_raw_flatten",
    "q40_persona_answers", "q44_recommend_from_text",
)


def main(names: tuple[str, ...]) -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("tablescout-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("OFF")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    first = {name: run(name) for name in names}  # starts workers, compiles code
    seconds = {name: run(name) for name in names}
    asked = spark.read.parquet(f"{folder}/customer.parquet").count()
    report = {
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "requests": asked,
        "first_run": first,
    }
    if "q07_hybrid_batch" in seconds:
        report["hybrid_requests_per_sec"] = round(asked / seconds["q07_hybrid_batch"], 1)
    print(json.dumps(report))


if __name__ == "__main__":
    main(tuple(sys.argv[1:]) or HEADLINE)
