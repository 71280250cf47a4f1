"""The whole job: request table in, recommendation table out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from tablescout import fixed_values as V
from tablescout.functions import text
from tablescout.operators import backfill, ground
from tablescout.operators.requests import validate_requests
from tablescout.operators.retrieve import attach_places, retrieve
from tablescout.session import materialize


def candidates(requests: DataFrame, places: DataFrame, embedder: backfill.Embedder | None = None,
               k: int = V.RESULT_LIMIT, described: bool = True, **options) -> DataFrame:
    """Ranked catalog rows of every valid request, with descriptions as a prompt shows them.

    With an embedder the query vectors are computed from the request texts; otherwise the
    ``query_vector`` column is used as it is. Only prompts need the descriptions: unless ``described``
    the rows have none, and the catalog's long texts are not moved.
    """
    accepted, _ = validate_requests(requests)
    if embedder is not None:
        accepted = backfill.embed_distinct(accepted, embedder, **options)
    ranked = materialize(retrieve(accepted, places, k), "ranked")  # read for its ids, then for its rows

    def shown(rows: DataFrame) -> DataFrame:
        """Descriptions at prompt size. The rows come from a broadcast join on the scan, so they are spread first."""
        rows = rows.repartition("id")
        return rows.withColumn("description", text.short_description(F.col("description"))) if described else rows.drop("description")

    return attach_places(ranked, places, shown)


def recommend(requests: DataFrame, places: DataFrame, responses: DataFrame | None = None,
              embedder: backfill.Embedder | None = None, k: int = V.RESULT_LIMIT,
              generator: Callable[[str], str | None] | None = None, ledger: str | None = None,
              generator_version: str = "1") -> DataFrame:
    """Final recommendations; ``responses`` is the ``(qid, body)`` table of the text generator, if there is one.

    With a ``generator`` (prompt to response body) the prompts are built from the candidates and its
    responses are written before they are used, so no prompt is paid for twice; with the path of a
    ``ledger`` this holds across runs. The candidates feed prompts, grounding and template rows, so
    they are written once.
    """
    found = candidates(requests, places, embedder, k, described=generator is not None)
    if generator is not None:
        found = materialize(found.select(*ground.CANDIDATE_COLUMNS, "description"), "candidates")
        prompts = ground.build_prompts(validate_requests(requests)[0], found, k, cut=False)
        made = ground.answer_prompts(prompts, generator, ledger, generator_version) if ledger else ground.generate_responses(prompts, generator)
        responses = materialize(made, "responses")
    if responses is None:
        return ground.recommendations(found)
    if generator is None:
        found = materialize(found.select(*ground.CANDIDATE_COLUMNS), "candidates")
    return ground.recommendations(found, ground.parse_generated(responses))


def write_recommendations(recs: DataFrame, path: str) -> None:
    """One row per request and position."""
    recs.write.mode("overwrite").parquet(path)
