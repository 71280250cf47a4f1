"""Generated texts checked against the retrieved candidates, with a template fallback."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window, functions as F

from tablescout import fixed_values as V
from tablescout import schemas
from tablescout.functions import text

#: Candidate columns the answers are made of; long texts stay out of what is stored per answer.
CANDIDATE_COLUMNS = ("qid", "rank", "id", "name", "cuisines", "overall_rating", "price_range", "latitude",
                     "longitude", "dist_km")

#: Columns of a recommendation besides ``qid`` and ``position``.
_FIELDS = ("id", "restaurant_name", "justification", "distance", "overall_rating", "price_range",
           "cuisines", "latitude", "longitude")


def parse_generated(responses: DataFrame) -> DataFrame:
    """``(qid, body)`` responses as ``(qid, pos, name, justification)``; anything unreadable yields no row.

    A list in which one distance is not a number, or one name or justification an object or a list,
    is unreadable as a whole.
    """
    found = F.get_json_object("body", "$.candidates[0].content.parts[0].text")
    item = schemas.GENERATED_ITEMS.elementType
    loose = f"array<struct<{','.join(f'{f.name}:string' for f in item.fields)}>>"
    listed = responses.select("qid", found.alias("answer")).where(F.col("answer").rlike(r"^\s*\["))
    parsed = listed.select("qid", "answer", F.from_json("answer", loose).alias("items"))
    broken = F.exists("items", lambda i: i["distance"].isNotNull() & i["distance"].try_cast("double").isNull())
    # As text an object and a quoted object look alike, so the types are read from the answer itself.
    kinds = F.transform(F.try_variant_get(F.try_parse_json("answer"), "$", "array<variant>"), lambda v: F.array(
        *(F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant")) for field in ("name", "justification"))))
    nested = F.exists(F.flatten(kinds), lambda k: k.startswith("OBJECT") | k.startswith("ARRAY"))
    return parsed.where(~broken & ~F.coalesce(nested, F.lit(False))).select("qid", F.posexplode("items").alias("pos", "item")).select(
        "qid", "pos", F.col("item.name").alias("name"), F.col("item.justification").alias("justification"))


def _first(df: DataFrame, keys: list, order: str) -> DataFrame:
    first = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def ground(generated: DataFrame, candidates: DataFrame) -> DataFrame:
    """Generated items whose name is that of a candidate, ignoring case.

    The first item of a name counts even if it matches nothing, and so does the first candidate
    of a name. Both windows and the join share one partitioning by request and name.
    """
    named = generated.where(F.col("name").isNotNull()).select(
        "qid", "pos", F.lower("name").alias("key"), F.col("justification").alias("generated_text"))
    known = candidates.withColumn("key", F.lower("name"))
    items = _first(named, ["qid", "key"], "pos")
    return items.join(_first(known, ["qid", "key"], "rank"), ["qid", "key"]).select(
        "qid", F.col("pos").cast("long").alias("pos"), "id", F.col("name").alias("restaurant_name"),
        F.col("generated_text").alias("justification"),
        F.coalesce("dist_km", F.lit(0.0)).alias("distance"), "overall_rating", "price_range", "cuisines",
        "latitude", "longitude")


def template_rows(candidates: DataFrame) -> DataFrame:
    """One rendered justification per candidate, in rank order."""
    return candidates.select(
        "qid", F.col("rank").cast("long").alias("pos"), "id", F.col("name").alias("restaurant_name"),
        text.template_text(F.col("dist_km")).alias("justification"),
        F.coalesce("dist_km", F.lit(0.0)).alias("distance"), "overall_rating", "price_range", "cuisines",
        "latitude", "longitude")


def recommendations(candidates: DataFrame, generated: DataFrame | None = None) -> DataFrame:
    """Final answers: the grounded generated rows of a request, or its template rows if there are none."""
    rows = template_rows(candidates).withColumn("generated", F.lit(False))
    if generated is not None:
        rows = rows.unionByName(ground(generated, candidates).withColumn("generated", F.lit(True)))
    request = Window.partitionBy("qid")
    rows = rows.withColumn("any_generated", F.max("generated").over(request))
    rows = rows.where(F.col("generated") == F.col("any_generated"))
    position = F.row_number().over(request.orderBy("pos"))
    return rows.select("qid", position.alias("position"), *_FIELDS, "generated")


def generate_responses(prompts: DataFrame, generator: Callable[[str], str | None]) -> DataFrame:
    """``(qid, body)`` from a text generator; a prompt that fails has a NULL body and gets template rows."""
    def respond(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def body(prompt: str) -> str | None:
            try:
                return generator(prompt)
            except Exception:
                return None

        for frame in frames:
            yield pd.DataFrame({"qid": frame["qid"], "body": [body(p) for p in frame["prompt"]]})

    qid_type = prompts.schema["qid"].dataType.simpleString()
    return prompts.select("qid", "prompt").mapInPandas(respond, f"qid {qid_type}, body string")


def answer_prompts(prompts: DataFrame, generator: Callable[[str], str | None], ledger: str, version: str) -> DataFrame:
    """``(qid, body)`` by a ledger of responses: a prompt is generated once per generator ``version``.

    Responses are kept under the digest of their prompt. Only prompts without one are generated, each
    distinct prompt once, and appended; failed ones are not, so that a later run tries them again.
    """
    spark = prompts.sparkSession
    path = f"{ledger}/version={quote(version, safe='')}"
    asked = prompts.select("qid", F.sha2("prompt", 256).alias("digest"), "prompt")
    schema = "digest string, body string"
    try:
        known = spark.read.schema(schema).parquet(path)
    except AnalysisException:
        known = spark.createDataFrame([], schema)  # nothing was ever generated
    texts = asked.groupBy("digest").agg(F.min("prompt").alias("prompt")).join(known.select("digest"), "digest", "left_anti")
    made = generate_responses(texts.withColumnRenamed("digest", "qid"), generator).withColumnRenamed("qid", "digest")
    made.where(F.col("body").isNotNull()).write.mode("append").parquet(path)
    # Two runs at once may have answered one prompt; one of the answers counts.
    stored = spark.read.schema(schema).parquet(path).groupBy("digest").agg(F.min("body").alias("body"))
    return asked.join(stored, "digest", "left").select("qid", "body")


def build_prompts(requests: DataFrame, candidates: DataFrame, max_results: int = V.RESULT_LIMIT, cut: bool = True) -> DataFrame:
    """One prompt per request that has candidates; at most ``k`` lines meet in a group.

    Lines are rendered where their request's lines meet, not in the tasks of whatever made the candidates.
    Without ``cut`` the descriptions are at prompt size already.
    """
    line = text.candidate_line(F.col("dist_km"), cut)
    lines = candidates.repartition("qid").select("qid", F.struct("rank", line.alias("line")).alias("entry"))
    blocks = lines.groupBy("qid").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    block = F.array_join(F.col("entries.line"), "\n")
    wanted = requests.select("qid", "preferred_cuisine", "minimum_rating", "preferred_price_range")
    return wanted.join(blocks, "qid").select(
        "qid", text.fill_prompt(F.lit(max_results), block).alias("prompt"), F.lit(V.PROMPT_VERSION).alias("prompt_version"))
