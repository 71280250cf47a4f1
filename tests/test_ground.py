import json
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from tablescout.operators import ground
from tablescout.plans import recommend as jobs

from helpers import places_df, requests_df

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CANDIDATES = ("qid long, rank int, id long, name string, description string, cuisines array<string>, overall_rating double, "
              "price_range int, latitude double, longitude double, dist_km double")


def candidates(spark, *names, qid=1):
    return spark.createDataFrame(
        [(qid, i, i, name, "d", ["Italian"], 4.8, 2, 40.0, -73.0, 0.2 * i) for i, name in enumerate(names, 1)], CANDIDATES)


def generated(spark, *names, qid=1):
    return spark.createDataFrame([(qid, i, n, f"text {i}") for i, n in enumerate(names)],
                                 "qid long, pos int, name string, justification string")


def shown(recs):
    return [(r["position"], r["id"], r["justification"]) for r in recs.orderBy("qid", "position").collect()]


def test_invented_names_are_dropped(spark):
    recs = ground.recommendations(candidates(spark, "Tony's Di Napoli"),
                                  generated(spark, "TONY's di napoli", "Hallucinated Spot"))
    assert shown(recs) == [(1, 1, "text 0")]
    row = recs.first()
    assert (row["restaurant_name"], row["distance"], row["generated"]) == ("Tony's Di Napoli", 0.2, True)


def test_template_when_nothing_was_generated(spark):
    found = candidates(spark, "A", "B")
    for made in (None, generated(spark, "Nobody"), generated(spark)):
        recs = ground.recommendations(found, made)
        assert [j for _, _, j in shown(recs)] == [
            "A serves Italian, rated 4.8/5, about 0.2 km away.", "B serves Italian, rated 4.8/5, about 0.4 km away."]


def test_one_generated_row_suppresses_the_template(spark):
    assert shown(ground.recommendations(candidates(spark, "A", "B", "C"), generated(spark, "c", None))) == [(1, 3, "text 0")]


def test_repeated_names(spark):
    recs = ground.recommendations(candidates(spark, "Twin", "twin", "B"), generated(spark, "TWIN", "b", "Twin", "B"))
    assert shown(recs) == [(1, 1, "text 0"), (2, 3, "text 1")]


def test_no_candidates_no_answer(spark):
    recs = ground.recommendations(candidates(spark), generated(spark, "A"))
    assert recs.isEmpty()


def body(text):
    return json.dumps({"candidates": [{"content": {"parts": [{"text": text}]}}]})


def test_parse_generated(spark):
    items = json.dumps([{"name": "A", "justification": "x", "distance": 1.5, "more": 1}, {"justification": "y"}])
    rows = [
        (1, body(items)), (2, body("not json")), (3, '{"candidates":[]}'), (4, None), (5, body("")), (6, "oops"),
        (7, body('{"name":"A"}')), (8, body('[{"name":"A","justification":"x","distance":"near"}]')),
        (9, body('[{"name":"A","justification":"x","distance":"2.5"}]')), (10, body(' [{"name":"B"}]')),
        (11, body('[{"name":1,"justification":{"a":1}}]')), (12, body('[{"name":["A"],"justification":"x"}]')),
        (13, body('[{"name":1,"justification":"{\\"a\\":1}"}]')),
    ]
    found = ground.parse_generated(spark.createDataFrame(rows, "qid long, body string"))
    assert sorted(map(tuple, found.collect()), key=str) == sorted([
        (1, 0, "A", "x"), (1, 1, None, "y"), (9, 0, "A", "x"), (10, 0, "B", None), (13, 0, "1", '{"a":1}')], key=str)


def test_prompt(spark):
    asked = spark.createDataFrame([(1, "pasta", 4, 2), (2, None, 0, 0)],
                                  "qid long, preferred_cuisine string, minimum_rating int, preferred_price_range int")
    rows = ground.build_prompts(asked, candidates(spark, *(f"P{i}" for i in range(12)))).collect()
    assert [r["qid"] for r in rows] == [1]  # no candidates, no prompt
    lines = [line for line in rows[0]["prompt"].split("\n") if line.startswith("- P") and "cuisines" in line]
    assert [line.split(" | ")[0] for line in lines] == [f"- P{i}" for i in range(12)]
    assert rows[0]["prompt_version"] == "recommendation.v1"


def test_whole_job_with_responses(spark, tmp_path):
    spot = {"latitude": 40.7580, "longitude": -73.9855}
    places = places_df(spark, [{"id": 1, "name": "Zen"} | spot, {"id": 2, "name": "Tony"} | spot])
    asked = requests_df(spark, [{"qid": q} | spot for q in (1, 2)] + [{"qid": 3, "max_distance_km": 900.0} | spot])
    responses = spark.createDataFrame([(1, body('[{"name":"tony","justification":"Best."}]'))], "qid long, body string")
    recs = jobs.recommend(asked, places, responses)
    jobs.write_recommendations(recs, str(tmp_path / "recs"))
    stored = spark.read.parquet(str(tmp_path / "recs")).orderBy("qid", "position").collect()
    assert [(r["qid"], r["id"], r["justification"]) for r in stored] == [
        (1, 2, "Best."), (2, 1, "Zen, about 0.0 km away."), (2, 2, "Tony, about 0.0 km away.")]


def test_generator_failures_leave_no_body(spark):
    prompts = spark.createDataFrame([(1, "good"), (2, "bad")], "qid long, prompt string")

    def generator(prompt):
        if prompt == "bad":
            raise RuntimeError("quota")
        return body('[{"name":"A","justification":"ok"}]')

    responses = ground.generate_responses(prompts, generator)
    assert {r["qid"]: r["body"] is None for r in responses.collect()} == {1: False, 2: True}
    assert ground.recommendations(candidates(spark, "A"), ground.parse_generated(responses)).first()["justification"] == "ok"


def test_candidates_are_ranked_by_struct_order(spark):
    shuffled = candidates(spark, *"ABCDEFGHIJK").orderBy(F.desc("rank"))
    asked = spark.createDataFrame([(1, "x", 0, 0)], "qid long, preferred_cuisine string, minimum_rating int, preferred_price_range int")
    prompt = ground.build_prompts(asked, shuffled).first()["prompt"]
    assert prompt.index("- B |") < prompt.index("- J |") < prompt.index("- K |")
