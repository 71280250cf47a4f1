import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescout.functions import geo, text, vectors
from tablescout.sources import catalog

from helpers import places_df


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("formula", [geo.acos_km, geo.haversine_km])
def test_distances(spark, formula):
    row = one(
        spark,
        formula(F.lit(40.7580), F.lit(-73.9855), F.lit(40.7580), F.lit(-73.9855)).alias("same"),
        formula(F.lit(40.7580), F.lit(-73.9855), F.lit(34.0522), F.lit(-118.2437)).alias("far"),
        formula(F.lit(40.7580), F.lit(-73.9855), F.lit(40.7680), F.lit(-73.9855)).alias("north"),
    )
    assert row["same"] == pytest.approx(0.0, abs=1e-6 if formula is geo.haversine_km else 1e-3)
    assert 3900 < row["far"] < 3980
    assert 1.0 < row["north"] < 1.2


def test_distance_argument_is_clamped(spark):
    grid = spark.range(100000).select((F.col("id") / 1111.0).alias("lat"), (F.col("id") / 777.0).alias("lon"))
    broken = grid.where(F.isnan(geo.acos_km(F.col("lat"), F.col("lon"), F.col("lat"), F.col("lon"))))
    assert broken.isEmpty()


def test_box_floor_near_the_pole(spark):
    bounds = geo.box_bounds(F.lit(89.9), F.lit(0.0), F.lit(111.0))
    row = one(spark, *(c.alias(n) for n, c in bounds.items()))
    assert row["lat_max"] == pytest.approx(90.9)
    assert row["lon_max"] == pytest.approx(100.0)


def test_vector_literal_and_back(spark):
    row = one(spark, F.array(*(F.lit(x).cast("float") for x in (0.1, -0.2, 0.3))).alias("v"))
    df = spark.createDataFrame([(row["v"],)], "v array<float>")
    literal = vectors.vector_literal(F.col("v"))
    result = df.select(literal.alias("text"), (vectors.parse_vector(literal, 3) == F.col("v")).alias("same"),
                       vectors.parse_vector(literal, 4).alias("wrong_size")).first()
    assert result["text"] == "[0.1,-0.2,0.3]"
    assert result["same"] is True
    assert result["wrong_size"] is None
    tiny = spark.createDataFrame([([1e-5, 100000000.0],)], "v array<float>").select(vectors.vector_literal(F.col("v"))).first()
    assert tiny[0] == "[1.0E-5,1.0E8]"
    assert one(spark, vectors.parse_vector(F.lit("[1,null]"), 2))[0] is None
    assert one(spark, vectors.parse_vector(F.lit("oops"), 2))[0] is None


def test_cosine_distance_of_zero_vector_is_null(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 0.0], [2.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(vectors.cosine_distance(F.col("a"), F.col("b"))).collect()] == [None, 0.0]


def test_place_document(spark):
    rows = [
        {"id": 1, "name": "Sushi Zen", "cuisines": ["Sushi", "Japanese"], "city": "New York", "state": "NY",
         "features": ["Outdoor Dining"], "description": "Fresh omakase.", "latitude": 0.0, "longitude": 0.0},
        {"id": 2, "name": "Bare", "state": "NY", "description": " \t", "latitude": 0.0, "longitude": 0.0},
        {"id": 3, "name": "City", "city": "Rome", "latitude": 0.0, "longitude": 0.0},
    ]
    texts = places_df(spark, rows).orderBy("id").select(text.place_document()).collect()
    assert [t[0] for t in texts] == [
        "Sushi Zen - Sushi, Japanese in New York, NY. Features: Outdoor Dining. Fresh omakase.", "Bare.", "City in Rome."]


def test_query_text(spark):
    df = spark.createDataFrame(
        [("cozy Italian", 2, 4), (None, 0, 0), (" \t ", 0, 3)],
        "preferred_cuisine string, preferred_price_range int, minimum_rating int")
    assert [r[0] for r in df.select(text.query_text()).collect()] == [
        "Looking for a cozy Italian restaurant around price level 2 with a rating of at least 4.",
        "Looking for a great restaurant.",
        "Looking for a great restaurant with a rating of at least 3.",
    ]


def test_template_text(spark):
    df = spark.createDataFrame(
        [("Tony's", ["Italian", "Pizza"], 4.8, 0.2), ("No Rating Cafe", ["Cafe"], None, 0.5), ("Zero", [], 0.0, None),
         ("Half", [], 4.85, 0.25), ("Half", [], 0.35, 0.05)],
        "name string, cuisines array<string>, overall_rating double, dist_km double")
    assert [r[0] for r in df.select(text.template_text(F.col("dist_km"))).collect()] == [
        "Tony's serves Italian, Pizza, rated 4.8/5, about 0.2 km away.",
        "No Rating Cafe serves Cafe, about 0.5 km away.",
        "Zero.",
        "Half, rated 4.9/5, about 0.3 km away.",
        "Half, rated 0.4/5, about 0.1 km away.",
    ]


@pytest.mark.parametrize("given, shown", [
    (None, ""),
    ("  a \n\t b  ", "a b"),
    ("x" * 240, "x" * 240),
    ("x" * 241, "x" * 240 + "…"),
    ("\U0001F600" * 120, "\U0001F600" * 120),
    ("\U0001F600" * 121, "\U0001F600" * 120 + "…"),
    ("x" + "\U0001F600" * 120, "x" + "\U0001F600" * 119 + "…"),
])
def test_short_description(spark, given, shown):
    df = spark.createDataFrame([(given,)], "t string")
    assert df.select(text.short_description(F.col("t"))).first()[0] == shown


def test_candidate_line(spark):
    df = spark.createDataFrame([("A", ["X", "Y"], None, None, None, None), ("B", [], 4.25, 3, "good  food", 1.005)],
                               "name string, cuisines array<string>, overall_rating double, price_range int, "
                               "description string, dist_km double")
    assert [r[0] for r in df.select(text.candidate_line(F.col("dist_km"))).collect()] == [
        "- A | cuisines: [X, Y] | rating: 0.0 | price: 0 | 0.00 km\n  ",
        "- B | cuisines: [] | rating: 4.3 | price: 3 | 1.01 km\n  good food",
    ]


def test_prompt_expands_placeholders_typed_by_the_diner(spark):
    df = spark.createDataFrame([("soup {{candidates}} {{maxResults}}", 4, 2), ("  ", 0, 0)],
                               "preferred_cuisine string, minimum_rating int, preferred_price_range int")
    first, second = [r[0] for r in df.select(text.fill_prompt(F.lit(10), F.lit("LINES"))).collect()]
    assert "soup LINES {{maxResults}}" in first  # the earlier step is not repeated
    assert first.endswith("Candidate restaurants:\nLINES\n")
    assert "Recommend at most 10, ordered best first." in first
    assert "- Minimum acceptable rating: 4" in first
    assert "vibe: any" in second


def test_blank_and_strip(spark):
    df = spark.createDataFrame([("",), ("  \t",), (" ",), (" x　",), (None,)], "t string")
    rows = df.select(text.not_blank(F.col("t")).alias("a"), text.strip(F.col("t")).alias("b")).collect()
    assert [r["a"] for r in rows] == [False, False, True, True, False]  # a no-break space is no white space here
    assert [r["b"] for r in rows] == ["", "", "", "x", None]


def test_hashing_embedder():
    embed = vectors.HashingEmbedder(32)
    a, b, empty = embed(["Fresh sushi", "fresh SUSHI!", ""])
    assert np.array_equal(a, b)
    assert np.linalg.norm(a) == pytest.approx(1.0, abs=1e-6)
    assert not empty.any()


def test_personas(spark):
    rows = catalog.personas(spark).orderBy("qid").collect()
    assert len(rows) == 8
    assert rows[0]["name"] == "Italian Romantic Dinner" and rows[0]["minimum_rating"] == 4
    assert rows[3]["expected_cuisines"] == [] and rows[3]["max_distance_km"] == 2.0
