"""Table schemas. Nothing is inferred from data."""

from pyspark.sql import types as T

_TEXTS = T.ArrayType(T.StringType())

#: Flat catalog record as it arrives in JSON (camelCase names are part of the format).
CATALOG_JSON = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("cuisines", _TEXTS),
    T.StructField("priceRange", T.IntegerType()),
    T.StructField("overallRating", T.DoubleType()),
    T.StructField("numberOfRatings", T.IntegerType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("neighborhood", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("phone", T.StringType()),
    T.StructField("websiteUrl", T.StringType()),
    T.StructField("features", _TEXTS),
])

_ADDRESS = T.StructType([
    T.StructField("city", T.StringType()),
    T.StructField("state", T.StringType()),
])

#: Nested merchant export.
RAW_MERCHANT = T.StructType([
    T.StructField("_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("cuisines", _TEXTS),
    T.StructField("priceRange", T.IntegerType()),
    T.StructField("rating", T.StructType([
        T.StructField("overallRating", T.DoubleType()),
        T.StructField("numberOfRatings", T.IntegerType()),
    ])),
    T.StructField("geoLocation", T.StructType([
        T.StructField("coordinates", T.ArrayType(T.DoubleType())),
    ])),
    T.StructField("location", T.StructType([
        T.StructField("neighborhood", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("address", _ADDRESS),
    ])),
    T.StructField("phone", T.StringType()),
    T.StructField("websiteUrl", T.StringType()),
    T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("types", _TEXTS),
    ]))),
])

#: Catalog table.
PLACES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("description", T.StringType()),
    T.StructField("cuisines", T.ArrayType(T.StringType(), False), False),
    T.StructField("features", T.ArrayType(T.StringType(), False), False),
    T.StructField("price_range", T.IntegerType()),
    T.StructField("overall_rating", T.DoubleType()),
    T.StructField("number_of_ratings", T.IntegerType()),
    T.StructField("latitude", T.DoubleType(), False),
    T.StructField("longitude", T.DoubleType(), False),
    T.StructField("neighborhood", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("phone", T.StringType()),
    T.StructField("website_url", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType(), False)),
])

#: Diner requests; ``qid`` is unique per request.
REQUESTS = T.StructType([
    T.StructField("qid", T.LongType(), False),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("preferred_cuisine", T.StringType()),
    T.StructField("max_distance_km", T.DoubleType()),
    T.StructField("prioritize_rating", T.BooleanType()),
    T.StructField("preferred_price_range", T.IntegerType()),
    T.StructField("minimum_rating", T.IntegerType()),
    T.StructField("query_vector", T.ArrayType(T.FloatType(), False)),
])

#: Interaction log.
HISTORY = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("user_id", T.StringType(), False),
    T.StructField("restaurant_id", T.LongType(), False),
    T.StructField("interaction_type", T.StringType(), False),
    T.StructField("rating_given", T.DoubleType()),
    T.StructField("interaction_time", T.TimestampType()),
])

#: Generator output: an array of these in the response text.
GENERATED_ITEMS = T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("justification", T.StringType()),
    T.StructField("distance", T.DoubleType()),
]))
