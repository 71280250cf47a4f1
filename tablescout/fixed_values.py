"""Values fixed by the data formats and answer definitions; results depend on them literally."""

# Geometry.
EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.0
MIN_COS_LATITUDE = 0.01

# Retrieval.
RESULT_LIMIT = 10
OVERFETCH = 3
SEMANTIC_WEIGHT = 0.75
PROXIMITY_WEIGHT = 0.25

# Embeddings.
EMBEDDING_DIMENSIONS = 768
EMBEDDING_BATCH_SIZE = 50
EMBEDDING_ATTEMPTS = 4
EMBEDDING_BACKOFF_SECONDS = 20.0

# Sampling.
SAMPLE_SIZE = 1500
SAMPLE_SEED = 42
SAMPLE_TOP_FLOOR = 400
FEATURE_CAP = 25
FEATURE_PLACEHOLDER = "not applicable"

# Request limits and rejection texts.
MAX_DISTANCE_KM = 500
MAX_PRICE = 4
MAX_RATING = 5
TEXT_POSITIVE = "must be greater than 0"
TEXT_AT_MOST = "must be less than or equal to {}"
TEXT_AT_LEAST = "must be greater than or equal to {}"
TEXT_MISSING = "Missing required parameter: {}"
TEXT_WRONG_TYPE = "Invalid value for parameter: {}"
TEXT_REJECTED = "Validation failed"

# Interaction log.
VISITED = "VISITED"
RATED = "RATED"

# Prompt.
PROMPT_VERSION = "recommendation.v1"
PROMPT_DESCRIPTION_CHARS = 240
PROMPT_TEMPLATE = """\
You are an expert local food critic helping a diner choose where to eat.

Recommend the best options for this diner using ONLY the candidate restaurants
listed below. Do not invent restaurants and do not include any that are not listed.
Recommend at most {{maxResults}}, ordered best first.

For each recommendation write a vivid, honest justification of one or two sentences
that begins with the restaurant's name and naturally weaves in its cuisine, its
rating, and how far away it is. Use the exact restaurant names and distances given.

Diner preferences:
- Preferred cuisine or vibe: {{preferredCuisine}}
- Minimum acceptable rating: {{minimumRating}}
- Preferred price level (0=unknown, 1=$ … 4=$$$$): {{preferredPriceRange}}

Candidate restaurants:
{{candidates}}
"""

# Evaluation tolerances, words and gates (metric, target label, threshold).
EVAL_TOLERANCE = 0.05
GROUNDING_WORDS = ("rating", "km", "cuisine")
GROUNDING_MIN_CHARS = 15
RATIONALE_CHARS = 120
GATES = (
    ("success_rate_pct", "100%", 100.0),
    ("distance_adherence_pct", "100%", 99.0),
    ("rating_adherence_pct", "100%", 99.0),
    ("rationale_groundedness_pct", "> 95%", 95.0),
    ("semantic_relevance_pct", "> 75%", 70.0),
    ("latency_p50_ms", "< 1500 ms", 1500.0),
    ("latency_p90_ms", "< 3000 ms", 3000.0),
)

# Benchmark personas
# (name, latitude, longitude, taste, max km, prioritise rating, price, rating, expected, min results).
PERSONAS = (
    ("Italian Romantic Dinner", 40.7580, -73.9855, "romantic cozy Italian pasta and wine",
     10.0, True, 2, 4, ["italian", "pasta", "pizza", "wine", "mediterranean"], 1),
    ("Authentic Japanese Sushi", 40.7580, -73.9855, "authentic Japanese sushi sashimi omakase",
     15.0, True, 3, 3, ["japanese", "sushi", "asian", "seafood"], 1),
    ("Casual Mexican Tacos", 40.7580, -73.9855, "street tacos and guacamole with spicy salsa",
     8.0, False, 1, 0, ["mexican", "tacos", "latin", "burritos"], 1),
    ("Strict Tight Distance Radius", 40.7580, -73.9855, "cafe bakery coffee sandwich",
     2.0, False, 0, 0, [], 0),
    ("High Rating Quality Gate", 40.7580, -73.9855, "fine dining dinner steakhouse seafood",
     25.0, True, 0, 4, ["steak", "seafood", "fine dining", "american"], 1),
    ("Budget Friendly Fast Casual", 40.7580, -73.9855, "cheap quick bite burger fries sandwich",
     12.0, False, 1, 0, ["burger", "american", "fast food", "sandwiches", "diner"], 1),
    ("Asian Noodles & Dumplings", 40.7580, -73.9855, "hand-pulled noodles ramen dumplings dim sum",
     15.0, True, 2, 3, ["chinese", "ramen", "asian", "noodles", "japanese"], 1),
    ("Late Night Dessert & Drinks", 40.7580, -73.9855, "cocktail bar dessert pastries sweets",
     10.0, True, 2, 0, ["bar", "dessert", "bakery", "cocktails", "cafe"], 1),
)
