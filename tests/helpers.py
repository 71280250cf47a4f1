"""Small tables and a plain reading of the retrieval rules to compare against."""

import math

from pyspark.sql import types as T

from tablescout import schemas

EMPTY_PLACE = {f.name: None for f in schemas.PLACES.fields} | {"cuisines": [], "features": []}


def places_df(spark, rows):
    full = [EMPTY_PLACE | {"name": f"place {r['id']}"} | r for r in rows]
    return spark.createDataFrame([tuple(r[f.name] for f in schemas.PLACES.fields) for r in full], schemas.PLACES)


def requests_df(spark, rows):
    base = {f.name: None for f in schemas.REQUESTS.fields} | {
        "prioritize_rating": False, "preferred_price_range": 0, "minimum_rating": 0, "max_distance_km": 5.0}
    full = [base | r for r in rows]
    return spark.createDataFrame([tuple(r[f.name] for f in schemas.REQUESTS.fields) for r in full], schemas.REQUESTS)


def km(lat1, lon1, lat2, lon2):
    a, b = math.radians(lat1), math.radians(lat2)
    cosine = math.cos(a) * math.cos(b) * math.cos(math.radians(lon2) - math.radians(lon1)) + math.sin(a) * math.sin(b)
    return 6371 * math.acos(min(1.0, max(-1.0, cosine)))


def cosine_distance(a, b):
    dot = sum(x * y for x, y in zip(a, b))
    return 1 - dot / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


def expected_answer(request, places, k=10, overfetch=3):
    """Ranked ``(id, semantic)`` of one request, place by place."""
    r = {"preferred_price_range": 0, "minimum_rating": 0, "max_distance_km": 5.0, "query_vector": None} | request
    far, lat, lon = r["max_distance_km"], r["latitude"], r["longitude"]
    d_lat = far / 111.0
    d_lon = far / (111.0 * max(0.01, math.cos(math.radians(lat))))
    found = []
    for place in places:
        p = {"overall_rating": None, "price_range": None, "embedding": None} | place
        if not (lat - d_lat <= p["latitude"] <= lat + d_lat and lon - d_lon <= p["longitude"] <= lon + d_lon):
            continue
        if r["minimum_rating"] > 0 and (p["overall_rating"] is None or p["overall_rating"] < r["minimum_rating"]):
            continue
        if r["preferred_price_range"] > 0 and (p["price_range"] is None or p["price_range"] > r["preferred_price_range"]):
            continue
        found.append((p, km(lat, lon, p["latitude"], p["longitude"])))
    semantic = []
    if r["query_vector"] is not None and any(r["query_vector"]):
        semantic = [(round(cosine_distance(r["query_vector"], p["embedding"]), 12), p["id"], d)
                    for p, d in found if p["embedding"] is not None and any(p["embedding"])]
    if semantic:
        near = [h for h in sorted(semantic)[: k * overfetch] if h[2] <= far]
        near.sort(key=lambda h: (-(0.75 * (1 - h[0]) + 0.25 * (1 - h[2] / far)), h[1]))
        return [(h[1], True) for h in near[:k]]
    hits = sorted((d, p["id"]) for p, d in found)[: k * overfetch]
    return [(i, False) for d, i in hits if d <= far][:k]


def answers(ranked):
    """``{qid: [(id, semantic), ...]}`` of a retrieval result."""
    result = {}
    for row in sorted(ranked.collect(), key=lambda row: (row["qid"], row["rank"])):
        result.setdefault(row["qid"], []).append((row["id"], row["semantic"]))
    return result


def expected_answers(requests, places):
    found = {r["qid"]: expected_answer(r, places) for r in requests}
    return {qid: rows for qid, rows in found.items() if rows}


STRINGS = T.ArrayType(T.StringType())
