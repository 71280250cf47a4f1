"""The same questions in plain SQL for DuckDB, without cells, blocks or narrowing."""

from __future__ import annotations

from tablescout import fixed_values as V
from tablescout.sources.fixtures import duckdb_text

_KM = """6371 * acos(least(1.0::double, greatest(-1.0::double,
    cos(radians({a})) * cos(radians({c})) * cos(radians({d}) - radians({b})) + sin(radians({a})) * sin(radians({c})))))"""


def _km(a: str, b: str, c: str, d: str) -> str:
    return _KM.format(a=a, b=b, c=c, d=d)


def _text(literal: str) -> str:
    return "'" + literal.replace("'", "''") + "'"


def _one_digit(value: str) -> str:
    return f"printf('%.1f', round({value}, 1))"


_TEMPLATE = f"""concat(name, case when len(cuisines) > 0 then concat(' serves ', array_to_string(cuisines, ', ')) else '' end,
    case when overall_rating > 0 then concat(', rated ', {_one_digit('overall_rating')}, '/5') else '' end,
    case when dist_km is not null then concat(', about ', {_one_digit('dist_km')}, ' km away') else '' end, '.')"""

_FLAT = "trim(regexp_replace(coalesce(description, ''), '\\s+', ' ', 'g'))"
_LINE = f"""concat('- ', name, ' | cuisines: [', array_to_string(cuisines, ', '), '] | rating: ',
    {_one_digit('coalesce(overall_rating, 0)')}, ' | price: ', cast(coalesce(price_range, 0) as varchar), ' | ',
    printf('%.2f', round(dist_km, 2)), ' km', chr(10), '  ',
    case when length({_FLAT}) <= 240 then {_FLAT} else concat(left({_FLAT}, 240), '…') end)"""

_PERSONA_ROWS = ", ".join(
    f"({i}, cast({lat} as double), cast({lon} as double), cast({far} as double), {price}, {rating})"
    for i, (_, lat, lon, _, far, _, price, rating, _, _) in enumerate(V.PERSONAS, 1))

_PARTS = {
    **{name: duckdb_text(name) for name in (
        "places", "requests", "history_events", "generated", "raw_merchants", "query_runs", "responses",
        "expectations", "reload", "flat_catalog", "raw_requests")},
    "accepted": """select * from requests where max_distance_km > 0 and max_distance_km <= 500
  and preferred_price_range between 0 and 4 and minimum_rating between 0 and 5""",
    "personas": f"""select qid, latitude, longitude, max_distance_km, preferred_price_range, minimum_rating,
  cast(null as float[]) as query_vector from (values {_PERSONA_ROWS})
  t(qid, latitude, longitude, max_distance_km, preferred_price_range, minimum_rating)""",
    "pairs": f"""select q.qid, q.max_distance_km as max_km, p.id, q.query_vector, p.embedding,
  {_km('q.latitude', 'q.longitude', 'p.latitude', 'p.longitude')} as dist_km
from {{asked}} q join places p
  on p.latitude between q.latitude - q.max_distance_km / 111.0::double and q.latitude + q.max_distance_km / 111.0::double
 and p.longitude between q.longitude - q.max_distance_km / (111.0::double * greatest(0.01::double, cos(radians(q.latitude))))
                     and q.longitude + q.max_distance_km / (111.0::double * greatest(0.01::double, cos(radians(q.latitude))))
 and (q.minimum_rating <= 0 or p.overall_rating >= q.minimum_rating)
 and (q.preferred_price_range <= 0 or p.price_range <= q.preferred_price_range)""",
    "vector_hits": """select * from (select *, row_number() over (partition by qid order by cos_dist, id) as rn from (
  select qid, max_km, id, dist_km,
         round(1 - list_cosine_similarity(cast(query_vector as double[]), cast(embedding as double[])), 12) as cos_dist
  from pairs where query_vector is not null and embedding is not null)) where rn <= 30""",
    "all_distance_hits": """select * from (select qid, max_km, id, dist_km,
  row_number() over (partition by qid order by dist_km, id) as rn from pairs) where rn <= 30""",
    "hits": """select qid, max_km, id, dist_km, cos_dist, true as semantic from vector_hits
union all
select qid, max_km, id, dist_km, null, false from all_distance_hits where qid not in (select qid from vector_hits)""",
    "ranked": """select * from (
  select *, row_number() over (partition by qid order by case when semantic then -score else dist_km end, id) as rank
  from (select *, case when semantic then 0.75::double * (1.0::double - cos_dist)
                       + 0.25::double * (1.0::double - dist_km / max_km) end as score
        from hits where dist_km <= max_km)) where rank <= 10""",
    "candidates": "select r.qid, r.rank, r.dist_km, p.* from ranked r join places p on p.id = r.id",
    "grounded": """select g.qid, g.pos, c.id, c.name as restaurant_name, g.justification,
  coalesce(c.dist_km, 0) as distance, c.overall_rating, c.price_range, c.cuisines, c.latitude, c.longitude
from (select * from generated where name is not null
      qualify row_number() over (partition by qid, lower(name) order by pos) = 1) g
join (select * from candidates qualify row_number() over (partition by qid, lower(name) order by rank) = 1) c
  on c.qid = g.qid and lower(c.name) = lower(g.name)""",
    "recs": f"""select qid, cast(row_number() over (partition by qid order by pos) as int) as position, * exclude (qid, pos) from (
  select *, true as generated from grounded
  union all
  select qid, rank, id, name, {_TEMPLATE}, coalesce(dist_km, 0), overall_rating, price_range, cuisines,
         latitude, longitude, false from candidates where qid not in (select qid from grounded))""",
    "scores": """select q.qid, count(r.position) as total_recommendations,
  count(*) filter (r.distance > q.max_distance_km + 0.05::double) as distance_violations,
  count(*) filter (r.position is not null and q.minimum_rating > 0
                   and coalesce(r.overall_rating, 0) < q.minimum_rating - 0.05::double) as rating_violations,
  count(*) filter (q.preferred_price_range > 0 and r.price_range = q.preferred_price_range) as price_matches,
  count(*) filter (r.position is not null and trim(r.justification) <> '' and (
      len(list_filter(r.cuisines, lambda c: contains(lower(r.justification), lower(c)))) > 0
      or contains(lower(r.justification), lower(r.restaurant_name)) or contains(lower(r.justification), 'rating')
      or contains(lower(r.justification), 'km') or contains(lower(r.justification), 'cuisine')
      or length(r.justification) > 15)) as grounded_rationales,
  count(*) filter (r.position is not null and len(list_filter(e.expected_cuisines, lambda t: contains(
      lower(concat(r.restaurant_name, ' ', array_to_string(r.cuisines, ' '), ' ', r.justification)), lower(t)))) > 0)
      as semantic_matches
from accepted q join expectations e on e.qid = q.qid left join recs r on r.qid = q.qid group by q.qid""",
    "latencies": """select latency_ms, row_number() over (order by latency_ms) as i, count(*) over () as n
from query_runs where status = 200""",
    "totals": """select count(*) as total_queries, count(*) filter (status = 200) as successful_queries,
  coalesce(avg(latency_ms) filter (status = 200), 0) as latency_mean_ms,
  cast(coalesce(sum(total_recommendations) filter (status = 200), 0) as bigint) as total,
  coalesce(sum(distance_violations) filter (status = 200), 0) as dv,
  coalesce(sum(rating_violations) filter (status = 200), 0) as rv,
  coalesce(sum(grounded_rationales) filter (status = 200), 0) as gr,
  coalesce(sum(semantic_matches) filter (status = 200), 0) as sm
from query_runs r left join scores s on s.qid = r.qid""",
    "metrics": """select total_queries, successful_queries,
  case when total_queries > 0 then successful_queries / total_queries * 100 else 0.0 end as success_rate_pct,
  total as total_recommendations, latency_mean_ms,
  (select coalesce(avg(latency_ms), 0) from latencies where i in ((n - 1) // 2 + 1, n // 2 + 1)) as latency_p50_ms,
  (select coalesce(max(latency_ms), 0) from latencies where i = cast(floor(n * 0.9::double) as bigint) + 1) as latency_p90_ms,
  (select coalesce(max(latency_ms), 0) from latencies where i = cast(floor(n * 0.99::double) as bigint) + 1) as latency_p99_ms,
  case when total > 0 then (total - dv) / total * 100 else 100.0 end as distance_adherence_pct,
  case when total > 0 then (total - rv) / total * 100 else 100.0 end as rating_adherence_pct,
  case when total > 0 then gr / total * 100 else 100.0 end as rationale_groundedness_pct,
  case when total > 0 then sm / total * 100 else 0.0 end as semantic_relevance_pct
from totals""",
    "metros": "select city, state, count(*) as n, min(id) as first_pos from places group by city, state",
    "densest": "select * from metros order by n desc, first_pos limit 1",
    "features": """select raw_pos, list_transform(
  json_extract_string(js, '$.features[*].types[*]'), lambda t: trim(t)) as items from raw_merchants""",
    "kept_features": """select raw_pos, list_filter(items, lambda t: t <> '' and lower(t) <> 'not applicable') as items
from features""",
    "flat_features": """select raw_pos, array_to_string(list_slice(list_filter(items,
  lambda t, i: list_position(items, t) = i), 1, 25), '|') as features from kept_features""",
    "addresses": """select raw_pos,
  coalesce(nullif(json_extract_string(js, '$.location.address.city'), ''), json_extract_string(js, '$.location.city')) as city,
  coalesce(nullif(json_extract_string(js, '$.location.address.state'), ''), json_extract_string(js, '$.location.state')) as state
from raw_merchants""",
    "merchants": """select raw_pos, cast(json_extract_string(js, '$._id') as bigint) as id,
  trim(json_extract_string(js, '$.name')) as name, trim(json_extract_string(js, '$.description')) as description,
  cast(json_extract_string(js, '$.priceRange') as int) as "priceRange",
  json_array_length(js, '$.geoLocation.coordinates') as n,
  cast(json_extract_string(js, '$.geoLocation.coordinates[1]') as double) as latitude,
  cast(json_extract_string(js, '$.geoLocation.coordinates[0]') as double) as longitude
from raw_merchants""",
    "usable": "select * from merchants where n = 2 and name <> '' and description <> ''",
    "new_rows": "select * from reload qualify row_number() over (partition by id order by input_pos desc) = 1",
    "answers": """select qid, json_extract_string(body, '$.candidates[0].content.parts[0].text') as answer from responses""",
}

_NEEDS = {
    "accepted": ["requests"],
    "pairs": ["places"],
    "vector_hits": ["pairs"],
    "all_distance_hits": ["pairs"],
    "hits": ["vector_hits", "all_distance_hits"],
    "ranked": ["hits"],
    "candidates": ["ranked", "places"],
    "grounded": ["generated", "candidates"],
    "recs": ["grounded", "candidates"],
    "scores": ["accepted", "expectations", "recs"],
    "latencies": ["query_runs"],
    "totals": ["query_runs", "scores"],
    "metrics": ["totals", "latencies"],
    "metros": ["places"],
    "densest": ["metros"],
    "features": ["raw_merchants"],
    "kept_features": ["features"],
    "flat_features": ["kept_features"],
    "addresses": ["raw_merchants"],
    "merchants": ["raw_merchants"],
    "usable": ["merchants"],
    "new_rows": ["reload"],
    "answers": ["responses"],
}


def _query(body: str, *parts: str, asked: str = "accepted", own: dict[str, tuple[str, list[str]]] | None = None) -> str:
    """A query over named parts; ``own`` replaces parts, as text and the parts it needs."""
    own = own or {}
    ordered: list[str] = []

    def need(part: str) -> None:
        for other in [*(own[part][1] if part in own else _NEEDS.get(part, [])), *([asked] if part == "pairs" else [])]:
            need(other)
        if part not in ordered:
            ordered.append(part)

    for part in parts:
        need(part)
    def text(part: str) -> str:
        return (own[part][0] if part in own else _PARTS[part]).replace("{asked}", asked)

    return "with " + ",\n".join(f"{part} as (\n{text(part)})" for part in ordered) + "\n" + body


def _prompt() -> str:
    text = _text(V.PROMPT_TEMPLATE)
    taste = "case when regexp_matches(coalesce(preferred_cuisine, ''), '\\S') then preferred_cuisine else 'any' end"
    for placeholder, value in (
        ("maxResults", "'10'"), ("preferredCuisine", taste), ("minimumRating", "cast(minimum_rating as varchar)"),
        ("preferredPriceRange", "cast(preferred_price_range as varchar)"), ("candidates", "block"),
    ):
        text = f"replace({text}, '{{{{{placeholder}}}}}', {value})"
    return f"""select q.qid, {text} as prompt, '{V.PROMPT_VERSION}' as prompt_version from accepted q
join (select qid, string_agg({_LINE}, chr(10) order by rank) as block from candidates group by qid) c on c.qid = q.qid"""


def _messages() -> str:
    def number(name: str) -> str:
        return f"try_cast({name} as double)"

    def whole(name: str) -> str:
        return f"case when abs({number(name)}) < 2147483648 then trunc({number(name)}) end"

    def unreadable(column: str, name: str, value=number) -> str:
        return f"when {column} is not null and ({value(column)}) is null then 'Invalid value for parameter: {name}'"

    return f"""select qid, {number('latitude')} as latitude, {number('longitude')} as longitude,
  coalesce({number('max_distance_km')}, 0) as max_distance_km,
  cast(coalesce({whole('preferred_price_range')}, 0) as int) as preferred_price_range,
  cast(coalesce({whole('minimum_rating')}, 0) as int) as minimum_rating,
  coalesce(
    case when latitude is null then 'Missing required parameter: latitude' {unreadable('latitude', 'latitude')} end,
    case when longitude is null then 'Missing required parameter: longitude' {unreadable('longitude', 'longitude')} end,
    case {unreadable('max_distance_km', 'maxDistanceInKm')} end,
    case {unreadable('preferred_price_range', 'preferredPriceRange', whole)} end,
    case {unreadable('minimum_rating', 'minimumRating', whole)} end,
    nullif(concat_ws('; ',
      case when not coalesce({number('max_distance_km')}, 0) > 0 then 'maxDistanceInKm: must be greater than 0' end,
      case when {number('max_distance_km')} > 500 then 'maxDistanceInKm: must be less than or equal to 500' end,
      case when ({whole('preferred_price_range')}) < 0 then 'preferredPriceRange: must be greater than or equal to 0' end,
      case when ({whole('preferred_price_range')}) > 4 then 'preferredPriceRange: must be less than or equal to 4' end,
      case when ({whole('minimum_rating')}) < 0 then 'minimumRating: must be greater than or equal to 0' end,
      case when ({whole('minimum_rating')}) > 5 then 'minimumRating: must be less than or equal to 5' end), '')
  ) as message from raw_requests"""


def _gates() -> str:
    rows = []
    for metric, target, threshold in V.GATES:
        if metric == "success_rate_pct":
            test, otherwise = f"{metric} = {threshold}", "WARN"
        elif metric.startswith("latency"):
            test, otherwise = f"{metric} < {threshold}", "SLOW"
        else:
            test, otherwise = f"{metric} >= {threshold}", "FAIL" if "adherence" in metric else "WARN"
        rows.append(f"select '{metric}' as metric, '{target}' as target, round(cast({metric} as double), 6) as achieved, "
                    f"case when {test} then 'PASS' else '{otherwise}' end as status from metrics")
    return "\nunion all\n".join(rows)


_DOCUMENT = """concat(name,
  case when len(cuisines) > 0 then concat(' - ', array_to_string(cuisines, ', ')) else '' end,
  case when city is not null then concat(' in ', city, case when state is not null then concat(', ', state) else '' end) else '' end, '.',
  case when len(features) > 0 then concat(' Features: ', array_to_string(features, ', '), '.') else '' end,
  case when regexp_matches(description, '\\S') then concat(' ', description) else '' end)"""
_QUERY_TEXT = """concat('Looking for a ',
  case when regexp_matches(preferred_cuisine, '\\S') then preferred_cuisine else 'great' end, ' restaurant',
  case when preferred_price_range > 0 then concat(' around price level ', cast(preferred_price_range as varchar)) else '' end,
  case when minimum_rating > 0 then concat(' with a rating of at least ', cast(minimum_rating as varchar)) else '' end,
  '.')"""


def _embedded(table: str, key: str, document: str, vector: str, only: str = "true") -> str:
    """Rows of a part with ``vector`` computed from a text: 64 dimensions, a word's MD5 gives dimension and sign."""
    return f"""select t.* exclude ({vector}), coalesce(e.vector, t.{vector}) as {vector} from {table} t left join (
  with texts as (select {key}, lower({document}) as document from {table} where {only}),
  codes as (select {key}, cast('0x' || substr(md5(word), 1, 8) as ubigint) as code from (
    select {key}, unnest(regexp_extract_all(document, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from texts)),
  cells as (select {key}, code % 64 as i, sum(case when code >= 2147483648 then 1 else -1 end) as x from codes group by all),
  lengths as (select {key}, sqrt(cast(sum(x * x) as double)) as length from cells group by {key})
  select {key}, list(cast(coalesce(x, 0) / coalesce(nullif(length, 0), cast(1 as double)) as float) order by d.i) as vector
  from texts cross join (select cast(unnest(range(64)) as ubigint) as i) d
  left join cells using ({key}, i) left join lengths using ({key}) group by {key}) e using ({key})"""


_PARSED = """select qid, cast(i as int) as pos, json_extract_string(answer, concat('$[', i, '].name')) as name,
  json_extract_string(answer, concat('$[', i, '].justification')) as justification
from (select qid, answer, unnest(range(cast(json_array_length(answer) as bigint))) as i from answers where json_valid(answer))"""
#: Places and requests with vectors computed from their texts, and answers parsed from responses.
_FROM_TEXT = {
    "plain_places": (f"select * replace (cast(null as float[]) as embedding) from ({_PARTS['places']})", []),
    "places": (_embedded("plain_places", "id", _DOCUMENT, "embedding"), ["plain_places"]),
    "plain_requests": (f"select * replace (cast(null as float[]) as query_vector) from ({_PARTS['requests']})", []),
    "requests": (_embedded("plain_requests", "qid", _QUERY_TEXT, "query_vector"), ["plain_requests"]),
    "generated": (_PARSED, ["answers"]),
}

_HISTORY = "event_id, user_id, restaurant_id, interaction_type, rating_given"
_BOX = """latitude between 40.758::double - 5.0::double / 111.0::double and 40.758::double + 5.0::double / 111.0::double
 and longitude between -73.9855::double - 5.0::double / (111.0::double * cos(radians(40.758::double)))
                   and -73.9855::double + 5.0::double / (111.0::double * cos(radians(40.758::double)))"""
_SINGLE_KM = _km("40.758::double", "-73.9855::double", "latitude", "longitude")

ORACLE: dict[str, str] = {
    "q01_valid_catalog": _query("""select id, name, description,
  array_to_string(list_filter(coalesce(cuisines, []), lambda c: c is not null), '|') as cuisines,
  array_to_string(list_filter(features, lambda c: c is not null), '|') as features,
  priceRange as price_range, overallRating as overall_rating, numberOfRatings as number_of_ratings,
  latitude, longitude, neighborhood, city, state, phone, websiteUrl as website_url
from flat_catalog where id is not null and trim(name) <> '' and latitude is not null and longitude is not null""", "flat_catalog"),
    "q02_box_filter": _query(f"""select id, round(latitude, 6) as latitude, round(longitude, 6) as longitude
from places where {_BOX}""", "places"),
    "q03_rating_price_filter": _query("""select id, overall_rating, price_range from places
where overall_rating >= 3 and price_range <= 2""", "places"),
    "q04_distance_topk_single": _query(f"""select id, name, round(dist_km, 6) as dist_km, {_TEMPLATE} as justification
from (select *, {_SINGLE_KM} as dist_km from places where {_BOX} order by dist_km, id limit 30)
where dist_km <= 5 order by places.dist_km, id limit 10""".replace("places.dist_km", "dist_km"), "places"),
    "q05_distance_topk_batch": _query("""select qid, cast(row_number() over (partition by qid order by dist_km, id) as int) as rank,
  id, round(dist_km, 6) as dist_km from all_distance_hits where dist_km <= max_km
qualify row_number() over (partition by qid order by dist_km, id) <= 10""".replace("round(dist_km, 6) as dist_km", "round(all_distance_hits.dist_km, 6) as dist_km"), "all_distance_hits"),
    "q06_vector_topk_batch": _query("""select qid, cast(rn as int) as rn, id, round(cos_dist, 6) as cos_dist
from vector_hits""", "vector_hits"),
    "q07_hybrid_batch": _query("""select qid, cast(rank as int) as rank, id, round(dist_km, 6) as dist_km,
  round(cos_dist, 6) as cos_dist, round(score, 6) as score, semantic from ranked""", "ranked"),
    "q08_semantic_fallback": _query("""select q.qid, case when bool_or(h.semantic) then 'semantic'
  when not bool_or(h.semantic) then 'distance' else 'none' end as path,
  least(count(*) filter (h.dist_km <= h.max_km), 10) as answers
from accepted q left join hits h on h.qid = q.qid group by q.qid""", "hits"),
    "q09_haversine_both": _query(f"""select q.qid, round({_km('q.latitude', 'q.longitude', 'p.latitude', 'p.longitude')}, 6) as acos_km,
  round(6371::double * 2 * atan2(sqrt(a), sqrt(1 - a)), 6) as haversine_km
from requests q join places p on p.id = q.qid, lateral (select
  sin(radians(p.latitude - q.latitude) / 2) * sin(radians(p.latitude - q.latitude) / 2)
  + cos(radians(q.latitude)) * cos(radians(p.latitude))
  * sin(radians(p.longitude - q.longitude) / 2) * sin(radians(p.longitude - q.longitude) / 2) as a)""", "requests", "places"),
    "q10_template_text": _query(f"""select id, {_TEMPLATE} as justification
from (select *, {_SINGLE_KM} as dist_km from places)""", "places"),
    "q11_place_document": _query(f"""select id, {_DOCUMENT} as document from places""", "places"),
    "q12_query_text": _query(f"""select qid, {_QUERY_TEXT} as query_text from requests""", "requests"),
    "q13_prompt": _query(_prompt(), "accepted", "candidates"),
    "q14_grounding_match": _query("""select qid, cast(pos as bigint) as pos, id, restaurant_name, justification,
  round(distance, 6) as distance from grounded""", "grounded"),
    "q15_generated_or_template": _query("""select qid, position, id, restaurant_name, justification, round(distance, 6) as distance,
  overall_rating, price_range, array_to_string(cuisines, '|') as cuisines, round(latitude, 6) as latitude,
  round(longitude, 6) as longitude, generated from recs""", "recs"),
    "q16_parse_generated": _query(_PARSED, "answers"),
    "q17_pending_embeddings": _query("select id, name from places where embedding is null", "places"),
    "q18_upsert_catalog": _query("""select coalesce(n.id, o.id) as id,
  case when n.id is null then o.name else n.name end as name,
  case when n.id is null then o.description else n.description end as description,
  array_to_string(case when n.id is null then o.cuisines else n.cuisines end, '|') as cuisines,
  array_to_string(case when n.id is null then o.features else n.features end, '|') as features,
  case when n.id is null then o.price_range else n.price_range end as price_range,
  case when n.id is null then o.overall_rating else n.overall_rating end as overall_rating,
  case when n.id is null then o.number_of_ratings else n.number_of_ratings end as number_of_ratings,
  round(case when n.id is null then o.latitude else n.latitude end, 6) as latitude,
  round(case when n.id is null then o.longitude else n.longitude end, 6) as longitude,
  case when n.id is null then o.city else n.city end as city,
  case when n.id is null then o.state else n.state end as state,
  cast(coalesce(len(o.embedding), 0) as int) as dims
from places o full join new_rows n on n.id = o.id""", "places", "new_rows"),
    "q19_history_by_user": _query(f"""select {_HISTORY}, interaction_time from history_events
where user_id in (select cast(qid as varchar) from requests)""", "history_events", "requests"),
    "q20_history_by_place": _query(f"""select {_HISTORY} from history_events
where restaurant_id in (select id from places)""", "history_events", "places"),
    "q21_metro_histogram": _query("select * from metros", "metros"),
    "q22_densest_metro_centroid": _query("""select d.city, d.state, d.n, round(avg(p.latitude), 6) as latitude,
  round(avg(p.longitude), 6) as longitude
from densest d join places p on p.city is not distinct from d.city and p.state is not distinct from d.state
group by d.city, d.state, d.n""", "places", "densest"),
    "q23_stratified_sample": _query("""select id, name, city, densest, md5(concat('42-shuffle-', id)) as sample_order
from (select *, row_number() over (partition by densest order by md5(concat('42-pick-', id)), id) as i,
        count(*) filter (densest) over () as n_top from (
  select p.id, p.name, p.city,
    p.city is not distinct from d.city and p.state is not distinct from d.state as densest from places p, densest d))
where i <= case when densest then least(n_top, 500) else greatest(1500 - least(n_top, 500), 0) end""", "places", "densest"),
    "q24_feature_flatten": _query("select * from flat_features", "flat_features"),
    "q25_address_pick": _query("select * from addresses", "addresses"),
    "q26_request_validation": _query(_messages(), "raw_requests"),
    "q27_eval_counters": _query("""select *, round(case when total_recommendations > 0
  then grounded_rationales / total_recommendations * 100 else 100 end, 6) as grounded_pct from scores""", "scores"),
    "q28_eval_metrics": _query("""select total_queries, successful_queries, round(success_rate_pct, 6) as success_rate_pct,
  total_recommendations, round(latency_mean_ms, 6) as latency_mean_ms, round(latency_p50_ms, 6) as latency_p50_ms,
  round(latency_p90_ms, 6) as latency_p90_ms, round(latency_p99_ms, 6) as latency_p99_ms,
  round(distance_adherence_pct, 6) as distance_adherence_pct, round(rating_adherence_pct, 6) as rating_adherence_pct,
  round(rationale_groundedness_pct, 6) as rationale_groundedness_pct,
  round(semantic_relevance_pct, 6) as semantic_relevance_pct from metrics""", "metrics"),
    "q29_quality_gates": _query(_gates(), "metrics"),
    "q30_kpi": _query("""select qid, count(*) as recommendations, round(min(distance), 6) as closest_km,
  max(coalesce(overall_rating, 0)) as top_rating from recs group by qid""", "recs"),
    "q31_ivf_topk": _query("""select qid, cast(rn as int) as rn, id, round(cos_dist, 6) as cos_dist
from vector_hits""", "vector_hits"),
    "q32_embed_backfill": _query(f"""select id, cast(len(embedding) as int) as dims,
  round(list_reduce(list_transform(embedding, lambda x, i: cast(x as double) * i), lambda s, x: s + x), 4) as weighted_sum
from ({_embedded("places", "id", _DOCUMENT, "embedding", "embedding is null")})""", "places"),
    "q33_stream_history": _query(f"select {_HISTORY}, interaction_time from history_events", "history_events"),
    "q34_rejected_requests": _query("""select qid, cast(400 as int) as status, 'Validation Failed' as error, concat_ws('; ',
  case when not max_distance_km > 0 then 'maxDistanceInKm: must be greater than 0' end,
  case when preferred_price_range > 4 then 'preferredPriceRange: must be less than or equal to 4' end,
  case when minimum_rating > 5 then 'minimumRating: must be less than or equal to 5' end) as message
from requests where qid not in (select qid from accepted)""", "accepted"),
    "q35_raw_flatten": _query("""select u.id, u.name, u.description, u."priceRange", u.latitude, u.longitude, a.city, a.state, f.features
from usable u join addresses a on a.raw_pos = u.raw_pos join flat_features f on f.raw_pos = u.raw_pos""",
                              "usable", "addresses", "flat_features"),
    "q36_pool_sizes": _query("select count(*) as total, (select count(*) from usable) as usable from raw_merchants", "usable"),
    "q37_catalog_counts": _query("select count(*) as places, count(embedding) as with_vector from places", "places"),
    "q38_history_rows": _query("""select event_id, user_id, restaurant_id, interaction_type, rating_given, interaction_time
from history_events""", "history_events"),
    "q39_sample_rows": _query("""select qid, position, restaurant_name as name, coalesce(overall_rating, 0) as rating,
  round(distance, 2) as distance, array_to_string(cuisines, '|') as cuisines,
  case when length(justification) > 120 then concat(left(justification, 120), '...') else justification end as rationale
from recs where position <= 2""", "recs"),
    "q40_persona_answers": _query(f"""select cast(qid as bigint) as qid, cast(rank as int) as position, id, round(dist_km, 6) as distance,
  {_TEMPLATE} as justification from candidates""".replace("dist_km is not null", "candidates.dist_km is not null"),
                                  "candidates", asked="personas"),
    "q41_vector_round_trip": _query("""select id, cast(len(embedding) as int) as dims, true as same,
  round(list_dot_product(cast(embedding as double[]), cast(embedding as double[])), 6) as squared_length
from places where embedding is not null""", "places"),
    "q42_vector_distance": _query("""select q.qid, round(1 - list_cosine_similarity(
  cast(q.query_vector as double[]), cast(p.embedding as double[])), 6) as cos_dist
from requests q join places p on p.id = q.qid where q.query_vector is not null and p.embedding is not null""", "requests", "places"),
    "q43_fetch_places": _query("""select id, name, city from places
where id in (select restaurant_id from history_events)""", "places", "history_events"),
    "q44_recommend_from_text": _query("""select qid, position, id, restaurant_name, justification, round(distance, 6) as distance,
  generated from recs""", "recs", own=_FROM_TEXT),
    "q45_ivf_recall": _query("select count(*) as exact_hits, count(*) as found_hits from vector_hits", "vector_hits"),
}

# The same questions by the other half of each measured switch.
_OPEN = """select * replace (case when qid % 3 <> 0 then minimum_rating end as minimum_rating,
  case when qid % 4 <> 0 then preferred_price_range end as preferred_price_range) from accepted"""
_OPEN_PAIRS = (_PARTS["pairs"].replace("(q.minimum_rating <= 0 ", "(coalesce(q.minimum_rating, 0) <= 0 ")
               .replace("(q.preferred_price_range <= 0 ", "(coalesce(q.preferred_price_range, 0) <= 0 "))
ORACLE |= {
    "q46_distance_narrowed": ORACLE["q05_distance_topk_batch"],
    "q47_hybrid_small_blocks": ORACLE["q07_hybrid_batch"],
    "q48_copies_answered_once": f"""with once as ({ORACLE["q05_distance_topk_batch"]})
select qid, rank, id, dist_km from once union all select -qid, rank, id, dist_km from once""",
    "q49_nullable_limits": _query("""select qid, cast(rank as int) as rank, id, round(dist_km, 6) as dist_km,
  round(cos_dist, 6) as cos_dist, round(score, 6) as score, semantic from ranked""", "ranked", asked="open_requests", own={
        "open_requests": (_OPEN, ["accepted"]), "pairs": (_OPEN_PAIRS, ["places"])}),
    "q51_generated_job": _query("""select qid, position, id, restaurant_name, justification, round(distance, 6) as distance,
  generated from recs""", "recs", own={"generated": (
        "select qid, 0 as pos, upper(name) as name, concat(name, ' comes first.') as justification from candidates where rank = 1",
        ["candidates"])}),
    "q50_bracketed_percentiles": _query("select latency_p50_ms as p50, latency_p90_ms as p90, latency_p99_ms as p99 from metrics", "metrics"),
}

# The same results read back from what was stored.
_UPSERTED = """select coalesce(n.id, o.id) as id, case when n.id is null then o.name else n.name end as name,
  case when n.id is null then o.description else n.description end as description,
  case when n.id is null then o.cuisines else n.cuisines end as cuisines,
  case when n.id is null then o.features else n.features end as features,
  case when n.id is null then o.price_range else n.price_range end as price_range,
  case when n.id is null then o.latitude else n.latitude end as latitude,
  case when n.id is null then o.city else n.city end as city, case when n.id is null then o.state else n.state end as state,
  o.embedding as embedding from places o full join new_rows n on n.id = o.id"""
ORACLE |= {
    "q54_stored_catalog": _query("""select id, name, array_to_string(cuisines, '|') as cuisines, price_range,
  round(latitude, 6) as latitude, city, cast(len(embedding) as int) as dims,
  round(list_reduce(list_transform(embedding, lambda x, i: cast(x as double) * i), lambda s, x: s + x), 4) as weighted_sum
from filled""", "filled", own={
        "upserted": (_UPSERTED, ["places", "new_rows"]),
        "filled": (_embedded("upserted", "id", _DOCUMENT, "embedding", "embedding is null"), ["upserted"])}),
    "q55_stored_upsert": ORACLE["q18_upsert_catalog"],
    "q56_json_catalog": ORACLE["q01_valid_catalog"],
    "q57_json_export": ORACLE["q35_raw_flatten"],
    "q58_stored_recommendations": ORACLE["q15_generated_or_template"],
    "q59_layout_answers": ORACLE["q40_persona_answers"],
    "q61_city_lookup": _query("""select id, name, p.city, p.state from places p
join densest d on p.city is not distinct from d.city and p.state is not distinct from d.state""", "places", "densest"),
    "q62_place_lookup": _query(f"""select {_HISTORY} from history_events where restaurant_id in (
  select restaurant_id from history_events where user_id is not null and restaurant_id is not null
  group by restaurant_id order by count(*) desc, restaurant_id limit 5)""", "history_events"),
    "q63_bucketed_fetch": ORACLE["q43_fetch_places"],
    "q64_ledger_job": ORACLE["q51_generated_job"],
    "q65_retried_backfill": ORACLE["q32_embed_backfill"],
    "q66_stream_backfill": ORACLE["q32_embed_backfill"],
}
