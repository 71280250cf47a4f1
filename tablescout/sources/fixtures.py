"""Places, requests and the other inputs derived from the benchmark tables.

Every view is one SQL text that runs unchanged on Spark and on DuckDB; only the array
constructor and the numbers from one to another differ: ``{list}(..)``, ``{numbers}a, b))``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

#: Table schemas by path, read from the files once.
_SCHEMAS: dict[str, StructType] = {}

VIEWS = {
    "places": """
select p.p_partkey as id, p.p_name as name, d.text as description,
       {list}(p.p_type, p.p_brand) as cuisines,
       case when d.doc_id is null then {list}() else {list}(d.lang, d.source) end as features,
       case when p.p_partkey % 11 = 0 then null else 1 + p.p_size % 4 end as price_range,
       case when p.p_partkey % 13 = 0 then null
            else cast(p.p_partkey * 7 % 51 as double) / cast(10 as double) end as overall_rating,
       p.p_size * 10 as number_of_ratings,
       cast(40.70 as double) + cast(p.p_partkey * 37 % 1000 as double) / cast(10000 as double) as latitude,
       cast(-74.05 as double) + cast(p.p_partkey * 91 % 1000 as double) / cast(8000 as double) as longitude,
       n.n_name as city, r.r_name as state, e.embedding as embedding
from part p
left join documents d on d.doc_id = p.p_partkey
left join embeddings e on e.vec_id = p.p_partkey
left join nation n on n.n_nationkey = p.p_partkey % 29
left join region r on r.r_regionkey = n.n_regionkey""",
    "requests": """
select c.c_custkey as qid,
       cast(40.70 as double) + cast(c.c_custkey * 53 % 1000 as double) / cast(10000 as double) as latitude,
       cast(-74.05 as double) + cast(c.c_custkey * 29 % 1000 as double) / cast(8000 as double) as longitude,
       case when c.c_custkey % 7 = 0 then null else lower(c.c_mktsegment) end as preferred_cuisine,
       cast(c.c_custkey % 12 as double) - cast(1 as double) as max_distance_km,
       cast(c.c_custkey % 7 as int) as minimum_rating,
       cast(c.c_custkey % 6 as int) as preferred_price_range,
       e.embedding as query_vector
from (select *, c_custkey % (select cast(floor(count(*) * 1.2) as bigint) from embeddings) as probe from customer) c
left join embeddings e on e.vec_id = c.probe""",
    "history_events": """
select event_id, cast(user_id as {string}) as user_id,
       cast(floor(value * 4) as bigint) as restaurant_id,
       case when event_type in ('view', 'click') then 'VISITED' else 'RATED' end as interaction_type,
       case when event_type in ('view', 'click') then null
            else cast(event_id % 6 as double) end as rating_given,
       ts as interaction_time
from events where event_type <> 'error'""",
    "generated": """
select q.c_custkey as qid, q.pos,
       case when (q.c_custkey + q.pos) % 5 = 0 then 'Invented Spot'
            when q.pos % 2 = 0 then upper(p.p_name) else p.p_name end as name,
       concat(p.p_name, ' is close by.') as justification
from (select c_custkey, pos, (c_custkey * 7 + pos * 13) % (select count(*) from part) as place
      from (select c_custkey, {numbers}0, 4)) as pos from customer where c_custkey % 3 <> 0)) q
join part p on p.p_partkey = q.place""",
    "raw_merchants": """
select p_partkey as raw_pos,
       concat('{"_id":', cast(p_partkey as {string}),
              ',"name":" ', p_name, ' ","description":"',
              case when p_partkey % 17 = 0 then '  ' else p_type end,
              '","priceRange":', cast(1 + p_size % 4 as {string}),
              ',"geoLocation":{"coordinates":[',
              case when p_partkey % 19 = 0 then '-74.5'
                   else concat('-74.', lpad(cast(p_partkey * 91 % 1000 as {string}), 3, '0'),
                               ',40.', lpad(cast(p_partkey * 37 % 1000 as {string}), 3, '0')) end,
              ']},"location":{"city":"Outer ', cast(p_size % 3 as {string}),
              '","state":"S","address":{"city":"',
              case when p_size % 5 = 0 then '' else concat('C', cast(p_size % 4 as {string})) end,
              '"}},"features":[{"types":[" Patio ","Not Applicable","', p_type, '"]},{"types":["Patio",""]}]}') as js
from part""",
    "query_runs": """
select event_id as qid, case when event_type = 'error' then 503 else 200 end as status,
       value as latency_ms
from events""",
    # Generator responses: two items, an empty answer, broken JSON, no body.
    "responses": """
select c_custkey as qid,
       case when c_custkey % 5 = 0 then '{"candidates":[]}'
            when c_custkey % 7 = 0 then '{"candidates":[{"content":{"parts":[{"text":"not json"}]}}]}'
            when c_custkey % 11 = 0 then null
            else concat('{"candidates":[{"content":{"parts":[{"text":"[{\\"name\\":\\"', lower(c_mktsegment),
                        '\\",\\"justification\\":\\"', c_name, ' fits.\\",\\"distance\\":1.5},{\\"name\\":\\"Spot ',
                        cast(c_custkey as {string}), '\\",\\"justification\\":\\"near\\"}]"}]}}]}') end as body
from customer""",
    # Expected terms of the semantic check; every fourth request expects nothing.
    "expectations": """
select c_custkey as qid,
       case when c_custkey % 4 = 0 then {list}() else {list}('economy', lower(c_mktsegment), 'ring') end
           as expected_cuisines
from customer""",
    # A second load of part of the catalog: changed rows, repeated ids, new ids.
    "reload": """
select p_partkey + case when p_partkey % 10 = 0 then 10000000 else 0 end as id,
       concat(p_name, ' v', cast(n_nationkey as {string})) as name,
       case when n_nationkey = 1 then null else p_type end as description,
       {list}(p_brand) as cuisines, {list}(p_type) as features,
       p_size as price_range, cast(n_nationkey as double) as overall_rating, p_size * 20 as number_of_ratings,
       cast(40.70 as double) + cast(p_partkey * 37 % 1000 as double) / cast(10000 as double) as latitude,
       cast(-74.05 as double) + cast(p_partkey * 91 % 1000 as double) / cast(8000 as double) as longitude,
       n_name as city, cast(null as {string}) as state,
       cast(n_nationkey * 100000000 as bigint) + p_partkey as input_pos
from (select *, {numbers}0, p_partkey % 3)) as load from part) join nation on n_nationkey = load""",
    # Flat catalog records with every kind of defect.
    "flat_catalog": """
select case when p_partkey % 23 = 0 then null else p_partkey end as id,
       case when p_partkey % 29 = 0 then '  ' when p_partkey % 31 = 0 then null else p_name end as name,
       p_type as description,
       case when p_partkey % 7 = 0 then null when p_partkey % 3 = 0 then {list}(p_brand, null, p_type)
            else {list}(p_type) end as cuisines,
       {list}(null, p_brand) as features,
       p_size as priceRange, p_retailprice as overallRating, p_size * 10 as numberOfRatings,
       case when p_partkey % 37 = 0 then null else cast(p_partkey % 90 as double) end as latitude,
       cast(p_partkey % 180 as double) as longitude,
       p_name as neighborhood, p_brand as city, p_type as state, p_name as phone, p_name as websiteUrl
from part""",
    # Requests as text, with missing and unreadable values and half-star ratings.
    "raw_requests": """
select c_custkey as qid,
       case when c_custkey % 89 = 0 then null when c_custkey % 97 = 0 then 'abc'
            else cast(c_custkey % 80 as {string}) end as latitude,
       case when c_custkey % 83 = 0 then null else cast(c_custkey % 170 as {string}) end as longitude,
       case when c_custkey % 41 = 0 then null when c_custkey % 43 = 0 then 'far'
            else cast(c_custkey % 550 - 20 as {string}) end as max_distance_km,
       case when c_custkey % 13 = 0 then null when c_custkey % 47 = 0 then 'NaN' when c_custkey % 53 = 0 then 'Infinity'
            else cast(c_custkey % 7 - 1 as {string}) end as preferred_price_range,
       case when c_custkey % 59 = 0 then '99999999999' when c_custkey % 61 = 0 then 'NaN'
            else concat(cast(c_custkey % 8 - 1 as {string}), '.5') end as minimum_rating
from customer""",
}


def _text(name: str, **words: str) -> str:
    text = VIEWS[name]
    for word, value in words.items():
        text = text.replace("{" + word + "}", value)
    return text


def spark_text(name: str) -> str:
    # Spark reads a backslash in a literal as an escape.
    return _text(name, list="array", string="string", numbers="explode(sequence(").replace("\\", "\\\\")


def duckdb_text(name: str) -> str:
    return _text(name, list="list_value", string="varchar", numbers="unnest(generate_series(")


def _register(spark: SparkSession, sf_dir: str, text: str) -> None:
    """Make the tables a text mentions available under their names."""
    for table in TABLES:
        if re.search(rf"(from|join) {table}\b", text):
            path = f"{sf_dir}/{table}.parquet"
            if path not in _SCHEMAS:
                _SCHEMAS[path] = spark.read.parquet(path).schema
            spark.read.schema(_SCHEMAS[path]).parquet(path).createOrReplaceTempView(table)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = spark_text(name)
    _register(spark, sf_dir, text)
    return spark.sql(text)
