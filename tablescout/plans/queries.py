"""Every operator as a query over the benchmark tables: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablescout import schemas
from tablescout.functions import geo, text, vectors
from tablescout.operators import (
    backfill, evaluate, ground, history, ingest, ivf, orderstats, requests as request_ops, retrieve, sampling,
)
from tablescout.plans import catalog as catalog_jobs, recommend as jobs
from tablescout.session import materialize, scratch_path
from tablescout.sources import buckets, catalog, layout, store
from tablescout.sources.fixtures import spark_text, view
from tablescout.streaming import history as streams, retries

Query = Callable[[SparkSession, str], DataFrame]

#: The single request of the integration scenario.
LATITUDE, LONGITUDE, RADIUS_KM = 40.7580, -73.9855, 5.0


def km(name: str) -> Column:
    return F.round(name, 6).alias(name)


def listed(name: str) -> Column:
    return F.array_join(name, "|").alias(name)


def _accepted(spark: SparkSession, sf: str) -> DataFrame:
    return request_ops.validate_requests(view(spark, sf, "requests"))[0]


def _candidates(spark: SparkSession, sf: str, described: bool = True) -> DataFrame:
    return jobs.candidates(view(spark, sf, "requests"), view(spark, sf, "places"), described=described)


def _generated(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "generated")


def _recommendations(spark: SparkSession, sf: str) -> DataFrame:
    found = materialize(_candidates(spark, sf, described=False).select(*ground.CANDIDATE_COLUMNS), "candidates")
    return ground.recommendations(found, _generated(spark, sf))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    asked = _accepted(spark, sf).join(view(spark, sf, "expectations"), "qid")
    return evaluate.score_recommendations(_recommendations(spark, sf), asked)


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.eval_metrics(_scores(spark, sf), view(spark, sf, "query_runs"))


def valid_catalog(spark: SparkSession, sf: str) -> DataFrame:
    rows = ingest.to_places(ingest.valid_places(view(spark, sf, "flat_catalog")))
    return rows.withColumns({c: F.array_join(c, "|") for c in ("cuisines", "features")})


def box_filter(spark: SparkSession, sf: str) -> DataFrame:
    inside = retrieve.single_box(view(spark, sf, "places"), LATITUDE, LONGITUDE, RADIUS_KM)
    return inside.select("id", km("latitude"), km("longitude"))


def rating_price_filter(spark: SparkSession, sf: str) -> DataFrame:
    wanted = geo.attribute_condition(F.col("overall_rating"), F.col("price_range"), F.lit(3), F.lit(2))
    return view(spark, sf, "places").where(wanted).select("id", "overall_rating", "price_range")


def distance_topk_single(spark: SparkSession, sf: str) -> DataFrame:
    found = retrieve.single_distance(view(spark, sf, "places"), LATITUDE, LONGITUDE, RADIUS_KM)
    return found.select("id", "name", km("dist_km"), text.template_text(F.col("dist_km")).alias("justification"))


def distance_topk_batch(spark: SparkSession, sf: str) -> DataFrame:
    ranked = retrieve.rerank(retrieve.distance_hits(_accepted(spark, sf), view(spark, sf, "places")))
    return ranked.select("qid", "rank", "id", km("dist_km"))


def vector_topk_batch(spark: SparkSession, sf: str) -> DataFrame:
    hits = retrieve.vector_hits(_accepted(spark, sf), view(spark, sf, "places"))
    return hits.select("qid", "rn", "id", km("cos_dist"))


def hybrid_batch(spark: SparkSession, sf: str) -> DataFrame:
    ranked = retrieve.retrieve(_accepted(spark, sf), view(spark, sf, "places"))
    return ranked.select("qid", "rank", "id", km("dist_km"), km("cos_dist"), km("score"), "semantic")


def semantic_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """How every valid request was answered, and with how many places inside its radius."""
    hits = retrieve.hybrid_hits(_accepted(spark, sf), view(spark, sf, "places"))
    inside = F.col("dist_km") <= F.col("max_km")
    paths = hits.groupBy("qid").agg(
        F.max("semantic").alias("semantic"), F.least(F.count_if(inside), F.lit(10)).alias("answers"))
    path = F.when(F.col("semantic"), "semantic").when(~F.col("semantic"), "distance").otherwise("none")
    return _accepted(spark, sf).select("qid").join(paths, "qid", "left").select(
        "qid", path.alias("path"), F.coalesce("answers", F.lit(0)).alias("answers"))


def distance_formulas(spark: SparkSession, sf: str) -> DataFrame:
    q = view(spark, sf, "requests").select("qid", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    pairs = q.join(view(spark, sf, "places"), q.qid == F.col("id"))
    ends = (F.col("lat"), F.col("lon"), F.col("latitude"), F.col("longitude"))
    return pairs.select("qid", F.round(geo.acos_km(*ends), 6).alias("acos_km"),
                        F.round(geo.haversine_km(*ends), 6).alias("haversine_km"))


def template_text(spark: SparkSession, sf: str) -> DataFrame:
    away = geo.acos_km(F.lit(LATITUDE), F.lit(LONGITUDE), F.col("latitude"), F.col("longitude"))
    return view(spark, sf, "places").select("id", text.template_text(away).alias("justification"))


def place_document(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "places").select("id", text.place_document().alias("document"))


def query_text(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "requests").select("qid", text.query_text().alias("query_text"))


def prompt(spark: SparkSession, sf: str) -> DataFrame:
    return ground.build_prompts(_accepted(spark, sf), _candidates(spark, sf), cut=False)


def grounding_match(spark: SparkSession, sf: str) -> DataFrame:
    matched = ground.ground(_generated(spark, sf), _candidates(spark, sf, described=False))
    return matched.select("qid", "pos", "id", "restaurant_name", "justification", km("distance"))


def generated_or_template(spark: SparkSession, sf: str) -> DataFrame:
    rows = _recommendations(spark, sf)
    return rows.select("qid", "position", "id", "restaurant_name", "justification", km("distance"), "overall_rating",
                       "price_range", listed("cuisines"), km("latitude"), km("longitude"), "generated")


def parse_generated(spark: SparkSession, sf: str) -> DataFrame:
    return ground.parse_generated(view(spark, sf, "responses")).withColumn("pos", F.col("pos").cast("int"))


def pending_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return backfill.pending(view(spark, sf, "places")).select("id", "name")


def upsert_catalog(spark: SparkSession, sf: str) -> DataFrame:
    merged = ingest.upsert_places(view(spark, sf, "places"), view(spark, sf, "reload"))
    return merged.select("id", "name", "description", listed("cuisines"), listed("features"), "price_range",
                         "overall_rating", "number_of_ratings", km("latitude"), km("longitude"), "city", "state",
                         F.coalesce(F.size("embedding"), F.lit(0)).alias("dims"))


def history_by_user(spark: SparkSession, sf: str) -> DataFrame:
    log = view(spark, sf, "history_events")
    users = view(spark, sf, "requests").select(F.col("qid").cast("string").alias("user_id"))
    return history.history_by_user(log, users).select(
        "event_id", "user_id", "restaurant_id", "interaction_type", "rating_given", "interaction_time")


def history_by_place(spark: SparkSession, sf: str) -> DataFrame:
    log = view(spark, sf, "history_events")
    ids = view(spark, sf, "places").select(F.col("id").alias("restaurant_id"))
    return history.history_by_place(log, ids).select(
        "event_id", "user_id", "restaurant_id", "interaction_type", "rating_given")


def history_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Visits and ratings as the two log writers shape them."""
    log = view(spark, sf, "history_events")
    visits = history.visits(log.where("interaction_type = 'VISITED'"))
    rated = history.ratings(log.where("interaction_type = 'RATED'"))
    return visits.unionByName(rated).withColumn("interaction_time", F.col("interaction_time").cast("timestamp_ntz"))


def metro_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.metro_histogram(view(spark, sf, "places"))


def densest_metro_centroid(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.centroid(view(spark, sf, "places")).select("city", "state", "n", km("latitude"), km("longitude"))


def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample_catalog(view(spark, sf, "places")).select("id", "name", "city", "densest", "sample_order")


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.parse_merchants(view(spark, sf, "raw_merchants"), "js")


def feature_flatten(spark: SparkSession, sf: str) -> DataFrame:
    return _raw(spark, sf).select("raw_pos", F.array_join(ingest.flatten_features(F.col("features")), "|").alias("features"))


def address_pick(spark: SparkSession, sf: str) -> DataFrame:
    return _raw(spark, sf).select("raw_pos", *(c.alias(n) for n, c in ingest.pick_address().items() if n != "neighborhood"))


def raw_flatten(spark: SparkSession, sf: str) -> DataFrame:
    flat = ingest.flatten_merchants(ingest.usable(_raw(spark, sf)))
    return flat.select("id", "name", "description", "priceRange", "latitude", "longitude", "city", "state", listed("features"))


def pool_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.pool_sizes(_raw(spark, sf))


def catalog_counts(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "places").agg(
        F.count(F.lit(1)).alias("places"), F.count("embedding").alias("with_vector"))


def request_validation(spark: SparkSession, sf: str) -> DataFrame:
    return request_ops.check_requests(view(spark, sf, "raw_requests")).select(
        "qid", "latitude", "longitude", "max_distance_km", "preferred_price_range", "minimum_rating", "message")


def rejected_requests(spark: SparkSession, sf: str) -> DataFrame:
    return request_ops.validate_requests(view(spark, sf, "requests"))[1].drop("rejected_at")


def eval_counters(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf).withColumn("grounded_pct", F.round("grounded_pct", 6))


def eval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    metrics = _metrics(spark, sf)
    return metrics.select(*(km(f.name) if f.dataType.typeName() == "double" else f.name for f in metrics.schema))


def quality_gates(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.quality_gates(_metrics(spark, sf)).withColumn("achieved", F.round("achieved", 6))


def kpi(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.kpis(_recommendations(spark, sf)).select("qid", "recommendations", km("closest_km"), "top_rating")


def sample_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluate.sample_rows(_recommendations(spark, sf))
    return rows.select("qid", "position", "name", "rating", "distance", listed("cuisines"), "rationale")


def persona_answers(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark personas against the whole catalog, by distance."""
    asked = catalog.personas(spark).withColumn("query_vector", F.lit(None).cast("array<float>"))
    recs = jobs.recommend(asked, view(spark, sf, "places"))
    return recs.select("qid", "position", "id", km("distance"), "justification")


def vector_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    literal = vectors.vector_literal(F.col("embedding"))
    parsed = view(spark, sf, "places").where(F.col("embedding").isNotNull()).select(
        "id", "embedding", vectors.parse_vector(literal, 64).alias("parsed"))
    return parsed.select(
        "id", F.size("parsed").alias("dims"), (F.col("parsed") == F.col("embedding")).alias("same"),
        F.round(vectors.dot(F.col("parsed"), F.col("parsed")), 6).alias("squared_length"))


def vector_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine distance of every request to the place of the same number."""
    q = view(spark, sf, "requests").select("qid", "query_vector")
    pairs = q.join(view(spark, sf, "places").select("id", "embedding"), q.qid == F.col("id"))
    distance = vectors.cosine_distance(F.col("query_vector"), F.col("embedding"))
    return pairs.select("qid", F.round(distance, 6).alias("cos_dist")).where(F.col("cos_dist").isNotNull())


def fetch_places(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog rows that the interaction log names."""
    visited = view(spark, sf, "history_events").select(F.col("restaurant_id").alias("id"))
    return history.fetch_places(view(spark, sf, "places"), visited).select("id", "name", "city")


def _stored_index(spark: SparkSession, sf: str, n_cells: int | None = None) -> ivf.VectorIndex:
    path = scratch_path(spark, "index")
    ivf.save_index(ivf.build_ivf(view(spark, sf, "places"), n_cells), path)
    return ivf.load_index(spark, path)


def ivf_topk(spark: SparkSession, sf: str) -> DataFrame:
    """A stored index, read until every answer is certified: the exact answers."""
    found = ivf.certified_hits(_accepted(spark, sf), _stored_index(spark, sf)).hits
    return found.select("qid", "rn", "id", km("cos_dist"))


def ivf_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of the exact search, and how many of them the search of the stored index finds."""
    asked, index = _accepted(spark, sf), _stored_index(spark, sf)
    found = ivf.certified_hits(asked, index).hits.select("qid", "id", F.lit(1).alias("found"))
    exact = retrieve.vector_hits(asked, view(spark, sf, "places")).select("qid", "id")
    return exact.join(found, ["qid", "id"], "left").agg(
        F.count(F.lit(1)).alias("exact_hits"), F.count("found").alias("found_hits"))


def ivf_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of a finely divided index that the requests read until certified, of those they could have read."""
    index = ivf.build_ivf(view(spark, sf, "places"), cluster_rows=64)
    reads = ivf.certified_hits(_accepted(spark, sf), index).reads
    return reads.agg(F.count(F.lit(1)).alias("requests"), F.sum("clusters").alias("clusters_read"),
                     (F.count(F.lit(1)) * int((index.members > 0).sum())).alias("clusters"),
                     F.count_if("certified").alias("certified"))


def scored_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of vectors that meet in the blocks of a vector search on small cells, and those it compares."""
    return retrieve.scored_pairs(_accepted(spark, sf), view(spark, sf, "places"))


def embed_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors after a backfill, by a weighted sum of their components."""
    filled = backfill.backfill(view(spark, sf, "places"), vectors.HashingEmbedder(64))
    weighted = F.transform("embedding", lambda x, i: x.cast("double") * (i + 1))
    return filled.select("id", F.size("embedding").alias("dims"),
                         F.round(F.aggregate(weighted, F.lit(0.0), lambda s, x: s + x), 4).alias("weighted_sum"))


def recommend_from_text(spark: SparkSession, sf: str) -> DataFrame:
    """The whole job with vectors computed from the texts of places and requests."""
    embedder = vectors.HashingEmbedder(64)
    places = materialize(backfill.backfill(view(spark, sf, "places").drop("embedding").withColumn(
        "embedding", F.lit(None).cast("array<float>")), embedder), "places")
    recs = jobs.recommend(view(spark, sf, "requests").drop("query_vector"), places,
                          view(spark, sf, "responses"), embedder)
    return recs.select("qid", "position", "id", "restaurant_name", "justification", km("distance"), "generated")


def stream_history(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.read.parquet(f"{sf}/events.parquet").schema
    files = spark.readStream.schema(events).option("pathGlobFilter", "events*.parquet").parquet(sf)
    files.createOrReplaceTempView("event_stream")
    log = spark.sql(spark_text("history_events").replace("from events", "from event_stream"))
    path = scratch_path(spark, "history")
    streams.stream_history(log, path, scratch_path(spark, "history-checkpoint")).awaitTermination()
    return spark.read.schema(schemas.HISTORY).parquet(path).withColumn(
        "interaction_time", F.col("interaction_time").cast("timestamp_ntz"))


def distance_narrowed(spark: SparkSession, sf: str) -> DataFrame:
    """The batch by distance with every box narrowed and a directory of cells that is never broadcast."""
    hits = retrieve.distance_hits(_accepted(spark, sf), view(spark, sf, "places"), narrow_pairs=0, broadcast_cells=0)
    return retrieve.rerank(hits).select("qid", "rank", "id", km("dist_km"))


def hybrid_small_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The hybrid batch in small blocks, narrowed, with a directory that is never broadcast."""
    ranked = retrieve.retrieve(_accepted(spark, sf), view(spark, sf, "places"), narrow_pairs=0, broadcast_cells=0,
                               request_block=(256, 1024), place_block=(512, 2048))
    return ranked.select("qid", "rank", "id", km("dist_km"), km("cos_dist"), km("score"), "semantic")


def _copied(spark: SparkSession, sf: str) -> DataFrame:
    """Every valid request twice, the second time under the negative number."""
    asked = _accepted(spark, sf)
    return asked.unionByName(asked.withColumn("qid", -F.col("qid")))


def copies_answered_once(spark: SparkSession, sf: str) -> DataFrame:
    hits = retrieve.distance_hits(_copied(spark, sf), view(spark, sf, "places"))
    return retrieve.rerank(hits).select("qid", "rank", "id", km("dist_km"))


def nullable_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of which some leave a limit open, searched without validation."""
    asked = _accepted(spark, sf).withColumns({
        "minimum_rating": F.when(F.col("qid") % 3 != 0, F.col("minimum_rating")),
        "preferred_price_range": F.when(F.col("qid") % 4 != 0, F.col("preferred_price_range"))})
    ranked = retrieve.retrieve(asked, view(spark, sf, "places"))
    return ranked.select("qid", "rank", "id", km("dist_km"), km("cos_dist"), km("score"), "semantic")


def bracketed_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Latency percentiles, digit by digit."""
    runs = view(spark, sf, "query_runs").where("status = 200")
    return orderstats.order_statistics(runs, "latency_ms", {"p50": None, "p90": 0.9, "p99": 0.99})


def _names_first(prompt: str) -> str | None:
    """A stand-in for a text generator: it recommends the first candidate of its prompt."""
    line = re.search(r"^- (.*) \| cuisines: ", prompt, re.MULTILINE)
    if line is None:
        return None
    answer = json.dumps([{"name": line[1].upper(), "justification": f"{line[1]} comes first."}])
    return json.dumps({"candidates": [{"content": {"parts": [{"text": answer}]}}]})


def generated_job(spark: SparkSession, sf: str) -> DataFrame:
    """From requests to grounded answers with a generator in the job."""
    recs = jobs.recommend(view(spark, sf, "requests"), view(spark, sf, "places"), generator=_names_first)
    return recs.select("qid", "position", "id", "restaurant_name", "justification", km("distance"), "generated")


def _base_places(spark: SparkSession, sf: str) -> str:
    """The root of a catalog that holds the places."""
    root = scratch_path(spark, "catalog")
    store.load_if_empty(view(spark, sf, "places"), root)
    return root


def stored_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """A catalog loaded, updated, compacted and given its missing vectors, each by what changed, then read."""
    root = _base_places(spark, sf)
    if store.load_if_empty(view(spark, sf, "reload"), root):
        raise RuntimeError("a catalog with rows was loaded again")
    store.upsert(view(spark, sf, "reload"), root)
    store.compact(spark, root, share=0.0)
    catalog_jobs.fill_vectors(spark, root, vectors.HashingEmbedder(64))
    weighted = F.transform("embedding", lambda x, i: x.cast("double") * (i + 1))
    return store.read(spark, root).select(
        "id", "name", listed("cuisines"), "price_range", km("latitude"), "city", F.size("embedding").alias("dims"),
        F.round(F.aggregate(weighted, F.lit(0.0), lambda s, x: s + x), 4).alias("weighted_sum"))


def stored_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """An update read back from base files and changes."""
    root = _base_places(spark, sf)
    store.upsert(view(spark, sf, "reload"), root)
    return store.read(spark, root).select(
        "id", "name", "description", listed("cuisines"), listed("features"), "price_range", "overall_rating", "number_of_ratings",
        km("latitude"), km("longitude"), "city", "state", F.coalesce(F.size("embedding"), F.lit(0)).alias("dims"))


def json_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Flat records written as JSON and read back as a catalog."""
    path = scratch_path(spark, "flat")
    catalog.write_json(view(spark, sf, "flat_catalog"), path)
    rows = ingest.to_places(ingest.valid_places(catalog.read_catalog(spark, path, multi_line=False))).drop("input_pos")
    return rows.withColumns({c: F.array_join(c, "|") for c in ("cuisines", "features")})


def json_export(spark: SparkSession, sf: str) -> DataFrame:
    """The raw export as files of one JSON array each, read by splits and flattened."""
    path = scratch_path(spark, "export")
    rows = view(spark, sf, "raw_merchants").withColumn("file", F.floor(F.col("raw_pos") / 5000))
    arrays = rows.groupBy("file").agg(F.array_join(F.collect_list("js"), ",\n").alias("objects"))  # 5000 objects a file
    arrays.repartition("file").select(F.concat(F.lit("[\n"), "objects", F.lit("]")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    flat = ingest.flatten_merchants(ingest.usable(catalog.read_raw_array(spark, path)))
    return flat.select("id", "name", "description", "priceRange", "latitude", "longitude", "city", "state", listed("features"))


def stored_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    """Recommendations written and read back."""
    path = scratch_path(spark, "recommendations")
    jobs.write_recommendations(_recommendations(spark, sf), path)
    return spark.read.parquet(path).select(
        "qid", "position", "id", "restaurant_name", "justification", km("distance"), "overall_rating", "price_range",
        listed("cuisines"), km("latitude"), km("longitude"), "generated")


def _laid_out(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark, "layout")
    layout.write_layout(view(spark, sf, "places"), path, files=32)
    return path


def _asked_personas(spark: SparkSession) -> DataFrame:
    return catalog.personas(spark).withColumn("query_vector", F.lit(None).cast("array<float>"))


def layout_answers(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark personas against the files of a stored catalog that their boxes reach."""
    asked = _asked_personas(spark)
    recs = jobs.recommend(asked, layout.places_in_boxes(spark, _laid_out(spark, sf), asked))
    return recs.select("qid", "position", "id", km("distance"), "justification")


def layout_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Files and rows of a stored catalog, and those read for the persona with the smallest box."""
    nearby = _asked_personas(spark).orderBy("max_distance_km", "qid").limit(1)
    return layout.read_share(spark, _laid_out(spark, sf), nearby)


def city_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Places of the densest metro, from the files that hold any."""
    densest = sampling.densest_metro(view(spark, sf, "places")).first()
    found = layout.places_in_city(spark, _laid_out(spark, sf), densest["city"], densest["state"])
    return found.select("id", "name", "city", "state")


def place_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Events of the five most visited places, from the stored log by its second access path."""
    path = scratch_path(spark, "log")
    history.write_history(view(spark, sf, "history_events"), path)
    log = spark.read.schema(schemas.HISTORY).parquet(path)
    busiest = log.groupBy("restaurant_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "restaurant_id").limit(5).collect()
    return history.place_events(log, [r["restaurant_id"] for r in busiest]).select(
        "event_id", "user_id", "restaurant_id", "interaction_type", "rating_given")


def bucketed_fetch(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog rows that the log names, from a catalog bucketed by id."""
    path = scratch_path(spark, "buckets")
    places = buckets.save_bucketed(view(spark, sf, "places"), path.rsplit("/", 1)[-1].replace("-", "_"), path)
    visited = view(spark, sf, "history_events").select(F.col("restaurant_id").alias("id"))
    return buckets.matching(places, visited).select("id", "name", "city")


def _unreachable(prompt: str) -> str | None:
    raise ConnectionError(prompt)


def ledger_job(spark: SparkSession, sf: str) -> DataFrame:
    """The job with a generator, twice: the second run has no generator to reach and answers from the ledger."""
    ledger = scratch_path(spark, "responses")
    asked, places = view(spark, sf, "requests"), view(spark, sf, "places")
    prompts = ground.build_prompts(_accepted(spark, sf), _candidates(spark, sf), cut=False)
    materialize(ground.answer_prompts(prompts, _names_first, ledger, "names-first"), "responses")
    recs = jobs.recommend(asked, places, generator=_unreachable, ledger=ledger, generator_version="names-first")
    return recs.select("qid", "position", "id", "restaurant_name", "justification", km("distance"), "generated")


class _Unsteady:
    """An embedder whose first two calls for a batch fail."""

    def __init__(self, embedder: backfill.Embedder):
        self.embedder, self.seen = embedder, {}

    def __call__(self, texts: list[str]):
        calls = self.seen[texts[0]] = self.seen.get(texts[0], 0) + 1
        if calls <= 2:
            raise ConnectionError(texts[0])
        return self.embedder(texts)


def retried_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of fifty texts whose first two calls fail."""
    filled = backfill.backfill(view(spark, sf, "places"), _Unsteady(vectors.HashingEmbedder(64)), attempts=3, backoff_s=0.0)
    weighted = F.transform("embedding", lambda x, i: x.cast("double") * (i + 1))
    return filled.select("id", F.size("embedding").alias("dims"),
                         F.round(F.aggregate(weighted, F.lit(0.0), lambda s, x: s + x), 4).alias("weighted_sum"))


class _Away:
    """An embedder that cannot be reached before a moment."""

    def __init__(self, embedder: backfill.Embedder, until: float):
        self.embedder, self.until = embedder, until

    def __call__(self, texts: list[str]):
        if time.time() < self.until:
            raise ConnectionError(texts[0])
        return self.embedder(texts)


def stream_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of the catalog as a stream, while the embedder is away for the first seconds; failed texts wait in the state."""
    source, out = scratch_path(spark, "places"), scratch_path(spark, "vectors")
    view(spark, sf, "places").write.parquet(source)
    own = spark.newSession()  # the number of state partitions belongs to this stream alone
    own.conf.set("spark.sql.shuffle.partitions", 8)
    arriving = own.readStream.schema(schemas.PLACES).parquet(source)
    embedder = _Away(vectors.HashingEmbedder(64), time.time() + 6)
    retries.finish(retries.stream_retried_backfill(arriving, embedder, out, scratch_path(spark, "vectors-checkpoint"),
                                                   attempts=12, backoff_s=0.5, every_s=0.5))
    found = spark.read.schema("id long, embedding array<float>").parquet(out)
    filled = backfill.write_vectors(spark.read.schema(schemas.PLACES).parquet(source), found)
    weighted = F.transform("embedding", lambda x, i: x.cast("double") * (i + 1))
    return filled.select("id", F.size("embedding").alias("dims"),
                         F.round(F.aggregate(weighted, F.lit(0.0), lambda s, x: s + x), 4).alias("weighted_sum"))



QUERIES: dict[str, Query] = {
    "q01_valid_catalog": valid_catalog,
    "q02_box_filter": box_filter,
    "q03_rating_price_filter": rating_price_filter,
    "q04_distance_topk_single": distance_topk_single,
    "q05_distance_topk_batch": distance_topk_batch,
    "q06_vector_topk_batch": vector_topk_batch,
    "q07_hybrid_batch": hybrid_batch,
    "q08_semantic_fallback": semantic_fallback,
    "q09_haversine_both": distance_formulas,
    "q10_template_text": template_text,
    "q11_place_document": place_document,
    "q12_query_text": query_text,
    "q13_prompt": prompt,
    "q14_grounding_match": grounding_match,
    "q15_generated_or_template": generated_or_template,
    "q16_parse_generated": parse_generated,
    "q17_pending_embeddings": pending_embeddings,
    "q18_upsert_catalog": upsert_catalog,
    "q19_history_by_user": history_by_user,
    "q20_history_by_place": history_by_place,
    "q21_metro_histogram": metro_histogram,
    "q22_densest_metro_centroid": densest_metro_centroid,
    "q23_stratified_sample": stratified_sample,
    "q24_feature_flatten": feature_flatten,
    "q25_address_pick": address_pick,
    "q26_request_validation": request_validation,
    "q27_eval_counters": eval_counters,
    "q28_eval_metrics": eval_metrics,
    "q29_quality_gates": quality_gates,
    "q30_kpi": kpi,
    "q31_ivf_topk": ivf_topk,
    "q32_embed_backfill": embed_backfill,
    "q33_stream_history": stream_history,
    "q34_rejected_requests": rejected_requests,
    "q35_raw_flatten": raw_flatten,
    "q36_pool_sizes": pool_sizes,
    "q37_catalog_counts": catalog_counts,
    "q38_history_rows": history_rows,
    "q39_sample_rows": sample_rows,
    "q40_persona_answers": persona_answers,
    "q41_vector_round_trip": vector_round_trip,
    "q42_vector_distance": vector_distance,
    "q43_fetch_places": fetch_places,
    "q44_recommend_from_text": recommend_from_text,
    "q45_ivf_recall": ivf_recall,
    "q46_distance_narrowed": distance_narrowed,
    "q47_hybrid_small_blocks": hybrid_small_blocks,
    "q48_copies_answered_once": copies_answered_once,
    "q49_nullable_limits": nullable_limits,
    "q50_bracketed_percentiles": bracketed_percentiles,
    "q51_generated_job": generated_job,
    "q52_ivf_reads": ivf_reads,
    "q53_scored_pairs": scored_pairs,
    "q54_stored_catalog": stored_catalog,
    "q55_stored_upsert": stored_upsert,
    "q56_json_catalog": json_catalog,
    "q57_json_export": json_export,
    "q58_stored_recommendations": stored_recommendations,
    "q59_layout_answers": layout_answers,
    "q60_layout_reads": layout_reads,
    "q61_city_lookup": city_lookup,
    "q62_place_lookup": place_lookup,
    "q63_bucketed_fetch": bucketed_fetch,
    "q64_ledger_job": ledger_job,
    "q65_retried_backfill": retried_backfill,
    "q66_stream_backfill": stream_backfill,
}
