import datetime
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tablescout import schemas
from tablescout.functions.vectors import HashingEmbedder
from tablescout.operators import backfill, history
from tablescout.streaming import history as streams

from helpers import places_df, requests_df

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the embedders below travel with the task

SPOT = {"latitude": 40.7580, "longitude": -73.9855}


def test_visits_and_ratings_are_appended(spark, tmp_path):
    path = str(tmp_path / "log")
    visit = spark.createDataFrame([("u", 1), ("u", 1)], "user_id string, restaurant_id long")
    rating = spark.createDataFrame([("u", 2, 11.5), (None, 3, 1.0)], "user_id string, restaurant_id long, rating_given double")
    history.append_history(history.visits(visit), path)
    history.append_history(history.ratings(rating), path)
    rows = spark.read.parquet(path).orderBy("restaurant_id").collect()
    assert [(r["restaurant_id"], r["interaction_type"], r["rating_given"]) for r in rows] == [
        (1, "VISITED", None), (1, "VISITED", None), (2, "RATED", 11.5)]
    assert all(isinstance(r["interaction_time"], datetime.datetime) for r in rows)


def test_given_time_is_kept(spark):
    at = datetime.datetime(2024, 1, 2, 3, 4, 5)
    df = spark.createDataFrame([("u", 1, at)], "user_id string, restaurant_id long, interaction_time timestamp")
    assert history.visits(df).first()["interaction_time"] == at


def test_lookups(spark, tmp_path):
    rows = [(i, f"u{i % 3}", i % 5, "VISITED", None, datetime.datetime(2024, 1, 1)) for i in range(30)]
    log = spark.createDataFrame(rows, schemas.HISTORY)
    history.write_history(log, str(tmp_path / "clustered"))
    log = spark.read.parquet(str(tmp_path / "clustered"))
    users = spark.createDataFrame([("u1",), ("u1",), ("nobody",)], "user_id string")
    assert history.history_by_user(log, users).count() == 10
    assert history.history_by_place(log, spark.createDataFrame([(2,)], "restaurant_id long")).count() == 6
    places = places_df(spark, [{"id": i} | SPOT for i in range(4)])
    assert history.fetch_places(places, spark.createDataFrame([(3,), (3,), (9,)], "id long")).count() == 1


def write_events(spark, path, rows):
    spark.createDataFrame(rows, schemas.HISTORY).write.mode("append").parquet(path)


@pytest.mark.parametrize("key, expected", [(None, 6), ("event_id", 4)])
def test_stream(spark, tmp_path, key, expected):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    now = datetime.datetime(2024, 1, 1, 12)
    write_events(spark, source, [(1, "u", 1, "VISITED", None, now), (1, "u", 1, "VISITED", None, now),
                                 (2, "u", 1, "RATED", 9.0, now), (3, "u", 1, "DELETED", None, now)])

    def run():
        stream = spark.readStream.schema(schemas.HISTORY).parquet(source)
        streams.stream_history(stream, sink, checkpoint, key).awaitTermination()
        return spark.read.parquet(sink).count()

    assert run() == (3 if key is None else 2)
    write_events(spark, source, [(2, "u", 1, "RATED", 9.0, now), (4, "v", 1, "RATED", 1.0, now), (5, "v", 2, "VISITED", None, now)])
    assert run() == expected  # goes on where it stopped
    assert run() == expected


class Flaky:
    """Fails for texts with a marker until ``tries`` calls have been made on this executor."""

    def __init__(self, marker):
        self.marker, self.calls = marker, 0

    def __call__(self, texts):
        self.calls += 1
        if any(self.marker in t for t in texts) and self.calls < 3:
            raise RuntimeError("busy")
        return [[float(len(texts)), 1.0] for _ in texts]


def broken(texts):
    if any("bad" in t for t in texts):
        raise RuntimeError("quota")
    return HashingEmbedder(4)(texts)


def test_batches_and_retries(spark):
    docs = spark.range(120).coalesce(1).select("id", F.lit("wait").alias("text"))
    rows = backfill.embed_texts(docs, "id", "text", Flaky("wait"), backoff_s=0.0).collect()
    assert len(rows) == 120
    assert {r["embedding"][0] for r in rows} == {50.0, 20.0}
    given_up = backfill.embed_texts(docs, "id", "text", Flaky("wait"), attempts=2, backoff_s=0.0).collect()
    assert sum(r["embedding"] is None for r in given_up) == 50


def test_backfill_is_resumable(spark):
    rows = [{"id": i, "name": "bad" if i == 3 else f"p{i}", "embedding": [9.0, 9.0, 9.0, 9.0] if i == 0 else None} | SPOT
            for i in range(6)]
    places = places_df(spark, rows).repartition(1)
    once = backfill.backfill(places, broken, batch_size=1, attempts=1)
    vectors = {r["id"]: r["embedding"] for r in once.collect()}
    assert vectors[0] == [9.0, 9.0, 9.0, 9.0] and vectors[3] is None and vectors[1] is not None
    assert [r["id"] for r in backfill.pending(once).collect()] == [3]
    twice = {r["id"]: r["embedding"] for r in backfill.backfill(once, HashingEmbedder(4)).collect()}
    assert twice[3] is not None and twice[1] == vectors[1]


@pytest.mark.parametrize("limit", [backfill.BROADCAST_BYTES, -1])
def test_each_text_is_embedded_once(spark, monkeypatch, limit):
    monkeypatch.setattr(backfill, "BROADCAST_BYTES", limit)
    asked = requests_df(spark, [{"qid": i, "preferred_cuisine": c} | SPOT for i, c in enumerate(["a", "a", "bad", None, " "])])
    rows = {r["qid"]: r for r in backfill.embed_distinct(asked, broken, batch_size=1, attempts=1).collect()}
    assert len(rows) == 5 and rows[0]["query_vector"] == rows[1]["query_vector"]
    assert rows[2]["query_vector"] is None
    assert rows[3]["query_text"] == rows[4]["query_text"] == "Looking for a great restaurant."


def test_stream_backfill(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def run(first):
        rows = [{"id": first + i} | SPOT | ({"embedding": [1.0, 0.0]} if i == 2 else {}) for i in range(3)]
        places_df(spark, rows).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schemas.PLACES).parquet(source)
        streams.stream_backfill(stream, HashingEmbedder(8), sink, checkpoint).awaitTermination()
        return sorted(r["id"] for r in spark.read.parquet(sink).collect())

    assert run(0) == [0, 1]
    assert run(10) == [0, 1, 10, 11]


class Unreliable:
    """Fails the first calls for a batch; calls are counted in files, since each runs in a task of its own."""

    def __init__(self, folder, failures):
        self.folder, self.failures = str(folder), failures

    def __call__(self, texts):
        import hashlib
        import os

        path = os.path.join(self.folder, hashlib.md5("|".join(sorted(texts)).encode()).hexdigest())
        calls = os.path.getsize(path) if os.path.exists(path) else 0
        with open(path, "a") as f:
            f.write("x")
        if calls < self.failures:
            raise ConnectionError("not now")
        return HashingEmbedder(8)(texts)


@pytest.mark.parametrize("failures", [0, 2, 3])
def test_stream_retries(spark, tmp_path, failures):
    """Two failures of three calls end with every vector; three leave the rows pending. All as in the batch."""
    from tablescout.streaming import retries

    calls, source, sink, checkpoint = (str(tmp_path / n) for n in ("calls", "source", "sink", "checkpoint"))
    (tmp_path / "calls").mkdir()
    rows = [SPOT | {"id": i, "city": f"town {i % 7}", "embedding": [1.0] if i % 5 == 0 else None} for i in range(40)]
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", 2)
    for part in (rows[:25], rows[25:]):
        places_df(spark, part).write.mode("append").parquet(source)
        stream = session.readStream.schema(schemas.PLACES).parquet(source)
        query = retries.stream_retried_backfill(stream, Unreliable(calls, failures), sink, checkpoint, batch_size=4, attempts=3,
                                                backoff_s=0.05, buckets=3, every_s=0.1)
        retries.finish(query)
    found = sorted((r["id"], list(r["embedding"])) for r in spark.read.parquet(sink).collect())
    batch = backfill.pending_vectors(places_df(spark, rows), HashingEmbedder(8)).collect()
    assert found == (sorted((r["id"], list(r["embedding"])) for r in batch) if failures < 3 else [])
    assert {p.stat().st_size for p in (tmp_path / "calls").iterdir()} == {min(failures + 1, 3)}


def test_stream_retries_outlive_a_restart(spark, tmp_path):
    """Texts that wait when the query is stopped get their vectors after it is started again; an empty folder ends at once."""
    import time

    from tablescout.streaming import retries

    source, sink, checkpoint, calls = (str(tmp_path / n) for n in ("source", "sink", "checkpoint", "calls"))
    for name in ("calls", "nothing"):
        (tmp_path / name).mkdir()
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", 2)

    def start(folder, failures, checkpoint):
        stream = session.readStream.schema(schemas.PLACES).parquet(folder)
        return retries.stream_retried_backfill(stream, Unreliable(calls, failures), sink, checkpoint, attempts=30, backoff_s=0.2, buckets=3, every_s=0.1)

    places_df(spark, [SPOT | {"id": i} for i in range(20)]).write.parquet(source)
    query = start(source, 1000, checkpoint)
    while not query.lastProgress or not query.lastProgress["stateOperators"][0]["numRowsTotal"]:
        time.sleep(0.1)
    query.stop()
    places_df(spark, [SPOT | {"id": 20}]).write.mode("append").parquet(source)
    retries.finish(start(source, 0, checkpoint))
    assert sorted(r["id"] for r in spark.read.parquet(sink).collect()) == list(range(21))
    retries.finish(start(str(tmp_path / "nothing"), 0, f"{checkpoint}-2"))
