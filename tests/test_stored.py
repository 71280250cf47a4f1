"""Stored tables: the catalog's change log, its layout along a curve, buckets, JSON arrays, the ledger of responses."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tablescout import schemas
from tablescout.functions import geo
from tablescout.operators import blocks, ground, history, retrieve
from tablescout.sources import buckets, catalog, json_array, layout, store

from helpers import answers, expected_answers, places_df, requests_df


def rows_of(spark, root):
    return {r["id"]: r for r in store.read(spark, root).collect()}


def place(i, **more):
    return {"id": i, "latitude": 40.0 + i / 100, "longitude": -74.0, "name": f"n{i}"} | more


def test_changes_are_as_large_as_what_changed(spark, tmp_path):
    root = str(tmp_path / "catalog")
    assert store.read(spark, root).isEmpty() and store.snapshot(spark, root) == store.Snapshot()
    assert store.load_if_empty(places_df(spark, [place(i, phone="p", embedding=[1.0, float(i)]) for i in range(100)]), root)
    assert not store.load_if_empty(places_df(spark, [place(7)]), root)
    assert store.upsert(places_df(spark, [place(3, name="new 3"), place(200, name="added")]), root) == 2
    assert store.upsert(places_df(spark, [place(200, name="added again", city="C"), place(4)]), root) == 2
    assert store.write_vectors(spark.createDataFrame([(200, [5.0, 6.0]), (5, [7.0, 8.0]), (6, None)], "id long, embedding array<float>"), root) == 2
    now = store.snapshot(spark, root)
    assert (now.base_rows, now.delta_rows, len(now.deltas), now.version) == (100, 6, 3, 4)
    rows = rows_of(spark, root)
    assert len(rows) == 101 and store.read(spark, root).count() == 101
    assert (rows[3]["name"], list(rows[3]["embedding"])) == ("new 3", [1.0, 3.0])  # an update keeps the vector
    assert (rows[200]["name"], rows[200]["city"], list(rows[200]["embedding"])) == ("added again", "C", [5.0, 6.0])
    assert rows[4]["phone"] is None and list(rows[5]["embedding"]) == [7.0, 8.0] and list(rows[6]["embedding"]) == [1.0, 6.0]
    assert not store.compact(spark, root)  # six of a hundred
    assert store.compact(spark, root, share=0.01)
    after = store.snapshot(spark, root)
    assert (after.base_rows, after.deltas) == (101, ()) and rows_of(spark, root) == rows
    assert not store.compact(spark, root, share=0.0)


def test_changes_too_large_for_a_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(store, "BROADCAST_IDS", 0)
    root = str(tmp_path / "catalog")
    store.replace_all(places_df(spark, [place(i) for i in range(20)]), root)
    store.upsert(places_df(spark, [place(i, name="x") for i in range(10, 30)]), root)
    assert {i: r["name"] for i, r in rows_of(spark, root).items()} == {i: f"n{i}" if i < 10 else "x" for i in range(30)}


def test_later_rows_of_a_load_win_and_absent_columns_are_empty(spark, tmp_path):
    root = str(tmp_path / "catalog")
    store.replace_all(places_df(spark, [place(1, phone="1")]), root)
    new = spark.createDataFrame([(1, "late", 1.0, 2.0, 9), (1, "early", 1.0, 2.0, 3)], "id long, name string, latitude double, longitude double, input_pos int")
    assert store.upsert(new, root) == 1
    row = rows_of(spark, root)[1]
    assert (row["name"], row["phone"]) == ("late", None)
    assert store.upsert(new.limit(0), root) == 0 and store.snapshot(spark, root).version == 2


def test_commits_of_stopped_and_of_faster_writers(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "catalog")
    store.replace_all(places_df(spark, [place(1)]), root)
    (tmp_path / "catalog" / "log" / f"{2:020d}.json").write_text("")  # stopped while it committed
    assert set(rows_of(spark, root)) == {1}
    store.upsert(places_df(spark, [place(2)]), root)
    assert set(rows_of(spark, root)) == {1, 2} and store.snapshot(spark, root).version == 3
    listed = store._commits
    stale = [True]

    def late(spark, root):  # another writer commits between the look at the log and the commit
        names = listed(spark, root)
        return names[1:] if stale and stale.pop() else names

    monkeypatch.setattr(store, "_commits", late)
    store.write_vectors(spark.createDataFrame([(2, [1.0])], "id long, embedding array<float>"), root)
    monkeypatch.setattr(store, "_commits", listed)
    assert list(rows_of(spark, root)[2]["embedding"]) == [1.0] and store.snapshot(spark, root).version == 4


def world(seed, n):
    rng = random.Random(seed)
    rows = [place(i, latitude=rng.uniform(-89, 89), longitude=rng.uniform(-179, 179), city=rng.choice(["A", "B", None]),
                  state=rng.choice(["S", None])) for i in range(n)]
    rows += [place(5000 + i, latitude=40.7 + rng.uniform(-0.2, 0.2), longitude=-74.0 + rng.uniform(-0.2, 0.2), city="NY", state="N",
                   embedding=[rng.gauss(0, 1), 1.0]) for i in range(n)]
    return rows


def boxes():
    near = [{"qid": i, "latitude": 40.7 + i / 50, "longitude": -74.0, "max_distance_km": 1.0 + i} for i in range(4)]
    odd = [(89.9, 10.0, 400.0), (-89.99, 0.0, 3.0), (0.0, 179.95, 30.0), (10.0, -180.0, 500.0), (0.0, 0.0, 500.0), (95.0, 200.0, 9.0)]
    return near + [{"qid": 10 + i, "latitude": a, "longitude": b, "max_distance_km": c} for i, (a, b, c) in enumerate(odd)]


@pytest.mark.parametrize("options", [{}, {"most_squares": 8, "most_ranges": 2}])
def test_boxes_read_all_they_need_and_little_else(spark, tmp_path, options):
    rows, path = world(1, 400), str(tmp_path / "places")
    assert layout.write_layout(places_df(spark, rows), path, files=16) == 800
    stored = spark.read.parquet(path)
    assert stored.where(F.col("curve") != layout.curve_key(F.col("latitude"), F.col("longitude"))).isEmpty()
    for asked in ([b] for b in boxes()) if not options else [boxes()]:
        requests = requests_df(spark, asked)
        found = {r["id"] for r in layout.places_in_boxes(spark, path, requests, **options).collect()}
        box = blocks.prepare_requests(requests, False).collect()
        needed = {r["id"] for r in rows for b in box
                  if b["lat_min"] <= r["latitude"] <= b["lat_max"] and b["lon_min"] <= r["longitude"] <= b["lon_max"]}
        assert needed <= found
        if asked[0]["qid"] == 0 and not options:
            share = layout.read_share(spark, path, requests).first()
            assert share["files"] == 16 and share["files_read"] <= 8 and share["rows_read"] == len(found) < 200
    near = [b for b in boxes() if b["qid"] < 4]
    ranked = retrieve.retrieve(requests_df(spark, near), layout.places_in_boxes(spark, path, requests_df(spark, near), **options))
    assert answers(ranked) == expected_answers(near, rows)


def test_ranges_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "places")
    layout.write_layout(places_df(spark, world(2, 100)), path, files=8)
    plan = layout.places_in_boxes(spark, path, requests_df(spark, boxes()[:1]))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(curve" in plan and "LessThanOrEqual(curve" in plan
    assert layout.places_in_boxes(spark, path, requests_df(spark, [])).isEmpty()
    layout.write_layout(places_df(spark, []), str(tmp_path / "none"))
    assert layout.places_in_boxes(spark, str(tmp_path / "none"), requests_df(spark, boxes())).isEmpty()


def test_cities(spark, tmp_path):
    rows, path = world(3, 200), str(tmp_path / "places")
    layout.write_layout(places_df(spark, rows), path, files=8)
    for city, state in (("NY", "N"), (None, "S"), (None, None), ("nowhere", "N")):
        found = layout.places_in_city(spark, path, city, state)
        assert {r["id"] for r in found.collect()} == {r["id"] for r in rows if (r["city"], r["state"]) == (city, state)}


def test_the_curve_keeps_squares_together():
    assert layout._merged([(5, 9), (0, 3), (4, 4), (20, 30), (28, 40), (100, 101)], 9) == [(0, 9), (20, 40), (100, 101)]
    assert layout._merged([(0, 1), (5, 6), (100, 101)], 2) == [(0, 6), (100, 101)]
    assert layout._merged([], 2) == []


def test_bucketed_joins_do_not_move_the_catalog(spark, tmp_path):
    spark.sql("drop table if exists bucketed_places")
    places = buckets.save_bucketed(places_df(spark, [place(i) for i in range(500)]), "bucketed_places", str(tmp_path / "b"), 8)
    wanted = spark.createDataFrame([(i % 50 * 7,) for i in range(300)] + [(None,), (9999,)], "id long")
    found = buckets.matching(places, wanted)
    assert sorted(r["id"] for r in found.collect()) == [i * 7 for i in range(50)]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    physical = found._jdf.queryExecution().executedPlan().toString()
    before = physical[: physical.index("SelectedBucketsCount")].splitlines()
    scan = len(before[-1]) - len(before[-1].lstrip(" :+-"))
    above, depth = [], scan
    for line in reversed(before[:-1]):
        own = len(line) - len(line.lstrip(" :+-"))
        if own < depth:
            above.append(line)
            depth = own
    assert "Join" in plan and above and not any("Exchange" in line for line in above)


MERCHANTS = [
    {"_id": 1, "name": 'br}ace "quoted" \\', "description": "a,{[}]b", "cuisines": ["x}", "]"], "features": [{"types": ["{", "\\"]}, {"types": None}]},
    {"_id": 2, "name": "é \u1234 \n", "description": "", "geoLocation": {"coordinates": [1.5, -2]}},
    {"_id": 3, "name": None, "location": {"city": "C", "address": {"city": "}{"}}, "unknown": {"deep": [{"a": {"b": [1, {}]}}]}},
    {"_id": 4, "name": "\\\\\"", "geoLocation": {"coordinates": ["a", 2]}},
]


@pytest.mark.parametrize("indent", [None, 2])
def test_arrays_are_read_by_many_tasks(spark, tmp_path, indent):
    rng = random.Random(4)
    rows = [dict(rng.choice(MERCHANTS), _id=i, description="".join(rng.choice('ab{}[]",\\ \n') for _ in range(rng.randint(0, 60)))) for i in range(300)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(rows[:250], indent=indent, ensure_ascii=False) + "\n")
    (tmp_path / "in" / "b.json").write_text(json.dumps(rows[250:], indent=indent))
    (tmp_path / "in" / "c.json").write_text("[]")
    (tmp_path / "in" / "d.json").write_text(" [ ] \n")
    whole = catalog.read_raw_merchants(spark, str(tmp_path / "in")).drop("input_pos")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.option("lineSep", "}").text(str(tmp_path / "in")).rdd.getNumPartitions() > 5
        found = catalog.read_raw_array(spark, str(tmp_path / "in")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert [r["_id"] for r in sorted(found, key=lambda r: tuple(r["input_pos"]))] == list(range(300))
    assert found[0].__fields__ == [*whole.columns, "input_pos"]
    assert sorted(repr(tuple(r)[:-1]) for r in found) == sorted(repr(tuple(r)) for r in whole.collect())


def test_a_broken_array_fails_the_load(spark, tmp_path):
    (tmp_path / "bad.json").write_text('[{"_id": 1}, {"_id": "x"}]')
    with pytest.raises(Exception):
        json_array.read_json_array(spark, str(tmp_path / "bad.json"), schemas.RAW_MERCHANT, "FAILFAST").collect()


def test_prompts_are_generated_once(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def generator(prompt):
        with open(calls, "a") as file:
            file.write(prompt + "\n")
        if prompt == "fails":
            raise ConnectionError
        return prompt.upper()

    def run(prompts, version="v/1"):
        open(calls, "w").close()
        df = spark.createDataFrame(list(enumerate(prompts)), "qid long, prompt string")
        found = {r["qid"]: r["body"] for r in ground.answer_prompts(df, generator, str(tmp_path / "ledger"), version).collect()}
        return found, sorted(open(calls).read().split())

    assert run(["a", "b", "a", "fails"]) == ({0: "A", 1: "B", 2: "A", 3: None}, ["a", "b", "fails"])
    assert run(["b", "c", "fails"]) == ({0: "B", 1: "C", 2: None}, ["c", "fails"])
    assert run(["a", "b", "c"]) == ({0: "A", 1: "B", 2: "C"}, [])
    assert run(["a"], "v2") == ({0: "A"}, ["a"])


def test_events_of_a_few_places(spark, tmp_path):
    path = str(tmp_path / "log")
    log = spark.range(4000).selectExpr("id as event_id", "cast(id % 40 as string) as user_id", "id * 7919 % 1000 as restaurant_id",
                                       "'VISITED' as interaction_type", "cast(null as double) as rating_given",
                                       "timestamp_seconds(id) as interaction_time")
    history.write_history(log, path, distinct_places=1000)
    stored = spark.read.schema(schemas.HISTORY).parquet(path)
    found = history.place_events(stored, [7, 919, 5000])
    assert sorted(r["event_id"] for r in found.collect()) == [i for i in range(4000) if i * 7919 % 1000 in (7, 919)]
    assert "In(restaurant_id" in found._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        history.place_events(stored, list(range(11)))


def test_files_are_bounded_by_their_bytes(spark, tmp_path, monkeypatch):
    """A few places with long texts fill several files, so no task is given all of them."""
    monkeypatch.setattr(layout, "FILE_BYTES", 50_000)
    places = places_df(spark, [{"id": i, "latitude": 40.0 + i / 100, "longitude": -74.0, "description": "word " * 400,
                                "embedding": [1.0] * 8} for i in range(100)])
    assert layout.write_layout(places, str(tmp_path / "long")) == 100
    rows = [r["rows"] for r in spark.read.parquet(str(tmp_path / "long" / "_files")).collect()]
    assert len(rows) >= 4 and max(rows) < 50
