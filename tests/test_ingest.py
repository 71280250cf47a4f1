import json

import pytest
from pyspark.sql import functions as F

from tablescout import schemas
from tablescout.functions.vectors import HashingEmbedder
from tablescout.operators import ingest, sampling
from tablescout.plans import catalog as jobs
from tablescout.sources import catalog

from helpers import places_df

MERCHANTS = [
    {"_id": 1, "name": " Zen ", "description": " Fresh. ", "cuisines": ["Sushi"], "priceRange": 2,
     "rating": {"overallRating": 4.5, "numberOfRatings": 7}, "geoLocation": {"coordinates": [-73.9, 40.7]},
     "location": {"neighborhood": "Soho", "city": "Outer", "state": "S", "address": {"city": "", "state": "NY"}},
     "features": [{"types": [" Patio ", "Not Applicable", None, "Bar"]}, {"types": ["Patio", ""]}, {"types": None}, None]},
    {"_id": 2, "name": "One coordinate", "description": "x", "geoLocation": {"coordinates": [-73.9]}},
    {"_id": 3, "name": "Text coordinate", "description": "x", "geoLocation": {"coordinates": ["a", 40.7]}},
    {"_id": 4, "name": "Blank", "description": "  ", "geoLocation": {"coordinates": [-73.9, 40.7]}},
    {"_id": 5, "name": "Plain", "description": "x", "geoLocation": {"coordinates": [1, 2]}, "unknown": {"a": 1}},
    {"_id": 6, "name": "No point", "description": "x"},
]


@pytest.fixture
def export(tmp_path):
    path = tmp_path / "export.json"
    path.write_text(json.dumps(MERCHANTS))
    return str(path)


def test_raw_export_to_flat_catalog(spark, export, tmp_path):
    raw = catalog.read_raw_merchants(spark, export)
    assert sampling.pool_sizes(raw).first().asDict() == {"total": 6, "usable": 2}
    flat = ingest.flatten_merchants(ingest.usable(raw))
    zen, plain = flat.orderBy("id").collect()
    assert (zen["name"], zen["description"], zen["latitude"], zen["longitude"]) == ("Zen", "Fresh.", 40.7, -73.9)
    assert (zen["city"], zen["state"], zen["neighborhood"]) == ("Outer", "NY", "Soho")
    assert zen["features"] == ["Patio", "Bar"]
    assert (plain["cuisines"], plain["features"], plain["latitude"]) == ([], [], 2.0)
    catalog.write_json(flat, str(tmp_path / "flat"))
    again = catalog.read_catalog(spark, str(tmp_path / "flat"), multi_line=False)
    assert sorted(r["id"] for r in again.collect()) == [1, 5]


def test_json_lines_of_the_export_read_the_same(spark, export, tmp_path):
    catalog.write_json(catalog.read_raw_merchants(spark, export).drop("input_pos"), str(tmp_path / "lines"))
    lines = catalog.read_raw_merchants(spark, str(tmp_path / "lines"), multi_line=False)
    assert sampling.pool_sizes(lines).first()["usable"] == 2


def test_catalog_jobs(spark, export, tmp_path):
    centre = jobs.sample_export(spark, export, str(tmp_path / "sample"), size=10)
    assert (centre.first()["city"], centre.first()["latitude"]) == ("Outer", 40.7)
    sample = catalog.read_catalog(spark, str(tmp_path / "sample"), multi_line=False)
    assert sorted(r["id"] for r in sample.collect()) == [1, 5]
    root = str(tmp_path / "places")
    assert [r["embedding"] for r in jobs.refresh(spark, str(tmp_path / "sample"), root, multi_line=False).collect()] == [None, None]
    places = jobs.refresh(spark, str(tmp_path / "sample"), root, HashingEmbedder(8), multi_line=False)
    assert [len(r["embedding"]) for r in places.collect()] == [8, 8]


def test_features_are_capped(spark):
    types = [f"t{i}" for i in range(40)] + ["t0"]
    df = spark.createDataFrame([([(types,)],)], "features array<struct<types:array<string>>>")
    assert df.select(ingest.flatten_features(F.col("features"))).first()[0] == types[:25]


def test_broken_catalog_fails_the_load(spark, tmp_path):
    (tmp_path / "bad.json").write_text('[{"id": 1, "name": "a", "latitude": "north", "longitude": 1}]')
    with pytest.raises(Exception):
        catalog.read_catalog(spark, str(tmp_path / "bad.json")).collect()


def flat_file(tmp_path, name, rows):
    (tmp_path / name).write_text(json.dumps(rows))
    return str(tmp_path / name)


def test_ingest_upserts_and_keeps_vectors(spark, tmp_path):
    root = str(tmp_path / "catalog")
    assert catalog.load_places(spark, root).isEmpty()
    first = flat_file(tmp_path, "first.json", [
        {"id": 1, "name": "A", "latitude": 1.0, "longitude": 1.0, "cuisines": ["x", None], "extra": 1},
        {"id": 1, "name": "A later", "latitude": 1.0, "longitude": 1.0},
        {"id": 2, "name": "  ", "latitude": 1.0, "longitude": 1.0}, {"id": None, "name": "C", "latitude": 1.0, "longitude": 1.0},
        {"id": 4, "name": "D", "longitude": 1.0}, {"id": 5, "name": "E", "latitude": 2.0, "longitude": 2.0, "cuisines": ["y", None]},
    ])
    assert ingest.ingest(spark, first, root)
    rows = {r["id"]: r for r in catalog.load_places(spark, root).collect()}
    assert {i: r["name"] for i, r in rows.items()} == {1: "A later", 5: "E"}
    assert rows[5]["cuisines"] == ["y"] and rows[1]["features"] == []
    assert not ingest.ingest(spark, first, root)  # not empty any more

    embedded = catalog.load_places(spark, root).withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    catalog.save_places(embedded, root)
    second = flat_file(tmp_path, "second.json", [
        {"id": 5, "name": "E2", "latitude": 3.0, "longitude": 3.0}, {"id": 9, "name": "N", "latitude": 3.0, "longitude": 3.0}])
    assert ingest.ingest(spark, second, root, only_if_empty=False)
    rows = {r["id"]: r for r in catalog.load_places(spark, root).collect()}
    assert {i: r["name"] for i, r in rows.items()} == {1: "A later", 5: "E2", 9: "N"}
    assert rows[5]["embedding"] == [1.0] and rows[9]["embedding"] is None


def test_unfinished_version_is_invisible(spark, tmp_path):
    root = tmp_path / "catalog"
    catalog.save_places(places_df(spark, [{"id": 1, "latitude": 1.0, "longitude": 2.0}]), str(root))
    (root / "v99999999999999999999-torn").mkdir()
    assert catalog.load_places(spark, str(root)).count() == 1


METROS = [("NY", "N", 700), ("LA", None, 600), (None, None, 500), ("SF", "C", 100)]


def metro_places(spark):
    rows, i = [], 0
    for city, state, n in METROS:
        for _ in range(n):
            rows.append({"id": i, "city": city, "state": state, "latitude": float(i % 7), "longitude": float(i % 3)})
            i += 1
    return places_df(spark, rows)


def test_sample_sizes(spark):
    places = metro_places(spark)
    hist = {(r["city"], r["state"]): r["n"] for r in sampling.metro_histogram(places).collect()}
    assert hist == {(c, s): n for c, s, n in METROS}
    sample = sampling.sample_catalog(places, size=900)
    counts = {r["densest"]: r["count"] for r in sample.groupBy("densest").count().collect()}
    assert counts == {True: 400, False: 500}
    assert sample.select("id").distinct().count() == 900
    assert {r["densest"]: r["count"] for r in sampling.sample_catalog(places, size=3000).groupBy("densest").count().collect()} \
        == {True: 700, False: 1200}
    assert sampling.sample_catalog(places, size=300).count() == 400  # the floor of the densest metro wins
    same = sampling.sample_catalog(places.repartition(5), size=900)
    assert sorted(r["id"] for r in same.collect()) == sorted(r["id"] for r in sample.collect())
    other = sampling.sample_catalog(places, size=900, seed=7)
    assert sorted(r["id"] for r in other.collect()) != sorted(r["id"] for r in sample.collect())


def test_densest_metro_ties_go_to_the_first_seen(spark):
    rows = [{"id": i, "city": c, "latitude": float(i), "longitude": 0.0} for i, c in enumerate([None, "B", "B", None])]
    places = places_df(spark, rows)
    top = sampling.densest_metro(places).first()
    assert (top["city"], top["n"]) == (None, 2)
    assert sampling.centroid(places).first()["latitude"] == 1.5


def test_sample_of_nothing(spark):
    assert sampling.sample_catalog(places_df(spark, [])).isEmpty()


def test_schema_of_places(spark, tmp_path):
    catalog.save_places(places_df(spark, [{"id": 1, "latitude": 1.0, "longitude": 2.0}]), str(tmp_path / "c"))
    assert catalog.load_places(spark, str(tmp_path / "c")).columns == schemas.PLACES.fieldNames()


def test_later_file_wins(spark, tmp_path):
    """Files count in the order of their names, though Spark reads the larger one first."""
    (tmp_path / "in").mkdir()
    row = {"name": "first", "latitude": 1.0, "longitude": 2.0}
    (tmp_path / "in" / "a.json").write_text(json.dumps([{"id": 1} | row]))
    more = [{"id": i} | row | {"name": "second", "description": "x" * 500} for i in range(1, 200)]
    (tmp_path / "in" / "b.json").write_text(json.dumps(more))
    (tmp_path / "in" / "c.json").write_text(json.dumps([{"id": 2} | row | {"name": "third"}]))
    loaded = ingest.to_places(ingest.valid_places(catalog.read_catalog(spark, str(tmp_path / "in"))))
    merged = ingest.upsert_places(spark.createDataFrame([], schemas.PLACES), loaded)
    names = {r["id"]: r["name"] for r in merged.collect()}
    assert names[1] == "second" and names[2] == "third" and names[3] == "second" and len(names) == 199
