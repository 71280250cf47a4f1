"""Bounds that spare comparisons: leaves inside a block, clusters of the vector index."""

import random
from collections import Counter

import numpy as np
import pytest

from tablescout.operators import blocks, geocells, ivf, retrieve

from helpers import answers, expected_answers, places_df, requests_df


def clustered(seed, n, n_requests, dim=12, centres=9, noise=0.15):
    """A crowded spot whose vectors lie around a few centres, and requests like some of its places."""
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((centres, dim))
    pick = random.Random(seed)

    def vector(i):
        return [float(x) for x in np.float32(middle[i % centres] + noise * rng.standard_normal(dim))]

    places = [{"id": i, "latitude": 40.7 + pick.uniform(-0.02, 0.02), "longitude": -74.0 + pick.uniform(-0.02, 0.02),
               "overall_rating": pick.choice([None, 1.0, 3.5, 5.0]), "price_range": pick.choice([None, 1, 2, 4]),
               "embedding": vector(i) if i % 50 else None} for i in range(n)]
    requests = [{"qid": q, "latitude": 40.7 + pick.uniform(-0.02, 0.02), "longitude": -74.0 + pick.uniform(-0.02, 0.02),
                 "max_distance_km": pick.choice([0.4, 3.0, 9.0]), "minimum_rating": pick.choice([0, 0, 3]),
                 "preferred_price_range": pick.choice([0, 0, 2]), "query_vector": vector(q)} for q in range(n_requests)]
    return places, requests


def test_no_member_of_a_leaf_is_nearer_than_its_bound():
    rng = np.random.default_rng(4)
    units = rng.standard_normal((500, 6))
    units[:250] += 2.0
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    asked = rng.standard_normal((40, 6))
    asked /= np.linalg.norm(asked, axis=1, keepdims=True)
    leaves = blocks._leaves(units, rng.standard_normal((500, 2)), 32)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(500)) and max(map(len, leaves)) <= 32
    lower = blocks.leaf_bounds(asked, units, leaves)
    nearest = np.stack([(1 - asked @ units[leaf].T).min(axis=1) for leaf in leaves], axis=1)
    assert (lower <= nearest).all()


@pytest.mark.parametrize("leaf_pairs", [0, 10**12])
def test_leaves_give_the_answers_of_all_pairs(spark, monkeypatch, leaf_pairs):
    monkeypatch.setattr(blocks, "_LEAF_PAIRS", leaf_pairs)
    monkeypatch.setattr(blocks, "LEAF", 24)
    monkeypatch.setattr(blocks, "_VISITORS", 16)
    places, requests = clustered(1, 500, 60)
    places += [dict(places[7], id=1000 + i) for i in range(40)]  # ties, more than the answer holds
    found = retrieve.rerank(retrieve.hybrid_hits(requests_df(spark, requests), places_df(spark, places)))
    assert answers(found) == expected_answers(requests, places)


def test_leaves_spare_comparisons_in_one_metro(spark, monkeypatch):
    monkeypatch.setattr(blocks, "_LEAF_PAIRS", 1000)
    monkeypatch.setattr(blocks, "LEAF", 64)
    places, requests = clustered(2, 3000, 80)
    row = retrieve.scored_pairs(requests_df(spark, requests), places_df(spark, places)).first()
    assert 0 < row["scored"] < 0.8 * row["pairs"]


def hits(df):
    return sorted((r["qid"], r["rn"], r["id"], r["cos_dist"]) for r in df.collect())


def test_certified_answers_are_exact_and_read_few_clusters(spark):
    places, requests = clustered(3, 900, 40, centres=12)
    q, p = requests_df(spark, requests), places_df(spark, places)
    index = ivf.build_ivf(p, n_cells=12)
    found = ivf.certified_hits(q, index, first=1, growth=2)
    assert hits(found.hits) == hits(retrieve.vector_hits(q, p))
    reads = {r["qid"]: r for r in found.reads.collect()}
    assert set(reads) == {r["qid"] for r in requests} and all(r["certified"] for r in reads.values())
    assert sum(r["clusters"] for r in reads.values()) < 0.7 * 12 * len(requests)
    capped = ivf.certified_hits(q, index, first=1, most=1)
    assert all(r["clusters"] == 1 for r in capped.reads.collect())
    some = set(hits(capped.hits.drop("rn").withColumn("rn", capped.hits["qid"] * 0)))
    assert some and not all(r["certified"] for r in capped.reads.collect())


def test_slack_loses_no_more_than_it_says(spark):
    places, requests = clustered(5, 900, 30, centres=12)
    q, p = requests_df(spark, requests), places_df(spark, places)
    index = ivf.build_ivf(p, n_cells=12)
    exact, loose = retrieve.vector_hits(q, p), ivf.certified_hits(q, index, first=1, growth=2, slack=0.1)
    by_rank = {(r["qid"], r["rn"]): r["cos_dist"] for r in exact.collect()}
    near = {(r["qid"], r["rn"]): r["cos_dist"] for r in loose.hits.collect()}
    assert set(near) == set(by_rank) and all(near[k] <= by_rank[k] + 0.1 + 1e-9 for k in near)
    assert sum(r["clusters"] for r in loose.reads.collect()) <= sum(
        r["clusters"] for r in ivf.certified_hits(q, index, first=1, growth=2).reads.collect())


def test_bounds_hold_for_every_member(spark):
    places, requests = clustered(6, 300, 20)
    index = ivf.build_ivf(places_df(spark, places), n_cells=5)
    units = np.array([r["query_vector"] for r in requests])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    bounds = ivf.lower_bounds(units, index)
    for row in index.places.collect():
        vector = np.array(row["embedding"]) / np.linalg.norm(row["embedding"])
        assert (1 - units @ vector >= bounds[:, row["cluster"]]).all()


def test_odd_vectors_and_a_stored_index(spark, tmp_path):
    """Vectors of another length and without direction; the index read back; no places, no requests."""
    places, requests = clustered(7, 200, 15)
    places += [{"id": 900 + i, "latitude": 40.7, "longitude": -74.0, "embedding": v} for i, v in enumerate(
        [[1.0, 2.0], [0.5, -1.0], [0.0] * 12, []])]
    requests += [{"qid": 100, "latitude": 40.7, "longitude": -74.0, "query_vector": [1.0, 1.0]},
                 {"qid": 101, "latitude": 40.7, "longitude": -74.0, "query_vector": [0.0] * 12}]
    q, p = requests_df(spark, requests), places_df(spark, places)
    built = ivf.build_ivf(p, n_cells=4)
    ivf.save_index(built, str(tmp_path / "index"))
    index = ivf.load_index(spark, str(tmp_path / "index"))
    assert np.array_equal(index.members, built.members) and index.members[-1] == 4
    exact = hits(retrieve.vector_hits(q, p))
    assert hits(ivf.certified_hits(q, index).hits) == exact and {h[2] for h in exact if h[0] == 100} == {900, 901}
    assert ivf.certified_hits(q.limit(0), index).hits.isEmpty()
    assert ivf.certified_hits(q, ivf.build_ivf(p.limit(0))).hits.isEmpty()


def counted_hits(monkeypatch):
    """Hits per request that each search merges afterwards, as it goes on."""
    most, whole = [], blocks.blocked_hits

    def watched(*args, **options):
        found = whole(*args, **options)
        most.append(max((r["count"] for r in found.groupBy("qid").count().collect()), default=0))
        return found

    monkeypatch.setattr(blocks, "blocked_hits", watched)
    return most


def test_hits_do_not_grow_with_the_blocks(spark, monkeypatch):
    """However many blocks the places of a cell fill, a request has its best hits once per cell and tile."""
    most = counted_hits(monkeypatch)
    places, requests = clustered(8, 600, 20)
    found = retrieve.retrieve(requests_df(spark, requests), places_df(spark, places), request_block=(4, 8), place_block=(8, 16))
    assert answers(found) == expected_answers(requests, places)
    assert most and max(most) <= 4 * 30


def test_tiles_are_bounded_by_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(blocks, "REQUEST_TILE_BYTES", 1000.0)
    monkeypatch.setattr(blocks, "PLACE_TILE_BYTES", 4000.0)
    places, requests = clustered(9, 300, 30)
    found = retrieve.retrieve(requests_df(spark, requests), places_df(spark, places), narrow_pairs=0)
    assert answers(found) == expected_answers(requests, places)


def test_hits_do_not_grow_with_the_clusters_read(spark, monkeypatch):
    places, requests = clustered(10, 900, 20, centres=30)
    q, p = requests_df(spark, requests), places_df(spark, places)
    exact = hits(retrieve.vector_hits(q, p))
    index = ivf.build_ivf(p, n_cells=30)
    most = counted_hits(monkeypatch)
    assert hits(ivf.certified_hits(q, index, first=30).hits) == exact
    assert most and max(most) <= 4 * 30


@pytest.mark.parametrize("mode", [blocks.VECTOR, blocks.DISTANCE])
def test_later_blocks_give_only_hits_nearer_than_those_found(spark, monkeypatch, mode):
    """A request knows its worst hit of the blocks before, so most blocks add hardly any."""
    given, whole = [], blocks.block_kernel

    def watched(*args, **options):
        score = whole(*args, **options)

        def kept(*tables):
            hits = score(*tables)
            given.append(hits.num_rows)
            return hits
        return kept

    monkeypatch.setattr(blocks, "block_kernel", watched)
    monkeypatch.setattr(blocks, "_LEAF_PAIRS", 0)
    places, requests = clustered(11, 1600, 25)
    requests = [dict(r, max_distance_km=9.0, minimum_rating=0, preferred_price_range=0) for r in requests]
    asked = blocks.prepare_requests(requests_df(spark, requests), mode == blocks.VECTOR).toArrow()
    offered = blocks.vector_places(places_df(spark, places)).toArrow()
    found = blocks.group_kernel(mode, 30, 64, 64)(asked, offered)
    assert found.num_rows == 30 * 25 and sum(given) < 30 * 25 * 8  # 25 blocks of places
    in_one = blocks.group_kernel(mode, 30, 64, 4096)(asked, offered)
    assert sorted(zip(*(found[c].to_pylist() for c in ("qid", "id")))) == sorted(zip(*(in_one[c].to_pylist() for c in ("qid", "id"))))


def test_pairs_told_in_single_precision_are_exact(spark, monkeypatch):
    """Vectors that single precision cannot tell apart, and more copies than an answer holds, in many blocks."""
    monkeypatch.setattr(blocks, "_LEAF_PAIRS", 0)
    monkeypatch.setattr(blocks, "LEAF", 24)
    monkeypatch.setattr(blocks, "_SPARSE", 1)
    places, requests = clustered(12, 700, 40)
    places += [dict(places[7], id=2000 + i) for i in range(70)]
    places += [dict(places[8], id=3000 + i, embedding=[float(np.float32(x * (1 + 1e-7 * (i % 5)))) for x in places[8]["embedding"]]) for i in range(70)]
    found = retrieve.retrieve(requests_df(spark, requests), places_df(spark, places), request_block=(8, 64), place_block=(16, 64))
    assert answers(found) == expected_answers(requests, places)


def test_limits_of_even_and_uneven_rows():
    rng = np.random.default_rng(13)
    for n in (3, 70_000):
        for counts in (rng.integers(0, 9, n), np.r_[rng.integers(0, 9, n - 1), 500]):
            rows = rng.permutation(np.repeat(np.arange(n), counts))
            values = rng.random(len(rows))
            limits = blocks._limits(rows, values, n, 4)
            for row in (0, 1, n - 1):
                own = np.sort(values[rows == row])
                assert limits[row] == (own[3] if len(own) >= 4 else np.inf)


def test_hits_travel_as_one_row_per_request_and_tile(spark, monkeypatch):
    """What a hit has of its request is moved once per list; a request met in several tiles has a list from each."""
    monkeypatch.setattr(blocks, "PLACE_TILE_BYTES", 6000.0)
    places, requests = clustered(14, 300, 12)
    requests += [{"qid": 50, "latitude": 10.0, "longitude": 10.0, "query_vector": requests[0]["query_vector"]}]
    q = blocks.prepare_requests(requests_df(spark, requests), True).withColumn("level", geocells.box_level())
    levels = sorted({r["level"] for r in q.select("level").collect()})

    def found(**options):
        return blocks.blocked_hits(q, blocks.vector_places(places_df(spark, places)), geocells.box_cells(),
                                   geocells.place_cells(levels), mode=blocks.VECTOR, limit=5, **options)

    lists, rows = found(packed=True).collect(), found().collect()
    assert max(len(r["hits"]) for r in lists) == 5 and len(lists) < len(rows) / 3
    assert max(Counter(r["qid"] for r in lists).values()) > 1 and {r["qid"] for r in lists} <= set(range(12))
    assert sorted((r["qid"], r["q_lat"], h["id"], h["cos_dist"], h["p_lon"]) for r in lists for h in r["hits"]) == sorted(
        (r["qid"], r["q_lat"], r["id"], r["cos_dist"], r["p_lon"]) for r in rows)


def test_hits_carried_through_rounds_are_moved_once_a_round(spark, monkeypatch):
    """Between rounds hits are lists of their requests, at most one each; requests that end in an early round keep theirs."""
    kept, whole = [], ivf.materialize

    def watched(df, name):
        written = whole(df, name)
        if name == "ivf-best":
            kept.append(written.groupBy("qid").count().collect())
        return written

    monkeypatch.setattr(ivf, "materialize", watched)
    places, requests = clustered(15, 600, 20, centres=12)
    requests += [{"qid": 60, "latitude": 10.0, "longitude": 10.0, "query_vector": requests[0]["query_vector"]},
                 {"qid": 61, "latitude": 40.7, "longitude": -74.0, "query_vector": [0.0] * 12}]
    q, p = requests_df(spark, requests), places_df(spark, places)
    found = ivf.certified_hits(q, ivf.build_ivf(p, n_cells=12), first=1, growth=2)
    assert hits(found.hits) == hits(retrieve.vector_hits(q, p))
    assert len(kept) > 1 and all(r["count"] == 1 for of_round in kept for r in of_round)


def odd_requests(requests):
    return requests + [{"qid": 60, "latitude": 10.0, "longitude": 10.0, "query_vector": requests[0]["query_vector"]},
                       {"qid": 61, "latitude": 40.7, "longitude": -74.0, "query_vector": [0.0] * 12},
                       {"qid": 62, "latitude": 40.7, "longitude": -74.0, "query_vector": [1.0, 1.0]}]


@pytest.mark.parametrize("options", [{}, {"slack": 0.1}, {"most": 5}])
@pytest.mark.parametrize("noise", [0.15, 3.0])
def test_many_requests_move_once_and_read_the_same(spark, monkeypatch, noise, options):
    """However many rounds there are, a large table of requests meets the places once; hits, and what is read until
    the certificate, are those of the search round by round."""
    for name, value in (("LEAF", 16), ("_CLUSTER_ROWS", 48), ("_SPLIT_BY_FILTER", 0), ("_VISITORS", 8), ("_CHUNK", 8)):
        monkeypatch.setattr(blocks, name, value)
    places, requests = clustered(16, 700, 40, centres=12, noise=noise)
    places += [dict(places[7], id=1000 + i) for i in range(40)]  # ties, more than the answer holds
    places += [{"id": 900 + i, "latitude": 40.7, "longitude": -74.0, "embedding": v} for i, v in enumerate([[1.0, 2.0], [0.0] * 12])]
    q, p = requests_df(spark, odd_requests(requests)), places_df(spark, places)
    index = ivf.build_ivf(p, n_cells=20)
    searches, whole = [], blocks.blocked_hits

    def watched(*args, **kinds):
        searches.append(1)
        return whole(*args, **kinds)

    monkeypatch.setattr(blocks, "blocked_hits", watched)
    found = []
    for most in (10**6, 0):
        monkeypatch.setattr(ivf, "ROUND_REQUESTS", most, raising=False)
        searches.clear()
        result = ivf.certified_hits(q, index, first=1, growth=2, request_block=(4, 16), place_block=(8, 64), **options)
        found.append((hits(result.hits), sorted(map(tuple, result.reads.collect()))))
        assert (len(searches) > 1) == (most > 0)
    assert found[0] == found[1]
    if not options:
        assert found[0][0] == hits(retrieve.vector_hits(q, p))
        assert noise > 1 or any(1 < n < 21 for _, n, _ in found[0][1])


def test_clusters_are_read_in_the_order_of_their_bounds(spark):
    """Each cluster once, equal bounds in the order of the clusters, empty ones never."""
    rng = np.random.default_rng(17)
    centroids = rng.standard_normal((30, 4))
    centroids /= np.linalg.norm(centroids, axis=1, keepdims=True)
    members = np.r_[rng.integers(0, 3, 30), 2]
    index = ivf.VectorIndex(None, centroids, np.r_[rng.uniform(0.0, 0.2, 30), 0.0], np.r_[rng.uniform(0.3, 1.5, 30), np.pi], members)
    vectors = rng.standard_normal((50, 4)).astype(np.float32)
    asked = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "qid long, query_vector array<float>")
    ends = ivf._round_ends(31, 2, 2, None)
    ranked = ivf._with_rounds(asked.coalesce(1), index, ends).toArrow()
    units = np.array(ranked["query_vector"].to_pylist())
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    bounds = ivf.lower_bounds(units, index)
    order = np.argsort(bounds, axis=1, kind="stable")
    assert (np.sort(bounds, axis=1)[:, 1] == 0).all()  # there are equal ones
    rounds = ivf._Pass(index, ends, 0, len(ends), 0.0).rounds(ranked, np.arange(50), units, np.arange(31))[0]
    middle = ivf._Pass(index, ends, 1, 3, 0.0).rounds(ranked, np.arange(50), units, np.arange(31))[0]
    for row in range(50):
        for place, cluster in enumerate(order[row]):
            if members[cluster]:
                number = np.searchsorted(ends, place, side="right")
                assert rounds[row, cluster] == number and middle[row, cluster] == (number - 1 if 1 <= number < 3 else -1)


def test_thousands_of_clusters_are_fitted_by_products(spark, monkeypatch):
    """Beyond a number of clusters MLlib is not asked; the clusters are nearly as tight as the planted ones, the hits exact."""
    places, requests = clustered(18, 900, 20, centres=40)
    places += [dict(places[7], id=1000 + i) for i in range(40)]
    places += [{"id": 2000, "latitude": 40.7, "longitude": -74.0, "embedding": [0.0] * 12}]
    odd = [{"id": 2001, "latitude": 40.7, "longitude": -74.0, "embedding": [float("nan")] * 12}]  # MLlib does not take it
    q, p = requests_df(spark, requests), places_df(spark, places + odd)
    known = [r for r in places if r["embedding"] and any(r["embedding"])]
    vectors = np.array([r["embedding"] for r in known])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)

    def spread(centres):
        return (1 - (vectors @ centres.T).max(axis=1)).sum()

    def unused(**_):
        raise AssertionError("compares vector by vector")

    monkeypatch.setattr(ivf, "KMeans", unused)
    monkeypatch.setattr(ivf, "MLLIB_CLUSTERS", 10, raising=False)
    index = ivf.build_ivf(p, n_cells=40)
    assert index.centroids.shape == (40, 12) and np.allclose(np.linalg.norm(index.centroids, axis=1), 1.0)
    of_centre = [np.mean([vectors[n] for n, r in enumerate(known) if r["id"] % 40 == i], axis=0) for i in range(40)]
    planted = spread(np.array(of_centre) / np.linalg.norm(of_centre, axis=1, keepdims=True))
    assert spread(index.centroids) < 1.5 * planted and index.members.sum() == len(known) + 2
    assert hits(ivf.certified_hits(q, index).hits) == hits(retrieve.vector_hits(q, p))
    same = places_df(spark, [dict(places[7], id=i) for i in range(60)])  # fewer different vectors than clusters
    assert ivf.build_ivf(same, n_cells=40).members.sum() == 60
