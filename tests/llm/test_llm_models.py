"""Toxicity, periodic runs and whitening against plain readings and planted cases."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

import samples
from tablescout.llm import jacobi, runs, toxicity, whitening
from tablescout.llm.words import mix


def plain_runs(words):
    """All runs, by trying every period at every place."""
    found = set()
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            own = words[i : i + length]
            if length >= max(6, 4 * q) and not any(own[p:] == own[:-p] for p in range(1, q)):
                found.add((i, length, q))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    """The contract of the query, word by word."""
    words = samples.words(text)
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *top, None if top[0] is None else 1000 * top[1] // top[2],
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(), kept)


def periodic_texts():
    rng = random.Random(3)
    texts = [None, "", " \n", "a " * 6, "a " * 5, "a b " * 4 + "a", "x " * 40 + "y " * 40, "a a b a a b a a b a a b c"]
    for k in range(60):
        words = []
        while len(words) < 40 + 6 * k:
            block = [rng.choice("ab" if rng.random() < 0.5 else "abcdefgh") for _ in range(rng.randint(1, 45))]
            words += [block[i % len(block)] for i in range(rng.randint(len(block), 9 * len(block)))]
            words += [rng.choice("abxyz") for _ in range(rng.randint(0, 4))]
        texts.append("  ".join(words) if k % 2 else "\n".join(words))
    return texts


def test_periodic_runs(spark):
    texts = periodic_texts()
    # Numbers whose checksum makes the documents periodic, and others; a repeated row; no number.
    marked = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10 == 0][: len(texts)]
    rows = [(i, t, "s") for i, t in zip(marked, texts)] + [(-1 - i, t, "s") for i, t in enumerate(texts)]
    rows += [(None, texts[20], None), (marked[30], texts[30], "s")]
    expected = sorted((plain_row(i, t) for i, t, _ in rows), key=repr)
    assert sum(r[1] for r in expected) > 200 and any((r[4] or 0) > 32 for r in expected)
    found = runs.collapse_runs(samples.documents(spark, rows).repartition(3))
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "collapsed_text"]
    assert sorted((tuple(r) for r in found.select(*columns).collect()), key=repr) == expected
    listed = found.where("n_runs > 0").select("runs", "runs_sha256").first()
    assert hashlib.sha256("".join(f"{r.start},{r.length},{r.period}\n" for r in listed[0]).encode()).hexdigest() == listed[1]


def test_periodic_runs_of_odd_rows(spark):
    rows = [r for r in samples.odd_rows() if r[0] != 5]
    expected = sorted((plain_row(i, t)[:-1] for i, t, _ in rows), key=repr)
    found = runs.collapse_runs(samples.documents(spark, rows), outputs=False)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected
    assert runs.collapse_runs(samples.documents(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("period", [9, 100, 4097, 15000])
def test_long_periods_in_a_long_text(period):
    rng = np.random.default_rng(period)
    block = rng.integers(0, 3, period)
    codes = np.concatenate([rng.integers(3, 9, 501), block, block, block, block, block[:1], [99], rng.integers(3, 9, 700)])
    found = [tuple(int(x) for x in r) for r in zip(*runs.find_runs(mix(codes.astype(np.uint64))))]
    assert (501, 4 * period + 1, period) in found


@pytest.mark.parametrize("window", [2, 8, 32])
def test_minimizers_are_the_minima_of_windows(window):
    values = mix(np.random.default_rng(1).integers(0, 40, 300).astype(np.uint64))
    expected = {i + j for i in range(300 - window + 1) for j in range(window) if values[i + j] == values[i : i + window].min()}
    assert set(runs.minimizers(values, window).tolist()) == expected


def matrices():
    rng = np.random.default_rng(5)
    data = np.floor(rng.standard_normal((400, 40)) * 30)
    low = rng.standard_normal((30, 2))
    yield "near equal", np.cov(data.T, bias=True)
    yield "rank two", low @ low.T
    yield "equal", np.eye(12)
    yield "repeated", np.diag([5.0, 5, 5, 5, 5, 1, 0, 0])
    yield "spread", np.diag(10.0 ** -np.arange(30))
    yield "small", np.array([[2.0, 1], [1, 3]])


@pytest.mark.parametrize("name, matrix", list(matrices()))
def test_leading_eigenpairs(name, matrix):
    values, vectors = jacobi.leading(lambda block: matrix @ block, len(matrix), 4)
    exact = np.linalg.eigvalsh(matrix)[::-1][: len(values)]
    assert len(values) == min(4, len(matrix)) and np.abs(values - exact).max() < 1e-13 * exact[0]
    assert np.linalg.norm(matrix @ vectors - vectors * values, axis=0).max() < 1e-12 * exact[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(2)
    matrix = rng.standard_normal((20, 20))
    matrix = matrix + matrix.T
    right = rng.standard_normal((20, 3))
    found = jacobi.minres(lambda block: matrix @ block, right, steps=60, enough=1e-12)
    assert np.abs(matrix @ found - right).max() < 1e-6


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                        T.StructField("x", T.StringType()), T.StructField("component", T.StringType()), T.StructField("n", T.StringType())])


def vectors_df(spark, rows):
    return spark.createDataFrame([(i, v, "x", "c", "n") for i, v in rows], VECTORS)


def odd_vectors():
    rng = np.random.default_rng(9)
    rows = [(i, rng.standard_normal(6).astype(np.float32).tolist()) for i in range(80)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # copies count once
    rows += [(None, rows[5][1]), (7, rows[9][1]), (200, None), (201, []), (202, [1.0] * 5 + [None]), (203, [float("nan")] * 6),
             (204, [float("inf")] + [0.0] * 5), (205, [1.0] * 7), (206, [1e30] * 6), (207, [0.0] * 6), (208, [-0.0] * 6)]
    return rows


def test_whitening(spark):
    rows = odd_vectors()
    usable = [(i, v) for i, v in rows if v and len(v) == 6 and all(c is not None and np.isfinite(c) and abs(c) < 2**32 for c in v)]
    x = np.array([np.floor(256 * np.array(v, dtype=np.float64)) for _, v in usable]) + 0.0
    fitted = np.unique(x, axis=0)
    n, sums = len(fitted), fitted.sum(axis=0).astype(int)
    values, axes = np.linalg.eigh(np.cov(fitted.T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    expected = (x - fitted.mean(axis=0)) @ axes[:, :4] / np.sqrt(values[:4])
    found = whitening.whiten(vectors_df(spark, rows).repartition(3)).toPandas()
    assert len(found) == 4 * len(usable) and set(found["n"]) == {n}
    assert found["identity_error"].nunique() == 1 and found["identity_error"].iloc[0] < 1e-12
    for k in range(4):
        own = found[found["component"] == k + 1]
        assert np.allclose(own["explained"], values[k] / values.sum(), rtol=1e-10)
        sign = np.sign(axes[np.abs(axes[:, k]).argmax(), k])
        order = lambda ids, numbers: sorted(zip([-1 if np.isnan(i) else i for i in ids], numbers))
        pairs = zip(order(own["vec_id"], own["whitened"]), order([np.nan if i is None else i for i, _ in usable], sign * expected[:, k]))
        assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-9 for a, b in pairs)
    exact = sorted(sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x)
    assert sorted(found[found["component"] == 1]["deviation"]) == exact


def test_whitening_without_variance(spark):
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None)], [(1, [0.5, 1.0]), (2, [0.5, 1.0])]):
        found = whitening.whiten(vectors_df(spark, rows))
        assert found.columns == columns and found.collect() == []
    line = [(i, [float(i), 2.0 * i, 1.0]) for i in range(5)]  # variance along one direction only
    assert {r["component"] for r in whitening.whiten(vectors_df(spark, line)).collect()} == {1}


def test_deviations_are_exact_or_null():
    x = np.array([[2**39, -(2**39)], [3, 4]], dtype=np.int64)
    small = whitening.deviations(x[1:], 10, (5, 6))
    assert small == [(30 - 5) ** 2 + (40 - 6) ** 2]
    assert whitening.deviations(x, 10, (5, 6)) == [None, small[0]]


LABELS = "doc_id long, quality int, toxic int"


def insulting(spark, n=900):
    """Every fifth document is toxic; two thirds of the labels are there."""
    rng = random.Random(8)
    common = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(common) for _ in range(rng.randint(20, 120))]
        if i % 5 == 0:
            for _ in range(rng.randint(2, 5)):  # whole words, and compounds of a root
                words[rng.randrange(len(words))] = rng.choice(["zutrash", "Zuscum!", "zuroot" + rng.choice(common)])
        rows.append((i, " ".join(words), "s"))
        if i % 3:
            labels.append((i, 1, int(i % 5 == 0)))
    return rows, labels


@pytest.fixture(scope="module")
def scored(spark):
    rows, labels = insulting(spark)
    rows += [(None, None, None), (None, "zutrash zuscum zutrash", None), (5000, "", "s"), (5001, None, "s"), (0, rows[0][1], "s"),
             (5002, samples.prose(3, 20_000) + " zutrash zuscum zurootabc", "s")]
    docs, marks = samples.documents(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (7, None, None)], LABELS)
    return rows, docs, marks, toxicity.toxicity(docs, marks).collect()


def test_toxicity_of_held_out_documents(scored):
    rows, _, _, found = scored
    assert len(found) == len(rows)
    for r in found:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    held = [r for r in found if r["held_out"] and r["doc_id"] < 900]
    assert sum(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held) >= 0.97 * len(held)
    assert {r["predicted"] for r in found if r["doc_id"] in (5000, 5001)} == {0}
    assert {r["predicted"] for r in found if r["doc_id"] == 5002} == {1}
    assert sorted(r["predicted"] for r in found if r["doc_id"] is None) == [0, 1]


def test_toxicity_learns_nothing_from_the_held_out_fold(spark, scored):
    """Labels of held-out documents, languages, sources and the order of the rows change no score."""
    _, docs, marks, found = scored
    other = marks.selectExpr("doc_id", "quality", "if(pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0, 1 - toxic, toxic) as toxic")
    again = toxicity.toxicity(docs.selectExpr("doc_id", "text", "'fr' as lang", "'z' as source").repartition(5), other).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))


def test_toxicity_without_examples(spark, scored):
    _, docs, marks, _ = scored
    for labels in (marks.limit(0), marks.where("toxic = 0")):
        assert {(r["score"], r["predicted"]) for r in toxicity.toxicity(docs, labels).collect()} == {(0.0, 0)}
    assert toxicity.toxicity(docs.limit(0), marks).collect() == []


def test_probabilities_are_the_formula():
    """Each feature counts once, whatever its number; the mean of the classifiers is taken."""
    texts = pa.array(["Abcd abcd, xyz", "xyz", None])
    rows, hashes = (np.concatenate(x) for x in zip(*toxicity._feature_sets(texts)))
    assert len(set(zip(rows.tolist(), hashes.tolist()))) == len(rows)
    both = np.intersect1d(hashes[rows == 0], hashes[rows == 1])
    alone = np.setdiff1d(hashes[rows == 0], both)
    assert len(both) == 2 and len(alone) == 3  # xyz and its beginning; abcd, abc and itself as a beginning
    features = np.sort(np.array([alone[0], both[0]], dtype=np.uint64))
    weights = np.array([[1.0, 2.0], [-3.0, 0.5]])
    found = toxicity.probabilities(texts, toxicity.Classifiers(features, weights, np.array([0.25, -1.0])))
    own = weights[np.searchsorted(features, both[0])]
    kinds, among, others = toxicity.count_features(texts, np.array([True, False, False]))
    assert dict(zip(kinds, zip(among, others))) == {k: (1, int(k in both)) for k in kinds} and len(kinds) == 5
    sigmoid = lambda g: 1 / (1 + np.exp(-g))
    assert np.allclose(found, [sigmoid(np.array([0.25, -1.0]) + weights.sum(axis=0)).mean(),
                               sigmoid(np.array([0.25, -1.0]) + own).mean(), sigmoid(np.array([0.25, -1.0])).mean()])
