"""Toxicity scores by non-negative positive-unlabelled learning.

1. Known are documents confirmed toxic and the corpus itself, of which nothing else is assumed: an
   unlabelled text may be toxic. The share of toxic documents (the class prior) is that among the labels.
2. A text is the set of its words and of their beginnings (``SHORTEST`` to ``LONGEST`` bytes), hashed:
   no vocabulary, and compounds of a root count as the root. Classifiers use those that confirmed
   documents hold significantly more often than unlabelled ones.
3. ``MODELS`` linear classifiers are trained in numpy, one task each, on bounded samples: the same
   confirmed documents, each without a part of the unlabelled ones that the others have. The risk is
   ``p * E+[l(g)] + max(0, Eu[l(-g)] - p * E+[l(-g)])`` with the logistic loss ``l`` and the prior ``p``;
   while the estimated risk of the clean documents is negative, its gradient is followed upwards.
4. Every whole text is scored by the mean of the classifiers' probabilities. Only the text counts.

Labels are learned from documents outside the held-out fold only; held-out documents are in no
sample. Samples are the lowest seeded hashes of the ids, so reruns agree. They are bounded by
``MOST_POSITIVES``, ``MOST_UNLABELLED`` and, per document, ``MOST_BYTES`` (longer texts are scored, but
not trained on).

Defined results: NULL counts as the empty text, which has no features and gets the classifiers'
intercept. A NULL ``doc_id`` is not held out and carries no label. Of rows that repeat a ``doc_id`` the
smallest text is trained on; each row is scored by itself. A ``doc_id`` with several labels is toxic if
one of them says so. Without confirmed documents every score is 0. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tablescout.llm.words import buffers, hashed_words, mix
from tablescout.session import materialize

FOLDS = 5
MODELS = 4
MOST_POSITIVES, MOST_UNLABELLED, MOST_BYTES = 4096, 8192, 1 << 15
#: Lengths of the beginnings of words, in bytes.
SHORTEST, LONGEST = 3, 8
#: Features of a classifier: the most, documents that must hold one, how much more often and with what significance.
MOST_FEATURES, LEAST_DOCUMENTS, LEAST_LIFT, LEAST_Z = 4096, 2, 6.0, 4.0
#: Steps, rate and shrinkage of the training; how fast a negative risk is undone.
STEPS, RATE, SHRINK, UNDO = 400, 0.1, 2e-4, 1.0
SEED = 11

_BLANKS = np.arange(256, dtype=np.uint8)
_BLANKS[[i for i in range(128) if not chr(i).isalnum()]] = 0x20
_LETTERS = np.random.default_rng(SEED).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Classifiers:
    """Hashes of the features in order, a weight per feature and classifier, and the intercepts."""

    features: np.ndarray
    weights: np.ndarray
    intercepts: np.ndarray


def held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the fold that is never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def _hashed(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Groups of whole rows: first row, number of rows, and each feature's row (counted from there) and hash."""
    column = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    offsets, data = buffers(pc.utf8_lower(column.cast(pa.large_string()).fill_null("")))
    plain = _BLANKS[data]
    clean = pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(plain)])
    for row, bounds, hashes, first, last in hashed_words(clean):
        count = len(bounds) - 1
        owner = np.repeat(np.arange(count), np.diff(bounds))
        at, size = first + offsets[row : row + count][owner], last - first
        owners, found = [owner], [hashes]
        start = np.zeros(len(at), dtype=np.uint64)
        for length in range(1, LONGEST + 1):
            some = size >= length
            at, size, owner, start = at[some], size[some], owner[some], start[some]
            start = start * _STEP + _LETTERS[plain[at + length - 1]]
            if length >= SHORTEST:
                owners.append(owner)
                found.append(mix(start + np.uint64(length)))
        yield row, count, np.concatenate(owners), np.concatenate(found)


def _feature_sets(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and hashes of the features, each once per row, by row, for groups of whole rows."""
    for first, _, owner, own in _hashed(texts):
        order = np.lexsort((own, owner))
        owner, own = owner[order], own[order]
        new = np.ones(len(own), dtype=bool)
        new[1:] = (own[1:] != own[:-1]) | (owner[1:] != owner[:-1])
        yield owner[new] + first, own[new]


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes, among, others = (np.concatenate(x) for x in zip(*parts))
    kinds, index = np.unique(hashes, return_inverse=True)
    return kinds, np.bincount(index, among, len(kinds)), np.bincount(index, others, len(kinds))


def count_features(texts: pa.Array, confirmed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all features, and how many confirmed and how many other texts hold each."""
    parts, waiting = [(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))], 0
    for rows, hashes in _feature_sets(texts):
        toxic = confirmed[rows]
        parts.append(_merged([(hashes, toxic.astype(float), (~toxic).astype(float))]))
        waiting += len(parts[-1][0])
        if waiting > 1 << 19:  # what is held grows with the different features, not with the texts
            parts, waiting = [_merged(parts)], 0
    return _merged(parts)


def select_features(kinds: np.ndarray, among: np.ndarray, others: np.ndarray, n: int, m: int, prior: float) -> np.ndarray:
    """Hashes of the features typical of ``n`` confirmed documents among ``m`` others, in order."""
    toxic, every = (among + 0.5) / (n + 1), (others + 0.5) / (m + 1)
    clean = np.maximum(every - prior * toxic, 0.5 / (m + 1)) / (1 - prior)
    pooled = (among + others + 1) / (n + m + 2)
    z = (toxic - every) / np.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))
    good = np.flatnonzero((among >= LEAST_DOCUMENTS) & (toxic >= LEAST_LIFT * clean) & (z >= LEAST_Z))
    best = good[np.lexsort((good, -z[good]))[:MOST_FEATURES]]
    return kinds[np.sort(best)]


def _places(features: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are among the ``features``, and where they stand there."""
    if not len(features):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(features, hashes), len(features) - 1)
    own = np.flatnonzero(features[place] == hashes)
    return own, place[own]


def train(texts: pa.Array, confirmed: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Features, weights and intercept of one classifier."""
    features = select_features(*count_features(texts, confirmed), int(confirmed.sum()), int((~confirmed).sum()), prior)
    pairs = [(np.zeros(0, np.int64),) * 2]
    for owner, hashes in _feature_sets(texts):
        own, at = _places(features, hashes)
        pairs.append((owner[own], at))
    rows, place = (np.concatenate(x) for x in zip(*pairs))
    n = len(confirmed)
    share = np.where(confirmed, 1.0 / confirmed.sum(), 1.0 / (~confirmed).sum())
    weights, intercept = np.zeros(len(features)), np.log(prior / (1 - prior))
    moment, square = np.zeros(len(features) + 1), np.zeros(len(features) + 1)
    for step in range(1, STEPS + 1):
        g = intercept + np.bincount(rows, weights[place], minlength=n)
        toxic = 1 / (1 + np.exp(-np.clip(g, -40, 40)))  # slope of l(-g); that of l(g) is one less
        clean_risk = share * np.logaddexp(0, g)
        negative = clean_risk[~confirmed].sum() - prior * clean_risk[confirmed].sum()
        of_clean = np.where(confirmed, -prior, 1.0) * share * toxic
        if negative >= 0:
            slope = of_clean + np.where(confirmed, prior * share * (toxic - 1), 0.0)
        else:
            slope = -UNDO * of_clean
        gradient = np.append(np.bincount(place, slope[rows], minlength=len(features)) + SHRINK * weights, slope.sum())
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient * gradient
        change = RATE * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        weights, intercept = weights - change[:-1], intercept - change[-1]
    return features, weights, float(intercept)


def _trainer(prior: float) -> Callable:
    def run(key: tuple[pa.Scalar, ...], sample: pa.Table) -> pa.Table:
        sample = sample.sort_by([("confirmed", "ascending"), ("doc_id", "ascending")])
        confirmed = sample["confirmed"].to_numpy()
        if confirmed.all() or not confirmed.any():
            features, values = np.zeros(0, np.uint64), np.zeros(0)
        else:
            features, weights, intercept = train(sample["text"], confirmed, prior)
            values = np.append(intercept, weights)
        return pa.table({
            "model": pa.array([key[0].as_py()] * len(values), pa.int32()), "constant": pa.array(np.arange(len(values)) == 0),
            "feature": pa.array(np.append(np.int64(0), features.view(np.int64))[: len(values)], pa.int64()), "weight": pa.array(values, pa.float64())})

    return run


def fit(documents: DataFrame, labels: DataFrame) -> Classifiers | None:
    """Classifiers from the confirmed toxic documents among ``labels(doc_id, toxic)`` and from unlabelled ones."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    marked = marked.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = materialize(marked, "labels")
    seen = marked.agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("all")).first()
    if not seen["toxic"]:
        return None
    prior = min(seen["toxic"] / seen["all"], 0.95)
    order = F.xxhash64(F.lit(SEED), "doc_id")
    confirmed = marked.where("toxic = 1").orderBy(order, "doc_id").limit(MOST_POSITIVES).select("doc_id")
    usable = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(
        F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & (F.octet_length("text") <= MOST_BYTES))

    def one_each(rows: DataFrame) -> DataFrame:
        return rows.groupBy("doc_id").agg(F.min("text").alias("text"))

    positives = one_each(usable.join(F.broadcast(confirmed), "doc_id", "left_semi"))  # at most MOST_POSITIVES ids
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(SEED + 1), "doc_id"), 11).cast("double") * 2.0**-53
    share = MOST_UNLABELLED / max(1, usable.select("doc_id").count())
    unlabelled = one_each(usable.where(chance < share))
    models, left_out = F.sequence(F.lit(0), F.lit(MODELS - 1)), F.pmod(F.xxhash64(F.lit(SEED + 2), "doc_id"), F.lit(MODELS))
    sample = positives.select("doc_id", "text", F.lit(True).alias("confirmed"), F.explode(models).alias("model")).unionByName(
        unlabelled.select("doc_id", "text", F.lit(False).alias("confirmed"), F.explode(F.filter(models, lambda m: m != left_out)).alias("model")))
    trained = materialize(sample.groupBy("model").applyInArrow(_trainer(prior), "model int, constant boolean, feature long, weight double"), "classifiers")
    rows = trained.toPandas()  # at most MODELS * (MOST_FEATURES + 1)
    if rows.empty:
        return None
    models = sorted(rows["model"].unique())
    weighted = rows[~rows["constant"]]
    places = weighted["feature"].to_numpy(np.int64).view(np.uint64)
    features = np.unique(places)
    weights = np.zeros((len(features), len(models)))
    weights[np.searchsorted(features, places), np.searchsorted(models, weighted["model"])] = weighted["weight"]
    intercepts = rows[rows["constant"]].sort_values("model")["weight"].to_numpy()
    return Classifiers(features, weights, intercepts)


def probabilities(texts: pa.Array, found: Classifiers) -> np.ndarray:
    """The score of every text."""
    scores = np.zeros(len(texts))
    known = np.zeros(1 << 20, dtype=bool)  # most features are unknown: told by their first 20 bits
    shift = np.uint64(44)
    known[found.features >> shift] = True
    for row, count, owner, hashes in _hashed(texts):
        maybe = np.flatnonzero(known[hashes >> shift])
        owner, hashes = owner[maybe], hashes[maybe]
        own, place = _places(found.features, hashes)
        owner, place = np.divmod(np.unique(owner[own] * max(1, len(found.features)) + place), max(1, len(found.features)))
        sums = np.zeros((count, len(found.intercepts)))
        for i, intercept in enumerate(found.intercepts):
            sums[:, i] = intercept + np.bincount(owner, found.weights[place, i], count)
        scores[row : row + count] = (1 / (1 + np.exp(-np.clip(sums, -40, 40)))).mean(axis=1)
    return scores


def score(documents: DataFrame, found: Classifiers | None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``documents(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(probabilities(batch["text"], found))], names=["doc_id", "score"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = rows.mapInArrow(run, "doc_id long, score double") if found is not None else rows.select("doc_id", F.lit(0.0).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by classifiers fitted to ``labels`` outside the held-out fold."""
    return score(documents, fit(documents, labels))
