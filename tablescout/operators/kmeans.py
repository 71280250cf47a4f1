"""K-means by cosine for thousands of clusters: k-means|| and Lloyd's iterations as matrix products.

The method is that of MLlib's KMeans with its default settings, which compares vector by vector and takes hours
from some thousands of clusters on. Vectors stay where they are: every pass sends the centres to the
tasks and brings back a sum per cluster. On the driver are the candidates of k-means||, about four per cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: MLlib's defaults: passes that pick candidates, iterations over these, and the cosine distance by which a settled centre moves at most.
_PICKS = 2
_SEED_ITERATIONS = 30
_SETTLED = 1e-4
#: Pairs of a vector and a centre compared at once.
_PAIRS = 2**21
#: Rows of sums that leave a task at once.
_SUMS = 512


def _units(column: pa.Array) -> np.ndarray:
    """Unit vectors of lists of one length that have a direction."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return matrix / np.maximum(np.sqrt((matrix * matrix).sum(axis=1, keepdims=True)), 1e-300)


def _nearest(units: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each vector and its cosine distance, in single precision."""
    centres, best, away = centres.astype(np.float32).T, np.zeros(len(units), np.int64), np.zeros(len(units))
    step = max(1, _PAIRS // centres.shape[1])
    for start in range(0, len(units), step):
        part = slice(start, start + step)
        cosines = units[part].astype(np.float32) @ centres
        best[part] = cosines.argmax(axis=1)
        away[part] = 1.0 - cosines[np.arange(len(cosines)), best[part]]
    return best, np.maximum(away, 0.0)


def _add(sums: np.ndarray, counts: np.ndarray, clusters: np.ndarray, vectors: np.ndarray, weights: np.ndarray) -> None:
    order = np.argsort(clusters, kind="stable")
    own, start = np.unique(clusters[order], return_index=True)
    if len(own):
        sums[own] += np.add.reduceat(vectors[order], start, axis=0)
        counts[own] += np.add.reduceat(weights[order], start)


def _summed(vectors: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the vectors nearest to each centre."""
    sent = vectors.sparkSession.sparkContext.broadcast(centres)

    def total(batches: Iterator[pa.RecordBatch], read: Callable[[pa.RecordBatch], tuple]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(sent.value.shape), np.zeros(len(sent.value))
        for batch in batches:
            _add(sums, counts, *read(batch))
        every = np.flatnonzero(counts)
        for start in range(0, len(every), _SUMS):
            own = every[start : start + _SUMS]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * sums.shape[1], pa.int32()), pa.array(sums[own].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(counts[own]), lists], names=["cluster", "n", "total"])

    def assigned(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        units = _units(batch.column("embedding"))
        return _nearest(units, sent.value)[0], units, np.ones(len(units))

    def added(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return (batch.column("cluster").to_numpy(), batch.column("total").flatten().to_numpy().reshape(batch.num_rows, -1),
                batch.column("n").to_numpy())

    schema = "cluster int, n double, total array<double>"
    partial = vectors.select("embedding").mapInArrow(lambda batches: total(batches, assigned), schema)
    whole = partial.repartition("cluster").mapInArrow(lambda batches: total(batches, added), schema)
    sums, counts = np.zeros(centres.shape), np.zeros(len(centres))
    for batch in whole.toArrow().to_batches():
        _add(sums, counts, *added(batch))
    sent.destroy()
    return sums, counts


def _chosen(vectors: DataFrame, centres: np.ndarray, wanted: int, chance: Column) -> np.ndarray:
    """About ``wanted`` vectors, likelier the farther they are from the centres."""
    sent = vectors.sparkSession.sparkContext.broadcast(centres)

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = _nearest(_units(batch.column("embedding")), sent.value)[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(away)], names=[*batch.schema.names, "cost"])

    priced = vectors.select("embedding", chance.alias("chance")).mapInArrow(cost, "embedding array<float>, chance double, cost double")
    total = priced.agg(F.sum("cost")).first()[0] or 0.0
    found = priced.where(F.col("chance") * F.lit(total) < F.lit(float(wanted)) * F.col("cost")).select("embedding").toArrow()
    sent.destroy()
    return _units(found["embedding"].combine_chunks()).reshape(found.num_rows, centres.shape[1])


def seeded(units: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` centres of weighted vectors: k-means++, then Lloyd's iterations."""
    rows, mass = units.astype(np.float32), weights.astype(np.float64)
    centres = np.zeros((k, units.shape[1]))
    away = np.ones(len(units))
    for number in range(k):
        upto = np.cumsum(mass * away)
        pick = min(np.searchsorted(upto, rng.random() * upto[-1], side="right"), len(units) - 1)
        centres[number] = units[pick]
        np.minimum(away, np.maximum(1.0 - rows @ rows[pick], 0.0), out=away)
        away[pick] = 0.0
    before = None
    for _ in range(_SEED_ITERATIONS):
        own = _nearest(units, centres)[0]
        if before is not None and (own == before).all():
            break
        before, sums, counts = own, np.zeros(centres.shape), np.zeros(k)
        _add(sums, counts, own, units * mass[:, None], mass)
        centres = _directions(sums, np.where(counts[:, None] > 0, centres, units[rng.integers(len(units), size=k)]))
    return centres


def _directions(sums: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Unit vectors; of rows without a direction those of ``others``."""
    lengths = np.linalg.norm(sums, axis=1, keepdims=True)
    return np.where(lengths > 0.0, sums / np.maximum(lengths, 1e-300), others)


def fit(vectors: DataFrame, k: int, max_iter: int, seed: int) -> np.ndarray:
    """At most ``k`` unit centres of the ``embedding`` of rows with an ``id``: lists of one length that have a direction."""
    def chance(number: int) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(number), "id"), 11).cast("double") * 2.0**-53

    first = vectors.orderBy(chance(0), "id").select("embedding").limit(1).toArrow()
    candidates = _units(first["embedding"].combine_chunks())
    for number in range(1, _PICKS + 1):
        candidates = np.concatenate([candidates, _chosen(vectors, candidates, 2 * k, chance(number))])
    candidates = np.unique(candidates, axis=0)
    centres = candidates
    if len(candidates) > k:
        weights = _summed(vectors, candidates)[1]
        centres = seeded(candidates, weights, k, np.random.default_rng(seed))
    for _ in range(max_iter):
        before, centres = centres, _directions(_summed(vectors, centres)[0], centres)
        if (1.0 - (before * centres).sum(axis=1)).max() <= _SETTLED:
            break
    return centres
