"""Vector search over k-means clusters inside geo cells: nearest clusters first, with a certificate.

Requests and places meet in the cells of the request's box, tile by tile, so neither a crowded metro nor a
large cluster is one task's input. A request travels once per cell and tile, not once per cluster: which
clusters it reads, the tasks find from the centroids, and they compare it with the places of these alone.

For each cluster the index keeps the smallest and the largest angle of a member to the centroid. By
the triangle inequality of angles this bounds how near a member can be to a request. Clusters are read
in the order of that bound, in growing steps, until no unread cluster can hold one of the wanted
nearest: then the answer is proven exact, although most clusters may never have been read. Places
whose vectors have no cluster (another length than the centroids, or no direction) form a last cluster
of their own that every request reads.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from tablescout import fixed_values as V
from tablescout.operators import blocks, geocells, kmeans
from tablescout.operators.retrieve import best_hits, vector_hits
from tablescout.session import materialize

#: Places per cluster that the number of clusters aims at, and the most clusters (their centroids go to every task).
CLUSTER_ROWS = 2048
MOST_CLUSTERS = 16_384
#: Centroids are fitted to a sample of at most so many places per cluster; all places are assigned.
FIT_ROWS = 256
#: Up to so many clusters are fitted by MLlib, which compares vector by vector.
MLLIB_CLUSTERS = 1024
#: Vectors scored against all centroids at once.
_CHUNK = 512
#: Angles and distances are rounded outwards by this much.
_MARGIN = 1e-6
#: Requests whose clusters are put in order at once.
_ROUND_ROWS = 64
#: Up to so many requests move once per round, more only once.
ROUND_REQUESTS = 16_384
#: Places of a cluster that share a tile; requests, and places and their numbers, of blocks that are compared cluster by cluster.
_TOGETHER = 4096
_REQUEST_ROWS = 8192
_PLACE_ROWS, _PLACE_NUMBERS = 32_768, 2**21
#: Clusters of a round that are listed in the filter of the index's scan.
_LISTED = 1024

_REQUEST_COLUMNS = ("qid", "latitude", "longitude", "max_distance_km", "minimum_rating", "preferred_price_range",
                    "query_vector")


@dataclass(frozen=True)
class VectorIndex:
    """Search columns of the places with their cluster, and the ``n_cells`` unit centroids.

    ``nearest`` and ``farthest`` are the extreme angles of the members of each cluster, ``members`` their
    number; the last entry is that of the places without a cluster.
    """

    places: DataFrame
    centroids: np.ndarray
    nearest: np.ndarray
    farthest: np.ndarray
    members: np.ndarray


@dataclass(frozen=True)
class Certified:
    """Hits, and per request how many ``clusters`` were read and whether the hits are ``certified`` as exact."""

    hits: DataFrame
    reads: DataFrame


def _matrix(column: pa.Array, rows: np.ndarray, dims: int) -> np.ndarray:
    return column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dims).astype(np.float64)


def _directed(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``dims`` components that have a direction, and their unit vectors."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dims)
    matrix = _matrix(column, rows, dims)
    lengths = np.sqrt((matrix * matrix).sum(axis=1))
    kept = (lengths > 0.0) & np.isfinite(lengths)
    return rows[kept], matrix[kept] / lengths[kept, None]


def _angles(units: np.ndarray, centroids: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    for start in range(0, len(units), _CHUNK):
        part = slice(start, start + _CHUNK)
        yield part, np.arccos(np.clip(units[part] @ centroids.T, -1.0, 1.0))


def _assigned(df: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add the nearest ``cluster`` and the ``angle`` to its centroid; vectors without one get the last cluster."""
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clusters = np.full(batch.num_rows, len(centroids), dtype=np.int32)
            angle = np.zeros(batch.num_rows)
            rows, units = _directed(batch.column("embedding"), centroids.shape[1])
            for part, angles in _angles(units, centroids):
                best = angles.argmin(axis=1)
                clusters[rows[part]], angle[rows[part]] = best, angles[np.arange(len(best)), best]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(clusters), pa.array(angle)],
                                             names=[*batch.schema.names, "cluster", "angle"])

    schema = T.StructType(df.schema.fields + [T.StructField("cluster", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    return df.mapInArrow(nearest, schema)


def lower_bounds(units: np.ndarray, index: VectorIndex) -> np.ndarray:
    """The least cosine distance of any member of each cluster to each unit vector; infinite for empty clusters."""
    bounds = 1.0 - np.cos(_gaps(units, index, np.arange(len(index.members))))
    bounds[:, index.members == 0] = np.inf
    return bounds


def _gaps(units: np.ndarray, index: VectorIndex, clusters: np.ndarray) -> np.ndarray:
    """The least angle of any member of the given clusters to each unit vector, rounded downwards."""
    last = len(index.members) - 1
    inside = clusters[clusters < last]
    whole = len(inside) == last
    centroids, nearest, farthest = ((x if whole else x[inside]) for x in (index.centroids, index.nearest[:-1], index.farthest[:-1]))
    gaps = np.zeros((len(units), len(clusters)))
    # Places without a cluster, the last, may be at any angle.
    for part, angles in _angles(units, centroids):
        gap = np.maximum(angles - farthest, nearest - angles)
        gap -= _MARGIN
        np.maximum(gap, 0.0, out=gaps[part, : len(inside)])
    return gaps


def _without_table(index: VectorIndex) -> VectorIndex:
    """What the tasks need."""
    return VectorIndex(None, index.centroids, index.nearest, index.farthest, index.members)


def _numbers(column: pa.ChunkedArray | pa.Array, count: int) -> np.ndarray:
    """Lists of ``count`` numbers as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), count)


def _round_ends(total: int, first: int | None, growth: int, most: int | None) -> list[int]:
    """How many clusters a request has read after each round if it stays open."""
    most = total if most is None else min(most, total)
    step, ends = first or max(1, math.isqrt(total)), [0]
    while ends[-1] < most:
        step = min(step, most - ends[-1])
        ends.append(ends[-1] + step)
        step *= growth
    return ends[1:]


def _with_rounds(df: DataFrame, index: VectorIndex, ends: list[int]) -> DataFrame:
    """Add what tells in which round a request reads a cluster, and what the rounds can find.

    A request reads the clusters in the order of their gaps (``_gaps``), equal ones in that of their numbers.
    ``edges`` has for each round an angle: clusters with a larger gap come later, and of those that have
    just this gap the ones from number ``ties`` on, where that is not 0. ``tops`` is the least distance in the
    last cluster of the round, ``beyond`` that in the first one after it, ``readable`` the number of clusters there are.
    """
    index = _without_table(index)
    last, occupied = len(index.members) - 1, int((index.members > 0).sum())

    def added(batch: pa.RecordBatch) -> pa.RecordBatch:
        shape = (batch.num_rows, len(ends))
        edges, tops, beyond = np.full(shape, np.inf), np.zeros(shape), np.full(shape, np.inf)
        ties = np.zeros(shape, dtype=np.int32)
        readable = np.full(batch.num_rows, int(index.members[last] > 0), dtype=np.int64)  # only places without a cluster can match
        rows, units = _directed(batch.column("query_vector"), index.centroids.shape[1])
        readable[rows] = occupied
        for start in range(0, len(rows), _ROUND_ROWS):
            own = rows[start : start + _ROUND_ROWS]
            gaps = _gaps(units[start : start + _ROUND_ROWS], index, np.arange(last + 1))
            gaps[:, index.members == 0] = np.inf
            ordered = np.sort(gaps, axis=1)
            for number, end in enumerate(ends):
                before = ordered[:, min(end, occupied) - 1] if occupied else np.zeros(len(own))
                tops[own, number] = 1.0 - np.cos(before)
                if end < occupied:
                    after = ordered[:, end]
                    beyond[own, number] = 1.0 - np.cos(after)
                    edges[own, number] = (before + after) / 2
                    for row in np.flatnonzero(before == after):
                        equal = np.flatnonzero(gaps[row] == after[row])
                        ties[own[row], number] = equal[end - np.searchsorted(ordered[row], after[row])]
        columns = {"readable": pa.array(readable)}
        for name, values in (("edges", edges), ("ties", ties), ("tops", tops), ("beyond", beyond)):
            at = pa.array(np.arange(shape[0] + 1) * shape[1], pa.int32())
            columns[name] = pa.ListArray.from_arrays(at, pa.array(values.ravel()))
        return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(added, batches)

    schema = T.StructType(df.schema.fields + [T.StructField("readable", T.LongType())] + [
        T.StructField(name, T.ArrayType(T.IntegerType() if name == "ties" else T.DoubleType())) for name in ("edges", "ties", "tops", "beyond")])
    return df.mapInArrow(ranked, schema)


@dataclass(frozen=True)
class _Pass:
    """The rounds ``first`` to ``stop`` (exclusive) of a search, in which its requests move once."""

    index: VectorIndex
    ends: list[int]
    first: int
    stop: int
    slack: float

    def until(self, requests: pa.Table) -> np.ndarray:
        """Whether a request goes on after a round depends on hits nearer than the next clusters can be, and which of these it
        reads, on hits nearer than the last of them."""
        tops = _numbers(requests["tops"], len(self.ends))[:, self.first + 1 : self.stop]
        return tops + max(self.slack, 0.0) + 2 * _MARGIN

    def rounds(self, requests: pa.Table, rows: np.ndarray, units: np.ndarray, clusters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        last = len(self.index.members) - 1
        when = np.full((len(rows), len(clusters)), -1, dtype=np.int16)
        least = np.zeros((len(rows), len(clusters)), dtype=np.float32)
        directed = np.flatnonzero(np.isfinite(units).all(axis=1)) if units.shape[1] == self.index.centroids.shape[1] else rows[:0]
        if self.first == 0:
            when[:, clusters == last] = 0  # all that a vector without direction among these clusters reads
        edges, ties = (_numbers(requests[name], len(self.ends)) for name in ("edges", "ties"))
        for start in range(0, len(directed), _ROUND_ROWS):
            some = directed[start : start + _ROUND_ROWS]
            gaps = _gaps(units[some], self.index, clusters)
            number = np.zeros(gaps.shape, dtype=np.int16)
            for edge, tie in zip(edges[rows[some]].T, ties[rows[some]].T):
                number += gaps > edge[:, None]
                tied = np.flatnonzero(tie)
                if len(tied):
                    number[tied] += (gaps[tied] == edge[tied, None]) & (clusters >= tie[tied, None])
            number[number >= self.stop] = -1
            number[number >= 0] -= self.first
            when[some] = np.maximum(number, -1)
            least[some] = gaps - _MARGIN  # more than what rounding to single precision adds
        return when, least

    def read(self, batch: pa.RecordBatch) -> np.ndarray:
        """The clusters that any of these requests reads."""
        picked = np.zeros(len(self.index.members), dtype=bool)
        rows, units = _directed(batch.column("query_vector"), self.index.centroids.shape[1])
        if self.first == 0 and len(rows) < batch.num_rows:
            picked[-1] = True
        table = pa.Table.from_batches([batch])
        worst = batch.column("worst").to_numpy()
        for start in range(0, len(rows), _ROUND_ROWS):
            some = rows[start : start + _ROUND_ROWS]
            when, least = self.rounds(table, some, units[start : start + _ROUND_ROWS], np.arange(len(picked)))
            reach = np.arccos(np.clip(1.0 - worst[some] - _MARGIN, -1.0, 1.0))
            picked |= ((when >= 0) & (least <= reach[:, None])).any(axis=0)
        return np.flatnonzero(picked & (self.index.members > 0))

    def closed(self, worst: np.ndarray, beyond: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of matrices over the rounds of this pass: the last round that each request takes part in, and whether it is open after it."""
        more = np.isfinite(beyond) & (beyond <= worst + _MARGIN - self.slack)
        return np.where(more.all(axis=1), more.shape[1] - 1, more.argmin(axis=1)), more.all(axis=1)


def build_ivf(places: DataFrame, n_cells: int | None = None, max_iter: int = 10, seed: int = V.SAMPLE_SEED,
              cluster_rows: int = CLUSTER_ROWS) -> VectorIndex:
    """Cluster the places that have a vector by cosine; the number of clusters follows the measured table.

    Centroids have the most frequent length of a vector and are fitted to a sample in the order of a
    seeded hash. Assignments are written once, so a search reads them instead of computing them again.
    """
    embedded = materialize(places.where(F.col("embedding").isNotNull()).select(
        "id", "latitude", "longitude", "overall_rating", "price_range", "embedding"), "embedded")
    sizes = embedded.groupBy(F.size("embedding").alias("dims")).agg(F.count(F.lit(1)).alias("n")).where("dims > 0")
    usual = sizes.orderBy(F.desc("n"), "dims").first()
    dims, rows = (usual["dims"], usual["n"]) if usual else (1, 0)
    if n_cells is None:
        n_cells = min(MOST_CLUSTERS, max(2, math.ceil(rows / cluster_rows)))
    fitting = embedded.where(F.size("embedding") == dims).where(F.exists("embedding", lambda x: x != 0))
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11).cast("double") * 2.0**-53
    sample = fitting.where(chance < FIT_ROWS * n_cells / max(rows, 1))
    if n_cells > MLLIB_CLUSTERS:
        sample = sample.where(F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))
    if not sample.isEmpty():
        if n_cells > MLLIB_CLUSTERS:
            centers = kmeans.fit(sample, n_cells, max_iter, seed)
        else:
            features = sample.select(array_to_vector("embedding").alias("features"))
            centers = np.array(KMeans(k=n_cells, distanceMeasure="cosine", maxIter=max_iter, seed=seed).fit(features).clusterCenters())
        centers = centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-300)
    else:
        centers = np.eye(1, dims)
    assigned = materialize(_assigned(embedded, centers), "ivf")
    return VectorIndex(assigned.drop("angle"), centers, *_extremes(assigned, len(centers)))


def _extremes(assigned: DataFrame, clusters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smallest and largest angle and number of members; a row per cluster, so no more than ``MOST_CLUSTERS``."""
    nearest, farthest, members = np.zeros(clusters + 1), np.full(clusters + 1, math.pi), np.zeros(clusters + 1, dtype=np.int64)
    summed = assigned.groupBy("cluster").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count(F.lit(1)).alias("n"))
    for row in summed.collect():
        members[row["cluster"]] = row["n"]
        if row["cluster"] < clusters:
            nearest[row["cluster"]], farthest[row["cluster"]] = row["low"], row["high"]
    return nearest, farthest, members


def save_index(index: VectorIndex, path: str) -> None:
    """Places by cluster, and a row per cluster, under ``path``."""
    index.places.repartition("cluster").write.mode("overwrite").partitionBy("cluster").parquet(f"{path}/places")
    spark = index.places.sparkSession
    centroids = [*(json.dumps(c.tolist()) for c in index.centroids), None]
    rows = [(i, c, float(a), float(b), int(n)) for i, (c, a, b, n) in enumerate(zip(centroids, index.nearest, index.farthest, index.members))]
    table = spark.createDataFrame(rows, "cluster int, centroid string, nearest double, farthest double, members long")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/clusters")


def load_index(spark: SparkSession, path: str) -> VectorIndex:
    rows = spark.read.parquet(f"{path}/clusters").orderBy("cluster").collect()  # no more than MOST_CLUSTERS and one
    nearest, farthest, members = (np.array([r[c] for r in rows]) for c in ("nearest", "farthest", "members"))
    return VectorIndex(spark.read.parquet(f"{path}/places"), np.array([json.loads(r["centroid"]) for r in rows[:-1]]),
                       nearest, farthest, members)


def _listed_clusters(open_: DataFrame, step: _Pass) -> list[int]:
    """The clusters that the requests read in a pass; no more than ``MOST_CLUSTERS`` and one."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(step.read(batch), pa.int32())], names=["cluster"])

    columns = open_.select("query_vector", "worst", "edges", "ties")
    return sorted(r["cluster"] for r in columns.mapInArrow(read, "cluster int").distinct().collect())


def _probed_hits(open_: DataFrame, places: DataFrame, step: _Pass, limit: int, listed: bool, **block_options) -> DataFrame:
    """Hits of requests inside the clusters they read in a pass and no farther than ``worst``, a list per request and pair of
    tiles. With ``listed`` only the clusters that any of them reads are fetched."""
    q = blocks.prepare_requests(open_, True, "worst", "edges", "ties", "tops", "beyond").withColumn("level", geocells.box_level())
    levels = sorted(q.agg(F.collect_set("level").alias("levels")).first()["levels"]) or [0]
    if listed:
        clusters = _listed_clusters(open_, step)
        if len(clusters) < (step.index.members > 0).sum() and len(clusters) <= _LISTED:
            places = places.where(F.col("cluster").isin(clusters))  # partitions of the stored index that are not read
    p = blocks.vector_places(places, "cluster")
    # A cluster's places share a tile, so that a request meets a cluster once; parts of them where one is large.
    pieces = max(1, math.ceil(int(step.index.members.max(initial=1)) / _TOGETHER))
    together = ["cluster", F.pmod(F.xxhash64("id"), F.lit(pieces))]
    most = max(blocks.PLACE_BLOCK[1], min(_PLACE_ROWS, _PLACE_NUMBERS // step.index.centroids.shape[1]))
    block_options = {"request_block": (blocks.REQUEST_BLOCK[0], _REQUEST_ROWS), "place_block": (blocks.PLACE_BLOCK[0], most)} | block_options
    return blocks.blocked_hits(q, p, geocells.box_cells(), geocells.place_cells(levels), mode=blocks.VECTOR, limit=limit,
                               chosen=step, packed=True, together=together, **block_options)


def _best_packed(found: DataFrame, step: _Pass, limit: int) -> DataFrame:
    """The ``limit`` nearest of each request again as a list, of the rounds it takes part in, with the distance of the last
    after each round (``worsts``; infinite if there are not so many), and whether the request is ``open`` after the pass."""
    rounds = range(step.first, step.stop)
    lists = found.repartition("qid").groupBy("qid", "q_lat", "q_lon", "max_km", "semantic").agg(
        F.flatten(F.collect_list("hits")).alias("hits"), F.array(*(F.max(F.col("beyond")[r]) for r in rounds)).alias("_beyond"),
        F.max("beyond").alias("beyond"))
    schema = T.StructType(lists.drop("_beyond").schema.fields + [
        T.StructField("worsts", T.ArrayType(T.DoubleType())), T.StructField("open", T.BooleanType())])
    kept = [f.name for f in schema.fields if f.name not in ("hits", "worsts", "open")]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, hits = batch.column("hits"), batch.column("hits").flatten()
            rows = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            away, ids, number = (hits.field(n).to_numpy(zero_copy_only=False) for n in ("cos_dist", "id", "round"))
            number = number.astype(np.int64)
            worst = np.stack([blocks._limits(rows[number <= r], away[number <= r], batch.num_rows, limit) for r in range(len(rounds))], axis=1)
            last, open_ = step.closed(worst, _numbers(batch.column("_beyond"), len(rounds)))
            mine = np.flatnonzero(number <= last[rows])
            mine = mine[blocks._first(rows[mine], ids[mine], away[mine], limit)]
            at = np.searchsorted(rows[mine], np.arange(batch.num_rows + 1))
            taken = hits.take(pa.array(mine))
            # In the passes to come these are hits of rounds before.
            taken = pa.StructArray.from_arrays([taken.field(f.name) if f.name != "round" else pa.array(np.full(len(mine), -1, np.int32))
                                                for f in hits.type], names=[f.name for f in hits.type])
            columns = {name: batch.column(name) for name in kept} | {
                "hits": pa.ListArray.from_arrays(pa.array(at, pa.int32()), taken),
                "worsts": pa.ListArray.from_arrays(pa.array(np.arange(len(worst) + 1) * len(rounds), pa.int32()), pa.array(worst.ravel())),
                "open": pa.array(open_)}
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema.fields], names=schema.names)

    return lists.mapInArrow(best, schema)


def _after(asked: DataFrame, step: _Pass) -> DataFrame:
    """Add ``n``, the number of clusters that a request reads in a pass, and whether it is ``open`` after it, and its new
    ``worst``. In each round it reads what can beat the ``worsts`` before."""
    ends, count = [0, *step.ends], step.stop - step.first

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            readable, before = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("readable", "worst"))
            worst = np.full((batch.num_rows, count), np.inf)
            known = np.flatnonzero(batch.column("worsts").is_valid().to_numpy(zero_copy_only=False))
            worst[known] = _numbers(batch.column("worsts"), count) if len(known) == batch.num_rows else _numbers(
                batch.column("worsts").take(pa.array(known)), count)
            tops, beyond = (_numbers(batch.column(n), len(step.ends))[:, step.first : step.stop] for n in ("tops", "beyond"))
            last, open_ = step.closed(worst, beyond)
            bound = np.column_stack([before, worst[:, :-1]]) + _MARGIN
            low, high = (np.array(ends[step.first + a : step.stop + a]) for a in (0, 1))
            part = np.maximum(np.minimum(high, readable[:, None]) - low, 0)
            taken = np.arange(count) <= last[:, None]
            # Where not all clusters of a round can beat it, those that can are counted.
            fewer = np.flatnonzero((taken & (part > 0) & (bound < tops)).any(axis=1))
            rows, units = _directed(batch.column("query_vector").take(pa.array(fewer)), step.index.centroids.shape[1])
            for start in range(0, len(rows), _ROUND_ROWS):
                own = fewer[rows[start : start + _ROUND_ROWS]]
                gaps = _gaps(units[start : start + _ROUND_ROWS], step.index, np.arange(len(step.index.members)))
                gaps[:, step.index.members == 0] = np.inf
                for r in range(count):
                    reach = np.arccos(np.clip(1.0 - bound[own, r], -1.0, 1.0))
                    able = (gaps <= reach[:, None]).sum(axis=1)
                    part[own, r] = np.maximum(np.minimum(high[r], able) - low[r], 0)
            n = np.where(taken, part, 0).sum(axis=1)
            columns = [c for c, name in zip(batch.columns, batch.schema.names) if name not in ("worst", "worsts")]
            names = [name for name in batch.schema.names if name not in ("worst", "worsts")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n), pa.array(open_), pa.array(worst[:, -1])], names=[*names, "n", "open", "worst"])

    schema = T.StructType([f for f in asked.schema.fields if f.name not in ("worst", "worsts")] + [
        T.StructField("n", T.LongType()), T.StructField("open", T.BooleanType()), T.StructField("worst", T.DoubleType())])
    return asked.mapInArrow(read, schema)


def certified_hits(requests: DataFrame, index: VectorIndex, limit: int = V.RESULT_LIMIT * V.OVERFETCH,
                   first: int | None = None, growth: int = 4, most: int | None = None, slack: float = 0.0,
                   **block_options: int) -> Certified:
    """The ``limit`` nearest inside box and filters, reading only clusters that can hold one of them.

    The first round reads the ``first`` most promising clusters of every request (by default the root
    of their number), each further one ``growth`` times as many of the requests that are still open. A
    request is closed when its ``limit``-th hit is nearer than anything in its unread clusters can be.
    With ``slack`` it is closed as soon as nothing unread can be nearer by more than that: what is missed is
    then at most so much nearer than what was returned in its place. ``most`` bounds the clusters read per
    request; what is then still open is not certified.

    Few requests move once per round, and what they do not read is not fetched. Many would read every cluster in the
    first round already; they move once, and the tasks find hits of all rounds, each cluster only for requests
    that it can still give a hit. From these it is told in which round a request is closed, and what it reads until then.
    """
    ends = _round_ends(len(index.members), first, growth, most)
    asked = requests.where(F.col("query_vector").isNotNull()).select(*_REQUEST_COLUMNS, F.lit(float("inf")).alias("worst"))
    open_ = materialize(_with_rounds(asked, index, ends), "ivf-probed")
    few = open_.count() <= ROUND_REQUESTS
    carried, done = None, 0
    hits, reads = [], []
    while True:
        step = _Pass(_without_table(index), ends, done, done + 1 if few else len(ends), slack)
        done = step.stop
        found = _probed_hits(open_, index.places, step, limit, few, **block_options)
        if carried is not None:
            found = found.unionByName(carried)
        carried = materialize(_best_packed(found, step, limit), "ivf-best")
        worsts = carried.groupBy("qid").agg(F.min("worsts").alias("worsts"))
        state = materialize(_after(open_.join(worsts, "qid", "left"), step), "ivf-state")
        ended = done == len(ends) or state.where("open").isEmpty()
        reads.append(state.select("qid", "n", (~F.col("open") if ended else F.lit(True)).alias("certified")))
        if ended:
            hits.append(carried.drop("worsts", "open"))
            break
        open_ = state.where("open").drop("n", "open")
        hits.append(carried.where(~F.col("open")).drop("worsts", "open"))
        carried = carried.where("open").drop("worsts", "open")
    every = best_hits(blocks.unpacked(reduce(DataFrame.unionByName, hits)), limit)
    read = reduce(DataFrame.unionByName, reads).groupBy("qid").agg(F.sum("n").alias("clusters"), F.bool_and("certified").alias("certified"))
    return Certified(every, read)


def ivf_hits(requests: DataFrame, index: VectorIndex, n_probe: int, limit: int = V.RESULT_LIMIT * V.OVERFETCH,
             widen: bool = True, **block_options: int) -> DataFrame:
    """Vector hits from the ``n_probe`` most promising clusters, with box and filters applied inside them.

    With ``widen``, requests that got fewer than ``limit`` hits are searched exactly, so no answer
    is short because its filters left too little in the probed clusters.
    """
    asked = requests.where(F.col("query_vector").isNotNull())
    ends = _round_ends(len(index.members), n_probe, 1, n_probe)
    probed = _with_rounds(asked.select(*_REQUEST_COLUMNS, F.lit(float("inf")).alias("worst")), index, ends)
    step = _Pass(_without_table(index), ends, 0, 1, 0.0)
    lists = _probed_hits(materialize(probed, "ivf-probed"), index.places, step, limit, True, **block_options)
    found = best_hits(blocks.unpacked(lists), limit)
    if not widen:
        return found
    found = materialize(found, "ivf-hits")  # at most ``limit`` rows per request, read three times
    full = found.groupBy("qid").agg(F.max("rn").alias("n")).where(F.col("n") == limit).select("qid")
    short = asked.join(full, "qid", "left_anti")
    exact = vector_hits(short, index.places, limit, **block_options)
    return found.join(full, "qid", "left_semi").unionByName(exact)
