"""Exact nearest neighbours by a block matrix join of quantised vectors.

1. Every vector is scaled to unit length and quantised to signed bytes with a scale of its own; the
   length of what the quantisation loses is kept beside it.
2. Queries and candidates are dealt into blocks of bounded size; each pair of blocks is one tile, a
   product of small integers (summed exactly). With the losses ``r`` and ``s`` of two vectors the true
   cosine lies within ``r + s + r*s`` of the quantised one (Cauchy-Schwarz), plus a rounding margin.
3. A tile passes on, per query, the candidates whose upper bound reaches the ``k``-th best lower bound in the tile. A
   further look at all tiles of a query drops those below its overall ``k``-th best lower bound.
4. The survivors' cosines are computed in double precision on the original vectors, each sum in
   order of the components, and the ``k`` best of each query are kept by heaps that are merged.

So the result equals an exhaustive search. Defined results: vectors that are NULL, empty, zero, hold
NULL or non-finite components, or whose squared length over- or underflows take no part, nor do rows
with a NULL ``vec_id``. Only vectors of one dimension are compared. Rows that repeat a ``vec_id``:
the row with the smallest vector (by its components) stands for it. Ties go to the smaller
``vec_id``. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablescout.llm.common import tasks_for
from tablescout.session import materialize

QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192
K = 5
#: More than the rounding of the quantised and of the double computation together.
MARGIN = 1e-6


def _sum_of_products(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v, norm2``: one row per usable vector, as doubles."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = rows.withColumn("norm2", _sum_of_products(F.col("v"), F.col("v")))
    return rows.where((F.col("norm2") > 0) & (F.col("norm2") < float("inf")))


def quantise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signed bytes, scales and losses of the rows scaled to unit length."""
    top = np.abs(matrix).max(axis=1, keepdims=True)
    unit = matrix / top
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None])
    loss = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes.astype(np.int8), scale, loss


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch["n"].to_numpy()
        for n in np.unique(sizes):
            rows = batch.filter(pa.array(sizes == n))
            matrix = rows["v"].flatten().to_numpy(zero_copy_only=False).reshape(len(rows), int(n))
            codes, scale, loss = quantise(matrix)
            yield pa.RecordBatch.from_arrays(
                [rows["vec_id"], rows["n"], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(loss)],
                names=["vec_id", "n", "codes", "scale", "loss"])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of two byte matrices; 1024 components at a time stay exact in single precision."""
    total = np.zeros((len(a), len(b)), dtype=np.float64)
    for i in range(0, a.shape[1], 1024):
        total += a[:, i : i + 1024].astype(np.float32) @ b[:, i : i + 1024].astype(np.float32).T
    return total


def _tile(k: int) -> Callable:
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                          "low": pa.array([], pa.float64()), "high": pa.array([], pa.float64())})
        if not len(queries) or not len(candidates):
            return empty
        n = queries["n"][0].as_py()
        q, c = (np.frombuffer(b"".join(t["codes"].to_pylist()), np.int8).reshape(len(t), n) for t in (queries, candidates))
        q_ids, c_ids = queries["vec_id"].to_numpy(), candidates["vec_id"].to_numpy()
        c_scale, c_loss = candidates["scale"].to_numpy(), candidates["loss"].to_numpy()
        out = []
        for start in range(0, len(q), 128):  # a strip of the tile at a time
            part = slice(start, start + 128)
            scale, loss = queries["scale"].to_numpy()[part, None], queries["loss"].to_numpy()[part, None]
            near = products(q[part], c) * scale * c_scale
            far = loss + c_loss + loss * c_loss + MARGIN
            low, high = near - far, near + far
            own = q_ids[part, None] == c_ids[None, :]
            low[own], high[own] = -np.inf, -np.inf
            at = min(k, low.shape[1]) - 1
            least = -np.partition(-low, at, axis=1)[:, at : at + 1]
            rows, cols = np.nonzero((high >= least) & ~own)
            out.append((q_ids[part][rows], c_ids[cols], low[rows, cols], high[rows, cols]))
        columns = (np.concatenate(x) for x in zip(*out))
        return pa.table(dict(zip(("query_id", "vec_id", "low", "high"), columns)))

    return run


def _best(k: int) -> Callable:
    """Heaps of the ``k`` best of each query seen in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list] = {}
        for batch in batches:
            for query, vec, score in zip(*(batch[c].to_pylist() for c in ("query_id", "vec_id", "score"))):
                heap = heaps.setdefault(query, [])
                if len(heap) < k:
                    heapq.heappush(heap, (score, -vec))
                else:
                    heapq.heappushpop(heap, (score, -vec))
        rows = [(q, i + 1, -vec, score) for q, heap in heaps.items()
                for i, (score, vec) in enumerate(sorted(heap, reverse=True))]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 4, kinds)],
                                         names=["query_id", "rank", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = K, query_block: int = QUERY_BLOCK,
            candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest of every query among all other rows.

    ``is_query`` is a condition on ``vec_id``.
    """
    spark = vectors.sparkSession
    rows = materialize(usable(vectors), "vectors")
    # Copies of a vector tie everywhere: only the smallest ids can be in an answer. Cut before the shuffle.
    copies = Window.partitionBy("v").orderBy("vec_id")
    first = rows.withColumn("place", F.row_number().over(copies)).where(F.col("place") <= k + 1).select("vec_id", "v")

    def coded(some: DataFrame) -> DataFrame:
        return materialize(some.select("vec_id", F.size("v").alias("n"), "v").mapInArrow(
            _quantised, "vec_id long, n int, codes binary, scale double, loss double"), "codes")

    queries, candidates = coded(rows.where(is_query)), coded(first)

    def blocks(side: DataFrame, size: int, name: str) -> DataFrame:
        return side.groupBy("n").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))

    counts = blocks(queries, query_block, "query_blocks").join(blocks(candidates, candidate_block, "candidate_blocks"), "n")
    counts = materialize(counts, "blocks")  # a row per dimension
    tiles = counts.agg(F.coalesce(F.sum(F.col("query_blocks").cast("long") * F.col("candidate_blocks")), F.lit(0)).alias("n")).first()["n"]

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        """Every row in a block of its side, once for each block of the other side."""
        block = F.pmod(F.xxhash64("vec_id"), F.col(f"{own}_blocks")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1))
        return side.join(counts, "n").withColumn(f"{own}_block", block).withColumn(f"{other}_block", every)

    queries, candidates = dealt(queries, "query", "candidate"), dealt(candidates, "candidate", "query")
    cell = ["n", "query_block", "candidate_block"]
    columns = [*cell, "vec_id", "codes", "scale", "loss"]
    tasks = tasks_for(spark, tiles, 4)
    # Fresh columns for each side: they share the table of blocks.
    left, right = (side.select(*(F.col(c).alias(c) for c in columns)).repartition(tasks, *cell) for side in (queries, candidates))
    survivors = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(
        _tile(k), "query_id long, vec_id long, low double, high double")
    survivors = materialize(survivors, "survivors")
    kept = survivors.join(_kth(survivors, k), "query_id").where(F.col("high") >= F.col("least")).select("query_id", "vec_id")
    q = rows.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("norm2").alias("q2"))
    scored = kept.join(q, "query_id").join(rows, "vec_id").select(
        "query_id", "vec_id", (_sum_of_products(F.col("q"), F.col("v")) / (F.sqrt("q2") * F.sqrt("norm2"))).alias("score"))
    return scored.repartition("query_id").mapInArrow(_best(k), "query_id long, rank int, vec_id long, score double")


def _kth(survivors: DataFrame, k: int) -> DataFrame:
    """``query_id, least``: the ``k``-th best lower bound, or minus infinity where there are fewer rows."""
    best = survivors.repartition("query_id").select(
        "query_id", "vec_id", F.col("low").alias("score")).mapInArrow(_best(k), "query_id long, rank int, vec_id long, score double")
    return best.groupBy("query_id").agg(
        F.coalesce(F.min(F.when(F.col("rank") == k, F.col("score"))), F.lit(float("-inf"))).alias("least"))
