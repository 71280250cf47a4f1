"""Whitening of embeddings: rows projected on the leading components of their covariance, at unit variance.

1. Entries ``c`` become whole numbers ``x = floor(256 * c)``. The fit list holds each distinct ``x``
   vector once, packed into blocks of about a megabyte, as a written table.
2. The covariance is never formed. A product with it is one pass over the blocks: each block is
   centred, multiplied by the (narrow) operand and then by its own transpose; a task adds up its blocks
   and Spark adds up the tasks, one row per dimension.
3. ``jacobi.leading`` finds the leading eigenpairs from such products. What the driver holds is a
   few columns as long as a vector.
4. Every row is projected, and divided by the root of the component's variance.

Count and sums of the fit list are exact, and so are the rows' deviations.

Defined results: rows whose vector is NULL or empty or holds a NULL or non-finite entry drop out, and
so do vectors of another length than most have (of lengths equally frequent the largest counts) and
those with an entry of 2^32 or more, whose whole numbers could not be summed up exactly. Every other
row is returned, those with a NULL or repeated ``vec_id`` or a repeated vector too. Components without
variance are left out: a table with fewer distinct vectors, or with one only, has fewer components or
none, and an empty table has no rows. A deviation that does not fit a long is NULL. Signs are fixed
by the largest entry of a component being positive. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablescout.llm import jacobi
from tablescout.session import materialize

COMPONENTS = 4
#: Entries become whole numbers at this scale; larger numbers than ``LARGEST`` are not taken.
SCALE, LARGEST = 256, 2**40
#: Bytes of a block of the fit list.
BLOCK_BYTES = 1 << 20
#: Components below this part of the whole variance have none.
NO_VARIANCE = 1e-12


@dataclass(frozen=True)
class Whitening:
    """Components as columns, with what is needed to apply and to judge them."""

    rows: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.rows for s in self.sums])


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """``vec_id, x``: the usable rows, as whole numbers."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST / SCALE)))
    rows = rows.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long")).alias("x"))
    return materialize(rows, "whole-numbers")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _blocks(dims: int) -> Callable:
    rows = max(1, BLOCK_BYTES // (8 * dims))

    def packed(matrix: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([matrix.astype("<i8").tobytes()], pa.binary())], names=["block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = np.zeros((0, dims), dtype=np.int64)
        for batch in batches:
            waiting = np.concatenate([waiting, _matrix(batch["x"], dims)])
            whole = len(waiting) - len(waiting) % rows
            for start in range(0, whole, rows):
                yield packed(waiting[start : start + rows])
            waiting = waiting[whole:]
        if len(waiting):
            yield packed(waiting)

    return run


def _added(blocks: DataFrame, dims: int, of_block: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of ``of_block``, a matrix of fixed shape: one pass, a row of it per row of the sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for block in batch["block"]:
                part = of_block(np.frombuffer(block.as_buffer(), "<i8").reshape(-1, dims))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), *map(pa.array, np.ascontiguousarray(total.T))],
                                             names=["at", *(f"c{i}" for i in range(total.shape[1]))])

    probe = of_block(np.zeros((1, dims), dtype=np.int64))
    names = [f"c{i}" for i in range(probe.shape[1])]
    exact = probe.dtype.kind == "i"
    schema = ", ".join(["at long", *(f"{n} {'long' if exact else 'double'}" for n in names)])
    parts = blocks.mapInArrow(run, schema)
    sums = [F.sum(F.col(n).cast("decimal(38,0)") if exact else F.col(n)).alias(n) for n in names]
    rows = sorted(parts.groupBy("at").agg(*sums).collect())  # a row per dimension
    return np.array([[int(x) if exact else x for x in row[1:]] for row in rows], dtype=object if exact else float)


def fit(numbers: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The leading components of ``whole_numbers`` rows of one length; None where there is no variance."""
    first = numbers.select(F.size("x").alias("n")).first()
    if first is None:
        return None
    dims = first["n"]
    blocks = materialize(numbers.select("x").distinct().mapInArrow(_blocks(dims), "block binary"), "fit")

    def counted(block: np.ndarray) -> np.ndarray:
        return np.vstack([np.full((1, 1), len(block)), block.sum(axis=0)[:, None]])

    count, *sums = (int(s) for s in _added(blocks, dims, counted)[:, 0])
    mean = np.array([s / count for s in sums])
    trace = _added(blocks, dims, lambda block: ((block - mean) ** 2).sum(axis=0)[:, None]).sum() / count
    if not trace > 0:
        return None

    def product(operand: np.ndarray) -> np.ndarray:
        def of_block(block: np.ndarray) -> np.ndarray:
            centred = block - mean
            return centred.T @ (centred @ operand)

        return _added(blocks, dims, of_block) / count

    values, vectors = jacobi.leading(product, dims, components)
    some = values > NO_VARIANCE * trace
    values, vectors = values[some], vectors[:, some]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])

    # The fitted rows themselves: their whitened values' mean, then their covariance around it.
    scaled = vectors / np.sqrt(values)
    centre = _added(blocks, dims, lambda block: ((block - mean) @ scaled).sum(axis=0)[:, None])[:, 0] / count

    def spread(block: np.ndarray) -> np.ndarray:
        own = (block - mean) @ scaled - centre
        return own.T @ own

    error = float(np.abs(_added(blocks, dims, spread) / count - np.eye(len(values))).max())
    return Whitening(count, tuple(sums), values, vectors, float(trace), error)


def deviations(x: np.ndarray, count: int, sums: tuple[int, ...]) -> list[int | None]:
    """``sum((count * x - sums)^2)`` of each row, exactly; None where a long cannot hold it."""
    far = count * float(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if far * far * x.shape[1] < 2**62:
        off = count * x - np.array(sums, dtype=np.int64)
        return (off * off).sum(axis=1).tolist()
    exact = [sum((count * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [e if e < 2**63 else None for e in exact]


def _projected(found: Whitening) -> Callable:
    scaled, mean, count = found.vectors / np.sqrt(found.values), found.mean, len(found.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch["x"], len(mean))
            rows = pa.array(np.repeat(np.arange(len(x)), count))
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"].take(rows), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                 pa.array(deviations(x, found.rows, found.sums), pa.int64()).take(rows), pa.array(((x - mean) @ scaled).ravel())],
                names=["vec_id", "component", "deviation", "whitened"])

    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row per usable row of
    ``vectors(vec_id, embedding)`` and component."""
    numbers = whole_numbers(vectors)
    lengths = numbers.groupBy(F.size("x").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    usual = lengths.orderBy(F.desc("rows"), F.desc("n")).first()
    if usual is not None:
        numbers = numbers.where(F.size("x") == usual["n"])
    found = fit(numbers, components)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, deviation long, whitened double"
    if found is None:
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, "
                                                        "whitened double, explained double, identity_error double")
    explained = F.element_at(F.array(*(F.lit(float(v / found.trace)) for v in found.values)), F.col("component"))
    return numbers.mapInArrow(_projected(found), schema).select(
        "vec_id", "component", F.lit(found.rows).cast("long").alias("n"), "deviation", "whitened",
        explained.alias("explained"), F.lit(found.identity_error).alias("identity_error"))
