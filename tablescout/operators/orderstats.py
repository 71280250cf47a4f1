"""Exact order statistics of a column by radix selection: no sort, and no task whose input grows with the data.

A double is mapped to a 64-bit number of the same order. Each of four rounds counts, among the values
that share the digits chosen so far, how many have each value of the next 16-bit digit, and chooses the
digit in which the wanted rank falls. A task counts into arrays of fixed size; what is shuffled
is at most 65536 counts per task and wanted rank, and what is looked through is 65536 counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

_DIGIT, _ROUNDS = 16, 4
_VALUES = 1 << _DIGIT
_SIGN = np.uint64(1 << 63)


@dataclass
class _Wanted:
    """A rank that is looked for: its statistic, the digits found so far, and its rank among the values that share them."""

    name: str
    rank: int
    prefix: int = 0


def nearest_rank(n: int, p: float) -> list[int]:
    """One-based rank of ``sorted_values[int(n * p)]``."""
    return [int(n * p) + 1]


def middle_ranks(n: int) -> list[int]:
    """One-based ranks whose mean is the median."""
    return [(n - 1) // 2 + 1, n // 2 + 1]


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles; both zeros are one value and NaN is above all others."""
    values = np.where(np.isnan(values), np.nan, values + 0.0)
    bits = np.ascontiguousarray(values, dtype=np.float64).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def from_bits(number: int) -> float:
    """The inverse of :func:`ordered_bits`."""
    bits = np.array([number], dtype=np.uint64)
    return float(np.where(bits & _SIGN, bits ^ _SIGN, ~bits).view(np.float64)[0])


def _digits(prefixes: list[int], level: int) -> Callable:
    """Counts of the digit at ``level`` among the values with each prefix."""
    above, shift = np.uint64(64 - _DIGIT * level), np.uint64(64 - _DIGIT * (level + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(prefixes), _VALUES), dtype=np.int64)
        for batch in batches:
            bits = ordered_bits(batch["v"].to_numpy(zero_copy_only=False))
            for i, prefix in enumerate(prefixes):
                own = bits if level == 0 else bits[(bits >> above) == np.uint64(prefix)]
                digits = ((own >> shift) & np.uint64(_VALUES - 1)).astype(np.int64)
                counts[i] += np.bincount(digits, minlength=_VALUES)
        which, digit = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(digit, pa.int32()), pa.array(counts[which, digit], pa.int64())],
                                         names=["which", "digit", "n"])

    return run


def _histogram(values: DataFrame, prefixes: list[int], level: int) -> DataFrame:
    """``which, digit, upto``: running counts over the digits of each prefix."""
    counts = values.mapInArrow(_digits(prefixes, level), "which int, digit int, n long")
    summed = counts.groupBy("which", "digit").agg(F.sum("n").alias("n"))
    return summed.withColumn("upto", F.sum("n").over(Window.partitionBy("which").orderBy("digit")))


def order_statistics(df: DataFrame, column: str, quantiles: dict[str, float | None]) -> DataFrame:
    """One row with a column per name: the value at ``int(n * p)``, or the median where ``p`` is None; 0.0 when empty."""
    spark = df.sparkSession
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    wanted: list[_Wanted] = []
    for level in range(_ROUNDS):
        prefixes = sorted({w.prefix for w in wanted}) if level else [0]
        histogram = _histogram(values, prefixes, level)
        if level == 0:
            # The first digits are few enough to be counted once for all ranks, whose number follows from them.
            first = np.array(sorted((r["digit"], r["upto"]) for r in histogram.collect())).reshape(-1, 2)  # at most 65536
            n = int(first[-1, 1]) if len(first) else 0
            wanted = [_Wanted(name, rank) for name, p in quantiles.items() if n
                      for rank in (middle_ranks(n) if p is None else nearest_rank(n, p))]
            for w in wanted:
                at = int(np.searchsorted(first[:, 1], w.rank))
                w.prefix, w.rank = int(first[at, 0]), w.rank - (int(first[at - 1, 1]) if at else 0)
            if not wanted:
                break
            continue
        picks = []
        for i, w in enumerate(wanted):
            own = (F.col("which") == prefixes.index(w.prefix)) & (F.col("upto") >= w.rank)
            picks.append(F.min(F.when(own, F.struct("digit", (F.col("upto") - F.col("n")).alias("before")))).alias(f"w{i}"))
        for w, found in zip(wanted, histogram.agg(*picks).first()):
            w.prefix, w.rank = (w.prefix << _DIGIT) | found["digit"], w.rank - found["before"]
    found = {name: [from_bits(w.prefix) for w in wanted if w.name == name] for name in quantiles}
    return spark.range(1).select(*(F.lit(float(np.mean(own)) if own else 0.0).alias(name) for name, own in found.items()))
