"""Small helpers the operators share."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from tablescout.llm.words import buffers
from tablescout.session import materialize

#: A side of a join is broadcast only if it was measured to hold at most this many bytes.
BROADCAST_BYTES = 32 << 20
#: Bytes a row takes in a broadcast table besides its variable-length values.
ROW_BYTES = 48
#: Stands for a missing identifier inside an operator. The smallest long is therefore no identifier of its
#: own: a row that has it is treated as one without an identifier, in every operator that uses this module.
NO_ID = -(2**63)


def identifier(name: str = "doc_id") -> Column:
    """The identifier as a number that is never NULL: joins and orders then need no special case."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def as_identifier(name: str) -> Column:
    """Undo ``identifier``."""
    return F.when(F.col(name) != NO_ID, F.col(name))


def text_mark(name: str = "text") -> Column:
    """A 64-bit digest of the text. With the identifier it names a document, also where ids are NULL or repeated."""
    return F.xxhash64(name)


def small_side(df: DataFrame, variable: Column | None = None) -> DataFrame:
    """``df`` marked for broadcast if its measured size allows it, unmarked (so shuffled) otherwise.

    ``df`` should be a written table: it is counted here and read again by the join. ``variable``
    gives the bytes of a row's variable-length values.
    """
    extra = F.coalesce(F.sum(variable if variable is not None else F.lit(0)), F.lit(0))
    size = df.agg(F.count(F.lit(1)).alias("rows"), extra.alias("extra")).first()
    return F.broadcast(df) if size["rows"] * ROW_BYTES + size["extra"] <= BROADCAST_BYTES else df


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table, without the shuffle files it came from.

    Spark deletes shuffle files when the driver's collector finds that nothing refers to them, which
    on a quiet driver may be long after the next step has filled the disks. What held them is freed by
    a first collection, they themselves by a second.
    """
    written = materialize(df, name)
    for _ in range(2):
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.5)
    return written


def tasks_for(spark, rows: float, per_task: float) -> int:
    """A number of tasks that follows the measured rows, with work for every core."""
    return max(spark.sparkContext.defaultParallelism, int(rows // per_task) + 1)


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coder = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        offsets, data = buffers(batch["text"])
        view = memoryview(data)
        packed = [coder.compress(view[offsets[i] : offsets[i + 1]]) for i in range(len(offsets) - 1)]
        yield pa.RecordBatch.from_arrays([batch["did"], batch["mark"], pa.array(packed, pa.binary())], names=["did", "mark", "packed"])


def compressed_texts(documents: DataFrame) -> DataFrame:
    """``did, mark, packed``: texts compressed for a shuffle, whose own codec gains little; NULL is empty."""
    texts = documents.select(identifier().alias("did"), text_mark().alias("mark"), "text")
    return texts.mapInArrow(_compressed, "did long, mark long, packed binary")


def unpacked(column: pa.Array) -> Iterator[bytes]:
    coder = zstandard.ZstdDecompressor()
    return (coder.decompress(x.as_buffer()) for x in column)
