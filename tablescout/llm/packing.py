"""Lexical retrieval packing: windows filled with the nearest unused neighbours by BM25.

1. Every text becomes token ids, with an end id behind them, written once.
2. A document fills windows of its own from its start. What remains of it, shorter than a window, is
   a passage to be packed with others.
3. Passages are ordered by the rare tokens they share (three weighted races over a passage's
   distinct tokens, heavier for tokens in fewer passages) and cut into shards of bounded size.
   Document frequencies and the mean length cover all passages.
4. Each shard has an inverted index from token to (passage, BM25 weight). The first unused passage is
   a seed; the unused passages are ranked against it, those that fit fill its window in this order,
   and when none fits any more the best one left is cut to the window's end. What is left of the cut
   one is the next seed. A window that a shard cannot fill goes on with the next shard's first seed.
   So every window is full, but for the end of each task, which is cut into sequences whose lengths are powers of two.

Nothing is dropped or padded: each id lies in exactly one piece. Defined results: NULL and empty
texts are the end id alone. Each row is a document of its own, also where rows repeat a ``doc_id`` or
text. A NULL ``doc_id`` stays NULL. Equal scores go to the passage that comes first in the shard.
Other columns are ignored. The numbers of sequences are unique, not gapless.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tablescout.llm.common import as_identifier, identifier
from tablescout.llm.tokens import STRETCH, encoder, public_path
from tablescout.session import materialize

WINDOW = 1024
END_ID = 0
#: Passages of one inverted index.
SHARD = 512
#: Passages of one task.
TASK_PASSAGES = 50_000
K1, B = 1.2, 0.75
_PIECE = "did long, start long, ids binary, doc_tokens long, sequence_id long, offset long"


def _tokenised(path: str, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        kind = np.uint32 if coder.wide else np.uint16
        end = np.array([end_id], dtype=kind)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).cumsum()
            at = 0
            while at < len(sizes):
                stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + STRETCH, side="right")))
                ids = [np.append(x.astype(kind), end) for x in coder.encode(batch["text"].slice(at, stop - at))]
                yield pa.RecordBatch.from_arrays(
                    [batch["did"].slice(at, stop - at), pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([x.tobytes() for x in ids], pa.binary())], names=["did", "doc_tokens", "ids"])
                at = stop
        pa.default_memory_pool().release_unused()  # the worker stays, idle or with other work

    return run


def _wide(data: memoryview, kind: type) -> bytes:
    return np.frombuffer(data, dtype=kind).astype("<u4").tobytes()


def _own_windows(window: int, kind: type) -> Callable:
    """The windows that documents fill by themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (1 << 62) + (TaskContext.get().partitionId() << 36)
        width = np.dtype(kind).itemsize
        for batch in batches:
            rows: list[tuple] = []
            for did, tokens, ids in zip(batch["did"].to_pylist(), batch["doc_tokens"].to_pylist(), batch["ids"]):
                data = memoryview(ids.as_buffer())
                for start in range(0, tokens - window + 1, window):
                    rows.append((did, start, _wide(data[start * width : (start + window) * width], kind), tokens, number, 0))
                    number += 1
                if len(rows) >= 2000:
                    yield _pieces(rows)
                    rows = []
            if rows:
                yield _pieces(rows)

    return run


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)],
                                      names=["did", "start", "ids", "doc_tokens", "sequence_id", "offset"])


def _passage(ids: pa.Scalar, tokens: int, window: int, kind: type) -> np.ndarray:
    return np.frombuffer(ids.as_buffer(), dtype=kind)[tokens // window * window :]


def _frequencies(window: int, kind: type, size: int) -> Callable:
    """Per task and token: passages that hold it; in row ``size`` the passages, in ``size + 1`` their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, last = np.zeros(size + 2, dtype=np.int64), np.zeros(size, dtype=np.int32)
        for batch in batches:
            for tokens, ids in zip(batch["doc_tokens"].to_pylist(), batch["ids"]):
                passage = _passage(ids, tokens, window, kind)
                if len(passage):
                    places = np.arange(len(passage), dtype=np.int32)
                    last[passage] = places  # of a token's places one remains
                    counts[passage[last[passage] == places]] += 1
                    counts[size:] += (1, len(passage))
        hit = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(counts[hit])], names=["token", "n"])

    return run


def _passages(window: int, kind: type, costs) -> Callable:
    """Passages and the key that orders them: the winners of three races among a passage's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = costs.value
        for batch in batches:
            rows = []
            for did, tokens, ids in zip(batch["did"].to_pylist(), batch["doc_tokens"].to_pylist(), batch["ids"]):
                passage = _passage(ids, tokens, window, kind)
                if len(passage):
                    first, second, third = (int(passage[c[passage].argmin()]) for c in cost)
                    rows.append((did, tokens, passage.tobytes(), first, second, third))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)],
                                                 names=["did", "doc_tokens", "ids", "first", "second", "third"])

    return run


class Shard:
    """Inverted index over a bounded number of passages."""

    def __init__(self, passages: list[np.ndarray], idf: np.ndarray, mean: float):
        n = len(passages)
        lengths = np.array([len(p) for p in passages])
        keys = np.concatenate(passages).astype(np.int64) * n + np.repeat(np.arange(n), lengths)
        keys, counts = np.unique(keys, return_counts=True)  # by token, then passage
        self.token, self.passage = keys // n, keys % n
        bend = K1 * (1 - B + B * lengths / mean)
        self.weight = idf[self.token] * counts * (K1 + 1) / (counts + bend[self.passage])
        heads = np.flatnonzero(np.concatenate([[True], self.token[1:] != self.token[:-1]]))
        self._low = dict(zip(self.token[heads].tolist(), range(len(heads))))
        self._heads, self._sizes = heads, np.diff(np.append(heads, len(keys)))
        by_passage = np.argsort(self.passage, kind="stable")
        self._lists = np.split(np.searchsorted(self.token[heads], self.token[by_passage]),
                               np.searchsorted(self.passage[by_passage], np.arange(1, n)))
        self.n = n

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every passage for the distinct tokens of ``seed``."""
        lists = self._lists[seed]
        sizes = self._sizes[lists]
        total = int(sizes.sum())
        at = np.arange(total) + np.repeat(self._heads[lists] - (np.cumsum(sizes) - sizes), sizes)
        return np.bincount(self.passage[at], self.weight[at], minlength=self.n)


class Packer:
    """Pieces of one task's sequences, in order."""

    def __init__(self, window: int, kind: type, idf: np.ndarray, mean: float, number: int):
        self.window, self.kind, self.idf, self.mean = window, kind, idf, mean
        self.number, self.offset = number, 0
        self.open: list[tuple] = []  # pieces of the sequence that is being filled

    def _put(self, did: int, tokens: int, ids: np.ndarray, behind: int) -> None:
        """Append ids to the open sequence; ``behind`` ids of the document follow them."""
        self.open.append((did, tokens - behind - len(ids), ids.astype("<u4").tobytes(), tokens, self.number, self.offset))
        self.offset += len(ids)

    def _close(self) -> list[tuple]:
        done, self.open, self.offset = self.open, [], 0
        self.number += 1
        return done

    def shard(self, rows: list[tuple]) -> Iterator[tuple]:
        """Pack passages ``(did, tokens, ids)``; the last window stays open for the next shard."""
        index = Shard([r[2] for r in rows], self.idf, self.mean)
        sizes = np.array([len(r[2]) for r in rows])
        used = np.zeros(len(rows), dtype=bool)
        rest = {}  # passage -> ids of it that are still to be placed
        seed = 0
        while True:
            did, tokens, ids = rows[seed]
            ids = rest.pop(seed, ids)
            used[seed] = True
            space = self.window - self.offset
            self._put(did, tokens, ids[:space], max(0, len(ids) - space))
            if len(ids) > space:  # only the first seed of a shard can meet a window that is partly full
                yield from self._close()
                self._put(did, tokens, ids[space:], 0)
            free = np.flatnonzero(~used)
            ranked = free[np.argsort(-index.scores(seed)[free], kind="stable")]
            at, lengths = 0, sizes[ranked]
            cut = None
            while self.offset < self.window:
                fits = lengths[at:] <= self.window - self.offset
                step = int(fits.argmax()) if len(fits) else 0
                if not len(fits) or not fits[step]:
                    break
                at += step
                did, tokens, ids = rows[ranked[at]]
                used[ranked[at]] = True
                self._put(did, tokens, ids, 0)
                at += 1
            if self.offset < self.window:
                unused = ranked[~used[ranked]]
                if not len(unused):
                    return  # the window stays open for the next shard
                cut = int(unused[0])
                did, tokens, ids = rows[cut]
                space = self.window - self.offset
                self._put(did, tokens, ids[:space], len(ids) - space)
                rest[cut] = ids[space:]
            yield from self._close()
            if cut is not None:
                seed = cut
            else:
                unused = np.flatnonzero(~used)
                if not len(unused):
                    return
                seed = int(unused[0])

    def end(self) -> Iterator[tuple]:
        """Cut the open window into sequences whose lengths are powers of two."""
        ids = [(did, start, np.frombuffer(data, "<u4"), tokens) for did, start, data, tokens, _, _ in self.open]
        left = sum(len(x[2]) for x in ids)
        self.open = []
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            offset = 0
            while offset < size:
                did, start, data, tokens = ids[0]
                part = data[: size - offset]
                yield did, start, part.tobytes(), tokens, self.number, offset
                offset += len(part)
                ids[0] = (did, start + len(part), data[len(part):], tokens)
                if len(part) == len(data):
                    ids.pop(0)
            self.number += 1


def _packed(window: int, kind: type, shard: int, statistics) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mean = statistics.value
        packer = Packer(window, kind, idf, mean, TaskContext.get().partitionId() << 36)
        rows: list[tuple] = []
        for batch in batches:
            for did, tokens, ids in zip(batch["did"].to_pylist(), batch["doc_tokens"].to_pylist(), batch["ids"].to_pylist()):
                rows.append((did, tokens, np.frombuffer(ids, dtype=kind)))
                if len(rows) == shard:
                    pieces = list(packer.shard(rows))
                    rows = []
                    if pieces:
                        yield _pieces(pieces)
        pieces = list(packer.shard(rows)) if rows else []
        pieces += packer.end()
        if pieces:
            yield _pieces(pieces)

    return run


def pack(documents: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID,
         shard: int = SHARD) -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens, sequence_id, offset`` per piece; ``ids`` are little-endian 32-bit."""
    spark = documents.sparkSession
    path = tokenizer or public_path()
    coder = encoder(path)
    kind, size = (np.uint32 if coder.wide else np.uint16), max(coder.size, end_id + 1)
    texts = documents.select(identifier().alias("did"), "text")
    tokens = materialize(texts.mapInArrow(_tokenised(path, end_id), "did long, doc_tokens long, ids binary"), "tokens")

    # A row per token of the vocabulary, so its size has a fixed bound.
    counted = tokens.mapInArrow(_frequencies(window, kind, size), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = np.zeros(size + 2)
    for row in counted.collect():
        counts[row["token"]] = row["n"]
    passages, total = counts[size], counts[size + 1]
    idf = np.log1p((passages - counts[:size] + 0.5) / (counts[:size] + 0.5))
    mean = max(total / max(passages, 1.0), 1.0)
    chances = np.random.default_rng(7).random((3, size))
    costs = spark.sparkContext.broadcast((-np.log(chances) / np.maximum(idf, 1e-9) ** 2).astype(np.float32))
    statistics = spark.sparkContext.broadcast((idf, mean))

    schema = "did long, doc_tokens long, ids binary, first int, second int, third int"
    keyed = tokens.mapInArrow(_passages(window, kind, costs), schema)
    order = ["first", "second", "third", "did", "doc_tokens", "ids"]
    tasks = max(1, math.ceil(passages / TASK_PASSAGES), min(spark.sparkContext.defaultParallelism, math.ceil(passages / (4 * shard))))
    dealt = keyed.repartitionByRange(tasks, *order[:4]).sortWithinPartitions(*order)
    shared = dealt.mapInArrow(_packed(window, kind, shard, statistics), _PIECE)
    own = tokens.mapInArrow(_own_windows(window, kind), _PIECE)
    pieces = own.unionByName(shared)
    return pieces.select(as_identifier("did").alias("doc_id"), "start", F.floor(F.octet_length("ids") / 4).alias("length"),
                         "ids", "doc_tokens", "sequence_id", "offset")


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
