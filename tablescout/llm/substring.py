"""Exact removal of repeated passages by super-k-mer partitioning.

A window is ``window`` consecutive words of one document. Its minimiser is the smallest hash among
its runs of ``gram`` words (the leftmost of equal ones), so equal windows have equal minimisers.
Consecutive windows that share a minimiser form a super-k-mer: one stretch of text.

1. Minimisers are counted. Those that occur once are dropped: no window below them can have an equal.
2. The other super-k-mers' text travels as one packed string to the bucket of its minimiser, where the windows
   are sorted, compared word by word, and all but the first occurrence are reported as word ranges.
3. A minimiser with very many super-k-mers is dealt over several buckets by document. Each reports
   what is not first in it; the windows first in their bucket meet once more, one row per window and
   bucket, by their digest.
4. The ranges are joined back to the documents.

Defined results: NULL and empty texts have no words. A text shorter than a window keeps its words.
A document is a ``doc_id`` and its text together (``common.text_mark``): rows that repeat both get the
same result; NULL ids, or one id on different texts, are different documents. Order between documents
is by ``doc_id``, NULL counting as the smallest, then by mark. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tablescout.llm.common import as_identifier, compressed_texts, identifier, settled, tasks_for, text_mark, unpacked
from tablescout.llm.words import buffers, hashed_words, mix

WINDOW = 20
GRAM = 6
#: Super-k-mers of one minimiser that one bucket takes.
BUCKET_ROWS = 20_000
#: Words whose windows are sorted together inside a bucket, more only for one minimiser.
BUCKET_WORDS = 400_000
_POSITION = np.uint64((1 << 24) - 1)
_SEGMENT = 1 << 23


def super_kmers(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window and number of windows of each super-k-mer of one document."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = []
    for start in range(0, n, _SEGMENT):  # positions inside a segment fit into the low bits
        windows = min(_SEGMENT, n - start)
        own = hashes[start : start + windows + window - 1]
        grams = own[: len(own) - gram + 1].copy()
        for i in range(1, gram):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + own[i : len(own) - gram + 1 + i]
        grams = mix(grams)
        least = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
        width, span = 1, window - gram + 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[:windows], least[span - width : span - width + windows])
        at = (least & _POSITION).astype(np.int64)
        heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        found.append((grams[at[heads]].view(np.int64), heads + start, np.diff(np.append(heads, windows))))
    return tuple(np.concatenate(x) for x in zip(*found))


def _counted(window: int, gram: int) -> Callable:
    """How often each minimiser heads a super-k-mer of some documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, bounds, hashes, _, _ in hashed_words(batch["text"]):
                own = [super_kmers(hashes[a:b], window, gram)[0] for a, b in zip(bounds[:-1], bounds[1:]) if b - a >= window]
                if own:
                    keys, n = np.unique(np.concatenate(own), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["minimiser", "n"])

    return run


def _places(window: int, gram: int) -> Callable:
    """Minimiser and place (first window, bytes of the stretch) of every super-k-mer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch["did"].to_numpy(), batch["mark"].to_numpy()
            for row, bounds, hashes, first, last in hashed_words(batch["text"]):
                parts = []
                for i in range(len(bounds) - 1):
                    a, b = bounds[i], bounds[i + 1]
                    if b - a >= window:
                        key, head, n = super_kmers(hashes[a:b], window, gram)
                        parts.append((np.full(len(key), ids[row + i]), np.full(len(key), marks[row + i]), key, head,
                                      first[a + head], last[a + head + n + window - 2]))
                if parts:
                    columns = [np.concatenate(x) for x in zip(*parts)]
                    columns[3:] = [x.astype(np.int32) for x in columns[3:]]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns],
                                                     names=["did", "mark", "minimiser", "head", "low", "high"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The listed stretches of each document's text."""
    for batch in batches:
        parts: list[tuple] = []
        size = 0
        for did, mark, whole, places in zip(batch["did"].to_pylist(), batch["mark"].to_pylist(), unpacked(batch["packed"]), batch["places"]):
            for place in places.as_py():
                text = whole[place["low"] : place["high"]]
                parts.append((place["minimiser"], place["parts"], did, mark, place["head"], text))
                size += len(text)
            if size > 4 << 20:
                yield _packed_batch(parts)
                parts, size = [], 0
        if parts:
            yield _packed_batch(parts)


def _packed_batch(parts: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*parts), kinds)],
                                      names=["minimiser", "parts", "did", "mark", "head", "packed"])


def _digests(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each row of word hashes."""
    a, b = np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.uint64)
    for i in range(rows.shape[1]):
        a = a * np.uint64(0x9E3779B97F4A7C15) + rows[:, i]
        b = b * np.uint64(0xD6E8FEB86659FD93) + (rows[:, i] ^ (rows[:, i] >> np.uint64(29)))
    return mix(a), mix(b)


def later_windows(groups: np.ndarray, ids: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whether each window repeats one of its group that starts earlier; the order used and the digests.

    Windows are sorted by group, digest and place. Neighbours of equal digests are compared word by
    word; should two unequal ones ever meet, all windows are ordered by their words instead.
    """
    a, b = _digests(rows)
    order = np.lexsort((starts, ids, a, groups))
    same = (groups[order][1:] == groups[order][:-1]) & (a[order][1:] == a[order][:-1])
    equal = (rows[order][1:] == rows[order][:-1]).all(axis=1)
    if (same & ~equal).any():
        order = np.lexsort((starts, ids, *rows.T, groups))
        equal = (rows[order][1:] == rows[order][:-1]).all(axis=1)
        same = (groups[order][1:] == groups[order][:-1]) & equal
    heads = np.flatnonzero(np.concatenate([[True], ~same]))
    lead = np.repeat(heads, np.diff(np.append(heads, len(order))))
    later = np.zeros(len(order), dtype=bool)
    later[order] = (ids[order] != ids[order][lead]) | (starts[order] != starts[order][lead])
    return later, order, a, b


def _bucket(window: int) -> Callable:
    """Ranges of windows that are not first in their bucket; of hot minimisers also the first ones."""

    def sorted_groups(tables: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(tables).combine_chunks()
        ids, marks, heads = table["did"].to_numpy(), table["mark"].to_numpy(), table["head"].to_numpy().astype(np.int64)
        # Documents as numbers in the order of id and mark.
        by = np.lexsort((marks, ids))
        docs = np.empty(len(by), dtype=np.int64)
        docs[by] = np.cumsum(np.concatenate([[False], (ids[by][1:] != ids[by][:-1]) | (marks[by][1:] != marks[by][:-1])]))
        parts = table["parts"].to_numpy()
        keys = table["minimiser"].to_numpy()
        row_of, start_of, grams = [], [], []
        for row, bounds, hashes, _, _ in hashed_words(table["packed"]):
            counts = np.maximum(np.diff(bounds) - window + 1, 0)  # windows of each string
            total = int(counts.sum())
            base = np.repeat(np.cumsum(counts) - counts, counts)
            inner = np.arange(total) - base
            view = np.lib.stride_tricks.sliding_window_view(hashes, window)
            grams.append(view[np.repeat(bounds[:-1], counts) + inner])
            row_of.append(np.repeat(np.arange(row, row + len(counts)), counts))
            start_of.append(inner)
        rows, at, inner = np.concatenate(grams), np.concatenate(row_of), np.concatenate(start_of)
        starts = heads[at] + inner
        later, _, a, b = later_windows(keys[at], docs[at], starts, rows)
        # Runs of later windows of one string become one range of words.
        hit = np.flatnonzero(later)
        if len(hit):
            new = np.concatenate([[True], (at[hit][1:] != at[hit][:-1]) | (inner[hit][1:] != inner[hit][:-1] + 1)])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(hit)) - 1
            yield _ranges(ids[at[hit[first]]], marks[at[hit[first]]], starts[hit[first]], starts[hit[last]] + window, None, None)
        open_ = np.flatnonzero(~later & (parts[at] > 1))
        if len(open_):
            yield _ranges(ids[at[open_]], marks[at[open_]], starts[open_], starts[open_] + window, a[open_], b[open_])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, limit = 0, BUCKET_WORDS * 6
        for batch in batches:
            keys = batch["minimiser"].to_numpy()
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            offsets, _ = buffers(batch["packed"])
            at = 0
            while at < len(keys):
                # Rows up to the last change of minimiser within the limit; one minimiser stays together.
                stop = int(np.searchsorted(offsets, offsets[at] + max(limit - size, 0), side="right")) - 1
                if stop >= len(keys):
                    held.append(batch.slice(at))
                    size += int(offsets[-1] - offsets[at])
                    break
                good = cuts[(cuts > at) & (cuts <= stop)]
                fresh = bool(held) and held[-1]["minimiser"][-1].as_py() != int(keys[at])
                if len(good):
                    cut = int(good[-1])
                elif fresh:
                    cut = at
                else:
                    later = cuts[cuts > at]
                    if not len(later):
                        held.append(batch.slice(at))
                        size += int(offsets[-1] - offsets[at])
                        break
                    cut = int(later[0])
                if cut > at:
                    held.append(batch.slice(at, cut - at))
                yield from sorted_groups(held)
                held, size, at = [], 0, cut
        if held:
            yield from sorted_groups(held)

    return run


_RANGE = "did long, mark long, low int, high int, digest_a long, digest_b long"


def _ranges(ids, marks, low, high, a, b) -> pa.RecordBatch:
    none = pa.nulls(len(ids), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(ids), pa.array(marks), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)),
         none if a is None else pa.array(a.view(np.int64)), none if b is None else pa.array(b.view(np.int64))],
        names=["did", "mark", "low", "high", "digest_a", "digest_b"])


def repeated_ranges(documents: DataFrame, window: int = WINDOW, gram: int = GRAM,
                    bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``did, mark, low, high``: word ranges covered by windows that also start earlier. Ranges may overlap."""
    spark = documents.sparkSession
    document = ["did", "mark"]
    texts = documents.select(identifier().alias("did"), text_mark().alias("mark"), "text").where(F.col("text").isNotNull())
    counts = texts.mapInArrow(_counted(window, gram), "minimiser long, n long").groupBy("minimiser").agg(F.sum("n").alias("n"))
    repeated = counts.where("n > 1").select("minimiser", F.ceil(F.col("n") / bucket_rows).cast("int").alias("parts"))
    places = texts.mapInArrow(_places(window, gram), "did long, mark long, minimiser long, head int, low int, high int")
    wanted = places.join(repeated, "minimiser").groupBy(*document).agg(
        F.collect_set(F.struct("minimiser", "parts", "head", "low", "high")).alias("places"))
    wanted = settled(wanted, "places")
    packed = compressed_texts(documents).join(wanted, document).mapInArrow(
        _packed, "minimiser long, parts int, did long, mark long, head int, packed binary")
    packed = packed.withColumn("part", F.pmod(F.xxhash64(*document), F.col("parts")).cast("int"))
    travelling = wanted.agg(F.sum(F.size("places")).alias("n")).first()["n"] or 0
    tasks = tasks_for(spark, travelling, 800_000)
    dealt = packed.repartition(tasks, "minimiser", "part").sortWithinPartitions("minimiser", "part", *document, "head").drop("part")
    found = settled(dealt.mapInArrow(_bucket(window), _RANGE), "ranges")
    own = found.where(F.col("digest_a").isNull()).select(*document, "low", "high")
    same = Window.partitionBy("digest_a", "digest_b")
    place = F.struct(*document, "low")
    met = found.where(F.col("digest_a").isNotNull()).withColumn("least", F.min(place).over(same))
    return own.unionByName(met.where(place != F.col("least")).select(*document, "low", "high"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        totals, removed, digests, texts = [], [], [], []
        for whole, ranges in zip(unpacked(batch["packed"]), batch["ranges"]):
            words = whole.split()
            gone = 0
            if ranges.is_valid:
                mask = np.ones(len(words), dtype=bool)
                for place in ranges.as_py():
                    mask[place["low"] : place["high"]] = False
                gone = len(words) - int(mask.sum())
                words_kept = [words[j] for j in np.flatnonzero(mask)]
            else:
                words_kept = words
            text = b" ".join(words_kept)
            totals.append(len(words))
            removed.append(gone)
            digests.append(hashlib.sha256(text).hexdigest())
            texts.append(text)
        yield pa.RecordBatch.from_arrays(
            [batch["did"], pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()),
             pa.array(texts, pa.binary()).cast(pa.string())],
            names=["did", "n_words", "n_removed", "kept_sha256", "kept_text"])


def drop_repeats(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept_text`` per row of ``documents(doc_id, text)``."""
    ranges = repeated_ranges(documents, window, gram, bucket_rows)
    ranges = ranges.groupBy("did", "mark").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))
    joined = compressed_texts(documents).join(ranges, ["did", "mark"], "left")
    schema = "did long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    return joined.mapInArrow(_kept, schema).withColumn("doc_id", as_identifier("did")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")
