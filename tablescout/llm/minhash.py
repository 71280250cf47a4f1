"""Near-duplicate classes by DartMinHash.

A document is the multiset of its five-word shingles: a shingle's weight is how often it occurs, and
similarity is the weighted Jaccard coefficient (sum of smaller weights over sum of larger ones; for
documents that repeat no shingle, the plain Jaccard coefficient).

1. Darts are thrown by hash into the region of each element: one unit of height per occurrence, with
   a rank as the other axis. The same element receives the same darts in every document. Darts up to a rank at which a document expects
   ``k ln k + 2k`` of them fall into ``k`` coordinates; each keeps its earliest, and the rank limit
   is doubled while a coordinate is empty. Two documents agree in a coordinate with a probability
   equal to their similarity.
2. Documents of equal multisets are one representative from here on.
3. Signatures are banded. In each bucket that holds several documents the best connected one (the
   sum of its buckets' sizes, a number that is highest for the original of a family of copies) is
   the hub; pairs of hub and member are verified exactly on the shingles, and linked.
4. Documents that share a bucket but not yet a class are compared in blocks of bounded size: pairs
   whose signatures may reach the threshold are verified exactly, unless a link has joined their
   classes already. A block gives back no more links than it has documents, however many pairs it
   compares. So every pair that shares a bucket is either verified, in one class anyhow, or excluded
   by its signatures. (At 0.8 a pair shares none of 24 buckets of four coordinates with probability 3.2e-6, and
   its signatures agree in fewer than the 58 of 96 coordinates asked for with probability 3.0e-6: 6.2e-6 together.)
5. The links' connected components are the classes.

A document is a row's ``doc_id`` and text together (``common.text_mark``): NULL ids, or one id on different
texts, are different documents. Defined results: a class is named after its first document, by ``doc_id``
(NULL counting as the smallest), then mark: ``class_id`` is that document's id, ``class_mark`` its mark, which
tells classes apart that begin with the same id. NULL, empty and blank texts have no shingles and are
classes of their own; a text of fewer than five words is one shingle. Rows that repeat a ``doc_id`` and text
get equal results. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablescout.llm.common import NO_ID, as_identifier, identifier, small_side, text_mark
from tablescout.llm.components import components
from tablescout.llm.words import hashed_words, mix
from tablescout.session import materialize

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 24
BAND_ROWS = 4
#: Documents of one block in the comparison inside crowded buckets, and shingles a document has room for there.
BLOCK = 1024
BLOCK_SHINGLES = 1024
#: Documents whose darts are thrown together.
DOCUMENTS = 250
_FINE = 6  # the lowest rank layer is 2**-_FINE high
_LAYERS = [(0.0, 2.0**-_FINE), (2.0**-_FINE, 0.25), (0.25, 1.0)]


def _layers(limit: float) -> list[tuple[float, float]]:
    """Rank intervals up to ``limit``. They are the same for every document."""
    layers = list(_LAYERS)
    while layers[-1][1] < limit:
        layers.append((layers[-1][1], 2 * layers[-1][1]))
    return [x for x in layers if x[0] < limit]


def _poisson(area: float) -> np.ndarray:
    """Cumulative distribution of the number of darts in a region."""
    n = np.arange(int(area + 12 * math.sqrt(area) + 24))
    logs = n * math.log(area) - area - np.cumsum(np.log(np.maximum(n, 1)))
    return np.cumsum(np.exp(logs))


def _uniform(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(11)).astype(np.float64) * 2.0**-53


def shingle_keys(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the runs of ``size`` words; a shorter text is one shingle."""
    n = min(size, len(hashes))
    keys = hashes[: len(hashes) - n + 1].copy()
    for i in range(1, n):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - n + 1 + i]
    keys = mix(keys)
    keys.sort()
    return keys


def occurrences(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """One 64-bit key per unit of weight: equal shingles of a document are told apart by their number."""
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(new)
    nth = np.arange(len(keys)) - np.repeat(heads, np.diff(np.append(heads, len(keys))))
    return np.where(nth == 0, keys, mix(keys + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def signatures(strips: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """Rank of the earliest dart of each document and coordinate; every document has a strip."""
    weights = np.bincount(doc, minlength=n_docs).astype(np.float64)
    limits = (k * math.log(k) + 2 * k) / weights
    result = np.full((n_docs, k), np.inf)
    todo = np.arange(n_docs)
    while len(todo):
        if len(todo) < n_docs:
            chosen = np.zeros(n_docs, dtype=bool)
            chosen[todo] = True
            mask = chosen[doc]
            own, of = strips[mask], doc[mask]
        else:
            own, of = strips, doc
        flat = result.reshape(-1)
        limit_of = limits[of]
        for i, (low, high) in enumerate(_layers(float(limits[todo].max()))):
            live = limit_of > low
            some, where = (own, of) if live.all() else (own[live], of[live])
            seed = mix(some + np.uint64(0xA0761D6478BD642F * (i + 1) % 2**64))
            darts = np.searchsorted(_poisson(high - low), _uniform(seed), side="right")
            hit = np.flatnonzero(darts)
            darts = darts[hit]
            total = int(darts.sum())
            nth = np.arange(total) - np.repeat(np.cumsum(darts) - darts, darts)
            dart = mix(np.repeat(seed[hit], darts) + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0xE7037ED1A0B428DB))
            rank = low + (high - low) * _uniform(dart)
            at = np.repeat(where[hit], darts)
            early = rank <= limits[at]
            spot = at[early] * k + (mix(dart[early] ^ np.uint64(0x8EBC6AF09C88C6E3)) % np.uint64(k)).astype(np.int64)
            np.minimum.at(flat, spot, rank[early])
        todo = todo[~np.isfinite(result[todo]).all(axis=1)]
        limits[todo] *= 2.0
        result[todo] = np.inf
    return result


def _signed(bands: int, rows: int, size: int) -> Callable:
    """Per document: two sums that identify its multiset, band keys, signature; all NULL without words."""
    k = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text_marks = batch["did"].to_numpy(), batch["mark"].to_numpy()
            for row, bounds, hashes, _, _ in hashed_words(batch["text"]):
                words = np.flatnonzero(np.diff(bounds))
                blank = row + np.flatnonzero(np.diff(bounds) == 0)
                if len(blank):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(ids[blank]), pa.array(text_marks[blank]), pa.nulls(len(blank), pa.int64()),
                        pa.nulls(len(blank), pa.int64()), pa.nulls(len(blank), pa.list_(pa.int64())), pa.nulls(len(blank), pa.binary())],
                        names=["did", "mark", "sum_a", "sum_b", "bands", "signature"])
                for filled in np.split(words, range(DOCUMENTS, len(words), DOCUMENTS)):
                    if not len(filled):
                        continue
                    each = [shingle_keys(hashes[bounds[i] : bounds[i + 1]], size) for i in filled]
                    lengths = np.array([len(x) for x in each])
                    doc = np.repeat(np.arange(len(each)), lengths)
                    strips = occurrences(np.concatenate(each), doc)
                    first = np.cumsum(lengths) - lengths
                    sums = [np.add.reduceat(mix(strips + np.uint64(c)), first) for c in (1, 2)]
                    ranks = signatures(strips, doc, len(each), k)
                    marks = mix(ranks.view(np.uint64))
                    keys = np.zeros((len(each), bands), dtype=np.uint64)
                    for i in range(rows):
                        keys = keys * np.uint64(0x9E3779B97F4A7C15) + marks[:, i::rows][:, :bands]
                    keys = mix(keys + np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93))
                    small = (marks >> np.uint64(32)).astype(np.uint32)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(ids[row + filled]), pa.array(text_marks[row + filled]), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(each) + 1, dtype=np.int32) * bands),
                                                 pa.array(keys.reshape(-1).view(np.int64))),
                        pa.array([x.tobytes() for x in small], pa.binary())],
                        names=["did", "mark", "sum_a", "sum_b", "bands", "signature"])

    return run


def _shingled(size: int) -> Callable:
    """A document's shingles, each occurrence with a key of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["id"].to_numpy()
            for row, bounds, hashes, _, _ in hashed_words(batch["text"]):
                each = [shingle_keys(hashes[a:b], size) for a, b in zip(bounds[:-1], bounds[1:])]
                lengths = np.array([len(x) for x in each])
                keys = occurrences(np.concatenate(each), np.repeat(np.arange(len(each)), lengths))
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row : row + len(each)]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64)))],
                    names=["id", "shingles"])

    return run


def _similarity(x: np.ndarray, y: np.ndarray) -> float:
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(x) + len(y) - common)


def least_agreement(bands: int, rows: int, threshold: float) -> int:
    """Coordinates in which signatures must agree for a pair to be verified: as many as lose, at the threshold,
    no more pairs than the bands do."""
    k, lost, chance, least = bands * rows, (1 - threshold**rows) ** bands, 0.0, 0
    while least < k:
        chance += math.comb(k, least) * threshold**least * (1 - threshold) ** (k - least)
        if chance > lost:
            break
        least += 1
    return least


def _joining(least: int, threshold: float) -> Callable:
    """Verified links of one cell that join classes: at most one less than its documents.

    Pairs of different classes are compared by signature; those that agree in ``least`` coordinates
    or more are verified on their shingles, the most alike first, unless a link found before has
    joined their classes.
    """

    def run(table: pa.Table) -> pa.Table:
        ids, classes = table["id"].to_numpy(), table["component"].to_numpy()
        blocks = table["block"].to_numpy()
        marks = np.stack([np.frombuffer(x.as_buffer(), dtype=np.uint32) for x in table["signature"]])
        one_block = blocks.min() == blocks.max()
        left = np.arange(len(ids)) if one_block else np.flatnonzero(blocks == blocks.min())
        right = left if one_block else np.flatnonzero(blocks == blocks.max())
        found = []
        for i in left:
            others = right[right > i] if one_block else right
            others = others[classes[others] != classes[i]]
            agree = (marks[others] == marks[i]).sum(axis=1)
            good = agree >= least
            if good.any():
                found.append(np.stack([agree[good], np.full(int(good.sum()), i), others[good]]))
        links = []
        if found:
            shingles = table["shingles"].combine_chunks()
            pairs = np.concatenate(found, axis=1)
            sets = {int(i): shingles[int(i)].values.to_numpy() for i in np.unique(pairs[1:])}
            parent = {int(c): int(c) for c in classes}

            def root(c: int) -> int:
                while parent[c] != c:
                    parent[c] = parent[parent[c]]
                    c = parent[c]
                return c

            for i, j in pairs[1:, np.argsort(-pairs[0], kind="stable")].T.tolist():
                a, b = root(int(classes[i])), root(int(classes[j]))
                if a != b and _similarity(sets[i], sets[j]) >= threshold:
                    parent[max(a, b)] = min(a, b)
                    links.append((int(ids[i]), int(ids[j])))
        return pa.table({"a": pa.array([min(x) for x in links], pa.int64()), "b": pa.array([max(x) for x in links], pa.int64())})

    return run


def _verified(pairs: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose shingles reach the threshold."""
    left = shingles.select(F.col("id").alias("a"), F.col("shingles").alias("shingles_a"))
    right = shingles.select(F.col("id").alias("b"), F.col("shingles").alias("shingles_b"))
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    scored = pairs.join(left, "a").join(right, "b").select("a", "b", common.alias("common"), (
        F.size("shingles_a") + F.size("shingles_b")).alias("sizes"))
    return materialize(scored.where(F.col("common") / (F.col("sizes") - F.col("common")) >= threshold).select("a", "b"), "links")


def _in_blocks(open_: DataFrame, block: int) -> DataFrame:
    """``id, block, low, high``: the documents of crowded buckets in cells of two blocks, once for each cell.

    ``open_(key, id, n, weight)`` has a row per bucket and document. A document belongs to the family of its
    largest bucket, and a family is cut into blocks of bounded documents and shingles. Blocks meet if some
    bucket holds documents of both.
    """
    family = open_.groupBy("id").agg(F.max_by("key", F.struct("n", "key")).alias("family"), F.max("weight").alias("weight"))
    parts = family.groupBy("family").agg(F.ceil(F.greatest(
        F.count(F.lit(1)) / block, F.sum("weight") / (block * BLOCK_SHINGLES))).cast("int").alias("parts"))
    own = family.join(parts, "family").select("id", F.xxhash64("family", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block"))
    placed = open_.select("key", "id").join(own, "id")
    others = placed.select("key", F.col("block").alias("other")).distinct()
    return placed.join(others, "key").select("id", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).distinct()


def _classified(documents: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE,
                bands: int = BANDS, band_rows: int = BAND_ROWS, block: int = BLOCK) -> DataFrame:
    """``did, mark, class, class_mark, blank`` per row: the first document of its class, and whether it has no words."""
    texts = documents.select(identifier().alias("did"), text_mark().alias("mark"), "text")
    schema = "did long, mark long, sum_a long, sum_b long, bands array<long>, signature binary"
    signed = materialize(texts.mapInArrow(_signed(bands, band_rows, shingle), schema), "signatures")
    same = ["sum_a", "sum_b"]
    filled = signed.where(F.col("sum_a").isNotNull())
    firsts = filled.groupBy(*same).agg(F.min(F.struct("did", "mark")).alias("first")).select(*same, "first.did", "first.mark")
    # A number for each multiset, in the order of the first documents: the smallest of a class is its first document's.
    firsts = materialize(firsts, "multisets").orderBy("did", "mark", *same)
    firsts = materialize(firsts.withColumn("id", F.monotonically_increasing_id()), "representatives")
    # A representative's own row; repeated rows of it are equal.
    single = filled.join(firsts, [*same, "did", "mark"])
    banded = single.select("id", F.explode("bands").alias("key")).distinct()
    sizes = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hits = materialize(banded.join(sizes, "key"), "buckets")
    popular = hits.groupBy("id").agg(F.sum("n").alias("popularity"))
    hubs = hits.join(popular, "id").groupBy("key").agg(
        F.max(F.struct(F.col("popularity"), F.bitwise_not("id").alias("order"))).alias("hub")).select(
        "key", F.bitwise_not("hub.order").alias("hub"))
    pairs = hits.join(hubs, "key").where("id != hub").select(
        F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    ids = small_side(materialize(hits.select("id").distinct().join(firsts.select("id", "did", "mark"), "id"), "bucket-ids"))
    wanted = texts.join(ids, ["did", "mark"]).select("id", "text")  # only documents in a bucket are read again
    shingles = materialize(wanted.mapInArrow(_shingled(shingle), "id long, shingles array<long>").dropDuplicates(["id"]), "shingles")
    links = _verified(pairs, shingles, threshold)
    classes = components(links)

    labelled = hits.join(classes, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    weights = shingles.select("id", F.size("shingles").alias("weight"))
    open_ = labelled.join(mixed.where("low != high").select("key"), "key", "left_semi").join(weights, "id")
    open_ = materialize(open_, "open-buckets")
    known = open_.groupBy("id").agg(F.first("component").alias("component"))
    marks = single.select("id", "signature").dropDuplicates(["id"])
    known = known.join(marks, "id").join(shingles, "id")
    cells = _in_blocks(open_, block).join(known, "id")
    more = cells.groupBy("low", "high").applyInArrow(_joining(least_agreement(bands, band_rows, threshold), threshold), "a long, b long")
    classes = components(links.unionByName(materialize(more, "links")))

    heads = classes.where("id = component").join(firsts, "id").select("component", F.col("did").alias("class"), F.col("mark").alias("class_mark"))
    heads = small_side(materialize(heads, "class-heads"))
    named = firsts.join(classes.join(heads, "component").drop("component"), "id", "left").select(
        *same, F.coalesce("class", "did").alias("class"), F.coalesce("class_mark", "mark").alias("class_mark"))
    named = materialize(named, "classes")
    result = filled.select("did", "mark", *same).join(named, same).select("did", "mark", "class", "class_mark", F.lit(False).alias("blank"))
    blank = signed.where(F.col("sum_a").isNull()).select(
        "did", "mark", F.col("did").alias("class"), F.col("mark").alias("class_mark"), F.lit(True).alias("blank"))
    return result.unionByName(blank)


def near_duplicates(documents: DataFrame, **settings) -> DataFrame:
    """``doc_id, class_id, class_mark`` per row of ``documents(doc_id, text)``; settings as for ``_classified``."""
    return _classified(documents, **settings).select(
        as_identifier("did").alias("doc_id"), as_identifier("class").alias("class_id"), "class_mark")


def keep_one(documents: DataFrame, **settings) -> DataFrame:
    """One row of each class, with all columns of ``documents``: that of its first document.

    Of rows that repeat that ``doc_id`` and its text one stays; rows with neither an id nor words all stay.
    Only what must go is looked up, so the rest is not shuffled while that is a small table.
    """
    same = ["did", "mark"]
    classes = _classified(documents, **settings).where(~F.col("blank") | (F.col("did") != NO_ID))
    classes = classes.groupBy(*same, "class", "class_mark").agg(F.count(F.lit(1)).alias("n"))
    first = (F.col("did") == F.col("class")) & (F.col("mark") == F.col("class_mark"))
    marked = materialize(classes.where(~first | (F.col("n") > 1)), "marked")
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"),
                            identifier().alias("did"), text_mark().alias("mark"))
    single = rows.join(small_side(marked.select(*same)), same, "left_anti")
    twice = small_side(materialize(marked.where(first).select(*same), "repeated"))
    one = rows.join(twice, same, "left_semi").dropDuplicates(same)
    return single.unionByName(one).select(*(F.col("row")[c].alias(c) for c in documents.columns))
