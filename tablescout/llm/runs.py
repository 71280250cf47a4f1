"""Periodic runs of words: stretches that repeat with a short or a long period, found by multi-scale minimizers.

A run is a stretch of words with smallest period ``q``, at least ``max(6, 4 q)`` long, that no
neighbouring word extends. Words are named by 64-bit hashes; many documents are searched at once as
one sequence in which a hash of its own ends each document, so no run reaches over an end.

1. Periods up to ``SHORT`` are too short for windows: the sequence is compared with itself at each lag.
2. A scale ``g`` (16, 32, ..) covers the periods above ``g / 2`` up to ``g``. All stretches of ``g``
   words are hashed (doubling those of the scale before), and the minima of all windows of ``g / 2``
   hashes are kept. Inside a run some window lies with its copy one period later, so its minimum
   appears twice, ``q`` apart; and stretches of ``g >= q`` words differ within a period, so no equal
   minimum stands between the two. Each pair of neighbouring equal minima at a distance of the scale
   is therefore a seed, and every run has one.
3. A seed is extended to both sides word by word (in growing strips) as long as words one distance
   apart agree; seeds inside a stretch found before are passed over. What is long enough is a run.
4. A stretch found with several periods has the smallest.

Nothing is sampled: the result equals that of comparing all lags, whatever the length of a text.

Defined results: NULL and blank texts have no words and no runs. Each row is searched by itself, so
repeated rows get equal results. A row without a ``doc_id`` keeps its words as they are. Ties of the
longest run go to the smaller start, then to the smaller period. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablescout.llm.words import buffers, hashed_words, mix

LEAST_LENGTH, LEAST_POWER = 6, 4
#: Periods up to here are found by direct comparison.
SHORT = 8
_NEXT = np.uint64(0xD6E8FEB86659FD93)
_END = np.uint64(0x94D049BB133111EB)

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]  # starts, lengths, periods


def _stretches(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the maximal stretches of True that are ``least`` long or longer."""
    ends = np.concatenate([[-1], np.flatnonzero(~equal), [len(equal)]])
    lengths = np.diff(ends) - 1
    some = lengths >= max(least, 1)
    return ends[:-1][some] + 1, lengths[some]


def _least_length(period):
    return np.maximum(LEAST_LENGTH, LEAST_POWER * period)


def _sliding(values: np.ndarray, window: int, best: np.ufunc, neutral) -> np.ndarray:
    """``best`` of every window: of a block's end and the next block's start, each summed up once."""
    n = len(values)
    padded = np.full(-(-n // window) * window, neutral, dtype=values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, window)
    starts = best.accumulate(blocks, axis=1).ravel()
    ends = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(ends[: n - window + 1], starts[window - 1 : n])


def minimizers(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places whose hash is the smallest of some window."""
    least = _sliding(hashes, window, np.minimum, np.uint64(2**64 - 1))
    edge = np.zeros(window - 1, dtype=np.uint64)
    highest = _sliding(np.concatenate([edge, least, edge]), window, np.maximum, np.uint64(0))
    return np.flatnonzero(highest == hashes)


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many values agree from the start on."""
    done, strip, n = 0, 64, len(a)
    while done < n:
        off = np.flatnonzero(a[done : done + strip] != b[done : done + strip])
        if len(off):
            return done + int(off[0])
        done, strip = done + strip, 2 * strip
    return n


def _extended(codes: np.ndarray, places: np.ndarray, distances: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """The maximal stretches around seeds, as start, length and period."""
    order = np.lexsort((places, distances))
    last, reach = 0, -1
    for place, distance in zip(places[order].tolist(), distances[order].tolist()):
        if distance != last:
            last, reach = distance, -1
        if place < reach or codes[place] != codes[place + distance]:
            continue
        reach = place + _agreeing(codes[place : len(codes) - distance], codes[place + distance :])
        back = _agreeing(codes[:place][::-1], codes[distance : place + distance][::-1])
        length = reach - (place - back) + distance
        if length >= _least_length(distance):
            yield place - back, length, distance


def find_runs(codes: np.ndarray, longest: int | None = None, short: int = SHORT) -> Runs:
    """All runs of a sequence of 64-bit codes, by start, then period. ``longest`` bounds the length of any run."""
    n = len(codes)
    longest = n if longest is None else longest
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for period in range(1, min(short, longest // LEAST_POWER) + 1):
        starts, lengths = _stretches(codes[period:] == codes[:-period], int(_least_length(period)) - period)
        found.append((starts, lengths + period, np.full(len(starts), period)))
    hashes, size = mix(codes), 1
    seeds: list[tuple[int, int, int]] = []
    while True:
        if size > short:
            if LEAST_POWER * (size // 2 + 1) > longest:
                break
            places = minimizers(hashes, size // 2)
            own = hashes[places]
            order = np.argsort(own, kind="stable")
            first, second = places[order[:-1]], places[order[1:]]
            distance = second - first
            pair = (own[order[:-1]] == own[order[1:]]) & (distance > size // 2) & (distance <= size)
            seeds.extend(_extended(codes, first[pair], distance[pair]))
        if 2 * size > n:
            break
        hashes = mix(hashes[:-size] * _NEXT + hashes[size:])
        size *= 2
    if seeds:
        found.append(tuple(np.array(x, dtype=np.int64) for x in zip(*seeds)))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    starts, lengths, periods = (np.concatenate(x).astype(np.int64) for x in zip(*found))
    order = np.lexsort((periods, lengths, starts))
    starts, lengths, periods = starts[order], lengths[order], periods[order]
    again = np.zeros(len(starts), dtype=bool)
    again[1:] = (starts[1:] == starts[:-1]) & (lengths[1:] == lengths[:-1])
    starts, lengths, periods = starts[~again], lengths[~again], periods[~again]
    order = np.lexsort((periods, starts))
    return starts[order], lengths[order], periods[order]


def repeated_places(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a document whose end is made periodic; None for the others."""
    if doc_id is None or n == 0:
        return None
    digest = zlib.crc32(str(doc_id).encode())
    if digest % 10:
        return None
    g = digest // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % period
    return places


def _summary(runs: list[tuple[int, int, int]], words: list[bytes]) -> dict:
    """A document's columns from its runs and its words."""
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    if runs:
        steps = np.zeros(len(words) + 1, dtype=np.int64)
        for start, length, period in runs:
            steps[start + period] += 1
            steps[start + length] -= 1
        kept = np.flatnonzero(np.cumsum(steps[:-1]) == 0)
        words = [words[i] for i in kept.tolist()]
    text = b" ".join(words)
    return {
        "n_runs": len(runs), "start": top and top[0], "length": top and top[1], "period": top and top[2],
        "exponent_milli": top and 1000 * top[1] // top[2], "runs_sha256": hashlib.sha256(listed.encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(text).hexdigest(), "collapsed_text": text.decode(),
        "runs": [{"start": s, "length": n, "period": q} for s, n, q in runs],
    }


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FIELDS = {"n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(),
           "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}
_OUTPUTS = {"runs": pa.list_(_RUN), "collapsed_text": pa.string()}


def _searched(outputs: bool):
    fields = _FIELDS | (_OUTPUTS if outputs else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            offsets, data = buffers(batch["text"])
            texts = memoryview(data)
            for row, bounds, hashes, _, _ in hashed_words(batch["text"]):
                count = len(bounds) - 1
                sizes = np.diff(bounds)
                # One sequence: every document's words, then a code that nothing else has.
                codes = np.empty(len(hashes) + count, dtype=np.uint64)
                heads = bounds[:-1] + np.arange(count)
                codes[bounds[1:] + np.arange(count)] = mix(np.arange(count, dtype=np.uint64) + _END)
                rows: list[dict] = []
                orders = [repeated_places(ids[row + i], int(sizes[i])) for i in range(count)]
                for i, order in enumerate(orders):
                    own = hashes[bounds[i] : bounds[i + 1]]
                    codes[heads[i] : heads[i] + sizes[i]] = own if order is None else own[order]
                starts, lengths, periods = find_runs(codes, int(sizes.max(initial=0)))
                owner = np.searchsorted(heads, starts, side="right") - 1
                cuts = np.searchsorted(owner, np.arange(count + 1))
                for i, order in enumerate(orders):
                    part = slice(cuts[i], cuts[i + 1])
                    runs = list(zip((starts[part] - heads[i]).tolist(), lengths[part].tolist(), periods[part].tolist()))
                    # ``bytes.split`` parts words at the same six characters.
                    own = bytes(texts[offsets[row + i] : offsets[row + i + 1]]).split()
                    rows.append(_summary(runs, own if order is None else [own[j] for j in order.tolist()]))
                columns = [pa.array([r[name] for r in rows], kind) for name, kind in fields.items()]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(row, count), *columns], names=["doc_id", *fields])

    return run


def collapse_runs(documents: DataFrame, outputs: bool = True) -> DataFrame:
    """Per row of ``documents(doc_id, text)``: ``doc_id, n_runs``, the longest run's ``start, length, period,
    exponent_milli``, digests of all runs and of the text that remains when every run is cut to its first
    period and, with ``outputs``, the ``runs`` and the ``collapsed_text`` themselves."""
    schema = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
              "runs_sha256 string, collapsed_sha256 string")
    schema += ", runs array<struct<start:long,length:long,period:long>>, collapsed_text string" if outputs else ""
    return documents.select(documents["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(_searched(outputs), schema)
