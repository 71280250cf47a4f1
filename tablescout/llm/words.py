"""Words of Arrow text columns as 64-bit hashes, computed on whole buffers at once.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return. These are single bytes in UTF-8, so buffers are read without decoding. Texts are handled in
stretches of about ``STRETCH`` bytes cut between words, so the working memory is a small multiple of
that however long a text is; what remains of a text is eight bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

STRETCH = 1 << 18
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(length: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < length:
        n = 1 << (length - 1).bit_length()
        for i, base in enumerate((_ODD, _ODD_INVERSE)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and the bytes they point into; NULL counts as empty."""
    column = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def _words(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words; ``breaks`` are positions no word crosses."""
    blank = BLANK[data]
    starts, ends = np.empty(len(data), dtype=bool), np.empty(len(data), dtype=bool)
    starts[0], ends[-1] = True, True
    starts[1:] = blank[:-1]
    starts[breaks] = True
    ends[:-1] = starts[1:] | blank[1:]
    starts &= ~blank
    ends &= ~blank
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    forward, back = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * forward[: len(data)], out=sums[1:])
    hashes = (sums[last] - sums[first]) * back[first]
    return first, last, mix(hashes + (last - first).astype(np.uint64))


def _stretches(offsets: np.ndarray, data: np.ndarray, first: int, last: int, stretch: int) -> Iterator[tuple[int, int]]:
    """Byte ranges that cover rows ``first`` to ``last``; a long row is cut at blanks."""
    start, end = int(offsets[first]), int(offsets[last])
    while end - start > 2 * stretch:
        cut, step = start + stretch, 4096
        while cut < end:
            blanks = np.flatnonzero(BLANK[data[cut : min(cut + step, end)]])
            if len(blanks):
                cut += int(blanks[0])
                break
            cut += step
        cut = min(cut, end)
        yield start, cut
        start = cut
    if end > start:
        yield start, end


def hashed_words(texts: pa.Array, stretch: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of whole rows of about ``stretch`` bytes, hashed in parts of at most ``STRETCH``: number of the
    first row, index of each row's first word (one more at the
    end), hashes, and the words' first and last bytes counted from the start of their row."""
    stretch = stretch or STRETCH
    offsets, data = buffers(texts)
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + stretch, side="right")) - 1)
        parts = []
        for start, end in _stretches(offsets, data, row, stop, min(stretch, STRETCH)):
            breaks = offsets[row:stop]
            breaks = breaks[(breaks >= start) & (breaks < end)] - start
            first, last, hashes = _words(data[start:end], breaks)
            parts.append((first + start, last + start, hashes))
        first, last, hashes = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
        bounds = np.searchsorted(first, offsets[row : stop + 1])
        base = np.repeat(offsets[row:stop], np.diff(bounds))
        yield row, bounds, hashes, first - base, last - base
        row = stop
