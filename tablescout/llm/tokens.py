"""Token ids by a tokenizer file, each different word of many texts encoded once."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tablescout.llm.words import BLANK, buffers, hashed_words

#: Bytes of text whose words are looked up together.
STRETCH = 1 << 21
_LOADED: dict[str, "Encoder"] = {}
#: How a word stands in a text: at its start, behind a space (which is part of the word), behind a line feed.
_START, _SPACE, _LINE = range(3)
_STANDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0], dtype=np.uint64)
#: Bytes that begin white space beyond ASCII, and the two that follow.
_WIDE_BLANKS = ((0xC2, {0x85, 0xA0}, None), (0xE1, {0x9A}, {0x80}), (0xE2, {0x80}, {*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF}),
                (0xE2, {0x81}, {0x9F}), (0xE3, {0x80}, {0x80}))


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers.

    A byte-level tokenizer never joins what lies on two sides of a single blank: a space belongs to
    the word after it, a line feed stands alone. So a text whose blanks are all single spaces and
    line feeds is put together from the ids of its words; any other text, and any text that holds one
    of the tokenizer's special tokens, is encoded as a whole. The words of many texts are told apart by
    64-bit hashes and encoded in one call, each different one once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        before = repr(self._tokenizer.pre_tokenizer)
        self._by_word = self._tokenizer.normalizer is None and before.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in before
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self.wide = self._tokenizer.get_vocab_size() > 1 << 16
        self.size = self._tokenizer.get_vocab_size()
        self._lengths = np.zeros(self.size, dtype=np.int64)
        self._words = self._ranked() if self._by_word else None

    def _ranked(self):
        """The same vocabulary for tiktoken, which is several times faster on single words; None if the
        merges are not applied in the order of their ids."""
        import json

        import tiktoken

        model = json.loads(self._tokenizer.to_str())["model"]
        merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model.get("merges", ())]
        if not merged or None in merged or merged != sorted(merged):
            return None
        # Byte-level vocabularies write a byte as a printable character: itself, or one from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in self._special}
        for token, i in ranks.items():
            self._lengths[i] = len(token)
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _cut(self, text: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text and where the parts that end at the given bytes (where tokens end too) begin, and the end."""
        ids = np.array(self._words.encode_ordinary(text.decode()), dtype="<u4")
        return ids, np.concatenate([[0], np.searchsorted(np.cumsum(self._lengths[ids]), ends) + 1]) if len(ends) else np.zeros(1, np.int64)

    def _of_words(self, words: list[bytes], stands: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words with the blank before each: all ids, and where a word's begin and how many they are."""
        starts, sizes = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        if self._words is None:
            blanks = {_START: "", _SPACE: " ", _LINE: "\n"}
            found = self._whole([blanks[s] + w.decode() for w, s in zip(words, stands.tolist())])
            sizes[:] = [len(x) // 4 for x in found]
            return np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes, sizes
        lengths = np.array([len(w) + 1 for w in words], dtype=np.int64)
        parts, before = [], 0
        for blank, own in ((b" ", np.flatnonzero(stands == _SPACE)), (b"\n", np.flatnonzero(stands != _SPACE))):
            text = b"".join([blank + words[i] for i in own.tolist()])
            ids, cuts = self._cut(text, np.cumsum(lengths[own]))
            # A line feed is a token of its own, which the first word of a text does without.
            skipped = (stands[own] == _START).astype(np.int64)
            starts[own], sizes[own] = cuts[:-1] + skipped + before, np.diff(cuts) - skipped
            parts.append(ids)
            before += len(ids)
        return np.concatenate(parts), starts, sizes

    def _regular(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Which rows are words parted by single spaces and line feeds, and hold no special token."""
        first, own = int(offsets[0]), data[offsets[0] : offsets[-1]]
        if not len(own):
            return np.ones(len(offsets) - 1, dtype=bool)
        blank = BLANK[own]
        inside = np.ones(len(own), dtype=bool)  # bytes that are not the first of a row
        heads = offsets[:-1][np.diff(offsets) > 0] - first
        inside[heads] = False
        ends = offsets[1:][np.diff(offsets) > 0] - first - 1
        bad = blank & (own != 0x20) & (own != 0x0A) | (own >= 0x1C) & (own <= 0x1F)
        bad[1:] |= blank[1:] & blank[:-1] & inside[1:]
        bad[heads] |= blank[heads]
        bad[ends] |= blank[ends]
        for lead, second, third in _WIDE_BLANKS:
            at = np.flatnonzero(own[:-2] == lead) if third else np.flatnonzero(own[:-1] == lead)
            at = at[np.isin(own[at + 1], list(second))]
            bad[at[np.isin(own[at + 2], list(third))] if third else at] = True
        places = np.flatnonzero(bad)
        whole = own.tobytes()
        special = []
        for token in self._special:
            at = whole.find(token.encode())
            while at >= 0:
                special.append(at)
                at = whole.find(token.encode(), at + 1)
        regular = np.ones(len(offsets) - 1, dtype=bool)
        regular[np.searchsorted(offsets, np.append(places, np.array(special, dtype=np.int64)) + first, side="right") - 1] = False
        return regular

    def _by_words(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of regular rows."""
        offsets, data = buffers(texts)
        for row, bounds, hashes, first, last in hashed_words(texts, STRETCH):
            base = np.repeat(offsets[row : row + len(bounds) - 1], np.diff(bounds))
            stands = np.where(first == 0, _START, np.where(data[np.maximum(base + first - 1, 0)] == 0x20, _SPACE, _LINE))
            keys, at, index = np.unique(hashes ^ _STANDS[stands], return_index=True, return_inverse=True)
            own = zip((base + first)[at].tolist(), (base + last)[at].tolist())
            flat, starts, sizes = self._of_words([data[a:b].tobytes() for a, b in own], stands[at])
            counts = sizes[index]
            ends = np.concatenate([[0], np.cumsum(counts)])
            ids = flat[np.arange(ends[-1]) + np.repeat(starts[index] - ends[:-1], counts)]
            cuts = ends[bounds]
            for i in range(len(bounds) - 1):
                yield ids[cuts[i] : cuts[i + 1]]

    def encode(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        """Ids of every text; NULL counts as empty."""
        column = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        regular = self._regular(*buffers(column)) if self._by_word else np.zeros(len(column), dtype=bool)
        odd = iter(self._whole([t or "" for t in column.filter(pa.array(~regular)).to_pylist()]))
        words = self._by_words(column if regular.all() else column.filter(pa.array(regular)))
        return [next(words) if r else np.frombuffer(next(odd), "<u4") for r in regular.tolist()]


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
