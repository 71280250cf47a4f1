"""A small table of documents that holds every odd case, and plain readings of the contracts."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns whose names the operators use themselves.
CLASHING = ("did", "key", "row", "size", "id", "packed", "shard", "place", "blob", "spans", "words", "class", "parts", "v", "kept", "n")
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *(T.StructField(c, T.StringType()) for c in CLASHING)])


def prose(seed, n, lines=12):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]
    return " ".join(w + (".\n" if i % lines == lines - 1 else "") for i, w in enumerate(words)).replace("\n ", "\n").strip()


def edited(text, every, offset=3):
    words = text.split(" ")
    return " ".join(f"edit{i}" if i % every == offset else w for i, w in enumerate(words))


def odd_rows():
    """``(doc_id, text, source)``: nulls, blanks, ties, repeated rows, copies, near copies, a very long text."""
    base, passage = prose(1, 300), prose(2, 60)
    long = prose(3, 60_000)
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one two", "b"), (None, prose(4, 90), "b"),
        (5, long, "hot"), (6, base, "hot"), (7, base, "hot"), (8, edited(base, 100), "hot"), (9, edited(base, 9), "hot"),
        (10, prose(5, 40) + "\n" + passage + "\n" + prose(6, 30), None), (11, passage + " " + prose(7, 80), "c"),
        (12, "und der " * 200, "c"), (13, "double  spaces\tand\r\nbreaks\x0b" + "été \U0001F600 " * 30, "c"),
        (14, "same line here\n" * 40, "d"), (15, prose(8, 25), "d"), (15, prose(8, 25), "d"),
    ]
    rows += [(100 + i, base, "hot") for i in range(30)]
    rows += [(200 + i, prose(50 + i, 60 + 7 * i), f"s{i % 3}") for i in range(25)]
    return rows


def documents(spark, rows):
    full = [(i, t, "en", s, None if t is None else len(t), *(f"{c}-{k}" for c in CLASHING)) for k, (i, t, s) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def words(text):
    return WORD.findall(text or "")


def without_repeats(rows, window=20):
    """``(doc_id, n_words, n_removed, kept text)`` per row, by looking at every window."""
    order = lambda i: -(2**63) if i is None else i
    first = {}
    for i, text, _ in rows:
        own = words(text)
        for at in range(len(own) - window + 1):
            key = tuple(own[at : at + window])
            first[key] = min(first.get(key, (order(i), at)), (order(i), at))
    found = []
    for i, text, _ in rows:
        own = words(text)
        gone = set()
        for at in range(len(own) - window + 1):
            if first[tuple(own[at : at + window])] < (order(i), at):
                gone.update(range(at, at + window))
        found.append((i, len(own), len(gone), " ".join(w for k, w in enumerate(own) if k not in gone)))
    return found


def shingles(text, size=5):
    own = words(text)
    return Counter(tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1))) if own else Counter()


def classes(rows, threshold=0.8):
    """Smallest identifier of each document's class, by comparing every pair that shares a shingle."""
    sets, holders = {}, defaultdict(list)
    for i, text, _ in rows:
        i = -(2**63) if i is None else i
        if i not in sets:
            sets[i] = shingles(text)
            for shingle in sets[i]:
                holders[shingle].append(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in {(min(x, y), max(x, y)) for own in holders.values() for x in own for y in own if x != y}:
        common = sum((sets[a] & sets[b]).values())
        if common >= threshold * (sum(sets[a].values()) + sum(sets[b].values()) - common):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {i: root(i) for i in sets}
