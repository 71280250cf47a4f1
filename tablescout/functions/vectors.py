"""Vector expressions and the default text embedder."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import Column, functions as F

from tablescout import fixed_values as V


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """NULL for a zero vector."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.lit(1.0) - F.try_divide(dot(a, b), norms)


def vector_literal(vector: Column) -> Column:
    """``[0.1,-0.2,0.3]`` with the JVM's float spelling."""
    return F.to_json(vector)


def parse_vector(text: Column, dim: int = V.EMBEDDING_DIMENSIONS) -> Column:
    """The inverse of :func:`vector_literal`; NULL when malformed or not ``dim`` long."""
    parsed = F.from_json(text, "array<float>")
    complete = (F.size(parsed) == dim) & ~F.exists(parsed, lambda x: x.isNull())
    return F.when(complete, parsed)


#: Words of letters, digits and whatever is outside ASCII.
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class HashingEmbedder:
    """Deterministic bag-of-words feature hashing with unit length; needs no network.

    A word's MD5 gives its dimension and sign, so the vectors can be checked in plain SQL.
    """

    def __init__(self, dim: int = V.EMBEDDING_DIMENSIONS):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        words = [TOKEN.findall(text.lower()) for text in texts]
        distinct = {word: i for i, word in enumerate(dict.fromkeys(w for own in words for w in own))}
        codes = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in distinct], dtype=np.int64)
        rows = np.repeat(np.arange(len(texts)), [len(own) for own in words])
        codes = codes[np.array([distinct[w] for own in words for w in own], dtype=np.int64)]
        vectors = np.zeros((len(texts), self.dim))
        np.add.at(vectors, (rows, codes % self.dim), np.where(codes >= 1 << 31, 1.0, -1.0))
        lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
        return (vectors / np.where(lengths == 0.0, 1.0, lengths)).astype(np.float32)
