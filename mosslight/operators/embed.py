"""Embedders: vectors that exist already, feature hashing, or a function of the user's.

Feature hashing is deterministic and needs no model; it does not know what words mean.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import truncate

LIMIT = 512
#: Words whose hashes a worker keeps, and texts whose words it holds.
WORDS, SLICE = 1 << 16, 256


class Embedder(Protocol):
    name: str

    def embed_documents(self, docs: DataFrame, content: str = "content") -> DataFrame: ...

    def embed_query(self, text: str) -> list[float]: ...


class PrecomputedEmbedder:
    """Vectors from a table, by id. Texts that aren't in it can't be embedded."""

    def __init__(self, vectors: DataFrame, *, key: str = "vec_id", embedding: str = "embedding", name: str = "precomputed"):
        self.vectors, self.key, self.embedding, self.name = vectors, key, embedding, name

    def embed_documents(self, docs: DataFrame, content: str = "content", on: str = "doc_id") -> DataFrame:
        own = self.vectors.select(F.col(self.key).alias(on), F.col(self.embedding).alias("embedding"))
        return docs.join(own, on)

    def embed_query(self, text: str) -> list[float]:
        raise ValueError("a table of vectors can't embed new text")

    def vector(self, key: int) -> list[float]:
        row = self.vectors.where(F.col(self.key) == key).select(self.embedding).first()
        if row is None:
            raise KeyError(key)
        return [float(x) for x in row[0]]


class FunctionEmbedder:
    """A function from texts to vectors, run on Arrow batches; vectors are scaled to length 1."""

    def __init__(self, function: Callable[[list[str]], np.ndarray], name: str = "function", retries: int = 3):
        self.function, self.name, self.retries = function, name, retries

    def _vectors(self, texts: list[str]) -> np.ndarray:
        for left in range(self.retries, 0, -1):
            try:
                x = np.asarray(self.function(texts), np.float64)
                break
            except Exception:
                if left == 1:
                    raise
        return x / np.maximum(np.sqrt((x**2).sum(axis=1, keepdims=True)), 1e-12)

    def embed_documents(self, docs: DataFrame, content: str = "content") -> DataFrame:
        vectors = self._vectors

        @F.arrow_udf("array<float>")
        def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                x = vectors(texts.fill_null("").to_pylist()).astype(np.float32) if len(texts) else np.zeros((0, 1), np.float32)
                ends = np.arange(len(texts) + 1, dtype=np.int32) * x.shape[1]
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel(), pa.float32()))

        return docs.withColumn("embedding", embed(truncate(F.col(content), LIMIT)))

    def embed_query(self, text: str) -> list[float]:
        short = text if len(text) <= LIMIT else text[: LIMIT - 3] + "..."
        return self._vectors([short])[0].tolist()


@lru_cache(maxsize=WORDS)
def _word_hash(word: str, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{word}".encode(), digest_size=8).digest(), "little")


def hashed_features(texts: list[str], dim: int = 64, seed: int = 0) -> np.ndarray:
    """Signed feature hashing of lower-case words, of SLICE texts at a time."""
    return np.concatenate([_features(texts[i : i + SLICE], dim, seed) for i in range(0, len(texts), SLICE)] or [np.zeros((0, dim))])


def _features(texts: list[str], dim: int, seed: int) -> np.ndarray:
    words = [re.findall(r"\w+", t.lower()) for t in texts]
    h = np.fromiter((_word_hash(w, seed) for own in words for w in own), np.uint64)
    at = np.repeat(np.arange(len(texts)), [len(own) for own in words]) * dim + (h % np.uint64(dim)).astype(np.int64)
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    return np.bincount(at, sign, len(texts) * dim).reshape(len(texts), dim)


class HashingEmbedder(FunctionEmbedder):
    """Feature hashing as an embedder."""

    def __init__(self, dim: int = 64, seed: int = 0):
        super().__init__(lambda texts: hashed_features(texts, dim, seed), f"hashing-{dim}-{seed}")
