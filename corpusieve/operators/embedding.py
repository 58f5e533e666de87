"""Embeddings of texts: a provider that can be exchanged, chunks, long documents, topics."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from corpusieve.functions.text import chunks
from corpusieve.functions.vectors import mean_vectors, norm

#: Characters that a whole text is cut to before it is embedded, and chunks of the index (fixed values).
TEXT_CHARS, CHUNK, OVERLAP = 12000, 2500, 250
#: Long documents: chunk, overlap, number of chunks, characters (fixed values).
LONG = (4500, 300, 12, 60000)


class Provider(Protocol):
    """Anything that turns texts into vectors of one length."""

    model_name: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingProvider:
    """Signed hashed counts of words, to unit length: needs no model, is the same everywhere."""

    def __init__(self, dimensions: int = 64) -> None:
        self.dimensions, self.model_name = dimensions, f"hashing-{dimensions}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimensions))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.dimensions] += 1 if h >> 63 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(size > 0, size, 1)).astype(np.float32).tolist()


def available(make: Callable[[], Provider] | None) -> Callable[[], Provider] | None:
    """``make``, or None where its library or model is missing: callers then go on without vectors."""
    if make is None:
        return None
    try:
        make()
    except (ImportError, OSError):
        return None
    return make


def embedded(text: Column, make: Callable[[], Provider]) -> Column:
    """The vector of each text. ``make`` gives the provider in the worker, once for a task."""

    @F.pandas_udf(ArrayType(FloatType()))
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        provider = make()
        for batch in batches:
            yield pd.Series(provider.embed([x or "" for x in batch]), dtype=object)

    return of(text)


def whole(docs: DataFrame, make: Callable[[], Provider]) -> DataFrame:
    """doc_id, vector and norm of the first TEXT_CHARS characters of each text."""
    own = docs.select("doc_id", embedded(F.substring(F.coalesce("text", F.lit("")), 1, TEXT_CHARS), make).alias("vector"))
    return own.withColumn("norm", norm(F.col("vector")))


def by_chunk(docs: DataFrame, make: Callable[[], Provider], size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, chunk_index, start, end, vector and norm of every chunk."""
    rows = docs.select("doc_id", F.inline(chunks(F.coalesce("text", F.lit("")), size, overlap)))
    return rows.select("doc_id", "chunk_index", "start", "end", embedded(F.col("text"), make).alias("vector")).withColumn("norm", norm(F.col("vector")))


def of_long_documents(docs: DataFrame, make: Callable[[], Provider]) -> DataFrame:
    """doc_id, vector, count and norm: the mean over a document's first chunks."""
    size, overlap, most, chars = LONG
    cut = docs.select("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, chars).alias("text"))
    return mean_vectors(by_chunk(cut, make, size, overlap).where(F.col("chunk_index") < most), ["doc_id"], "vector").withColumn("norm", norm(F.col("vector")))


def topic(phrases: list[str], provider: Provider) -> list[float]:
    """The mean vector of a few phrases."""
    vectors = [v for v in provider.embed(phrases) if v]
    return np.mean([v[: min(map(len, vectors))] for v in vectors], axis=0).tolist() if vectors else []
