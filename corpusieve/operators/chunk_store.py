"""Vectors of the chunks of documents that change: only texts of chunks that are new are embedded."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusieve.functions.text import chunks
from corpusieve.functions.vectors import norm
from corpusieve.operators.embedding import CHUNK, OVERLAP, Provider, embedded
from corpusieve.operators.state import last_of_each
from corpusieve.operators.versions import Versions


class ChunkStore:
    """Chunks and vectors below ``root``, of one model and one cut.

    Chunks (doc_id, chunk_index, start, end, digest) are small and written anew by each step. Vectors are kept
    by the digest of their text, in parts that are only added to, so a chunk that moves, or that another
    document has too, is not embedded again. A step makes one version: who reads sees all of it or nothing, and
    a step that failed leaves only files that no version names. A step that another writer was ahead of
    raises ``Conflict``.
    """

    def __init__(self, spark: SparkSession, root: str, make: Callable[[], Provider], size: int = CHUNK, overlap: int = OVERLAP) -> None:
        self.spark, self.root, self.make, self.size, self.overlap = spark, root.rstrip("/"), make, size, overlap
        self.model, self.versions = make().model_name, Versions(spark, root)
        self.number = self.versions.newest()
        self.now: dict = self.versions.read(self.number) if self.number else {"model": self.model, "cut": [size, overlap], "chunks": None, "vectors": []}
        if (self.now["model"], self.now["cut"]) != (self.model, [size, overlap]):
            raise ValueError(f"{self.root} has vectors of {self.now['model']}, cut by {self.now['cut']}")

    def _put(self, kind: str, rows: DataFrame) -> str:
        name = f"{kind}={uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{name}")
        return name

    def _commit(self, chunks_at: str | None, vectors: list[str]) -> None:
        now = {**self.now, "chunks": chunks_at, "vectors": vectors}
        self.versions.put(self.number + 1, now)
        self.number, self.now = self.number + 1, now

    def _chunks(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.root}/{self.now['chunks']}").select("doc_id", "chunk_index", "start", "end", "digest") if self.now["chunks"] else None

    def _vectors(self) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.root}/{n}" for n in self.now["vectors"]]).select("digest", "vector", "norm") if self.now["vectors"] else None

    def update(self, docs: DataFrame) -> int:
        """Takes in docs(doc_id, text) in place of what documents of these ids had; returns how many texts were
        embedded. Rows without doc_id are left out; of rows that share one the greatest text counts. A null or
        empty text has no chunk. Other documents stay as they are."""
        own = last_of_each(docs.where("doc_id is not null").select("doc_id", "text"), "doc_id")
        cut = own.select("doc_id", F.inline(chunks(F.coalesce("text", F.lit("")), self.size, self.overlap))).withColumn("digest", F.sha2("text", 256))
        known, before = self._vectors(), self._chunks()
        fresh = cut if known is None else cut.join(known.select("digest"), "digest", "left_anti")
        texts = fresh.groupBy("digest").agg(F.any_value("text").alias("text"))  # the same for each
        rows = texts.select("digest", embedded(F.col("text"), self.make).alias("vector"))
        part = self._put("vectors", rows.withColumn("norm", norm(F.col("vector"))))
        n = self.spark.read.parquet(f"{self.root}/{part}").count()
        new = cut.drop("text")
        if before is not None:
            new = new.unionByName(before.join(own.select("doc_id"), "doc_id", "left_anti"))
        at = self._put("chunks", new)
        if not n:
            self.versions.delete(part)
        self._commit(at, [*self.now["vectors"], *([part] if n else [])])
        return n

    def remove(self, gone: DataFrame) -> None:
        """Takes the documents in gone(doc_id) out."""
        if (before := self._chunks()) is not None:
            self._commit(self._put("chunks", before.join(gone.select("doc_id"), "doc_id", "left_anti")), self.now["vectors"])

    def table(self) -> DataFrame:
        """doc_id, model_name, chunk_index, start, end, vector and norm of every chunk."""
        own, vectors = self._chunks(), self._vectors()
        if own is None or vectors is None:
            raise ValueError(f"no chunk was taken in below {self.root}")
        return own.join(vectors, "digest").select("doc_id", F.lit(self.model).alias("model_name"), "chunk_index", "start", "end", "vector", "norm")

    def compact(self) -> None:
        """Makes one part of all vectors, without those that no chunk has any more, and deletes what no version
        needs then. No one may write or read an older version meanwhile."""
        own, vectors = self._chunks(), self._vectors()
        if own is None or vectors is None:
            return
        self._commit(self.now["chunks"], [self._put("vectors", vectors.join(own.select("digest"), "digest", "left_semi"))])
        named = {self.now["chunks"], *self.now["vectors"]}
        for name in (*self.versions.folders("vectors="), *self.versions.folders("chunks=")):
            if name not in named:
                self.versions.delete(name)
