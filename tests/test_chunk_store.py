"""Chunk vectors follow their documents, and only new texts reach the provider."""

from __future__ import annotations

import os

import pytest

from corpusieve.operators.chunk_store import ChunkStore
from corpusieve.operators.embedding import HashingProvider, by_chunk
from corpusieve.operators.versions import Conflict


def counting(folder):
    """A provider that leaves a file for each text that it is asked for."""

    class Counting(HashingProvider):
        def embed(self, texts):
            for _ in texts:
                os.close(os.open(os.path.join(folder, os.urandom(8).hex()), os.O_CREAT))
            return super().embed(texts)

    return Counting


def made(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def rows_of(df):
    return sorted((r.doc_id, r.chunk_index, r.start, r.end, tuple(r.vector), pytest.approx(r.norm)) for r in df.collect())


def test_only_new_chunks_are_embedded(spark, tmp_path):
    seen = tmp_path / "asked"
    seen.mkdir()
    asked = lambda: len(os.listdir(seen))
    root, make = f"file://{tmp_path}/v", counting(str(seen))
    text = lambda *words: " ".join(f"{w}{k:03d}" for w in words for k in range(20))
    docs = {1: text("a", "b"), 2: text("a", "b"), 3: text("c"), 4: "", 5: None, 6: text("d", "e", "f")}
    store = ChunkStore(spark, root, make, 60, 10)
    with pytest.raises(ValueError, match="no chunk"):
        store.table()
    same = lambda: rows_of(ChunkStore(spark, root, make, 60, 10).table()) == rows_of(by_chunk(made(spark, list(docs.items())), HashingProvider, 60, 10))
    n = store.update(made(spark, [*docs.items(), (None, "no id"), (3, "a")]))
    assert n == asked() > 0 and same()  # 1 and 2 share theirs, of 3 the greater text counts
    assert store.update(made(spark, list(docs.items()))) == 0 and asked() == n and same()
    docs[6] = docs[6] + " more"
    assert store.update(made(spark, [(6, docs[6])])) in (1, 2) and same()
    docs[1], docs[7] = docs[3], docs[6]
    n = asked()
    assert store.update(made(spark, [(1, docs[1]), (7, docs[7])])) == 0 and asked() == n and same()  # known from others
    store.remove(made(spark, [(3, ""), (6, ""), (99, "")]))
    docs.pop(3), docs.pop(6)
    assert same()
    docs[7] = "x"
    store.update(made(spark, [(7, "x")]))
    before = store._vectors().count()
    store.compact()
    assert same() and store._vectors().count() < before and len(store.versions.folders("vectors=")) == 1 == len(store.versions.folders("chunks="))
    assert store.update(made(spark, list(docs.items()))) == 0


def test_steps_that_meet(spark, tmp_path):
    root = f"file://{tmp_path}/v"
    one, two = (ChunkStore(spark, root, HashingProvider) for _ in range(2))
    assert one.update(made(spark, [(1, "a b")])) == 1
    with pytest.raises(Conflict):
        two.update(made(spark, [(2, "c")]))
    assert [r.doc_id for r in ChunkStore(spark, root, HashingProvider).table().collect()] == [1]
    with pytest.raises(ValueError, match="cut by"):
        ChunkStore(spark, root, HashingProvider, 60, 10)
    assert one.update(made(spark, [])) == 0 and one.update(made(spark, [(1, None)])) == 0 and one.table().count() == 0
