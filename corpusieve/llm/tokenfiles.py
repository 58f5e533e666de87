"""Operator 9: token ids in binary files of bit- or byte-planes.

A file holds the documents of one range of doc_id, ascending. Their ids, one after the other, are
cut into blocks of a fixed number of ids. Of each block the k-th bit (or byte) of every id is
brought together into the k-th plane, and each plane is compressed with zstandard by itself; a
plane of zeros takes no space. After the blocks stand the chunk index (place, ids, bytes of each
plane and CRC of every block), the document index (doc_id and number of ids) and a trailer.

    "BPLANES1" | planes of block 0 | planes of block 1 | ... | index (zstandard) | trailer
    trailer: bytes of the index (u64), planes per block (u32), ids per block (u32), "BPLANES1"

Every task writes files under names of its own attempt and reports those that it finished; the
manifest lists only these, so tasks that are lost or run twice leave nothing that is ever read.
"""

from __future__ import annotations

import io
import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusieve.runtime import BATCH_BYTES, bound_batches, scratch, table

MAGIC = b"BPLANES1"
_TRAILER = struct.Struct("<QII8s")
BLOCK_IDS = 1 << 16
_PLANES = {"byte": 4, "bit": 32}


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, lowest first."""
    by_byte = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if kind == "byte":
        return [x.tobytes() for x in by_byte]
    return [np.packbits(x >> k & 1).tobytes() for x in by_byte for k in range(8)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    """The ids that ``to_planes`` took apart; an empty plane is all zeros."""
    out = np.zeros((n, 4), np.uint8)
    for k, plane in enumerate(planes):
        if plane:
            if kind == "byte":
                out[:, k] = np.frombuffer(plane, np.uint8)
            else:
                out[:, k // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n) << (k % 8)
    return out.view("<u4").ravel()


class Writer:
    """Writes one file to a binary stream; documents in the order in which they come."""

    def __init__(self, stream: io.RawIOBase, kind: str = "byte", level: int = 3, block_ids: int = BLOCK_IDS) -> None:
        self.stream, self.kind, self.block_ids = stream, kind, block_ids
        self.zip = zstandard.ZstdCompressor(level=level)
        self.held: list[bytes] = []
        self.held_bytes = 0
        self.blocks: list[tuple[int, int, list[int], int]] = []
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []
        stream.write(MAGIC)
        self.at = len(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.held.append(ids)
        self.held_bytes += len(ids)
        if self.held_bytes >= 4 * self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        data, step = b"".join(self.held), 4 * self.block_ids
        end = len(data) if last else len(data) // step * step
        for k in range(0, end, step):
            self._block(np.frombuffer(data[k : min(k + step, end)], "<u4"))
        self.held, self.held_bytes = [data[end:]], len(data) - end

    def _block(self, ids: np.ndarray) -> None:
        packed = [self.zip.compress(x) if x.strip(b"\0") else b"" for x in to_planes(ids, self.kind)]
        self.blocks.append((self.at, len(ids), [len(x) for x in packed], zlib.crc32(ids.tobytes())))
        for x in packed:
            self.stream.write(x)
            self.at += len(x)

    def close(self) -> int:
        """Ends the file; returns its number of ids."""
        self._flush(True)
        index = self.zip.compress(json.dumps({"blocks": self.blocks, "doc_ids": self.doc_ids, "counts": self.counts}).encode())
        self.stream.write(index)
        self.stream.write(_TRAILER.pack(len(index), _PLANES[self.kind], self.block_ids, MAGIC))
        return sum(self.counts)


class Reader:
    """Reads a file of Writer's from a stream that can seek."""

    def __init__(self, stream: io.RawIOBase, size: int) -> None:
        self.stream = stream
        stream.seek(size - _TRAILER.size)
        length, planes, self.block_ids, magic = _TRAILER.unpack(stream.read(_TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a token file, or one that was never finished")
        self.kind = next(k for k, n in _PLANES.items() if n == planes)
        self.unzip = zstandard.ZstdDecompressor()
        stream.seek(size - _TRAILER.size - length)
        index = json.loads(self.unzip.decompress(stream.read(length)))
        self.blocks, self.doc_ids, self.counts = index["blocks"], index["doc_ids"], index["counts"]

    def block(self, k: int) -> np.ndarray:
        at, n, sizes, crc = self.blocks[k]
        self.stream.seek(at)
        ids = from_planes([self.unzip.decompress(self.stream.read(x)) if x else b"" for x in sizes], n, self.kind)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"block {k} is damaged")
        return ids

    def documents(self) -> Iterator[tuple[int | None, int, bytes]]:
        """doc_id, ids of the file before it and its ids as bytes, for each document in order."""
        data, base, k, at = b"", 0, 0, 0
        for doc_id, n in zip(self.doc_ids, self.counts, strict=True):
            while base + len(data) // 4 < at + n:
                data, base = data[4 * (at - base) :], at
                data += self.block(k).tobytes()
                k += 1
            yield doc_id, at, data[4 * (at - base) : 4 * (at - base + n)]
            at += n


def _open(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def write(docs: DataFrame, root: str, encoder: Callable[[], Callable[[str | None], bytes]], end_id: int = 0, kind: str = "byte", level: int = 3, partitions: int | None = None) -> DataFrame:
    """Writes the ids of docs(doc_id, text), each document's followed by ``end_id``, below ``root``.

    Documents go in ascending doc_id (null first, repeated ids by a hash of the text, then the text):
    ranges of both to partitions, so an id that many rows share is dealt to many, one file for each
    that has rows. ``encoder`` is called in the worker and gives what
    turns a text into bytes of ids; null is the empty text. Returns the manifest, which is also
    written to ``root``/manifest: file_no, name, docs, n_ids, start (ids in all files before it).
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = struct.pack("<I", end_id)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        fs, base = _open(root)
        number, name, writer, stream = TaskContext.get().partitionId(), "", None, None
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    name = f"part-{number:06d}-{TaskContext.get().taskAttemptId()}.planes"
                    stream = fs.open_output_stream(f"{base}/{name}")
                    writer = Writer(stream, kind, level)
                writer.add(None if pd.isna(doc_id) else int(doc_id), encode(text) + end)
        if writer is not None:
            ids = writer.close()
            stream.close()
            yield pd.DataFrame({"file_no": [number], "name": [name], "docs": [len(writer.counts)], "n_ids": [ids]})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_hash").asc()]
    ranged = own.withColumn("_hash", F.xxhash64("text")).repartitionByRange(n, *order).sortWithinPartitions(*order, "text").drop("_hash")
    rows = sorted(ranged.mapInPandas(task, "file_no int, name string, docs long, n_ids long").collect())  # one row for each file
    start, listed = 0, []
    for row in rows:
        listed.append((*row, start))
        start += row.n_ids
    manifest = spark.createDataFrame(listed, "file_no int, name string, docs long, n_ids long, start long").coalesce(1)
    manifest.write.parquet(f"{root}/manifest")
    return _manifest(spark, root)


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("file_no int, name string, docs long, n_ids long, start long").parquet(f"{root}/manifest")


def read(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (binary, little-endian unsigned
    32-bit) of what ``write`` put below ``root``; one task for each file, in bounded batches."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _open(root)
        for batch in batches:
            for name, start in zip(batch["name"], batch["start"], strict=True):
                rows, held = [], 0
                with fs.open_input_file(f"{base}/{name}") as stream:
                    for doc_id, at, ids in Reader(stream, stream.size()).documents():
                        rows.append((doc_id, start + at, ids))
                        held += len(ids)
                        if held > BATCH_BYTES // 2:
                            yield _rows(rows)
                            rows, held = [], 0
                if rows:
                    yield _rows(rows)

    manifest = _manifest(spark, root)
    files = max(1, manifest.count())
    return manifest.repartitionById(files, F.expr(f"int(file_no % {files})")).mapInPandas(task, "doc_id long, start long, ids binary")


def _rows(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "start", "ids"])
    return out.astype({"doc_id": "Int64", "start": "int64"})


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum, read back from the files."""
    import public_tokenizers

    bound_batches(spark)
    path, root = public_tokenizers.path("byte_bpe_50k.json"), scratch(spark, "op9-tokens")

    def encoder():
        from corpusieve.llm.encoders import library_encoder

        return library_encoder(path)

    write(table(spark, sf_dir, "documents"), root, encoder)
    return read(spark, root).select("doc_id", "start", F.expr("length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
