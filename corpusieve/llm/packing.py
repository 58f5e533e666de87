"""Operator 10: bounded-space online packing of documents into training sequences.

Each partition keeps a fixed number of open windows. A document gives as many whole windows as it
fills; what remains goes into the fullest window that still has room for all of it. When none
has, and no further window may be opened, the fullest one takes the head of the piece as far as it
has room and is emitted. Windows that are still open at the end of a partition are the leftovers:
a bounded number of them, which meet by groups of partitions, are packed again, and are in the end
laid end to end. The last tokens are cut into powers of two, the lengths that need no padding.
"""

from __future__ import annotations

import bisect
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusieve.runtime import bound_batches, scratch, table

LENGTH = 2048
OPEN_WINDOWS = 32
#: Partitions whose leftovers meet in one group.
MERGED_PARTITIONS = 32
PIECE = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"

Piece = tuple[int, int, bytes, int]  # doc_id, start, ids, tokens of the document


class Packer:
    """Bounded-space best fit over pieces; ``emit`` gets each closed window, a list of pieces."""

    def __init__(self, emit: Callable[[list[Piece]], None], length: int = LENGTH, windows: int = OPEN_WINDOWS) -> None:
        self.emit, self.length, self.windows = emit, length, windows
        self.open: list[tuple[int, int]] = []  # room and number of each open window, by room
        self.pieces: dict[int, list[Piece]] = {}
        self.made = 0

    def add(self, piece: Piece) -> None:
        doc_id, start, ids, total = piece
        at, size, full = 0, len(ids) // 4, self.length
        while size - at >= full:
            self.emit([(doc_id, start + at, ids[4 * at : 4 * (at + full)], total)])
            at += full
        while at < size:
            k = bisect.bisect_left(self.open, (size - at, -1))
            if k == len(self.open):
                if len(self.open) < self.windows:
                    self.made += 1
                    self.pieces[self.made] = []
                    self.open.append((full, self.made))
                    k = len(self.open) - 1
                else:
                    k = 0
            room, number = self.open.pop(k)
            take = min(room, size - at)
            self.pieces[number].append((doc_id, start + at, ids[4 * at : 4 * (at + take)], total))
            at += take
            if take == room:
                self.emit(self.pieces.pop(number))
            else:
                bisect.insort(self.open, (room - take, number))

    def leftovers(self) -> Iterator[list[Piece]]:
        """The windows that are still open, fullest first; they are no longer held."""
        for _, number in self.open:
            yield self.pieces.pop(number)
        self.open = []


def powers_of_two(pieces: list[Piece], length: int) -> Iterator[list[Piece]]:
    """Lays pieces end to end and cuts them into windows, the last tokens into powers of two."""
    rest = sum(len(x[2]) for x in pieces) // 4
    queue, at = list(reversed(pieces)), 0
    while rest:
        room = min(length, 1 << (rest.bit_length() - 1)) if length & (length - 1) == 0 else min(length, rest)
        rest -= room
        window: list[Piece] = []
        while room:
            doc_id, start, ids, total = queue[-1]
            take = min(room, len(ids) // 4 - at)
            if take:
                window.append((doc_id, start + at, ids[4 * at : 4 * (at + take)], total))
            at, room = at + take, room - take
            if at == len(ids) // 4:
                queue.pop()
                at = 0
        yield window


class _Out:
    """Collects emitted windows as rows."""

    def __init__(self, base: int) -> None:
        self.next, self.rows = base, []

    def __call__(self, window: list[Piece]) -> None:
        offset = 0
        for doc_id, start, ids, total in window:
            self.rows.append((doc_id, start, ids, total, self.next, offset))
            offset += len(ids) // 4
        self.next += 1

    def take(self, is_open: bool, task: int) -> pd.DataFrame:
        rows, self.rows = self.rows, []
        out = pd.DataFrame(rows, columns=["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"]).astype({"doc_id": "Int64"})
        return out.assign(open=is_open, task=task)


def pack(docs: DataFrame, root: str, encoder: Callable[[], Callable[[str | None], bytes]], end_id: int, length: int = LENGTH, windows: int = OPEN_WINDOWS) -> DataFrame:
    """Packs docs(doc_id, text) into sequences of at most ``length`` ids, written below ``root``.

    Returns a row for each piece: doc_id, start (ids of its document before it), ids (binary,
    little-endian unsigned 32-bit), doc_tokens, sequence_id and offset in the sequence. Every
    document ends with ``end_id``; null and empty texts have only that. Only the last sequences of
    a merge group are shorter than ``length``, and those are powers of two if ``length`` is one.
    No shuffle but of the leftovers: ``windows`` for each partition at most.
    """
    spark, end = docs.sparkSession, struct.pack("<I", end_id)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, number = encoder(), TaskContext.get().partitionId()
        out = _Out(number << 32)
        packer = Packer(out, length, windows)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encode(text) + end
                packer.add((None if pd.isna(doc_id) else int(doc_id), 0, ids, len(ids) // 4))
                if len(out.rows) > 2000:
                    yield out.take(False, number)
        yield out.take(False, number)
        for window in packer.leftovers():
            out(window)
        yield out.take(True, number)

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["sequence_id", "offset"])
        out = _Out((1 << 62) | (int(key[0]) << 32))
        packer = Packer(out, length, windows)
        for x in rows.itertuples():
            packer.add((None if pd.isna(x.doc_id) else int(x.doc_id), x.start, x.ids, x.doc_tokens))
        for window in powers_of_two([x for w in packer.leftovers() for x in w], length):
            out(window)
        return out.take(False, 0).drop(columns=["open", "task"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own.mapInPandas(task, f"{PIECE}, open boolean, task int").write.partitionBy("open").parquet(root)
    packed = spark.read.schema(f"{PIECE}, task int, open boolean").parquet(root)
    left = packed.where("open").withColumn("merge_group", F.expr(f"task div {MERGED_PARTITIONS}"))
    merged = left.drop("open", "task").groupBy("merge_group").applyInPandas(merge, PIECE)
    return packed.where("not open").drop("open", "task").unionByName(merged)


def library_pack(docs: DataFrame, root: str, path: str, end_id: int = 1, remembered: int | None = None) -> DataFrame:
    """``pack`` with the tokenizers library's vocabulary at ``path``; a worker remembers the ids of as
    many words as ``remembered`` says, which changes nothing but time and memory."""

    def encoder():
        from corpusieve.llm import encoders

        return encoders.library_encoder(path, remembered or encoders.REMEMBERED)

    return pack(docs, root, encoder, end_id)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", F.expr("length(ids) div 4").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place."""
    import public_tokenizers

    bound_batches(spark)
    return digest(library_pack(table(spark, sf_dir, "documents"), scratch(spark, "op10-packed"), public_tokenizers.path("byte_bpe_50k.json")))
