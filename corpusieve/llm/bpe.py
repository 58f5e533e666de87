"""Operator 8: byte-level BPE encoding and decoding by backtracking over longest matches.

The vocabulary's byte strings, read as Latin-1 text, form one Aho-Corasick automaton. A single
pass over a pretoken finds the longest token that starts at each byte. Tokens are then laid from
the left, longest first; two neighbours may stand together only if no merge would ever have
crossed their border, which is decided once for each pair of tokens and remembered. A position
from which no continuation exists is marked and never entered again, so the work is linear in the
text. The sequence in which all neighbours are compatible is the one the merges would have made.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusieve.llm.encoders import ChunkEncoder
from corpusieve.llm.words import only

_NEVER = math.inf
#: Pairs of tokens that a worker remembers at most.
FITS = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """token -> rank of a file with a base64 token and its rank in each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class Vocabulary:
    """Encodes single pretokens by ranks; ids are the ranks."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}  # the two tokens whose merge makes a token
        self.merged: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int | None] = {}
        self.automaton = ahocorasick.Automaton()
        self._build()

    def _build(self) -> None:
        """Adds tokens by rising rank. A token that lower merges can't leave as two parts is never
        made by merging, so it stays out of the automaton."""
        reachable: dict[bytes, int] = {}
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                if (parts := self._two_parts(token, reachable)) is None:
                    continue
                self.parts[rank] = parts
                self.merged[parts] = rank
            reachable[token] = rank
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.fits.clear()  # decided so far without the merges of higher ranks
        self.automaton.make_automaton()
        for token, rank in reachable.items():
            self.shorter[rank] = next((reachable[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in reachable), None)

    def _two_parts(self, token: bytes, known: dict[bytes, int]) -> tuple[int, int] | None:
        for k in range(1, len(token)):
            a, b = known.get(token[:k]), known.get(token[k:])
            if a is not None and b is not None and self.compatible(a, b):
                return a, b
        return None

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges of left's bytes followed by right's end in these two tokens.

        Both tokens are undone step by step, the later merge first; while two pieces touch at the
        border, their own merge must not have had its turn before either was used up. Of equal
        merges the one further left comes first.
        """
        key = (left, right)
        if (known := self.fits.get(key)) is None:
            if len(self.fits) >= FITS:
                self.fits.clear()
            known = self.fits[key] = self._apart(left, right)
        return known

    def _apart(self, x: int, y: int) -> bool:
        parts, merged = self.parts, self.merged
        x_used, y_used = _NEVER, _NEVER  # when the piece is merged into a larger one
        while True:
            rank = merged.get((x, y))
            if rank is not None and rank < x_used and rank <= y_used:
                return False
            x_made, y_made = (x if x in parts else -1), (y if y in parts else -1)
            if x_made < 0 and y_made < 0:
                return True
            if y_made >= x_made:
                y_used, y = y_made, parts[y][0]
            else:
                x_used, x = x_made, parts[x][1]

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one pretoken; one that is itself in the vocabulary is not split."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        size = len(piece)
        longest, lengths = [-1] * size, [0] * size
        for end, (n, rank) in self.automaton.iter(piece.decode("latin-1")):
            if n > lengths[start := end - n + 1]:
                longest[start], lengths[start] = rank, n
        token, shorter = self.token, self.shorter
        dead = bytearray(size + 1)
        out: list[int] = []
        at, trying = 0, longest[0]
        while at < size:
            while trying is not None:
                end = at + len(token[trying])
                if not dead[end] and (not out or self.compatible(out[-1], trying)):
                    break
                trying = shorter[trying]
            if trying is None:
                dead[at] = 1
                trying = out.pop()
                at -= len(token[trying])
                trying = shorter[trying]
            else:
                out.append(trying)
                at = end
                trying = longest[at] if at < size else None
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


def loaded(path: str) -> tuple[Vocabulary, ChunkEncoder]:
    """The vocabulary of a rank file and its encoder of texts, which a worker process keeps between tasks."""

    def make() -> tuple[Vocabulary, ChunkEncoder]:
        own = Vocabulary(read_ranks(path))
        return own, ChunkEncoder(lambda pretoken: np.array(own.encode(pretoken.encode()), "<u4").tobytes(), limit=600_000)

    return only(("ranks", path), make)


def encode(text: Column, ranks_path: str) -> Column:
    """Ids of each whole text as binary: little-endian unsigned 32-bit integers.

    Null and empty texts give no ids. ``ranks_path`` must be a file on every executor.
    """

    @F.pandas_udf("binary")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        _, encoder = loaded(ranks_path)
        for batch in texts:
            yield pd.Series([encoder(x) for x in batch], dtype=object)

    return ids(text)


def decode(ids: Column, ranks_path: str) -> Column:
    """The bytes that ids, as ``encode`` gives them, stand for; null gives null."""

    @F.pandas_udf("binary")
    def texts(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary, _ = loaded(ranks_path)
        for batch in column:
            yield pd.Series([None if x is None else vocabulary.decode(np.frombuffer(x, "<u4")) for x in batch], dtype=object)

    return texts(ids)


def round_trip(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, ids and decoded (both binary) of every row of docs(doc_id, text); rows stay as
    many as they are, also where doc_id repeats or is null."""
    own = docs.select("doc_id", encode(F.col("text"), ranks_path).alias("ids"))
    return own.select("doc_id", "ids", decode(F.col("ids"), ranks_path).alias("decoded"))


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and their decoding, as digests."""
    import public_tokenizers

    from corpusieve.runtime import bound_batches, table

    bound_batches(spark)
    out = round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return out.select("doc_id", F.expr("length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
