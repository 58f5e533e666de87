"""Operator 4: maximum inner product search by score-aware anisotropic quantisation.

Vectors are product-quantised: each subspace of a few dimensions has 16 code words, so a code takes
four bits. Code words and codes minimise a loss that weighs the error along the vector more than
the error across it, since it is the former that shifts large inner products. A query makes a table
of its inner products with the code words; scanning a block of codes adds up table entries, two codes
(one byte) at a time. The best of every block by these sums are ranked again by exact inner
products, and the best of all blocks are merged.

Queries are a stated set and meet all rows, in blocks of both. Codes are made once for every row.
Rows are told apart by a number of their own, not by vec_id, which may repeat. Vectors travel in
the precision that they are stored in and are compared in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from corpusieve.llm.sampling import sampled
from corpusieve.runtime import bound_batches, table, written

WORDS = 16
#: Dimensions of a subspace.
WIDTH = 2
#: Rows that code words are fitted on at most, by the hash of vec_id.
SAMPLE = 8192
#: Share of a vector's norm from which on an inner product counts as large.
THRESHOLD = 0.2
ROUNDS, SWEEPS = 8, 2
#: Rows travel once for each block of queries and queries once for each block of rows, and every block
#: gives each query its best: so blocks are large. Blocks of rows are smaller, down to ROW_BLOCK,
#: where there would be fewer of them than three for each partition.
QUERY_BLOCK, LARGE_BLOCK, ROW_BLOCK = 1 << 16, 1 << 16, 4096
#: Distinct vectors of each block that are ranked exactly, and all that tie with the last of them.
RERANK = 128
NEAREST = 20


def _directions(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


@dataclass
class Quantiser:
    """``words``: subspaces x 16 x WIDTH code words; ``weight``: of the error along a vector, in
    addition to the error's square."""

    words: np.ndarray
    weight: float
    dimension: int

    def _parts(self, x: np.ndarray) -> np.ndarray:
        """x cut into subspaces, with zeros to fill the last."""
        whole = np.zeros((len(x), self.words.shape[0] * self.words.shape[2]))
        whole[:, : self.dimension] = x
        return whole.reshape(len(x), self.words.shape[0], -1)

    def codes(self, x: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
        """Rows x subspaces codes, by coordinate descent on the anisotropic loss."""
        parts, along = self._parts(x), self._parts(_directions(x))
        out = np.empty(parts.shape[:2], np.uint8)
        parallel = np.zeros(parts.shape[:2])
        for sweep in range(sweeps + 1):
            for s, words in enumerate(self.words):
                error = parts[:, s, None, :] - words
                square = (error**2).sum(2)
                own = np.einsum("nwd,nd->nw", error, along[:, s])
                if sweep:
                    others = parallel.sum(1) - parallel[:, s]
                    square = square + self.weight * (others[:, None] + own) ** 2
                out[:, s] = square.argmin(1)
                parallel[:, s] = own[np.arange(len(x)), out[:, s]]
        return out

    def loss(self, x: np.ndarray, codes: np.ndarray) -> float:
        error = self._parts(x) - self.words[np.arange(len(self.words)), codes]
        along = (error * self._parts(_directions(x))).sum((1, 2))
        return float(((error**2).sum((1, 2)) + self.weight * along**2).mean())

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Queries x bytes x 256: inner products of a query with both code words of a byte."""
        each = np.einsum("qsd,swd->qsw", self._parts(queries), self.words)
        return (each[:, 1::2, :, None] + each[:, ::2, None, :]).reshape(len(queries), -1, WORDS * WORDS).astype(np.float32)


def pack_codes(codes: np.ndarray) -> np.ndarray:
    """Two codes in each byte: the even subspace low, the odd one high."""
    return (codes[:, 1::2] << 4 | codes[:, ::2]).astype(np.uint8)


def fit(sample: np.ndarray, dimension: int, rounds: int = ROUNDS, threshold: float = THRESHOLD, seed: int = 11) -> Quantiser:
    """Code words from a sample: k-means in each subspace, then alternating codes by the
    anisotropic loss and the least-squares code words for these codes."""
    spaces = -(-dimension // WIDTH)
    spaces += spaces % 2
    eta = (max(dimension, 2) - 1) * threshold**2 / (1 - threshold**2)
    q = Quantiser(np.zeros((spaces, WORDS, WIDTH)), max(0.0, eta - 1), dimension)
    if not len(sample):
        return q
    random = np.random.default_rng(seed)
    parts, along = q._parts(sample), q._parts(_directions(sample))
    for s in range(spaces):
        words = parts[random.choice(len(sample), WORDS), s].copy()
        for _ in range(rounds):
            near = ((parts[:, s, None, :] - words) ** 2).sum(2).argmin(1)
            for w in np.unique(near):
                words[w] = parts[near == w, s].mean(0)
        q.words[s] = words
    for _ in range(rounds):
        codes = q.codes(sample)
        for s in range(spaces):
            error = parts - q.words[np.arange(spaces), codes]
            parallel = (error * along).sum(2)
            others = parallel.sum(1) - parallel[:, s]
            for w in np.unique(codes[:, s]):
                rows = codes[:, s] == w
                x, d = parts[rows, s], along[rows, s]
                left = rows.sum() * np.eye(WIDTH) + q.weight * d.T @ d
                right = x.sum(0) + q.weight * (d * (others[rows] + (x * d).sum(1))[:, None]).sum(0)
                q.words[s, w] = np.linalg.solve(left, right)
    return q


def scan(codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Approximate inner products of one query, by its tables, with every packed code."""
    total = tables[0][codes[0]]
    for k in range(1, len(codes)):
        total += tables[k][codes[k]]
    return total


def best_of_block(numbers: np.ndarray, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, asking: np.ndarray, queries: np.ndarray, tables: np.ndarray, nearest: int, rerank: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each query of the numbers ``asking`` its place there, and numbers, ids and exact scores of
    its ``nearest`` in a block of rows; the row of its own number is not among them.

    Equal vectors are scanned once, and of each only the first rows by id stand for it, as many as an
    answer can hold besides the query's own row: so no number of copies can crowd out another vector.
    """
    order = np.lexsort((numbers, ids))
    numbers, ids, vectors, codes = numbers[order], ids[order], vectors[order], codes[order]
    _, first, group = np.unique(np.ascontiguousarray(vectors + 0.0).view([("", vectors.dtype)] * vectors.shape[1]).ravel(), return_index=True, return_inverse=True)
    members = np.argsort(group, kind="stable")
    starts = np.r_[0, np.cumsum(np.bincount(group))]
    distinct, columns = vectors[first], np.ascontiguousarray(codes[first].T)
    most = nearest + 1
    for place, (number, query) in enumerate(zip(asking, queries, strict=True)):
        likely = scan(columns, tables[place]) if len(columns) else (distinct * query).sum(1)
        least = np.partition(likely, -rerank)[-rerank] if len(likely) > rerank else -np.inf
        top = np.flatnonzero(likely >= least)  # all that tie with the last: codes can't tell them apart
        exact = (distinct[top] * query).sum(1)
        if len(top) < len(likely):
            # what was left out may still belong here if its sum erred as much as any seen so far
            holds = np.minimum(starts[top + 1] - starts[top], most)
            by_score = np.argsort(-exact)
            enough = by_score[min(np.searchsorted(np.cumsum(holds[by_score]), most), len(top) - 1)]
            reach = exact[enough] - max(0.0, float((exact - likely[top]).max()))
            if reach < least:
                more = np.flatnonzero((likely < least) & (likely >= reach))
                top, exact = np.r_[top, more], np.r_[exact, (distinct[more] * query).sum(1)]
        rows = np.concatenate([members[starts[g] : min(starts[g + 1], starts[g] + most)] for g in top])
        scores = np.repeat(exact, np.minimum(starts[top + 1] - starts[top], most))
        keep = numbers[rows] != number
        rows, scores = rows[keep], scores[keep]
        best = np.lexsort((numbers[rows], ids[rows], -scores))[:nearest]
        yield place, numbers[rows][best], ids[rows][best], scores[best]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and x (array of double) of the rows that take part: vec_id and vector not null, all
    components finite and not all zero."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    sound = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("x", lambda v: v != 0)
    return rows.where(F.coalesce(sound, F.lit(False)))


def _is_float(vectors: DataFrame) -> bool:
    return vectors.schema["embedding"].dataType == ArrayType(FloatType(), vectors.schema["embedding"].dataType.containsNull)


def _joined(packed: pd.Series, kind: str) -> np.ndarray:
    """The vectors of a column of bytes, in double precision."""
    return np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1).astype(float)


def search(vectors: DataFrame, queries: DataFrame | None = None, nearest: int = NEAREST, rerank: int = RERANK, every: int = 20, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score of each query's nearest rows of vectors(vec_id,
    embedding) by inner product, ties to smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``, each without itself among its
    candidates, or the rows of ``queries``, to which every row is a candidate. A repeated vec_id is
    as many rows and as many queries, each with an answer of its own. Only vectors of a query's own
    length are its candidates. Of equally frequent lengths the least has codes.
    """
    rows = usable(vectors)
    common = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dimension = common[0].n if common else 1
    fitted = np.array([r.x for r in sampled(rows.where(F.size("x") == dimension), sample, "vec_id", "x").collect()])
    quantiser = fit(fitted.reshape(-1, dimension), dimension)
    kind = "<f4" if _is_float(vectors) and (queries is None or _is_float(queries)) else "<f8"

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, b in batch.groupby(batch["x"].map(len)):
                x = np.stack(b["x"].to_list())
                codes = [c.tobytes() for c in pack_codes(quantiser.codes(x))] if n == dimension else [b""] * len(b)
                yield pd.DataFrame({"number": b["number"], "vec_id": b["vec_id"], "n": n, "x": [v.tobytes() for v in x.astype(kind)], "code": codes}).astype({"n": "int32"})

    def indexed(own: DataFrame, name: str) -> DataFrame:
        numbered = own.withColumn("number", F.monotonically_increasing_id())
        return written(numbered.mapInPandas(encode, "number long, vec_id long, n int, x binary, code binary"), name)

    index = indexed(rows, "op4-index")
    if queries is None:
        # read anew: cogroup mixes up the columns of two frames that share theirs
        asked = index.sparkSession.read.schema(index.schema).parquet(index.written_to).where(F.col("vec_id") % every == 0)
    else:  # numbers that no row has
        asked = indexed(usable(queries), "op4-queries").withColumn("number", -1 - F.col("number"))
    n_rows, n_asked = index.count(), asked.count()
    query_blocks = max(1, -(-n_asked // QUERY_BLOCK))
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row_blocks = max(1, -(-n_rows // LARGE_BLOCK), min(-(-n_rows // ROW_BLOCK), -(-3 * tasks // query_blocks)))
    by_query = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    by_row = F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)))
    left = index.withColumn("r", F.pmod(F.xxhash64("number"), F.lit(row_blocks)).cast("int")).withColumn("q", by_query)
    right = asked.drop("code").withColumn("q", F.pmod(F.xxhash64("number", F.lit(1)), F.lit(query_blocks)).cast("int")).withColumn("r", by_row)

    def meet(block: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(block) and len(ask):
            numbers, ids, x = block["number"].to_numpy(), block["vec_id"].to_numpy(), _joined(block["x"], kind)
            codes = np.frombuffer(b"".join(block["code"]), np.uint8).reshape(len(block), -1)
            for k in range(0, len(ask), 256):
                part = ask.iloc[k : k + 256]
                asking, query_ids, wanted = part["number"].to_numpy(), part["vec_id"].to_numpy(), _joined(part["x"], kind)
                tables = quantiser.tables(wanted) if x.shape[1] == dimension else np.zeros((len(part), 0))
                for place, *near in best_of_block(numbers, ids, x, codes, asking, wanted, tables, nearest, rerank):
                    found.append((np.full(len(near[0]), asking[place]), np.full(len(near[0]), query_ids[place]), *near))
        return pd.DataFrame({name: np.concatenate(c) for name, c in zip(("asking", "query_id", "number", "vec_id", "score"), zip(*found, strict=True), strict=True)})

    # dealt by number, since blocks are small and take long: adaptive execution would put many in one task
    left, right = (x.repartition(tasks, "q", "r", "n") for x in (left, right))
    met = left.groupBy("q", "r", "n").cogroup(right.groupBy("q", "r", "n")).applyInPandas(meet, "asking long, query_id long, number long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("asking").orderBy(F.desc("score"), "vec_id", "number"))
    return met.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth embedding."""
    bound_batches(spark)
    return search(table(spark, sf_dir, "embeddings"))
