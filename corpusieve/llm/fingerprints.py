"""Operator 3: document fingerprints by one-permutation MinHash.

The hashes of a text's word shingles are binned once; each bin keeps its least hash, empty bins are
filled by optimal densification, and of each bin's hash only the low-order bits are stored. Two
sets agree in a bin with probability J + (1 - J) / 2^bits, so the share of equal bins is corrected
for chance agreement.

A fingerprint is binary, two bins of 4 bits in each byte. That of a text without words is empty; two
such texts have likeness 1, one of them and any other text 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusieve.functions.arrays import place_among
from corpusieve.llm.shingles import OnePermutation, Shingler
from corpusieve.runtime import bound_batches, table

BINS = 512
BITS = 4


class Fingerprinter:
    """text -> low-order bits of each bin, as a small array (empty for a text without words)."""

    def __init__(self, bins: int = BINS) -> None:
        self.shingler, self.bin = Shingler(), OnePermutation(bins)

    def __call__(self, text: str | None) -> np.ndarray:
        shingles = self.shingler(text)
        if not len(shingles):
            return np.zeros(0, np.uint8)
        return (self.bin(shingles) & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def packed(bits: np.ndarray) -> bytes:
    """Two bins in each byte, the even one high."""
    return (bits[::2] << BITS | bits[1::2]).astype(np.uint8).tobytes()


def unpacked(fingerprint: bytes) -> np.ndarray:
    both = np.frombuffer(fingerprint, np.uint8)
    return np.stack([both >> BITS, both & (1 << BITS) - 1], 1).ravel()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The estimate of the Jaccard similarity of the two shingle sets, 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    chance = 1 / (1 << BITS)
    return max(0.0, (float((a == b).mean()) - chance) / (1 - chance))


def fingerprint(text: Column, bins: int = BINS) -> Column:
    """The fingerprint of each whole text; null counts as the empty text."""

    @F.pandas_udf("binary")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        make = Fingerprinter(bins)
        for batch in texts:
            yield pd.Series([packed(make(x)) for x in batch], dtype=object)

    return of(text)


def similarity(a: Column, b: Column) -> Column:
    """Likeness of two fingerprint columns; null where either is null. No Python: their hex digits,
    one for each bin, are compared in place."""
    equal = F.aggregate(F.zip_with(F.split(F.hex(a), ""), F.split(F.hex(b), ""), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    share = equal / F.greatest(2 * F.octet_length(a), F.lit(1))
    chance = 1 / (1 << BITS)
    fair = F.greatest(F.lit(0.0), (share - chance) / (1 - chance))
    empty = F.octet_length(a) * F.octet_length(b) == 0
    return F.when(empty, (a == b).cast("double")).otherwise(fair)


def with_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows of docs(doc_id, text) in runs of descending doc_id, each run in one partition and
    followed by the row that comes after it (``guest``): after the last row comes the first.

    Runs are cut at quantiles of doc_id, so they hold about as many rows. Rows of one doc_id stand
    in the order of their texts, null ids last. One shuffle of the texts.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), key.alias("key"))
    ids = own.select("key")
    cuts = sorted(set(ids.selectExpr("double(key) k").approxQuantile("k", [k / n for k in range(1, n)], 0.2 / n))) if n > 1 else []
    run = place_among(F.lit(cuts), len(cuts), F.col("key").cast("double"))
    tops = dict(sorted((r.run, r.top) for r in ids.groupBy(run.alias("run")).agg(F.max("key").alias("top")).collect()))  # a row for each run
    above = dict(zip(tops, [*list(tops)[1:], *list(tops)[:1]], strict=True))
    top_of, above_of = (F.array(*[F.lit(of.get(k)).cast("long") for k in range(len(cuts) + 1)]) for of in (tops, above))
    runs = F.when(F.get(top_of, F.col("own")) == F.col("key"), F.array(F.col("own"), F.get(above_of, F.col("own")).cast("int"))).otherwise(F.array("own"))

    placed = own.withColumn("own", run).select("doc_id", "text", "key", F.posexplode(runs).alias("guest", "run"))
    return placed.repartitionById(n, "run").sortWithinPartitions("run", "guest", F.col("key").desc(), "text").select("run", "guest", "doc_id", "text")


REPORT = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def edit_report(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Fingerprints of docs(doc_id, text) and of texts whose last third is the next one's head.

    A row for each row: n_chars (code points), edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next. Null texts are empty; a single row is its own next.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make, held, rows = Fingerprinter(), None, []
        for batch in batches:
            for run, guest, doc_id, text in zip(batch["run"], batch["guest"], batch["doc_id"], batch["text"], strict=True):
                if held is None and guest:
                    continue
                bits = make(text)
                if held is not None:
                    rows.append(_row(make, held, text, bits))
                held = None if guest else (run, None if pd.isna(doc_id) else int(doc_id), text, bits)
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in REPORT.split(", ")]).astype({"doc_id": "Int64", "n_chars": "int64", "near_edited": float, "near_next": float})
            rows = []

    return with_next(docs, partitions).mapInPandas(task, REPORT)


def _row(make: Fingerprinter, held: tuple, next_text: str, next_bits: np.ndarray) -> tuple:
    _, doc_id, text, bits = held
    third = len(text) // 3
    edited = text[: len(text) - third] + next_text[:third]
    edited_bits = make(edited)
    return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), packed(bits), packed(edited_bits), likeness(bits, edited_bits), likeness(bits, next_bits)


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness."""
    bound_batches(spark)
    out = edit_report(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
