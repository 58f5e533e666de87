"""Operator 1: a quality classifier on supervised subword embeddings.

A word is represented by itself and its character n-grams, hashed to rows of one table of learned
vectors. So is each pair of neighbouring words, by whether the document had that pair before: two
rows of their own. A document's vector is the mean over all of its rows
and a few zeros; a softmax over it gives the
label. Table and output weights are trained by stochastic gradient descent in numpy, on a bounded
sample of labelled documents. Since everything up to the softmax is linear, scoring needs only one
number for each row, and one pair of numbers for each word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusieve.llm.sampling import learnable, sampled, taken
from corpusieve.llm.shingles import mixed, odd_numbers
from corpusieve.llm.words import WordTable, blocks, forget, text_rows
from corpusieve.runtime import bound_batches, table

ROW_BITS = 17
DIMENSIONS = 16
GRAMS = (2, 3, 4)
#: Labelled documents that a model is trained on at most, chosen by the hash of doc_id.
SAMPLE = 4000
#: Characters that they have together at most; documents after those that fill it are left out.
SAMPLE_CHARS = 1 << 25
#: Steps of gradient descent, over as many rounds of the sample as that takes.
STEPS = 12_000
#: Zero rows in every mean, so that a word or two decide little.
PRIOR = 20
RATE = 2.0


def features(words: list[str], bits: int = ROW_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the words and of their n-grams, and the word that each belongs to."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    shift = np.uint64(64 - bits)
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), sizes)
    rows = [(mixed(np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)) >> shift).astype(np.int64)]
    owners = [np.arange(len(words))]
    for n in GRAMS:
        count = len(points) - n + 1
        inside = owner[:count] == owner[n - 1 :]
        total = np.full(count, np.uint64(n))
        for k, factor in enumerate(odd_numbers(n, n)):
            total += (points[k : count + k] + np.uint64(1)) * factor
        rows.append((mixed(total[inside]) >> shift).astype(np.int64))
        owners.append(owner[:count][inside])
    return np.concatenate(rows), np.concatenate(owners)


def word_keys(words: list[str]) -> np.ndarray:
    """52 bits of each word's hash, which a double holds exactly."""
    return np.array([xxhash.xxh3_64_intdigest(w) >> 12 for w in words], float)


class Pairs:
    """Counts the pairs of neighbouring words of one document by whether they came before."""

    def __init__(self) -> None:
        self.seen, self.count, self.last = np.zeros(0, np.uint64), 0, np.zeros(0)

    def add(self, keys: np.ndarray) -> None:
        run = np.r_[self.last, keys].astype(np.uint64)
        self.last = keys[-1:]
        factors = odd_numbers(2, 2)
        pairs = run[1:] * factors[0] + run[:-1] * factors[1]
        self.count += len(pairs)
        self.seen = np.unique(np.concatenate([self.seen, pairs]) if len(self.seen) else pairs)

    def counts(self) -> np.ndarray:
        """Of pairs that came before, and of new ones."""
        return np.array([self.count - len(self.seen), len(self.seen)], float)


@dataclass
class Model:
    """``weight`` has the log-odds of label 1 that each row of the table adds, before the mean; its
    last two are those of pairs that came before and of new pairs."""

    weight: np.ndarray
    bias: float

    def word_sums(self, words: list[str]) -> np.ndarray:
        """For each word the sum of its rows' weights, their number, and its key."""
        rows, owner = features(words, (len(self.weight) - 2).bit_length() - 1)
        return np.stack([np.bincount(owner, self.weight[rows], len(words)), np.bincount(owner, minlength=len(words)).astype(float), word_keys(words)], 1)

    def scorer(self):
        """texts -> array of probabilities of label 1."""
        sums = WordTable(self.word_sums)

        def score(texts: list[str | None]) -> np.ndarray:
            total, pairs = np.zeros((len(texts), 2)), Pairs()
            last = -1
            for i, rows in text_rows(texts, sums):
                if i != last:
                    self._add_pairs(total, last, pairs)
                    pairs, last = Pairs(), i
                total[i] += rows[:, :2].sum(0)
                pairs.add(rows[:, 2])
            self._add_pairs(total, last, pairs)
            odds = self.bias + total[:, 0] / (total[:, 1] + PRIOR)
            return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

        return score

    def _add_pairs(self, total: np.ndarray, text: int, pairs: Pairs) -> None:
        if text >= 0:
            counts = pairs.counts()
            total[text] += counts @ self.weight[-2:], counts.sum()


def train(texts: list[str], labels: list[int], bits: int = ROW_BITS, dimensions: int = DIMENSIONS, steps: int = STEPS, rate: float = RATE, seed: int = 7) -> Model:
    """Trains on texts with labels 0 and 1; without texts every score is 0.5."""
    if not texts:
        return Model(np.zeros((1 << bits) + 2), 0.0)
    number: dict[str, int] = {}
    counted = []
    for text in texts:
        words = np.fromiter((number.setdefault(w, len(number)) for w in text.split()), np.int32)
        pairs = Pairs()
        pairs.add(words.astype(float))
        counted.append((*np.unique(words, return_counts=True), pairs.counts()))
    rows, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for part in blocks(list(number), 1 << 14):
        own, owner = features(part, bits)
        rows.append(own[np.argsort(owner, kind="stable")].astype(np.int32))
        sizes.append(np.bincount(owner, minlength=len(part)))
    del number
    rows, sizes = np.concatenate(rows), np.concatenate(sizes)
    begins = np.cumsum(sizes) - sizes
    documents = []
    for (words, times, pair), label in zip(counted, labels, strict=True):
        if len(words):
            own = sizes[words]
            at = np.repeat(begins[words] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            unique, back = np.unique(rows[at], return_inverse=True)
            weight = np.r_[np.bincount(back, np.repeat(times, own)), pair]
            unique = np.r_[unique, 1 << bits, (1 << bits) + 1].astype(np.int32)
            documents.append((unique, (weight / (weight.sum() + PRIOR)).astype(np.float32), label))
    del rows, counted
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / dimensions, 1 / dimensions, ((1 << bits) + 2, dimensions)).astype(np.float32)
    output, bias = np.zeros((2, dimensions), np.float32), np.zeros(2, np.float32)
    done, rounds = 0, -(-steps // max(len(documents), 1)) if documents else 0
    for _ in range(rounds):
        for k in random.permutation(len(documents))[: steps - done]:
            unique, weight, label = documents[k]
            step = np.float32(rate * (1 - done / steps))
            done += 1
            hidden = weight @ vectors[unique]
            logits = output @ hidden + bias
            wrong = np.exp(logits - logits.max())
            wrong /= wrong.sum()
            wrong[label] -= 1
            back = wrong @ output
            output -= step * np.outer(wrong, hidden)
            bias -= np.float32(0.1) * step * wrong
            vectors[unique] -= step * np.outer(weight, back)
    return Model((vectors @ (output[1] - output[0])).astype(float), float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    """A model from at most ``sample`` documents, of ``chars`` characters together, that have a label
    and are not held out.

    Ids are chosen first, by hash, from ``labels`` alone, so only texts of the sample leave the
    executors. Several labels of one document: the majority, 1 on a tie; null labels and ids
    count as none; of repeated documents one text is taken, and none that is longer than a 64th of ``chars``.
    """
    known = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    ids = F.broadcast(sampled(known, sample, "doc_id"))  # bounded by sample
    rows = learnable(docs, chars).select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    found = list(taken(rows, chars, "doc_id"))
    return train([r.text for r in found], [r.label for r in found])


def score(text: Column, model: Model) -> Column:
    """Probability of label 1 for each whole text; texts without words (and null) get what the
    output layer says of a zero vector."""

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        rate = model.scorer()
        for batch in texts:
            yield pd.Series(rate(list(batch)), dtype=float)

    return of(text)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs(doc_id, text)."""
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), learn(docs, labels)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality."""
    bound_batches(spark)
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
