"""Operator 2: language identification by prediction by partial matching.

For each language a byte context tree holds how often each byte followed each context of up to
``ORDER`` bytes. A byte that was seen in the longest known context costs -log2(c / (t + d)) bits (c
its count there, t all counts, d distinct bytes); otherwise an escape of -log2(d / (t + d)) bits is
paid and the context loses its oldest byte; below the empty context any byte costs 8 bits. The
statistics stay as they were learned, so the code length of a text is exact and the same everywhere.

What is coded is the lower-cased text in which every run of other characters than letters is one
space, from its first byte to its last, contexts reaching over words. Of languages with equally
short codes the first by name is predicted.

A byte and the bytes before it that can matter are a window; texts are coded together, and each
distinct window of some hundred thousand bytes is looked up once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusieve.llm.sampling import learnable, sampled_by, taken
from corpusieve.llm.shingles import mixed
from corpusieve.llm.words import forget
from corpusieve.runtime import bound_batches, table

ORDER = 4
#: Documents of each language, and of all together, that statistics are learned from at most.
PER_LANGUAGE = 400
SAMPLE = 4000
#: Characters that they have together at most, and values of ``lang`` that count, the most frequent.
SAMPLE_CHARS = 1 << 25
LANGUAGES = 400
UNDETERMINED = "und"
#: A text is in no learned language if a byte takes more than so many times the usual bits.
FAR = 2.5
#: Bytes that are coded together.
BYTES = 1 << 19
_OTHER = re.compile(r"[\W\d_]+")
_TAG, _LOW = np.uint64(56), np.uint64((1 << 56) - 1)


def stream(text: str | None) -> bytes:
    """The bytes that are coded, between two spaces; empty if there is no letter."""
    words = _OTHER.sub(" ", (text or "").lower()).strip(" ")
    return f" {words} ".encode("utf-8", "surrogatepass") if any(map(str.isalpha, words)) else b""


def windows(streams: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows of all bytes but the first of each stream, and the numbers of their streams, some at a
    time. A window is a number: the byte, the bytes before it of its stream, ``order`` at most, and on
    top how many these are."""
    for first, last in _parts([len(x) for x in streams]):
        data = np.frombuffer(b"".join(streams[first:last]), np.uint8)
        sizes = np.array([len(x) for x in streams[first:last]], np.int64)
        for k in range(0, len(data), BYTES):  # a long text is one part of several times as many bytes
            at = np.arange(k, min(k + BYTES, len(data)))
            owner = np.searchsorted(np.cumsum(sizes), at, "right")
            place = at - (np.cumsum(sizes) - sizes)[owner]
            at, owner, place = at[place > 0], owner[place > 0], np.minimum(place[place > 0], order)
            key = data[at].astype(np.uint64) | place.astype(np.uint64) << _TAG
            for back in range(1, order + 1):
                there = place >= back
                key[there] |= data[at[there] - back].astype(np.uint64) << np.uint64(8 * back)
            yield key, owner + first


def _parts(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring items of about BYTES together."""
    first, held = 0, 0
    for k, size in enumerate(sizes):
        if held and held + size > BYTES:
            yield first, k
            first, held = k, 0
        held += size
    if held:
        yield first, len(sizes)


def _context(key: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` bytes before the byte of a window, tagged with the order."""
    return np.uint64(order) << _TAG | key >> np.uint64(8) & np.uint64((1 << 8 * order) - 1)


def _with_byte(context: np.ndarray, key: np.ndarray) -> np.ndarray:
    return (context >> _TAG << _TAG) | ((context & _LOW) << np.uint64(8)) | key & np.uint64(255)


class Lookup:
    """Places of keys in an array, by open addressing; a wanted key takes a probe or two."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.mask = np.uint64((1 << max(4, (4 * len(keys)).bit_length())) - 1)
        self.slots = np.full(int(self.mask) + 1, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._first(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several keys for one slot one stays
            stays = self.slots[at] == left
            left, at = left[~stays], (at[~stays] + np.uint64(1)) & self.mask

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return mixed(keys) & self.mask

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each wanted key, -1 if it is not there."""
        out = np.full(len(wanted), -1, np.int32)
        left, at = np.arange(len(wanted)), self._first(wanted)
        while len(left):
            found = self.slots[at]
            hit = found >= 0
            left, at, found = left[hit], at[hit], found[hit]
            same = self.keys[found] == wanted[left]
            out[left[same]] = found[same]
            left, at = left[~same], (at[~same] + np.uint64(1)) & self.mask
        return out


@dataclass
class Model:
    """Frozen statistics of all languages, by key: a tagged context, with or without a byte. The
    last row of each table is for keys that are not there."""

    languages: list[str]
    order: int
    symbols: np.ndarray
    symbol_bits: np.ndarray  # infinite where the language never saw it
    contexts: np.ndarray
    escape_bits: np.ndarray  # 0 where the language has no such context

    def __post_init__(self) -> None:
        self.find_symbol, self.find_context = Lookup(self.symbols), Lookup(self.contexts)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("find_")}

    def __setstate__(self, own: dict) -> None:
        self.__dict__.update(own)
        self.__post_init__()

    def window_bits(self, keys: np.ndarray) -> np.ndarray:
        """For each window the code length of its byte in each language."""
        cost = np.zeros((len(keys), len(self.languages)))
        open_ = np.ones(cost.shape, bool)
        left, reach = np.arange(len(keys)), keys >> _TAG
        for order in range(self.order, -1, -1):
            can = reach[left] >= order
            rows = left[can]
            context = _context(keys[rows], order)
            bits = self.symbol_bits[self.find_symbol(_with_byte(context, keys[rows]))]
            known = np.isfinite(bits)
            escape = self.escape_bits[self.find_context(context)]
            own = open_[rows]
            cost[rows] += np.where(own, np.where(known, bits, escape), 0)
            own &= ~known
            open_[rows] = own
            left = np.concatenate([left[~can], rows[own.any(1)]])
        return cost + 8.0 * open_

    def code_lengths(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """For each text its code length in each language, and its number of coded bytes."""
        streams = [stream(x) for x in texts]
        total = np.zeros((len(streams), len(self.languages)))
        for key, owner in windows(streams, self.order):
            distinct, back = np.unique(key, return_inverse=True)
            bits = self.window_bits(distinct)
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(owner, bits[back, k], len(streams))
        return total, np.array([max(0, len(x) - 1) for x in streams], np.int64)

    def predict(self, texts) -> list[tuple[str, float, float]]:
        """For each text (language, probability among the learned languages, bits for each coded byte)."""
        out = []
        for total, size in zip(*self.code_lengths(texts), strict=True):
            if not size or not self.languages:
                out.append((UNDETERMINED, 0.0, 0.0))
                continue
            best = int(total.argmin())
            share = 1 / np.exp2(np.maximum(total[best] - total, -1000.0)).sum()
            out.append((self.languages[best], float(share), float(total[best] / size)))
        return out


def _counted(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct windows of texts, and how often each is there."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0)
    for key, _ in windows([x for x in map(stream, texts) if x], order):
        new, times = np.unique(key, return_counts=True)
        keys, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([counts, times]), len(keys))
    return keys, counts


def train(texts: dict[str, list[str]], order: int = ORDER) -> Model:
    """Counts the contexts of each language's texts. Languages in order of their names."""
    languages = sorted(texts)
    found = []
    for language in languages:
        seen, times = _counted(texts[language], order)
        symbols, weights = [], []
        for k in range(order + 1):
            there = seen >> _TAG >= k
            symbols.append(_with_byte(_context(seen[there], k), seen[there]))
            weights.append(times[there])
        keys, back = np.unique(np.concatenate(symbols), return_inverse=True)
        count = np.bincount(back, np.concatenate(weights), len(keys))
        context = (keys >> _TAG << _TAG) | ((keys & _LOW) >> np.uint64(8))
        contexts, of = np.unique(context, return_inverse=True)
        distinct = np.bincount(of, minlength=len(contexts))
        total = np.bincount(of, count, len(contexts)) + distinct
        found.append((keys, np.log2(total[of]) - np.log2(count), contexts, np.log2(total) - np.log2(distinct)))
    empty = np.zeros(0, np.uint64)
    symbols = np.unique(np.concatenate([empty, *(x[0] for x in found)]))
    contexts = np.unique(np.concatenate([empty, *(x[2] for x in found)]))
    symbol_bits, escape_bits = np.full((len(symbols) + 1, len(languages)), np.inf, np.float32), np.zeros((len(contexts) + 1, len(languages)), np.float32)
    for k, (own, bits, own_contexts, escapes) in enumerate(found):
        symbol_bits[np.searchsorted(symbols, own), k] = bits
        escape_bits[np.searchsorted(contexts, own_contexts), k] = escapes
    return Model(languages, order, symbols, symbol_bits, contexts, escape_bits)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_texts(docs: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """Texts of each language from docs(doc_id, text, lang): at most ``per_language`` documents of
    each language and ``sample`` in all, by the hash of doc_id, none held out, none with a null in
    one of the three, and no more than ``chars`` characters. Of rows that share doc_id and lang one
    text is taken, and none that is longer than a 64th of ``chars``."""
    known = docs.where("doc_id is not null and lang is not null").where(~held_out(F.col("doc_id"))).select("doc_id", "lang")
    ids = sampled_by(known.distinct(), "lang", per_language, sample, LANGUAGES, "doc_id")
    rows = learnable(docs, chars).select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    texts: dict[str, list[str]] = {}
    for r in taken(rows, chars, "doc_id", "lang"):
        texts.setdefault(r.lang, []).append(r.text)
    return texts


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Model:
    """Statistics from the training texts of ``docs``."""
    return train(training_texts(docs, per_language, sample))


def most_bits(texts: dict[str, list[str]], order: int = ORDER) -> dict[str, float]:
    """For each language the bits a byte above which a text is taken to be in no learned one.

    Texts are coded by what the other half of them taught, since a model knows its own texts too
    well. The bound is ``FAR`` times the median of a language's texts, which texts with other
    things in them don't move; a language that no text was found to be in has none.
    """
    found: dict[str, list[float]] = {}
    for k in (0, 1):
        half = train({language: own[k::2] for language, own in texts.items()}, order)
        for own in texts.values():
            for language, _, bits in half.predict(own[1 - k :: 2]):
                if language != UNDETERMINED:
                    found.setdefault(language, []).append(bits)
    return {language: FAR * float(np.median(bits)) for language, bits in sorted(found.items())}


def predict(text: Column, model: Model) -> Column:
    """struct(lang_pred, score, bits) of each whole text: `und`, 0, 0 for null, for a text without
    letters, and if no language was learned; ``bits`` is the code length for each coded byte."""

    @F.pandas_udf("lang_pred string, score double, bits double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        forget()
        for batch in texts:
            yield pd.DataFrame(model.predict(batch), columns=["lang_pred", "score", "bits"])

    return of(text)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits for every row of docs(doc_id, text, lang)."""
    guessed = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text"), learn(docs)).alias("p"))
    return guessed.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.bits")


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language."""
    bound_batches(spark)
    return identify(table(spark, sf_dir, "documents"))
