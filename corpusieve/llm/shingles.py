"""Sets of word shingles as 64-bit hashes, and one-permutation MinHash over them.

Words are what white space parts in the lower-cased text. A text of fewer words than a shingle
takes has one shingle, of all its words; a text without words has none.
"""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
SIMILARITY = 0.8
_TOP = np.uint64((1 << 64) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def odd_numbers(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit integers, the same for the same seed everywhere."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


#: What each byte of a word is multiplied by, from its first; they come again in longer words.
_FACTORS = odd_numbers(5, 4096)
#: Bytes whose words are hashed together.
_BYTES = 1 << 18


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word in order: the sum of its bytes, each times the number of its place, mixed
    with its length."""
    joined = " ".join((text or "").lower().split())
    if not joined:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
    ends = np.append(np.flatnonzero(data == 32), len(data))
    starts = np.append(0, ends[:-1] + 1)
    sizes, sums = ends - starts, np.empty(len(ends), np.uint64)
    first = 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + _BYTES, "right")))
        begin, own = starts[first], starts[first:last] - starts[first]
        part = data[begin : ends[last - 1]]
        place = np.arange(len(part)) - np.repeat(own, sizes[first:last] + 1)[: len(part)]
        terms = (part.astype(np.uint64) + np.uint64(1)) * _FACTORS[place & (len(_FACTORS) - 1)]
        terms[own[1:] - 1] = 0  # spaces
        sums[first:last] = np.add.reduceat(terms, own)
        first = last
    return mixed(sums + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Shingler:
    """text -> hashes of its shingles in order, repeats kept."""

    def __init__(self, words: int = WORDS) -> None:
        self.words = words
        self.factors = odd_numbers(words, words)

    def __call__(self, text: str | None) -> np.ndarray:
        hashes, n = word_hashes(text), self.words
        count = len(hashes) - n + 1
        if not len(hashes):
            return hashes
        if count < 1:
            return mixed(np.array([xxhash.xxh3_64_intdigest(hashes.tobytes())], np.uint64))
        total = hashes[:count] * self.factors[0]
        for k in range(1, n):
            total += hashes[k : count + k] * self.factors[k]
        return mixed(total)


class OnePermutation:
    """The least hash of each of ``bins`` bins; an empty bin borrows from the first filled one
    among bins drawn for it, the same draws for every set (optimal densification)."""

    def __init__(self, bins: int) -> None:
        if bins & (bins - 1):
            raise ValueError("the number of bins must be a power of two")
        self.bins, self.shift = bins, np.uint64(64 - bins.bit_length() + 1)
        self.draws = [self._draw(0, 16), self._draw(16, 256), self._draw(256, 4096)]

    def _draw(self, first: int, end: int) -> np.ndarray:
        at = np.arange(self.bins, dtype=np.uint64)[:, None] << np.uint64(32) | np.arange(first, end, dtype=np.uint64)
        return (mixed(at + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.bins)).astype(np.int16)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        """``bins`` hashes, for a set with at least one shingle."""
        least = np.full(self.bins, _TOP)
        np.minimum.at(least, (shingles >> self.shift).astype(np.int64), shingles)
        filled = least != _TOP
        empty = np.flatnonzero(~filled)
        if len(empty):
            source = np.arange(self.bins)
            for draws in self.draws:
                drawn = draws[empty]
                hit = filled[drawn]
                first = hit.argmax(1)
                found = hit[np.arange(len(empty)), first]
                source[empty[found]] = drawn[np.arange(len(empty)), first][found]
                empty = empty[~found]
                if not len(empty):
                    break
            else:  # next filled bin to the right, in a circle
                there = np.flatnonzero(filled)
                source[empty] = there[np.searchsorted(there, empty) % len(there)]
            least = least[source]
        return least
