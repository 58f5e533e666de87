"""Per-worker memo of what is known about a word, kept as rows of one numpy array.

Texts repeat their words, so an operator that needs a number (or a few) for each word computes
it once for each word that a worker meets, for all new words of a document together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

import numpy as np

T = TypeVar("T")
#: Words longer than this are computed each time: they rarely repeat and would fill the memo.
LONGEST = 64


_kept: dict[object, object] = {}


def only(name: object, make: Callable[[], T]) -> T:
    """What ``make`` gives under a name, kept in this process; what was kept under other names is
    dropped, so a worker that runs one operator after another holds what one of them remembers."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def forget() -> None:
    """Drops what ``only`` keeps: for tasks that need none of it."""
    _kept.clear()


class _Index(dict):
    """word -> row; a word that is not there yet gets the next row."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []
        self.next = 0

    def __missing__(self, word: str) -> int:
        row, self.next = self.next, self.next + 1
        self[word] = row
        self.new.append(word)
        return row


class WordTable:
    """Rows that ``compute(words)`` gives, an array of len(words) x width; at most about
    ``limit`` words are remembered, then the memo starts anew. Results never depend on it."""

    def __init__(self, compute: Callable[[list[str]], np.ndarray], limit: int = 300_000) -> None:
        self.compute, self.limit = compute, limit
        self._clear()

    def _clear(self) -> None:
        self.index = _Index()
        first = self.compute([])
        self.rows = np.zeros((1024, *first.shape[1:]), first.dtype)

    def __call__(self, words: list[str]) -> np.ndarray:
        if self.index.next > self.limit:
            self._clear()
        index = self.index
        at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        if index.new:
            new, index.new = index.new, []
            if index.next > len(self.rows):
                grown = np.zeros((max(index.next, 2 * len(self.rows)), *self.rows.shape[1:]), self.rows.dtype)
                grown[: len(self.rows)] = self.rows
                self.rows = grown
            self.rows[index.next - len(new) : index.next] = self.compute(new)
            for word in new:
                if len(word) > LONGEST:
                    del index[word]
        return self.rows[at]


def blocks(words: list[str], size: int = 1 << 16) -> Iterable[list[str]]:
    """The words in slices, so that arrays about them stay small however long the text is."""
    for k in range(0, len(words), size):
        yield words[k : k + size]


def text_rows(texts: Iterable[str | None], table: WordTable, size: int = 1 << 16) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the text, rows of some of its words in order), for all texts with a word. New
    words of many texts are computed together; only about ``size`` words are held at a time."""
    words: list[str] = []
    held: list[tuple[int, int]] = []

    def known() -> Iterator[tuple[int, np.ndarray]]:
        rows, at = table(words), 0
        for i, n in held:
            yield i, rows[at : at + n]
            at += n
        words.clear()
        held.clear()

    for i, text in enumerate(texts):
        for part in blocks((text or "").split(), size):
            words.extend(part)
            held.append((i, len(part)))
            if len(words) >= size:
                yield from known()
    yield from known()
