"""A whole keyword pack in one pass over the words of a text.

Literals are compiled into a trie of folded words, the first word to what may follow it. A text is cut into
words once; each is folded and looked up, so a word that begins no keyword costs one probe of a dictionary,
however many keywords there are. Only where one begins are the words after it looked at, as far as the trie
goes on and white space stands between. Catalyst has no way to do that whose cost does not grow with the
pack (lambdas over words cost a hundred times as much), so it is an Arrow function over texts; no row is
exploded, joined or shuffled, and a worker holds the trie and one batch.

Globs are told by one alternation for each word first, and by one glob after the other only where it hits.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusieve.functions.text import word_tokens
from corpusieve.plans.patterns import Pattern

#: What separates the words of a phrase, as patterns have it.
_BETWEEN = " \t\n\x0b\f\r"
_WORD = re.compile(r"\w+")
_FOLDED_WORDS = 100_000


def folded(word: str) -> str:
    """Words that patterns take for one another, whatever their case, have equal folded forms: each letter
    goes to upper case and then to lower case, where that is one letter."""
    if word.isascii():
        return word.lower()
    out = []
    for c in word:
        upper = c.upper() if len(c.upper()) == 1 else c
        out.append("i" if upper == "İ" else upper.lower() if len(upper.lower()) == 1 else upper)
    return "".join(out)


class Trie:
    """text -> (order, start, size) of every match of a literal, by order and place. Matches of one
    literal do not overlap; the first one counts."""

    def __init__(self, patterns: list[Pattern]) -> None:
        self.root: dict = {}
        for p in patterns:
            node = self.root
            for word in word_tokens(p.source):
                node = node.setdefault(folded(word), {})
            node.setdefault(None, []).append(p.order)  # no word is None
        self._folds: dict[str, str] = {}

    def _fold(self, word: str) -> str:
        if (out := self._folds.get(word)) is None:
            if len(self._folds) >= _FOLDED_WORDS:
                self._folds.clear()
            out = self._folds[word] = folded(word)
        return out

    def __call__(self, text: str | None) -> list[tuple[int, int, int]]:
        if not text:
            return []
        words = _WORD.findall(text.lower()) if text.isascii() else [self._fold(w) for w in _WORD.findall(text)]
        root = self.root
        begins = [i for i, w in enumerate(words) if w in root]
        if not begins:
            return []
        spans = [m.span() for m in _WORD.finditer(text)]
        found, ends, n = [], {}, len(words)
        for i in begins:
            node, last = root[words[i]], i
            while node is not None:
                for order in node.get(None, ()):
                    start, end = spans[i][0], spans[last][1]
                    if start >= ends.get(order, 0):
                        ends[order] = end
                        found.append((order, start, end - start))
                last += 1
                if last == n or len(node) == (None in node) or text[spans[last - 1][1] : spans[last][0]].strip(_BETWEEN):
                    break
                node = node.get(words[last])
        found.sort()
        return found


def literal_hits(text: Column, patterns: list[Pattern]) -> Column:
    """struct of arrays o (order), pattern, hit (number from 0 among those of its pattern), start and size
    of all matches in a text."""

    @F.pandas_udf("o array<int>, pattern array<string>, hit array<int>, start array<int>, size array<int>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        find, names = Trie(patterns), {p.order: p.source for p in patterns}
        for batch in batches:
            rows = []
            for t in batch:
                found, numbers, before, k = find(t), [], None, 0
                for order, _, _ in found:
                    k = k + 1 if order == before else 0
                    numbers.append(k)
                    before = order
                rows.append(([x[0] for x in found], [names[x[0]] for x in found], numbers, [x[1] for x in found], [x[2] for x in found]))
            yield pd.DataFrame(rows, columns=["o", "pattern", "hit", "start", "size"], dtype=object)

    return of(text)


def literal_counts(text: Column, patterns: list[Pattern]) -> Column:
    """struct of arrays pattern and n_hits of the literals that a text has."""

    @F.pandas_udf("pattern array<string>, n_hits array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        find, names = Trie(patterns), {p.order: p.source for p in patterns}
        for batch in batches:
            rows = []
            for t in batch:
                times = Counter(order for order, _, _ in find(t))
                rows.append(([names[o] for o in times], list(times.values())))
            yield pd.DataFrame(rows, columns=["pattern", "n_hits"], dtype=object)

    return of(text)


def may_be_glob(globs: list[Pattern]) -> str:
    """One pattern of words that some glob takes."""
    return "(?s)" + "|".join(p.java.removeprefix("(?s)") for p in globs)
