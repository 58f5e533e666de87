"""The boolean query language, compiled into one Column.

    flight AND ("black book" OR memo) AND NOT draft        landing NEAR/5 strip

NOT binds closest, then AND and NEAR/n alike, then OR; operators of equal rank group to the left.
A term is a word or a quoted phrase. NEAR compares the places where two terms or phrases begin; it
counts words, and ``distance`` is meant to be a few dozen at most, since so many are looked at.
A query that can't be read matches nothing, as does one that names no word.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusieve.functions.arrays import once
from corpusieve.functions.text import WORDS, literal_pattern, word_tokens

#: How strongly operators between two operands bind.
_BINDS = {"OR": 1, "AND": 2, "NEAR": 2}


@dataclass(frozen=True)
class Node:
    """``kind`` is TERM, NOT, AND, OR or NEAR; ``text`` is how the node is written out."""

    kind: str
    text: str
    parts: tuple[Node, ...] = ()
    distance: int = 0


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class _Word:
    """A piece of a query: kind is (, ), AND, OR, NOT, NEAR or TERM."""

    kind: str
    text: str
    distance: int = 0


def _name_at_start(word: str) -> _Word | None:
    """The operator that a word begins with, if no letter, digit or underscore follows its name."""
    upper = word.upper()
    for kind in ("AND", "OR", "NOT", "NEAR"):
        if not upper.startswith(kind):
            continue
        end, distance = len(kind), 0
        if kind == "NEAR":
            digits = "".join(itertools.takewhile(str.isdecimal, word[end + 1 :]))
            if word[end : end + 1] != "/" or not digits:
                continue
            end, distance = end + 1 + len(digits), int(digits)
        after = word[end : end + 1]
        if not (after.isalnum() or after == "_"):
            return _Word(kind, word[:end], distance)
    return None


def _words(query: str) -> list[_Word]:
    out, at = [], 0
    while at < len(query):
        c = query[at]
        closing = query.find('"', at + 1) if c == '"' else -1
        if c.isspace():
            at += 1
            continue
        if c in "()":
            out.append(_Word(c, c))
        elif closing > at + 1:
            out.append(_Word("TERM", query[at : closing + 1]))
        else:
            word = "".join(itertools.takewhile(lambda x: not x.isspace() and x not in "()", query[at:]))
            out.append(_name_at_start(word) or _Word("TERM", word))
        at += len(out[-1].text)
    return out


class _Parser:
    """Reads operands and what stands between them, from stronger to weaker operators.

    Operands may stand side by side with nothing between them; then they make a row, of which an
    operator takes the nearest, and of a whole query the last one counts.
    """

    def __init__(self, words: list[_Word], strict: bool) -> None:
        self.words, self.at, self.strict = words, 0, strict

    def next_kind(self) -> str:
        return self.words[self.at].kind if self.at < len(self.words) else ""

    def query(self) -> Node:
        row = self.row(1, [])
        while self.next_kind() == ")":  # closes nothing: all before it counts as one group
            self.at += 1
            row = self.row(1, row)
        if not row:
            raise QueryError("empty query")
        return row[-1]

    def row(self, least: int, row: list[Node]) -> list[Node]:
        """``row`` and what follows, as long as operators bind at least so strongly."""
        while kind := self.next_kind():
            if kind in ("TERM", "(", "NOT"):
                row = [*row, *self.operands()]
            elif _BINDS.get(kind, 0) >= least:
                word = self.words[self.at]
                self.at += 1
                both = [*row, *self.row(_BINDS[kind] + 1, [])]
                if not row or len(both) == len(row):
                    raise QueryError(f"{word.text} lacks an operand")
                row = [*both[:-2], self.joined(word, both[-2], both[-1])]
            else:
                break
        return row

    def operands(self) -> list[Node]:
        word = self.words[self.at]
        self.at += 1
        if word.kind == "TERM":
            return [Node("TERM", word.text)]
        if word.kind == "(":
            inside = self.row(1, [])
            if self.next_kind() != ")":
                raise QueryError("unbalanced parentheses")
            self.at += 1
            return inside
        row: list[Node] = []
        while self.next_kind() in ("TERM", "("):
            row += self.operands()
        if not row:
            raise QueryError("NOT lacks an operand")
        return [*row[:-1], Node("NOT", f"NOT({row[-1].text})", (row[-1],))]

    def joined(self, word: _Word, left: Node, right: Node) -> Node:
        if word.kind != "NEAR":
            return Node(word.kind, f"({left.text} {word.kind} {right.text})", (left, right))
        if self.strict and not left.kind == right.kind == "TERM":
            raise QueryError("NEAR takes words and phrases")
        return Node("NEAR", f"{left.text} NEAR/{word.distance} {right.text}", (left, right), word.distance)


def parse(query: str, strict: bool = False) -> Node:
    """The query's tree. ``strict`` refuses NEAR on anything but terms; otherwise such an operand
    counts as the phrase that it is written as."""
    return _Parser(_words(query), strict).query()


def _phrase(term: str) -> list[str]:
    return word_tokens(term.strip().removeprefix('"').removesuffix('"') if term.startswith('"') and term.endswith('"') else term)


def _begins(words: Column, phrase: list[str], place: Column) -> Column:
    """Whether the phrase stands at a place (from 0) of an array of words."""
    ok = F.lit(True)
    for k, word in enumerate(phrase):
        ok = ok & (F.get(words, place + k) == word)
    return F.coalesce(ok, F.lit(False))


def near(tokens: Column, left: list[str], right: list[str], distance: int) -> Column:
    """Whether the two phrases begin within ``distance`` words of each other, in either order. Texts
    are cut into words once; around each place of the one phrase the other is looked for."""
    if not left or not right:
        return F.lit(False)

    def of(words: Column) -> Column:
        last, reach = F.size(words) - 1, min(distance, 1 << 30)
        places = F.filter(F.sequence(F.lit(0), last), lambda i: _begins(words, left, i))
        around = lambda i: F.sequence(F.greatest(F.lit(0), i - reach), F.least(last, i + reach))
        return F.when(last >= 0, F.exists(places, lambda i: F.exists(around(i), lambda j: _begins(words, right, j)))).otherwise(F.lit(False))

    return once(tokens, of)


def to_column(node: Node, text: Column) -> Column:
    if node.kind == "TERM":
        pattern = literal_pattern(" ".join(_phrase(node.text)))
        return text.rlike(pattern) if pattern else F.lit(False)
    if node.kind == "NEAR":
        left, right = (([w.lower() for w in _phrase(p.text)]) for p in node.parts)
        both = [literal_pattern(" ".join(x)) for x in (left, right)]
        tokens = F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))
        # cheap test first: words are only listed where both sides can be there
        screen = F.lit(all(both))
        for words in (left, right):
            for w in words:
                screen = screen & F.contains(F.lower(text), F.lit(w))
        return F.when(screen, near(tokens, left, right, node.distance)).otherwise(F.lit(False))
    parts = [to_column(p, text) for p in node.parts]
    if node.kind == "NOT":
        return ~parts[0]
    return parts[0] & parts[1] if node.kind == "AND" else parts[0] | parts[1]


def compiled(query: str, text: Column, strict: bool = False) -> Column:
    """Whether each text matches; false everywhere for a query that can't be read."""
    try:
        return to_column(parse(query, strict), F.coalesce(text, F.lit("")))
    except QueryError:
        if strict:
            raise
        return F.lit(False)
