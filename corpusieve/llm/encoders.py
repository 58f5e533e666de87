"""Token ids of whole texts, remembered by space-separated chunk.

The pattern that byte-level vocabularies split texts by never joins two non-space runs. Where
two of them are parted by exactly one space, the text can be cut before that space and each
side split on its own: the second starts with " ". So a text is cut at its single spaces, ids are
looked up by chunk, and only a new chunk is split and encoded. A chunk is cut again at single line
ends, which are matches by themselves, and where marks follow letters. Other runs of white space stay
inside one chunk, with the words on both sides.
"""

from __future__ import annotations

import itertools
import string
import struct
from collections.abc import Callable

import numpy as np
import public_tokenizers
import regex

from corpusieve.llm.words import only

_SPLIT = regex.compile(public_tokenizers.PATTERN)
#: Characters below this have had their letter class since long before any library's tables.
_SETTLED = "ɐ"
_LONGEST = 48
#: Chunks whose ids are remembered in a worker at most: about 190 MB.
REMEMBERED = 800_000


def pretokens(text: str) -> list[str]:
    return _SPLIT.findall(text)


class _Memo(dict):
    """What ``compute`` gives for a key, kept for short keys that have no line end: ``limit`` of them at
    most, in two halves. When the newer one is full, the older is dropped, and of its keys those that
    were asked for meanwhile are in the newer."""

    def __init__(self, compute: Callable[[str], bytes | None], limit: int) -> None:
        super().__init__()
        self.compute, self.half, self.older = compute, max(1, limit // 2), {}

    def __missing__(self, key: str) -> bytes | None:
        found = self.older.get(key)
        if found is None:
            found = self.compute(key)
        if len(key) <= _LONGEST and "\n" not in key:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class ChunkEncoder:
    """``encode_pretoken`` gives the ids of one match of the pattern, as bytes of little-endian
    unsigned 32-bit integers, ``encode_word`` those of ASCII letters after a space; calling this object
    gives those of a whole text."""

    def __init__(self, encode_pretoken: Callable[[str], bytes], encode_word: Callable[[str], bytes] | None = None, limit: int = REMEMBERED) -> None:
        self.encode = encode_pretoken
        self.word = encode_word or (lambda word: encode_pretoken(" " + word))
        self.chunk = _Memo(self._chunk, limit)
        self.bare = _Memo(self._bare, limit // 4)
        self.pretoken = _Memo(encode_pretoken, limit // 4)  # matches that are not a whole word after a space
        self.line_end = encode_pretoken("\n")

    def _chunk(self, chunk: str) -> bytes | None:
        """Ids of " " + chunk; None if its white space may belong to a neighbour's run. Letters and marks
        after them are two matches, which need no pattern."""
        if chunk.isalpha() and chunk.isascii():
            return self.word(chunk)
        core = chunk.rstrip(string.punctuation)
        if core.isalpha() and (core.isascii() or max(core) < _SETTLED):
            return self.chunk[core] + self.pretoken[chunk[len(core) :]] if len(core) < len(chunk) else self.encode(" " + chunk)
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return None
        if "\n" in chunk:
            # a line end between two other characters is a match by itself, and what follows has no space before it
            first, *rest = chunk.split("\n")
            if all(p and not p[0].isspace() and not p[-1].isspace() for p in (first, *rest)):
                return self.chunk[first] + b"".join([self.line_end + self.bare[p] for p in rest])
        return self._plain(" " + chunk)

    def _bare(self, part: str) -> bytes:
        """Ids of a part with neither a space before it nor white space at its ends."""
        core = part.rstrip(string.punctuation)
        if core.isalpha() and (core.isascii() or max(core) < _SETTLED):
            return self.bare[core] + self.pretoken[part[len(core) :]] if len(core) < len(part) else self.encode(part)
        return self._plain(part)

    def _plain(self, text: str) -> bytes:
        return b"".join([self.pretoken[x] for x in pretokens(text)])

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        parts = text.split(" ")
        if not parts[0] or parts[0][-1].isspace():
            return self._uneven(parts)
        found = list(map(self.chunk.__getitem__, itertools.islice(parts, 1, None)))
        if None in found:
            return self._uneven(parts)
        return self._plain(parts[0]) + b"".join(found)

    def _uneven(self, parts: list[str]) -> bytes:
        """A text in which some white space is not one space: parts that touch it stay together."""
        out, held = [], [parts[0]]
        for i in range(1, len(parts)):
            part, before = parts[i], parts[i - 1]
            if before and part and not before[-1].isspace() and not part[0].isspace():
                out.append(self._held(held, not out))
                held = [part]
            else:
                held.append(part)
        out.append(self._held(held, not out))
        return b"".join(out)

    def _held(self, held: list[str], first: bool) -> bytes:
        if len(held) == 1 and not first and not held[0][-1].isspace():
            return self.chunk[held[0]]
        return self._plain(("" if first else " ") + " ".join(held))


_BYTE_RUNS = ((33, 127), (161, 173), (174, 256))


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabulary files: bytes of the printable
    runs stand for themselves, the others for the code points from 256 on, in order."""
    plain = [b for a, z in _BYTE_RUNS for b in range(a, z)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class LibraryEncoder:
    """text -> ids as the tokenizers library's ``encode(text, add_special_tokens=False)`` gives them, as
    bytes of little-endian unsigned 32-bit integers.

    The model is asked for single pretokens, as the library's own byte-level step would hand them
    over. A text that holds the string of an added token, and every text if the file has a
    normalizer or another kind of pretokens, goes to the library whole: so such a string gets its own
    id, as the library's default has it.
    """

    def __init__(self, path: str, limit: int = REMEMBERED) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        steps = self.whole.pre_tokenizer
        self.plain = self.whole.normalizer is None and type(steps).__name__ == "ByteLevel" and not steps.add_prefix_space and steps.use_regex
        ask, letters = self.whole.model.tokenize, byte_letters()
        space, packed = letters[32], [struct.pack("<I", k) for k in range(self.whole.get_vocab_size())]

        def encode(pretoken: str) -> bytes:
            return b"".join([packed[t.id] for t in ask(pretoken.encode().decode("latin-1").translate(letters))])

        def encode_word(word: str) -> bytes:  # bytes of ASCII letters stand for themselves
            return b"".join([packed[t.id] for t in ask(space + word)])

        self.chunks = ChunkEncoder(encode, encode_word, limit)

    def __call__(self, text: str | None) -> bytes:
        if text and (not self.plain or any(map(text.__contains__, self.added))):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.chunks(text)


def library_encoder(path: str, limit: int = REMEMBERED) -> LibraryEncoder:
    """The encoder of the file ``path``, which a worker process keeps between tasks."""
    return only(("library", path, limit), lambda: LibraryEncoder(path, limit))
