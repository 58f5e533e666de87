"""Column expressions over texts. Everything here stays inside Catalyst."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusieve.functions.arrays import once, sums_before

#: What counts as part of a word: letters, digits and the underscore, of any script.
WORD = r"[\p{L}\p{N}_]"
WORDS = WORD + "+"
#: Characters before and after a hit that its snippet shows.
CONTEXT = 90


def quoted(s: str) -> str:
    """``s`` as a pattern that matches just itself, in Java's and RE2's dialect."""
    return re.sub(r"([^\w\s])", r"\\\1", s, flags=re.ASCII) if s.isascii() else "".join("\\" + c if c.isascii() and not (c.isalnum() or c == "_" or c.isspace()) else c for c in s)


def word_tokens(s: str) -> list[str]:
    return re.findall(r"\w+", s)


def literal_pattern(keyword: str) -> str | None:
    """A whole-word pattern of a keyword or phrase, any white space between its words; None if it
    has no word."""
    tokens = word_tokens(keyword)
    if not tokens:
        return None
    return rf"(?iu)(?<!{WORD})" + r"\s+".join(quoted(t) for t in tokens) + rf"(?!{WORD})"


def glob_pattern(glob: str) -> str:
    """An anchored pattern of a shell-style glob with * ? and [seq], [!seq]."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = end
        else:
            out.append(quoted(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def words(text: Column) -> Column:
    return matches(text, WORDS)


#: Code points that no text has; where one does, another of its kind stands in while offsets are found.
_OPEN, _CLOSE, _OTHER = "\ufdd0", "\ufdd1", "\ufdd2"


def located(text: Column, pattern: str) -> Column:
    """All matches that are not empty, as structs of start (from 0, in code points) and match.

    One pass puts a mark on both sides of every match, empty ones too; starts are what the pieces
    between the marks add up to.
    """
    marked = F.regexp_replace(F.translate(text, _OPEN + _CLOSE, _OTHER * 2), pattern, f"{_OPEN}$0{_CLOSE}")

    def of(pieces: Column) -> Column:
        sizes = F.transform(pieces, lambda p, k: F.length(p) - F.when(k == 0, 0).otherwise(1))
        both = F.zip_with(pieces, sums_before(sizes), lambda p, at: F.struct(at.alias("start"), F.substring_index(p, _CLOSE, 1).alias("match")))
        return F.filter(F.slice(both, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda m: m["match"] != "")

    return once(F.split(marked, _OPEN, -1), of)


def snippet(text: Column, start: Column, size: Column, context: int = CONTEXT) -> Column:
    left = F.greatest(F.lit(0), start - context)
    return F.substring(text, left + 1, start + size + context - left)


def sentences(text: Column) -> Column:
    """Non-empty stripped pieces between line ends, full stops, question and exclamation marks."""
    pieces = F.transform(F.split(text, r"[\n.?!]+", -1), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(pieces, lambda s: s != "")


def chunks(text: Column, size: int, overlap: int) -> Column:
    """Overlapping slices as structs of index, start, end (offsets from 0) and text; none of an
    empty text. The last one ends with the text."""
    n, step = F.length(text), size - overlap
    count = F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil((n - overlap) / step).cast("int")))
    index = F.when(count == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), count - 1))
    return F.transform(index, lambda i: F.struct(i.alias("chunk_index"), (i * step).alias("start"), F.least(n, i * step + size).alias("end"), F.substring(text, i * step + 1, F.lit(size)).alias("text")))


def word_count(text: Column) -> Column:
    """Pieces between white space, page marks aside; 1 at least."""
    pieces = F.filter(F.split(F.replace(text, F.lit("[PAGE"), F.lit(" ")), r"\s+", -1), lambda w: w != "")
    return F.greatest(F.lit(1), F.size(pieces))


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def pages(text: Column) -> Column:
    """The text by page, as structs of page_no (null before the first mark, and where it is no
    number of 32 bits) and text; a mark is [PAGE n], of any case."""
    mark = r"(?i)\[PAGE\s+(\d+)\]"
    numbers = F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(text, F.lit(mark), F.lit(1)))
    return F.zip_with(numbers, F.split(text, mark, -1), lambda n, t: F.struct(n.try_cast("int").alias("page_no"), t.alias("text")))


def marked_pages(text: Column) -> Column:
    """As ``pages``, for marks that have a line of their own; what is before the first is dropped, and
    so are pages whose number has more than 32 bits."""
    mark = r"(?m)^\s*\[PAGE (\d+)\]\s*$"
    numbers = F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(text, F.lit(mark), F.lit(1)))
    both = F.zip_with(numbers, F.split(text, mark, -1), lambda n, t: F.struct(n.try_cast("int").alias("page_no"), t.alias("text")))
    return F.filter(both, lambda p: p["page_no"].isNotNull())


def safe_filename(name: Column, longest: int = 160) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"^\s+|\s+$", ""), r"[\\/:*?\"<>|]+", "_"), r"\s+", " ")
    s = F.when(s == "", F.lit("file")).otherwise(s)
    return F.when(F.length(s) > longest, F.regexp_replace(F.substring(s, 1, longest), r"\s+$", "")).otherwise(s)


def html_escape(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


#: Letters with marks and what search takes them for (fixed values).
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"


def search_terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits without marks: what the search index holds."""
    return matches(F.translate(F.lower(text), MARKED, PLAIN), r"[\p{L}\p{N}]+")
