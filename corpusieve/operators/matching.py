"""Keyword, wildcard, regex, boolean, fuzzy and semantic matching of documents.

All patterns of a pack are folded into one projection, so documents are read once and nothing is
shuffled until hits, which are small, are deduplicated or capped by document. A few literals are searched
for one by one; a larger pack of them is looked up word by word (``pack``), at hardly more cost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusieve.functions.arrays import once
from corpusieve.functions.text import chunks, located, matches, sentences, snippet, word_tokens
from corpusieve.functions.vectors import cosine, norm
from corpusieve.operators import pack
from corpusieve.operators.pairs import met
from corpusieve.plans import boolean
from corpusieve.plans.patterns import Pattern

#: After this many hits of a document each further literal or regex adds one at most.
SOFT_CAP = 200
FUZZY_LEAST, FUZZY_SNIPPET = 0.92, 350
_NONE = "array<struct<method:string,pattern:string,pattern_order:int,hit:int,start:int,score:double,snippet:string>>"
_WILD_WORDS = r"(?U)\b[\w\-']+\b"
#: Literals and globs that are searched for one by one at most.
ONE_BY_ONE = 12


def _hits_of(pattern: Pattern, text: Column, with_snippet: bool) -> Column:
    """All hits of one pattern as an array of structs."""
    found = located(text, _WILD_WORDS if pattern.method == "wildcard" else pattern.java)
    if pattern.method == "wildcard":
        found = F.filter(found, lambda x: F.lower(x["match"]).rlike(pattern.java))
    return _shown(pattern, F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.length(x["match"]).alias("size"))), text, with_snippet)


def _snippet(text: Column, with_snippet: bool) -> Callable[[Column], Column]:
    return (lambda x: snippet(text, x["start"], x["size"])) if with_snippet else (lambda x: F.lit(None).cast("string"))


def _shown(pattern: Pattern, sized: Column, text: Column, with_snippet: bool) -> Column:
    show = _snippet(text, with_snippet)
    return F.transform(
        sized,
        lambda x, i: F.struct(F.lit(pattern.method).alias("method"), F.lit(pattern.source).alias("pattern"), F.lit(pattern.order).alias("pattern_order"), i.alias("hit"), x["start"].alias("start"), F.lit(1.0).alias("score"), show(x).alias("snippet")),
    )


def _together(patterns: list[Pattern]) -> tuple[list[Pattern], list[Pattern], list[Pattern]]:
    """Literals and globs that are looked up together, and patterns that are searched for one by one."""
    kinds = [[p for p in patterns if p.method == m] for m in ("keyword", "wildcard")]
    literals, globs = (own if len(own) > ONE_BY_ONE else [] for own in kinds)
    taken = {*literals, *globs}
    return literals, globs, [p for p in patterns if p not in taken]


def _glob_hits(globs: list[Pattern], text: Column) -> Column:
    """For each glob, in order, its hits: words are cut once, and those that no glob takes dropped by one
    test."""
    any_of = pack.may_be_glob(globs)
    words = F.filter(F.transform(located(text, _WILD_WORDS), lambda x: F.struct(F.lower(x["match"]).alias("w"), x["start"].alias("start"), F.length(x["match"]).alias("size"))), lambda x: x["w"].rlike(any_of))
    return once(words, lambda own: F.array(*[F.filter(own, _taken_by(g)) for g in globs]))


def _taken_by(glob: Pattern) -> Callable[[Column], Column]:
    return lambda x: x["w"].rlike(glob.java)


#: Columns that a pass over texts leaves beside those of the documents.
_LITERALS, _GLOBS = "_pack_literals", "_pack_globs"


def hits(docs: DataFrame, patterns: list[Pattern], with_snippet: bool = True) -> DataFrame:
    """doc_id, method, pattern, pattern_order, hit, start, score and snippet of every hit.

    Offsets and snippets are worked out only for texts that a pattern is in.
    """
    if not patterns:
        raise ValueError("the pack has no usable pattern")
    text, show = F.coalesce(F.col("text"), F.lit("")), _snippet(F.coalesce(F.col("text"), F.lit("")), with_snippet)
    literals, globs, rest = _together(patterns)
    own, arrays = docs, []
    if literals:
        own = own.withColumn(_LITERALS, pack.literal_hits(text, literals))
        zipped = F.arrays_zip(*[F.col(f"{_LITERALS}.{c}").alias(c) for c in ("o", "pattern", "hit", "start", "size")])
        arrays.append(F.transform(zipped, lambda x: F.struct(F.lit("keyword").alias("method"), x["pattern"], x["o"].alias("pattern_order"), x["hit"], x["start"], F.lit(1.0).alias("score"), show(x).alias("snippet"))))
    if globs:
        own = own.withColumn(_GLOBS, _glob_hits(globs, text))
        arrays += [_shown(p, F.get(F.col(_GLOBS), k), text, with_snippet) for k, p in enumerate(globs)]
    for p in rest:
        found = _hits_of(p, text, with_snippet)
        arrays.append(found if p.method == "wildcard" else F.when(text.rlike(p.java), found).otherwise(F.array().cast(_NONE)))
    return own.select("doc_id", F.inline(F.concat(*[a.cast(_NONE) for a in arrays])))


def hit_counts(docs: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """doc_id, pattern and n_hits where there are any: no offsets, so one scan and no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    literals, globs, rest = _together(patterns)
    own, kind, arrays = docs, "array<struct<pattern:string,n_hits:long>>", []
    if literals:
        own = own.withColumn(_LITERALS, pack.literal_counts(text, literals))
        arrays.append(F.arrays_zip(*[F.col(f"{_LITERALS}.{c}").alias(c) for c in ("pattern", "n_hits")]))

    def count(p: Pattern) -> Column:
        if p.method == "wildcard":
            return F.size(F.filter(words, _matches(p)))
        return F.regexp_count(text, F.lit(p.java))

    words = matches(F.lower(text), _WILD_WORDS)
    if globs:
        own = own.withColumn(_GLOBS, F.filter(words, lambda w: w.rlike(pack.may_be_glob(globs))))
        words, rest = F.col(_GLOBS), [*globs, *rest]
    if rest:
        rows = F.array(*[F.struct(F.lit(p.source).alias("pattern"), count(p).cast("long").alias("n_hits")) for p in rest])
        arrays.append(F.filter(rows, lambda r: r["n_hits"] > 0))
    return own.select("doc_id", F.inline(F.concat(*[a.cast(kind) for a in arrays])))


def _matches(glob: Pattern) -> Callable[[Column], Column]:
    return lambda w: w.rlike(glob.java)


def capped(found: DataFrame) -> DataFrame:
    """Hits within the soft cap of each document: the first SOFT_CAP + 1 in order of pattern and
    place, then the first of each further pattern; wildcard hits are never cut."""
    order = Window.partitionBy("doc_id").orderBy("pattern_order", "hit")
    running = F.row_number().over(order)
    return found.withColumn("_n", running).where((F.col("_n") <= SOFT_CAP + 1) | (F.col("hit") == 0) | (F.col("method") == "wildcard")).drop("_n")


def deduplicated(found: DataFrame) -> DataFrame:
    """One hit for each document, method, pattern and snippet: the best, of equals the first."""
    first = Window.partitionBy("doc_id", "method", "pattern", "snippet").orderBy(F.desc("score"), "pattern_order", "hit")
    return found.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def boolean_hits(docs: DataFrame, query: str) -> DataFrame:
    """doc_id and snippet (the query as it was understood) of documents that match."""
    try:
        shown = boolean.parse(query).text
    except boolean.QueryError:
        shown = ""
    return docs.where(boolean.compiled(query, F.col("text"))).select("doc_id", F.lit("query").alias("method"), F.lit(query).alias("pattern"), F.lit(1.0).alias("score"), F.lit(shown).alias("snippet"))


# -- fuzzy


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        match = row & masks.get(c, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def _likeness(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * _common(a, b) / total if total else 100.0


def token_set_ratio(a: str, b: str) -> float:
    """0 to 100: how alike two strings are as sets of words. 100 if the words of one are all in the
    other; otherwise the best likeness among the shared words alone, and with each side's rest."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared, only_x, only_y = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if shared and (not only_x or not only_y):
        return 100.0
    whole_x, whole_y = (shared + " " + only_x).strip(), (shared + " " + only_y).strip()
    best = _likeness(whole_x, whole_y)
    if shared:
        best = max(best, _likeness(shared, whole_x), _likeness(shared, whole_y))
    return best


def fuzzy_keywords(keywords: list[str], most: int | None = None) -> list[str]:
    """Literals that fuzzy matching takes: two words and eight characters at least; with ``most`` only such
    among the first so many keywords."""
    return [k for k in keywords[:most] if len(word_tokens(k)) > 1 and len(k.strip()) >= 8]


#: White space as Python's split sees it.
_SPACE = r"(?U)[\s\x1c-\x1f]+"


def _joined_length(words: Column) -> Column:
    """Characters of the words with a space between each two."""
    return F.aggregate(words, F.size(words) - 1, lambda n, w: n + F.length(w))


def _with_words(sentence: Column) -> Column:
    """A sentence as s, its distinct lower-cased words and their length."""
    return once(F.array_distinct(F.split(F.lower(sentence), _SPACE, -1)), lambda w: F.struct(sentence.alias("s"), w.alias("words"), _joined_length(w).alias("n")))


def _may_be_like(x: Column, keyword: str, least: float) -> Column:
    """Whether a sentence's likeness to the keyword can reach ``least``; never false where it does.

    All of one side's words on the other make a whole match. Otherwise two strings of a and b
    characters have a likeness of at most 2 min(a, b) / (a + b); this is tried for both sides whole, and
    for the shared words against each.
    """
    own = list(dict.fromkeys(keyword.lower().split()))
    a, words = len(" ".join(own)), F.array(*[F.lit(w) for w in own])
    near = lambda m, n: 2 * F.least(m, n) >= least * (m + n) - 1e-9

    def by_words(shared: Column) -> Column:
        s = _joined_length(shared)
        whole = (F.size(shared) == len(own)) | (F.size(shared) == F.size(x["words"]))
        return (F.size(shared) > 0) & (whole | near(s, F.lit(a)) | near(s, x["n"]))

    return near(F.lit(a), x["n"]) | once(F.array_intersect(words, x["words"]), by_words)


def _like(every: Column, keyword: str, least: float) -> Column:
    return F.transform(F.filter(every, lambda x: _may_be_like(x, keyword, least)), lambda x: x["s"])


def fuzzy_hits(docs: DataFrame, keywords: list[str], least: float = FUZZY_LEAST) -> DataFrame:
    """doc_id, pattern, score and snippet: for each keyword a document's best sentence, if it is
    good enough. Of equally good sentences the first counts.

    Sentences that can't be good enough, by their length and the words that they share with a keyword,
    are dropped before Python; most documents have none left and never get there.
    """
    wanted = fuzzy_keywords(keywords)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, pattern string, score double, snippet string"
    if not wanted:
        return docs.sparkSession.createDataFrame([], schema)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lowered = [(k.lower(), set(k.lower().split())) for k in wanted]
        for batch in batches:
            rows = []
            for doc_id, found in zip(batch["doc_id"], batch["found"], strict=True):
                for keyword, (low, own), pieces in zip(wanted, lowered, found, strict=True):
                    best, shown = 0.0, ""
                    for s in pieces:
                        low_s = s.lower()
                        score = 100.0 if own <= set(low_s.split()) else token_set_ratio(low, low_s)
                        if score > best:
                            best, shown = score, s
                            if best == 100.0:
                                break
                    if best / 100.0 >= least:
                        rows.append((doc_id, keyword, best / 100.0, shown[:FUZZY_SNIPPET]))
            yield pd.DataFrame(rows, columns=["doc_id", "pattern", "score", "snippet"])

    own = docs.select("doc_id", once(F.transform(sentences(F.coalesce("text", F.lit(""))), _with_words), lambda every: F.array(*[_like(every, k, least) for k in wanted])).alias("found"))
    return own.where(F.exists("found", lambda x: F.size(x) > 0)).mapInPandas(task, schema)


def fuzzy_subset_hits(docs: DataFrame, keywords: list[str]) -> DataFrame:
    """The fuzzy hits with score 1: some sentence has all words of the keyword. No Python."""
    sets = F.transform(sentences(F.coalesce("text", F.lit(""))), lambda s: F.split(F.lower(s), r"\s+", -1))
    own = docs.select("doc_id", sets.alias("sets"))

    def has_all(keyword: str) -> Column:
        wanted = F.array(*[F.lit(w) for w in dict.fromkeys(keyword.lower().split())])
        return F.exists("sets", lambda s: F.size(F.array_except(wanted, s)) == 0)

    tests = [F.struct(F.lit(k).alias("pattern"), has_all(k).alias("ok")) for k in fuzzy_keywords(keywords)]
    return own.select("doc_id", F.explode(F.array(*tests)).alias("t")).where("t.ok").select("doc_id", "t.pattern", F.lit(1.0).alias("score"))


# -- semantic


def chunk_rows(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """doc_id, chunk_index, start, end and text of every chunk."""
    return docs.select("doc_id", F.inline(chunks(F.coalesce("text", F.lit("")), size, overlap)))


def semantic_hits(keywords: DataFrame, rows: DataFrame, least: float = 0.62, top: int = 30) -> DataFrame:
    """row_id, keyword_id and score: for each chunk its nearest keywords, ``top`` at most, with
    cosine ``least`` or more. ``keywords``(keyword_id, k) is a pack."""
    k = keywords.select("keyword_id", "k", norm(F.col("k")).alias("k_norm"))
    both = met(k, rows.select("row_id", "v", norm(F.col("v")).alias("v_norm")))
    scored = both.select("row_id", "keyword_id", cosine(F.col("k"), F.col("k_norm"), F.col("v"), F.col("v_norm")).alias("score")).where(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc("score"), "keyword_id"))
    return scored.withColumn("_n", rank).where(F.col("_n") <= top).drop("_n")


def top_by_cosine(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """query_id, rank, row_id, similarity: the k rows(row_id, v, v_norm) nearest to each of the
    queries(query_id, q, q_norm); each task keeps its own best before anything is shuffled by query."""
    both = met(queries, rows)
    scored = both.select("query_id", "row_id", cosine(F.col("q"), F.col("q_norm"), F.col("v"), F.col("v_norm")).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "row_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)
