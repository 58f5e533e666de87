from __future__ import annotations

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusieve.functions import text as T
from corpusieve.operators import matching, pairs
from corpusieve.plans import boolean
from corpusieve.plans.patterns import compile_pack
from pyspark.sql import functions as F


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_every_method(spark):
    docs = frame(spark, "The flight log names an escort; a minor passenger was listed. flight  log")
    found = matching.hits(docs, compile_pack(["flight log", "re:min(or|us)", "esc*"])).collect()
    assert sorted((r.method, r.start) for r in found) == [("keyword", 4), ("keyword", 62), ("regex", 34), ("wildcard", 24)]
    assert matching.boolean_hits(docs, "flight AND NOT yacht").collect()[0].snippet == "(flight AND NOT(yacht))"


def test_word_boundary(spark):
    docs = frame(spark, "partial", "this is art.", "éart art", None, "")
    assert {r.doc_id: r.n_hits for r in matching.hit_counts(docs, compile_pack(["art"])).collect()} == {1: 1, 2: 1}


def test_near_and_phrase_across_lines(spark):
    docs = frame(spark, "black\nbook was found near the landing strip", "black book " + "x " * 50 + "landing strip")
    own = boolean.compiled('"black book" NEAR/6 "landing strip"', F.col("text"))
    assert [r.ok for r in docs.select(own.alias("ok")).collect()] == [True, False]


@pytest.mark.parametrize("query", ["", "AND", "a AND", "NOT NOT a", "( a"])
def test_unreadable_query_matches_nothing(spark, query):
    assert matching.boolean_hits(frame(spark, "a"), query).count() == 0


def test_offsets_equal_python(spark):
    rng = random.Random(3)
    pieces = ["art", "Art", "😀", "é", " ", "\n", "partial", "art-", "x", "ART "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    found = matching.hits(frame(spark, *texts), compile_pack(["art"])).collect()
    want = {(i, m.start()) for i, t in enumerate(texts) for m in re.finditer(r"(?<!\w)art(?!\w)", t, re.I)}
    assert {(r.doc_id, r.start) for r in found} == want
    for r in found:
        assert r.snippet == texts[r.doc_id][max(0, r.start - 90) : r.start + 3 + 90]


def test_soft_cap(spark):
    docs = frame(spark, "a " * 250 + "b " * 5 + "c")
    kept = matching.capped(matching.hits(docs, compile_pack(["a", "b", "c", "?"]), with_snippet=False))
    assert {r.pattern: r["count"] for r in kept.groupBy("pattern").count().collect()} == {"a": 201, "b": 1, "c": 1, "?": 256}


def test_deduplication_keeps_the_first(spark):
    docs = frame(spark, "art" + "." * 300 + "art" + "." * 300)
    assert matching.deduplicated(matching.hits(docs, compile_pack(["art"]))).count() == 2


def test_stopwords_and_bad_patterns():
    pack = compile_pack(["the", "re:(", "re:a+", "x?", " ", "!!"], stopwords={"the"})
    assert [p.source for p in pack] == ["x?", "re:a+"]


def test_token_set_ratio():
    assert matching.token_set_ratio("black book", "the black old book") == 100
    assert matching.token_set_ratio("a b", "") == 0
    assert matching.token_set_ratio("flight log", "flight logs") == pytest.approx(200 * 10 / 21)


def test_fuzzy_takes_the_first_best_sentence(spark):
    docs = frame(spark, "nothing here. The black book again! black book", "no")
    found = matching.fuzzy_hits(docs, ["black book", "book"]).collect()
    assert [(r.doc_id, r.score, r.snippet) for r in found] == [(0, 1.0, "The black book again")]


@pytest.mark.parametrize("n", [0, 1, 2499, 2500, 2501, 4750, 4751])
def test_chunks_cover_the_text(spark, n):
    text = "".join(chr(97 + i % 26) for i in range(n))
    rows = matching.chunk_rows(frame(spark, text), 2500, 250).orderBy("chunk_index").collect()
    start, want = 0, []
    while start < n:
        end = min(n, start + 2500)
        want.append(text[start:end])
        if end == n:
            break
        start = end - 250
    assert [r.text for r in rows] == want


def test_near_equals_python(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 15))) for _ in range(150)]
    got = frame(spark, *texts).select(boolean.compiled('a NEAR/2 "b c"', F.col("text")).alias("ok")).collect()
    for t, r in zip(texts, got, strict=True):
        w = t.split()
        left, right = [i for i, x in enumerate(w) if x == "a"], [i for i in range(len(w) - 1) if w[i : i + 2] == ["b", "c"]]
        assert r.ok == any(abs(i - j) <= 2 for i in left for j in right)


def test_pages(spark):
    rows = frame(spark, "x [PAGE 1] one [page 2] two").select(F.inline(T.pages(F.col("text")))).collect()
    assert [(r.page_no, r.text.strip()) for r in rows] == [(None, "x"), (1, "one"), (2, "two")]


def test_offsets_of_patterns_that_can_match_nothing(spark):
    found = matching.hits(frame(spark, "baaac xaay", "", "\ufdd0a\ufdd1 a"), compile_pack(["re:a*"])).collect()
    assert [(r.doc_id, r.start, r.snippet.strip()[:1]) for r in found if r.doc_id == 0] == [(0, 1, "b"), (0, 7, "b")]
    assert sorted(r.start for r in found if r.doc_id == 2) == [1, 4]


def test_offsets_of_many_hits(spark):
    text = "ab " * 1500
    found = matching.hits(frame(spark, text), compile_pack(["a?"]), with_snippet=False).collect()
    assert [r.start for r in sorted(found, key=lambda r: r.hit)] == list(range(0, 4500, 3))


@pytest.mark.parametrize(
    ("query", "want"),
    [("a OR b AND c", "(a OR (b AND c))"), ("a AND b NEAR/3 c", "(a AND b) NEAR/3 c"), ("NOT a AND b", "(NOT(a) AND b)"), ("a b", "b"), ("a AND b NOT c", "(b AND NOT(c))"), ("(a OR b) AND c", "((a OR b) AND c)")]
    + [("a OR b ) AND c", "((a OR b) AND c)"), ("android AND-x", "(android AND -x)"), ('"a (b" or near/2x', '("a (b" OR near/2x)'), ("a and b or c", "((a AND b) OR c)"), ("a NEAR/2 b NEAR/3 c", "a NEAR/2 b NEAR/3 c"), ("NOT (a OR b)", "NOT((a OR b))")],
)
def test_how_queries_are_read(query, want):
    assert boolean.parse(query).text == want


@pytest.mark.parametrize("query", ["a OR", "OR a", "()", "a AND ()", "NOT", "(a"])
def test_unreadable_queries(query):
    with pytest.raises(boolean.QueryError):
        boolean.parse(query)


def test_strict_near():
    with pytest.raises(boolean.QueryError):
        boolean.parse("(a AND b) NEAR/2 c", strict=True)


def test_near_on_edges(spark):
    texts = ["", None, "a", "b a", "A x B", "a " + "x " * 3000 + "b"]
    near = lambda q: [r.ok for r in frame(spark, *texts).select(boolean.compiled(q, F.col("text")).alias("ok")).collect()]
    assert near("a NEAR/2 b") == [False, False, False, True, True, False]
    assert near("a NEAR/99999999999 b") == [False, False, False, True, True, True]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["black", "book", "Bock", "a", "log", "flight", "x\u00a0y", "é"]), max_size=6).map(" ".join), max_size=8))
def test_fuzzy_screen_loses_nothing(spark, texts):
    keywords = ["black book", "flight log a", "book book black x"]
    got = {(r.doc_id, r.pattern): r.score for r in matching.fuzzy_hits(frame(spark, "", *texts), keywords, 0.8).collect()}
    want = {}
    for i, t in enumerate(texts, 1):
        for k in keywords:
            score = matching.token_set_ratio(k.lower(), t.strip().lower()) / 100
            if score >= 0.8:
                want[i, k] = score
    assert got == pytest.approx(want)


def test_many_keywords_meet_rows_in_blocks(spark, monkeypatch):
    few, rows = spark.range(7).withColumnRenamed("id", "a"), spark.range(20).withColumnRenamed("id", "b")
    got = {(r.a, r.b) for r in pairs.met(few, rows, most=3).collect()}
    assert got == {(a, b) for a in range(7) for b in range(20)} == {(r.a, r.b) for r in pairs.met(few, rows).collect()}
    assert pairs.met(few, rows, most=3).count() == 140
