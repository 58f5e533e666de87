"""The best documents by bounds on blocks are those of a search that reads all postings."""

from __future__ import annotations

import random

import pytest

from corpusieve.operators import search

COLUMNS = "doc_id long, title string, content string"
QUERIES = ["the", "rare", "rare OR the", "log the", "the NOT log", "title:rare OR content:log", "NEAR(rare log, 2) OR rare", "none", "(rare OR log) the", "rare rare"]


@pytest.fixture(scope="module")
def texts():
    dice = random.Random(5)

    def text(n):
        return " ".join(dice.choices(["the", "log", "x", "y", "rare"], [8, 3, 4, 4, 0.03], k=n))

    return [(i, dice.choice(["the log", "rare", "x y", None]) if i % 50 == 0 else "x", text(dice.choice([3, 10, 40, 200]))) for i in range(1500)]


@pytest.fixture(scope="module")
def store(spark, texts, tmp_path_factory):
    own = search.Store(spark, f"file://{tmp_path_factory.mktemp('index')}/i", block=16)
    own.upsert(spark.createDataFrame([(i, t, c + " rare") for i, t, c in texts[:40]], COLUMNS))
    own.upsert(spark.createDataFrame(texts[:1000], COLUMNS))  # the first 40 changed
    own.upsert(spark.createDataFrame(texts[1000:], COLUMNS))
    own.remove(spark.createDataFrame(texts[::9], COLUMNS))
    return own


def rows(df):
    return [(r.doc_id, pytest.approx(r.bm25)) for r in df.collect()]


def test_best_by_bounds_equal_a_search_of_all_postings(spark, store, texts):
    live = [t for k, t in enumerate(texts) if k % 9]
    fresh, opened = search.build_index(spark.createDataFrame(live, COLUMNS)), store.index()
    assert opened.dead is not None and len(store.now["segments"]) == 3
    fresh.postings, fresh.lengths = fresh.postings.cache(), fresh.lengths.cache()
    for k, query in enumerate(QUERIES):
        want = rows(search.search(fresh, query, 5000))
        assert (want == []) == (query == "none")
        for limit in (7, 5000 if k % 3 else 1):
            assert rows(search.search(opened, query, limit)) == want[:limit], (query, limit)
    assert search.search(opened, "the", 0).count() == 0


def test_blocks_that_cannot_win_are_not_read(spark, store):
    opened = store.index()
    for query, words in (("rare OR the", ["rare", "the"]), ("rare", ["rare"])):
        own = opened.postings.where(search.F.col("term").isin(words))
        kept = own.join(search.Bounded.of(opened, search.parse(query)).survivors(3), ["segment", "block"], "left_semi").count()
        assert 0 < kept < 0.5 * own.count(), (query, kept, own.count())


def test_bounds_of_a_block_hold_for_its_documents(store):
    opened = store.index()
    joined = opened.postings.join(opened.blocks, ["segment", "term", "block"])
    assert joined.where("(field = 'title' AND (tf > title_tf OR tf / length > title_share)) OR (field = 'content' AND (tf > content_tf OR tf / length > content_share))").count() == 0
    assert joined.count() == opened.postings.count()


def test_queries_without_bounds_read_all_places(spark, store):
    opened = store.index()
    for query in ('"the log"', "ra*"):
        assert search.Bounded.of(opened, search.parse(query)) is None
    assert search.Bounded.of(search.build_index(spark.createDataFrame([], COLUMNS)), search.parse("the")) is None


def test_ties_across_blocks_go_to_the_least_id(spark, tmp_path):
    own = search.Store(spark, f"file://{tmp_path}/i", block=4)
    own.upsert(spark.createDataFrame([(i, None, "same text") for i in range(200)], COLUMNS))
    assert [r.doc_id for r in search.search(own.index(), "same", 5).collect()] == [0, 1, 2, 3, 4]
