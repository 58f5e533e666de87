from __future__ import annotations

import importlib
import re

import pytest

from corpusieve.operators.embedding import HashingProvider
from corpusieve.operators.matching import token_set_ratio
from corpusieve.queries import ORACLES, QUERIES
from corpusieve.queries.documents import FUZZY
from corpusieve.runtime import table
from tests import oracle


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, con, name):
    oracle.same(QUERIES[name](spark, sf_dir), con, ORACLES[name])


def test_queries_without_sql():
    assert set(QUERIES) - set(ORACLES) == {"train_flagger", "chunk_embeddings", "fuzzy_hits"}  # each has a test below


def test_train_flagger(spark, sf_dir):
    (row,) = QUERIES["train_flagger"](spark, sf_dir).collect()
    assert row.n > 0 and 0 <= row.accuracy <= 1 and 0 <= row.auc <= 1  # test_learning.py shows that it learns


def test_chunk_embeddings_equal_brute_force(spark, sf_dir):
    provider, want = HashingProvider(), {}
    for r in table(spark, sf_dir, "documents").collect():
        text, at, k = r.text or "", 0, 0
        while at < len(text):
            (v,) = provider.embed([text[at : at + 2500]])
            want[r.doc_id, k] = (at, min(len(text), at + 2500), pytest.approx(sum(x * x for x in v) ** 0.5, abs=1e-3))
            if at + 2500 >= len(text):
                break
            at, k = at + 2250, k + 1
    got = {(r.doc_id, r.chunk_index): (r.start, r.end, r.norm) for r in QUERIES["chunk_embeddings"](spark, sf_dir).collect()}
    assert got == want


def test_fuzzy_hits_equal_brute_force(spark, sf_dir):
    want = set()
    for r in table(spark, sf_dir, "documents").collect():
        pieces = [s.strip() for s in re.split(r"[\n.?!]+", r.text or "")]
        for k in FUZZY:
            scored = [token_set_ratio(k.lower(), s.lower()) for s in pieces if s]
            if scored and max(scored) >= 92:
                want.add((r.doc_id, k, round(max(scored) / 100, 9)))
    assert {(r.doc_id, r.pattern, round(r.score, 9)) for r in QUERIES["fuzzy_hits"](spark, sf_dir).collect()} == want


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_a_library(monkeypatch):
    import __spark_entry__

    real = importlib.import_module

    def missing(name, *a):
        if name == "corpusieve.llm.queries":
            raise ModuleNotFoundError("No module named 'some_library'", name="some_library")
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", missing)
    with pytest.warns(UserWarning, match="some_library"):
        assert set(QUERIES) <= set(__spark_entry__.queries())
