from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusieve import cli, schemas
from corpusieve.functions import urls
from corpusieve.functions.register import register
from corpusieve.operators import embedding
from corpusieve.operators.triage import Model, triage
from corpusieve.settings import Settings

TEXTS = ["The flight log\nwas found. Mail a@b.org", "nothing here", "The flight log\nwas found. Mail a@b.org", None, "a flight log and a ledger, flight log"]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, f"https://h{i}.org/x", t) for i, t in enumerate(TEXTS)], "doc_id long, url string, text string")


def test_triage_without_embeddings(docs):
    out = triage(docs, Settings(keywords=("flight log",), query="ledger"))
    got = {r.doc_id: r for r in out["documents"].collect()}
    assert set(got) == {0, 1, 3, 4}  # equal texts are one document
    assert {i: (r.n_hits, r.passes_relevance, r.bucket) for i, r in got.items()} == {0: (2, True, "flagged"), 1: (0, False, "triaged"), 3: (0, False, "triaged"), 4: (3, True, "flagged")}
    assert {r.method for r in out["matches"].collect()} == {"keyword", "query", "fuzzy"}
    assert [r.canonical for r in out["doc_entities"].collect()] == ["a@b.org"]
    assert out["doc_page_flags"].count() == 0
    with pytest.raises(ValueError, match="nothing to look for"):
        triage(docs, Settings())


def test_triage_of_texts_that_share_an_id(spark):
    far = "two: flight log" + " x" * 200 + " flight log"
    rows = [(1, "u1", "a flight log"), (1, "u2", far), (2, "u3", "a flight log"), (None, "u4", "alone"), (None, "u5", None), (1, "u1", "a flight log"), (None, "u6", "a flight log")]
    out = triage(spark.createDataFrame(rows, "doc_id long, url string, text string"), Settings(keywords=("flight log",)))
    got = sorted(((r.doc_id, r.url, r.title, r.n_hits) for r in out["documents"].collect()), key=str)
    own = [(h, n) for _, _, h, n in got if "flight" in h]
    assert sorted(r[:2] for r in got if r[0] == 1) == [(1, "u1"), (1, "u2")] and sorted((r[:2] for r in got if r[0] is None), key=str) == [(None, "u4"), (None, "u5")]
    assert len(got) == 4 and dict(own) == {"a flight log": 2, far: 3}  # one of each is fuzzy
    assert {r.doc_id for r in out["matches"].collect()} == {1}
    assert out["matches"].groupBy("sha256").count().count() == 2


def test_triage_with_embeddings(spark, docs):
    provider = embedding.HashingProvider()
    model = Model(topic=embedding.topic(["flight log", "found mail"], provider), penalties=spark.createDataFrame([("h1.org", 0.5)], "host string, penalty double"))
    got = {r.doc_id: r for r in triage(docs, Settings(keywords=("ledger",)), embedding.HashingProvider, model)["documents"].collect()}
    assert got[0].topic_similarity > got[1].topic_similarity and got[0].passes_relevance
    assert got[1].url_penalty == 0.5 and not got[1].passes_relevance


def test_embeddings(spark, docs):
    assert embedding.by_chunk(docs, embedding.HashingProvider).count() == 4
    rows = embedding.of_long_documents(spark.createDataFrame([(1, "word " * 3000)], "doc_id long, text string"), embedding.HashingProvider).collect()
    assert rows[0]["count"] == 4 and rows[0].norm == pytest.approx(1.0, abs=0.1)
    assert embedding.whole(docs, embedding.HashingProvider).where("norm > 0.99").count() == 4


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("SELECT token_set_ratio('a b', 'b a c'), nfkc('ﬁ')").first()[:] == (100.0, "fi")
    assert [r.label for r in spark.sql("SELECT * FROM entity_mentions('a@b.org 212-555-0100')").collect()] == ["EMAIL", "PHONE"]


def test_schemas(spark):
    assert len(schemas._DDL) == 11
    old = spark.createDataFrame([(1, "u", "x")], "doc_id int, url string, odd string")
    assert schemas.conformed(old, "documents").schema == schemas.schema("documents")


def test_seeds(spark):
    assert urls.valid_seeds([" https://a ", "ftp://b", "https://a", "HTTP://c"]) == ["https://a", "HTTP://c"]
    assert spark.range(1).select(urls.valid_seed(F.lit(" http://x"))).first()[0]


def test_cli(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("a flight log")
    (tmp_path / "p.json").write_text('["flight log"]')
    cli.main(["triage", f"file://{tmp_path}/in", f"file://{tmp_path}/out", "--keywords", str(tmp_path / "p.json")])
    assert spark.read.parquet(f"file://{tmp_path}/out/documents").first().bucket == "flagged"
    assert spark.read.csv(f"file://{tmp_path}/out/index", sep="\t", header=True).count() == 1
