"""Operators and stages read all rows and report what they find of them."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from corpusieve.llm import anisotropic, chat, langid
from corpusieve.runtime import table


def test_language_stage_rejects_foreign_texts_and_letter_soup(spark, sf_dir):
    import random

    docs, dice = table(spark, sf_dir, "documents"), random.Random(1)
    odd = [
        "nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita",
        "litwo ojczyzno moja ty jesteś jak zdrowie ile cię trzeba cenić ten tylko się dowie kto cię stracił",
        "мой дядя самых честных правил когда не в шутку занемог он уважать себя заставил",
        *["".join(dice.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(400)) for _ in range(5)],
    ]
    more = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(more, allowMissingColumns=True), sf_dir).select("doc_id").collect()}
    clean = {r.doc_id for r in docs.where(langid.held_out(F.col("doc_id"))).select("doc_id").collect()}
    assert clean and clean <= kept
    assert not [i for i in kept if i < 0]


def test_op7_reports_how_conversations_are_ordered(spark, tmp_path):
    orders = [["user", "assistant"], ["system"], ["system", "user"], ["assistant", "user"], ["user", "user", "assistant"], ["user", "assistant", "system"]]
    rows = [(k, i, role, "t") for k, own in enumerate(orders) for i, role in enumerate(own)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: (r.state, r.well_formed) for r in chat.op7_query(spark, str(tmp_path)).collect()}
    want = [("answered", True), ("ready", False), ("asked", False), (None, False), (None, False), (None, False)]
    assert got == {**dict(enumerate(want)), chat.PROBE_ID: ("answered", True)}


def test_nearest_keeps_ties_beside_repeated_rows_of_the_query(spark):
    rows = [(0, [1.0, 0.5])] * 6 + [(i, [1.0, 0.5]) for i in range(1, 31)] + [(100 + i, [0.5, 0.5]) for i in range(1, 20)]
    own = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.rank, r.vec_id) for r in anisotropic.search(own).collect() if r.query_id == 0)
    assert [v for _, v in got] == [v for v in [0, 0, 0, 0, 0, *range(1, 16)] for _ in range(6)]  # six queries
