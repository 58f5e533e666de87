from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from corpusieve.llm import anisotropic, chosenpath
from corpusieve.runtime import table


def brute(ids, x, query_id, query, k=20):
    scores = (x * query).sum(1)
    keep = ids != query_id
    order = np.lexsort((ids[keep], -scores[keep]))[:k]
    return ids[keep][order].tolist(), scores[keep][order]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")


@pytest.mark.parametrize("blocks", [4096, 150])
def test_recall(spark, monkeypatch, blocks):
    monkeypatch.setattr(anisotropic, "ROW_BLOCK", blocks)
    monkeypatch.setattr(anisotropic, "LARGE_BLOCK", blocks)
    monkeypatch.setattr(anisotropic, "QUERY_BLOCK", 20)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1200, 32)).astype(np.float32)
    x[400:800] = x[5] + 0.001 * rng.normal(size=(400, 32))  # near copies that codes can't tell apart
    got: dict[int, list] = {}
    for r in anisotropic.search(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids, y, hits = np.arange(1200), x.astype(float), 0
    assert sorted(got) == list(range(0, 1200, 20))
    for q, rows in got.items():
        want, scores = brute(ids, y, q, y[q])
        assert [r for r, _, _ in sorted(rows)] == list(range(1, 21))
        hits += len(set(want) & {v for _, v, _ in rows})
        for _, v, s in rows:
            assert s == pytest.approx(float((y[v] * y[q]).sum()), abs=1e-12)
    assert hits / (20 * len(got)) >= 0.95


def test_copies_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.5]) for i in range(100)] + [(200, [nan, 1.0]), (201, [0.0, 0.0]), (202, None), (203, [1.0]), (204, [inf, 1.0]), (205, [None, 1.0]), (None, [9.0, 9.0]), (220, [2.0, 2.0])]
    got = sorted((r.query_id, r.rank, r.vec_id) for r in anisotropic.search(vectors(spark, rows)).collect())
    for q in (0, 20, 40, 60, 80):
        own = [v for i, _, v in got if i == q]
        assert own == [220, *[v for v in range(25) if v != q][:19]]
    assert {i for i, _, _ in got} == {0, 20, 40, 60, 80, 220}
    assert anisotropic.search(vectors(spark, [])).count() == 0
    assert anisotropic.search(vectors(spark, [(0, [1.0, 2.0])])).count() == 0


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [0.5, 0.25])]
    got = sorted((r.rank, r.vec_id, r.score) for r in anisotropic.search(vectors(spark, rows)).collect())
    assert got == sorted([(1, 1, 0.5), (2, 0, 0.0), (3, 0, 0.0), *2 * [(1, 0, 1.0), (2, 1, 0.25), (3, 0, 0.0)]])
    asked = vectors(spark, [(7, [1.0, 1.0]), (7, [1.0, 1.0])])
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in anisotropic.search(vectors(spark, rows), asked, nearest=2).collect())
    assert got == 2 * [(7, 1, 0, 1.0)] + 2 * [(7, 2, 0, 1.0)]


def test_vectors_meet_those_of_their_length(spark):
    rows = [(i, [1.0, float(i)]) for i in range(10)] + [(100 + i, [float(i + 1), 0.5, 1.0]) for i in range(3)] + [(200, [3.0])]
    got: dict[int, list] = {}
    for r in anisotropic.search(vectors(spark, rows)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {0, 100} and sorted(got[100]) == [(1, 102, 4.25), (2, 101, 3.25)]
    assert [v for _, v, _ in sorted(got[0])] == list(range(1, 10))


def test_many_copies_with_the_query_among_them(spark):
    rows = [(i // 2, [2.0, 2.0]) for i in range(120)] + [(500, [2.0, 1.0])]
    by_query: dict[int, list] = {}
    for r in anisotropic.search(vectors(spark, rows)).collect():
        by_query.setdefault(r.query_id, []).append(r.vec_id)
    assert sorted(by_query) == [0, 20, 40, 500]
    assert sorted(by_query[0]) == sorted(2 * [0, *[v for i in range(1, 10) for v in (i, i)], 10])
    assert sorted(by_query[500]) == sorted(v for i in range(10) for v in (i, i))


def test_query_equals_brute_force(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings").collect()
    ids, x = np.array([r.vec_id for r in own]), np.array([r.embedding for r in own], float)
    got: dict[int, list] = {}
    for r in anisotropic.op4_query(spark, sf_dir).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == sorted(i for i in ids if i % 20 == 0)
    hits = 0
    for q, rows in got.items():
        want, scores = brute(ids, x, q, x[ids == q][0])
        assert sorted(r for r, _, _ in rows) == list(range(1, 21))
        hits += len(set(want) & {v for _, v, _ in rows})
        for _, v, s in rows:
            assert s == pytest.approx(float((x[ids == v][0] * x[ids == q][0]).sum()), abs=1e-12)
    assert hits / (20 * len(got)) >= 0.95


def test_anisotropic_loss_falls():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 16))
    q = anisotropic.fit(x, 16)
    plain = q.codes(x, sweeps=0)
    assert q.loss(x, q.codes(x)) <= q.loss(x, plain)
    tables = q.tables(x[:3])
    codes = anisotropic.pack_codes(q.codes(x))
    decoded = q.words[np.arange(len(q.words)), q.codes(x)].reshape(500, -1)[:, :16]
    assert anisotropic.scan(np.ascontiguousarray(codes.T), tables[1]) == pytest.approx(decoded @ x[1], abs=1e-4)


def test_pipeline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept.append(stage(spark, kept[-1], sf_dir).cache())
        assert kept[-1].columns == docs.columns, name
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert ids[0] == ids[1]
    gone = ids[1] - ids[2]
    assert np.mean([labels[i] == 0 for i in gone if i in labels]) > 0.8
    from tests.llm.test_texts import brute_join

    groups = brute_join({r.doc_id: r.text for r in kept[2].collect()})
    assert ids[3] == {root for root, _ in groups.values()}
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids[3]


def test_pipeline_on_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _stay int"
    rows = [(1, None, None, None, None, 1), (2, "", "en", "s", 0, 1), (None, "the words of it", "en", "s", 3, 1), (4, "the words of it", None, "s", 3, 1)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES[:3]:
            docs = stage(spark, docs, f"file://{tmp_path}")
            assert docs.columns == [x.split()[0] for x in schema.split(", ")]
            docs.collect()
        corpus_pipeline.STAGES[3][1](spark, docs, f"file://{tmp_path}").collect()


def test_pipeline_on_repeated_rows_and_long_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    (first,) = docs.where("lang = 'en' and n_chars > 500").orderBy("doc_id").limit(1).collect()
    long = spark.createDataFrame([(900_000, (first.text + " ") * (400_000 // len(first.text)), "en", "s", 1)], docs.schema)
    own = docs.unionByName(docs.where(docs.doc_id == first.doc_id)).unionByName(long)
    kept = own
    for _, stage in corpus_pipeline.STAGES[:3]:
        before, kept = kept, stage(spark, kept, sf_dir).cache()
        assert kept.exceptAll(before).count() == 0  # rows stay as they are, and none is made
    assert kept.groupBy("doc_id").count().where("count > 1").count() == 0  # repeated rows are copies
    packed = corpus_pipeline.STAGES[3][1](spark, kept, sf_dir)
    whole = packed.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).where("`sum(length)` <> `max(doc_tokens)`")
    assert whole.count() == 0 and packed.select("doc_id").distinct().count() == kept.count()


def test_of_rows_equal_in_id_and_text_the_same_one_stays(spark):
    text = "one two three four five six seven"
    rows = [(1, text, f"s{k}", k) for k in range(12)] + [(2, text, "other", 0), (3, "quite another text that is alone here", "a", 1)]
    kept = set()
    for seed in range(4):
        own = spark.createDataFrame(sorted(rows, key=lambda r: hash((r, seed))), "doc_id long, text string, source string, n int").repartition(1 + seed, "n")
        kept.add(tuple(sorted(tuple(r) for r in chosenpath.keep_one(own).collect())))
    (one,) = kept
    assert [r[0] for r in one] == [1, 3]
