"""Removal of repeated passages, the filter audit and clustering, against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusieve.llm import audit, balltree, repeats
from corpusieve.llm import queries as llm
from corpusieve.runtime import shared_dir
from tests import oracle

EXTRA = "doc_id long, text string, source string, doc long, key long, start int, spans int, mask int, n long, part string"


def docs(spark, rows):
    """Documents with extra columns that bear names which operators use themselves."""
    return spark.createDataFrame([(*(r if len(r) == 3 else (*r, "web")), 1, 2, 3, 4, 5, 6, "p") for r in rows], EXTRA)


@pytest.mark.parametrize("name", ["op11_repeats", "op12_filter_audit", "op13_ball_tree"])
def test_query_equals_sql(spark, sf_dir, name):
    oracle.same(llm.QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), llm.ORACLES[name])


# -- repeated passages


def brute_kept(rows, size):
    last = 1 << 63
    first, own = {}, []
    for i, text, *_ in rows:
        words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
        own.append(words)
        for k in range(len(words) - size + 1):
            w = tuple(words[k : k + size])
            first[w] = min(first.get(w, last), last if i is None else i)
    out = []
    for (i, *_), words in zip(rows, own, strict=True):
        gone = set()
        for k in range(len(words) - size + 1):
            if first[tuple(words[k : k + size])] < (last if i is None else i):
                gone |= set(range(k, k + size))
        out.append((i, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return sorted(out, key=str)


def kept(rows, size=50):
    out, _ = repeats.without_repeats(rows, size)
    return sorted((tuple(r) for r in out.collect()), key=str)


def passages(seed, n=60, words=80):
    """Texts of few different words that share passages, with odd spaces, marks and shifts."""
    dice = random.Random(seed)
    shared = [[dice.choice(["a", "bb", "été", "the", "of", "x y", " "]) for _ in range(dice.randrange(3, words))] for _ in range(6)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(dice.randrange(0, 5)):
            text += dice.choice(shared)[dice.randrange(0, 3) :] if dice.random() < 0.6 else [f"w{dice.randrange(40)}" for _ in range(dice.randrange(0, words))]
        rows.append((dice.randrange(n), dice.choice([" ", "  ", "\n", "\t \r\n", "\x0b"]).join(text) + dice.choice(["", " ", "\n"])))
    return rows


@pytest.mark.parametrize(("seed", "size"), [(1, 5), (2, 20), (3, 50), (4, 1), (5, 2)])
def test_repeats_equal_brute_force(spark, seed, size):
    rows = passages(seed) + [(None, None), (7, None), (8, ""), (9, " \n "), (None, "a bb " * 60), (None, "a bb " * 60), (-5, "the of " * 70), (3, "the of " * 70), (3, "the of " * 70)]
    assert kept(docs(spark, rows).repartition(5), size) == brute_kept(rows, size)


def test_repeats_in_segments_and_blocks(spark, monkeypatch):
    """A text that is longer than what is looked at together, a word longer than a block, a full sketch."""
    monkeypatch.setattr(repeats, "_SEGMENT", 64)
    monkeypatch.setattr(repeats, "_BLOCK", 128)
    monkeypatch.setattr(repeats, "_TABLES", {})
    monkeypatch.setattr(repeats, "LEAST_BITS", 3)
    monkeypatch.setattr(repeats, "MOST_BITS", 3)
    monkeypatch.setattr(repeats, "HELD", 10)
    long = " ".join(f"n{k % 700}" for k in range(2000))
    rows = [(1, long), (2, "x " * 31 + long[500:6000]), (3, "z" * 500 + " " + long[3000:]), (4, "z" * 500 + " " + long[3000:])]
    for i, words in enumerate([rows, passages(6, 25)]):
        batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in words])], ["text"])
        own = repeats.Words(batch.column("text"))
        least = np.concatenate([s.minimizer for s in repeats.stretches(own, 20)])
        assert sum(int(s.size.sum()) for s in repeats.stretches(own, 20)) == sum(max(0, len(re.findall(r"[^\x20\x09-\x0d]+", t)) - 19) for _, t in words)
        assert len(least) and i < 2
    sketch = np.zeros((2, 1), np.uint8)
    assert not repeats.estimated_repeated(sketch, least).any() and repeats.estimated_repeated(~sketch, least).all()


def test_repeats_with_a_full_sketch(spark, monkeypatch):
    monkeypatch.setattr(repeats, "LEAST_BITS", 3)
    monkeypatch.setattr(repeats, "MOST_BITS", 3)
    rows = passages(7, 40)
    assert kept(docs(spark, rows), 10) == brute_kept(rows, 10)


def test_sketch_never_counts_too_low(spark):
    rows = passages(8, 50)
    own = docs(spark, rows).repartition(6)
    sketch = repeats.sketched(own, 10, 10)
    seen = {}
    for i, (_, text) in enumerate(rows):
        words = repeats.Words(pa.array([text]))
        for s in repeats.stretches(words, 10):
            for m in s.minimizer.tolist():
                seen.setdefault(m, set()).add(i)
    often = np.array([m for m, at in seen.items() if len(at) > 1], np.uint64)
    assert len(often) and repeats.estimated_repeated(sketch, often).all()
    wide = repeats.sketched(own, 20, 10)
    once = np.array([m for m, at in seen.items() if len(at) == 1], np.uint64)
    assert repeats.estimated_repeated(wide, often).all() and repeats.estimated_repeated(wide, once).mean() < 0.01


def test_repeats_of_a_hot_passage(spark):
    """A third of all rows have one passage, each in a place of its own."""
    hot = " ".join(f"h{k}" for k in range(70))
    rows = [(i, f"{' '.join(f'u{i}x{k}' for k in range(i % 60))} {hot if i % 3 == 0 else ''} {' '.join(f'v{i}x{k}' for k in range(55))}") for i in range(600)]
    assert kept(docs(spark, rows)) == brute_kept(rows, 50)


def test_repeats_of_no_rows(spark):
    assert kept(docs(spark, []).limit(0)) == []
    assert kept(docs(spark, [(1, None), (2, "a b")])) == [(1, 0, 0, ""), (2, 2, 0, "a b")]


def test_repeats_of_long_texts(spark):
    dice = random.Random(9)
    words = [f"q{dice.randrange(10**6)}" for _ in range(400_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[100_000:300_000], "end"])), (3, "y" * 3_000_000), (4, "y" * 3_000_000)]
    got = kept(docs(spark, rows))
    assert [r[:3] for r in got] == [(1, 400_000, 0), (2, 200_001, 200_000), (3, 1, 0), (4, 1, 0)] and got[1][3] == "end"


def test_op11_leaves_no_tables(spark, sf_dir, tmp_path):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    names = lambda: {x.getPath().getName() for x in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)}
    before = names()
    llm.QUERIES["op11_repeats"](spark, sf_dir)
    assert {n.rpartition("-")[0] for n in names() - before} == {"op11-kept"}


# -- the audit


def brute_audit(rows, labels):
    quality, toxic = {}, {}
    for i, q, t in labels:
        quality[i], toxic[i] = quality.get(i, False) or q == 1, toxic.get(i, False) or t == 1
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    documents = []
    for i, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0d]+", text)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and least[text] < i}
        documents.append((source or "", fails, i is not None and quality.get(i, False), i is not None and toxic.get(i, False)))
    out, removed = [], {}
    for part in {d[0] for d in documents}:
        own = [d for d in documents if d[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                earlier = len([d for d in own if d[1][f]]) - len(gone)
                removed[part, f] = removed.get((part, f), 0) + len(gone)
                left = [d for d in left if not d[1][f]]
                out.append((part, order, step, len(left), len(gone), earlier, sum(d[1][f] and sum(d[1].values()) == 1 for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)))
    return sorted((*r, removed[r[0], r[1][r[2] - 1]]) for r in out)


def reported(rows, labels):
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return sorted(tuple(r) for r in audit.report(rows, labels).select(*columns).collect())


def test_audit_equals_brute_force(spark):
    dice = random.Random(1)
    texts = ["", " \n", "Few Words", "a b " * 30, "word " * 10, "#", *(" ".join(f"w{dice.randrange(90)}" for _ in range(n)) + dice.choice(["", " SHOUT" * 30, " 5 % | x"]) for n in (49, 50, 60, 120, 300))]
    rows = [(dice.choice([None, *range(40)]), dice.choice([None, *texts]), dice.choice([None, "", "a", "b"])) for _ in range(150)]
    rows += [(99, "same text", "hot")] * 80 + [(98, "ÉtÉ   x" * 20, "marks")]
    marks = [(i, dice.choice([0, 1, None]), dice.choice([0, 1, None])) for i in [*range(0, 40, 2), *range(0, 40, 5), 99, None, 500]]
    labels = spark.createDataFrame([(*m, 1) for m in marks], "doc_id long, quality int, toxic int, mask int")
    assert reported(docs(spark, rows).repartition(4), labels) == brute_audit(rows, marks)
    assert reported(docs(spark, rows[:9]), labels.limit(0)) == brute_audit(rows[:9], [])
    assert reported(docs(spark, rows).limit(0), labels) == []


def test_audit_rows(spark, sf_dir):
    got = llm.QUERIES["op12_filter_audit"](spark, sf_dir)
    parts = spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.count_distinct(F.coalesce("source", F.lit("")))).first()[0]
    assert got.count() == 600 * parts
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan


# -- clustering


def brute_clusters(rows, k=40, rounds=5):
    own = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(x) < 2**19 for x in v)]
    first = sorted(own, key=lambda r: ((r[0] is None), hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in first[:k]]

    def near():
        return [min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in own]

    for _ in range(rounds):
        at = near()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(own, at, strict=True) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted(((i, c, d) for (i, _), (d, c) in zip(own, near(), strict=True)), key=str), centroids


def clustered(spark, rows, **how):
    own = spark.createDataFrame([(*r, 7, 8) for r in rows], "vec_id long, embedding array<double>, cluster int, v int")
    found, centroids = balltree.cluster(own.repartition(3), **how)
    return sorted((tuple(r) for r in found.collect()), key=str), centroids.tolist()


def vectors(seed, n, scale=1.0, centres=12):
    dice = np.random.default_rng(seed)
    base = dice.normal(size=(centres, 64)) * scale
    return [(i, (base[i % centres] + dice.normal(size=64) * scale * 0.05).tolist()) for i in range(n)]


@pytest.mark.parametrize(("n", "scale"), [(300, 1.0), (150, 3e4), (120, 1e5), (200, 0.003)])
def test_clusters_equal_brute_force(spark, n, scale):
    rows = vectors(n, n, scale)
    odd = [(1000, None), (1001, [1.0] * 63), (1002, [1.0] * 65), (1003, []), (1004, [float("nan")] + [0.0] * 63), (1005, [float("inf")] * 64), (1006, [None] + [0.0] * 63), (1007, [1e300] * 64), (None, [0.25] * 64), (None, [-0.25] * 64)]
    hot = [(2000 + i, [0.5 * scale] * 64) for i in range(n // 3)] + [(2000, [0.5 * scale] * 64), (2000, [0.1] * 64)]
    assert clustered(spark, rows + odd + hot) == brute_clusters(rows + odd + hot)


def test_clusters_of_few_rows(spark):
    rows = vectors(3, 7)
    assert clustered(spark, rows) == brute_clusters(rows)
    assert clustered(spark, [(1, [0.0] * 64), (2, [0.0] * 64)]) == ([(1, 0, 0), (2, 0, 0)], [[0] * 64] * 2)
    assert clustered(spark, [(1, None)]) == ([], [])


def test_balls_go_to_one_centroid_whole():
    own = np.array([[math.floor(256 * x) for x in v] for _, v in vectors(4, 4000, 1.0, 20)], np.int64)
    order, balls = balltree.tree_of(own)
    assert sorted(order) == list(range(len(own)))
    for (a, b), centre, radius, total in zip(balls["bounds"], balls["centres"], balls["radii"], balls["sums"], strict=True):
        inside = own[order[a:b]]
        assert (total == inside.sum(0)).all() and np.sqrt(((inside - centre) ** 2).sum(1)).max() <= radius
    names = [x.split()[0] for x in balltree._TREE.split(", ")]
    parts = [own[order], np.arange(len(own)), np.ones(len(own), bool), *balls.values()]
    tree = balltree.Tree(dict(zip(names, (p.tobytes() for p in parts), strict=True)))
    centroids = own[:20]
    found, compared = np.empty(len(own), int), 0
    for _, a, b, each, one in tree.walk(centroids):
        found[a:b] = one if each is None else each
        compared += 0 if each is None else b - a
    assert (found == balltree.nearest(own[order], centroids)).all()
    assert compared < len(own) / 2  # most vectors are never compared


def test_block_of_equal_vectors_is_one_leaf():
    order, balls = balltree.tree_of(np.ones((5000, 64), np.int64))
    assert len(balls["radii"]) == 1 and list(order) == list(range(5000))
