from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusieve.llm import chat, chosenpath, fingerprints, langid, quality, shards, shingles
from corpusieve.llm.components import components
from corpusieve.llm.shingles import OnePermutation, Shingler
from corpusieve.llm.words import WordTable, text_rows
from corpusieve.runtime import scratch
from tests import oracle

EXTRA = "doc_id long, text string, lang string, score double, run int, node long, n int"


def docs(spark, rows):
    """Documents with extra columns that bear names which operators use themselves."""
    return spark.createDataFrame([(i, t, lang, 0.0, 1, 2, 3) for i, t, lang in rows], EXTRA)


def held_out(i, by, rest):
    return zlib.crc32(str(i).encode()) % by == rest


# -- words


def test_word_table_forgets_and_stays_right():
    table = WordTable(lambda new: np.array([[len(w)] for w in new], float).reshape(-1, 1), limit=3)
    for words in (["a", "bb", "a"], ["c" * 100, "bb"], ["d", "ee", "fff", "gggg"], ["a"], []):
        assert table(words)[:, 0].tolist() == [len(w) for w in words]


# -- quality


def test_quality_on_held_out_rows(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = quality.op1_query(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in rows:
        assert r.held_out == held_out(r.doc_id, 3, 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    test = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in test]) > 0.8


def test_quality_edge_cases(spark):
    own = docs(spark, [(1, None, None), (2, "", "en"), (3, "x" * 100_000, "en"), (3, "x", "en"), (None, "a b", "en"), *((10 + i, "good words here" if i % 2 else "bad### bad###", "en") for i in range(40))])
    labels = spark.createDataFrame([(i + 10, i % 2) for i in range(40)] + [(10, None), (None, 1), (11, 1), (11, 1), (3, 1)], "doc_id long, quality int")
    rows = quality.classify(own, labels).collect()
    assert len(rows) == 45 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.doc_id - 10) % 2 for r in rows if r.doc_id and r.doc_id >= 10)
    assert quality.classify(own, labels.limit(0)).where("score <> 0.5").count() == 0
    assert quality.classify(own.limit(0), labels).count() == 0


def brute_score(model, text):
    """The mean over a document's rows and the softmax, feature by feature."""
    words = (text or "").split()
    bits, total, count, seen = (len(model.weight) - 2).bit_length() - 1, 0.0, 0, set()
    for k, w in enumerate(words):
        rows, _ = quality.features([w], bits)
        assert len(rows) == 1 + sum(max(0, len(w) + 3 - n) for n in quality.GRAMS)
        total += sum(model.weight[r] for r in rows)
        count += len(rows)
        if k:
            pair = words[k - 1], w
            total += model.weight[-2 if pair in seen else -1]
            seen.add(pair)
            count += 1
    return 1 / (1 + np.exp(-(model.bias + total / (count + quality.PRIOR))))


def test_scores_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["good", "fine", "bad", "é😀", "x", "worse"]) for _ in range(rng.choice([0, 1, 2, 30, 200]))) for _ in range(60)] + [None, " a  b ", "y" * 3000]
    model = quality.train(texts[:40], [i % 2 for i in range(40)], steps=200)
    got = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", quality.score(F.col("text"), model).alias("s")).collect()
    assert [r.s for r in sorted(got)] == pytest.approx([brute_score(model, t) for t in texts], abs=1e-9)


def test_samples_are_bounded(spark):
    from corpusieve.llm import sampling

    rows = docs(spark, [(i, "x" * 100, f"l{i % 7}") for i in range(300)])
    assert len(list(sampling.taken(rows, 1050, "doc_id"))) == 10
    assert sum(map(len, langid.training_texts(rows, chars=12_800).values())) == 128
    by = sampling.sampled_by(rows, "lang", 3, 100, 5, "doc_id").groupBy("lang").count().collect()
    assert len(by) == 5 and all(r["count"] == 3 for r in by)
    assert sampling.sampled(rows, 20, "doc_id").count() == 20 and sampling.sampled(rows, 2000, "doc_id").count() == 300


def test_a_text_that_does_not_fit_is_passed_over(spark):
    from corpusieve.llm import sampling

    own = docs(spark, [(i, "x" * (900 if i % 2 else 100), "en") for i in range(40)])
    kept = [len(r.text) for r in sampling.taken(own, 2000, "doc_id")]
    assert sum(kept) == 2000 or sum(kept) > 1900
    assert {len(r.text) for r in sampling.learnable(own, 64 * 500).collect()} == {100}


def test_one_very_long_labelled_text_changes_nothing(spark):
    rows = [(10 + i, f"good words here {i}" if i % 2 else f"bad### bad### {i}", "en" if i % 2 else "fr") for i in range(60)]
    marks = spark.createDataFrame([(i, i % 2) for i in range(500)], "doc_id long, quality int")
    less = docs(spark, rows)
    for i in range(100, 104):  # one of these is not held out, whatever the fold
        more = less.unionByName(spark.range(1).select(F.lit(i).cast("long").alias("doc_id"), F.repeat(F.lit("odd words "), 4_000_000).alias("text"), F.lit("fr").alias("lang")), allowMissingColumns=True)
        if not held_out(i, 3, 1) and not held_out(i, 4, 2):
            break
    a, b = quality.learn(less, marks), quality.learn(more, marks)
    assert (a.weight == b.weight).all() and a.bias == b.bias and a.weight.any()
    assert langid.training_texts(less) == langid.training_texts(more) and langid.training_texts(less)


def test_equal_code_lengths_give_the_first_name():
    model = langid.train({"b": ["one two"], "a": ["one two"]})
    assert model.predict(["one two"])[0][:2] == ("a", 0.5)


def test_scores_do_not_depend_on_blocks(monkeypatch):
    model = quality.train(["a b c d e f"] * 3 + ["z z z z"] * 3, [1, 1, 1, 0, 0, 0], steps=12)
    texts = ["a b c a b z z", None, "", "z z z a", "a"]
    whole = model.scorer()(texts)
    monkeypatch.setattr(quality, "text_rows", lambda t, table: text_rows(t, table, 2))
    assert model.scorer()(texts) == pytest.approx(whole)
    assert model.scorer()(texts[:1])[0] == pytest.approx(whole[0])


# -- language


def brute_bits(texts: list, order: int, text: str) -> float:
    """Code length of a text by walking plain dictionaries."""
    seen = defaultdict(lambda: defaultdict(int))
    for s in map(langid.stream, texts):
        for i in range(1, len(s)):
            for k in range(min(order, i) + 1):
                seen[s[i - k : i]][s[i]] += 1
    s, total = langid.stream(text), 0.0
    for i in range(1, len(s)):
        for k in range(min(order, i), -1, -1):
            own = seen.get(s[i - k : i])
            if own:
                t, d = sum(own.values()), len(own)
                if s[i] in own:
                    total -= np.log2(own[s[i]] / (t + d))
                    break
                total -= np.log2(d / (t + d))
        else:
            total += 8
    return total


@pytest.mark.parametrize("size", [1 << 19, 7])
def test_code_lengths_are_exact(monkeypatch, size):
    monkeypatch.setattr(langid, "BYTES", size)
    texts = {"en": ["the thing that the other thinks", "é the", "12"], "fr": ["les choses que les autres pensent"], "xx": []}
    model = langid.train(texts, 3)
    asked = ["the", "then the Choses, l'été 42!", None, "zzz\n\nzz", "é", "12 !", "the other " * 30]
    bits, sizes = model.code_lengths(asked)
    for k, lang in enumerate(["en", "fr", "xx"]):
        assert bits[:, k] == pytest.approx([brute_bits(texts[lang], 3, t) for t in asked], rel=1e-5)
    assert sizes.tolist() == [max(0, len(langid.stream(t)) - 1) for t in asked]
    guess = model.predict(["The THING, (that) 42 the!", "²"])
    (own,) = model.code_lengths(["the thing that the"])[0]
    assert guess[0][:2] == ("en", pytest.approx(1 / np.exp2(own.min() - own).sum(), rel=1e-6)) and guess[1] == ("und", 0.0, 0.0)


def test_streams():
    assert langid.stream("Hé,  l'Eau_7\n") == " hé l eau ".encode()
    assert langid.stream("12 ² _") == langid.stream(None) == b""


def test_language_edge_cases(spark):
    own = docs(spark, [(i, "the and of that with " * 3 if i % 2 else "der und die das mit ", "en" if i % 2 else "de") for i in range(40)] + [(50, None, "en"), (51, "", None), (52, "12 !!! 3", "en"), (53, "the and of", None), (None, "die das", "de"), (54, "x" * 100_000, "en")])
    got = {r.doc_id: r for r in langid.identify(own).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (50, 51, 52))
    assert got[53].lang_pred == "en" and got[None].lang_pred == "de" and got[None].held_out is False
    assert all(r.lang_pred in ("en", "de", "und") and 0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.identify(own.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(own.limit(0)).count() == 0


def test_language_on_held_out_rows(spark, sf_dir):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = langid.op2_query(spark, sf_dir).collect()
    assert len(rows) == len(langs) and all(r.held_out == held_out(r.doc_id, 4, 2) for r in rows)
    test = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in test]) > 0.97


# -- fingerprints


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_densification_is_the_same_for_all_sets():
    make = OnePermutation(64)
    a, b = np.array([1 << 60, 5 << 50], np.uint64), np.array([1 << 60, 5 << 50, 7 << 58], np.uint64)
    assert set(make(a)) <= set(a.tolist()) and len(make(a)) == 64
    assert (make(a) == make(a[::-1].copy())).all()
    assert 0 < (make(a) == make(b)).mean() < 1


def test_similarity_column_equals_likeness(spark):
    make = fingerprints.Fingerprinter()
    texts = ["", "a b c d e f g", "a b c d e f h", "other words entirely in this text", None]
    rows = [(fingerprints.packed(make(a)), fingerprints.packed(make(b)), fingerprints.likeness(make(a), make(b))) for a in texts for b in texts]
    got = spark.createDataFrame(rows, "a binary, b binary, w double").select("w", fingerprints.similarity(F.col("a"), F.col("b")).alias("g")).collect()
    assert all(r.g == pytest.approx(r.w) for r in got)
    assert (fingerprints.unpacked(rows[7][0]) == make(texts[1])).all()


@pytest.mark.parametrize("partitions", [1, 3])
def test_edit_report(spark, partitions):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "é😀", "eps"]) for _ in range(rng.choice([0, 1, 3, 50, 400]))) for _ in range(30)]
    rows = [(i * 7, t, "en") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in fingerprints.edit_report(docs(spark, rows), partitions).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for k, (i, text, _) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(text)
        assert got[i].near_edited == pytest.approx(jaccard(shingle_set(text), shingle_set(edited)), abs=0.15)
        assert got[i].near_next == pytest.approx(jaccard(shingle_set(text), shingle_set(after)), abs=0.15)


def test_edit_report_edge_cases(spark):
    (r,) = fingerprints.edit_report(docs(spark, [(1, None, None)])).collect()
    assert (r.n_chars, r.fingerprint, r.near_edited, r.near_next) == (0, b"", 1.0, 1.0)
    rows = fingerprints.edit_report(docs(spark, [(1, "same text", None), (1, "same text", None), (None, "x", None), (2, "same text", None)])).collect()
    assert len(rows) == 4 and len({bytes(r.fingerprint) for r in rows if r.doc_id}) == 1
    long = " ".join(f"w{i}" for i in range(60_000))
    (a, b) = fingerprints.edit_report(docs(spark, [(1, long, None), (2, long, None)])).collect()
    assert bytes(a.fingerprint) == bytes(b.fingerprint) and len(a.fingerprint) == 256 and a.near_next == 1.0 and 0.6 < a.near_edited < 0.95
    assert fingerprints.edit_report(docs(spark, [])).count() == 0


# -- Jaccard join


def brute_join(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    links, parent = dict.fromkeys(sets, 0), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if jaccard(sets[a], sets[b]) >= 0.8:
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (root(i), links[i]) for i in ids}


def near_texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    while len(texts) < n:
        base = [rng.choice(words) for _ in range(rng.choice([1, 4, 8, 60, 300]))]
        for _ in range(rng.choice([1, 1, 2, 5, 45])):
            own = list(base)
            for _ in range(rng.randint(0, len(base) // 30)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
    return texts[:n]


def test_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(chosenpath, "BLOCK", 16)
    texts = dict(enumerate([*near_texts(1, 300), "", None, "A b", "a  B"]))
    got = {r.doc_id: (r.class_id, r.n_links) for r in chosenpath.jaccard_join(docs(spark, [(i, t, None) for i, t in texts.items()]), small=8).collect()}
    assert got == brute_join(texts)


def test_keep_one(spark):
    same = "one two three four five six seven"
    rows = [(3, same, "a"), (3, same, "a"), (None, same, "b"), (4, "other words that are not the same", "c"), (None, "lonely text of no id at all", "d"), (5, "", "e"), (6, None, "f")]
    kept = chosenpath.keep_one(docs(spark, rows))
    assert kept.columns == [x.split()[0] for x in EXTRA.split(", ")]
    assert sorted((str(r.doc_id), r.lang) for r in kept.collect()) == [("3", "a"), ("4", "c"), ("5", "e"), ("None", "d")]
    assert chosenpath.keep_one(docs(spark, [])).count() == 0 and chosenpath.jaccard_join(docs(spark, [])).count() == 0


def test_join_of_repeated_and_null_ids(spark):
    same, long = "one two three four five six seven", " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, same, ""), (1, same, ""), (1, "quite other words than all the rest", ""), (None, same, ""), (None, None, ""), (7, long, ""), (8, long + " more", ""), (9, long[: len(long) // 2], "")]
    got = sorted((str(r.doc_id), str(r.class_id), str(r.copy_id), r.n_links) for r in chosenpath.jaccard_join(docs(spark, rows)).collect())
    assert got == sorted([("1", "1", "1", 2), ("1", "1", "1", 2), ("1", "1", "1", 0), ("None", "1", "1", 2), ("None", "None", "None", 0), ("7", "7", "7", 1), ("8", "7", "8", 1), ("9", "9", "9", 0)])


def test_keep_one_with_clashing_columns(spark):
    own = spark.createDataFrame([(2, "a b c d e f", 1), (1, "a b c d e f", 2)], "doc_id long, text string, x int")
    own = own.selectExpr("*", "x AS _stays_id", "x AS _stays_hash", "x AS root", "x AS node", "x AS text_hash", "x AS _times", "x AS least", "x AS _key")
    assert [r.doc_id for r in chosenpath.keep_one(own).collect()] == [1]


def test_shared_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 200, rng.integers(0, 150))).astype(np.uint64) for _ in range(20)]
    got = chosenpath.shared_counts(sets)
    for i in range(20):
        for j in range(20):
            if i != j:
                assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_recall_of_one_pair_at_the_threshold():
    """How often two sets of exactly the threshold's similarity share a path at the last level."""
    rng, together = np.random.default_rng(4), 0
    signer = chosenpath.Signer(5, 0.8, chosenpath.runs_needed())
    for _ in range(200):
        x = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        a, b = np.unique(x), np.unique(x[:80])
        together += bool(np.intersect1d(signer.paths(a)[2][0], signer.paths(b)[2][0]).size)
    assert together >= 190


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (200, 200)] + [(300, 301 + i) for i in range(20)], "a long, b long")
    got = defaultdict(set)
    for r in components(edges, "t").collect():
        got[r.root].add(r.node)
    assert sorted(map(sorted, got.values())) == [list(range(31)), [100, 101], list(range(300, 321))]


def test_shingler_short_texts():
    make = Shingler()
    assert len(make("")) == 0 and len(make("a b")) == 1 and len(make("a b c d e f")) == 2
    assert make("A b\tC")[0] == make("a B c")[0]


def test_word_hashes(monkeypatch):
    rng, words = random.Random(3), ["a", "b", "ab", "ba", "é", "日本", "x" * 5000, "x" * 5001, "aa", "a" * 4097]
    texts = [[rng.choice(words) for _ in range(rng.randint(1, 30))] for _ in range(50)]
    alone = {w: int(shingles.word_hashes(w)[0]) for w in words}
    assert len(set(alone.values())) == len(words)
    for size in (1 << 18, 3, 7000):
        monkeypatch.setattr(shingles, "_BYTES", size)
        for t in texts:
            assert shingles.word_hashes("\n ".join(t).upper().replace("É", "é")).tolist() == [alone[w] for w in t]
    assert len(shingles.word_hashes(" \u2003\n")) == len(shingles.word_hashes(None)) == 0


# -- shards


def test_shards(spark):
    store = shards.ShardStore(spark, scratch(spark, "t5"), target_bytes=1 << 14, run=3)
    with pytest.raises(ValueError, match="nothing"):
        store.read()
    rows = docs(spark, [(i, f"text {i} " * 20, "en") for i in range(400)])
    for k in range(4):
        store.append(rows.where(F.col("doc_id") % 4 == k).coalesce(2), f"a{k}")
    before, version = store.shards(), store.version()
    assert len(before) == 8 and version == 4
    assert store.compact() > version and len(store.shards()) < len(before)
    assert sorted(r.doc_id for r in store.read().collect()) == list(range(400))
    assert store.read(2).count() == 200  # an older version is still whole
    assert store.vacuum() == len(before)
    with pytest.raises(ValueError, match="version 2"):
        store.read(2)
    assert store._put(2, {}, []) is False  # its number stays taken
    read = []
    store.manifest, whole = (lambda v=None: read.append(v) or whole(v)), store.manifest
    assert store.vacuum() == 0 and len(read) <= 2  # emptied manifests are not read again
    store.manifest = whole
    assert store.read().exceptAll(rows).count() == 0 and rows.exceptAll(store.read()).count() == 0
    with pytest.raises(ValueError, match="columns differ"):
        store.append(rows.select("doc_id"))
    assert store.vacuum(grace=-1) == 0  # it wrote nothing
    assert store._put(1, {}, []) is False and store.read().count() == 400


def test_shards_of_writers_at_once(spark, monkeypatch):
    root = scratch(spark, "t5")
    one, two = (shards.ShardStore(spark, root, target_bytes=1 << 14, run=2) for _ in range(2))
    rows = docs(spark, [(i, f"text {i} " * 20, "en") for i in range(100)])
    parts = [rows.where(F.col("doc_id") % 5 == k).coalesce(1) for k in range(5)]
    for k in range(2):
        one.append(parts[k], f"a{k}")
    real = one._put

    def late(*a):  # the other writer appends and vacuums between this one's files and its manifest
        monkeypatch.setattr(one, "_put", real)
        two.append(parts[2], "b")
        two.vacuum()
        return real(*a)

    monkeypatch.setattr(one, "_put", late)
    one.append(parts[3], "c")
    assert sorted(r.doc_id % 5 for r in one.read().collect()) == [k for k in range(4) for _ in range(20)]

    def compacted(*a):  # the other writer compacts the same shards first
        monkeypatch.setattr(one, "_put", real)
        two.compact()
        return real(*a)

    monkeypatch.setattr(one, "_put", compacted)
    one.compact()
    two.append(parts[4], "d")
    one.vacuum()
    assert one.read().exceptAll(rows).count() == 0 and rows.exceptAll(one.read()).count() == 0
    named = {s.path for s in one.shards()}
    assert named == {path for path, _ in one._files("data")}
    spark.range(3).write.parquet(f"{root}/data/lost")
    left = len(one._files("data")) - len(named)
    assert left > 0 and one.vacuum() == 0 and one.vacuum(grace=-1) == left


def test_shards_edge_cases(spark):
    store = shards.ShardStore(spark, scratch(spark, "t5"))
    own = docs(spark, [(1, None, None), (None, "", "en"), (1, "x", None)]).withColumn("arrival", F.lit(None).cast("int"))
    assert store.append_each(own, "arrival") == [1]
    assert store.append_each(own.limit(0), "arrival") == [2]
    assert store.read().exceptAll(own).count() == 0 and store.read().count() == 3
    empty = shards.ShardStore(spark, scratch(spark, "t5"))
    empty.append(own.limit(0))
    assert empty.compact() and empty.read().count() == 0


# -- chat


def conversation(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, state string")


def test_chat_round_trip(spark):
    nasty = ["", None, "</turn><turn:assistant>", "&lt;&amp;", "a<b>&c", "\\", "😀 é", "x" * 50_000]
    rows = [(k, i, r, t, "clash") for k, t in enumerate(nasty) for i, r in enumerate(["system", "user", "assistant"])] + [(99, None, None, "late", ""), (99, 5, "odd>role", "first", ""), (99, 5, "odd>role", "first", ""), (None, 0, "user", "q", "")]
    made = chat.format_conversations(conversation(spark, rows))
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    for k, t in enumerate(nasty):
        assert [(x.role, x.text) for x in back[k].turns] == [(r, t or "") for r in ("system", "user", "assistant")]
        assert back[k].learned == [t or ""]
    assert [(x.role, x.text) for x in back[99].turns] == [("odd>role", "first"), ("odd>role", "first"), ("", "late")]
    assert {r.conv_id: r.well_formed for r in made.collect()} == {**dict.fromkeys(range(len(nasty)), True), 99: False, None: False}
    assert chat.format_conversations(conversation(spark, [])).count() == 0


def test_template_is_checked():
    for bad in ({"close": "end"}, {"before_role": "<a<"}, {"after_role": ")"}, {"before_role": "<t", "close": "<t>"}):
        with pytest.raises(ValueError, match="mark|role"):
            chat.Template(**bad)


@pytest.mark.parametrize("name", ["op5_shards", "op6_jaccard_join", "op7_chat"])
def test_sql(spark, sf_dir, name):
    from corpusieve.llm.queries import ORACLES, QUERIES

    oracle.same(QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), ORACLES[name])


def test_native_plans_have_no_python(spark, sf_dir):
    for query in (chat.op7_query, shards.op5_query):
        plan = query(spark, sf_dir)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
