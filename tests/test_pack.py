"""A whole pack in one pass finds what its patterns find one by one."""

from __future__ import annotations

import random

import pytest
from corpusieve.operators import matching, pack
from corpusieve.plans.patterns import compile_pack

WORDS = ["art", "Art", "ART", "log", "flight", "straße", "STRASSE", "ẞ", "ß", "ss", "ſet", "set", "SET", "İd", "id", "ıd", "\u212ane", "kne", "été", "ÉTÉ", "οδος", "ΟΔΟΣ", "ǆ", "ǅ", "ﬀ", "ff", "x_1", "12", "don't", "co-op", "😀"]
GAPS = [" ", "  ", "\n", "\t ", ", ", "-", "\u00a0", ". ", "'"]


def texts(n: int, seed: int) -> list[str | None]:
    dice = random.Random(seed)
    return [None, "", *("".join(dice.choice(WORDS) + dice.choice(GAPS) for _ in range(dice.randint(0, 60))) for _ in range(n))]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(rows)], "doc_id long, text string, start int, o int")


def large(seed: int) -> list[str]:
    dice = random.Random(seed)
    words = [w for w in WORDS if w not in ("😀", "ß", "ẞ")]  # Java takes these for each other in longer words only
    return [*words, *(" ".join(dice.choice(words) for _ in range(dice.randint(2, 4))) for _ in range(40)), "art art", "re:l.g", *(f"{a}*" for a in "aefist"), "*t", "?t?", "s[es]*", *(f"{w[:2]}*" for w in words[:4])]


@pytest.mark.parametrize("seed", [1, 2])
def test_a_large_pack_equals_its_patterns(spark, monkeypatch, seed):
    docs, patterns = frame(spark, texts(150, seed)), compile_pack(large(seed))
    together = sorted(map(tuple, matching.hits(docs, patterns).collect()))
    counted = sorted(map(tuple, matching.hit_counts(docs, patterns).collect()))
    monkeypatch.setattr(matching, "ONE_BY_ONE", 10_000)
    assert together == sorted(map(tuple, matching.hits(docs, patterns).collect())) and together
    assert counted == sorted(map(tuple, matching.hit_counts(docs, patterns).collect()))


def test_a_pack_is_one_scan_without_shuffle(spark, sf_dir):
    patterns = compile_pack([f"word{i} more" for i in range(1000)] + [f"glob{i}*" for i in range(20)])
    plan = matching.hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), patterns)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("FileScan") == 1


def test_a_pack_costs_hardly_more_for_more_keywords():
    class Counted(dict):
        probes = 0

        def __contains__(self, word):
            Counted.probes += 1
            return super().__contains__(word)

    text, probes = " ".join(f"w{i % 997} the" for i in range(5000)), []
    for n in (10, 1000):
        trie = pack.Trie(compile_pack([f"k{i} the w{i}" for i in range(n)]))
        trie.root, Counted.probes = Counted(trie.root), 0
        assert trie(text) == []
        probes.append(Counted.probes)
    assert probes == [10_000, 10_000]


def test_phrases_that_overlap_themselves(spark):
    docs = frame(spark, ["a b a b a", "a a a", "a a a a"])
    patterns = compile_pack(["a b a", "a a", *(f"k{i}" for i in range(40))])
    assert sorted((r.doc_id, r.pattern, r.start) for r in matching.hits(docs, patterns).collect()) == [(0, "a b a", 0), (1, "a a", 0), (2, "a a", 0), (2, "a a", 4)]


def test_folded_words():
    pairs = [("\u212a", "k"), ("ſ", "S"), ("ß", "ẞ"), ("İ", "i"), ("ı", "I"), ("Σ", "ς"), ("ǅ", "ǆ")]
    assert all(pack.folded(a) == pack.folded(b) for a, b in pairs)
    assert pack.folded("ß") != "ss" and pack.folded("ﬀ") != "ff"
