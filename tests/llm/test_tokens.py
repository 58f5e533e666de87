from __future__ import annotations

import hashlib
import io
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusieve.llm import bpe, encoders, packing, tokenfiles, words
from corpusieve.runtime import scratch

RANKS, JSON = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
END = "<|endoftext|>"
TEXTS = [None, "", " ", "a", "  two  spaces \n\n x\t", "naïve café 中文 😀", END, f"{END} start", f"a {END} b", f"at the end {END}", f"{END}{END} twice  {END}", "<|endoftext|", "x" * 3000, "word, word. word\nword", "I'll 12,345!"]
PIECES = st.lists(st.sampled_from(["a", "the", " ", "\n", "\t", "\x1c", " ", "é", "中", "😀", "12", "'s", ".", ",", END, "<|", "ing", "A"]), max_size=30).map("".join)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def ids_of(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.one_of(PIECES, st.text(max_size=40)))
def test_bpe_equals_the_library(reference, text):
    vocabulary, encode = bpe.loaded(RANKS)
    assert ids_of(encode(text)) == reference.encode_ordinary(text)
    assert vocabulary.decode(np.frombuffer(encode(text), "<u4")) == text.encode()


@settings(max_examples=400, deadline=None)
@given(st.one_of(PIECES, st.text(max_size=40)))
def test_chunks_equal_the_whole_text(library, text):
    assert ids_of(encoders.library_encoder(JSON)(text)) == library.encode(text, add_special_tokens=False).ids


def test_memo_overflow_changes_nothing(library):
    small = encoders.ChunkEncoder(encoders.library_encoder(JSON).chunks.encode, limit=2)
    text = "many different words pass by here, many different words"
    assert ids_of(small(text)) == library.encode(text, add_special_tokens=False).ids


def test_other_files_go_to_the_library_whole():
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, encode = Tokenizer.from_file(path), encoders.library_encoder(path)
    for text in ("Some Words, 12!", f"a {END} b", " "):
        assert ids_of(encode(text)) == whole.encode(text, add_special_tokens=False).ids


def test_a_worker_keeps_one_thing():
    first = encoders.library_encoder(JSON)
    assert encoders.library_encoder(JSON) is first
    vocabulary, _ = bpe.loaded(RANKS)
    assert bpe.loaded(RANKS)[0] is vocabulary and encoders.library_encoder(JSON) is not first
    words.forget()
    assert not words._kept


def frame(spark, texts, **more):
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_bpe_round_trip(spark, reference):
    docs = frame(spark, TEXTS).unionByName(spark.createDataFrame([(None, "a", "x"), (1, "", "y")], "doc_id long, text string, ids string"))
    rows = bpe.round_trip(docs, RANKS).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "a" if r.doc_id is None else TEXTS[r.doc_id] or ""
        assert bytes(r.decoded) == text.encode() and ids_of(r.ids) == reference.encode_ordinary(text)


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes(kind, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    assert (tokenfiles.from_planes(tokenfiles.to_planes(ids, kind), n, kind) == ids).all()


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_file_round_trip(kind):
    docs = [(5, [1, 2, 3]), (6, []), (None, list(range(100)))]
    stream = io.BytesIO()
    writer = tokenfiles.Writer(stream, kind, block_ids=16)
    for doc_id, ids in docs:
        writer.add(doc_id, np.array(ids, "<u4").tobytes())
    assert writer.close() == 103
    data = stream.getvalue()
    reader = tokenfiles.Reader(io.BytesIO(data), len(data))
    assert [(d, at, ids_of(x)) for d, at, x in reader.documents()] == [(5, 0, [1, 2, 3]), (6, 3, []), (None, 3, list(range(100)))]
    assert len(reader.blocks) == 7
    broken = bytearray(data)
    broken[12] ^= 255
    with pytest.raises(Exception):  # noqa: B017, PT011
        list(tokenfiles.Reader(io.BytesIO(bytes(broken)), len(data)).documents())
    with pytest.raises(ValueError, match="never finished"):
        tokenfiles.Reader(io.BytesIO(data[:-1]), len(data) - 1)


def test_token_files(spark, library):
    texts = [*TEXTS, *(f"document {i} " * i for i in range(40))]
    docs = frame(spark, texts).unionByName(spark.createDataFrame([(None, "n", ""), (3, "a", "")], "doc_id long, text string, ids string"))
    root = scratch(spark, "t9")
    manifest = tokenfiles.write(docs, root, lambda: encoders.library_encoder(JSON), partitions=3)
    assert manifest.count() > 1
    rows = sorted(tokenfiles.read(spark, root).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 0, 1, 2, 3, 3, *range(4, len(texts))]
    at = 0
    for r in rows:
        text = "n" if r.doc_id is None else texts[r.doc_id] or ""
        assert (r.start, ids_of(r.ids)) == (at, [*library.encode(text, add_special_tokens=False).ids, 0])
        at += len(r.ids) // 4


def test_token_files_of_one_id(spark):
    docs = spark.createDataFrame([(None if i % 2 else 5, f"text {i}") for i in range(200)], "doc_id long, text string")
    root = scratch(spark, "t9")
    manifest = tokenfiles.write(docs, root, lambda: encoders.library_encoder(JSON), partitions=8)
    assert manifest.where("docs > 60").count() == 0
    rows = sorted(tokenfiles.read(spark, root).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None] * 100 + [5] * 100 and len({bytes(r.ids) for r in rows}) == 200
    assert all(b.start == a.start + len(a.ids) // 4 for a, b in zip(rows, rows[1:], strict=False))


def test_token_files_of_nothing(spark):
    root = scratch(spark, "t9")
    tokenfiles.write(frame(spark, []), root, lambda: encoders.library_encoder(JSON))
    assert tokenfiles.read(spark, root).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60), st.sampled_from([8, 12, 16]), st.integers(1, 5))
def test_packer(sizes, length, windows):
    out: list[list[packing.Piece]] = []
    packer = packing.Packer(out.append, length, windows)
    ids = [np.arange(n, dtype="<u4") + 1000 * k for k, n in enumerate(sizes)]
    for k, x in enumerate(ids):
        packer.add((k, 0, x.tobytes(), len(x)))
        assert len(packer.open) <= windows
    full = len(out)
    out += packing.powers_of_two([x for w in packer.leftovers() for x in w], length)
    lengths = [sum(len(x[2]) // 4 for x in w) for w in out]
    assert all(n == length for n in lengths[:full]) and all(0 < n <= length for n in lengths)
    if length in (8, 16):
        assert all(n & (n - 1) == 0 for n in lengths)
    got: dict[int, list] = {k: [] for k in range(len(ids))}
    for w in out:
        for doc, start, data, total in w:
            assert total == sizes[doc]
            got[doc].append((start, ids_of(data)))
    for k, pieces in got.items():
        assert [i for _, x in sorted(pieces) for i in x] == ids[k].tolist()


def check_packed(rows, want: dict):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(want)
    for doc_id, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and zlib.crc32(np.array(want[doc_id][at : at + r.length], "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(want[doc_id])
            at += r.length
        assert at == len(want[doc_id])
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding


def test_packing(spark, library):
    texts = [*TEXTS, *("long text " * (i * 40) for i in range(60))]
    rows = packing.digest(packing.library_pack(frame(spark, texts).repartition(3), scratch(spark, "t10"), JSON)).collect()
    assert check_packed(rows, {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}) == 0
    assert packing.library_pack(frame(spark, []), scratch(spark, "t10"), JSON).count() == 0


def test_packing_of_null_and_repeated_ids(spark, library):
    docs = spark.createDataFrame([(None, "a"), (None, None), (1, "b c"), (1, "b c")], "doc_id long, text string")
    rows = packing.library_pack(docs, scratch(spark, "t10"), JSON).collect()
    want = sorted([*library.encode(t, add_special_tokens=False).ids, 1] for t in ("a", "", "b c", "b c"))
    whole = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):  # pieces of four tokens at most lie side by side
        whole.setdefault(r.doc_id, []).extend(ids_of(r.ids))
    assert sorted(whole[None] + whole[1]) == sorted(i for x in want for i in x) and sum(r.doc_tokens for r in rows if r.start == 0) == sum(map(len, want))


def test_bpe_of_nothing_and_of_long_texts(spark, reference):
    assert bpe.round_trip(frame(spark, []), RANKS).count() == 0
    texts = ["ab" * 100_000, "the words and  more\n" * 20_000, "é😀" * 30_000]
    for r in bpe.round_trip(frame(spark, texts), RANKS).collect():
        assert bytes(r.decoded) == texts[r.doc_id].encode() and ids_of(r.ids) == reference.encode_ordinary(texts[r.doc_id])


def test_queries(spark, sf_dir, reference, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in bpe.op8_query(spark, sf_dir).collect():
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    ids = {d: library.encode(t, add_special_tokens=False).ids for d, t in texts.items()}
    at = 0
    for r in tokenfiles.op9_query(spark, sf_dir).orderBy("doc_id").collect():
        own = [*ids[r.doc_id], 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        at += len(own)
    assert check_packed(packing.op10_query(spark, sf_dir).collect(), {d: [*x, 1] for d, x in ids.items()}) == 0
