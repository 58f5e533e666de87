"""Operator 11: removal of passages that an earlier document has, with a count-min prefilter.

A window is ``words`` consecutive words of one document; words stand between ASCII white space and are
compared byte by byte. A word goes if a window over it also starts in a document with a smaller doc_id.
Windows are judged on the input, so the order in which documents are looked at is of no matter.

* Each window is known by the least hash of the short runs of words in it (its minimizer). Equal windows
  have equal minimizers, and some sixteen windows in a row mostly share one, so counting these counts no
  window too low and takes a sixteenth of the room.
* First pass: each task counts the minimizers of its documents, once for each document, in a count-min
  sketch. Sketches are merged slice by slice; of the sum, which counts to two, the driver gets a bitmap:
  cells with two or more. Its size follows the size of the texts, up to MOST_BITS for each row.
* Second pass: only windows whose minimizer is estimated to be repeated are written, in stretches that
  share it, with 128-bit hashes of the windows and of the stretch. A stretch that an earlier document has
  whole goes whole. Where all stretches of a minimizer are equal, no more is to be found. Windows of the
  rest, mostly at the ends of copied passages, are grouped one by one.

The sketch overestimates, so no repeated window is lost, whatever its load; beyond about MOST_BITS
minimizers (some 50 GB of text by default) it drops less and more is written and shuffled, at most 16
bytes for each word and 60 for each stretch. A row that is the first of its group is found by a join on
the hash and the doc_id, so a passage that a third of all documents have is no hot key there.

Null texts have no words. Rows without doc_id come after all others and take nothing from one another, nor
do rows that share a doc_id; rows equal in doc_id and text are treated alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusieve.llm.shingles import mixed, odd_numbers
from corpusieve.runtime import bound_batches, discard, table, written

WORDS = 50
#: Words of the short runs whose least hash stands for a window.
GRAM = 19
ROWS = 2
#: Columns of a row of the sketch: at least, at most, and in a slice.
LEAST_BITS, MOST_BITS, SLICE_BITS = 16, 29, 20
#: Bytes of text that have about one minimizer.
BYTES_EACH = 100
#: Minimizers that a task keeps before it passes on what they come to.
HELD = 1 << 21
#: Words that are looked at together, and bytes that are hashed together.
_SEGMENT, _BLOCK = 1 << 18, 1 << 18

_BASES = odd_numbers(11, 3)
_LAST = (1 << 63) - 1


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


class Words:
    """The words of a batch of texts: ``starts`` and ``ends`` in ``data``, and the row of each."""

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.cast(pa.large_string())
        n = len(texts)
        _, offsets, data = texts.buffers()
        self.offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.data, self.offsets = self.data[self.offsets[0] : self.offsets[-1]], self.offsets - self.offsets[0]
        size = len(self.data)
        inside = (self.data != 32) & ((self.data < 9) | (self.data > 13))
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        edges = self.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < size)]
        begins[edges] |= inside[edges]
        stops[edges - 1] |= inside[edges - 1]
        self.inside, self.starts, self.ends = inside, np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.row = np.searchsorted(self.offsets, self.starts, "right") - 1
        #: The first word of each row, and one past the last.
        self.first = np.searchsorted(self.row, np.arange(n + 1))

    def hashes(self) -> np.ndarray:
        """64 bits of each word: the sum of its bytes times powers of a number, mixed with its length."""
        out = np.empty(len(self.starts), np.uint64)
        base = _BASES[0]
        powers, back = _tables(base, _BLOCK + 1)
        first = 0
        while first < len(out):
            at = self.starts[first]
            last = int(np.searchsorted(self.ends, at + _BLOCK, "right"))
            if last <= first:  # a word that is longer than a block
                out[first] = xxhash.xxh3_64_intdigest(self.data[at : self.ends[first]].tobytes())
                first += 1
                continue
            end, own = self.ends[last - 1], self.starts[first:last] - at
            part = (self.data[at:end].astype(np.uint64) + np.uint64(1)) * powers[: end - at]
            part[~self.inside[at:end]] = 0
            out[first:last] = np.add.reduceat(part, own) * back[own]
            first = last
        return mixed(out + (self.ends - self.starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    if int(base) not in _TABLES:
        _TABLES[int(base)] = _powers(base, n), _powers(_inverse(base), n)
    return _TABLES[int(base)]


def _rolling(hashes: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """A hash of every ``size`` consecutive items."""
    powers, back = _tables(base, _SEGMENT + _BLOCK)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers[: len(hashes)])])
    return mixed((sums[size:] - sums[:-size]) * back[: len(hashes) - size + 1])


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` consecutive values."""
    have = 1
    while have < size:
        by = min(have, size - have)
        values = np.minimum(values[:-by], values[by:])
        have += by
    return values


class Stretches:
    """Stretches of windows of one row that share their minimizer, segment by segment.

    Each has ``row``, ``start`` (the word of the row that it starts at), ``size`` (windows) and
    ``minimizer``; ``lanes()`` has two hashes of every window of the segment, ``at`` where the stretch
    begins among these.
    """

    def __init__(self, words: Words, hashes: np.ndarray, size: int, begin: int) -> None:
        self._own, self._size = hashes[begin : begin + _SEGMENT + size - 1], size
        gram = min(GRAM, size)
        least = _least(_rolling(self._own, gram, _BASES[1]), size - gram + 1)
        row = words.row[begin : begin + len(least)]
        whole = row == words.row[begin + size - 1 : begin + size - 1 + len(least)]
        changes = np.ones(len(least), bool)
        changes[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | (whole[1:] != whole[:-1])
        at = np.flatnonzero(changes)
        ends = np.append(at[1:], len(least))
        keep = whole[at]
        self.at, ends = at[keep], ends[keep]
        self.size, self.minimizer, self.row = ends - self.at, least[self.at], row[self.at]
        self.start = self.at + begin - words.first[self.row]

    def lanes(self) -> tuple[np.ndarray, np.ndarray]:
        return _rolling(self._own, self._size, _BASES[1]), _rolling(mixed(self._own ^ _BASES[2]), self._size, _BASES[2])


def stretches(words: Words, size: int) -> Iterator[Stretches]:
    if len(words.starts) >= size:
        hashes = words.hashes()
        for begin in range(0, len(hashes) - size + 1, _SEGMENT):
            yield Stretches(words, hashes, size, begin)


# -- the sketch


def cells(minimizers: np.ndarray, bits: int) -> np.ndarray:
    """The column of each minimizer in each row of the sketch."""
    again = mixed(minimizers)
    return np.stack([again >> np.uint64(64 - bits), mixed(again + np.uint64(1)) >> np.uint64(64 - bits)]).astype(np.int64)


def _packed(offsets: np.ndarray) -> bytes:
    return zstandard.compress(np.diff(offsets, prepend=0).astype(np.uint32).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(data), np.uint32).astype(np.int64))


_PIECES = "part int, once binary, more binary"


def _pieces(minimizers: np.ndarray, bits: int) -> pa.RecordBatch:
    """What minimizers add to the sketch, slice by slice: cells with one, and with more."""
    parts, once, more = [], [], []
    slices = 1 << max(0, bits - SLICE_BITS)
    for r, own in enumerate(cells(minimizers, bits)):
        found, counts = np.unique(own, return_counts=True)
        cuts = np.searchsorted(found >> SLICE_BITS, np.arange(slices + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            here, n = found[cuts[k] : cuts[k + 1]] & ((1 << SLICE_BITS) - 1), counts[cuts[k] : cuts[k + 1]]
            parts.append(r * slices + int(k))
            once.append(_packed(here[n == 1]))
            more.append(_packed(here[n > 1]))
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], ["part", "once", "more"])


def sketched(docs: DataFrame, bits: int, words: int = WORDS) -> np.ndarray:
    """Rows of packed bits: cells of the merged sketch with two or more minimizers of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for s in stretches(Words(batch.column("text")), words):
                order = np.lexsort((s.minimizer, s.row))
                row, least = s.row[order], s.minimizer[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (least[1:] != least[:-1])
                held.append(least[new])
                n += len(held[-1])
                if n >= HELD:
                    yield _pieces(np.concatenate(held), bits)
                    held, n = [], 0
        if n:
            yield _pieces(np.concatenate(held), bits)

    width = 1 << min(bits, SLICE_BITS)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, once, more in zip(*(batch.column(c).to_pylist() for c in ("part", "once", "more")), strict=True):
                own = sums.setdefault(part, np.zeros(width, np.uint8))
                own[_unpacked(once)] += 1
                own[_unpacked(more)] = 2
                np.minimum(own, 2, out=own)
        for part, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(own > 1).tobytes()], pa.binary())], ["part", "repeated"])

    pieces = docs.select("text").mapInArrow(count, _PIECES).repartition("part")
    out = np.zeros((ROWS, max(1, (1 << bits) // 8)), np.uint8)
    slices = 1 << max(0, bits - SLICE_BITS)
    for part, repeated in pieces.mapInArrow(merge, "part int, repeated binary").toLocalIterator():
        r, k = divmod(part, slices)
        out[r, k * width // 8 : (k + 1) * width // 8] = np.frombuffer(repeated, np.uint8)
    return out


def estimated_repeated(sketch: np.ndarray, minimizers: np.ndarray) -> np.ndarray:
    """Whether each may have been counted twice; never false where it was."""
    own = cells(minimizers, (sketch.shape[1] * 8).bit_length() - 1)
    out = np.ones(len(minimizers), bool)
    for bits, at in zip(sketch, own, strict=True):
        out &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return out


def sketch_bits(docs: DataFrame) -> int:
    """The width of a sketch that is filled to about an eighth: it follows the size of the texts."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, (8 * total // BYTES_EACH).bit_length()))


# -- the windows


_RUNS = "doc long, key long, start int, size int, minimizer long, d1 long, d2 long, w1 array<long>, w2 array<long>"


def _candidates(docs: DataFrame, sketch: np.ndarray, words: int) -> DataFrame:
    """Stretches of docs(doc, key, text) that may be repeated, with the hashes of their windows."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)  # MOST_BITS bounds its size

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _RUNS.split(", ")]
        for batch in batches:
            doc, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "key"))
            for s in stretches(Words(batch.column("text")), words):
                kept = np.flatnonzero(estimated_repeated(shared.value, s.minimizer))
                if not len(kept):
                    continue
                lanes, at, size, row = s.lanes(), s.at[kept], s.size[kept], s.row[kept]
                cuts = np.append(0, np.cumsum(size))
                inside = np.arange(cuts[-1]) + np.repeat(at - cuts[:-1], size)
                own = [w[inside] for w in lanes]
                digests = [mixed(np.add.reduceat(w, cuts[:-1]) + size.astype(np.uint64)) for w in own]
                lists = [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(w.view(np.int64))) for w in own]
                flat = [doc[row], key[row], s.start[kept].astype(np.int32), size.astype(np.int32), s.minimizer[kept].view(np.int64), *(d.view(np.int64) for d in digests)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, flat), *lists], names)

    return docs.mapInArrow(task, _RUNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc (the doc_id, the last one possible for null), key (of the text) and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text).alias("key"), text.alias("text"))


def repeated_windows(docs: DataFrame, words: int = WORDS) -> tuple[DataFrame, list[DataFrame]]:
    """doc, key, start and size: ``size`` windows from word ``start`` on that a smaller document has too;
    with the tables that it reads."""
    own = _keyed(docs).drop("doc_id")
    runs = written(_candidates(own, sketched(own, sketch_bits(own), words), words), "op11-runs")
    same = ["minimizer", "d1", "d2"]
    firsts = runs.groupBy(*same).agg(F.min("doc").alias("doc"))
    copied = runs.select(*same, "doc", "key", "start", "size").join(firsts, [*same, "doc"], "left_anti")
    digest = F.struct("d1", "d2")
    unlike = runs.groupBy("minimizer").agg(F.min(digest).alias("a"), F.max(digest).alias("b")).where("a <> b").select("minimizer")
    leaders = runs.join(firsts.join(unlike, "minimizer"), [*same, "doc"], "left_semi")
    both = F.posexplode(F.arrays_zip("w1", "w2")).alias("at", "w")
    windows = written(leaders.select("doc", "key", "start", both).select("doc", "key", (F.col("start") + F.col("at")).alias("start"), "w.w1", "w.w2"), "op11-windows")
    earliest = windows.groupBy("w1", "w2").agg(F.min("doc").alias("doc"))
    later = windows.join(earliest, ["w1", "w2", "doc"], "left_anti")
    found = copied.select("doc", "key", "start", "size").unionByName(later.select("doc", "key", "start", F.lit(1).alias("size")))
    return found, [runs, windows]


_KEPT = "doc_id long, n_words long, n_removed long, kept string"


def without_repeats(docs: DataFrame, words: int = WORDS) -> tuple[DataFrame, list[DataFrame]]:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of every row of
    docs(doc_id, text); with the tables that it reads."""
    found, tables = repeated_windows(docs, words)
    spans = found.groupBy("doc", "key").agg(F.collect_list(F.struct("start", "size")).alias("spans"))  # no more than a text has words

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _kept(batch, words)

    rows = _keyed(docs).join(spans, ["doc", "key"], "left").select("doc_id", "text", F.col("spans.start").alias("starts"), F.col("spans.size").alias("sizes"))
    return rows.mapInArrow(task, _KEPT), tables


def _kept(batch: pa.RecordBatch, size: int) -> pa.RecordBatch:
    own = Words(batch.column("text"))
    lists = batch.column("starts")
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    starts = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + own.first[owner]
    sizes = batch.column("sizes").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    steps = np.zeros(len(own.starts) + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + sizes + size - 1, -1)
    stays = np.cumsum(steps)[:-1] == 0
    n = len(lists)
    n_words, n_kept = np.diff(own.first), np.bincount(own.row[stays], minlength=n)
    # bytes of the words that stay, and a space before each but a row's first
    edge = np.zeros(len(own.data) + 1, np.int8)
    edge[own.starts[stays]] += 1
    np.add.at(edge, own.ends[stays], -1)
    mask = np.cumsum(edge[:-1], dtype=np.int8) > 0
    row = own.row[stays]
    more = np.zeros(len(row), bool)
    more[1:] = row[1:] == row[:-1]
    gaps = own.starts[stays][more] - 1
    data = own.data.copy()
    data[gaps], mask[gaps] = 32, True
    lengths = np.concatenate([np.zeros(1, np.int64), np.cumsum(mask, dtype=np.int64)])[own.offsets]
    kept = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(lengths.astype(np.int64).tobytes()), pa.py_buffer(data[mask].tobytes())]).cast(pa.string())
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words.astype(np.int64)), pa.array((n_words - n_kept).astype(np.int64)), kept], [x.split()[0] for x in _KEPT.split(", ")])


def op11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps."""
    bound_batches(spark)
    out, tables = without_repeats(table(spark, sf_dir, "documents"))
    result = written(out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")), "op11-kept")
    discard(*tables)
    return result


OP11_SQL = r"""
WITH rows AS (
  SELECT doc_id, coalesce(doc_id, 9223372036854775807) AS doc, row_number() OVER () AS r,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
windows AS (
  SELECT r, doc, i, array_to_string(list_slice(w, i, i + 49), ' ') AS words
  FROM (SELECT r, doc, w, unnest(range(1, greatest(len(w) - 48, 1))) AS i FROM rows)),
firsts AS (SELECT words, min(doc) AS first FROM windows GROUP BY words HAVING min(doc) < max(doc)),
gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 50)) AS p
  FROM windows JOIN firsts USING (words) WHERE first < doc),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM rows),
kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS words
  FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM rows LEFT JOIN kept USING (r)
"""
