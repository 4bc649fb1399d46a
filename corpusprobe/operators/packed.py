"""N-grams in sorted ranges, packed: what :mod:`corpusprobe.operators.ngrams` sends through a shuffle and keeps.

An n-gram repeats the words of its neighbours, so as rows the n-grams of a corpus take
many times its size. Here a task sorts some millions of them at a time by the ranks of
their words, drops copies, cuts them at the bounds of the ranges and packs each piece:
a block of first words, a block of second ones and so on, compressed together. A shuffle
carries pieces, not rows; the pieces of a range are merged in one task. Bounds come from
a sample of the n-grams; they decide where an n-gram is merged, never whether it is.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprobe.operators.places import _token_array, _valid, ws_token_array

SAMPLE_EVERY = 16_384   # n-grams for one that helps to choose the bounds
GRAM_BYTES = 32         # of an n-gram, usually; beside its text it takes twice that in a task
PIECE_ROWS = 100_000    # n-grams of a range unpacked together
KNOWN_BYTES = 8 * 1024 * 1024  # of an index's n-grams packed together; they come in order
LEVEL = 5               # of zstd
PASSES = 2              # over more than PASS_ROWS n-grams, each for its share of the ranges: the disk holds one's shuffle at a time
PASS_ROWS = 4_000_000

PIECES = "ngram_range int, old boolean, size bigint, packed binary"
SORTED_PIECES = "ngram_range int, place bigint, n bigint, size bigint, packed binary"


@dataclass(frozen=True)
class Ranges:
    """N-grams of ``n`` words, not merged yet: ``cut`` gives their pieces (``PIECES``) in some ranges at any bounds, ``sample`` is of ``total`` with copies."""
    n: int
    sample: list[bytes]
    total: int
    range_rows: int
    cores: int
    cut: Callable[[list[bytes], range], DataFrame]

    def bounds(self) -> list[bytes]:
        """The first n-gram of each range but the first."""
        if not self.sample:
            return []
        sample = sorted(self.sample)
        weights = np.cumsum([2 * GRAM_BYTES + len(x) for x in sample])
        wanted = -(-self.total * int(weights[-1]) // (len(sample) * 3 * GRAM_BYTES * self.range_rows))
        wanted = max(wanted, min(self.cores, len(sample)))
        return sorted({sample[i] for i in np.searchsorted(weights, weights[-1] * np.arange(1, wanted) / wanted)})


# ------------------------------------------------------------------ in tasks

def _ranks(words: pa.Array) -> np.ndarray:
    ranks = np.empty(len(words), dtype=np.uint64)
    ranks[pc.sort_indices(words).to_numpy()] = np.arange(len(words), dtype=np.uint64)
    return ranks


def _in_order(words: pa.Array, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The places of n-grams in the order of their text, and which of them in that order differ from the one before.

    ``codes`` number the first words, the second words and so on in ``words``, which are distinct. A space follows
    each word but the last; it counts where a character below it is next in a longer word."""
    spaced, last = _ranks(pc.binary_join_element_wise(words, b"", b" ")), _ranks(words)
    bits = max(1, (len(words) - 1).bit_length())
    keys, room = [], 0
    for k, some in enumerate(codes):
        of = (last if k == len(codes) - 1 else spaced)[some]
        if room < bits:
            keys.append(of)
            room = 64
        else:
            keys[-1] <<= np.uint64(bits)
            keys[-1] |= of
        room -= bits
    order = np.argsort(keys[0], kind="stable")  # quick where sorted pieces follow each other
    differ = _changes(keys[0][order])
    for key in keys[1:]:
        tied = ~differ
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        among, runs = order[at], np.cumsum(differ[at])
        of = key[among]
        inner = np.lexsort((of, runs))
        order[at] = among[inner]
        differ[at] |= _changes(of[inner])
    return order, differ


def _changes(sorted_key: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before; the first one does."""
    differ = np.ones(len(sorted_key), dtype=bool)
    np.not_equal(sorted_key[1:], sorted_key[:-1], out=differ[1:])
    return differ


def _packed(lined: pa.Array, codes: list[np.ndarray], codec: pa.Codec) -> tuple[int, bytes]:
    """The size of the blocks of words (``lined``: each with a line feed behind) and the blocks, compressed."""
    body = b"".join(memoryview(lined.take(pa.array(some)).buffers()[2]) for some in codes)
    return len(body), codec.compress(body, asbytes=True)


def _unpacked(size: int, packed: bytes | pa.Buffer, codec: pa.Codec) -> pa.Array:
    """The words, block after block."""
    body = codec.decompress(packed, size, asbytes=True)
    ends = np.flatnonzero(np.frombuffer(body, dtype=np.uint8) == 0x0A)
    offsets = np.zeros(len(ends) + 1, dtype=np.int32)
    offsets[1:] = ends - np.arange(len(ends))
    return _token_array(offsets, body.translate(None, b"\n"))


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=LEVEL)


def _lined(words: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(words, b"", b"\n")


def _pieces(words: pa.Array, codes: list[np.ndarray], bounds: list[bytes], wanted: range, old: bool) -> Iterator[pa.RecordBatch]:
    """N-grams sorted, without copies, cut at the bounds and packed: those in the ranges ``wanted``."""
    order, differ = _in_order(words, codes)
    order = order[differ]
    for k, some in enumerate(codes):
        codes[k] = some[order]
    lined, codec, places = _lined(words), _codec(), range(len(order))

    def gram(at: int) -> bytes:
        return b" ".join(words[int(some[at])].as_py() for some in codes)

    first, last = max(wanted.start, bisect_right(bounds, gram(0))), min(wanted.stop - 1, bisect_right(bounds, gram(places[-1])))
    start = bisect_left(places, bounds[first - 1], key=gram) if first else 0
    for i in range(first, last + 1):
        end = bisect_left(places, bounds[i], lo=start, key=gram) if i < len(bounds) else len(places)
        if end > start:
            size, packed = _packed(lined, [some[start:end] for some in codes], codec)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([old]), pa.array([size]), pa.array([packed], pa.binary())],
                                             names=["ngram_range", "old", "size", "packed"])
        start = end


def _line_grams(batches: Iterator[pa.RecordBatch], n: int, rows: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The tokens of some lines and the places where their n-grams begin, about ``rows`` n-grams together."""
    def chunks() -> Iterator[tuple[pa.Array, np.ndarray]]:
        some, held = [], 0
        for batch in batches:
            for line in batch.column("line").to_pylist():
                some.append(line)
                held += len(line) + 1
                if held >= 6 * rows:
                    yield ws_token_array(_valid(some))
                    some, held = [], 0
        if some:
            yield ws_token_array(_valid(some))

    for tokens, ends in chunks():
        line = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))
        starts = np.flatnonzero(line[:max(0, len(line) - n + 1)] == line[n - 1:])
        del line
        for at in range(0, len(starts), rows):
            yield tokens, starts[at:at + rows]


def _merged(rows: list[tuple[bool, int, pa.Buffer]], n: int) -> tuple[pa.Array, list[np.ndarray]]:
    """The words and sorted codes of the n-grams in a range's pieces, without copies and without old ones."""
    codec, parts, old = _codec(), [], []
    for was, size, packed in rows:
        parts.append(_unpacked(size, packed, codec))
        old.append(was)
    ends = np.cumsum([0, *map(len, parts)])
    whole = pa.concat_arrays(parts)
    del parts
    coded = whole.dictionary_encode()
    del whole
    flat = coded.indices.to_numpy()
    blocks = [flat[a:b].reshape(n, -1) for a, b in zip(ends, ends[1:], strict=False)]
    codes = [np.concatenate([block[k] for block in blocks]) for k in range(n)]
    order, differ = _in_order(coded.dictionary, codes)
    firsts = np.flatnonzero(differ)
    if any(old) and len(firsts):
        known = np.repeat(old, [block.shape[1] for block in blocks])[order]
        firsts = firsts[~np.logical_or.reduceat(known, firsts)]
    return coded.dictionary, [some[order[firsts]] for some in codes]


def _each_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[bool, int, pa.Buffer]]]]:
    """The pieces of each range; those of a range are neighbours."""
    at, some = None, []
    for batch in batches:
        packed = batch.column("packed")
        for i, (r, was, size) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("ngram_range", "old", "size")), strict=True)):
            if r != at and some:
                yield at, some
                some = []
            at = r
            some.append((was, size, packed[i].as_buffer()))
    if some:
        yield at, some


def _grams(words: pa.Array, codes: list[np.ndarray]) -> pa.Array:
    return pc.binary_join_element_wise(*(words.take(pa.array(some)) for some in codes), b" ").view(pa.string())


# ------------------------------------------------------------------ operators

def line_ranges(lines: DataFrame, n: int, chunk_rows: int, range_rows: int) -> Ranges:
    """The n-grams of ``line`` in ranges of about ``range_rows`` of usual length, fewer of longer ones. One action samples them."""
    some = lines.where(F.col("line").isNotNull()).select(F.col("line").cast("binary").alias("line"))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chance, rows = np.random.default_rng(TaskContext.get().partitionId()), 0
        for tokens, starts in _line_grams(batches, n, chunk_rows):
            rows += len(starts)
            at = starts[chance.integers(0, len(starts), chance.binomial(len(starts), 1 / SAMPLE_EVERY))]
            grams = _grams(tokens, [at + k for k in range(n)]).view(pa.binary())
            yield pa.RecordBatch.from_arrays([grams, pa.nulls(len(at), pa.int64())], names=["ngram", "n"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.array([rows])], names=["ngram", "n"])

    found = some.mapInArrow(sampled, "ngram binary, n bigint").collect()

    def pieces(bounds: list[bytes], wanted: range) -> DataFrame:
        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for tokens, starts in _line_grams(batches, n, chunk_rows):
                first, last = int(starts[0]), int(starts[-1]) + n
                coded = tokens.slice(first, last - first).dictionary_encode()
                codes = coded.indices.to_numpy()
                yield from _pieces(coded.dictionary, [codes[starts - first + k] for k in range(n)], bounds, wanted, False)

        return some.mapInArrow(cut, PIECES)

    return Ranges(n, [bytes(r["ngram"]) for r in found if r["ngram"] is not None], sum(r["n"] or 0 for r in found), range_rows,
                  lines.sparkSession.sparkContext.defaultParallelism, pieces)


def without(ranges: Ranges, known: DataFrame, col: str, sample: list[bytes], total: int) -> Ranges:
    """``ranges`` less the values of ``col`` (``total`` or fewer), whose sample counts for the bounds too.

    Values that are no n-grams of as many words are left out, as they are in no range."""
    n = ranges.n
    some = known.where(F.col(col).isNotNull()).select(F.col(col).cast("binary").alias("ngram"))

    def pieces(bounds: list[bytes], wanted: range) -> DataFrame:
        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def chunks() -> Iterator[pa.Array]:
                some, held = [], 0
                for batch in batches:
                    values = batch.column("ngram")
                    some.append(values.filter(pc.and_(pc.equal(pc.count_substring(values, b" "), n - 1), pc.equal(pc.count_substring(values, b"\n"), 0))))
                    held += some[-1].nbytes
                    if held >= KNOWN_BYTES:
                        yield pa.concat_arrays(some)
                        some, held = [], 0
                if held:
                    yield pa.concat_arrays(some)

            for values in chunks():
                body = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), b" ")[0].as_py() + b" "
                ends = np.flatnonzero(np.frombuffer(body, dtype=np.uint8) == 0x20)
                offsets = np.zeros(len(ends) + 1, dtype=np.int32)
                offsets[1:] = ends - np.arange(len(ends))
                coded = _token_array(offsets, body.translate(None, b" ")).dictionary_encode()
                yield from _pieces(coded.dictionary, list(coded.indices.to_numpy().reshape(-1, n).T), bounds, wanted, True)

        part = some
        if wanted.start:
            part = part.where(F.col("ngram") >= F.lit(bytearray(bounds[wanted.start - 1])))
        if wanted.stop <= len(bounds):
            part = part.where(F.col("ngram") < F.lit(bytearray(bounds[wanted.stop - 1])))
        return ranges.cut(bounds, wanted).unionByName(part.mapInArrow(cut, PIECES))

    return replace(ranges, sample=[*ranges.sample, *sample], total=ranges.total + total, cut=pieces)


def merged_values(ranges: Ranges) -> DataFrame:
    """``(ngram)``, distinct."""
    n = ranges.n

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pieces in _each_range(batches):
            words, codes = _merged(pieces, n)
            for at in range(0, len(codes[0]), PIECE_ROWS):
                yield pa.RecordBatch.from_arrays([_grams(words, [some[at:at + PIECE_ROWS] for some in codes])], names=["ngram"])

    bounds = ranges.bounds()
    dealt = ranges.cut(bounds, range(len(bounds) + 1)).repartition(max(2, len(bounds) + 1), "ngram_range")
    return dealt.sortWithinPartitions("ngram_range").mapInArrow(rows, "ngram string")


def merged_pieces(ranges: Ranges) -> Iterator[DataFrame]:
    """``SORTED_PIECES``: the distinct n-grams of each range in order, packed; ``place`` is that of a piece's first one in its range.

    A frame for each pass, to be stored before the next one is."""
    n = ranges.n

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, pieces in _each_range(batches):
            words, codes = _merged(pieces, n)
            lined, codec = _lined(words), _codec()
            for at in range(0, len(codes[0]), PIECE_ROWS):
                some = [part[at:at + PIECE_ROWS] for part in codes]
                size, packed = _packed(lined, some, codec)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r], pa.int32()), pa.array([at]), pa.array([len(some[0])]), pa.array([size]), pa.array([packed], pa.binary())],
                    names=["ngram_range", "place", "n", "size", "packed"])

    bounds = ranges.bounds()
    count = len(bounds) + 1
    passes = min(count, PASSES if ranges.total > PASS_ROWS else 1)
    for i in range(passes):
        wanted = range(count * i // passes, count * (i + 1) // passes)
        dealt = ranges.cut(bounds, wanted).repartitionById(len(wanted), F.col("ngram_range") - wanted.start)
        yield dealt.sortWithinPartitions("ngram_range").mapInArrow(rows, SORTED_PIECES)


def numbered_values(pieces: DataFrame, n: int, col: str, id_col: str) -> DataFrame:
    """``(col, id_col)`` of pieces ``(start, size, packed)``: their n-grams, numbered from ``start``."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec()
        for batch in batches:
            for start, size, packed in zip(*(batch.column(c).to_pylist() for c in ("start", "size", "packed")), strict=True):
                words = _unpacked(size, packed, codec)
                m = len(words) // n
                grams = pc.binary_join_element_wise(*(words.slice(k * m, m) for k in range(n)), b" ").view(pa.string())
                yield pa.RecordBatch.from_arrays([grams, pa.array(np.arange(start, start + m))], names=[col, id_col])

    return pieces.select("start", "size", "packed").mapInArrow(rows, f"`{col}` string, `{id_col}` bigint")
