"""What tasks find in whole texts, in Arrow batches: counts of their tokens, and places that may match a query.

The joins of :mod:`corpusprobe.operators.occurrences` stay exact; here tasks only drop
what has no partner, before a row is made of it. A place is a space (the start and
the end of a text count as one) with the bytes beside it, or a gram in a token. Its
hash is asked for in a sieve of the queries' hashes. Bytes beside a space are compared
in a few sizes: the largest that fits a query's own text on either side.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, ByteType, IntegerType, LongType, StructField, StructType

from corpusprobe.operators.sieves import Bits, Sieve

CHUNK_BYTES = 4 * 1024 * 1024   # of texts looked at together
TALLY_BYTES = 16 * 1024 * 1024  # of texts whose tokens are counted together
LEFT = (0, 1, 2, 4, 8)          # bytes before a space that are compared
RIGHT = (0, 1, 2, 4, 8, 16)     # and after it

_BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f", b" " * 9)
_WIDE_BLANKS = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)   # masks of a word's first bytes
_HIGH = ~_LOW[::-1]                                                      # of its last ones


def text_chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """The values of a binary column, about ``size`` bytes together, each time with the place of the first; null is empty.

    Bytes that are no UTF-8 are replaced, as where Spark splits strings."""
    some, held, at = [], 0, 0
    for i, value in enumerate(column):
        some.append(value.as_py() or b"")
        held += len(some[-1])
        if held >= size:
            yield at, _valid(some)
            some, held, at = [], 0, i + 1
    if some:
        yield at, _valid(some)


def _valid(some: list[bytes]) -> list[bytes]:
    try:
        b" ".join(some).decode()
    except UnicodeDecodeError:
        return [x.decode("utf-8", "replace").encode() for x in some]
    return some


# ------------------------------------------------------------------ tokens

def spaced_tokens(some: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The tokens of some texts, as :func:`corpusprobe.functions.text.space_pieces` cuts them, and where each text's end among them."""
    data = b" ".join([b"", *some, b""])
    spaces = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 0x20)
    offsets = np.zeros(len(spaces), dtype=np.int32)
    np.cumsum(np.diff(spaces) - 1, out=offsets[1:])
    return _token_array(offsets, data.translate(None, b" ")), np.searchsorted(spaces, np.cumsum([len(x) + 1 for x in some]))


def ws_token_array(some: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The same for :func:`corpusprobe.functions.text.ws_tokens`."""
    data = b"\xff".join([b" ", *some, b""]).translate(_BLANKS)
    if not all(map(bytes.isascii, some)):
        for start in sorted({blank[:-1] for blank in _WIDE_BLANKS}):
            if start in data:
                for blank in _WIDE_BLANKS:
                    data = data.replace(blank, b" ") if blank.startswith(start) else data
    raw = np.frombuffer(data, dtype=np.uint8)
    ends = np.flatnonzero(raw == 0xFF)[1:]     # no byte of a text
    blank = (raw == 0x20) | (raw == 0xFF)
    turns = np.flatnonzero(blank[1:] != blank[:-1])  # before starts and before ends take turns
    offsets = np.zeros(len(turns) // 2 + 1, dtype=np.int32)
    np.cumsum(turns[1::2] - turns[::2], out=offsets[1:])
    return _token_array(offsets, data.translate(None, b" \xff")), np.searchsorted(turns[::2], ends)


def _token_array(offsets: np.ndarray, flat: bytes) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def token_tally(texts: DataFrame, text: Column, tokens_of: Callable[[list[bytes]], tuple[pa.Array, np.ndarray]]) -> DataFrame:
    """``(token, n)``: how often the tokens of ``text`` occur; null texts have none.

    Tasks count those of ``TALLY_BYTES`` of texts at a time, which absorbs hot tokens."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, some in text_chunks(batch.column("text"), TALLY_BYTES):
                tokens, n = tokens_of(some)[0].value_counts().flatten()
                yield pa.RecordBatch.from_arrays([tokens, n], names=["token", "n"])

    some = texts.select(text.cast("binary").alias("text")).where(F.col("text").isNotNull())
    return (some.mapInArrow(rows, "token binary, n bigint").groupBy(F.col("token").cast("string").alias("token"))
            .agg(F.sum("n").cast("bigint").alias("n")))


# ------------------------------------------------------------------ hashes

def _mixed(code, *words: np.ndarray) -> np.ndarray:
    """Hashes, signed as Spark's, of words of eight bytes and a small number."""
    h = np.uint64(code) + np.uint64(_MIX[1])
    for w in words:
        h = (w ^ h) * np.uint64(_MIX[0])
        h ^= h >> np.uint64(32)
    h *= np.uint64(_MIX[1])
    h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``data``, as one number."""
    return np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))


def _edge_hash(left: int | None, right: int, before: np.ndarray, after: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Of so many bytes on either side of a space; of those after it alone, if ``left`` is None."""
    n = RIGHT[right]
    code = right + len(RIGHT) * (0 if left is None else left + 1)
    sides = [after & _LOW[min(n, 8)]]
    if n > 8:
        sides.append(later & _LOW[n - 8])
    if left:
        sides.append(before & _HIGH[LEFT[left]])
    return _mixed(code, *sides)


# ------------------------------------------------------------------ places beside spaces

def edge_hashes(edges: DataFrame) -> DataFrame:
    """``(l, r, h)`` of ``(left, right)``, the bytes that a match has before and after a space: the sizes compared and the hashes."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [(x or b"")[-8:] for x in batch.column("left").to_pylist()]
            right = [(x or b"")[:16] for x in batch.column("right").to_pylist()]
            before = np.frombuffer(b"".join(x.rjust(8, b"\0") for x in left), "<u8")
            after, later = np.frombuffer(b"".join(x.ljust(16, b"\0") for x in right), "<u8").reshape(-1, 2).T
            ls = np.array([bisect_right(LEFT, len(x)) - 1 for x in left], dtype=np.int8)
            rs = np.array([bisect_right(RIGHT, len(x)) - 1 for x in right], dtype=np.int8)
            for l, r in sorted(set(zip(ls.tolist(), rs.tolist(), strict=True))):
                at = np.flatnonzero((ls == l) & (rs == r))
                h = np.unique(np.concatenate([_edge_hash(x, r, before[at], after[at], later[at]) for x in (None, l)]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), l, np.int8)), pa.array(np.full(len(h), r, np.int8)), pa.array(h)],
                                                 names=["l", "r", "h"])

    both = edges.select(F.col("left").cast("binary").alias("left"), F.col("right").cast("binary").alias("right"))
    return both.mapInArrow(rows, "l tinyint, r tinyint, h bigint")


def _matching_spaces(data: np.ndarray, spaces: np.ndarray, sizes: dict[int, list[int]], bits: Bits) -> np.ndarray:
    """Which of ``spaces`` may have a query's bytes beside them."""
    found = np.zeros(len(spaces), dtype=bool)
    words = _words(data)
    for at in range(0, len(spaces), 1 << 17):
        some = spaces[at:at + (1 << 17)]
        before, after, later = words[some - 8], words[some + 1], words[some + 9]
        for r, ls in sizes.items():
            near = np.flatnonzero(bits.has(_edge_hash(None, r, before, after, later)))
            for l in ls:
                found[at + near[bits.has(_edge_hash(l, r, before[near], after[near], later[near]))]] = True
    return found


def runs_near(texts: DataFrame, edges: DataFrame, n_keys: int, max_bytes: int, after: int) -> DataFrame | None:
    """``(doc_id, start, run)``: the pieces of texts, cut on the space, around places that may match one of ``edges``.

    A run holds the piece before such a place and ``after`` pieces from it on, more where such
    places are close: no two runs of a text share a piece. ``start`` is the first one's number
    in its text. None, if not even a small sieve may be sent."""
    hashes = edge_hashes(edges).checkpoint()
    sieve = Sieve.of(hashes, n_keys, max_bytes)
    if sieve is None:
        return None
    bits, sizes = sieve.bits, {}
    for row in hashes.select("l", "r").distinct().collect():
        sizes.setdefault(row["r"], []).append(row["l"])
    schema = StructType([texts.schema["doc_id"], StructField("start", IntegerType()), StructField("run", BinaryType())])

    def cut(ids: pa.Array, some: list[bytes]) -> pa.RecordBatch | None:
        raw = b"".join([b"\0" * 8, b" ", b" ".join(some), b" ", b"\0" * 24])
        data = np.frombuffer(raw, dtype=np.uint8)
        spaces = np.flatnonzero(data == 0x20)            # piece g follows the space g
        n = len(spaces) - 1
        found = np.flatnonzero(_matching_spaces(data, spaces[:-1], sizes, bits))
        if not len(found):
            return None
        ends = np.cumsum([len(x) + 1 for x in some])
        first = np.searchsorted(spaces, 8 + ends - [len(x) + 1 for x in some])   # each text's first piece
        turns = np.zeros(n + 1, dtype=np.int64)
        np.add.at(turns, np.maximum(found - 1, 0), 1)
        np.add.at(turns, np.minimum(found + after, n), -1)
        kept = np.cumsum(turns[:-1]) > 0
        own = np.zeros(n + 1, dtype=bool)
        own[first] = own[n] = True
        begins = np.flatnonzero(kept & (own[:-1] | ~np.concatenate([[False], kept[:-1]])))
        stops = np.flatnonzero(kept & (own[1:] | ~np.concatenate([kept[1:], [False]])))
        doc = np.searchsorted(first, begins, "right") - 1
        runs = [raw[a:b] for a, b in zip((spaces[begins] + 1).tolist(), spaces[stops + 1].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array((begins - first[doc]).astype(np.int32)), pa.array(runs, pa.binary())],
                                          names=schema.names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in text_chunks(batch.column("text")):
                made = cut(batch.column("doc_id").slice(at, len(some)), some)
                if made is not None:
                    yield made

    return texts.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(rows, schema)


# ------------------------------------------------------------------ grams in tokens

def _gram_hashes(some: list[bytes], lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each gram length: the tokens that have one, its first character's number (from 0) and its hash."""
    data = np.frombuffer(b"".join([*some, b"\0" * 24]), dtype=np.uint8)
    ends = np.cumsum([len(x) for x in some], dtype=np.int64)
    starts = np.flatnonzero((data[:ends[-1]] & 0xC0) != 0x80)      # of characters
    token = np.searchsorted(ends, starts, "right")
    first = np.searchsorted(starts, np.concatenate([[0], ends[:-1]]))
    nth = np.arange(len(starts)) - first[token]
    bound = np.append(starts, ends[-1])
    words = _words(data)
    for a in lengths:
        ok = np.flatnonzero(token[:len(starts) - a + 1] == token[a - 1:]) if len(starts) >= a else np.zeros(0, dtype=np.int64)
        at = starts[ok]
        size = bound[ok + a] - at
        low, high = _LOW[np.minimum(size, 8)], _LOW[np.maximum(size - 8, 0)]
        yield a, token[ok], nth[ok], _mixed(a, words[at] & low, words[at + 8] & high)


def gram_hashes(grams: DataFrame) -> DataFrame:
    """``grams`` (a, key and other columns) with ``h``, the hash that :func:`token_grams` gives such a gram."""
    schema = StructType([*grams.schema.fields, StructField("h", LongType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("a").to_numpy()
            keys = [x.encode() for x in batch.column("key").to_pylist()]
            h = np.zeros(len(keys), dtype=np.int64)
            for a in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == a)
                h[at] = next(_gram_hashes([keys[i] for i in at], [a]))[3]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h)], names=schema.names)

    return grams.mapInArrow(rows, schema)


def _kept_grams(tokens: list[bytes], lengths: list[int], bits: Bits | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for _, token, nth, h in _gram_hashes(tokens, lengths):
        if bits is not None:
            at = np.flatnonzero(bits.has(h))
            token, nth, h = token[at], nth[at], h[at]
        yield token, nth, h


def gram_places(vocab: DataFrame, lengths: list[int], sieve: Sieve | None) -> DataFrame:
    """``(h, places)``: the places in the tokens ``tok`` of the grams in ``sieve``."""
    bits = None if sieve is None else sieve.bits

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, some in text_chunks(batch.column("tok")):
                for _, _, h in _kept_grams(some, lengths, bits):
                    h, n = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], names=["h", "places"])

    counts = vocab.select(F.col("tok").cast("binary").alias("tok")).mapInArrow(rows, "h bigint, places bigint")
    return counts.groupBy("h").agg(F.sum("places").alias("places"))


def token_grams(vocab: DataFrame, lengths: list[int], sieve: Sieve | None) -> DataFrame:
    """``vocab`` with a row for each place ``i`` (from 1) of a gram in ``sieve`` in its tokens ``tok``, and the gram's hash ``h``."""
    bits = None if sieve is None else sieve.bits
    schema = StructType([*vocab.schema.fields, StructField("i", IntegerType()), StructField("h", LongType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in text_chunks(batch.column("tok").cast(pa.binary())):
                part = batch.slice(at, len(some))
                for token, nth, h in _kept_grams(some, lengths, bits):
                    for n in range(0, len(h), 1 << 16):
                        own = part.take(pa.array(token[n:n + (1 << 16)]))
                        yield pa.RecordBatch.from_arrays([*own.columns, pa.array((nth[n:n + (1 << 16)] + 1).astype(np.int32)), pa.array(h[n:n + (1 << 16)])],
                                                         names=schema.names)

    return vocab.mapInArrow(rows, schema)
