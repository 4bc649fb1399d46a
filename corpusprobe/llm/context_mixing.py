"""Language-model scores by logistic context mixing.

A text is read as its words, each followed by a space, then one end byte; the
bytes are coded bit by bit. Five predictors give each bit a probability: the
previous two, three and four bytes with the text's class (hashed contexts), the
word so far, and the word so far with the class. Their stretched
probabilities ``ln(n1 / n0)`` are mixed by weights that a gate picks (how often
the word so far was seen, whether it always went on alike, place in the word and in
the byte), squashed, and refined by an adaptive map from (byte so far, mixed probability) to the frequency seen
there; the result is the mean of the mixed and the refined probability.
``score`` is the sum of log10 of all bits, ``bits_per_byte`` the same per byte.

A text's class at a word is the group of frequent words that had the most
votes before it. The groups are learned from which of ``TRACKED`` words stand in the
same documents, by spectral clustering; in mixed corpora they are languages.

What is learned comes from the whole training part and grows with it:

* units (class, word) are counted in one shuffle. They are dealt to buckets of
  about ``BUCKET_UNITS`` by their first bytes, all units with one beginning
  together. Sorted, the units that share a beginning stand in a row, so the
  exact counts of every word so far are sums over runs: no table of them is
  made, sent or cut. A beginning with more than ``MAX_GROUP`` units is split by
  more of its bytes, and its shorter contexts use the four-byte counts instead;
* the hashed contexts' counts are summed over all units into tables sized by the
  number of units (up to ``MAX_BITS`` bits; then contexts share cells);
* mixing weights are learned online: in each bucket, bit place by bit place, units in a
  fixed mixed order, by Newton steps on the coding cost, chunk by chunk. An occurrence does
  not see itself (one is taken off its counts). The buckets' weights are joined by their curvatures. Buckets depend on the data alone,
  so scores are the same on any number of partitions. Units of a class with the same bits so far
  are one node with one set of predictions; a node, not each of its units, is learned and scored.

The unigram base is exact. Scores and counts of the ``TOP_UNITS`` most frequent
units (a bounded table) are looked up in the tasks, all others by a join.

Defined results: null and empty texts have the end token alone; repeated rows
are scored (and learned from) each; null ids count as held out (crc32 of the
empty text is 0); words of ``PIECE`` bytes and more are coded in pieces; without training tokens base scores are those
of V = N = 0 and all contexts are empty; an empty table gives an empty result;
extra columns of the input don't matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, WordHashes, bucket_of, scratch_table, text_bytes

HELD_OUT_MOD = 10
ADD = 0.1
END = b"\n"
#: Words whose company tells the class of a text, and groups of them.
TRACKED, CLASSES = 256, 6
#: Codes of units: the class; a piece that goes on with a long word; a long word (for the base alone).
GOES_ON, LONG, UNIT_CODES = 8, 24, 32
PIECE = 64
ORDERS = 5
MAX_BITS = 22
#: Units of a bucket, most units with one beginning, and the lengths of beginnings.
BUCKET_UNITS = 200_000
MAX_GROUP = 1_000_000
BEGINNINGS = (3, 12, 40)
#: Occurrences of the word so far at which the next set of weights starts.
SEEN_STEPS = np.array([1, 2, 4, 16, 64, 512], dtype=np.float32)
GATES = (len(SEEN_STEPS) + 1) * 2 * 64
MAP_CELLS = 33
FIRST_WEIGHTS = np.array([0.0, 0.1, 0.2, 0.2, 0.5])
RIDGE = 100.0
#: Bits between two Newton steps, and the most that a step changes a weight.
MIX_CHUNK, MIX_STEP = 65_536, 0.5
TOP_UNITS = 1_000_000
#: Bytes of text whose units are counted, and scored, at once.
COUNT_CHUNK, TEXT_CHUNK = 4_000_000, 4_000_000
#: Texts whose tracked words are matched at once.
COMPANY_TEXTS = 1024
#: A chunk first tells only the words in one of so many of its texts; most words that may be counted once more by name.
TOLD_PART, COUNTED_AGAIN = 64, 100_000

_U = np.uint64
_SEEDS = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
_MIX = _U(0xFF51AFD7ED558CCD)
_f4 = np.float32
#: A-Z become a-z, white space becomes a space.
_LOWER = bytes(0x20 if chr(b) in SPACE_CHARS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Equal leading bits of two bytes, by their exclusive or.
_EQUAL_BITS = np.array([8 - x.bit_length() for x in range(256)])


# ------------------------------------------------------------------ texts to units

class FreshHashes:
    """:class:`WordHashes` that remember nothing, for words that are asked for once."""

    __getitem__ = staticmethod(xxhash.xxh3_64_intdigest)


def byte_strings(column: pa.Array) -> list[bytes]:
    """``to_pylist`` of a binary column without nulls; that makes an Arrow scalar of each value first."""
    column = column.cast(pa.binary())
    if not len(column):
        return []
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[column.offset:column.offset + len(column) + 1].tolist()
    raw = data.slice(ends[0], ends[-1] - ends[0]).to_pybytes() if data is not None else b""
    return [raw[a - ends[0]:b - ends[0]] for a, b in zip(ends, ends[1:], strict=False)]


def chunk_tokens(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The tokens of some texts, and which are ``END``, the last token of each text.

    The same words as :func:`~corpusprobe.llm.common.space_words`, without an object for each token."""
    data = b" " + b"".join([raw.translate(_LOWER) + b" \n " for raw in texts])
    inside = np.frombuffer(data, dtype=np.uint8) != 0x20
    turns = np.flatnonzero(inside[1:] != inside[:-1])  # starts and ends take turns
    offsets = np.zeros(len(turns) // 2 + 1, dtype=np.int32)
    np.cumsum(turns[1::2] - turns[::2], out=offsets[1:])
    flat = data.translate(None, b" ")
    end = np.frombuffer(flat, dtype=np.uint8)[offsets[:-1]] == END[0]  # no word has that byte
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(flat)]), end


def token_table(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some texts, and of each token its word and its text."""
    tokens, end = chunk_tokens(texts)
    coded = tokens.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.cumsum(end) - end


def word_list(words: pa.Array) -> list[bytes]:
    """:func:`byte_strings` of words, which hold no space."""
    if not len(words):
        return []
    ends = pa.array([0, len(words)], pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(ends, words), b" ")[0].as_py().split(b" ")


def chunk_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """:func:`token_table` with a list of the words."""
    words, index, of = token_table(texts)
    return word_list(words), index, of


def token_classes(groups: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """The class at each word: the group (from 1) with the most votes before it in its text (``of``; None: all one text),
    the lower one if level; 0 without votes."""
    of = np.zeros(len(groups), dtype=np.int64) if of is None else of
    voted = groups > 0
    before, of_vote, votes = np.cumsum(voted) - voted, of[voted], groups[voted]
    first = np.searchsorted(of_vote, np.arange(of[-1] + 1 if len(of) else 0))
    best, most = np.zeros(len(votes) + 1, dtype=np.int64), np.zeros(len(votes), dtype=np.int32)
    for k in range(1, CLASSES + 1):
        so_far = np.zeros(len(votes) + 1, dtype=np.int32)
        np.cumsum(votes == k, out=so_far[1:])
        here = so_far[1:] - so_far[first][of_vote]
        more = here > most
        best[:-1][more] = k
        np.maximum(most, here, out=most)
    return np.where(before > first[of], best[before - 1], 0)


def pieces_of(word: bytes) -> list[bytes]:
    """A long word in pieces of ``PIECE`` bytes, the last one with its space."""
    whole = len(word) - len(word) % PIECE
    return [*(word[i:i + PIECE] for i in range(0, whole, PIECE)), word[whole:] + b" "]


def unit_keys(ids: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """64-bit keys of units from the hash of their text (a word's without its space) and their code."""
    h = (ids ^ (codes.astype(np.uint64) * _SEEDS[0])) * _MIX
    return h ^ (h >> _U(31))


def is_word(unit: bytes, code: int) -> bool:
    """Whether a unit stands for a token of the base."""
    return code == LONG or code < GOES_ON and unit[-1:] in (b" ", END)


class Texts:
    """The units of some texts: arrays of their words (places in ``names``), keys, codes, text numbers, coded bytes and whether
    they are words of the base, and ``tokens`` by text. A long word gives its pieces, and itself once more."""

    def __init__(self, texts: list[bytes], hashes: WordHashes, tracked: tuple[np.ndarray, np.ndarray]):
        self.words, self.index, self.of = token_table(texts)
        self.hashes, self.plain, self.places = hashes, len(self.words), {}
        self.tokens = np.bincount(self.of, minlength=len(texts))
        sizes = pc.binary_length(self.words).to_numpy().astype(np.int64)
        tracked_at = pc.fill_null(pc.index_in(self.words, value_set=tracked[0]), -1).to_numpy()
        group = np.append(tracked[1], 0)[tracked_at]
        self.codes = token_classes(group[self.index], self.of)
        sizes_coded, self.end = sizes + 1, self.index[-1] if len(self.index) else -1
        sizes_coded[self.end:self.end + 1] = len(END)
        self.size = sizes_coded[self.index]
        self.word = np.ones(len(self.index), dtype=bool)
        long = np.flatnonzero((sizes >= PIECE)[self.index])
        if len(long):
            more, places = [], self.places
            for i in long.tolist():
                code, pieces = int(self.codes[i]), pieces_of(self.names[self.index[i]])
                more += [(places.setdefault(u, self.plain + len(places)), code + GOES_ON * (k > 0), self.of[i], len(u), False)
                         for k, u in enumerate(pieces)]
            self.codes[long], self.size[long] = LONG, 0
            self.index, self.codes, self.of, self.size, self.word = (np.concatenate([x, np.array([m[k] for m in more], dtype=x.dtype)])
                for k, x in enumerate((self.index, self.codes, self.of, self.size, self.word)))
            del self.names

    @cached_property
    def names(self) -> list[bytes]:
        return word_list(self.words) + list(self.places)

    @cached_property
    def ids(self) -> np.ndarray:
        return np.fromiter(map(self.hashes.__getitem__, self.names), dtype=np.uint64, count=len(self.names))

    @property
    def keys(self) -> np.ndarray:
        return unit_keys(self.ids[self.index], self.codes)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word and code of the distinct units, and the one that each unit is."""
        both = self.index * UNIT_CODES + self.codes
        here = np.bincount(both) > 0
        own = np.flatnonzero(here)
        return own // UNIT_CODES, own % UNIT_CODES, (np.cumsum(here) - 1)[both]

    def texts(self, name: np.ndarray, code: np.ndarray) -> pa.Array:
        """The coded texts of units, by their words and codes."""
        words = pa.concat_arrays([self.words, pa.array(list(self.places), pa.binary())]).take(pa.array(name))
        spaced = (name < self.plain) & (code != LONG) & (name != self.end)
        return pc.binary_join_element_wise(words, pa.array([b"", b" "], pa.binary()).take(pa.array(spaced.astype(np.int8))), b"")

    def unit(self, i: int) -> bytes:
        return self.texts(self.index[i:i + 1], self.codes[i:i + 1])[0].as_py()


def text_chunks(batches: Iterator[pa.RecordBatch], size: int, *columns: str) -> Iterator[tuple[list[bytes], list[list]]]:
    """Texts of about ``size`` bytes together, and the values of other columns."""
    texts, others, n = [], [[] for _ in columns], 0
    for batch in batches:
        for raw, *values in zip(text_bytes(batch), *(batch.column(c).to_pylist() for c in columns), strict=True):
            texts.append(raw)
            for have, value in zip(others, values, strict=True):
                have.append(value)
            n += len(raw) + 1
            if n >= size:
                yield texts, others
                texts, others, n = [], [[] for _ in columns], 0
                pa.default_memory_pool().release_unused()  # a worker keeps what Arrow doesn't give back
    if texts:
        yield texts, others
        texts.clear()
        pa.default_memory_pool().release_unused()


def tracked_hashes(groups: dict[bytes, int]) -> tuple[pa.Array, np.ndarray]:
    """The tracked words and their groups."""
    return pa.array(list(groups), pa.binary()), np.array(list(groups.values()), dtype=np.int64)


def _trained(docs: DataFrame) -> DataFrame:
    return docs.where(bucket_of(F.col("doc_id"), HELD_OUT_MOD) != 0).select("doc_id", "text")


def texts_with(place: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
    """In how many texts (``of``, rising) each of ``size`` words stands, by the word of each token; -1: another word."""
    of, place = of[place >= 0], place[place >= 0]
    order = np.argsort(place.astype(np.uint16) if size <= 1 << 16 else place, kind="stable")
    place, of = place[order], of[order]
    new = np.ones(len(place), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (of[1:] != of[:-1])
    return np.bincount(place[new], minlength=size)


def word_texts(docs: DataFrame, part: int | None, among: list[bytes] | None = None) -> DataFrame:
    """``word``, ``n``, ``known``: in how many training documents words stand, as far as their chunks tell it.

    A chunk tells the words in at least one of ``part`` of its texts (None: all words), or those ``among`` some. Of another word
    it may hold fewer than that least number less one; ``known`` sums these over the chunks that told a word, and the null word
    has their sum over all chunks. A word with as much is counted exactly."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, _ in text_chunks(batches, COUNT_CHUNK):
            words, index, of = token_table(texts)
            least = 1 if part is None else max(1, len(texts) // part)
            asked = np.bincount(index, minlength=len(words)) >= least
            asked[index[-1]] = False  # END
            if among is not None:
                asked &= pc.is_in(words, value_set=pa.array(among, pa.binary())).to_numpy(zero_copy_only=False)
            place = np.where(asked, np.cumsum(asked) - 1, -1)
            n = texts_with(place[index], of, int(asked.sum()))
            told = words.take(pa.array(np.flatnonzero(asked)[n >= least]))
            n = n[n >= least]
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([told, pa.nulls(1, pa.binary())]), pa.array(np.append(n, 0)), pa.array(np.full(len(n) + 1, least - 1))],
                names=["word", "n", "known"])

    counts = _trained(docs).select("text").mapInArrow(rows, "word binary, n long, known long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("known").alias("known"))


def tracked_words(docs: DataFrame) -> list[bytes]:
    """The words that stand in most training documents.

    Exactly those, without moving every word: chunks tell their frequent words, and a word whose untold rest could bring it among
    the first is counted once more. Where that can't be told, all words are counted."""
    def first(found: DataFrame) -> list:
        return found.where("word is not null").orderBy(F.desc("n"), "word").limit(TRACKED).collect()

    told = scratch_table(word_texts(docs, TOLD_PART), "lm-frequent")
    top, every = first(told), told.where("word is null").first()
    if every is None:
        return []
    untold = every["known"]
    if untold:
        least = top[-1]["n"] if len(top) == TRACKED else 0
        close = told.where("word is not null").where(F.col("n") + untold - F.col("known") >= least)
        again = [bytes(r["word"]) for r in close.select("word").limit(COUNTED_AGAIN + 1).collect()]
        if untold >= least or len(again) > COUNTED_AGAIN:
            top = first(word_texts(docs, None))
        elif close.where(F.col("known") < untold).limit(1).count():
            top = first(word_texts(docs, None, again))
    return [bytes(r["word"]) for r in top]


def company(docs: DataFrame, tracked: list[bytes]) -> np.ndarray:
    """In how many training documents each two tracked words stand."""
    size = len(tracked)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size), dtype=np.int64)
        for texts, _ in text_chunks(batches, COUNT_CHUNK):
            tokens, end = chunk_tokens(texts)
            at = pc.fill_null(pc.index_in(tokens, value_set=pa.array(tracked, pa.binary())), -1).to_numpy()
            of, at = (np.cumsum(end) - end)[at >= 0], at[at >= 0]
            for first in range(0, len(texts), COMPANY_TEXTS):
                i, j = np.searchsorted(of, [first, first + COMPANY_TEXTS])
                stand = np.zeros((COMPANY_TEXTS, size), dtype=_f4)
                stand[of[i:j] - first, at[i:j]] = 1
                total += (stand.T @ stand).astype(np.int64)
        a, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[a, b])],
                                         names=["a", "b", "n"])

    found = _trained(docs).select("text").mapInArrow(rows, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((size, size))
    out[found["a"].to_numpy(), found["b"].to_numpy()] = found["n"].to_numpy()
    return out


def word_groups(tracked: list[bytes], together: np.ndarray) -> dict[bytes, int]:
    """Groups (from 1) of the tracked words, by spectral clustering of the company they keep."""
    if len(tracked) <= CLASSES:
        return dict.fromkeys(tracked, 1)
    near = together / np.sqrt(np.outer(together.diagonal(), together.diagonal()))
    near /= np.sqrt(np.outer(near.sum(axis=1), near.sum(axis=1)))
    values, vectors = np.linalg.eigh(near)
    x = vectors[:, np.argsort(-values)[:CLASSES]]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centres = [int(together.diagonal().argmax())]
    while len(centres) < CLASSES:  # the word farthest from all so far
        centres.append(int((x @ x[centres].T).max(axis=1).round(9).argmin()))
    means = x[centres]
    for _ in range(30):
        of = (x @ means.T).round(9).argmax(axis=1)
        means = np.stack([x[of == k].mean(axis=0) if (of == k).any() else means[k] for k in range(CLASSES)])
        means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
    return {w: int(k) + 1 for w, k in zip(tracked, of, strict=True)}


def count_units(docs: DataFrame, groups: dict[bytes, int]) -> DataFrame:
    """``unit``, ``code``, ``n``: all units and how often they occur in training documents."""
    tracked = tracked_hashes(groups)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, (learn,) in text_chunks(batches, COUNT_CHUNK, "learn"):
            some = Texts(texts, FreshHashes(), tracked)
            name, code, which = some.distinct()
            n = np.bincount(which, weights=np.array(learn, dtype=float)[some.of]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([some.texts(name, code), pa.array(code.astype(np.int32)), pa.array(n)],
                                             names=["unit", "code", "n"])

    every = docs.select("text", (bucket_of(F.col("doc_id"), HELD_OUT_MOD) != 0).alias("learn"))
    found = every.mapInArrow(count, "unit binary, code int, n long").groupBy("unit", "code").agg(F.sum("n").alias("n"))
    return scratch_table(found, "lm-units")


def dealt_units(units: DataFrame) -> DataFrame:
    """``units`` with ``bucket`` and ``depth``: the length of the beginning that its bucket holds whole.

    Crowded beginnings are counted level by level; there are fewer than units / MAX_GROUP of them."""
    spark, n = units.sparkSession, units.count()
    units = units.withColumn("depth", F.lit(BEGINNINGS[0]))
    for short, longer in zip(BEGINNINGS, BEGINNINGS[1:], strict=False):
        begin = F.expr(f"substring(unit, 1, {short})")
        crowded = units.where(F.col("depth") == short).groupBy(begin.alias("begin")).count().where(F.col("count") > MAX_GROUP)
        rows = [(r["begin"],) for r in crowded.collect()]
        if not rows:
            break
        units = units.withColumn("begin", begin).join(
            F.broadcast(spark.createDataFrame(rows, "begin binary").withColumn("many", F.lit(True))), "begin", "left").withColumn(
            "depth", F.when(F.col("many"), F.lit(longer)).otherwise(F.col("depth"))).drop("begin", "many")
    buckets = max(1, -(-n // BUCKET_UNITS))
    at = F.pmod(F.xxhash64(F.expr("substring(unit, 1, depth)")), F.lit(buckets)).cast("int")
    dealt = scratch_table(units.withColumn("bucket", at), "lm-buckets")
    return dealt.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "unit", "code")


# ------------------------------------------------------------------ a bucket's bits

class Bucket:
    """The sorted units of a bucket, bit column by bit column."""

    def __init__(self, units: list[bytes], codes: np.ndarray, n: np.ndarray, depth: np.ndarray):
        self.units, self.codes, self.n, self.depth = units, codes, n.astype(np.float64), depth
        self.sizes = np.array([len(u) for u in units], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(units), dtype=np.uint8)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """:func:`is_word` of all units, and which of these end with a space."""
        last = self.flat[self.starts + self.sizes - 1]
        word = (self.codes == LONG) | (self.codes < GOES_ON) & ((last == 0x20) | (last == END[0]))
        return word, word & (last == 0x20)

    def shared_bits(self, order: np.ndarray) -> np.ndarray:
        """Leading bits that each unit, in ``order``, shares with the one before (all of them: very many)."""
        out = np.zeros(len(order), dtype=np.int64)
        a, j = np.arange(1, len(order)), 0
        while len(a):
            left, right = order[a - 1], order[a]
            both = (self.sizes[left] > j) & (self.sizes[right] > j)
            out[a[~both]] = np.where((self.sizes[left] == j) & (self.sizes[right] == j), 1 << 40, 8 * j)[~both]
            a = a[both]
            differ = self.flat[self.starts[order[a - 1]] + j] ^ self.flat[self.starts[order[a]] + j]
            out[a[differ != 0]] = 8 * j + _EQUAL_BITS[differ[differ != 0]]
            a, j = a[differ == 0], j + 1
        return out

    def byte_columns(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Place, units that reach it, their byte there, and their three hashed contexts."""
        alive, j = np.arange(len(self.units)), 0
        code = self.codes.astype(np.uint64)
        back = [_U(256) + code] * 4
        while len(alive):
            byte = self.flat[self.starts[alive] + j]
            two = back[0] * _U(521) + back[1]
            three = two * _U(521) + back[2]
            four = three * _U(521) + back[3]
            context = np.stack([(c * _U(31) + code + _U(1)) * s for c, s in zip((two, three, four), _SEEDS, strict=True)])
            yield j, alive, byte.astype(np.int64), context ^ (context >> _U(29))
            keep = self.sizes[alive] > j + 1
            back = [byte.astype(np.uint64)[keep], *[x[keep] for x in back[:3]]]
            alive, code, j = alive[keep], code[keep], j + 1

    @cached_property
    def by_class(self) -> tuple[np.ndarray, np.ndarray]:
        """The units by class and text, and the leading bits that each shares with the one before in its class."""
        order = np.argsort(self.codes, kind="stable")
        shared = self.shared_bits(order)
        shared[np.flatnonzero(np.diff(self.codes[order], prepend=-1))] = -1
        return order, np.minimum(shared, 1 << 30).astype(np.int32)

    def class_columns(self) -> Iterator[tuple]:
        """For each place: the units that reach it, by class and text, and their groups: all units of a class that are alike so far,
        this byte included. Of the groups: the leading bits shared with the one before (-1: none, or a shorter unit between),
        occurrences, the byte, hashed contexts and where its first unit stands among ``alive``, the units by text."""
        order, shared = self.by_class
        at, stands = np.arange(len(order)), np.zeros(len(order), dtype=np.int64)
        for j, alive, byte, context in self.byte_columns():
            at = at[self.sizes[order[at]] > j]
            units = order[at]
            stands[alive] = np.arange(len(alive))
            gap = np.where(np.diff(at, prepend=-2) != 1, -1, shared[at])
            new = gap < 8 * j + 8
            first = np.flatnonzero(new)
            one = stands[units[first]]
            yield j, alive, byte, units, np.cumsum(new) - 1, gap[first], np.add.reduceat(self.n[units], first), byte[one], context[:, one], one

    def node_columns(self, bits: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, Iterator[tuple]]]:
        """For each place: its units and their groups, as in :meth:`class_columns`, and for each of its bits: the bit and the node of
        each group. All groups of a class with the same bits so far are one node: all predictors see the same there. Of the nodes:
        the byte so far, slots of the hashed contexts, zeros and ones after the word so far (without and with the class), whether
        the word so far is too short for this bucket to hold all that begin with it (None: nowhere), and the gate's part."""
        shared = np.minimum(self.shared_bits(np.arange(len(self.units))), 1 << 30).astype(np.int32)
        offsets = np.cumsum([0, *[1 << b for b in bits]])

        def runs(shared: np.ndarray, upto: int) -> tuple[np.ndarray, np.ndarray]:
            new = shared < upto
            return np.flatnonzero(new), np.cumsum(new) - 1

        for j, alive, byte, units, group, shared_class, n_class, byte_class, context, one in self.class_columns():
            gap = np.where(np.diff(alive, prepend=-2) != 1, -1, shared[alive])
            first, of_word = runs(gap, 8 * j + 8)
            shared_word, n_word, byte_word, of_word = gap[first], np.add.reduceat(self.n[alive], first), byte[first], of_word[one]
            low = j < self.depth[alive[one]] if j < BEGINNINGS[-1] else None

            def bit_nodes(j=j, shared_class=shared_class, n_class=n_class, byte_class=byte_class, context=context,
                          shared_word=shared_word, n_word=n_word, byte_word=byte_word, of_word=of_word, low=low) -> Iterator[tuple]:
                for k in range(8):
                    bit = (byte_class >> (7 - k)) & 1
                    start, run = runs(shared_class, 8 * j + k)
                    total_class, ones_class = (np.add.reduceat(w, start) for w in (n_class, n_class * bit))
                    start_word, run_word = runs(shared_word, 8 * j + k)
                    word = run_word[of_word[start]]
                    total, ones = (np.add.reduceat(w, start_word)[word] for w in (n_word, n_word * ((byte_word >> (7 - k)) & 1)))
                    node = (256 | byte_class[start]) >> (8 - k)
                    h = (context[:, start] + node.astype(np.uint64)) * _MIX
                    slots = np.stack([(h[i] >> _U(64 - b)).astype(np.int64) + offsets[i] for i, b in enumerate(bits)])
                    ones = np.stack([ones, ones_class])
                    yield (bit, run, node, slots, np.stack([total, total_class]) - ones, ones, None if low is None else low[start],
                           min(j, 7) * 8 + k)

            yield units, group, bit_nodes()

    def bit_columns(self, bits: tuple[int, ...]) -> Iterator[tuple]:
        """For each bit place: units that reach it, the bit, and what their nodes have in :meth:`node_columns`."""
        for units, group, nodes in self.node_columns(bits):
            for bit, run, node, slots, zeros, ones, low, place in nodes:
                at = run[group]
                yield units, bit[group], node[at], slots[:, at], zeros[:, at], ones[:, at], None if low is None else low[at], place


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[Bucket]:
    """The buckets of a task, from rows sorted by bucket and unit."""
    key, parts = None, []

    def whole() -> Bucket:
        units = [u for p in parts for u in p[0]]
        return Bucket(units, *(np.concatenate([p[i] for p in parts]) for i in (1, 2, 3)))

    for batch in batches:
        at = batch.column("bucket").to_numpy()
        turns = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)] if len(at) else [0]
        for a, b in zip(turns, turns[1:], strict=False):
            if key != at[a]:
                if parts:
                    yield whole()
                key, parts = at[a], []
            part = batch.slice(a, b - a)
            parts.append((byte_strings(part.column("unit")), *(part.column(c).to_numpy() for c in ("code", "n", "depth"))))
    if parts:
        yield whole()


def modelled(bucket: Bucket) -> Bucket:
    """A bucket without the long words, which only the base counts."""
    keep = np.flatnonzero(bucket.codes != LONG)
    if len(keep) == len(bucket.units):
        return bucket
    return Bucket([bucket.units[i] for i in keep], bucket.codes[keep], bucket.n[keep], bucket.depth[keep])


# ------------------------------------------------------------------ learning

def table_bits(n_units: int) -> tuple[int, int, int]:
    """Bits of the hashed contexts' tables, by the number of units."""
    most = min(max(16, (max(n_units, 1) - 1).bit_length() + 5), MAX_BITS)
    return most - 4, most - 1, most


def local_tables(bucket: Bucket, bits: tuple[int, ...], tables: np.ndarray) -> None:
    """Adds a bucket's bits to the hashed contexts' counts (a row of zeros and ones for each slot)."""
    offsets = np.cumsum([0, *[1 << b for b in bits]])
    flat = tables.reshape(-1)
    for *_, times, value, of, _ in bucket.class_columns():
        for k in range(8):
            h = (of + ((256 | value) >> (8 - k)).astype(np.uint64)) * _MIX
            bit = (value >> (7 - k)) & 1
            for i, b in enumerate(bits):
                np.add.at(flat, 2 * ((h[i] >> _U(64 - b)).astype(np.int64) + offsets[i]) + bit, times)


def context_tables(buckets: DataFrame, bits: tuple[int, ...]) -> np.ndarray:
    """Zeros and ones of all slots; at most a row a slot reaches the driver."""
    size = sum(1 << b for b in bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((size, 2))
        for bucket in _buckets(batches):
            local_tables(modelled(bucket), bits, tables)
        at = np.flatnonzero(tables.any(axis=1))
        for i in range(0, len(at), 100_000):
            a = at[i:i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(tables[a, 0]), pa.array(tables[a, 1])],
                                             names=["slot", "zeros", "ones"])

    found = buckets.mapInArrow(count, "slot int, zeros double, ones double").groupBy("slot").agg(
        F.sum("zeros").cast("float").alias("zeros"), F.sum("ones").cast("float").alias("ones")).toArrow()
    tables = np.zeros((size, 2), dtype=_f4)
    slot = found["slot"].to_numpy()
    tables[slot, 0], tables[slot, 1] = found["zeros"].to_numpy(), found["ones"].to_numpy()
    return tables


def stretched(tables: np.ndarray) -> np.ndarray:
    return np.log((tables[..., 1] + _f4(0.3)) / (tables[..., 0] + _f4(0.3)))


def inputs(tables: np.ndarray, ready: np.ndarray, slots: np.ndarray, zeros: np.ndarray, ones: np.ndarray, low, place: int,
           bit=None) -> tuple[np.ndarray, np.ndarray]:
    """Stretched probabilities of all predictors and the full gate; with ``bit`` given, one occurrence of it is left out.

    ``ready``: ``tables`` stretched, or None."""
    zeros, ones = zeros.astype(_f4), ones.astype(_f4)
    if low is not None and low.any():  # runs are not whole here: the four-byte context is the word so far
        zeros, ones = (np.where(low, tables[slots[2], i], x) for i, x in enumerate((zeros, ones)))
    if bit is None and ready is not None:
        hashed = ready[slots]
    else:
        cells = tables.view(np.result_type(tables.dtype, np.complex64))[:, 0].take(slots)  # zeros and ones at once
        none, some = cells.real, cells.imag
        if bit is not None:
            one, zero = bit.astype(_f4), (1 - bit).astype(_f4)
            none, some = np.maximum(none - zero, 0), np.maximum(some - one, 0)
            zeros, ones = np.maximum(zeros - zero, 0), np.maximum(ones - one, 0)
        hashed = np.log((some + _f4(0.3)) / (none + _f4(0.3)))
    alike = (zeros[1] == 0) | (ones[1] == 0)
    seen = np.searchsorted(SEEN_STEPS, zeros[1] + ones[1], side="right")
    return np.concatenate([hashed, np.log((ones + _f4(0.1)) / (zeros + _f4(0.1)))]), place + 64 * (2 * seen + alike)


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -16, 16)))


def mixed(weights: np.ndarray, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """``weights``: predictors by gates."""
    return sum(w[gate] * v for w, v in zip(weights, x, strict=True))


def refine_cell(node: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Cell of the adaptive map: byte so far x stretched probability in steps of 3/4."""
    step = np.clip(np.rint(m / 0.75) + MAP_CELLS // 2, 0, MAP_CELLS - 1).astype(np.int64)
    return node * MAP_CELLS + step


def refine_middle() -> np.ndarray:
    return squash((np.arange(256 * MAP_CELLS) % MAP_CELLS - MAP_CELLS // 2) * 0.75)


def learn_bucket(bucket: Bucket, tables: np.ndarray, bits: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One online run through a bucket: curvatures (gates x 5 x 5), weights (gates x 5), and the map's counts."""
    curve = np.tile(np.eye(ORDERS) * RIDGE, (GATES, 1, 1))
    weights = np.tile(FIRST_WEIGHTS, (GATES, 1))
    slope, seen, pending = np.zeros((GATES, ORDERS)), np.zeros((2, 256 * MAP_CELLS)), 0
    rank = np.random.default_rng(len(bucket.units)).permutation(len(bucket.units))

    def stepped() -> np.ndarray:
        change = np.linalg.solve(curve, slope[..., None])[..., 0]
        return weights + change * np.minimum(1, MIX_STEP / np.maximum(np.abs(change).max(axis=1, keepdims=True), 1e-9))

    for units, group, nodes in bucket.node_columns(bits):
        some = np.flatnonzero(bucket.n[units] > 0)
        lots = -(-len(some) // MIX_CHUNK)
        lot = rank[units[some]] % max(lots, 1)  # neighbours are alike: each chunk takes from all over the bucket
        chosen = [some[lot == turn] for turn in range(lots)]
        # Units with one node and bit learn as one, with their summed weight.
        chunks = [(len(c), np.bincount(group[c], weights=bucket.n[units[c]], minlength=group[-1] + 1)) for c in chosen]
        for bit, run, node, slots, zeros, ones, low, place in nodes:
            for size, times in chunks:
                w = np.bincount(2 * run + bit, weights=times)
                ways = np.flatnonzero(w)
                w, of, b = w[ways], ways >> 1, ways & 1
                x, gate = inputs(tables, None, slots[:, of], zeros[:, of], ones[:, of], None if low is None else low[of], place, b)
                m = mixed(weights.T.astype(_f4), x, gate)
                p = squash(m)
                err = b - p
                force, bend = err * w, (p * (1 - p) + err * err) * w
                kind = (gate // 64).astype(np.uint8)
                order = np.argsort(kind, kind="stable")
                turned, force, bend = x.take(order, axis=1).astype(np.float64), force[order], bend[order]
                ends = np.cumsum(np.bincount(kind)).tolist()
                for g, (first, last) in enumerate(zip([0, *ends], ends, strict=False)):
                    if first < last:
                        own = turned[:, first:last]
                        slope[place + 64 * g] += own @ force[first:last]
                        curve[place + 64 * g] += (own * bend[first:last]) @ own.T
                cell = refine_cell(node[of], m)
                seen[0] += np.bincount(cell, weights=w, minlength=seen.shape[1])
                seen[1] += np.bincount(cell, weights=w * b, minlength=seen.shape[1])
                pending += size
                if pending >= MIX_CHUNK:
                    weights = stepped()
                    slope[:], pending = 0, 0
    return curve, stepped(), seen


def mixing_pass(buckets: DataFrame, sent, bits: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Weights (predictors x gates) and the refined probabilities, learned in all buckets."""
    sizes = {"c": GATES * ORDERS * ORDERS, "w": GATES * ORDERS, "n": 256 * MAP_CELLS, "o": 256 * MAP_CELLS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, found = sent.value, None
        for bucket in _buckets(batches):
            curve, weights, seen = learn_bucket(modelled(bucket), tables, bits)
            curve = curve - np.eye(ORDERS) * RIDGE
            own = [curve.ravel(), (curve @ weights[..., None]).ravel(), *seen]
            found = own if found is None else [a + b for a, b in zip(found, own, strict=True)]
        if found is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(list(sizes), list(sizes.values()))), pa.array(np.concatenate([np.arange(s) for s in sizes.values()])),
                 pa.array(np.concatenate(found))], names=["kind", "place", "value"])

    got = buckets.mapInArrow(run, "kind string, place long, value double").groupBy("kind", "place").agg(
        F.sum("value").alias("value")).toPandas()
    out = {k: np.zeros(size) for k, size in sizes.items()}
    for kind, rows in got.groupby("kind"):
        out[kind][rows["place"]] = rows["value"]
    curve = out["c"].reshape(GATES, ORDERS, ORDERS) + np.eye(ORDERS) * RIDGE
    pulled = out["w"].reshape(GATES, ORDERS) + RIDGE * FIRST_WEIGHTS
    weights = np.linalg.solve(curve, pulled[..., None])[..., 0]
    return np.ascontiguousarray(weights.T), (out["o"] + 2 * refine_middle()) / (out["n"] + 2)


def bucket_scores(bucket: Bucket, tables: np.ndarray, ready: np.ndarray | None, bits: tuple[int, ...], weights: np.ndarray,
                  refined: np.ndarray) -> np.ndarray:
    """log10 probability of each unit."""
    out = np.zeros(len(bucket.units))
    weights = weights.astype(_f4)
    for units, group, nodes in bucket.node_columns(bits):
        log = 0.0
        for bit, run, node, slots, zeros, ones, low, place in nodes:
            x, gate = inputs(tables, ready, slots, zeros, ones, low, place)
            m = mixed(weights, x, gate).astype(np.float64)
            p = np.clip((squash(m) + refined[refine_cell(node, m)]) / 2, 1e-7, 1 - 1e-7)
            p = p[run]
            log = log + np.log10(np.where(bit == 1, p, 1 - p))
        out[units] += log[group]
    return out


def score_units(buckets: DataFrame, sent, bits: tuple[int, ...], weights: np.ndarray, refined: np.ndarray) -> DataFrame:
    """``key``, ``n``, ``c`` (training occurrences of the word in all classes; 0 for pieces), ``s`` (log10 probability)
    and ``first`` (one row of each word, to count words by)."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, hashes = sent.value, FreshHashes()
        for bucket in _buckets(batches):
            keep = bucket.codes != LONG
            s = np.zeros(len(bucket.units))
            s[keep] = bucket_scores(modelled(bucket), tables, None, bits, weights, refined)
            word, spaced = bucket.words()
            # The rows of a text stand together.
            run = np.cumsum(bucket.shared_bits(np.arange(len(word))) < 1 << 40)
            c = np.where(word, np.bincount(run, weights=bucket.n * word)[run], 0).astype(np.int64)
            first = word.copy()
            first[np.flatnonzero(word)[1:]] = np.diff(run[word]) != 0
            ids = [hashes[u[:-1]] if cut else hashes[u] for u, cut in zip(bucket.units, (spaced & (bucket.codes != LONG)).tolist(), strict=True)]
            keys = unit_keys(np.array(ids, dtype=np.uint64), bucket.codes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(bucket.n.astype(np.int64)), pa.array(c), pa.array(s),
                 pa.array(first)], names=["key", "n", "c", "s", "first"])

    return scratch_table(buckets.mapInArrow(rows, "key long, n long, c long, s double, first boolean"), "lm-scores")


# ------------------------------------------------------------------ documents

def frequent_units(scored: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Sorted keys, counts and scores of the units that occur most (at most TOP_UNITS), and the least occurrences among them."""
    least, total = 1 << 62, 0
    for r in scored.groupBy("n").agg(F.count("*").alias("units")).orderBy(F.desc("n")).limit(TOP_UNITS).collect():
        total += r["units"]
        if total > TOP_UNITS:
            break
        least = r["n"]
    top = scored.where(F.col("n") >= least).select("key", "c", "s").toArrow()
    keys = top["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], top["c"].to_numpy()[order], top["s"].to_numpy()[order], least


_SCORED = ("part string, ordinal int, doc_id long, n_tokens long, n_bytes long, score double, base double, "
           "known long, rest array<long>, times array<int>, based array<int>")


def score_documents(docs: DataFrame, groups: dict[bytes, int], top) -> DataFrame:
    """Sums over the frequent units of each document, and the keys of its other ones."""
    tracked = tracked_hashes(groups)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, scores = top.value
        for texts, (ids,) in text_chunks(batches, TEXT_CHUNK, "doc_id"):
            some, n = Texts(texts, FreshHashes(), tracked), len(texts)
            name, code, which = some.distinct()
            own = unit_keys(some.ids[name], code)
            at = np.searchsorted(keys, own)
            hit = np.append(keys, 0)[at] == own if len(keys) else np.zeros(len(own), dtype=bool)
            at = np.where(hit, at, len(keys))  # a unit that isn't among them adds nothing here
            log = np.append(np.log10(counts + ADD), 0.0)[at]
            sums = [np.bincount(some.of, weights=w, minlength=n) for w in (
                some.size, np.append(scores, 0.0)[at][which], np.where(some.word, log[which], 0),
                some.word & (np.append(counts, 0)[at] > 0)[which])]
            miss = np.flatnonzero(~hit[which])
            # Per document, the other units once each: (document, unit) in one sorted number.
            pair, first, times = np.unique(some.of[miss] * len(own) + which[miss], return_index=True, return_counts=True)
            cut = np.searchsorted(pair, np.arange(n + 1) * len(own)).astype(np.int32)
            rest = own[pair % max(len(own), 1)].view(np.int64)
            based = np.where(some.word[miss][first], times, 0)
            lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(v, k)) for v, k in (
                (rest, pa.int64()), (times.astype(np.int32), pa.int32()), (based.astype(np.int32), pa.int32()))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex] * n), pa.array(range(n), pa.int32()), pa.array(ids, pa.int64()), pa.array(some.tokens),
                 pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), pa.array(sums[3].astype(np.int64)), *lists],
                names=[c.split()[0] for c in _SCORED.split(", ")])

    return scratch_table(docs.mapInArrow(score, _SCORED), "lm-documents")


def lm_scores(docs: DataFrame) -> DataFrame:
    """One row per document: the contract's columns and ``bits_per_byte``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tracked = tracked_words(docs)
    groups = word_groups(tracked, company(docs, tracked))
    units = count_units(docs, groups)
    buckets = dealt_units(units)
    bits = table_bits(units.count())
    sent = spark.sparkContext.broadcast(context_tables(buckets, bits))
    weights, refined = mixing_pass(buckets, sent, bits)
    scored = score_units(buckets, sent, bits, weights, refined)
    sent.destroy()  # the scores are written; executors need not hold the tables any longer
    n_all, n_distinct = scored.agg(F.coalesce(F.sum(F.when(F.col("first"), F.col("c"))), F.lit(0)),
                                   F.count(F.when(F.col("first") & (F.col("c") > 0), 1))).first()
    keys, counts, scores, least = frequent_units(scored)
    top = spark.sparkContext.broadcast((keys, counts, scores))
    found = score_documents(docs, groups, top)
    top.destroy()
    asked = found.select("part", "ordinal", F.explode(F.arrays_zip("rest", "times", "based")).alias("x")).select(
        "part", "ordinal", F.col("x.rest").alias("key"), F.col("x.times").alias("t"), F.col("x.based").alias("b"))
    rare = (asked.join(scored.where(F.col("n") < least).select("key", "c", "s"), "key").groupBy("part", "ordinal").agg(
        F.sum(F.col("t") * F.col("s")).alias("rare_score"), F.sum(F.col("b") * F.log10(F.col("c") + ADD)).alias("rare_base"),
        F.sum(F.when(F.col("c") > 0, F.col("b")).otherwise(0)).alias("rare_known")))
    out = found.drop("rest", "times", "based").join(rare, ["part", "ordinal"], "left")
    below = float(np.log10(n_all + ADD * (n_distinct + 1)))
    score = F.col("score") + F.coalesce("rare_score", F.lit(0.0))
    return out.select(
        "doc_id", (bucket_of(F.col("doc_id"), HELD_OUT_MOD) == 0).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * below).alias("base_score"),
        score.alias("score"), (-score / float(np.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"))
