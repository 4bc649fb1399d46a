"""Benchmark decontamination over a distributed positional inverted index.

The corpus is indexed once, in segments of some hundred thousand words: each
segment row stores, for every benchmark word that occurs in it, the ascending
list of its positions (documents follow each other with a gap). A window of
``WINDOW`` consecutive benchmark words is then searched segment by segment:
its terms are taken from the rarest in the corpus to the most frequent, the
list of the rarest gives candidate starts (position minus offset in the
window), and every further list, adjusted by its own offset, is intersected
with them. With ``slop`` 0 this finds exact phrases; with ``slop`` s each term
may stand up to s places off (proximity).

Segments are independent, so nothing of the corpus is shuffled and no word,
however frequent, is gathered in one place. The benchmark goes to the tasks in
blocks of bounded size (``BLOCK_WORDS``), each searched against all segments.
Words are known by 64-bit hashes.

Defined results: null and empty texts have no words; an item of fewer than
``WINDOW`` words is one window, an item without words none;
items without an id are met like others and count as one item, named nowhere;
repeated rows are reported each; an empty corpus gives no rows, an empty
benchmark no hits; extra columns are carried along whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, alnum_words, broadcast_if, scratch_table, text_bytes

WINDOW = 10
SEGMENT_WORDS = 300_000
#: Words of the benchmark that travel to the tasks at once.
BLOCK_WORDS = 1_000_000
FILTER_BITS = 24
#: Places between two documents of a segment; slop stays below half of it.
GAP = 64
BROADCAST_LOST = 1_000_000

_SEGMENT = ("segment string, doc_ids array<long>, text_hashes array<long>, bases array<long>, n_words array<long>, "
            "terms array<long>, lens array<int>, places array<int>")
_HITS = "segment string, ordinal int, doc_id long, text_hash long, n_words long, hits array<int>, items array<string>"


def word_ids(raw: bytes, hashes: WordHashes) -> np.ndarray:
    words = alnum_words(raw)
    return np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def benchmark_blocks(benchmark: DataFrame, item_id: str, text: str) -> list[pd.DataFrame]:
    """The items in blocks of about ``BLOCK_WORDS`` words each (at least one item)."""
    items = benchmark.select(
        F.col(item_id).cast("string").alias("item_id"), F.col(text).cast("string").alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // (4 * BLOCK_WORDS)))
    return [items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b).toPandas() for b in range(n)]


def in_order(items: set) -> list[str | None]:
    """Sorted ids, the null one last."""
    return sorted(items, key=lambda x: (x is None, x or ""))


def windows_of(block: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[list[str | None]]]:
    """Distinct windows as a (n x WINDOW) matrix of word ids padded with 0,
    their lengths, and the items each belongs to."""
    hashes, items_of = WordHashes(), {}
    for item, text in zip(block["item_id"], block["text"], strict=True):
        ids = word_ids((text or "").encode(), hashes)
        size = min(WINDOW, len(ids))
        for i in range(len(ids) - size + 1 if size else 0):
            items_of.setdefault(ids[i:i + size].tobytes(), set()).add(None if pd.isna(item) else item)
    terms = np.zeros((len(items_of), WINDOW), dtype=np.uint64)
    lens = np.zeros(len(items_of), dtype=np.int64)
    for row, key in enumerate(items_of):
        ids = np.frombuffer(key, dtype=np.uint64)
        terms[row, :len(ids)] = ids
        lens[row] = len(ids)
    return terms, lens, [in_order(x) for x in items_of.values()]


def build_index(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """The stored index: one row per segment, postings of the words whose
    hash passes the fixed-size filter made of ``vocabulary``."""
    wanted = np.zeros(1 << FILTER_BITS, dtype=bool)
    wanted[(vocabulary >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    packed = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted).tobytes())

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(packed.value, dtype=np.uint8)).view(bool)
        hashes, shift = WordHashes(), np.uint64(64 - FILTER_BITS)

        def flush(ids, text_hashes, bases, sizes, words, places):
            w, p = np.concatenate(words), np.concatenate(places)
            order = np.argsort(w, kind="stable")  # places already ascend
            terms, lens = np.unique(w[order], return_counts=True)
            rows = [[uuid.uuid4().hex], [ids], [text_hashes], [bases], [sizes], [terms.view(np.int64)],
                    [lens.astype(np.int32)], [p[order].astype(np.int32)]]
            kinds = [pa.string(), *[pa.list_(pa.int64())] * 5, *[pa.list_(pa.int32())] * 2]
            names = ["segment", "doc_ids", "text_hashes", "bases", "n_words", "terms", "lens", "places"]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names=names)

        ids, text_hashes, bases, sizes, words, places, at = [], [], [], [], [], [], 0
        for batch in batches:
            cols = batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), text_bytes(batch)
            for doc, text_hash, raw in zip(*cols, strict=True):
                w = word_ids(raw, hashes)
                here = np.flatnonzero(bits[(w >> shift).astype(np.int64)])
                ids.append(doc)
                text_hashes.append(text_hash)
                bases.append(at)
                sizes.append(len(w))
                words.append(w[here])
                places.append(here + at)
                at += len(w) + GAP
                if at >= SEGMENT_WORDS:
                    yield flush(ids, text_hashes, bases, sizes, words, places)
                    ids, text_hashes, bases, sizes, words, places, at = [], [], [], [], [], [], 0
        if ids:
            yield flush(ids, text_hashes, bases, sizes, words, places)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
                       F.col("text").cast("string").alias("text"))
    return scratch_table(rows.mapInArrow(segments, _SEGMENT), "postings")


def term_counts(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Occurrences in the whole corpus of each of ``terms`` (one benchmark block's)."""
    spark = index.sparkSession
    asked = spark.createDataFrame(pd.DataFrame({"term": terms.view(np.int64)}), "term long")
    totals = (index.select(F.explode(F.arrays_zip("terms", "lens")).alias("x"))
              .groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.lens").alias("n")))
    got = totals.join(asked, "term").toPandas()
    counts = dict(zip(got["term"], got["n"], strict=True))
    return np.array([counts.get(t, 0) for t in terms.view(np.int64).tolist()], dtype=np.int64)


def intersect(terms: np.ndarray, lens: np.ndarray, places: np.ndarray, windows: np.ndarray, sizes: np.ndarray,
              by_rarity: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows found in one segment: window numbers and the (m x WINDOW)
    places of their terms (-1 beyond a short window's end).

    ``by_rarity`` lists each window's offsets, rarest term first.
    """
    at = np.searchsorted(terms, windows)
    at[at == len(terms)] = 0
    here = (terms[at] == windows) | (np.arange(WINDOW) >= sizes[:, None])
    number = np.flatnonzero(here.all(axis=1))
    ends = np.cumsum(lens.astype(np.int64))
    keys = (np.repeat(np.arange(len(terms), dtype=np.int64), lens) << 32) + places
    off = by_rarity[number, 0]
    first = at[number, off]
    n = lens[first].astype(np.int64)
    which = np.repeat(number, n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = places[np.repeat(ends[first] - n, n) + inside].astype(np.int64)
    start = place - np.repeat(off, n)
    found = np.full((len(which), WINDOW), -1, dtype=np.int64)
    found[np.arange(len(which)), by_rarity[which, 0]] = place
    for j in range(1, WINDOW):
        if not len(which):
            break
        off = by_rarity[which, j]
        live = off < sizes[which]
        key = (at[which, off].astype(np.int64) << 32) + start + off
        i = np.searchsorted(keys, key - slop)
        hit = keys[np.minimum(i, len(keys) - 1)]
        ok = ~live | ((i < len(keys)) & (hit >= key - slop) & (hit <= key + slop))
        if slop:  # an exact place counts before a nearer-left one
            k = np.searchsorted(keys, key)
            exact = (k < len(keys)) & (keys[np.minimum(k, len(keys) - 1)] == key)
            hit = np.where(exact, key, hit)
        rows = np.flatnonzero(live)
        found[rows, off[rows]] = hit[rows] & 0xFFFFFFFF
        which, start, found = which[ok], start[ok], found[ok]
    return which, found


def search(index: DataFrame, block: pd.DataFrame, slop: int = 0) -> DataFrame:
    """All documents of the index with the word places hit and the items met."""
    windows, sizes, items = windows_of(block)
    distinct, spot = np.unique(windows, return_inverse=True)
    spot = spot.reshape(windows.shape)
    counts = term_counts(index, distinct)[spot]
    counts[np.arange(WINDOW) >= sizes[:, None]] = np.iinfo(np.int64).max  # padding comes last
    by_rarity = np.argsort(counts, axis=1, kind="stable")
    present = (counts > 0).all(axis=1)
    sent = index.sparkSession.sparkContext.broadcast(
        (windows[present], sizes[present], by_rarity[present], [x for x, p in zip(items, present, strict=True) if p]))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, sizes, by_rarity, items = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                ids, text_hashes, n_words = (batch.column(c)[row].as_py() for c in ("doc_ids", "text_hashes", "n_words"))
                bases, terms, lens, places = (batch.column(c)[row].values.to_numpy() for c in ("bases", "terms", "lens", "places"))
                spots: list[list[int]] = [[] for _ in ids]
                met: list[list[str | None]] = [[] for _ in ids]
                if len(terms) and len(windows):
                    which, found = intersect(terms.view(np.uint64), lens, places, windows, sizes, by_rarity, slop)
                    if len(which):
                        doc = np.searchsorted(bases, found.max(axis=1), side="right") - 1
                        cells = np.unique(found[found >= 0])
                        owner = np.searchsorted(bases, cells, side="right") - 1
                        for d in np.unique(doc):
                            spots[d] = (cells[owner == d] - bases[d]).tolist()
                            met[d] = in_order({x for w in np.unique(which[doc == d]) for x in items[w]})
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.column("segment")[row].as_py()] * len(ids)), pa.array(range(len(ids)), pa.int32()),
                    pa.array(ids, pa.int64()), pa.array(text_hashes, pa.int64()), pa.array(n_words, pa.int64()),
                    pa.array(spots, pa.list_(pa.int32())), pa.array(met, pa.list_(pa.string()))],
                    names=["segment", "ordinal", "doc_id", "text_hash", "n_words", "hits", "items"])

    return index.mapInArrow(hits, _HITS)


def contamination(docs: DataFrame, benchmark: DataFrame, slop: int = 0, item_id: str = "item_id") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``text_hash``, ``n_words``, ``hits``
    (places of hit words) and ``items`` (sorted ids of the items met)."""
    if not 0 <= slop < GAP // 2 - WINDOW:
        raise ValueError("slop is out of range")
    blocks = benchmark_blocks(benchmark, item_id, "text")
    vocabulary = np.unique(np.concatenate([windows_of(b)[0].ravel() for b in blocks]))
    index = build_index(docs, vocabulary)
    found = [search(index, b, slop) for b in blocks]
    if len(found) == 1:
        return found[0].drop("segment", "ordinal")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("segment", "ordinal").agg(
        *[F.any_value(c).alias(c) for c in ("doc_id", "text_hash", "n_words")],
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).drop("segment", "ordinal")


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents no benchmark window occurs in, with all their columns."""
    lost = scratch_table(contamination(docs, benchmark).where(F.size("hits") > 0).select(
        F.col("doc_id").alias("lost_id"), F.col("text_hash").alias("lost_hash")).distinct(), "contaminated")
    on = (F.xxhash64("text") == F.col("lost_hash")) & F.col("doc_id").eqNullSafe(F.col("lost_id"))
    return docs.join(broadcast_if(lost, BROADCAST_LOST), on, "left_anti")
