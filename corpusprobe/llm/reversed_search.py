"""Ranked lexical search, reversed: documents stream past an index of the items.

The items (the queries) are few, the documents many, so the index is built over
the items and sent to the tasks, and every document is read as if it were the
query:

1. The distinct terms of the items get dense ids, and a posting list of the
   items that hold them. Items are dealt to blocks of at most about
   ``BLOCK_POSTINGS`` postings; only one block's index is sent at a time, so
   what is broadcast has a bound whatever the number of items.
2. One pass over the documents counts their terms: N, L and each document's
   length, and the counts of its terms that some item holds, stored as a row a
   document. Document frequencies are sums over these rows.
3. The stored counts stream through the index: the weight of each term is added
   to the items of its posting list, a chunk of documents at a time, and each
   task keeps a heap of the ``top`` best documents for each item.
4. The heaps of all tasks are merged in two steps, first within salted parts of
   an item, then for each item. A heap holds at most ``top`` rows.

Scores are 64-bit integers but for the weight floor(1000 ln((2N+2)/(2df+1))).

Defined results: null and empty texts hold no term and count nowhere; null and
empty items have no result; items alike in id and text count once, otherwise
each row is an item of its own (so repeated ids give several rankings under one
id, and items without an id have rankings with a null id); rows of documents
that share an id are documents of their own; a document without an id follows
the others at equal score; empty tables give an empty result; extra columns are
not read.
"""

from __future__ import annotations

import heapq
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import alnum_words, scratch_table, text_bytes

TOP = 10
#: Postings (term, item) of the index sent to tasks at once.
BLOCK_POSTINGS = 2_000_000
#: Cells (document, item) and contributions (document, term, item) scored at once.
CHUNK_CELLS = 2_000_000
CHUNK_ADDS = 4_000_000
FIRST_CHUNK = 16
#: Parts in which an item's heaps are merged first.
MERGE_PARTS = 32

_NO_ID = 2**63 - 1


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [sorted(set(alnum_words(raw))) for raw in text_bytes(batch)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("item"), batch.column("item_id"), pa.array(terms, pa.list_(pa.binary()))],
            names=["item", "item_id", "terms"])


def items_of(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item`` (a key), ``item_id``, ``terms``, ``block``: the distinct items that hold a term."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).distinct()
    items = items.where("text is not null").withColumn(
        "item", F.sha2(F.concat_ws(":", F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text"), 256))
    items = scratch_table(items.mapInArrow(_item_rows, "item string, item_id long, terms array<binary>").where("size(terms) > 0"),
                          "items")
    postings = items.agg(F.sum(F.size("terms"))).first()[0] or 0
    return items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(-(-postings // BLOCK_POSTINGS) or 1)).cast("int"))


def item_index(rows: list) -> dict:
    """Inverted index of one block of items, in plain types: ``ids`` of the terms, then for
    term t the positions ``items[starts[t]:starts[t + 1]]`` in ``keys``."""
    rows = sorted(rows, key=lambda r: r["item"])
    ids = {t: i for i, t in enumerate(sorted({bytes(t) for r in rows for t in r["terms"]}))}
    pairs = np.array([(ids[bytes(t)], i) for i, r in enumerate(rows) for t in r["terms"]], dtype=np.int64)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    return {"keys": [r["item"] for r in rows], "ids": ids, "items": pairs[:, 1],
            "starts": np.searchsorted(pairs[:, 0], np.arange(len(ids) + 1))}


def count_terms(docs: DataFrame, index) -> DataFrame:
    """``doc_id``, ``n`` (terms with repeats), ``terms`` and ``counts`` (those of the index) of documents with a term."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = index.value["ids"]
        for batch in batches:
            doc_ids, lens, terms, counts, ends = [], [], array("i"), array("q"), array("i", [0])
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), text_bytes(batch), strict=True):
                words = alnum_words(raw)
                if not words:
                    continue
                doc_ids.append(doc_id)
                lens.append(len(words))
                held = Counter(words)
                for term in held.keys() & ids.keys():
                    terms.append(ids[term])
                    counts.append(held[term])
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array(doc_ids, pa.int64()), pa.array(lens, pa.int64()),
                pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))], names=["doc_id", "n", "terms", "counts"])

    return docs.mapInArrow(rows, "doc_id long, n long, terms array<int>, counts array<long>")


def parts(counts: np.ndarray, lens: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The factor of a term's weight: counts in documents of ``lens`` terms, in 64-bit integers."""
    m = 100 - 90 + (90 * lens * n_docs) // n_terms
    return (1_000_000_000 * counts) // (1000 * counts + 8 * m)


class Heaps:
    """The ``top`` best (score, smaller id first) documents of each item."""

    def __init__(self, n: int, top: int):
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        self.least = np.ones(n, dtype=np.int64)  # no document below this score can enter
        self.top = top

    def add(self, scores: np.ndarray, doc_ids: np.ndarray) -> None:
        """``scores``: documents by items."""
        rows, items = np.nonzero(scores >= self.least)
        for item, score, doc in zip(items.tolist(), scores[rows, items].tolist(), doc_ids[rows].tolist(), strict=True):
            heap, entry = self.heaps[item], (score, -doc)
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            else:
                continue
            if len(heap) == self.top:
                self.least[item] = heap[0][0]

    def rows(self) -> list[tuple[int, int, int]]:
        return [(i, -doc, score) for i, heap in enumerate(self.heaps) for score, doc in heap]


def score_documents(counted: DataFrame, index, weights, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """``item``, ``doc_id``, ``score``: each task's heaps."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight = index.value, weights.value
        items, starts, width, step = known["items"], known["starts"], len(known["keys"]), FIRST_CHUNK
        heaps = Heaps(width, top)
        per_term = np.diff(starts)
        for batch in batches:
            doc_ids = batch.column("doc_id").fill_null(_NO_ID).to_numpy()
            lens, column = batch.column("n").to_numpy(), batch.column("terms")
            terms, counts = column.flatten().to_numpy(), batch.column("counts").flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy().astype(np.int64))])
            owner = np.repeat(np.arange(len(lens)), np.diff(ends))
            value = weight[terms] * parts(counts, lens[owner], n_docs, n_terms)
            adds = np.concatenate([[0], np.cumsum(per_term[terms])])
            before = adds[ends]
            a = 0
            while a < len(lens):  # as many documents as fit both bounds, one at least; few while the heaps fill
                b = int(np.searchsorted(before, before[a] + CHUNK_ADDS, side="right")) - 1
                b = max(a + 1, min(b, a + max(1, min(step, CHUNK_CELLS // width)), len(lens)))
                step *= 2
                i, j = ends[a], ends[b]
                n = per_term[terms[i:j]]
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                cell = np.repeat(owner[i:j] - a, n) * width + items[np.repeat(starts[terms[i:j]], n) + nth]
                scores = np.zeros((b - a) * width, dtype=np.int64)
                np.add.at(scores, cell, np.repeat(value[i:j], n))
                heaps.add(scores.reshape(b - a, width), doc_ids[a:b])
                a = b
        found = heaps.rows()
        yield pa.RecordBatch.from_arrays([
            pa.array([known["keys"][i] for i, _, _ in found], pa.string()),
            pa.array([None if doc == _NO_ID else doc for _, doc, _ in found], pa.int64()),
            pa.array([score for _, _, score in found], pa.int64())], names=["item", "doc_id", "score"])

    return counted.mapInArrow(rows, "item string, doc_id long, score long")


def term_weights(counted: DataFrame, size: int, n_docs: int) -> np.ndarray:
    """floor(1000 ln((2N+2)/(2df+1))) by term id; a row a term of the block reaches the driver."""
    df = np.zeros(size, dtype=np.int64)
    found = counted.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    df[found.column("term").to_numpy()] = found.column("count").to_numpy()
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def merged(heaps: DataFrame, top: int, *keys: str) -> DataFrame:
    best = Window.partitionBy("item", *keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return heaps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def search_items(docs: DataFrame, benchmark: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``top`` documents of each item."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    items = items_of(benchmark, item_id, item_text)
    blocks = sorted(r["block"] for r in items.select("block").distinct().collect())
    found = None
    for block in blocks:  # each block is a pass of its own over the documents
        known = item_index(items.where(F.col("block") == block).select("item", "terms").collect())
        index = spark.sparkContext.broadcast(known)
        counted = scratch_table(count_terms(docs, index), "term-counts")
        size = counted.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        if not size["docs"]:
            break
        weights = spark.sparkContext.broadcast(term_weights(counted, len(known["ids"]), size["docs"]))
        heaps = scratch_table(score_documents(counted, index, weights, size["docs"], size["terms"], top), "heaps")
        found = heaps if found is None else found.unionByName(heaps)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_PARTS))
    best = merged(merged(found.withColumn("part", part), top, "part").drop("rank"), top)
    return best.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def search_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return search_items(docs, benchmark)
