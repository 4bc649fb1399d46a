"""Lines, n-grams, dense ids and token-id text (SRC7, STR3-5, AGG6-10, TOK1-2, OCC2).

The reference streams a file through worker processes into one consumer that
holds the whole n-gram set. Here the set is a distributed ``distinct``: tasks drop
the copies among ``SET_ROWS`` n-grams at a time, then sorted ranges of them go packed
through a shuffle (:mod:`corpusprobe.operators.packed`). Dense ids come from a
range-partitioned, stored copy plus per-partition offsets, never from a
single-partition ``row_number``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from corpusprobe.functions.text import ngram_set, ngram_strings, unnest, ws_tokens
from corpusprobe.operators import packed
from corpusprobe.operators.occurrences import BROADCAST_BYTES, ROW_BYTES, count_matches
from corpusprobe.operators.places import text_chunks, ws_token_array
from corpusprobe.session import shuffles_dropped, stored

# ------------------------------------------------------------------ lines

def corpus_lines(corpus: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SRC7 for table input: ``(doc_id, line_no, line)``, lines split on '\\n'.

    A terminator at the very end does not open another line (as when reading
    a file line by line).
    """
    parts = F.split(F.col(text_col), "\n", -1)
    n = F.size(parts)
    trimmed = F.when((n > 1) & (F.element_at(parts, -1) == F.lit("")),
                     F.slice(parts, F.lit(1), n - 1)).otherwise(parts)
    return (unnest(corpus.where(F.col(text_col).isNotNull()), trimmed, F.col(doc_col).alias("doc_id"), name="line", at="line_no")
            .select("doc_id", F.col("line_no").cast("bigint"), "line"))


def lines_scanned(lines: DataFrame) -> DataFrame:
    """AGG9: ``(lines)``, the number of lines read."""
    return lines.agg(F.count(F.lit(1)).cast("bigint").alias("lines"))


def newline_count(corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """AGG10: ``(newlines)``; an unterminated last line adds nothing."""
    per_doc = F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit("")))
    return corpus.agg(F.coalesce(F.sum(per_doc), F.lit(0)).cast("bigint").alias("newlines"))


# ------------------------------------------------------------------ n-grams

def line_ngrams(lines: DataFrame, n: int = 5, distinct: bool = False) -> DataFrame:
    """STR3 (list, duplicates kept) or STR4 (set): ``(doc_id, line_no, pos, ngram)``.

    ``pos`` is the 0-based position of the first occurrence in the line.
    """
    w = ws_tokens("line")
    grams = ngram_set(w, n) if distinct else ngram_strings(w, n)
    return (unnest(lines, grams, "doc_id", "line_no", name="ngram", at="pos")
            .select("doc_id", "line_no", F.col("pos").cast("bigint"), "ngram"))


#: Values of a range of dense ids: one sorted partition.
RANGE_ROWS = 1_000_000

#: N-grams among which a task drops copies.
SET_ROWS = 1_000_000


def distinct_ngrams(lines: DataFrame, n: int = 5) -> DataFrame:
    """AGG6: the union of all per-line n-gram sets, ``(ngram)``.

    They go through the shuffle packed, in sorted ranges (one action chooses these), of
    which :func:`dense_index` and :func:`extend_index` make further use."""
    ranges = packed.line_ranges(lines, n, SET_ROWS, RANGE_ROWS)
    found = packed.merged_values(ranges)
    found.ngram_ranges = ranges
    return found


def ngram_cardinality(ngrams: DataFrame, approx: bool = False) -> DataFrame:
    """AGG7: ``(n_ngrams)``; ``approx`` uses HyperLogLog++ (stored sketches: :mod:`corpusprobe.operators.sketches`).

    What :func:`distinct_ngrams` found has no copies, so that counting it needs no second shuffle."""
    exact = F.count_distinct("ngram") if getattr(ngrams, "ngram_ranges", None) is None else F.count("ngram")
    agg = F.approx_count_distinct("ngram") if approx else exact
    return ngrams.agg(agg.cast("bigint").alias("n_ngrams"))


def _offsets(counts: DataFrame, part: str) -> DataFrame:
    """``(part, _off)`` of ``(part, _c)``: the values before each part."""
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(part, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))


def _packed_index(ranges: packed.Ranges, col: str, id_col: str, first: Column) -> DataFrame:
    """``(col, id_col)`` of n-grams in ranges, numbered from ``first``; the only copy of them is stored packed."""
    pieces = None
    for merged in packed.merged_pieces(ranges):
        with shuffles_dropped(merged.sparkSession):
            some = stored(merged, "index-ranges")
        pieces = some if pieces is None else pieces.unionByName(some)
    offs = _offsets(pieces.groupBy("ngram_range").agg(F.sum("n").alias("_c")), "ngram_range")
    placed = pieces.join(F.broadcast(offs), "ngram_range").withColumn("start", (first + F.col("_off") + F.col("place")).cast("bigint"))
    return packed.numbered_values(placed, ranges.n, col, id_col)


def dense_index(values: DataFrame, col: str, id_col: str = "id",
                num_partitions: int | None = None, order=None) -> DataFrame:
    """AGG8: ``(col, id_col)`` with 0-based ids in ascending order of ``col``.

    ``values`` must hold distinct values of ``col`` (other columns are carried);
    ``order`` optionally gives the sort columns. The values are stored once in
    the shared checkpoint folder and counted there; they are cut into as many
    ranges as their number asks for (``RANGE_ROWS`` each, whatever the session's
    shuffle partitions), and the sorted copy is stored as well, so boundaries and
    positions survive a lost executor. Both copies are sorted in each part: neighbours
    share their beginnings, which makes files and shuffle small. The per-range counts
    (one row per range, a proven bound) are broadcast as offsets. What
    :func:`distinct_ngrams` found is in ranges already and stored once, packed.
    """
    ranges = getattr(values, "ngram_ranges", None)
    if ranges is not None and order is None and num_partitions is None:
        return _packed_index(ranges, col, id_col, F.lit(0))
    order = order or [F.col(col)]
    if num_partitions is None:
        values = stored(values.sortWithinPartitions(*order), "index-values")
        num_partitions = max(1, -(-values.count() // RANGE_ROWS))
    ranged = (values
              .repartitionByRange(num_partitions, *order)
              .sortWithinPartitions(*order)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))  # place in its range
    ranged = stored(ranged, "index-ranges")
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    offs = _offsets(counts, "_pid")
    keep = [c for c in values.columns]
    return (ranged.join(F.broadcast(offs), "_pid")
            .select(*keep, (F.col("_off") + F.col("_row")).cast("bigint").alias(id_col)))


def extend_index(index: DataFrame, values: DataFrame, col: str, id_col: str = "id") -> DataFrame:
    """AGG8, kept up: ``index`` with the values it lacks, whose ids follow its largest one in ascending order.

    Ids given before stay, so what was written with them stays right. ``values``
    need not be distinct, nor new. Only the new values are sorted. Where they are what
    :func:`distinct_ngrams` found, those of the index go to the same ranges, packed like them."""
    ranges = getattr(values, "ngram_ranges", None)
    picked = F.when(F.lit(ranges is not None) & (F.pmod(F.xxhash64(col), F.lit(packed.SAMPLE_EVERY)) == 0), F.col(col).cast("binary"))
    top, total, sample = index.agg(F.max(id_col), F.count(col), F.collect_list(picked)).first()
    start = 0 if top is None else top + 1
    if ranges is not None:
        left = packed.without(ranges, index, col, [bytes(x) for x in sample], total)
        return index.select(col, id_col).unionByName(_packed_index(left, col, id_col, F.lit(start)))
    new = values.select(col).where(F.col(col).isNotNull()).distinct().join(index.select(col), col, "left_anti")
    return index.select(col, id_col).unionByName(
        dense_index(new, col, id_col).select(col, (F.col(id_col) + F.lit(start)).alias(id_col)))


def ngram_index(lines: DataFrame, n: int = 5) -> DataFrame:
    """``(ngram, ngram_id)`` over the distinct n-grams of all lines."""
    return dense_index(distinct_ngrams(lines, n), "ngram", "ngram_id")


# ------------------------------------------------------------------ token ids

def vocabulary(corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """Offline tokeniser: distinct whitespace tokens -> dense ids, ``(token, token_id)``."""
    toks = unnest(corpus, ws_tokens(text_col), name="token").distinct()
    return dense_index(toks, "token", "token_id")


#: Id of tokens outside the vocabulary; no query may hold it.
UNKNOWN_ID = -1

#: Bytes of texts whose distinct tokens get their ids together.
CODED_BYTES = 8 * 1024 * 1024


def _vocab_side(vocab: DataFrame, max_bytes: int) -> DataFrame:
    size = vocab.agg(F.sum(F.octet_length("token") + ROW_BYTES).alias("b")).first()["b"] or 0
    return F.broadcast(vocab) if size <= max_bytes else vocab


def _coded_texts(corpus: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    """The texts in chunks, written once: a row ``(chunk, words)`` for each chunk's distinct tokens, and
    ``(chunk, doc_id, codes)`` for each text, whose codes (four bytes each) number them."""
    texts = corpus.select(F.col(doc_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    schema = StructType([StructField("chunk", LongType()), StructField("words", ArrayType(BinaryType())), texts.schema["doc_id"],
                         StructField("codes", BinaryType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column("doc_id")
            for at, some in text_chunks(batch.column("text"), CODED_BYTES):
                chunk += 1
                tokens, ends = ws_token_array(some)
                coded = tokens.dictionary_encode()
                offsets, codes = np.concatenate([[0], 4 * ends]).astype(np.int32), coded.indices.to_numpy().astype("<i4").tobytes()
                of = [pa.array(np.full(len(some), chunk)), pa.nulls(len(some), pa.list_(pa.binary())), ids.slice(at, len(some)),
                      pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(codes)])]
                yield pa.RecordBatch.from_arrays(of, names=schema.names)
                words = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), words, pa.nulls(1, ids.type), pa.nulls(1, pa.binary())], names=schema.names)

    return stored(texts.mapInArrow(rows, schema), "coded-texts")


def token_ids(corpus: DataFrame, vocab: DataFrame, doc_col: str = "doc_id",
              text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """TOK1: ``(doc_id, ids array<int>)`` in word order, one row per document.

    A token outside the vocabulary keeps its place as ``UNKNOWN_ID``, so words
    beside it never become neighbours; a document without tokens has no ids.
    Rows of one ``doc_id`` are one document: their tokens are merged by place.

    Only the distinct tokens of ``CODED_BYTES`` of texts meet the vocabulary, which
    is broadcast below ``broadcast_bytes`` (one sizing action) and otherwise joined
    by shuffle; a chunk's texts and the ids of its tokens then meet in one group.
    """
    coded = _coded_texts(corpus, doc_col, text_col)
    texts = coded.where(F.col("codes").isNotNull()).select("chunk", "doc_id", "codes")
    words = (coded.where(F.col("words").isNotNull()).select("chunk", F.posexplode("words").alias("code", "token"))
             .withColumn("token", F.col("token").cast("string")))
    known = words.join(_vocab_side(vocab, broadcast_bytes), "token").select(F.col("chunk").alias("of"), "code", F.col("token_id").cast("int").alias("id"))
    schema = StructType([texts.schema["doc_id"], StructField("ids", ArrayType(IntegerType()))])

    def numbered(some: pa.Table, own: pa.Table) -> pa.Table:
        codes = some.column("codes").to_pylist()
        flat = np.frombuffer(b"".join(codes), dtype="<i4")
        ids = np.full(int(flat.max(initial=-1)) + 1, UNKNOWN_ID, dtype=np.int32)
        ids[own.column("code").to_numpy()] = own.column("id").to_numpy()
        offsets = np.cumsum([0, *(len(x) // 4 for x in codes)]).astype(np.int32)
        return pa.table([some.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[flat]))], names=schema.names)

    found = texts.groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(numbered, schema)
    places = F.sequence(F.lit(0), F.array_max(F.transform("all", F.size)) - 1)
    merged = F.flatten(F.transform(places, lambda p: F.array_sort(F.filter(
        F.transform("all", lambda ids: F.get(ids, p)), lambda x: x.isNotNull()))))
    return (found.groupBy("doc_id").agg(F.collect_list("ids").alias("all"))
            .select("doc_id", F.when(F.size("all") == 1, F.element_at("all", 1))
                    .when(F.array_max(F.transform("all", F.size)) == 0, F.array().cast("array<int>")).otherwise(merged).alias("ids")))


def token_lines(ids: DataFrame) -> DataFrame:
    """TOK2: ``(doc_id, line)`` with ids joined by one space."""
    return ids.select("doc_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")
                      .alias("line"))


def encode_queries(queries: DataFrame, vocab: DataFrame, query_col: str = "query",
                   broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Queries to id arrays with the same vocabulary: ``(query, ids)``.

    A query with a token outside the vocabulary gets ``ids = null`` (it cannot
    occur in the corpus).
    """
    q = (queries.select(F.col(query_col).alias("query")).distinct()
         .select("query", F.posexplode_outer(ws_tokens("query")).alias("pos", "token")))
    j = q.join(_vocab_side(vocab, broadcast_bytes), "token", "left")
    return (j.groupBy("query")
            .agg(F.array_sort(F.collect_list(F.struct("pos", F.col("token_id").cast("int").alias("id"))))
                 .alias("s"),
                 F.count("token").alias("nt"), F.count("token_id").alias("ni"))
            .select("query", F.when((F.col("nt") == F.col("ni")) & (F.col("nt") > 0),
                                    F.transform("s", lambda x: x["id"])).alias("ids")))


def token_occurrence_counts(doc_ids: DataFrame, query_ids: DataFrame,
                            broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """OCC2: overlapping occurrences of id sequences, ``(query, n)`` with zeros.

    The whole-token plan of the occurrence counts over ids; null ids count 0.
    Where tokens are plain whitespace words, ``occurrence_counts(tokens=True)``
    gives the same without turning the corpus into ids.
    """
    def words(col: str):
        return F.transform(col, lambda x: x.cast("string"))

    q = (query_ids.select("query", F.coalesce(words("ids"), F.array().cast("array<string>")).alias("pieces"))
         .distinct().withColumn("k", F.size("pieces")))
    texts = doc_ids.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("text"))
    return count_matches(texts.where(F.col("text").isNotNull()), q, True, False, broadcast_bytes)
