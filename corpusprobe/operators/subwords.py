"""Subword token ids of a corpus and of queries (TOK1, TOK2, TOK4, OCC2).

A published vocabulary file is a parameter: byte-level pair encodings as
``.tiktoken`` ranks or tokenizer ``.json``, sentence pieces as ``.model``. It is
read through Spark on the driver, checked against ``MAX_VOCABULARY_BYTES`` and
sent to the tasks with the plan, so executors need no copy of the file. A task
builds its encoder once and encodes Arrow batches.

Byte-level vocabularies know every string, so any query has ids (a null only
has null), and decoding gives the text back. Ids of one vocabulary are counted in
a corpus by :func:`corpusprobe.operators.ngrams.token_occurrence_counts`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

MAX_VOCABULARY_BYTES = 32 * 1024 * 1024
#: Characters handed to an encoder at once.
CHUNK_CHARS = 500_000

#: Fixed value: the published split of byte-level vocabularies into words, numbers, signs and spaces.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_vocabulary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    """(kind, content) of a vocabulary file; the kind is its suffix."""
    kind = path.rsplit(".", 1)[-1]
    if kind not in ("tiktoken", "json", "model"):
        raise ValueError(f"unknown kind of vocabulary: {path}")
    found = spark.read.format("binaryFile").load(path)
    size = found.agg(F.max("length")).first()[0]
    if size > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has {size} bytes, the bound is {MAX_VOCABULARY_BYTES}")
    return kind, bytes(found.select("content").first()["content"])


class Codec:
    """Encoder and decoder of one vocabulary, all of it plain text: no special tokens."""

    def __init__(self, kind: str, content: bytes):
        self.encode_all: Callable[[list[str]], list[list[int]]]
        self.decode: Callable[[list[int]], str]
        if kind == "tiktoken":
            import base64

            import tiktoken
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, content.splitlines())}
            own = tiktoken.Encoding("vocabulary", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode_all = lambda texts: [own.encode_ordinary(t) for t in texts]
            self.decode = own.decode
        elif kind == "json":
            from tokenizers import Tokenizer
            model = Tokenizer.from_str(content.decode())
            model.encode_special_tokens = True
            self.encode_all = lambda texts: [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
            self.decode = lambda ids: model.decode(ids, skip_special_tokens=False)
        else:
            import sentencepiece
            pieces = sentencepiece.SentencePieceProcessor(model_proto=content)
            self.encode_all = lambda texts: pieces.encode(texts, num_threads=1)
            self.decode = pieces.decode


def _chunks(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts of an Arrow column, about ``CHUNK_CHARS`` together; only these become Python strings."""
    some, size = [], 0
    for text in texts:
        some.append(text.as_py())
        size += len(some[-1] or "")
        if size > CHUNK_CHARS:
            yield some
            some, size = [], 0
    yield some


def encode(df: DataFrame, vocabulary: tuple[str, bytes], text_col: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``ids_col``, the ids of its text; a null text has null ids, an empty one none."""
    if ids_col in df.columns:
        raise ValueError(f"column {ids_col} is there already")
    schema = StructType([*df.schema.fields, StructField(ids_col, ArrayType(IntegerType()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codec(*vocabulary)
        for batch in batches:
            at = 0
            for some in _chunks(batch.column(text_col)):
                found = iter(own.encode_all([t for t in some if t is not None]))
                ids = pa.array([None if t is None else next(found) for t in some], pa.list_(pa.int32()))
                part = batch.slice(at, len(some))
                at += len(some)
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=schema.names)

    return df.mapInArrow(rows, schema)


def decode(df: DataFrame, vocabulary: tuple[str, bytes], ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with ``text_col``, the text of its ids."""
    schema = StructType([*df.schema.fields, StructField(text_col, StringType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codec(*vocabulary)
        for batch in batches:
            texts = [None if ids is None else own.decode(ids) for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(rows, schema)


def subword_ids(corpus: DataFrame, vocabulary: tuple[str, bytes], doc_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """TOK1: ``(doc_id, ids array<int>)``; a document without text has no ids."""
    texts = corpus.select(F.col(doc_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return encode(texts, vocabulary, "text").drop("text")


def subword_queries(queries: DataFrame, vocabulary: tuple[str, bytes], query_col: str = "query") -> DataFrame:
    """TOK4: ``(query, ids)`` of the distinct queries."""
    return encode(queries.select(F.col(query_col).alias("query")).distinct(), vocabulary, "query")


def packed_ids(ids, width: int = 2) -> Column:
    """TOK4: ids as one binary, ``width`` little-endian bytes each; null if an id doesn't fit."""
    def digits(x: Column) -> Column:
        return F.concat(*[F.lpad(F.hex(F.shiftright(x, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(width)])

    ids = F.col(ids) if isinstance(ids, str) else ids
    return F.when(F.forall(ids, lambda x: (x >= 0) & (x < F.lit(1 << (8 * width)))),
                  F.unhex(F.array_join(F.transform(ids, lambda x: digits(x.cast("bigint"))), "")))
