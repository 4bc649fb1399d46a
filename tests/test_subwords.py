"""Subword ids against a plain encoder over the published ranks, and round trips."""

import base64
import os
import struct

import pytest
import regex

from corpusprobe.operators import ngrams as ng
from corpusprobe.operators import subwords as sw

FOLDER = os.environ.get("TOKENIZERS", "/opt/tokenizers")
BYTE_LEVEL = ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"]
TEXTS = ["", " ", "Hello  world, it's 1234 <|endoftext|>\n\n x ", "ñandú größe   日本 🎉", "a" * 3000, "\t\r\n  \n", None,
         "the cat sat on the mat the cat sat", "unheard-of Xyzzyq wörd"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no vocabulary files")


def plain_ids(ranks, text):
    """Split, then merge the lowest-ranked neighbours until none is listed."""
    out = []
    for word in regex.findall(sw.BYTE_LEVEL_PATTERN, text):
        parts = [bytes([b]) for b in word.encode()]
        while len(parts) > 1:
            rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if rank == 1 << 40:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        out += [ranks[p] for p in parts]
    return out


def texts_table(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").repartition(3)


@pytest.mark.parametrize("name", BYTE_LEVEL + ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_round_trip(spark, name):
    vocabulary = sw.read_vocabulary(spark, f"{FOLDER}/{name}")
    back = sw.decode(sw.encode(texts_table(spark), vocabulary, "text"), vocabulary).orderBy("doc_id").collect()
    assert [r["ids"] is None for r in back] == [t is None for t in TEXTS]
    if name in BYTE_LEVEL:  # the others change white space, case or unknown characters
        assert [r["decoded"] for r in back] == TEXTS


def test_ids_by_definition(spark):
    with open(f"{FOLDER}/{BYTE_LEVEL[0]}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(40)
    for table in (texts_table(spark).where("length(text) < 1000 or text is null"), docs):
        texts = {r["doc_id"]: r["text"] for r in table.collect()}
        rows = sw.subword_ids(table, sw.read_vocabulary(spark, f"{FOLDER}/{BYTE_LEVEL[0]}")).collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert r["ids"] == plain_ids(ranks, texts[r["doc_id"]] or "")


def test_counts_by_brute_force(spark):
    """Every query has ids, unseen words too; counts are overlapping runs of ids."""
    vocabulary = sw.read_vocabulary(spark, f"{FOLDER}/{BYTE_LEVEL[0]}")
    queries = spark.createDataFrame([(q,) for q in ("the cat", " the cat", "Xyzzyq", " sat", "aaaaaaaa", "never seen ☃", "日本")],
                                    "query string")
    ids = sw.subword_ids(texts_table(spark), vocabulary)
    asked = sw.subword_queries(queries, vocabulary)
    assert asked.where("ids is null or size(ids) = 0").count() == 0
    docs = [r["ids"] for r in ids.collect()]
    want = {r["query"]: sum(d[i:i + len(r["ids"])] == r["ids"] for d in docs for i in range(len(d))) for r in asked.collect()}
    got = {r["query"]: r["n"] for r in ng.token_occurrence_counts(ids, asked).collect()}
    assert got == want and want[" the cat"] == 1 and want["the cat"] == 1 and want["never seen ☃"] == 0


def test_packed_ids(spark):
    df = spark.createDataFrame([([0, 1, 255, 256, 50_256, 65_535],), ([],), ([65_536],), ([-1],), (None,)], "ids array<int>")
    got = [r[0] for r in df.select(sw.packed_ids("ids")).collect()]
    assert bytes(got[0]) == struct.pack("<6H", 0, 1, 255, 256, 50_256, 65_535)
    assert bytes(got[1]) == b"" and got[2:] == [None] * 3
    assert bytes(df.select(sw.packed_ids("ids", 4)).collect()[2][0]) == struct.pack("<I", 65_536)


def test_vocabulary_files_are_checked(spark, tmp_dir):
    with pytest.raises(ValueError):
        sw.read_vocabulary(spark, f"{tmp_dir}/words.txt")
    bound = sw.MAX_VOCABULARY_BYTES
    try:
        sw.MAX_VOCABULARY_BYTES = 100
        with pytest.raises(ValueError):
            sw.read_vocabulary(spark, f"{FOLDER}/{BYTE_LEVEL[0]}")
    finally:
        sw.MAX_VOCABULARY_BYTES = bound
    table = spark.createDataFrame([("x", 1)], "text string, ids int")
    with pytest.raises(ValueError):
        sw.encode(table, ("tiktoken", b""), "text")


def test_chunks_of_an_arrow_column_are_bounded(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(sw, "CHUNK_CHARS", 10)
    texts = ["abcdef", None, "ghijkl", "m", "", "nopqrstuvwxyz", "a"]
    chunks = list(sw._chunks(pa.array(texts)))
    assert [t for c in chunks for t in c] == texts and [len(c) for c in chunks] == [3, 3, 1]
