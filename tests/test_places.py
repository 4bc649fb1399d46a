import random

from pyspark.sql import functions as F

from corpusprobe.operators import ngrams as ng
from corpusprobe.operators import occurrences as occ
from corpusprobe.operators import places as pl
from corpusprobe.operators.sieves import Sieve
from naive import overlap_count


def _edges(spark, pairs):
    return spark.createDataFrame(pairs, "left string, right string")


def test_only_tokens_near_a_match_leave_a_task(spark):
    """Texts are cut around the few places that may match, before tokens become rows."""
    docs = [(i, " ".join(f"w{i * 40 + k}x" for k in range(40))) for i in range(50)]
    docs += [(99, "we say hello there, my friend now"), (None, "hello there,  oh hello there, my"), (7, "")]
    texts = spark.createDataFrame(docs, "doc_id bigint, text string")
    runs = pl.runs_near(texts, _edges(spark, [("lo", "there, "), ("w3x", "w4x")]), 4, 1 << 20, 2).collect()
    assert sum(len(r["run"].split(b" ")) for r in runs) <= 100   # of 2,000
    got = {(r["doc_id"], r["start"], bytes(r["run"]).decode()) for r in runs}
    assert {(99, 2, "hello there, my"), (0, 3, "w3x w4x w5x")} <= got
    assert {(None, 0, "hello there, "), (None, 4, "hello there, my")} <= got or (None, 0, docs[51][1]) in got


def test_runs_share_no_token_and_miss_no_place(spark):
    rng = random.Random(5)
    docs = ["".join(rng.choice("ab  é") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    for pairs in ([("a", "b")], [("", "a"), ("éb", "")], [("a", "bb a é"), ("é", "aé ")]):
        seen = set()
        for r in pl.runs_near(texts, _edges(spark, pairs), 2, 1 << 20, 2).collect():
            words, own = docs[r["doc_id"]].split(" "), bytes(r["run"]).decode().split(" ")
            assert words[r["start"]:r["start"] + len(own)] == own
            places = {(r["doc_id"], r["start"] + i) for i in range(len(own))}
            assert not places & seen
            seen |= places
        for doc, text in enumerate(docs):
            for n, at in enumerate(i for i, c in enumerate(text) if c == " "):
                if any(text[:at].endswith(a) and text[at + 1:].startswith(b) for a, b in pairs):
                    assert {(doc, n), (doc, n + 1)} <= seen


def test_tokens_without_an_object_each():
    rng = random.Random(3)
    for _ in range(300):
        docs = ["".join(rng.choice("ab \n  é　\x1c 中") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 5))]
        for tokens_of, split in ((pl.ws_token_array, str.split), (pl.spaced_tokens, lambda x: x.split(" "))):
            tokens, ends = tokens_of([d.encode() for d in docs])
            words = [x.decode() for x in tokens.to_pylist()]
            assert [words[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] == [split(d) for d in docs]


def test_grams_of_a_sieve_only(spark):
    words = [f"wört{i:04d}" for i in range(2000)] + ["ab", "日本語学校"]
    vocab = spark.createDataFrame([(w, 1) for w in words], "tok string, freq bigint")
    grams = pl.gram_hashes(spark.createDataFrame([(4, "0042"), (2, "本語"), (2, "zz")], "a int, key string")).checkpoint()
    sieve = Sieve(grams.select("h"), 3)
    rows = pl.token_grams(vocab, [2, 4], sieve).join(grams, "h").collect()
    assert {(r["tok"], r["i"], r["key"]) for r in rows} == {("wört0042", 5, "0042"), ("日本語学校", 2, "本語")}
    assert pl.token_grams(vocab, [2, 4], sieve).count() < 1000
    counts = pl.gram_places(vocab, [2, 4], sieve).join(grams, "h").collect()
    assert {(r["key"], r["places"]) for r in counts} == {("0042", 1), ("本語", 1)}


def test_counts_in_copied_documents_and_wide_characters(spark):
    docs = ["längere Wörter und Wörterbücher", "längere Wörter", "längere Wörter", None, "", "日本 語学 校 の 本", " a  b "]
    asked = ["ö", "ere Wör", "längere Wörter und W", "本 語学 校", "校 の 本", "a  b", "  ", " ", "ücher", "Wört", "zz"]
    corpus = spark.createDataFrame([(i % 3, d) for i, d in enumerate(docs)], "doc_id int, text string")
    queries = spark.createDataFrame([(x,) for x in asked], "query string")
    for size in (0, occ.BROADCAST_BYTES):
        got = {r["query"]: r["n"] for r in occ.occurrence_counts(corpus, queries, broadcast_bytes=size).collect()}
        assert got == {x: sum(overlap_count(d, x) for d in docs if d) for x in asked}
    tally = pl.token_tally(corpus, F.col("text"), pl.ws_token_array).collect()
    assert {(r["token"], r["n"]) for r in tally} >= {("längere", 3), ("a", 1)} and "" not in {r["token"] for r in tally}


def test_ids_move_by_distinct_tokens(spark):
    """The vocabulary meets a chunk's distinct tokens, not every token; rows of one document are merged by place."""
    docs = [(i, "a b " * 2000 + f"x{i}") for i in range(20)] + [(50, "b a X"), (50, "a c"), (None, "a"), (None, None), (51, ""), (52, None)]
    corpus = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    coded = ng._coded_texts(corpus, "doc_id", "text")
    assert coded.where("words is not null").agg(F.sum(F.size("words"))).first()[0] <= 40   # of 80,000 tokens
    vocab = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "token string, token_id bigint")
    for size in (0, 1 << 20):
        got = {r["doc_id"]: r["ids"] for r in ng.token_ids(corpus, vocab, broadcast_bytes=size).collect()}
        assert got.pop(50) == [0, 1, 0, 2, -1] and got.pop(51) == [] and got.pop(52) == [] and got.pop(None) == [0]
        assert got == {i: [0, 1] * 2000 + [-1] for i in range(20)}
