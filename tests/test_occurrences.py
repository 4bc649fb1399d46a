import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusprobe.operators import occurrences as occ
from corpusprobe.operators.occurrences import occurrence_counts
from naive import overlap_count
from nested_loop import occurrence_counts_naive


def _counts(spark, docs, queries, **kw):
    c = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    q = spark.createDataFrame([(x,) for x in queries], "query string")
    return {r["query"]: r["n"] for r in occurrence_counts(c, q, **kw).collect()}


def test_golden_overlapping(spark):
    got = _counts(spark, ["aaaa", "a.b.a.b.a"], ["aa", "a.b.a"])
    assert got == {"aa": 3, "a.b.a": 2}


def test_no_cross_document_match(spark):
    got = _counts(spark, ["ab c", "d ef"], ["c d", "ab c", "c"])
    assert got == {"c d": 0, "ab c": 1, "c": 1}


def test_all_piece_classes_against_python(spark):
    rng = random.Random(7)
    alphabet = "ab \n."
    docs = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    queries = set()
    for _ in range(300):
        d = rng.choice(docs)
        if len(d) < 2:
            continue
        i = rng.randrange(len(d))
        queries.add(d[i:i + rng.randint(1, 20)])
    queries |= {"a", " ", "  ", "a a a a a a a a a", " a ", "b b", "ab ab ab", ". a"}
    queries.discard("")
    for size in (0, occ.BROADCAST_BYTES):
        got = _counts(spark, docs, sorted(queries), broadcast_bytes=size)
        for q in queries:
            assert got[q] == sum(overlap_count(d, q) for d in docs), q


def test_long_queries_use_several_chunks(spark):
    words = [f"w{i % 5}" for i in range(80)]
    doc = " ".join(words)
    queries = [" ".join(words[s:s + n]) for s, n in [(0, 20), (3, 17), (10, 40), (5, 13), (1, 7)]]
    got = _counts(spark, [doc, doc + " x"], queries)
    for q in queries:
        assert got[q] == 2 * overlap_count(doc, q)


def test_per_doc_and_shuffle_path(spark):
    docs = ["x the cat sat the cat", "the cat", "cat the cat"]
    c = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    q = spark.createDataFrame([("the cat",), ("cat",), ("t sat the c",)], "query string")
    rows = occurrence_counts(c, q, per_doc=True, broadcast_bytes=0).collect()
    got = {(r["query"], r["doc_id"]): r["n"] for r in rows}
    for qs in ["the cat", "cat", "t sat the c"]:
        for i, d in enumerate(docs):
            n = overlap_count(d, qs)
            assert got.get((qs, i), 0) == n


def test_naive_plan_agrees(spark):
    docs = ["abc abc", "xabcx a\\Eb", "ab\nc"]
    c = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    q = spark.createDataFrame([("abc",), ("a\\Eb",), ("b\nc",), ("c a",)], "query string")
    a = {r["query"]: r["n"] for r in occurrence_counts(c, q).collect()}
    b = {r["query"]: r["n"] for r in occurrence_counts_naive(c, q).collect()}
    assert a == b


def test_plan_has_no_nested_loop(spark):
    docs = spark.createDataFrame([(0, "a b c d e f g h")], "doc_id bigint, text string")
    q = spark.createDataFrame([("b c d e",), ("c",), ("a b",)], "query string")
    plan = occurrence_counts(docs, q)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=25), min_size=1, max_size=6),
       st.lists(st.text(alphabet="ab ", min_size=1, max_size=6), min_size=1, max_size=6))
def test_property_overlap(spark, docs, queries):
    got = _counts(spark, docs, queries)
    for q in set(queries):
        assert got[q] == sum(overlap_count(d, q) for d in docs)


def test_whole_tokens(spark):
    docs = ["a b\tc a  b", "ab c", None, "", "a\nb c d e f g h i a b"]
    want = {"a b": 4, "a  b": 4, "b c": 2, "a b c d e f g h i": 1, "c": 3, "zz": 0, " ": 0}
    for size in (0, occ.BROADCAST_BYTES):
        assert _counts(spark, docs, list(want), tokens=True, broadcast_bytes=size) == want


def test_queries_with_spaces_between_letters(spark):
    docs = ["say w o,r d now", "w o,r d w o,r d", "word = drow", "xword = drowx"]
    got = _counts(spark, docs, ["w o,r d", "word = drow", "o,r d w"])
    assert got == {"w o,r d": 3, "word = drow": 2, "o,r d w": 1}


def test_size_covers_the_broadcast_rows(spark):
    prompts = [" ".join(f"wörd{(i * 7 + j) % 991}" for j in range(500)) for i in range(20)]
    q = occ.distinct_queries(spark.createDataFrame([(p,) for p in prompts], "query string")).withColumn(
        "qid", occ.F.monotonically_increasing_id())
    chunks = occ.chunk_queries(q)
    real = sum(sum(len(v.encode()) + 16 if isinstance(v, str) else 8 for v in row) for row in chunks.collect())
    estimate = occ._plan({"many": chunks}).bytes["many"]
    texts = sum(len(p.encode()) for p in prompts)
    assert real <= estimate <= 20 * texts  # linear in the texts, though a prompt has 83 chunks


def test_one_inner_piece_meets_few_positions(spark):
    words = [f"word{i:03d}" for i in range(300)]
    docs = [" = ".join(words)]
    q = occ.distinct_queries(spark.createDataFrame([(f"{w} = x{w}",) for w in words], "query string")).withColumn(
        "qid", occ.F.monotonically_increasing_id())
    chunks = occ.chunk_queries(q)
    toks = occ._tokens(spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string"), "doc_id", "text", False)
    classes = occ._plan({"many": chunks}).many
    joined = occ.token_windows(toks, classes).join(chunks, ["s", "a", "b", "key"]).count()
    assert joined == 0  # every query has the inner piece, none the edges


def test_both_join_plans(spark):
    docs = spark.createDataFrame([(0, "a b c d e f g h")], "doc_id bigint, text string")
    q = spark.createDataFrame([("b c d e",), ("c",), ("a b",)], "query string")
    for size, broadcasts in ((0, False), (occ.BROADCAST_BYTES, True)):
        plan = occurrence_counts(docs, q, broadcast_bytes=size)._jdf.queryExecution().optimizedPlan().toString()
        assert ("strategy=broadcast" in plan) == broadcasts


def test_sieves_drop_rows_before_a_shuffle(spark):
    """Windows and pairs without a partner stay where they are, also when the queries are too many to send."""
    docs = [(i, " ".join(f"w{i * 40 + k}x" for k in range(40))) for i in range(50)] + [(99, "say hello there, my friend now")]
    toks = occ._tokens(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", False)
    q = occ.distinct_queries(spark.createDataFrame([("lo there, my fr",), ("o there, m",), ("ere, my",)], "query string")).withColumn(
        "qid", F.monotonically_increasing_id()).localCheckpoint()
    chunks, pairs = occ.chunk_queries(q), occ.pair_queries(q)
    classes = [tuple(r) for r in chunks.select("s", "a", "b").distinct().collect()]
    assert occ.token_windows(toks, classes).count() > 2000
    kept = occ.token_windows(toks, classes, sieve=occ.Sieve(occ.chunk_hashes(chunks), 6))
    assert 2 <= kept.count() <= 20
    near = occ.token_pairs(toks, [tuple(r) for r in pairs.select("a1", "a2").distinct().collect()], ["doc_id"], occ.Sieve(occ.pair_hashes(pairs), 3))
    assert 1 <= near.count() <= 10


def test_large_query_tables_count_the_same(spark):
    docs = [(1, "a b c a b c  a b"), (2, "xa bc a b"), (3, None), (4, "längere Wörter, längere Wörterbücher")]
    asked = ["a b", "a b c", "b c a", " a", "", "b ", "  ", "c  a", "längere Wörter", "ere Wörterb", "a b c a b c  a b", "zz y"]
    asked += [f"{x}{i}{y}" for i in range(30) for x, y in (("u", " v"), ("u v", " w x"))]  # too large to send with one block allowed
    corpus = spark.createDataFrame(docs, "doc_id bigint, text string")
    queries = spark.createDataFrame([(x,) for x in asked], "query string")
    for bound in (0, 4096, occ.BROADCAST_BYTES):
        got = {r["query"]: r["n"] for r in occ.occurrence_counts(corpus, queries, broadcast_bytes=bound).collect()}
        assert got == {x: sum(t.startswith(x, i) for _, t in docs if t for i in range(len(t))) for x in asked if x}
