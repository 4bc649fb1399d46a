import random
import re

import numpy as np
from pyspark.sql import functions as F

from corpusprobe.operators import lsa
from corpusprobe.operators import minhash as mh
from corpusprobe.operators import natural as nat
from corpusprobe.operators import ngrams as ng
from corpusprobe.operators import embed as em
from corpusprobe.operators import sketches as sk
from naive import natural_count


def test_lines_and_newlines(spark):
    c = spark.createDataFrame([(0, "a\nb\n"), (1, "c"), (2, "a\nb")], "doc_id bigint, text string")
    lines = ng.corpus_lines(c)
    assert [(r["doc_id"], r["line"]) for r in lines.orderBy("doc_id", "line_no").collect()] == \
        [(0, "a"), (0, "b"), (1, "c"), (2, "a"), (2, "b")]
    assert ng.newline_count(c).first()["newlines"] == 3


def test_dense_index_is_ordered_and_dense(spark):
    rng = random.Random(1)
    vals = sorted({"".join(rng.choice("abcdef") for _ in range(5)) for _ in range(500)})
    df = spark.createDataFrame([(v,) for v in vals], "g string").repartition(7)
    got = ng.dense_index(df, "g", "gid", num_partitions=5).collect()
    assert sorted((r["gid"], r["g"]) for r in got) == list(enumerate(vals))


def test_token_space_counts(spark):
    c = spark.createDataFrame([(0, "a b a b a"), (1, "xa b a")], "doc_id bigint, text string")
    vocab = ng.vocabulary(c)
    q = spark.createDataFrame([("a b a",), ("b a",), ("zz a",)], "query string")
    got = {r["query"]: r["n"] for r in
           ng.token_occurrence_counts(ng.token_ids(c, vocab), ng.encode_queries(q, vocab)).collect()}
    assert got == {"a b a": 2, "b a": 3, "zz a": 0}


def test_tokens_outside_the_vocabulary_keep_their_place(spark):
    c = spark.createDataFrame([(0, "a X b"), (1, "a b X"), (2, ""), (3, None), (4, "X")], "doc_id bigint, text string")
    vocab = spark.createDataFrame([("a", 0), ("b", 1)], "token string, token_id bigint")
    ids = ng.token_ids(c, vocab)
    assert {r["doc_id"]: r["line"] for r in ng.token_lines(ids).collect()} == {0: "0 -1 1", 1: "0 1 -1", 2: "", 3: "", 4: "-1"}
    q = ng.encode_queries(spark.createDataFrame([("a b",), ("X",)], "query string"), vocab)
    for size in (0, 1 << 20):
        got = {r["query"]: r["n"] for r in ng.token_occurrence_counts(ids, q, broadcast_bytes=size).collect()}
        assert got == {"a b": 1, "X": 0}


def test_natural_prompt_golden(spark):
    cases = ["abc cba abc", "xx abc, cba. abc cba", "abc_cba", "éabc cba", "cba\tabc\n"]
    lines = spark.createDataFrame([(0, i, t) for i, t in enumerate(cases)],
                                  "doc_id bigint, line_no bigint, line string")
    got = {r["line_no"]: r["n"] for r in
           nat.natural_prompt_counts(lines, {"reverse": [("abc", "cba")]}, keep_zeros=True).collect()}
    assert [got[i] for i in range(len(cases))] == [natural_count(t, "abc", "cba") for t in cases]
    assert [got[i] for i in range(4)] == [1, 1, 0, 0]


def natural_list_count(line, pairs):
    pat = "|".join(rf"(^|\W+){re.escape(a)}\W+{re.escape(b)}($|\W+)|(^|\W+){re.escape(b)}\W+{re.escape(a)}($|\W+)"
                   for a, b in pairs)
    return len(re.findall(pat, line)) if pairs else 0


def test_natural_prefilter_path(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(150)]
    pairs = [(w, w[::-1]) for w in words]
    texts = []
    for _ in range(200):
        toks = [rng.choice(words + [p[1] for p in pairs] + ["x", "y"]) for _ in range(8)]
        texts.append(" ".join(toks))
    lines = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)],
                                  "doc_id bigint, line_no bigint, line string")
    got = {r["line_no"]: r["n"] for r in nat.natural_prompt_counts(lines, {"r": pairs}).collect()}
    want = {i: natural_list_count(t, pairs) for i, t in enumerate(texts)}
    assert got == {i: n for i, n in want.items() if n > 0}


def test_natural_pairs_on_both_plans(spark):
    lines = spark.createDataFrame([(0, 0, "a.b c, a.b"), (0, 1, "-- !! --"), (0, 2, "b c"), (1, 0, ""), (1, 1, None)],
                                  "doc_id bigint, line_no bigint, line string")
    pairs = {"dots": [("a.b", "c"), ("zz", "yy")], "signs": [("--", "!!")], "none": [("b", "x")]}
    for size in (0, 1 << 20):
        got = {(r["doc_id"], r["line_no"], r["transform"]): r["n"]
               for r in nat.natural_prompt_counts(lines, pairs, broadcast_bytes=size).collect()}
        assert got == {(0, 0, "dots"): natural_count("a.b c, a.b", "a.b", "c"),
                       (0, 1, "signs"): natural_count("-- !! --", "--", "!!")}
        report = {r["transform"]: tuple(r)[1:] for r in nat.natural_prompt_docs(lines, pairs, size).collect()}
        assert report == {"dots": (5, 1, 1), "signs": (5, 1, 1), "none": (5, 0, 0)}
    assert nat.natural_prompt_counts(lines, {}).count() == 0
    assert nat.natural_prompt_docs(lines, {}).count() == 0


def _sets(spark, rows):
    return spark.createDataFrame([(k, s) for k, ss in rows.items() for s in ss], "key bigint, shingle string")


def test_containment_golden_and_exact(spark):
    q = _sets(spark, {1: ["1", "2", "3", "4", "5"]})
    x = _sets(spark, {10: ["1", "2", "3", "4", "9"], 11: ["1", "2", "3"], 12: [str(i) for i in range(1, 6)]})
    got = {(r["qkey"], r["key"]): r["containment"] for r in mh.containment_exact(q, x, 0.8).collect()}
    assert got == {(1, 10): 0.8, (1, 12): 1.0}


def test_minhash_estimate_tracks_jaccard(spark):
    a = [f"t{i}" for i in range(400)]
    b = a[:200] + [f"u{i}" for i in range(200)]
    sig = {r["key"]: r["sig"] for r in mh.minhash_signatures(_sets(spark, {1: a, 2: b})).collect()}
    est = spark.createDataFrame([(sig[1], sig[2])], "x array<bigint>, y array<bigint>").select(
        mh.minhash_estimate("x", "y").alias("e")).first()["e"]
    assert abs(est - 200 / 600) < 0.12


def test_embedding_keeps_columns_and_normalises(spark):
    df = spark.createDataFrame([(1, "a b a", "x"), (2, "", "y")], "doc_id bigint, text string, other string")
    out = em.embed_text(df, dim=8).collect()
    assert out[0]["other"] == "x" and len(out[0]["embedding"]) == 8
    assert abs(sum(v * v for v in out[0]["embedding"]) - 1.0) < 1e-5
    assert out[1]["embedding"] == [0.0] * 8


def test_seeded_subset_is_stable(spark):
    df = spark.range(200).withColumnRenamed("id", "doc_id")
    first = [r["doc_id"] for r in df.orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("1066")))).collect()]
    for n in (0, 1, 10, 100, 199, 200, 300):
        for frame in (df, df.repartition(5)):
            assert sorted(r["doc_id"] for r in em.seeded_subset(frame, n).collect()) == sorted(first[:n])
    odd = spark.createDataFrame([(None,)] * 5 + [(7,)] * 50 + [(i,) for i in range(20)], "doc_id bigint")
    assert [em.seeded_subset(odd, n).count() for n in (1, 30, 60, 75, 80)] == [1, 30, 60, 75, 75]


def test_predict_batch_encoder(spark):
    import numpy as np

    def make():
        def predict(texts):
            return np.stack([np.full(4, len(t), dtype=np.float32) for t in texts])
        return predict
    df = spark.createDataFrame([(1, "abc"), (2, "hello")], "doc_id bigint, text string")
    out = {r["doc_id"]: r["embedding"] for r in em.embed_with_model(df, make, dim=4, batch_size=1).collect()}
    assert out == {1: [3.0] * 4, 2: [5.0] * 4}


def test_index_is_extended_without_moving_ids(spark):
    rng = random.Random(3)
    first = sorted({str(rng.randrange(5000)) for _ in range(300)})
    more = [str(rng.randrange(5000)) for _ in range(600)] + [None]
    frame = lambda values: spark.createDataFrame([(v,) for v in values], "v string")
    start = ng.dense_index(frame(first), "v")
    assert sorted((r["id"], r["v"]) for r in start.collect()) == list(enumerate(first))
    rows = ng.RANGE_ROWS
    try:
        ng.RANGE_ROWS = 50  # several ranges
        got = {r["v"]: r["id"] for r in ng.extend_index(start, frame(more), "v").collect()}
    finally:
        ng.RANGE_ROWS = rows
    new = sorted(set(more) - set(first) - {None})
    assert [got[v] for v in first + new] == list(range(len(first) + len(new))) and len(got) == len(first) + len(new)
    assert ng.extend_index(start, frame(first), "v").count() == len(first)
    empty = ng.dense_index(frame([]), "v")
    assert empty.count() == 0 and ng.extend_index(empty, frame(["b", "a"]), "v").orderBy("id").first()["v"] == "a"


def test_ranges_follow_the_rows_not_the_session(spark):
    values = spark.range(3000).selectExpr("cast(id AS string) AS v")
    rows = ng.RANGE_ROWS
    try:
        ng.RANGE_ROWS = 500
        assert ng.dense_index(values, "v").rdd.getNumPartitions() == 6
    finally:
        ng.RANGE_ROWS = rows


def test_united_sketches_equal_the_sketch_of_all(spark):
    rng = random.Random(6)
    rows = spark.createDataFrame([(f"p{i % 7}", f"g{rng.randrange(40_000)}") for i in range(60_000)], "part string, v string")
    exact = rows.select("v").distinct().count()
    early, late = rows.where("part < 'p4'"), rows.where("part >= 'p3'")  # p3 comes twice
    stored = sk.add_part(sk.sketch_values(early, "v", "part"), late, "v", "part")
    assert stored.count() == 7
    united = sk.sketched_cardinality(sk.merge_sketches(stored)).first()["n"]
    whole = sk.sketched_cardinality(sk.merge_sketches(sk.sketch_values(rows, "v"))).first()["n"]
    assert united == whole and abs(united - exact) < 4 * sk.ERROR / 2 ** (sk.LG_K / 2) * exact


def test_lsa_against_full_factorisation(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    model = lsa.fit_lsa(docs, dim=16, buckets=512)
    rows = em.embed_text(docs, encoder=lsa.lsa_encoder(model)).orderBy("doc_id").collect()
    got = np.array([r["embedding"] for r in rows])
    buckets = [np.array(r["b"], dtype=np.int64) for r in
               docs.select("doc_id", em.token_buckets("text", 512).alias("b")).orderBy("doc_id").collect()]
    counts = np.array([np.bincount(b, minlength=512) for b in buckets], dtype=float)
    some = counts.sum(axis=1) > 0
    idf = np.log((1 + some.sum()) / (1 + (counts > 0).sum(axis=0))) + 1
    a = counts * idf
    a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
    _, singular, right = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(model.weights, idf) and np.abs(model.singular / singular[:16] - 1).max() < 0.01
    want = a @ right[:16].T
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-300)
    # Nearest neighbours agree, but for ties of copies: compare their similarities.
    near, true = (np.sort(x @ x.T - 2 * np.eye(len(x)), axis=1)[some, -5:] for x in (got, want))
    assert np.abs(near - true).mean() < 0.01
    same = ((got @ got.T > 0.8) == (want @ want.T > 0.8))[np.ix_(some, some)].mean()
    assert same > 0.98


def test_lsa_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "c " * 5000), (None, "a b a")], "doc_id bigint, text string")
    model = lsa.fit_lsa(docs, dim=4, buckets=32, extra=4)
    out = {r["doc_id"]: r["embedding"] for r in em.embed_text(docs.withColumn("other", F.lit(1)), encoder=lsa.lsa_encoder(model)).collect()}
    assert out[2] == out[3] == [0.0] * 4 and out[1] == out[None] and abs(sum(x * x for x in out[1]) - 1) < 1e-5
    assert em.embed_text(docs.limit(0), encoder=lsa.lsa_encoder(lsa.fit_lsa(docs.limit(0), dim=4, buckets=32))).count() == 0


def test_pair_bitmap_keeps_all_matches(spark):
    """Many pairs, several bitmaps, both joins: the same counts as the plain pattern."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(200)] + ["x-y", "é", "a.b.c"]
    text = [(0, i, rng.choice([" ", ", ", " - "]).join(rng.choices(vocabulary, k=12))) for i in range(150)]
    lines = spark.createDataFrame(text, "doc_id bigint, line_no bigint, line string")
    pairs = {"p": [tuple(rng.sample(vocabulary, 2)) for _ in range(4500)], "q": [("w1", "--"), ("x-y", "é")]}
    want = {}
    for _, i, line in text:
        for name, listed in pairs.items():
            n = natural_list_count(line, [x for x in listed if x[0] in line and x[1] in line])
            if n:
                want[i, name] = n
    for limit in (nat.BROADCAST_BYTES, 0):
        got = {(r["line_no"], r["transform"]): r["n"] for r in nat.natural_prompt_counts(lines, pairs, broadcast_bytes=limit).collect()}
        assert got == want and len(want) > 100


def test_distinct_ngrams_of_long_and_odd_lines(spark, monkeypatch):
    """Copies go among a bounded number of n-grams in a task, and no table of them is aggregated before the shuffle."""
    monkeypatch.setattr(ng, "SET_ROWS", 7)
    texts = ["a b c d e f " * 9, "a\u00a0b\u2028c d\x1ce", "a b c d", "", None, "é b c d e", "a b c d e f g h i j k l m n o p q r s t u v w x y z"]
    lines = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id bigint, line_no bigint, line string")
    found = ng.distinct_ngrams(lines, 5)
    want = {" ".join(w[i:i + 5]) for t in texts if t for w in [t.split()] for i in range(len(w) - 4)}
    rows = [r["ngram"] for r in found.collect()]
    assert sorted(rows) == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    below = plan.split("== Initial Plan ==")[-1].split("Exchange hashpartitioning(ngram")
    assert len(below) == 2 and "Aggregate" not in below[1]


def test_index_copies_are_compressed_files(spark):
    values = spark.createDataFrame([(f"v{i % 977:04d}",) for i in range(3000)], "v string").distinct()
    index = ng.dense_index(values, "v", num_partitions=4)
    assert "parquet" in index._jdf.queryExecution().optimizedPlan().treeString().lower()
    assert [(r["v"], r["id"]) for r in index.orderBy("v").collect()] == [(f"v{i:04d}", i) for i in range(977)]


def test_factored_regex_counts_like_the_alternation(spark):
    import random
    rng = random.Random(5)
    words = ["a", "b", "ab", "ba", "é", "a_b", "it's", "b."]
    pairs = [("t", i, *rng.choices(words, k=2)) for i in range(6)]
    lines = [(i, 0, "".join(rng.choice([*words, " ", " ", ", ", "\n"]) + rng.choice([" ", "", "; "]) for _ in range(rng.randrange(0, 14)))) for i in range(300)]
    df = spark.createDataFrame(lines, "doc_id bigint, line_no bigint, line string")
    table = spark.createDataFrame(pairs, "transform string, idx bigint, word string, transformed string").orderBy("idx")
    both = table.agg(F.sort_array(F.collect_list(F.struct("idx", nat.pair_core("word", "transformed").alias("c"),
                                                          nat.unitary_regex("word", "transformed").alias("r")))).alias("x"))
    counted = df.crossJoin(both).select(
        F.regexp_count("line", nat.factored_regex(F.transform("x", lambda v: v["c"]))).alias("n"),
        F.regexp_count("line", nat.regex_from_pairs(F.transform("x", lambda v: v["r"]))).alias("m")).collect()
    assert [r["n"] for r in counted] == [r["m"] for r in counted] and sum(r["n"] for r in counted) > 50
    patterns = nat._keyed_patterns(table.withColumn("word", F.lit("'x")))
    assert patterns.where(F.col("core").isNotNull()).count() == 0


def test_lsa_buckets_are_those_of_the_columns(spark):
    texts = ["a b\u00a0c  a", "", None, "é\x1cü\u2028z", " \t", "längere Wörter " * 5]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    want = [r["b"] or [] for r in df.orderBy("doc_id").select(em.token_buckets("text", 4096).alias("b")).collect()]
    assert [x.tolist() for x in lsa.TokenBuckets(4096).rows(texts)] == want
