import random

from pyspark.sql import functions as F

from corpusprobe.operators import contamination as con
from naive import fixed_tiles, halving_chars, halving_words


def _prompts(spark, texts, task="t"):
    return spark.createDataFrame([(task, i, t) for i, t in enumerate(texts)],
                                 "task string, prompt_id bigint, text string")


def _corpus(spark, docs):
    return spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")


def test_halving_words_golden(spark):
    p = _prompts(spark, ["a b c d e f g h", "a b c d e f g h", "a b c d e"], "t")
    for corpus_text, idx, expected in [("x c d x", 0, 6), ("x a b x", 1, 4), ("x e x", 2, 2)]:
        r = con.halving_words(p.where(F.col("prompt_id") == idx), _corpus(spark, [corpus_text]), 2)
        row = r.first()
        assert row["longest"] == expected, (corpus_text, row)
        assert row["flagged"] == (expected > 2)
    rump = con.halving_words(p.where(F.col("prompt_id") == 2), _corpus(spark, ["x e x"]), 2).first()
    assert rump["rump"]


def test_halving_chars_golden(spark):
    p = _prompts(spark, ["abcdefgh"])
    assert con.halving_chars(p, _corpus(spark, ["xxcdxx"]), 2).first()["longest"] == 6
    r = con.halving_chars(p, _corpus(spark, ["xxcdxx"]), 4).first()
    assert r["longest"] == 4 and not r["flagged"]


def test_halving_closed_form_matches_loop(spark):
    rng = random.Random(3)
    vocab = "a b c d e".split()
    prompts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    docs = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 12))) for _ in range(6)]

    def occurs(q):
        return any(q in d for d in docs)
    for lb in (2, 4, 16):
        got = {r["prompt_id"]: r["longest"]
               for r in con.halving_words(_prompts(spark, prompts), _corpus(spark, docs), lb).collect()}
        for i, t in enumerate(prompts):
            assert got[i] == halving_words(t, occurs, lb), (lb, t)
        got_c = {r["prompt_id"]: r["longest"]
                 for r in con.halving_chars(_prompts(spark, prompts), _corpus(spark, docs), lb).collect()}
        for i, t in enumerate(prompts):
            assert got_c[i] == halving_chars(t, occurs, lb), (lb, t)


def test_fixed_length_search_and_per_task(spark):
    prompts = ["one two three four five", "alpha beta gamma", "", "six seven"]
    docs = ["zz three four five yy", "alphabet gamma"]
    p = _prompts(spark, prompts)
    flags = {r["prompt_id"]: r for r in con.fixed_length_search(p, _corpus(spark, docs), 2).collect()}
    for i, t in enumerate(prompts):
        hits = [q for q in fixed_tiles(t, 2) if any(q in d for d in docs)]
        assert flags[i]["tiles"] == hits
        assert flags[i]["flagged"] == bool(hits)
    per_task = con.flagged_per_task(con.fixed_length_search(p, _corpus(spark, docs), 2)).collect()
    assert [(r["task"], r["flagged"]) for r in per_task] == [("t", 1)]


def test_rump_ignore_and_normalized_whitespace(spark):
    rng = random.Random(9)
    vocab = "a b c d e".split()
    prompts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    docs = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 12))) for _ in range(6)]

    def occurs(q):
        return any(q in d for d in docs)
    got = {r["prompt_id"]: r["longest"] for r in
           con.halving_words(_prompts(spark, prompts), _corpus(spark, docs), 4, rump="ignore").collect()}
    for i, t in enumerate(prompts):
        assert got[i] == halving_words(t, occurs, 4, ignore_rump=True), t
    p = _prompts(spark, ["alpha beta gamma"])
    c = _corpus(spark, ["x alpha\nbeta  gamma y"])
    assert not con.fixed_length_search(p, c, 3).first()["flagged"]
    assert con.fixed_length_search(p, c, 3, normalize_ws=True).first()["flagged"]


def test_min_words_option(spark):
    p = _prompts(spark, ["short one", "a much longer prompt here"])
    c = _corpus(spark, ["x short one y", "a much longer prompt here"])
    got = {r["prompt_id"]: r["flagged"] for r in con.fixed_length_search(p, c, 8).collect()}
    assert got == {0: True, 1: True}
    got = {r["prompt_id"]: r["flagged"] for r in con.fixed_length_search(p, c, 8, min_words=3).collect()}
    assert got == {0: False, 1: True}


def test_failed_lookups_are_kept_and_counted(spark):
    rows = [("a", 0, b"x y"), ("a", 1, None), ("a", 2, b""), ("b", 3, b"caf\xc3"), ("b", 4, "café".encode()), ("b", 5, b"z" * 50),
            ("c", 6, b"\xff\xfe"), ("a", 7, b"nowhere")]
    prompts = spark.createDataFrame(rows, "task string, prompt_id bigint, raw binary")
    corpus = spark.createDataFrame([(1, "x y x y café"), (2, None)], "doc_id bigint, text string")
    checked = con.prompt_counts_checked(prompts, corpus, "raw", max_chars=20)
    got = {r["prompt_id"]: (r["n"], r["error"]) for r in checked.collect()}
    assert got == {0: (2, None), 1: (None, "null text"), 2: (None, "empty text"), 3: (None, "invalid utf-8"), 4: (1, None),
                   5: (None, "too long"), 6: (None, "invalid utf-8"), 7: (0, None)}
    report = {r["task"]: (r["prompts"], r["failed"], r["n"]) for r in con.lookup_report(checked).collect()}
    assert report == {"a": (4, 2, 2), "b": (3, 2, 1), "c": (1, 1, 0)}
    strings = prompts.select("task", "prompt_id", prompts.raw.cast("string").alias("text"))
    assert {r["prompt_id"]: r["error"] for r in con.prompt_counts_checked(strings, corpus).collect()}[6] == "invalid utf-8"
