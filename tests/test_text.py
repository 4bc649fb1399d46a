from pyspark.sql import functions as F

from corpusprobe.functions.text import (fixed_tile, fixed_tile_starts, ngram_set, ngram_strings,
                                        power_log, ws_tokens)
from corpusprobe.functions.wordforms import (build_anagram_easy, build_anagram_hard, build_cycles,
                                             build_insertion, build_reverse, combine)
from naive import fixed_tiles, ngrams
from naive import power_log as py_power_log


def _one(spark, expr, value="x", schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_ws_tokens_match_python_split(spark):
    texts = ["a  b\tc\nd", " lead trail ", "x y z　w", "\x1cq\x1fr\x85s", ""]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    got = [r["w"] for r in df.select(ws_tokens("v").alias("w")).collect()]
    assert got == [t.split() for t in texts]


def test_power_log(spark):
    df = spark.createDataFrame([(x,) for x in [1, 2, 3, 8, 9, 1000, 1025]], "v int")
    got = [r["p"] for r in df.select(power_log("v").alias("p")).collect()]
    assert got == [py_power_log(x) for x in [1, 2, 3, 8, 9, 1000, 1025]]
    assert got[:5] == [1, 2, 4, 8, 16]


def test_fixed_tiles_golden(spark):
    for text, length, expected in [("a b c d e", 2, ["a b", "c d", "d e"]),
                                   ("a b c d", 2, ["a b", "c d"]),
                                   ("a", 16, ["a"])]:
        df = spark.createDataFrame([(text,)], "v string").select(ws_tokens("v").alias("w"))
        rows = (df.select("w", F.explode(fixed_tile_starts(F.size("w"), length)).alias("s"))
                .select(fixed_tile("w", "s", length).alias("t")).collect())
        assert [r["t"] for r in rows] == expected == fixed_tiles(text, length)


def test_ngrams_list_and_set(spark):
    df = spark.createDataFrame([("1 2 3 1 2 3",), ("a b c d",)], "v string")
    rows = df.select(ngram_strings(ws_tokens("v"), 2).alias("l"), ngram_set(ws_tokens("v"), 2).alias("s"),
                     ngram_strings(ws_tokens("v"), 5).alias("five")).collect()
    assert rows[0]["l"] == ["1 2", "2 3", "3 1", "1 2", "2 3"]
    assert rows[0]["s"] == ["1 2", "2 3", "3 1"]
    assert rows[1]["five"] == []
    assert [" ".join(g) for g in ngrams("1 2 3 1 2 3", 2)] == rows[0]["l"]


def test_transforms_golden(spark):
    w = F.col("v")
    assert _one(spark, build_reverse(w), "hello") == ["olleh"]
    assert sorted(_one(spark, F.filter(build_cycles(w), lambda x: x != w), "hello")) == \
        sorted(["elloh", "llohe", "lohel", "ohell"])
    assert _one(spark, F.filter(build_cycles(w), lambda x: x != w), "abab") == ["baba"]
    assert sorted(_one(spark, combine(F.lit("olleh"), w), "hello")) == sorted(
        ["hello, olleh", "hello olleh", "hello = olleh", "hello=olleh",
         "olleh, hello", "olleh hello", "olleh = hello", "olleh=hello"])


def test_anagram_and_insertion_properties(spark):
    words = ["cryptography", "house", "abc", "a"]
    df = spark.createDataFrame([(x,) for x in words], "v string")
    w = F.col("v")
    rows = df.select("v", build_anagram_hard(w).alias("h"), build_anagram_easy(w).alias("e"),
                     build_insertion(w).alias("i")).collect()
    for r in rows:
        word = r["v"]
        for x in r["h"]:
            assert x[:1] == word[:1] and x[-1:] == word[-1:]
            assert sorted(x[1:-1]) == sorted(word[1:-1]) if len(word) > 2 else True
        for x in r["e"]:
            # Python slicing w[:2] + w[2:-2] + w[-2:]; short words repeat letters.
            assert x == word[:2] + x[len(word[:2]):len(x) - len(word[-2:])] + word[-2:]
            if len(word) >= 4:
                assert sorted(x) == sorted(word)
        for x in r["i"]:
            assert len(x) == 2 * len(word) - 1 and x[::2] == word
        assert len(r["h"]) <= 5 and len(r["i"]) <= 5
    # Python slicing quirk of a one-letter word is kept: 'a'[:1] + '' + 'a'[-1:]
    assert rows[3]["h"] == ["aa"]


def test_transforms_are_deterministic(spark):
    df = spark.createDataFrame([("deterministic",)], "v string")
    a = df.select(build_anagram_hard(F.col("v")).alias("x")).first()["x"]
    b = df.repartition(3).select(build_anagram_hard(F.col("v")).alias("x")).first()["x"]
    assert a == b
