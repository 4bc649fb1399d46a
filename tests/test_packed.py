"""N-grams in packed ranges against sets and sorting."""
import os
import random

import pytest

from corpusprobe.operators import ngrams as ng
from corpusprobe.operators import packed
from corpusprobe.session import ensure_checkpoint_dir

WORDS = ["a", "a\x01", "a\x01b", "ab", "b", "é", "z中", "\U0001f600", "�", "-", "~", "\x7f", "aa", "B"]


def frame(spark, texts):
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id bigint, line_no bigint, line string")


def grams(texts, n):
    found = {" ".join(w[i:i + n]) for t in texts if t for w in [t.split()] for i in range(len(w) - n + 1)}
    return sorted(found, key=lambda x: x.encode())


def some_texts(seed, count):
    rng = random.Random(seed)
    blanks = [" ", "  ", "\t", " ", " ", "\x1c"]
    texts = ["".join(w + rng.choice(blanks) for w in rng.choices(WORDS, k=rng.randrange(0, 30))) for _ in range(count)]
    return [*texts, None, "", " ", *texts[:20]]


@pytest.fixture
def many_ranges(monkeypatch):
    monkeypatch.setattr(ng, "SET_ROWS", 70)
    monkeypatch.setattr(ng, "RANGE_ROWS", 90)
    monkeypatch.setattr(packed, "SAMPLE_EVERY", 3)
    monkeypatch.setattr(packed, "PIECE_ROWS", 17)
    monkeypatch.setattr(packed, "KNOWN_BYTES", 400)
    monkeypatch.setattr(packed, "PASS_ROWS", 500)


@pytest.mark.parametrize("n", [1, 2, 5])
def test_ids_of_many_ranges(spark, many_ranges, n):
    texts, more = some_texts(n, 120), some_texts(n + 9, 160)
    first = ng.ngram_index(frame(spark, texts), n)
    want = grams(texts, n)
    assert [(r["ngram"], r["ngram_id"]) for r in first.orderBy("ngram_id").collect()] == [(g, i) for i, g in enumerate(want)]
    both = ng.extend_index(first, ng.distinct_ngrams(frame(spark, texts + more), n), "ngram", "ngram_id")
    known = set(want)
    want += [g for g in grams(texts + more, n) if g not in known]
    assert [(r["ngram"], r["ngram_id"]) for r in both.orderBy("ngram_id").collect()] == [(g, i) for i, g in enumerate(want)]
    assert both.columns == ["ngram", "ngram_id"] and dict(both.dtypes)["ngram_id"] == "bigint"


def test_an_index_of_other_values_takes_nothing_away(spark, many_ranges):
    """A line feed or another number of words in an index must not pass for n-grams."""
    texts = ["a b c d e f", "g a b c d"]
    index = spark.createDataFrame([("x\na b c d e", 7), ("a b c d e\n", 3), ("a b c d", 4), ("b c d e f g", 5), ("", 6), (None, 9), ("g a b c d", 2)],
                                  "ngram string, ngram_id bigint")
    both = ng.extend_index(index, ng.distinct_ngrams(frame(spark, texts), 5), "ngram", "ngram_id").collect()
    assert sorted((r["ngram_id"], r["ngram"]) for r in both if r["ngram_id"] > 9) == [(10, "a b c d e"), (11, "b c d e f")]
    assert len(both) == index.count() + 2


def test_a_large_index_has_its_own_ranges(spark, many_ranges):
    """Few values beside a large index: its n-grams do not all meet in the ranges of these."""
    index = ng.ngram_index(frame(spark, [" ".join(f"w{i:04d}" for i in range(900))]), 5)
    values = ng.distinct_ngrams(frame(spark, ["w0001 w0002 w0003 w0004 w0005 x"]), 5)
    left = packed.without(values.ngram_ranges, index, "ngram", [r["ngram"].encode() for r in index.collect()[::3]], 896)
    assert len(left.bounds()) >= 9
    assert [(r["ngram"], r["ngram_id"]) for r in ng.extend_index(index, values, "ngram", "ngram_id").where("ngram_id >= 896").collect()] == [
        ("w0002 w0003 w0004 w0005 x", 896)]


def test_no_texts(spark):
    for texts in ([], [None, "", "a b c"]):
        index = ng.ngram_index(frame(spark, texts), 5)
        assert index.count() == 0 and ng.distinct_ngrams(frame(spark, texts), 5).count() == 0
        both = ng.extend_index(index, ng.distinct_ngrams(frame(spark, [*texts, "e d c b a"]), 5), "ngram", "ngram_id")
        assert [tuple(r) for r in both.collect()] == [("e d c b a", 0)]


def test_the_index_takes_little_disk(spark):
    """Pieces, not rows, go through the shuffle, and one copy is stored: less than half of the n-grams' text."""
    rng = random.Random(3)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(1, 12))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(200)]
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")

    def kept() -> dict:
        return {d: sum(os.path.getsize(os.path.join(folder, d, f)) for f in os.listdir(os.path.join(folder, d)) if f.endswith(".parquet"))
                for d in os.listdir(folder) if d.startswith("index-")}

    before = kept()
    found = ng.distinct_ngrams(frame(spark, texts), 5)
    ng.extend_index(ng.ngram_index(frame(spark, texts[:120]), 5), found, "ngram", "ngram_id").count()
    new = {d: size for d, size in kept().items() if d not in before}
    assert len(new) == 2 and sum(new.values()) < 0.5 * sum(map(len, grams(texts, 5)))
    sent = found._jdf.queryExecution().executedPlan().toString().split("Exchange ")[1]
    assert "hashpartitioning(ngram_range" in sent and "packed#" in sent
