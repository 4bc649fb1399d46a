"""Reversed lexical search against a plain ranking of every document."""

import math
import random
import re
from collections import Counter

from corpusprobe.llm import reversed_search as rs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


def plain_ranking(docs, items, top=10):
    """Sorted (item_id, rank, doc_id, score) of lists of (id, text)."""
    held = [(i, Counter(terms_of(t)), len(terms_of(t))) for i, t in docs if terms_of(t)]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in set(items):
        scored = []
        for doc_id, c, n in held:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in set(terms_of(text)) if c[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def got(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, item string, rank int")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = rs.search_items(d.repartition(5), b, **options)
    assert rows.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted((tuple(r) for r in rows.collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Größe", "ÄB", "x1", "THE"]
    text = lambda k: rng.choice([" ", "-", "\n"]).join(rng.choices(vocabulary, range(64, 0, -1), k=k))
    docs = [(i, text(rng.randrange(0, 80))) for i in range(n)]
    items = [(i, text(rng.randrange(0, 12))) for i in range(25)]
    return docs, items


def test_ranking_against_brute_force(spark):
    docs, items = corpus(1, 300)
    docs += [(1000 + i, docs[4][1]) for i in range(40)]  # ties across tasks
    assert got(spark, docs, items) == plain_ranking(docs, items)
    assert got(spark, docs, items, top=3) == plain_ranking(docs, items, 3)


def test_blocks_and_chunks_change_nothing(spark):
    docs, items = corpus(2, 120)
    kept = rs.BLOCK_POSTINGS, rs.CHUNK_CELLS, rs.CHUNK_ADDS, rs.MERGE_PARTS
    try:
        rs.BLOCK_POSTINGS, rs.CHUNK_CELLS, rs.CHUNK_ADDS, rs.MERGE_PARTS = 40, 30, 50, 3
        assert got(spark, docs, items) == plain_ranking(docs, items)
    finally:
        rs.BLOCK_POSTINGS, rs.CHUNK_CELLS, rs.CHUNK_ADDS, rs.MERGE_PARTS = kept


def test_odd_rows(spark):
    docs, items = corpus(3, 30)
    docs += [(None, docs[0][1]), (None, None), (40, None), (41, ""), (42, " .-\n"), (5, docs[6][1]), (43, "w1 " * 200_000),
             (44, "y" * 300_000)]
    items = [(0, None), (1, ""), (2, "--"), (3, "unheard of"), (None, "w1 w2"), (None, "w3"), (None, "w3"), (4, "w1"), (4, "w2"),
             (5, "y" * 300_000), (6, docs[0][1])]
    assert got(spark, docs, items) == plain_ranking(docs, items)
    assert got(spark, [(1, None), (2, "...")], items) == []
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert rs.search_items(empty, spark.createDataFrame(items, "item_id long, text string")).collect() == []
    assert rs.search_items(spark.createDataFrame(docs, "doc_id long, text string"),
                           spark.createDataFrame([], "item_id long, text string")).collect() == []
