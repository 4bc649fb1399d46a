"""SimHash classes against all pairs, the covering codes against every word."""

import random
import re

import numpy as np
import pytest
import xxhash

from corpusprobe.llm import simhash_anchors as sh

SF001 = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    k = min(4, len(words))
    hs = [xxhash.xxh64(" ".join(words[i:i + k]).encode(), seed=42).intdigest() for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(rows):
    """doc_id -> smallest id reachable, by comparing all pairs."""
    parent = {i: i for i, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    named = [r for r in rows if r[0] is not None]
    for a, (i, x) in enumerate(named):
        for j, y in named[a + 1:]:
            if (x ^ y).bit_count() <= 4:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in parent}


@pytest.mark.parametrize("code,width,radius", [(sh.golay_code(), 23, 3), (sh.hamming_code(), 22, 1)])
def test_code_covers_all_words_and_neighbours_meet_at_home(code, width, radius):
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << width, 5000)
    assert code.radius == radius and not code.syndrome(code.patterns[:1]).any()
    which, anchor, home = code.anchors(words)
    assert not code.syndrome(anchor).any() and np.array_equal(which[home], np.arange(len(words)))
    assert np.bitwise_count(anchor[home] ^ words).max() <= radius
    assert np.bitwise_count(anchor ^ words[which]).max() == radius + 1
    at_home = dict(zip(which[home].tolist(), anchor[home].tolist(), strict=True))
    for bit in range(width):
        near_which, near_anchor, _ = code.anchors(words[:200] ^ (1 << bit))
        come = set(zip(near_which.tolist(), near_anchor.tolist(), strict=True))
        assert all((i, at_home[i]) in come for i in range(200))


def test_golay_code_is_perfect():
    code = sh.golay_code(0)
    assert len(code.patterns) == 1 << 11 == len(code.starts) - 1


def test_every_pair_within_the_threshold_meets(spark):
    """Fingerprints at 0 to 6 bits from their seed, under both codes and with tiny tiles."""
    rng = random.Random(3)
    fps = []
    for _ in range(60):
        fp = rng.getrandbits(64)
        fps.append(fp)
        for far in range(7):
            fps.append(fp ^ sum(1 << b for b in rng.sample(range(64), far)))
    centre = rng.getrandbits(64)  # a crowded anchor
    fps += [centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)]
    fps = sorted(set(fps))
    want = plain_components(list(enumerate(fps)))
    points = spark.createDataFrame([(i, np.uint64(fp).view(np.int64).item()) for i, fp in enumerate(fps)], "node long, fp long")
    size = sh.TILE
    try:
        for code, tile in ((sh.golay_code(), size), (sh.golay_code(), 7), (sh.hamming_code(), 50)):
            sh.TILE = tile
            found = {i: i for i in range(len(fps))}
            edges = sh.links(points, code)
            for r in sh.components(edges).collect():
                found[r["node"]] = r["component"]
            assert found == want
    finally:
        sh.TILE = size
    rows = sh.links(points, sh.golay_code()).collect()
    assert all((fps[r["u"]] ^ fps[r["v"]]).bit_count() <= 4 for r in rows)


def test_report_against_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    want = plain_components([(i, plain_fingerprint(t)) for i, t in rows])
    got = {r["doc_id"]: r for r in sh.simhash_report(spark.read.parquet(f"{SF001}/documents.parquet")).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert got[i]["fingerprint"] == f"{plain_fingerprint(t):016x}" and got[i]["component_id"] == want[i]
    assert len(set(want.values())) < len(rows)


def test_odd_rows(spark):
    rng = random.Random(4)
    text = " ".join(rng.choice(["Ab", "cd", "ef", "ÄÖ"]) + str(rng.randrange(50)) for _ in range(80))
    other = " ".join(str(rng.random()) for _ in range(60))
    rows = [(7, text), (3, text.lower().replace("ÄÖ".lower(), "ÄÖ")), (9, None), (8, ""), (6, " \n\t"), (None, text), (None, None),
            (5, "one two"), (4, "x" * 300_000), (2, other), (2, text), (11, other), (12, " ".join(map(str, range(300_000))))]
    docs = spark.createDataFrame([(i, t, "z", 1, True) for i, t in rows],
                                 "doc_id long, text string, fp string, node int, home boolean")
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in sh.simhash_report(docs).collect()]
    zero = "0" * 16
    hexed = {t: f"{plain_fingerprint(t):016x}" for _, t in rows}
    want = [(7, hexed[text], 2), (3, hexed[text], 2), (9, zero, 6), (8, zero, 6), (6, zero, 6), (None, hexed[text], None),
            (None, zero, None), (5, hexed["one two"], 5), (4, hexed["x" * 300_000], 4), (2, hexed[other], 2),
            (2, hexed[text], 2), (11, hexed[other], 2), (12, hexed[rows[-1][1]], 12)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sh.simhash_report(docs.limit(0)).collect() == []
