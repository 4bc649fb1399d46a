"""LSH Ensemble: signatures, size parts and the prefix index against plain definitions."""

import hashlib
import math
import random

import numpy as np

from corpusprobe.operators import lsh_ensemble as lsh
from corpusprobe.operators import minhash as mh


def rows_of(spark, sets):
    return spark.createDataFrame([(k, list(s)) for k, s in sets.items()], "key bigint, shingles array<string>")


def sets_of(rows):
    return lsh.Sets(rows, rows["key"], rows["shingles"])


def exploded(rows):
    return rows.selectExpr("key", "explode(shingles) AS shingle")


def random_sets(seed, n=150):
    rng = random.Random(seed)
    universe = [f"s{i}" for i in range(6000)]
    index, queries = {}, {}
    for k in range(n):
        index[k] = rng.sample(universe, rng.choice([5, 20, 60, 200, 900]))
        if k % 2 == 0:
            own = index[k][: max(3, int(len(index[k]) * rng.uniform(0.3, 1.0)))]
            queries[1000 + k] = own[:60] + [f"x{i}" for i in range(rng.randrange(0, len(own[:60]) // 3 + 1))]
    return queries, index


def test_signatures_by_definition(spark):
    rng = random.Random(5)
    sets = {1: ["a"], 2: [f"t{i}" for i in range(300)], 3: [], 4: [str(rng.random()) for _ in range(40)]}
    got = {r["key"]: r for r in lsh.set_signatures(rows_of(spark, sets)).collect()}
    assert sorted(got) == [1, 2, 4]
    for k, r in got.items():
        hashes = [int(hashlib.md5(s.encode()).hexdigest()[:8], 16) % mh.PRIME for s in sets[k]]
        assert r["size"] == len(sets[k])
        assert r["sig"] == [min((a * h + b) % mh.PRIME for h in hashes) for a, b in mh.permutations()]
    chunk = lsh.CHUNK
    try:
        lsh.CHUNK = 7
        assert {r["key"]: r for r in lsh.set_signatures(rows_of(spark, sets)).collect()} == got
    finally:
        lsh.CHUNK = chunk
    wide = {r["key"]: r for r in mh.minhash_signatures(exploded(rows_of(spark, sets))).collect()}
    assert wide == got


def cost(sizes, bounds):
    cells, low = 0, 0
    for u in bounds:
        part = [x for x in sizes if low < x <= u]
        cells += sum(u - x for x in part) * 1000 // u
        low = u
    return cells


def test_size_bounds_are_the_cheapest():
    rng = random.Random(2)
    for _ in range(20):
        sizes = sorted(rng.choice([3, 5, 8, 8, 13, 20, 40, 41, 60]) for _ in range(30))
        distinct = sorted(set(sizes))
        histogram = [(sizes.count(x), x * sizes.count(x), x) for x in distinct]
        for parts in (1, 2, 3, 20):
            bounds = lsh.size_bounds(histogram, parts)
            assert len(bounds) == min(parts, len(distinct)) and bounds[-1] == sizes[-1] and bounds == sorted(set(bounds))
            best = min(cost(sizes, [*cut, distinct[-1]]) for cut in combinations_of(distinct[:-1], len(bounds) - 1))
            assert cost(sizes, bounds) == best
    assert lsh.size_bounds([], 4) == []


def combinations_of(values, n):
    from itertools import combinations
    return combinations(values, n)


def expected_candidates(bounds, pairs):
    """By the probabilities of the layouts, for (set size, query size, containment)."""
    total = 0
    for x, q, c in pairs:
        qb = 1 << (q.bit_length() - 1)
        u = min(b for b in bounds if b >= x)
        if u >= 0.8 * qb:
            trees, r = lsh.layout(u, qb, 0.8)
            total += 1 - (1 - (c / (x / q + 1 - c)) ** r) ** trees
    return total


def test_fewer_false_candidates_than_equal_counts():
    """The dynamic program against parts of equal numbers of sets, heavy-tailed sizes, containments below the threshold."""
    for seed in range(4):
        rng = random.Random(seed)
        asked = [int(min(20 * (1 - rng.random()) ** -1.0, 1500)) for _ in range(60)]
        pairs = [(int(q * rng.uniform(1, 6)), q, rng.uniform(0, 0.78)) for q in rng.choices(asked, k=1500)]
        sizes = sorted(x for x, _, _ in pairs)
        histogram = [(sizes.count(x), x * sizes.count(x), x) for x in sorted(set(sizes))]
        least = expected_candidates(sorted(set(sizes)), pairs)  # a part for each size
        for parts in (16, 32):
            equal = sorted({sizes[(i + 1) * len(sizes) // parts - 1] for i in range(parts)})
            best = lsh.size_bounds(histogram, parts)
            assert least <= expected_candidates(best, pairs) < expected_candidates(equal, pairs)


def test_recall_and_precision_against_exact(spark):
    queries, index = random_sets(11)
    q, x = rows_of(spark, queries), rows_of(spark, index)
    exact = {(r["qkey"], r["key"]): r["containment"] for r in mh.containment_exact(exploded(q), exploded(x), 0.8).collect()}
    for limit in (lsh.BROADCAST_BYTES, 0):  # both join plans
        got = {(r["qkey"], r["key"]): r["containment"]
               for r in lsh.containment_lsh(sets_of(q), sets_of(x), 0.8, num_part=8, broadcast_bytes=limit).collect()}
        assert got.items() <= exact.items()
        assert len(exact) > 30 and len(got) >= 0.95 * len(exact)


def test_candidates_by_definition(spark):
    """Every pair whose signatures agree on a chosen run of r values, and no other."""
    queries, index = random_sets(4, 60)
    sig = {k: r["sig"] for k, r in ((r["key"], r) for s in (queries, index) for r in lsh.set_signatures(rows_of(spark, s)).collect())}
    bounds, table = lsh.build_lsh_index(rows_of(spark, index), num_part=4)
    assert table.count() == mh.NUM_PERM * len(index)
    want = set()
    for q, own in queries.items():
        qb = 1 << (len(own).bit_length() - 1)
        for k, s in index.items():
            u = min(b for b in bounds if b >= len(s))
            if u < 0.8 * qb:
                continue
            trees, r = lsh.layout(u, qb, 0.8)
            if any(sig[q][t * r:t * r + r] == sig[k][t * r:t * r + r] for t in range(trees)):
                want.add((q, k))
    asked = lsh.set_signatures(rows_of(spark, queries)).withColumnRenamed("key", "qkey")
    assert {tuple(r) for r in lsh.lsh_candidates(asked, bounds, table).collect()} == want


def test_layout_reaches_recall_with_the_longest_prefix():
    for u, q in ((10, 10), (40, 30), (300, 30), (20_000, 30)):
        trees, r = lsh.layout(u, q, 0.8)
        s = min(0.8 / (u / q + 0.2), 1.0)
        assert trees * r <= mh.NUM_PERM
        reached = 1 - (1 - s ** r) ** trees >= lsh.RECALL - 1e-12
        assert reached or (trees, r) == (mh.NUM_PERM, 1)
        if r < lsh.DEPTH and reached:
            assert 1 - (1 - s ** (r + 1)) ** (mh.NUM_PERM // (r + 1)) < lsh.RECALL


def test_stored_index_answers_the_same(spark, tmp_dir):
    queries, index = random_sets(7, 60)
    q, x = rows_of(spark, queries), rows_of(spark, index)
    built = lsh.build_lsh_index(x, num_part=4)
    lsh.save_lsh_index(*built, f"{tmp_dir}/index")
    loaded = lsh.load_lsh_index(spark, f"{tmp_dir}/index")
    assert loaded[0] == built[0] and loaded[1].count() == built[1].count()
    both = [sorted(map(tuple, lsh.containment_lsh(sets_of(q), sets_of(x), built=b).collect())) for b in (built, loaded)]
    assert both[0] == both[1] and both[0]


def test_empty_sides(spark):
    some, none = sets_of(rows_of(spark, {1: ["a", "b"], 2: []})), sets_of(rows_of(spark, {3: []}))
    assert lsh.containment_lsh(some, none).count() == 0
    assert lsh.containment_lsh(none, some).count() == 0
    assert [(r["qkey"], r["key"]) for r in lsh.containment_lsh(some, some).collect()] == [(1, 1)]


def test_keys_without_shingles(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "a b"), (3, None), (4, " a  b c\nd e f ")], "k bigint, t string")
    keys = lsh.indexed_keys(df, "k", "t", 5)
    assert sorted(r["key"] for r in keys.collect()) == [1, 4]
    assert sorted(r["key"] for r in lsh.set_rows(df, "k", "t", 5).where("size(shingles) > 0").collect()) == [1, 4]


def test_prefix_arithmetic():
    h = np.array([0, 1, mh.PRIME - 1], dtype=np.int64)
    for a, b in mh.permutations()[:20]:
        assert lsh.minima(h, np.arange(3), [(a, b)])[:, 0].tolist() == [(a * int(x) + b) % mh.PRIME for x in h]
    assert math.isclose(mh.PRIME, 2**31 - 1)


def test_texts_have_the_signatures_of_their_rows(spark):
    spaces = "".join(chr(c) for c in range(0x3100) if not chr(c).isalnum())
    texts = ["a b c d e", "a b c d", None, "", "  é ß\u3000ü\x85x\xa0y z é ß ü x y ", "to be or not " * 400,
             " ".join(f"w{c}" for c in spaces), "".join(f"{c}q" for c in spaces), "x\U0001f600 y z 😀 ö"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    for n in (1, 2, 5):
        want = sorted(map(tuple, lsh.set_signatures(lsh.set_rows(df, "k", "t", n)).collect()))
        assert sorted(map(tuple, lsh.set_signatures(lsh.text_sets(df, "k", "t", n)).collect())) == want
        assert len(want) >= 5
    for key, _, sig in want:
        words = texts[key].split()
        grams = {" ".join(words[i:i + 5]) for i in range(len(words) - 4)}
        hashes = np.array([int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % mh.PRIME for g in grams])
        assert sig == [int(((a * hashes + b) % mh.PRIME).min()) for a, b in mh.permutations()]
