"""The language model against plain Python: contexts, scores, normalisation, partitions, base part."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from corpusprobe.llm import context_mixing as cm

MASK = (1 << 64) - 1


def some_units(seed, n=300):
    rng = random.Random(seed)
    words = {("".join(rng.choice(["a", "b", "th", "er", "é"]) for _ in range(rng.randrange(1, 7))) + " ").encode() for _ in range(n)}
    words |= {bytes(rng.randrange(33, 127) for _ in range(64)), cm.END}
    rows = sorted((w, rng.choice([0, 1, 2, 9])) for w in words for _ in range(2))
    rows = sorted(set(rows))
    return [w for w, _ in rows], np.array([c for _, c in rows]), np.array([rng.choice([0, 1, 1, 2, 30]) for _ in rows])


def bucket_of(units, codes, n, depth=0):
    return cm.Bucket(units, codes, n, np.full(len(units), depth))


def prefix(unit, j, k):
    """The first j bytes and k bits of the next one."""
    return unit[:j], (256 | unit[j]) >> (8 - k)


def plain_columns(units, codes, n, bits, depth):
    """unit, place, bit -> (bit value, node, slots, zeros, ones of both word contexts, by definition)."""
    after = [Counter(), Counter()]
    for u, c, times in zip(units, codes.tolist(), n.tolist(), strict=True):
        for j in range(len(u)):
            for k in range(8):
                value = u[j] >> (7 - k) & 1
                after[0][prefix(u, j, k), value] += times
                after[1][prefix(u, j, k), c, value] += times
    out = {}
    for i, (u, c) in enumerate(zip(units, codes.tolist(), strict=True)):
        for j in range(len(u)):
            back = [u[j - b] if j >= b else 256 + c for b in (1, 2, 3, 4)]
            two = back[0] * 521 + back[1]
            three = two * 521 + back[2]
            contexts = []
            for value, seed in zip((two, three, three * 521 + back[3]), cm._SEEDS.tolist(), strict=True):
                h = (value * 31 + c + 1) * seed & MASK
                contexts.append(h ^ h >> 29)
            for k in range(8):
                node, value = (256 | u[j]) >> (8 - k), u[j] >> (7 - k) & 1
                slots, offset = [], 0
                for h, b in zip(contexts, bits, strict=True):
                    slots.append(((h + node) * int(cm._MIX) & MASK) >> (64 - b) | 0)
                    slots[-1] += offset
                    offset += 1 << b
                counts = [(after[0][prefix(u, j, k), v], after[1][prefix(u, j, k), c, v]) for v in (0, 1)]
                out[i, j, k] = value, node, slots, counts[0], counts[1], j < depth
    return out


@pytest.mark.parametrize("depth", [0, 3])
def test_columns_tables_and_scores_by_definition(depth):
    units, codes, n = some_units(1)
    bits, bucket = (10, 12, 13), bucket_of(units, codes, n, depth)
    want = plain_columns(units, codes, n, bits, depth)
    tables = np.zeros((sum(1 << b for b in bits), 2))
    cm.local_tables(bucket, bits, tables)
    plain = np.zeros_like(tables)
    for (i, _, _), (value, _, slots, _, _, _) in want.items():
        plain[slots, value] += n[i]
    assert np.array_equal(tables, plain)
    rng = np.random.default_rng(2)
    weights, refined = rng.uniform(0, 0.5, (cm.ORDERS, cm.GATES)), rng.uniform(0.2, 0.8, 256 * cm.MAP_CELLS)
    tables = tables.astype(np.float32)
    seen, at = set(), -1
    for alive, bit, node, slots, zeros, ones, low, place in bucket.bit_columns(bits):
        at += 1
        j, k = divmod(at, 8)
        assert place == min(j, 7) * 8 + k
        for col, i in enumerate(alive.tolist()):
            value, own_node, own_slots, z, o, short = want[i, j, k]
            seen.add((i, j, k))
            assert (bit[col], node[col], slots[:, col].tolist()) == (value, own_node, own_slots)
            assert tuple(zeros[:, col]) == z and tuple(ones[:, col]) == o and (low is not None and low[col]) == short
    assert seen == set(want)
    got = cm.bucket_scores(bucket, tables, cm.stretched(tables), bits, weights, refined)
    for i in range(0, len(units), 7):
        total = 0.0
        for j in range(len(units[i])):
            for k in range(8):
                value, node, slots, z, o, short = want[i, j, k]
                z, o = (tuple(tables[slots[2], v] for _ in range(2)) if short else x for v, x in ((0, z), (1, o)))
                x = [math.log((tables[s, 1] + 0.3) / (tables[s, 0] + 0.3)) for s in slots]
                x += [math.log((b + 0.1) / (a + 0.1)) for a, b in zip(z, o, strict=True)]
                level = sum(z[1] + o[1] >= step for step in cm.SEEN_STEPS)
                gate = min(j, 7) * 8 + k + 64 * (2 * level + (z[1] == 0 or o[1] == 0))
                m = sum(w * v for w, v in zip(weights[:, gate], x, strict=True))
                step = min(max(round(m / 0.75) + cm.MAP_CELLS // 2, 0), cm.MAP_CELLS - 1)
                p = (1 / (1 + math.exp(-m)) + refined[node * cm.MAP_CELLS + step]) / 2
                total += math.log10(p if value else 1 - p)
        assert math.isclose(got[i], total, rel_tol=1e-3)


def test_probabilities_of_all_units_sum_to_one():
    """Over every first byte, and no more than one over the units of a corpus."""
    units = [bytes([b]) for b in range(256)]
    rng = np.random.default_rng(3)
    tables = rng.integers(0, 50, (3 << 12, 2)).astype(np.float32)
    weights, refined = rng.uniform(0, 0.5, (cm.ORDERS, cm.GATES)), rng.uniform(0.2, 0.8, 256 * cm.MAP_CELLS)
    for n in (np.zeros(256), rng.integers(0, 9, 256)):
        s = cm.bucket_scores(bucket_of(units, np.full(256, 2), n), tables, cm.stretched(tables), (12, 12, 12), weights, refined)
        assert math.isclose((10 ** s).sum(), 1, rel_tol=1e-5)


def test_long_words_are_coded_in_pieces():
    for size in (62, 63, 64, 65, 127, 128, 200):
        some = cm.Texts([b"A " + b"x" * size, b"q"], cm.WordHashes(), cm.tracked_hashes({}))
        units = [(some.unit(i), int(some.codes[i])) for i in range(len(some.keys)) if some.of[i] == 0]
        assert some.tokens.tolist() == [3, 2] and units[0] == (b"a ", 0) and (cm.END, 0) in units
        inner = [(u, c) for u, c in units if c != cm.LONG and b"x" in u or u == b" "]
        assert b"".join(u for u, _ in inner) == b"x" * size + b" " and all(len(u) <= cm.PIECE for u, _ in inner)
        assert [c >= cm.GOES_ON for _, c in inner] == [False] + [True] * (len(inner) - 1)
        assert sum(cm.is_word(u, c) for u, c in units) == 3 == some.word[some.of == 0].sum()
        assert [cm.is_word(some.unit(i), int(some.codes[i])) for i in range(len(some.keys))] == some.word.tolist()
        assert some.size[some.of == 0].sum() == size + 4


def test_classes_are_votes_before_the_word():
    rng = random.Random(4)
    for _ in range(50):
        groups = np.array([rng.choice([0, 0, 0, 1, 2, 6]) for _ in range(rng.randrange(1, 40))])
        for i, got in enumerate(cm.token_classes(groups)):
            votes = Counter(g for g in groups[:i].tolist() if g)
            assert got == (min(votes, key=lambda g: (-votes[g], g)) if votes else 0)


def corpus(spark, n=120):
    rng = random.Random(7)
    tongues = [[f"{a}{b}{c}" for b in "aeiou" for c in ("n", "st", "r", "")] for a in ("k", "m", "sch", "zh")]
    rows = []
    for i in range(n):
        words = rng.choices(tongues[i % 4], range(20, 0, -1), k=rng.randrange(0, 120))
        rows.append((i, " ".join(words) + (" " + "y" * rng.choice([64, 300]) if i % 9 == 0 else "")))
    return spark.createDataFrame(rows + [(None, "kan ken"), (5, "kan"), (n, None)], "doc_id long, text string")


def scores(docs):
    return sorted((tuple(r) for r in cm.lm_scores(docs).collect()), key=str)


def test_scores_do_not_depend_on_partitions_or_lookups(spark):
    docs = corpus(spark)
    kept = cm.BUCKET_UNITS, cm.TOP_UNITS, cm.COUNT_CHUNK, cm.TEXT_CHUNK, spark.conf.get("spark.sql.shuffle.partitions")
    try:
        cm.BUCKET_UNITS = 30
        want = scores(docs.repartition(1))
        cm.TOP_UNITS, cm.COUNT_CHUNK, cm.TEXT_CHUNK = 3, 70, 50
        spark.conf.set("spark.sql.shuffle.partitions", "5")
        got = scores(docs.repartition(7))
    finally:
        cm.BUCKET_UNITS, cm.TOP_UNITS, cm.COUNT_CHUNK, cm.TEXT_CHUNK = kept[:4]
        spark.conf.set("spark.sql.shuffle.partitions", kept[4])
    assert len(got) == len(want) == docs.count()
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and all(math.isclose(x, y, rel_tol=1e-9) for x, y in zip(a[5:], b[5:], strict=True))


def test_crowded_beginnings_are_split(spark):
    docs = corpus(spark)
    want = {r["doc_id"]: r for r in cm.lm_scores(docs).collect()}
    kept = cm.MAX_GROUP
    try:
        cm.MAX_GROUP = 4
        got = {r["doc_id"]: r for r in cm.lm_scores(docs).collect()}
    finally:
        cm.MAX_GROUP = kept
    for i, r in want.items():  # the same base; another model, no wilder
        assert (got[i]["n_known"], got[i]["n_tokens"]) == (r["n_known"], r["n_tokens"])
        assert math.isclose(got[i]["base_score"], r["base_score"]) and got[i]["score"] > 2 * r["score"] - 10


def test_better_than_the_unigrams_on_held_out_texts(spark):
    rows = cm.lm_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    assert 1 < sum(r["bits_per_byte"] for r in rows) / len(rows) < 2.5


def test_tracked_words_come_from_all_training_documents(spark):
    rng = random.Random(11)
    names = [f"w{i}" for i in range(600)]
    rows = [(i, " ".join(rng.choices(names, k=8))) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    import zlib
    seen = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in set(t.split()))
    want = [w.encode() for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0].encode()))[:cm.TRACKED]]
    assert cm.tracked_words(df) == want


def test_units_alike_so_far_are_one_node():
    """48 words with one beginning have one node for each bit of it, whatever their number."""
    units = sorted(b"beginning" + bytes([97 + a, 97 + b]) + b" " for a in range(8) for b in range(6))
    bucket = bucket_of(units, np.full(48, 1), np.arange(48), 3)
    columns = list(bucket.node_columns((10, 12, 13)))
    for j, (reached, group, nodes) in enumerate(columns):
        sizes = [len(node) for _, _, node, *_ in nodes]
        assert len(reached) == 48 and len(set(group.tolist())) == len({u[:j + 1] for u in units})
        assert sizes[0] == len({u[:j] for u in units}) and (j >= 9 or sizes == [1] * 8)


def test_words_of_a_chunk_are_kept_once():
    texts = [b"One one\tTWO\xc3\x89 \n", b"", b" two\xc3\x89\x0bone\x85 " + b"z" * 70]
    names, index, of = cm.chunk_words(texts)
    assert len(set(names)) == len(names)
    assert [(names[i], t) for i, t in zip(index.tolist(), of.tolist(), strict=True)] == [
        (w, t) for t, raw in enumerate(texts) for w in [*raw.lower().split(), cm.END]]
    some = cm.Texts(texts, cm.WordHashes(), cm.tracked_hashes({b"one": 2}))
    name, code, which = some.distinct()
    assert [cm.unit_keys(some.ids[name], code)[which].tolist(), len(set(zip(name.tolist(), code.tolist(), strict=True)))] == [
        some.keys.tolist(), len(name)]


@pytest.mark.parametrize("kind", ["common", "by_place", "level", "few"])
def test_tracked_words_are_exact_though_chunks_tell_few(spark, monkeypatch, kind):
    import zlib
    rng = random.Random(13)
    names = [f"w{i}" for i in range({"common": 400, "by_place": 400, "level": 3000, "few": 30}[kind])]
    weights = [1] * len(names) if kind == "level" else [1 / (5 + i) for i in range(len(names))]
    rows = []
    for i in range(2000):
        turned = names[i // 500 * 60:] + names[:i // 500 * 60] if kind == "by_place" else names
        rows.append((i, " ".join(rng.choices(turned, weights, k=25) + [f"rare{i}x{k}" for k in range(10 if kind != "few" else 0)])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(4)
    seen = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in set(t.split()))
    want = [w.encode() for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0].encode()))[:cm.TRACKED]]
    monkeypatch.setattr(cm, "COUNT_CHUNK", 30_000)
    ways, counted = [], cm.word_texts
    monkeypatch.setattr(cm, "word_texts", lambda docs, part, among=None: (ways.append((part, among is None)), counted(docs, part, among))[1])
    for part in (cm.TOLD_PART, 8, 3):
        monkeypatch.setattr(cm, "TOLD_PART", part)
        assert cm.tracked_words(docs) == want
    told = counted(docs, 8)
    assert told.where("known is null").count() == 0 and (kind == "few" or told.count() < len(seen) / 10)
    if kind == "level":  # no word is far above the others: all are counted
        assert (None, True) in ways
    if kind == "by_place":
        assert (None, False) in ways


def test_word_counts_and_first_rows_of_a_bucket():
    units, codes, n = some_units(5)
    units, codes, n = [*units, b"z" * 64], np.append(codes, cm.LONG), np.append(n, 3)
    order = sorted(range(len(units)), key=lambda i: (units[i], codes[i]))
    bucket = bucket_of([units[i] for i in order], codes[order], n[order])
    word, spaced = bucket.words()
    assert word.tolist() == [cm.is_word(u, c) for u, c in zip(bucket.units, bucket.codes.tolist(), strict=True)]
    assert spaced.tolist() == [w and u[-1:] == b" " for u, w in zip(bucket.units, word.tolist(), strict=True)]
