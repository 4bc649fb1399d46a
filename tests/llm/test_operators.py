"""The training-data operators against brute force, held-out labels and edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusprobe.llm import context_mixing, decontamination, license_scan, line_dedup, minhash_dedup, mixing
from corpusprobe.llm import passage_dedup, quality_classifier, quality_rules, toxicity
from corpusprobe.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, row string, slot string"
SF001 = "/root/testdata/sf0.001"


def words(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()) + str(rng.randrange(9))
            for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, clashing names."""
    rng = random.Random(5)
    text = " ".join(words(rng, 80))
    rows = [(1, text), (2, text), (2, text), (3, None), (4, ""), (5, " \n\t"), (None, text), (None, None),
            (6, "a\nb\nc\nd\na\nb\nc"), (7, " ".join(words(rng, 30_000))), (8, "the mit license")]
    return spark.createDataFrame([(i, t, None if k % 3 else "en", None if k % 4 else "s", None, "x", "y", "z")
                                  for k, (i, t) in enumerate(rows)], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_odd_and_empty_tables(spark, odd, empty):
    items, marks = bench(spark, [(1, "the mit license"), (None, "x"), (2, None)]), labels(spark, [(1, None, 1), (9, 1, 0)])
    per_row = [
        lambda d: decontamination.contamination_report(d, items), line_dedup.line_report,
        lambda d: toxicity.toxicity_report(d, marks), lambda d: quality_classifier.quality_scores(d, marks),
        context_mixing.lm_scores, mixing.mix_report, minhash_dedup.near_dup_report, license_scan.scan_licenses,
        quality_rules.quality_report]
    for report in per_row:
        assert report(odd).count() == odd.count()
        assert report(empty).count() == 0
    assert passage_dedup.repeated_passages(empty).count() == 0
    assert {(r["doc_id"], r["other_doc_id"]) for r in passage_dedup.repeated_passages(odd).collect()} == {(2, 1)}
    for stage in (quality_rules.filter_quality, line_dedup.drop_repeated_lines, minhash_dedup.drop_near_duplicates,
                  lambda d: decontamination.drop_contaminated(d, items)):
        assert stage(odd).columns == odd.columns and stage(empty).count() == 0
        stage(odd).collect()
    assert [c for c in mixing.mix(odd).columns if c not in odd.columns] == ["mix_slot", "position"]


def test_phrases_and_proximity(spark):
    rng = random.Random(1)
    texts = [words(rng, rng.randrange(0, 60)) for _ in range(60)]
    items = [words(rng, n) for n in (0, 1, 4, 10, 14)]
    texts[3][5:5] = items[3]
    texts[7][0:0] = items[4][2:13]
    texts[9] += items[2]
    want = {}
    for i, t in enumerate(texts):
        hit, met = set(), set()
        for j, w in enumerate(items):
            k = min(10, len(w))
            for a in range(len(w) - k + 1 if k else 0):
                for p in range(len(t) - k + 1):
                    if t[p:p + k] == w[a:a + k]:
                        hit |= set(range(p, p + k))
                        met.add(str(j))
        want[i] = (len(t), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit))
    docs = spark.createDataFrame([(i, " ".join(t).upper()) for i, t in enumerate(texts)], "doc_id long, text string")
    items_df = bench(spark, [(j, "-".join(w)) for j, w in enumerate(items)])
    got = {r[0]: tuple(r)[1:] for r in decontamination.contamination_report(docs, items_df).collect()}
    assert got == want and sum(w[1] > 0 for w in want.values()) > 3
    block = decontamination.BLOCK_WORDS
    try:  # a benchmark in several blocks gives the same
        decontamination.BLOCK_WORDS = 20
        assert {r[0]: tuple(r)[1:] for r in decontamination.contamination_report(docs, items_df).collect()} == want
    finally:
        decontamination.BLOCK_WORDS = block
    loose = texts[3][:8] + ["extra"] + texts[3][8:]  # one word slipped into item 3
    near = spark.createDataFrame([(0, " ".join(loose))], "doc_id long, text string")
    assert "3" not in decontamination.contamination(near, items_df).first()["items"]
    assert "3" in decontamination.contamination(near, items_df, slop=1).first()["items"]


def test_items_without_an_id_contaminate(spark):
    """As in the query's SQL: their windows are hit, and they count as one item without a name."""
    rng = random.Random(6)
    first, second, third = (words(rng, 12) for _ in range(3))
    docs = spark.createDataFrame([(0, " ".join(first + second)), (1, " ".join(words(rng, 9) + first + third)), (2, "clean")],
                                 "doc_id long, text string")
    items = bench(spark, [(None, " ".join(first)), (None, " ".join(second)), (7, " ".join(third)), (None, None)])
    sha = {k: hashlib.sha256(k.encode()).hexdigest() for k in ("", "7")}
    want = {0: (24, 24, 1, sha[""], True), 1: (33, 24, 2, sha["7"], True), 2: (1, 0, 0, sha[""], False)}
    block = decontamination.BLOCK_WORDS
    try:
        for size in (block, 5):
            decontamination.BLOCK_WORDS = size
            assert {r[0]: tuple(r)[1:] for r in decontamination.contamination_report(docs, items).collect()} == want
    finally:
        decontamination.BLOCK_WORDS = block
    assert [r["doc_id"] for r in decontamination.drop_contaminated(docs, items).collect()] == [2]


def test_line_windows_keep_the_first(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd\ne"), (2, "x\nb\nc\nd\ny"), (3, "a\nb\nc\nd\ne"), (4, "\n\n\n"), (5, "\n\n\n")],
                                 "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["clean_text"]) for r in line_dedup.line_report(docs).collect()}
    assert got == {1: (0, "a\nb\nc\nd\ne"), 2: (3, "x\ny"), 3: (5, ""), 4: (0, "\n\n\n"), 5: (0, "\n\n\n")}


def test_schedule_deviates_less_than_one_block():
    blocks = {"a": 400, "b": 37, "c": 90, "d": 1}
    weights = {"a": 0.5, "b": 0.2, "c": 0.29, "d": 0.01}
    plan = mixing.plan_phases(blocks, weights, period=100)
    slots = {}
    for s, n in blocks.items():
        for k in range(n):
            first, start, size, own = [p for p in plan[s] if p[0] <= k][-1]
            slots[start + (k - first) // len(own) * size + own[(k - first) % len(own)]] = s
    assert sorted(slots) == list(range(sum(blocks.values())))
    starts = sorted({p[1] for s in plan for p in plan[s]})
    for at, end in zip(starts, [*starts[1:], len(slots)], strict=True):
        parts = {s: (len(p[3]), p[2]) for s in plan for p in plan[s] if p[1] == at}
        seen = Counter()
        for t in range(at, end):
            seen[slots[t]] += 1
            for s, (a, size) in parts.items():
                assert abs(seen[s] - (t + 1 - at) * a / size) < 1


def test_mix_stays_within_a_block_of_exact_weights(spark):
    """A heavy and 200 light sources over a long run, against the target weights themselves."""
    docs = spark.range(9000).select(
        F.col("id").alias("doc_id"), F.lit("t").alias("text"),
        F.expr("case when id < 3000 then 'heavy' else concat('l', id % 200) end").alias("source"))
    got = mixing.interleave(docs, weights={"=heavy": 100.0}, block_docs=1).select("row.source", "slot").collect()
    slots = {r["slot"]: r["source"] for r in got}
    assert sorted(slots) == list(range(9000))
    seen = Counter()
    for t in range(9000):  # all run out together, so no source's share changes
        seen[slots[t]] += 1
        for s in {"heavy", slots[t], f"l{t % 200}"}:
            assert abs(seen[s] - Fraction(t + 1, 3 if s == "heavy" else 300)) < 1


def test_mix_has_no_bound_on_sources(spark):
    docs = spark.range(12_400).select(
        F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.concat(F.lit("site"), F.col("id") % 6200).alias("source"))
    got = mixing.interleave(docs, block_docs=1).select("row.doc_id", "row.source", "block", "slot").collect()
    assert {r["doc_id"] for r in got} == set(range(12_400)) and {r["slot"] for r in got} == set(range(12_400))
    assert all(r["slot"] // 6200 == r["block"] for r in got)


def test_slots_follow_the_shares_of_the_sources_left():
    blocks, weights = {"a": 400, "b": 37, "c": 90, "d": 1}, {"a": 0.5, "b": 0.2, "c": 0.29, "d": 0.01}
    events = sorted((k / weights[s], s, k, n, weights[s]) for s, n in blocks.items() for k in range(n + 1))
    dealt = list(mixing.deal_slots((e[1:] for e in events), sum(map(Fraction, weights.values()))))
    assert [x[2] for x in dealt] == list(range(528)) and {x[:2] for x in dealt} == {(s, k) for s, n in blocks.items() for k in range(n)}
    share, seen, left = dict.fromkeys(blocks, Fraction(0)), Counter(), {s: Fraction(n) for s, n in blocks.items()}
    for s, _, _ in dealt:
        seen[s] += 1
        rest = Fraction(1)
        while rest and any(left.values()):  # one slot, shared among those that still have blocks
            total = sum(Fraction(weights[x]) for x in left if left[x])
            part = min([rest, *(left[x] * total / Fraction(weights[x]) for x in left if left[x])])
            for x in [x for x in left if left[x]]:
                out = part * Fraction(weights[x]) / total
                left[x], share[x] = left[x] - out, share[x] + out
            rest -= part
        assert all(abs(seen[x] - share[x]) < 1 for x in blocks)


def test_mix_is_a_permutation(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "big" if i % 3 else None) for i in range(500)],
                                 "doc_id long, text string, source string")
    got = mixing.interleave(docs, block_docs=8, period=50).select("row.doc_id", "slot", "position").collect()
    assert len({r["position"] for r in got}) == 500 and {r["doc_id"] for r in got} == set(range(500))
    assert all(n <= 8 for n in Counter(r["slot"] for r in got).values())


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(25):
        base = words(rng, rng.randrange(1, 150))
        for _ in range(6):
            t = list(base)
            for _ in range(rng.randrange(0, 9)):
                t[rng.randrange(len(t))] = "new" + str(rng.randrange(99))
            texts.append(t)
    sets = [{tuple(t[i:i + 4]) for i in range(len(t) - 3)} or {tuple(t)} for t in texts]
    least = list(range(len(texts)))
    for _ in range(6):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 80 * len(a | b):
                    least[i] = min(least[i], least[j])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_dup_report(docs).collect()}
    assert got == {i: (len(sets[i]), least[i]) for i in range(len(texts))}


def test_packed_estimate_is_close():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    b = np.concatenate([a[:2400], rng.integers(0, 2**63, 600, dtype=np.uint64)])
    sig, _ = minhash_dedup.signatures([np.unique(a), np.unique(b)])
    x = sig.view(np.uint64)[0] ^ sig.view(np.uint64)[1]
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    same = 128 - int(np.bitwise_count(x & np.uint64(0x1111111111111111)).sum())
    assert abs((same / 128 - 1 / 16) / (15 / 16) - 2400 / 3600) < 0.15


def test_fuzzy_passages(spark):
    rng = random.Random(4)
    passage = words(rng, 70)
    edited = passage[:30] + ["changed"] + passage[31:50] + passage[52:]
    texts = [words(rng, 40) + passage + words(rng, 40), words(rng, 90), words(rng, 10) + edited + words(rng, 20),
             words(rng, 5) + passage[:30] + words(rng, 60)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = passage_dedup.repeated_passages(docs).collect()
    assert [(r["doc_id"], r["other_doc_id"]) for r in got] == [(2, 0)]
    assert (got[0]["start_word"], got[0]["end_word"]) == (10, 10 + len(edited)) and got[0]["identity"] > 0.9
    best = passage_dedup.chains([(0, 5), (10, 15), (20, 25), (12, 2), (21, 300)])[0]
    assert best == [(0, 5), (10, 15), (20, 25)]


def test_passages_span_the_gaps_of_a_chain(spark):
    """Halves below MIN_WORDS with up to 20 words inserted, deleted or replaced between them."""
    rng = random.Random(21)
    texts, want = [], {}
    for n in (13, 15, 20):
        for own, other in ((n, 0), (0, n), (n, n)):
            first, second = ([f"{w}-{len(texts)}" for w in words(rng, k)] for k in (45, 46))
            for middle in (other, own):
                texts.append(words(rng, 30) + first + [f"only{len(texts)}"] * middle + second + words(rng, 30))
            want[len(texts) - 1] = (len(texts) - 2, 30, 30 + 91 + own, 30, 30 + 91 + other, 91)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:7] for r in passage_dedup.repeated_passages(docs).collect()}
    assert got == want


def test_common_words_and_joined_runs():
    rng = random.Random(3)
    for _ in range(200):
        x, y = ([rng.choice("abc") for _ in range(rng.randrange(12))] for _ in range(2))
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, v in enumerate(x):
            for j, w in enumerate(y):
                table[i + 1][j + 1] = table[i][j] + 1 if v == w else max(table[i][j + 1], table[i + 1][j])
        assert passage_dedup.common_words(x, y) == table[-1][-1]
    texts = list(range(300)), list(range(1000, 1300))
    runs = [(0, 40, 0, 40, 40), (50, 90, 40, 80, 40), (190, 235, 180, 225, 45), (240, 250, 230, 240, 10)]
    assert passage_dedup.joined_runs(*texts, runs) == [(0, 90, 0, 80, 80), (190, 250, 180, 240, 55)]


def test_every_repeated_window_is_in_a_passage(spark):
    """Against all 50-word windows, also where no document that holds a first seed holds the passage."""
    rng = random.Random(12)
    parts = [words(rng, 18) for _ in range(4)]
    run = ["same"]
    texts = [words(rng, 20) + p + words(rng, 20) for p in parts]
    texts += [words(rng, 30) + sum(parts, []) + words(rng, n) for n in (9, 40)]
    texts += [words(rng, 9) + run * n + words(rng, 9) for n in (55, 200, 50)]
    texts += [texts[4][:60] + texts[5][40:], [], words(rng, 49), texts[7][:100]]
    for _ in range(30):
        texts.append(sum((rng.choice(texts[:6])[a:a + rng.randrange(20, 90)] for a in (0, 10, 30)), []))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = passage_dedup.repeated_passages(docs).collect()
    held, least = set(), passage_dedup.MIN_WORDS
    for i, t in enumerate(texts):
        windows = [tuple(t[p:p + least]) for p in range(len(t) - least + 1)]
        want = {p + k for p, w in enumerate(windows) if w in held for k in range(least)}
        assert want <= {p for r in rows if r["doc_id"] == i for p in range(r["start_word"], r["end_word"])}
        held.update(windows)
    assert any(r["doc_id"] == 5 and r["other_doc_id"] == 4 for r in rows)
    assert not any(r["doc_id"] < 5 for r in rows)
    for r in rows:
        own, other = r["end_word"] - r["start_word"], r["other_end"] - r["other_start"]
        assert r["other_doc_id"] < r["doc_id"] and min(own, other) >= least
        assert r["n_equal"] >= passage_dedup.MIN_IDENTITY * max(own, other)


def test_base_language_model_and_normalisation(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a", "b c", None, "zz zz a", "A\tb"] * 8)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in context_mixing.lm_scores(docs).collect()}
    toks = {r["doc_id"]: ((r["text"] or "").lower().split() + ["\n"]) for r in docs.collect()}
    c = Counter(w for i, t in toks.items() if zlib.crc32(str(i).encode()) % 10 for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in toks.items():
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert math.isclose(rows[i]["base_score"], base) and rows[i]["n_tokens"] == len(t)
        assert rows[i]["n_known"] == sum(c[w] > 0 for w in t) and rows[i]["train_tokens"] == n
        assert rows[i]["score"] < 0
    assert rows[0]["bits_per_byte"] < 8


def test_quality_classifier_on_held_out_labels(spark):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_classifier.quality_scores(docs, marks).join(marks, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9


def test_chain_feeds_earlier_categories(spark):
    rng = random.Random(6)
    bad, worse = ["grot", "slur"], ["vile"]
    texts, y = [], []
    for i in range(600):
        t = words(rng, 40)
        a = i % 4 == 0
        b = a and i % 8 == 0
        t += [rng.choice(bad)] * a + worse * b
        texts.append((i, " ".join(t)))
        y.append((i, int(a), int(b)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    marks = spark.createDataFrame(y, "doc_id long, rude int, severe int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, marks, ["rude", "severe"]).collect()}
    assert np.mean([(got[i]["p_rude"] > 0.5) == bool(a) for i, a, _ in y]) > 0.98
    assert np.mean([(got[i]["p_severe"] > 0.5) == bool(b) for i, _, b in y]) > 0.98


def test_template_join_equals_plain_containment():
    rng = random.Random(7)
    sets = license_scan.template_sets()
    pool = sorted(frozenset().union(*(w for _, w in sets)))
    join = license_scan.TemplateJoin({w: rng.randrange(100) for w in pool})
    for _ in range(400):
        label, chosen = rng.choice(sets)
        block = [w for w in chosen if rng.random() < 0.93] + rng.sample(pool, 4) + [b"other"]
        want = sorted((lab, len(t & set(block)) / len(t)) for lab, t in sets if len(t & set(block)) >= license_scan.needed(len(t)))
        assert sorted(join.matches(block)) == want


def test_licenses_do_not_depend_on_line_breaks(spark):
    rng = random.Random(8)
    wrapped = ["Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and",
               " * Redistribution and use in source and binary forms, with or\n * without modification, are permitted",
               "This Source Code Form is subject to the terms of the Mozilla\n# Public License, v. 2.0.", "licensed under CC\nBY-NC 4.0"]
    templates = [t for _, t in license_scan.TEMPLATES]
    scattered = " ".join(w + " " + " ".join(words(rng, 9)) for w in " ".join(templates[i] for i in (1, 4, 5, 6)).split())
    one_line = " ".join(words(rng, 300) + [w.replace("\n", " ") for w in wrapped] + words(rng, 300))
    docs = spark.createDataFrame(list(enumerate([*wrapped, scattered, one_line])), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan_licenses(docs).collect()}
    assert got == {0: "mit", 1: "bsd", 2: "mpl", 3: "cc-by-nc", 4: "", 5: "bsd,cc-by-nc,mit,mpl"}


def test_license_blocks_against_all_windows():
    rng = random.Random(10)
    sets, join = license_scan.template_sets(), license_scan.TemplateJoin({})
    hits = 0
    for _ in range(300):
        t = rng.randrange(len(sets))
        text = license_scan.TEMPLATES[t][1].encode().split()
        for _ in range(rng.randrange(8)):
            text.insert(rng.randrange(len(text)), rng.choice([b"other", rng.choice(text)]))
        text = [b"x"] * rng.randrange(9) + [w for w in text if rng.random() < 0.97] + rng.sample(text, 5)
        want = []
        for (label, own), (_, wording) in zip(sets, license_scan.TEMPLATES, strict=True):
            span = len(wording.split()) + license_scan.SLACK
            both = max(len(own.intersection(text[a:a + span])) for a in range(len(text)))
            want += [(label, both / len(own))] * (both >= license_scan.needed(len(own)))
        assert sorted(join.block_matches(text)) == sorted(want)
        hits += len(want)
    assert 100 < hits


def test_quality_rules_use_no_python(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    plan = quality_rules.quality_report(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_quality_stage_keeps_clean_documents(spark):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = quality_rules.filter_quality(docs).select("doc_id").join(marks, "doc_id")
    clean = docs.join(marks.where("quality = 1"), "doc_id").where(F.size(F.split("text", r"\s+")) >= 20).count()
    assert kept.where("quality = 1").count() >= 0.97 * clean
    assert kept.where("quality = 0").count() <= 0.1 * marks.where("quality = 0").count()


def test_minimizers_by_definition():
    rng = np.random.default_rng(5)
    for n in (1, 5, 9, 10, 11, 40, 300):
        for values in (2, 3, 1 << 60):
            h = rng.integers(0, values, n).astype(np.uint64)
            w = min(10, n)
            want = [i + int(np.argmin(h[i:i + w])) for i in range(n - w + 1)]
            assert passage_dedup.window_least(h, w).tolist() == want


def test_first_places_packed_or_not(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    want = sorted(map(tuple, passage_dedup.repeated_passages(docs).collect()))
    assert passage_dedup.place_bits(docs.selectExpr("doc_id", "n_chars AS n_words"))
    assert passage_dedup.place_bits(docs.selectExpr("-doc_id AS doc_id", "n_chars AS n_words")) is None
    assert passage_dedup.place_bits(docs.selectExpr("doc_id + (1L << 50) AS doc_id", "n_chars AS n_words")) is None
    monkeypatch.setattr(passage_dedup, "place_bits", lambda texts: None)
    assert sorted(map(tuple, passage_dedup.repeated_passages(docs).collect())) == want and want
