"""Fuzzy repeated passages by collinear chaining of shared k-mers.

1. Every text gives seeds: of each ``WINDOW`` consecutive k-mers (``K`` words,
   A-Z lower-cased) the one with the smallest hash, so two texts that share
   ``K + WINDOW - 1`` words in a row share a seed. Documents with the same words
   are one text here; copies are reported against the one of smallest id.
2. Seeds are joined on their hash, each with the first place (smallest id,
   then place) it occurs at, not with all others: links grow with the
   seeds, however many documents share a passage.
3. Per document and earlier document the seeds are chained: in both texts in
   ascending order, ``K`` points a seed minus ``GAP_COST`` per word of distance; the
   best predecessor comes from a Fenwick tree of prefix maxima.
4. Chains are aligned word by word from their seeds outwards; a mismatch is
   bridged when ``ANCHOR`` words agree again within ``BRIDGE`` words; where the
   bridged ends bring a run below ``MIN_IDENTITY`` equal words, they are cut back.
   What lies between the runs of one chain is aligned whatever its length (longest
   common subsequence), and neighbouring runs are joined as far as the whole
   keeps ``MIN_IDENTITY``. Runs and joined runs of at least ``MIN_WORDS`` words
   with ``MIN_IDENTITY`` equal words are the passages.
5. The first places of a passage's seeds may lie in several documents, none of
   which holds the passage. So 2 to 4 run once more with windows of
   ``MIN_WORDS`` words as seeds, at every place of the stretches whose seeds
   all occur in a passage that may have been missed that way.

So each word of a ``MIN_WORDS``-word window that an earlier document holds word
for word is in a passage.

Defined results: null and empty texts and texts below ``MIN_WORDS`` words have no
passages; rows with a null id are left out, as a passage is named by ids; rows
that share an id are each compared; an empty table gives an empty result;
extra columns of the input don't matter.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, broadcast_if, scratch_table, space_words, text_bytes

K, WINDOW = 6, 10
GAP_COST = 0.05
MIN_WORDS = 50
MIN_IDENTITY = 0.8
ANCHOR, BRIDGE = 3, 12
#: Words compared at once in an alignment, a power of four.
STRIDE = 64
#: Words kept around a chain when the earlier text is cut to size.
MARGIN = 100
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(31337)
_MULT = _rng.integers(0, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LONG_MULT = _rng.integers(0, 2**63, MIN_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PROFILE = "doc_id long, n_words long, digest binary, seeds array<long>, places array<int>"
_CHAIN = "doc_id long, other_doc_id long, places array<int>, other_places array<int>"
_PASSAGE = ("doc_id long, other_doc_id long, start_word long, end_word long, other_start long, other_end long, "
            "n_equal long, identity double")


def kmers(ids: np.ndarray, mult: np.ndarray) -> np.ndarray:
    """Hashes of all runs of ``len(mult)`` words of a sequence of word hashes."""
    n = max(0, len(ids) - len(mult) + 1)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(len(mult)):
        h += ids[j:j + n] * mult[j]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def window_least(h: np.ndarray, w: int) -> np.ndarray:
    """For each run of ``w`` values the place of its smallest, the first one if several are equal."""
    at, size = np.arange(len(h)), 1
    while size < w:  # runs of twice the size, then of w, from two that overlap or touch
        step = min(size, w - size)
        left, right = at[:-step], at[step:]
        at, size = np.where(h[left] <= h[right], left, right), size + step
    return at


def seeds_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the minimizers of a sequence of word hashes."""
    h = kmers(ids, _MULT)
    if not len(h):
        return h, np.empty(0, dtype=np.int64)
    at = window_least(h, min(WINDOW, len(h)))
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]  # the places never go back
    return h[at], at


def _profile_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        sizes, digests, seeds, places = [], [], [], []
        for raw in text_bytes(batch):
            words = space_words(raw)
            sizes.append(len(words))
            digests.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
            ids = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
            h, at = seeds_of(ids if len(ids) >= MIN_WORDS else ids[:0])
            seeds.append(h.view(np.int64))
            places.append(at.astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
             pa.array(seeds, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))],
            names=["doc_id", "n_words", "digest", "seeds", "places"])


class PrefixMax:
    """Fenwick tree: largest (value, item) among the first i places."""

    def __init__(self, size: int):
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (size + 1)

    def put(self, place: int, value: float, item: int) -> None:
        i = place + 1
        while i < len(self.best):
            if value > self.best[i][0]:
                self.best[i] = (value, item)
            i += i & -i

    def below(self, place: int) -> tuple[float, int]:
        out, i = (float("-inf"), -1), place
        while i > 0:
            if self.best[i][0] > out[0]:
                out = self.best[i]
            i -= i & -i
        return out


def chains(anchors: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Collinear chains of (place, other place), best first; an anchor is in one at most."""
    anchors = sorted(set(anchors))
    ranks = sorted({a for _, a in anchors})
    tree, score, before = PrefixMax(len(ranks)), [], []
    waiting: list[int] = []  # anchors at the present place: they can't follow each other
    for i, (b, a) in enumerate(anchors):
        if waiting and anchors[waiting[0]][0] < b:
            for j in waiting:
                tree.put(bisect_left(ranks, anchors[j][1]), score[j] + GAP_COST * sum(anchors[j]), j)
            waiting = []
        value, j = tree.below(bisect_left(ranks, a))
        gain = value - GAP_COST * (a + b)
        score.append(K + max(gain, 0.0))
        before.append(j if gain > 0 else -1)
        waiting.append(i)
    out, used = [], [False] * len(anchors)
    for i in sorted(range(len(anchors)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(anchors[i])
            i = before[i]
        if chain:
            out.append(chain[::-1])
    # In runs of one word all seeds meet the same place: those are aligned in one go.
    alone = defaultdict(list)
    for c in out:
        if len(c) == 1:
            alone[c[0][1]] += c
    return [c for c in out if len(c) > 1] + [sorted(c) for c in alone.values()]


def _chain_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, hits in zip(batch.column("doc_id").to_pylist(), batch.column("hits").to_pylist(), strict=True):
            by_other = defaultdict(list)
            for x in hits:
                by_other[x["other"]].append((x["place"], x["other_place"]))
            for other, anchors in by_other.items():
                rows += [(doc, other, [b for b, _ in c], [a for _, a in c]) for c in chains(anchors)]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                         names=["doc_id", "other_doc_id", "places", "other_places"])


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The part of the earlier text that a chain needs, and where it starts."""
    for batch in batches:
        parts, starts = [], []
        last, words = None, []
        for raw, places in zip(text_bytes(batch), batch.column("other_places").to_pylist(), strict=True):
            if raw is not last:
                last, words = raw, space_words(raw)
            start = max(0, places[0] - MARGIN)
            parts.append(b" ".join(words[start:places[-1] + K + MARGIN]).decode())
            starts.append(start)
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("doc_id", "other_doc_id", "places", "other_places")]
            + [pa.array(parts, pa.string()), pa.array(starts, pa.int32())],
            names=["doc_id", "other_doc_id", "places", "other_places", "part", "part_start"])


def ahead(x: list, i: int, step: int, size: int) -> list:
    """At most ``size`` items of ``x`` from place ``i`` on in direction ``step``."""
    return x[i:i + size] if step > 0 else x[max(0, i - size + 1):i + 1][::-1]


def bridge(x: list, y: list, i: int, j: int, step: int) -> tuple[int, int] | None:
    """The nearest places ahead at which ``ANCHOR`` words agree again."""
    runs_x, runs_y = (list(zip(*(w[t:] for t in range(ANCHOR)), strict=False))
                      for w in (ahead(x, i, step, BRIDGE + ANCHOR), ahead(y, j, step, BRIDGE + ANCHOR)))
    first = {run: dj for dj, run in reversed(list(enumerate(runs_y)))}
    near = min(((di + first[run], di) for di, run in enumerate(runs_x) if run in first), default=None)
    return near and (i + step * near[1], j + step * (near[0] - near[1]))


def extend(x: list, y: list, i: int, j: int, step: int) -> tuple[tuple[int, int, int], tuple[int, int, int]]:
    """Align outwards from (i, j), the first pair not yet aligned, in direction
    ``step``: the first places beyond the alignment, and the equal words in it;
    then the same for its longest part with ``MIN_IDENTITY`` equal words."""
    i0, j0, equal = i, j, 0
    end = safe = i, j, 0
    while 0 <= i < len(x) and 0 <= j < len(y):
        size = STRIDE  # equal words in large steps first
        while size:
            part = ahead(x, i, step, size) if i >= 0 else []
            if len(part) == size and j >= 0 and part == ahead(y, j, step, size):
                equal += size
                i += step * size
                j += step * size
            else:
                size //= 4
        if equal > end[2]:
            end = i, j, equal
        if equal >= MIN_IDENTITY * max(abs(end[0] - i0), abs(end[1] - j0)):
            safe = end
        jump = bridge(x, y, i, j, step) if i >= 0 and j >= 0 else None
        if not jump:
            break
        i, j = jump
    return end, safe


def common_words(x: list, y: list) -> int:
    """Length of the longest common subsequence, the places of ``x`` as bits of one number."""
    at: dict = defaultdict(int)
    for i, w in enumerate(x):
        at[w] |= 1 << i
    full = rest = (1 << len(x)) - 1
    for w in y:
        hit = rest & at.get(w, 0)
        rest = (rest + hit | rest - hit) & full
    return len(x) - rest.bit_count()


def joined_runs(words: list, part: list, runs: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """The longest stretches of two and more of the runs that meet ``MIN_WORDS`` and
    ``MIN_IDENTITY`` as a whole. The runs follow each other in both texts."""
    if len(runs) < 2:
        return []
    whole = max(runs[-1][1] - runs[0][0], runs[-1][3] - runs[0][2])
    total = [runs[0][4]]  # equal words up to the end of each run
    for p, q in zip(runs, runs[1:], strict=False):
        x, y = q[0] - p[1], q[2] - p[3]
        spare = (1 - MIN_IDENTITY) * (whole - max(x, y))  # what the rest can make up for
        hopeless = MIN_IDENTITY * max(x, y) - min(x, y) > spare
        between = 0 if hopeless or not min(x, y) else common_words(words[p[1]:q[0]], part[p[3]:q[2]])
        total.append(total[-1] + between + q[4])
    _, b1, _, a1, own = np.array(runs).T
    total, out, last = np.array(total), [], -1
    for i, (b0, _, a0, _, _) in enumerate(runs[:-1]):
        equal, x, y = total - total[i] + own[i], b1 - b0, a1 - a0
        good = (np.minimum(x, y) >= MIN_WORDS) & (equal >= MIN_IDENTITY * np.maximum(x, y))
        j = max(np.flatnonzero(good[i + 1:]), default=-1) + i + 1
        if j > max(i, last):
            out.append((b0, int(b1[j]), a0, int(a1[j]), int(equal[j])))
            last = j
    return out


def passages(words: list, part: list, places: list[int], other: list[int], span: int) -> list[tuple[int, int, int, int, int]]:
    """(start, end, other start, other end, equal words) of the aligned runs of a
    chain, alone and joined. An anchor is left out if its first ``span`` words are
    aligned already, or will be with the next anchor's."""
    out, done = [], -1
    rows: list[list] = [[]]  # runs that follow each other in both texts
    for i, (b, a) in enumerate(zip(places, other, strict=True)):
        if b + span <= done or i + 1 < len(places) and places[i + 1] <= done or words[b:b + K] != part[a:a + K]:
            continue
        for right, left in zip(extend(words, part, b, a, 1), extend(words, part, b - 1, a - 1, -1), strict=True):
            found = left[0] + 1, right[0], left[1] + 1, right[1], left[2] + right[2]
            if found[4] >= MIN_IDENTITY * max(found[1] - found[0], found[3] - found[2]):
                break
        out.append(found)
        done = found[1]
        own = found
        if rows[-1]:
            _, b1, _, a1, _ = rows[-1][-1]
            if b < b1 or a < a1:
                rows.append([])
            elif found[0] < b1 or found[2] < a1:  # what the run before has already is left to it
                left = extend(words[b1:b], part[a1:a], b - b1 - 1, a - a1 - 1, -1)[0]
                own = b1 + left[0] + 1, right[0], a1 + left[1] + 1, right[1], left[2] + right[2]
        rows[-1].append(own)
    joined = [j for runs in rows for j in joined_runs(words, part, runs)]
    return joined + [f for f in out if not any(
        j[0] <= f[0] and f[1] <= j[1] and j[2] <= f[2] and f[3] <= j[3] for j in joined)]


def _align_rows(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        cols = [batch.column(c).to_pylist() for c in ("doc_id", "other_doc_id", "places", "other_places", "part", "part_start")]
        last, words = None, []
        for raw, doc, other, places, other_places, part, start in zip(text_bytes(batch), *cols, strict=True):
            if raw is not last:
                last, words = raw, space_words(raw)
            for b0, b1, a0, a1, equal in passages(words, part.encode().split(), places, [a - start for a in other_places], span):
                size = max(b1 - b0, a1 - a0)
                if min(b1 - b0, a1 - a0) >= MIN_WORDS and equal >= MIN_IDENTITY * size:
                    rows.append((doc, other, b0, b1, a0 + start, a1 + start, equal, equal / size))
        out = list(zip(*rows, strict=True)) or [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, [pa.int64()] * 7 + [pa.float64()], strict=True)],
                                         names=[c.split()[0] for c in _PASSAGE.split(", ")])


def _held(n_words: int, places: np.ndarray, hit: np.ndarray, spans: list) -> tuple[np.ndarray, np.ndarray]:
    """Of the ``MIN_WORDS``-word windows of a text, by first word: whether all
    seeds that depend on the window alone are hit, and whether the spans cover it."""
    missed, covered = np.zeros(n_words + 1, dtype=np.int64), np.zeros(n_words + 1, dtype=np.int64)
    missed[places[~np.isin(places, hit)] + 1] = 1
    for s in spans:
        covered[s["start_word"] + 1:s["end_word"] + 1] = 1
    missed, covered = np.cumsum(missed), np.cumsum(covered)
    at = np.arange(n_words - MIN_WORDS + 1)
    inner = missed[at + MIN_WORDS - K - WINDOW + 2] - missed[at + WINDOW - 1]
    return inner == 0, covered[at + MIN_WORDS] - covered[at] == MIN_WORDS


def _ask_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seeds of the windows whose seeds all have an earlier place but which no passage covers."""
    for batch in batches:
        out = [np.empty(0, dtype=np.int64)]
        cols = [batch.column(c).to_pylist() for c in ("n_words", "seeds", "places", "hit_places", "spans")]
        for n, seeds, places, hit, spans in zip(*cols, strict=True):
            places = np.array(places, dtype=np.int64)
            held, covered = _held(n, places, np.array(hit, dtype=np.int64), spans or [])
            asked = np.concatenate([[0], np.cumsum(held & ~covered)])
            lo = np.clip(places - (MIN_WORDS - K - WINDOW + 1), 0, len(asked) - 1)
            hi = np.clip(places - WINDOW + 2, 0, len(asked) - 1)
            out.append(np.array(seeds, dtype=np.int64)[asked[np.maximum(lo, hi)] > asked[lo]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out))], names=["h"])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the windows whose seeds are all asked for; ``open``: no passage covers it."""
    hashes = WordHashes()
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("doc_id", "asked_places", "spans")]
        for doc, asked, spans, raw in zip(*cols, text_bytes(batch), strict=True):
            words = space_words(raw)
            if len(words) < MIN_WORDS:  # rows that share an id with a longer text
                continue
            ids = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
            held, covered = _held(len(ids), seeds_of(ids)[1], np.array(asked, dtype=np.int64), spans or [])
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kmers(ids, _LONG_MULT)[at].view(np.int64)), pa.array(np.full(len(at), doc)),
                 pa.array(at.astype(np.int32)), pa.array(~covered[at])], names=["h", "doc_id", "place", "open"])


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents named in ``ids``, so that no other text is shuffled."""
    named = scratch_table(ids.select(F.col("id")).distinct(), "passage-ids")
    return docs.join(broadcast_if(named, BROADCAST_IDS), F.col("doc_id") == F.col("id"), "left_semi")


def place_bits(texts: DataFrame) -> int | None:
    """Bits for the places if an id and a place fit one long together."""
    r = texts.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("top"), F.max("n_words").alias("words")).first()
    if r["words"] is None or r["low"] < 0:
        return None
    bits = r["words"].bit_length()
    return bits if r["top"].bit_length() + bits < 63 else None


def first_hits(seeds: DataFrame, bits: int | None) -> DataFrame:
    """Per document with open seeds whose first place is in an earlier document: its ``hits``.

    With ``bits``, the first place is found as one long: such a minimum is hashed, one of a struct sorts all seeds."""
    if bits is None:
        first, doc, place = F.min(F.struct("doc_id", "place")), F.col("first.doc_id"), F.col("first.place")
    else:
        first = F.min(F.shiftleft("doc_id", bits).bitwiseOR(F.col("place").cast("long")))
        doc, place = F.shiftright("first", bits), F.col("first").bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    first = (seeds.groupBy("h").agg(first.alias("first"), F.max(F.when(F.col("open"), F.col("doc_id"))).alias("last"))
             .select("h", doc.alias("first_doc"), place.alias("first_place"), "last").where(F.col("first_doc") < F.col("last")).drop("last"))
    hits = seeds.where("open").join(first, "h").where(F.col("doc_id") > F.col("first_doc")).select(
        "doc_id", F.struct(F.col("first_doc").alias("other"), "place", F.col("first_place").alias("other_place")).alias("hit"))
    return hits.groupBy("doc_id").agg(F.collect_list("hit").alias("hits"))


def aligned_passages(hits: DataFrame, docs: DataFrame, span: int) -> DataFrame:
    """Steps 3 and 4 for the hits of all documents, stored."""
    found = scratch_table(hits.mapInArrow(_chain_rows, _CHAIN), "passage-chains")
    earlier = _only(docs, found.select(F.col("other_doc_id").alias("id"))).withColumnRenamed("doc_id", "id")
    cut = found.join(earlier, F.col("other_doc_id") == F.col("id")).drop("id").mapInArrow(
        _cut_rows, _CHAIN + ", part string, part_start int")
    later = _only(docs, found.select(F.col("doc_id").alias("id"))).withColumnRenamed("doc_id", "id")
    aligned = cut.join(later, F.col("doc_id") == F.col("id")).drop("id")
    return scratch_table(aligned.mapInArrow(partial(_align_rows, span=span), _PASSAGE).distinct(), "passages")


def missed_passages(texts: DataFrame, seeds: DataFrame, hits: DataFrame, passages: DataFrame, docs: DataFrame,
                    bits: int | None) -> DataFrame | None:
    """Step 5; None if nothing can have been missed."""
    spans = scratch_table(passages.groupBy("doc_id").agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans")), "passage-spans")
    own = hits.select("doc_id", F.col("hits.place").alias("hit_places"))
    asked = scratch_table(
        texts.join(own, "doc_id").join(spans, "doc_id", "left").select("n_words", "seeds", "places", "hit_places", "spans")
        .mapInArrow(_ask_rows, "h long").distinct(), "passage-asked")
    if asked.isEmpty():
        return None
    held = seeds.join(broadcast_if(asked, BROADCAST_IDS), "h", "left_semi").groupBy("doc_id").agg(
        F.collect_list("place").alias("asked_places")).join(spans, "doc_id", "left").withColumnRenamed("doc_id", "id")
    held = scratch_table(held, "passage-held")
    rows = _only(docs, held.select("id")).join(held, F.col("doc_id") == F.col("id"))
    windows = scratch_table(rows.select("doc_id", "text", "asked_places", "spans").mapInArrow(
        _window_rows, "h long, doc_id long, place int, open boolean"), "passage-windows")
    return aligned_passages(first_hits(windows, bits), docs, MIN_WORDS)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row per passage of a document that an earlier one holds, see ``_PASSAGE``."""
    docs = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = scratch_table(docs.mapInArrow(_profile_rows, _PROFILE), "passage-seeds")
    long_enough = profile.where(F.col("n_words") >= MIN_WORDS)
    heads = long_enough.groupBy("digest").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")).where("n > 1")
    copies = scratch_table(
        long_enough.select("doc_id", "n_words", "digest").join(heads, "digest").where("doc_id <> head")
        .select("doc_id", "head", "n_words"), "passage-copies")
    copied = broadcast_if(copies.select(F.col("doc_id").alias("copied")).distinct(), BROADCAST_IDS)
    texts = long_enough.join(copied, F.col("doc_id") == F.col("copied"), "left_anti")
    seeds = texts.select("doc_id", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select(
        F.col("s.seeds").alias("h"), "doc_id", F.col("s.places").alias("place"), F.lit(True).alias("open"))
    bits = place_bits(long_enough)
    hits = scratch_table(first_hits(seeds, bits), "passage-hits")
    found = aligned_passages(hits, docs, 1)
    more = missed_passages(texts, seeds, hits, found, docs, bits)
    if more is not None:
        found = found.unionByName(more).distinct()
    whole = copies.select(
        "doc_id", F.col("head").alias("other_doc_id"), F.lit(0).cast("long").alias("start_word"),
        F.col("n_words").alias("end_word"), F.lit(0).cast("long").alias("other_start"), F.col("n_words").alias("other_end"),
        F.col("n_words").alias("n_equal"), F.lit(1.0).alias("identity"))
    return found.unionByName(whole.distinct())
