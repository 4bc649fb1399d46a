"""Near-duplicate documents by b-bit MinHash.

A document's set are its distinct 4-word shingles. 128 minima are taken; full
minima make 32 bands of four (a pair at similarity 0.8 shares no band with
probability 5e-8), and only the low four bits of each minimum are kept, packed
into eight longs. Documents with equal sets fall together first; then

1. each document is paired with the smallest member of all its bands, and
   after a first round of 2 and 3, in bands whose members still lie in several
   components, with the band's own smallest member;
2. the packed signatures give the collision-corrected estimate
   ``(m/128 - 1/16) / (1 - 1/16)`` by bit counts, and pairs below
   ``MIN_ESTIMATE`` (over five standard deviations under 0.8) go;
3. the rest is confirmed on the full sets and contracted to components;
4. documents of bands that still hold several components are compared in
   blocks, by signature and then on full sets, no pair being written.

So every link is found that shares a band, while a band that is one component
after step 3 costs no further comparison.

Defined results: null and empty texts have the empty set and are linked with
nothing; rows with a null id are linked with nothing and get a null component;
rows that share an id count as one vertex; an empty table gives an empty
result; extra columns are carried along whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, broadcast_if, scratch_table, space_words, text_bytes
from .components import components

SHINGLE = 4
PERMS, BANDS, BITS = 128, 32, 4
MIN_SHARED, OF_UNION = 80, 100
MIN_ESTIMATE = 0.6
#: Words hashed at once; members compared with one copy of a hub; block of the cross comparison.
CHUNK_WORDS = 200_000
HUB_MEMBERS = 200
CROSS_BLOCK = 1000
BROADCAST_STARS = 1_000_000
BROADCAST_SIGS = 100_000

_rng = np.random.default_rng(20240229)
_MULT = _rng.integers(0, 2**63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, PERMS, dtype=np.uint64)
_WORD_MULT = _rng.integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_MULT = _rng.integers(0, 2**63, (BANDS, PERMS // BANDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_set(raw: bytes, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = space_words(raw)
    if not words:
        return np.empty(0, dtype=np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(SHINGLE, len(ids))
    n = len(ids) - k + 1
    total = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        total += ids[j:j + n] * _WORD_MULT[j]
    return np.unique(_mixed(total))


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Packed b-bit signatures (n x 8 longs) and band keys (n x 32 longs) of non-empty sets."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    minima = np.empty((PERMS, len(sets)), dtype=np.uint64)
    for i in range(PERMS):
        minima[i] = np.minimum.reduceat(flat * _MULT[i] + _ADD[i], starts)
    minima = minima.T
    per_long = 64 // BITS
    low = (minima & np.uint64(2**BITS - 1)).reshape(len(sets), PERMS // per_long, per_long)
    packed = (low << (np.arange(per_long, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)
    rows = minima.reshape(len(sets), BANDS, PERMS // BANDS)
    bands = _mixed((rows * _BAND_MULT).sum(axis=2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64))
    return packed.view(np.int64), bands.view(np.int64)


_PROFILE = "doc_id long, n_shingles long, digest binary, sig array<long>, bands array<long>"


def _profile_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), text_bytes(batch)
        at = 0
        while at < len(ids):
            sets, size, end = [], 0, at
            while end < len(ids) and size < CHUNK_WORDS:
                sets.append(shingle_set(texts[end], hashes))
                size += len(sets[-1])
                end += 1
            full = [i for i, s in enumerate(sets) if len(s)]
            sig, bands = signatures([sets[i] for i in full]) if full else (None, None)
            place = {i: j for j, i in enumerate(full)}
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[at:end], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([sig[place[i]] if i in place else None for i in range(len(sets))], pa.list_(pa.int64())),
                pa.array([bands[place[i]] if i in place else None for i in range(len(sets))], pa.list_(pa.int64())),
            ], names=["doc_id", "n_shingles", "digest", "sig", "bands"])
            at = end


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures, corrected for chance agreement."""
    matches = F.lit(0)
    for i in range(PERMS * BITS // 64):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        matches = matches + (64 // BITS - F.bit_count(x))
    chance = 2.0 ** -BITS
    return (matches / PERMS - chance) / (1 - chance)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return OF_UNION * both >= MIN_SHARED * (len(a) + len(b) - both)


def _confirm_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hub, salt), the hub's own row first: links hub - member."""
    hashes, hub, hub_sets = WordHashes(), None, []
    for batch in batches:
        hubs, nodes, texts = batch.column("hub").to_pylist(), batch.column("node").to_pylist(), text_bytes(batch)
        u, v = [], []
        for h, node, raw in zip(hubs, nodes, texts, strict=True):
            own = shingle_set(raw, hashes)
            if h == node:  # more than one text only where rows share an id
                hub_sets = hub_sets + [own] if hub == h else [own]
                hub = h
            elif any(similar(own, x) for x in hub_sets):
                u.append(h)
                v.append(node)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (``hub``, ``node``) whose full sets are similar, as ``u``, ``v``.

    A hub's text travels once per ``HUB_MEMBERS`` members, each member's once
    per pair; a hub of any number of members is split over many keys.
    """
    pairs = scratch_table(pairs, "pairs")
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count("*") / HUB_MEMBERS).cast("int").alias("salts"))
    members = pairs.join(sizes, "hub").select("hub", F.pmod(F.xxhash64("node"), "salts").cast("int").alias("salt"), "node")
    heads = sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("hub").alias("node"))
    stars = scratch_table(members.unionByName(heads), "stars")
    rows = docs.join(broadcast_if(stars, BROADCAST_STARS), F.col("doc_id") == F.col("node")).select("hub", "salt", "node", "text")
    dealt = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("hub") != F.col("node"))
    return dealt.select("hub", "node", "text").mapInArrow(_confirm_rows, "u long, v long")


def _cross_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (grp, lo, hi, block): the rows of block ``lo`` are held,
    those of block ``hi`` compared with them (within one block, each with those
    before it): links between different components."""
    least = (MIN_ESTIMATE * (1 - 2.0 ** -BITS) + 2.0 ** -BITS) * PERMS
    ones, hashes = np.uint64(0x1111111111111111), WordHashes()
    key, held, sets = None, 0, []
    nodes, comps = np.empty(CROSS_BLOCK, dtype=np.int64), np.empty(CROSS_BLOCK, dtype=np.int64)
    sigs = np.empty((CROSS_BLOCK, PERMS * BITS // 64), dtype=np.uint64)
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("grp", "lo", "hi", "block", "node", "component")]
        own_sigs = np.asarray(batch.column("sig").flatten()).view(np.uint64).reshape(batch.num_rows, -1)
        u, v = [], []
        for i, (grp, lo, hi, block, node, comp, raw) in enumerate(zip(*cols, text_bytes(batch), strict=True)):
            if key != (grp, lo, hi):
                key, held, sets = (grp, lo, hi), 0, []
            own = shingle_set(raw, hashes)
            if block == hi:
                x = sigs[:held] ^ own_sigs[i]
                x |= x >> np.uint64(1)
                x |= x >> np.uint64(2)
                close = PERMS - np.bitwise_count(x & ones).sum(axis=1) >= least
                for j in np.flatnonzero(close & (comps[:held] != comp)):
                    if similar(sets[j], own):
                        u.append(int(nodes[j]))
                        v.append(node)
            if block == lo:
                if held == len(nodes):  # hashing may fill a block somewhat over its mean
                    nodes, comps, sigs = (np.concatenate([x, np.empty_like(x)]) for x in (nodes, comps, sigs))
                nodes[held], comps[held], sigs[held] = node, comp, own_sigs[i]
                sets.append(own)
                held += 1
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def close_pairs(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs (``hub``, ``node``) whose signatures are similar enough (step 2)."""
    hubs = sigs.select(F.col("node").alias("hub"), F.col("sig").alias("hub_sig"))
    return pairs.join(sigs, "node").join(hubs, "hub").where(
        estimate(F.col("sig"), F.col("hub_sig")) >= MIN_ESTIMATE).select("hub", "node")


def mixed_bands(bands: DataFrame, found: DataFrame) -> DataFrame:
    """``bucket``, ``node``, ``component`` of the bands that hold several components."""
    members = bands.select("bucket", "node").join(found, "node", "left").select(
        "bucket", "node", F.coalesce("component", "node").alias("component"))
    mixed = members.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b")
    return scratch_table(members.join(mixed.select("bucket"), "bucket", "left_semi"), "mixed-bands")


def cross_links(members: DataFrame, sigs: DataFrame, docs: DataFrame) -> DataFrame:
    """Links of ``members``, bands that hold several components (step 4).

    Documents that share such bands, directly or over others, are one group;
    it is cut into blocks, and each pair of blocks is a task of its own, which
    compares signatures and confirms on full sets without making pair rows.
    """
    heads = members.groupBy("bucket").agg(F.min("node").alias("v"))
    groups = components(members.select("bucket", F.col("node").alias("u")).join(heads, "bucket").select("u", "v"))
    nodes = (members.select("node", "component").distinct().join(sigs, "node")
             .join(groups.withColumnRenamed("component", "grp"), "node"))
    nodes = scratch_table(nodes, "apart")
    sizes = nodes.groupBy("grp").agg(F.ceil(F.count("*") / CROSS_BLOCK).cast("int").alias("blocks"))
    placed = scratch_table(nodes.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")), "apart")
    rows = docs.join(broadcast_if(placed, BROADCAST_SIGS), F.col("doc_id") == F.col("node")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = rows.select("grp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block",
                        "node", "component", "sig", "text")
    dealt = dealt.repartition("grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi", "block")
    return dealt.mapInArrow(_cross_rows, "u long, v long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``digest`` of the set, ``component_id`` per row of ``docs``."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    profile = scratch_table(docs.mapInArrow(_profile_rows, _PROFILE), "minhash-profiles")
    sets = scratch_table(
        profile.where("digest is not null and doc_id is not null").groupBy("digest").agg(
            F.min("doc_id").alias("node"), F.any_value("sig").alias("sig"), F.any_value("bands").alias("bands")),
        "minhash-sets")
    sigs = sets.select("node", "sig")
    every = sets.select(F.explode("bands").alias("bucket"), "node")
    ends = every.groupBy("bucket").agg(F.min("node").alias("lo"), F.count("*").alias("n")).where("n > 1")
    bands = scratch_table(every.join(ends.drop("n"), "bucket"), "minhash-bands")
    # First every document meets the smallest member of all its bands, once.
    stars = bands.groupBy("node").agg(F.min("lo").alias("hub")).where("hub <> node").select("hub", "node")
    links = scratch_table(confirm(close_pairs(stars, sigs), docs), "links")
    found = scratch_table(components(links), "components")
    # Then, in bands of several components only, the band's own smallest member.
    apart = mixed_bands(bands, found)
    heads = apart.groupBy("bucket").agg(F.min(F.struct("node", "component")).alias("head"))
    stars = apart.join(heads, "bucket").where(F.col("head.component") != F.col("component")).select(
        F.col("head.node").alias("hub"), "node").distinct()
    links = scratch_table(links.unionByName(confirm(close_pairs(stars, sigs), docs)), "links")
    found = scratch_table(components(links), "components")
    # At last all that is still apart in some band.
    more = scratch_table(cross_links(mixed_bands(bands, found), sigs, docs), "links")
    if not more.isEmpty():
        found = scratch_table(components(links.unionByName(more)), "components")
    classes = sets.select("digest", "node").join(found, "node", "left").select(
        "digest", F.coalesce("component", "node").alias("component"))
    return profile.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left").select(
        "doc_id", "n_shingles", "digest",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def near_dup_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns: the one of smallest id.
    Of rows alike in id and text one stays."""
    found = near_duplicates(docs)
    lost = scratch_table(found.where("doc_id <> component_id").select(F.col("doc_id").alias("lost_id")).distinct(), "dropped")
    kept = docs.join(broadcast_if(lost, BROADCAST_STARS), F.col("doc_id") == F.col("lost_id"), "left_anti")
    again = scratch_table(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select(
        F.col("doc_id").alias("again_id")), "repeated-ids")
    if again.isEmpty():
        return kept
    rows = kept.join(again, F.col("doc_id") == F.col("again_id"), "left_semi")
    return kept.join(again, F.col("doc_id") == F.col("again_id"), "left_anti").unionByName(
        rows.dropDuplicates(["doc_id", "text"]))
