"""Near-duplicate documents by SimHash and anchor points of a covering code.

A document's fingerprint has 64 bits: bit i is 1 if it is set in over half of
the XXH64 values (seed 42) of its 4-word shingles, repeats included. Two
fingerprints are linked at ``THRESHOLD`` = 4 or fewer differing bits.

1. Equal fingerprints fall together; what follows works on distinct ones.
2. The 64 bits are cut into three blocks. Linked fingerprints differ in at most
   one bit of some block, so each block is searched at threshold 1.
3. The anchors of a block are the words of a covering code with radius R. A
   fingerprint's home is its nearest anchor, at most R bits away. It is copied
   to every anchor within R + 1 bits: by the triangle inequality a fingerprint
   one bit away from it comes to its home anchor.
4. At each anchor the fingerprints at home are compared, on all 64 bits, with
   all that came. An anchor of any size is cut into tiles of bounded size, so a
   crowded anchor is many tasks; a tile returns the edges of a spanning forest
   of its links, never its pairs.
5. Connected components of these edges give the classes.

The code is the perfect Golay code (23 bits, R = 3, 4,096 anchors and 5.3
copies a block) or, beyond ``LARGE`` distinct fingerprints, the Hamming code
with seven bits beside it (22 bits, R = 1, 262,144 anchors, 15.9 copies). Both
find every link; they differ in copies and comparisons only.

Defined results: null, empty and blank texts have fingerprint zero and are
linked like any other; a row without an id has a fingerprint but a null
component, and links nothing; rows that share an id are one vertex; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, scratch_table, space_words, text_bytes
from .components import components

SHINGLE = 4
SEED = 42
THRESHOLD = 4
#: Widths of the bit blocks: a link has at most THRESHOLD // 3 differing bits in one of them.
BLOCKS = (22, 21, 21)
#: Shingles hashed at once.
CHUNK = 200_000
#: Distinct fingerprints from which the code with more anchors is used.
LARGE = 30_000_000
#: Fingerprints on each side of a tile.
TILE = 8192
BROADCAST_CLASSES = 200_000

#: Generator x^11+x^10+x^6+x^5+x^4+x^2+1 of the binary Golay code.
GOLAY = 0b110001110101


def fingerprint(raw: bytes) -> int:
    """SimHash of a text; 0 without a word."""
    words = space_words(raw)
    if not words:
        return 0
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lens + 1) - 1
    k = min(SHINGLE, len(words))
    starts, last = (ends - lens)[:len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), CHUNK):
        part = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + CHUNK], last[at:at + CHUNK], strict=True)],
                        dtype="<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view("<u8")[0])


_PROFILE = "doc_id long, fp long"


def _profile_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([fingerprint(raw) for raw in text_bytes(batch)], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])


class CoveringCode:
    """A linear code given by the syndrome of each single bit.

    ``patterns[starts[s]:starts[s + 1]]`` are the error patterns of syndrome s
    with weight up to ``radius + reach``, lightest first: adding them to a word
    gives its anchors within that distance, the first one being its home.
    """

    def __init__(self, columns: list[int], checks: int, reach: int):
        self.columns, self.checks = np.array(columns, dtype=np.int64), checks
        words = np.zeros(1, dtype=np.int64)
        layers, lightest, weight = [words], {0: 0}, 0
        while len(lightest) < 1 << checks or weight < self._radius(lightest) + reach:
            weight += 1
            top = np.where(words > 0, np.frexp(words.astype(np.float64))[1], 0)  # each pattern once: add higher bits only
            words = np.concatenate([words[top <= b] | (1 << b) for b in range(len(columns))])
            layers.append(words)
            for s in np.unique(self.syndrome(words)).tolist():
                lightest.setdefault(s, weight)
        self.radius = self._radius(lightest)
        every = np.concatenate(layers[:self.radius + reach + 1])
        heavy = np.concatenate([np.full(len(x), i) for i, x in enumerate(layers[:self.radius + reach + 1])])
        of = self.syndrome(every)
        order = np.lexsort((every, heavy, of))
        self.patterns = every[order]
        self.starts = np.searchsorted(of[order], np.arange((1 << checks) + 1))

    @staticmethod
    def _radius(lightest: dict[int, int]) -> int:
        return max(lightest.values())

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), dtype=np.int64)
        for b, column in enumerate(self.columns):
            out ^= np.where((words >> b) & 1, column, 0)
        return out

    def anchors(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each copy: the word's position, the anchor, and whether it is the word's home."""
        s = self.syndrome(words)
        n = self.starts[s + 1] - self.starts[s]
        which = np.repeat(np.arange(len(words)), n)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        return which, words[which] ^ self.patterns[self.starts[s][which] + nth], nth == 0


def golay_code(reach: int = THRESHOLD // len(BLOCKS)) -> CoveringCode:
    """23 bits, 11 checks, radius 3; a bit's syndrome is x^i modulo the generator."""
    columns, x = [], 1
    for _ in range(23):
        columns.append(x)
        x <<= 1
        x ^= GOLAY if x >> 11 else 0
    return CoveringCode(columns, 11, reach)


def hamming_code(reach: int = THRESHOLD // len(BLOCKS)) -> CoveringCode:
    """15 bits under a Hamming code and seven bits as they are: radius 1."""
    return CoveringCode([*range(1, 16), *[0] * 7], 4, reach)


def block_words(fps: np.ndarray) -> list[np.ndarray]:
    """The bit blocks of unsigned fingerprints."""
    out, at = [], 0
    for width in BLOCKS:
        out.append(((fps >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64))
        at += width
    return out


def replicate(points: DataFrame, code: CoveringCode) -> DataFrame:
    """``anchor``, ``home``, ``node``, ``fp``: a copy of each point for each anchor within reach."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps = (batch.column(c).to_numpy() for c in ("node", "fp"))
            for block, words in enumerate(block_words(fps.view(np.uint64))):
                which, anchor, home = code.anchors(words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor + (block << 32)), pa.array(home), pa.array(nodes[which]), pa.array(fps[which])],
                    names=["anchor", "home", "node", "fp"])

    return points.select("node", "fp").mapInArrow(rows, "anchor long, home boolean, node long, fp long")


def tiles(copies: DataFrame) -> DataFrame:
    """``copies`` dealt to tiles (``anchor``, ``h``, ``v``) of about ``TILE`` points at
    home and ``TILE`` visitors. The sizes are a row per anchor, of which there are
    no more than the code has words, whatever the input."""
    sizes = copies.groupBy("anchor").agg(F.count("*").alias("came"), F.count(F.when(F.col("home"), 1)).alias("homes")).where(
        "came > 1 and homes > 0").select("anchor", F.ceil(F.col("homes") / TILE).cast("int").alias("hs"),
                                         F.ceil(F.col("came") / TILE).cast("int").alias("vs"))
    sizes = F.broadcast(scratch_table(sizes, "anchor-sizes"))
    rows = copies.join(sizes, "anchor").withColumn("spot", F.xxhash64("fp"))
    visits = F.transform(F.sequence(F.lit(0), F.col("hs") - 1), lambda i: F.struct(
        i.alias("h"), F.pmod("spot", "vs").cast("int").alias("v"), F.lit(False).alias("home")))
    stays = F.transform(F.sequence(F.lit(0), F.col("vs") - 1), lambda i: F.struct(
        F.pmod("spot", "hs").cast("int").alias("h"), i.alias("v"), F.lit(True).alias("home")))
    places = F.explode(F.when(F.col("home"), F.concat(visits, stays)).otherwise(visits))
    return rows.select("anchor", places.alias("at"), "node", "fp").select("anchor", "at.*", "node", "fp")


def forest(homes: np.ndarray, came: np.ndarray, limit: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Edges (positions in ``homes`` and in ``came``) that connect what the links within ``limit`` bits connect."""
    label = np.arange(len(homes), len(homes) + len(came))  # of each visitor; a home takes over what it meets
    u, v = [], []
    for i, fp in enumerate(homes):
        near = np.flatnonzero(np.bitwise_count(came ^ fp) <= limit)
        if not len(near):
            continue
        found, first = np.unique(label[near], return_index=True)
        u.extend([i] * len(found))
        v.extend(near[first].tolist())
        if len(found) > 1:
            label[np.isin(label, found)] = found[0]
    return np.array(u, dtype=np.int64), np.array(v, dtype=np.int64)


def _link_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile, those at home first: the forest of each tile's links."""
    key, parts = None, []

    def edges() -> pa.RecordBatch:
        home, node, fp = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, dtype=bool),) * 3
        u, v = forest(fp[home], fp[~home]) if home.any() else (np.empty(0, dtype=np.int64),) * 2
        a, b = node[home][u] if len(u) else u, node[~home][v] if len(v) else v
        real = a != b
        return pa.RecordBatch.from_arrays([pa.array(a[real], pa.int64()), pa.array(b[real], pa.int64())], names=["u", "v"])

    for batch in batches:
        anchor, h, v, home, node, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        fp = fp.view(np.uint64)
        if not len(anchor):
            continue
        turns = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(h) != 0) | (np.diff(v) != 0)) + 1
        for a, b in zip([0, *turns.tolist()], [*turns.tolist(), len(anchor)], strict=True):
            if key != (anchor[a], h[a], v[a]):
                if parts:
                    yield edges()
                key, parts = (anchor[a], h[a], v[a]), []
            parts.append((home[a:b], node[a:b], fp[a:b]))
    if parts:
        yield edges()


def links(points: DataFrame, code: CoveringCode) -> DataFrame:
    """Edges ``u``, ``v`` that connect all nodes within the threshold. ``points``: distinct (``node``, ``fp``)."""
    copies = replicate(points, code)
    dealt = tiles(copies).repartition("anchor", "h", "v").sortWithinPartitions("anchor", "h", "v", F.col("home").desc())
    return dealt.select("anchor", "h", "v", "home", "node", "fp").mapInArrow(_link_rows, "u long, v long").distinct()


def simhash_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint as a signed long), ``component_id`` per row of ``docs``."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    profile = scratch_table(docs.mapInArrow(_profile_rows, _PROFILE), "fingerprints")
    named = profile.where("doc_id is not null")
    points = scratch_table(named.groupBy("fp").agg(F.min("doc_id").alias("node")), "points")
    code = golay_code() if points.count() <= LARGE else hamming_code()
    edges = links(points, code)
    # An id with several texts is one vertex: its fingerprints are linked to each other.
    several = scratch_table(named.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi")
                            .select("doc_id"), "several-texts")
    if not several.isEmpty():
        edges = edges.unionByName(named.join(several, "doc_id").join(points, "fp").select(
            F.col("doc_id").alias("u"), F.col("node").alias("v")))
    edges = scratch_table(edges, "links")
    found = scratch_table(components(edges), "components")
    # Most fingerprints stand alone: only those that share a class are joined back.
    classes = points.join(found.where("node <> component"), "node").select("fp", "component")
    single = points.join(named.groupBy("fp").agg(F.max("doc_id").alias("top")), "fp").where("node < top").select(
        "fp", F.col("node").alias("single"))
    known = scratch_table(single.join(classes, "fp", "full").select("fp", F.coalesce("component", "single").alias("component")),
                          "classes")
    return profile.join(broadcast_if(known, BROADCAST_CLASSES), "fp", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def simhash_report(docs: DataFrame) -> DataFrame:
    return simhash_near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
