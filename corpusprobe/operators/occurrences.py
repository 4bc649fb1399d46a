"""Exact occurrence counting of query strings in a corpus (OCC1-OCC5).

A query occurs in a document wherever its characters appear verbatim;
occurrences may overlap ('aa' occurs 3 times in 'aaaa') and never cross a
document border.

A ``contains`` join is a nested loop. Instead both sides are cut on the literal
space character, keeping empty pieces. A query of k pieces P1..Pk then matches
corpus tokens t_j .. t_{j+k-1} iff

* k = 1: the query lies inside one token. Distinct tokens are counted first
  (map-side partial aggregation absorbs hot words). The queries' character
  grams are counted in the distinct tokens; a query with a gram that is nowhere
  is nowhere, and every other one is looked up by its rarest gram only and
  verified there.
* k = 2: t_j ends with P1 and t_{j+1} starts with P2. Token pairs are
  anchored on a few characters on both sides of the space and verified.
* k >= 3: the inner pieces P2..P(k-1) equal whole tokens. They are cut into
  chunks of up to ``ANCHOR_WORDS`` tokens (the last chunk overlaps so that all
  have one size); corpus windows of that size are equi-joined on their text,
  the neighbouring tokens checked against P1/Pk, and a position counts when
  all chunks of the query matched at their offsets. With few inner pieces (they
  may be one frequent token) the key also holds the last characters of P1 and
  the first of Pk.

Pairs and windows are as many as the corpus has tokens, times the lengths in use.
So tasks first cut out the tokens around places whose bytes may match
(:mod:`corpusprobe.operators.places`). Of what is left a sieve
(:mod:`corpusprobe.operators.sieves`) of the queries' keys, side by side first and
then whole, drops what has no partner before anything is shuffled, however many
queries there are.

With ``tokens=True`` both sides are whitespace tokens and a query matches runs
of whole tokens: all its tokens are inner pieces, there are no edges.

Each branch is an equi-join. Query texts stay out of the joins (rows hold a
numeric id, each edge piece appears once per query), so a query table grows
with the queries' length. It is broadcast only when a sizing action over the
very rows to send shows them below ``broadcast_bytes``; otherwise it is a
shuffle join, where AQE splits a hot anchor.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprobe.functions.text import space_pieces, unnest, ws_tokens
from corpusprobe.operators.places import gram_hashes, gram_places, runs_near, spaced_tokens, token_grams, token_tally
from corpusprobe.operators.sieves import Sieve
from corpusprobe.session import ensure_checkpoint_dir

ANCHOR_WORDS = 6   # max inner tokens per anchor chunk (k >= 3)
GRAM_CHARS = 4     # characters of a gram inside one token (k = 1)
EDGE_CHARS = 3     # anchor chars on each side of few inner pieces
PAIR_CHARS = 6     # anchor chars on each side of the space (k = 2); EDGE_CHARS for few queries: fewer lengths to try
FEW_INNER = 2      # up to so many inner pieces, edge characters join the key
BROADCAST_BYTES = 32 * 1024 * 1024
ROW_BYTES = 192    # a row's fixed fields, string padding and hash-table entry


@dataclass
class _Plan:
    one: list[int] = field(default_factory=list)            # k = 1 gram lengths
    two: list[tuple[int, int]] = field(default_factory=list)  # k = 2 edge classes
    many: list[tuple[int, int, int]] = field(default_factory=list)  # window size, edge characters
    bytes: dict[str, int] = field(default_factory=dict)
    longest: int = 0   # characters of the longest k = 1 query
    chunks: int = 1    # most chunks of a query


def _numbered(queries: DataFrame) -> DataFrame:
    """Distinct queries with an id, written once to the shared checkpoint
    folder: they may be costly to derive, and ids must not change."""
    ensure_checkpoint_dir(queries.sparkSession)
    return queries.withColumn("qid", F.monotonically_increasing_id()).checkpoint()


def distinct_queries(queries: DataFrame, query_col: str = "query", tokens: bool = False) -> DataFrame:
    """Distinct non-empty query strings as ``query`` with their pieces."""
    return (queries.select(F.col(query_col).alias("query"))
            .where(F.col("query").isNotNull() & (F.length("query") > 0))
            .distinct()
            .withColumn("pieces", ws_tokens("query") if tokens else space_pieces("query"))
            .withColumn("k", F.size("pieces")))


def _text(*values) -> Column:
    return F.concat(*[v.cast("string") if isinstance(v, Column) else F.lit(v) for v in values])


def query_bytes(table: DataFrame) -> Column:
    """Bytes of a query table's rows, not below what a broadcast of them holds."""
    strings = [f.name for f in table.schema.fields if f.dataType.simpleString() == "string"]
    return sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in strings), F.lit(ROW_BYTES)).cast("bigint")


def _plan(tables: dict[str, DataFrame]) -> _Plan:
    """One small action: the anchor classes present and the bytes per branch.

    The result has at most GRAM_CHARS rows, one per pair of edge lengths, and
    one per window size and pair of edge lengths.
    """
    cls = {"one": _text(F.col("a")), "two": _text(F.col("a1"), ",", F.col("a2")),
           "many": _text(F.col("s"), ",", F.col("a"), ",", F.col("b"))}
    extra = {"one": F.max("ql"), "two": F.lit(0), "many": F.max("nch")}
    parts = [t.groupBy(F.lit(name).alias("branch"), cls[name].alias("cls"))
             .agg(F.sum(query_bytes(t)).alias("bytes"), extra[name].cast("int").alias("extra"))
             for name, t in tables.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    plan = _Plan()
    for r in sorted(rows.collect(), key=lambda r: (r["branch"], r["cls"])):
        spec = tuple(int(x) for x in r["cls"].split(","))
        getattr(plan, r["branch"]).append(spec[0] if r["branch"] == "one" else spec)
        plan.bytes[r["branch"]] = plan.bytes.get(r["branch"], 0) + r["bytes"]
        if r["branch"] == "one":
            plan.longest = max(plan.longest, r["extra"])
        elif r["branch"] == "many":
            plan.chunks = max(plan.chunks, r["extra"])
    return plan


def _texts(corpus: DataFrame, doc_col: str, text_col: str, tokens: bool) -> DataFrame:
    """(doc_id, text); of whole tokens with one space between them, if they are to be matched."""
    texts = corpus.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    return texts.select("doc_id", F.array_join(ws_tokens("text"), " ").alias("text")) if tokens else texts


def _pieces(texts: DataFrame) -> DataFrame:
    return texts.select("doc_id", space_pieces("text").alias("toks"))


def _tokens(corpus: DataFrame, doc_col: str, text_col: str, tokens: bool) -> DataFrame:
    return _pieces(_texts(corpus, doc_col, text_col, tokens))


def _near(texts: DataFrame, edges: DataFrame, size: int, after: int, broadcast_bytes: int) -> DataFrame:
    """(doc_id, start, toks): the tokens around places that may match; all, where no sieve may be sent."""
    runs = runs_near(texts, edges, 2 * size // ROW_BYTES, broadcast_bytes, after)
    if runs is None:
        return _pieces(texts).select("doc_id", F.lit(0).alias("start"), "toks")
    return runs.select("doc_id", "start", space_pieces(F.col("run").cast("string")).alias("toks"))


def single_queries(q: DataFrame) -> DataFrame:
    """k = 1 queries: qid, query, ql (characters), a (characters of their grams)."""
    return (q.where(F.col("k") == 1).select("qid", "query", F.length("query").alias("ql"))
            .withColumn("a", F.least(F.col("ql"), F.lit(GRAM_CHARS))))


def query_grams(one: DataFrame) -> DataFrame:
    """The grams of :func:`single_queries`: qid, a, off, key. A shorter query is its own gram."""
    return (one.select("qid", "query", "a", F.explode(F.sequence(F.lit(0), F.col("ql") - F.col("a"))).alias("off"))
            .select("qid", "a", "off", F.col("query").substr(F.col("off") + 1, F.col("a")).alias("key")))


def rarest_grams(grams: DataFrame, places: DataFrame) -> DataFrame:
    """(qid, h, off): of each query the gram with the fewest ``places`` (h, places) in the distinct tokens.

    Queries with a gram that has none have no row."""
    rarest = F.min(F.struct(F.coalesce("places", F.lit(0)).alias("places"), "off", "h"))
    return (grams.join(places, "h", "left").groupBy("qid").agg(rarest.alias("g")).where(F.col("g.places") > 0)
            .select("qid", "g.h", "g.off"))


def _branch_one(one, texts, lengths, longest, keys, bcast, broadcast_bytes) -> DataFrame:
    if keys:
        words = unnest(_pieces(texts), "toks", *keys, name="tok")
        vocab = words.groupBy(*keys, "tok").agg(F.count(F.lit(1)).alias("freq"))
        distinct = words.select("tok").distinct()
    else:
        vocab = token_tally(texts, F.col("text"), spaced_tokens).select(F.col("token").alias("tok"), F.col("n").alias("freq"))
        distinct = vocab = vocab.checkpoint()  # read twice
    # Queries share grams: a sieve of all of them for the counts, one of the rarest for the lookup.
    grams = gram_hashes(query_grams(one)).checkpoint()
    places = gram_places(distinct, lengths, Sieve.of(grams.select("h"), grams.count(), broadcast_bytes))
    rare = rarest_grams(grams, places).checkpoint()
    pos = token_grams(vocab, lengths, Sieve.of(rare.select("h"), rare.count(), broadcast_bytes))
    table = rare.join(one.drop("a"), "qid")
    # A place carries no more of its token than the longest query needs on either side.
    start = F.greatest(F.col("i") - F.lit(longest), F.lit(1))
    pos = pos.select(
        *keys, "freq", "h", F.col("tok").substr(start, F.lit(2 * longest)).alias("near"), (F.col("i") - start).alias("at"))
    hit = (pos.join(F.broadcast(table) if bcast else table, "h")
           .where((F.col("at") >= F.col("off"))
                  & (F.col("near").substr(F.col("at") - F.col("off") + 1, F.col("ql")) == F.col("query"))))
    return hit.groupBy("qid", *keys).agg(F.sum("freq").alias("n"))


def pair_queries(q: DataFrame, chars: int = PAIR_CHARS) -> DataFrame:
    """k = 2 queries by the characters beside the space: qid, p1, p2, a1, a2, key."""
    return (q.where(F.col("k") == 2)
            .select("qid", F.element_at("pieces", 1).alias("p1"), F.element_at("pieces", 2).alias("p2"))
            .withColumn("a1", F.least(F.length("p1"), F.lit(chars)))
            .withColumn("a2", F.least(F.length("p2"), F.lit(chars)))
            .withColumn("key", F.concat(F.expr("right(p1, a1)"), F.lit(" "), F.expr("left(p2, a2)"))))


def _edge_hash(side: int, size, text: Column) -> Column:
    return F.xxhash64(F.lit(side), F.col(size).cast("int"), text)


def pair_hashes(table: DataFrame) -> DataFrame:
    """Of the characters on either side of the space, and of the whole keys of :func:`pair_queries`."""
    hashes = F.array(_edge_hash(1, "a1", F.expr("right(p1, a1)")), _edge_hash(2, "a2", F.expr("left(p2, a2)")),
                     F.xxhash64("a1", "a2", "key"))
    return table.select(F.explode(hashes).alias("h"))


def token_pairs(toks: DataFrame, classes: list[tuple[int, int]], keys: list[str], sieve: Sieve | None = None) -> DataFrame:
    """Neighbouring tokens by their characters beside the space: keys, t1, t2, a1, a2, key, as in :func:`pair_queries`.

    ``sieve`` (of :func:`pair_hashes`) keeps those that may match a query."""
    def kept(df: DataFrame, h: Column) -> DataFrame:
        return df if sieve is None else sieve.keep(df, h)

    def sizes(side: int, name: str) -> Column:
        return F.explode(F.array(*[F.lit(a) for a in sorted({c[side] for c in classes})])).alias(name)

    pos = unnest(toks, "toks", *keys, "toks", name="t1", at="p")
    left = pos.select(*keys, "t1", F.get("toks", F.col("p") + 1).alias("t2"), sizes(0, "a1")).where(
        F.col("t2").isNotNull() & (F.length("t1") >= F.col("a1")))
    left = kept(left, _edge_hash(1, "a1", F.expr("right(t1, a1)")))
    both = left.select("*", sizes(1, "a2")).where(F.length("t2") >= F.col("a2"))
    both = kept(both, _edge_hash(2, "a2", F.expr("left(t2, a2)")))
    both = both.withColumn("key", F.concat(F.expr("right(t1, a1)"), F.lit(" "), F.expr("left(t2, a2)")))
    return kept(both, F.xxhash64("a1", "a2", "key"))


def _branch_two(table, texts, plan, keys, bcast, broadcast_bytes) -> DataFrame:
    edges = table.select(F.col("p1").alias("left"), F.col("p2").alias("right"))
    toks = _near(texts, edges, plan.bytes["two"], 1, broadcast_bytes)
    sieve = Sieve.of(pair_hashes(table), 3 * plan.bytes["two"] // ROW_BYTES, broadcast_bytes)
    pairs = token_pairs(toks, plan.two, keys, sieve)
    if not bcast:
        # Shuffle join: shrink its input to distinct pairs (partial aggregation).
        pairs = pairs.groupBy(*pairs.columns).agg(F.count(F.lit(1)).alias("freq"))
    hit = (pairs.join(F.broadcast(table) if bcast else table, ["a1", "a2", "key"])
           .where(F.col("t1").endswith(F.col("p1")) & F.col("t2").startswith(F.col("p2"))))
    return hit.groupBy("qid", *keys).agg((F.count(F.lit(1)) if bcast else F.sum("freq")).alias("n"))


def chunk_queries(q: DataFrame, tokens: bool = False) -> DataFrame:
    """Inner pieces cut into equal-size anchor chunks, one row per chunk.

    Output: qid, nch, j, off, s, a, b, first, second, key, head, tail. ``first``
    and ``second`` are the chunk's first tokens, ``head`` (P1) is on the first chunk only and ``tail`` (Pk) on the last; ``a`` and ``b`` are
    the characters of them in the key.
    """
    c = ANCHOR_WORDS
    if tokens:
        some = q.where(F.col("k") >= 1)
        head = tail = F.lit(None).cast("string")
        inner = F.col("pieces")
    else:
        some = q.where(F.col("k") >= 3)
        head, tail = F.element_at("pieces", 1), F.element_at("pieces", -1)
        inner = F.slice("pieces", F.lit(2), F.col("k") - 2)
    m = F.size("inner")
    offs = F.when(m <= c, F.array(F.lit(0))).otherwise(
        F.array_distinct(F.concat(F.sequence(F.lit(0), m - c, F.lit(c)), F.array(m - c))))

    def edge(piece: str) -> Column:
        known = F.coalesce(F.least(F.length(piece), F.lit(EDGE_CHARS)), F.lit(0))
        return F.when(m <= FEW_INNER, known).otherwise(F.lit(0))

    rows = (some.select("qid", head.alias("head"), tail.alias("tail"), inner.alias("inner"))
            .select("qid", "head", "tail", "inner", F.least(m, F.lit(c)).alias("s"),
                    edge("head").alias("a"), edge("tail").alias("b"), offs.alias("offs"))
            .select("*", F.size("offs").alias("nch"), F.posexplode("offs").alias("j", "off")))
    words = F.array_join(F.slice("inner", F.col("off") + 1, F.col("s")), " ")
    key = words if tokens else F.concat(F.expr("right(head, a)"), F.lit(" "), words, F.lit(" "),
                                        F.expr("left(tail, b)"))
    return rows.select(
        "qid", "nch", "j", "off", "s", "a", "b", F.element_at("inner", F.col("off") + 1).alias("first"),
        F.when(F.col("s") > 1, F.element_at("inner", F.col("off") + 2)).alias("second"),
        key.alias("key"), F.when(F.col("j") == 0, F.col("head")).alias("head"),
        F.when(F.col("j") == F.col("nch") - 1, F.col("tail")).alias("tail"))


def _start_hash(first: str, second: str) -> Column:
    """Of the first two tokens of a window; of its token, where ``second`` is null."""
    return F.xxhash64(F.col(second).isNull(), F.col(first), F.col(second))


def chunk_hashes(chunks: DataFrame) -> DataFrame:
    """Of the first tokens of :func:`chunk_queries`, these with the kind of window, and the whole keys."""
    hashes = F.array(_start_hash("first", "second"), F.xxhash64("s", "a", "b", "first", "second"),
                     F.xxhash64("s", "a", "b", "key"))
    return chunks.select(F.explode(hashes).alias("h"))


def token_windows(toks: DataFrame, classes: list[tuple[int, int, int]], tokens: bool = False,
                  sieve: Sieve | None = None) -> DataFrame:
    """Every window of the classes' sizes, keyed as in :func:`chunk_queries`.

    ``sieve`` (of :func:`chunk_hashes`) keeps only positions whose tokens can start an anchor,
    before any window string is built, and then only windows that may be one.
    Rows of ``toks`` may be parts of documents, with the number of their first token as ``start``.
    Output: doc_id, p (0-based start), s, a, b, key [, prev, nxt].
    """
    n = F.size("toks")
    if "start" not in toks.columns:
        toks = toks.withColumn("start", F.lit(0))
    pos = unnest(toks, "toks", "doc_id", "start", "toks", name="tok", at="p").withColumn("second", F.get("toks", F.col("p") + 1))
    if sieve is not None:
        alone = F.explode(F.array(*[F.lit(x) for x in sorted({s == 1 for s, *_ in classes})])).alias("alone")
        pos = pos.select("doc_id", "start", "toks", "p", "tok", "second", alone).where(F.col("alone") | F.col("second").isNotNull())
        pos = pos.withColumn("second", F.when(~F.col("alone"), F.col("second")))
        pos = sieve.keep(pos, _start_hash("tok", "second"))
    kinds = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(a).alias("a"), F.lit(b).alias("b"))
                      for s, a, b in classes])
    w = (pos.select("doc_id", "start", "toks", "p", "tok", "second", F.explode(kinds).alias("c"))
         .select("doc_id", "start", "toks", "p", "tok", "second", "c.s", "c.a", "c.b")
         .where(F.col("p") + F.col("s") <= n))
    if sieve is not None:
        w = w.where((F.col("s") == 1) == F.col("second").isNull())
        w = sieve.keep(w, F.xxhash64("s", "a", "b", "tok", "second"))
    words = F.array_join(F.slice("toks", F.col("p") + 1, F.col("s")), " ")
    place = (F.col("start") + F.col("p")).alias("p")
    if tokens:
        found = w.select("doc_id", place, "s", "a", "b", words.alias("key"))
    else:
        end = F.col("p") + F.col("s")
        edged = w.select("doc_id", place, "s", "a", "b", words.alias("words"),
                         F.when(F.col("p") >= 1, F.element_at("toks", F.col("p"))).alias("prev"),
                         F.when(end < n, F.element_at("toks", end + 1)).alias("nxt"))
        key = F.concat(F.expr("right(coalesce(prev, ''), a)"), F.lit(" "), F.col("words"), F.lit(" "),
                       F.expr("left(coalesce(nxt, ''), b)"))
        found = edged.select("doc_id", "p", "s", "a", "b", key.alias("key"), "prev", "nxt")
    return found if sieve is None else sieve.keep(found, F.xxhash64("s", "a", "b", "key"))


def match_chunks(windows: DataFrame, chunks: DataFrame, several: bool, tokens: bool = False) -> DataFrame:
    """Join windows with query chunks; one row (qid, doc_id) per match.

    ``several``: some query has more than one chunk, so the chunks found at a
    start are counted; otherwise each joined row is a match.
    """
    hit = windows.join(chunks, ["s", "a", "b", "key"])
    if not tokens:
        first_ok = (F.col("j") != 0) | F.col("prev").endswith(F.col("head"))
        last_ok = (F.col("j") != F.col("nch") - 1) | F.col("nxt").startswith(F.col("tail"))
        hit = hit.where(first_ok & last_ok)
    if not several:
        return hit.select("qid", "doc_id")
    return (hit.select("qid", "doc_id", (F.col("p") - F.col("off")).alias("start"), "nch")
            .groupBy("qid", "doc_id", "start")
            .agg(F.count(F.lit(1)).alias("c"), F.max("nch").alias("nch"))
            .where(F.col("c") == F.col("nch"))
            .select("qid", "doc_id"))


def chunk_edges(chunks: DataFrame, tokens: bool = False) -> DataFrame:
    """(left, right): what a match of :func:`chunk_queries` has before and after the space at its start."""
    words = F.col("key") if tokens else F.expr("substr(key, a + 2, length(key) - a - b - 2)")
    return chunks.select(F.col("head").alias("left"), F.concat(words, F.lit(" "), F.coalesce("tail", F.lit(""))).alias("right"))


def _branch_many(chunks, texts, plan, keys, bcast, broadcast_bytes, tokens) -> DataFrame:
    longest = max(s for s, *_ in plan.many)
    toks = _near(texts, chunk_edges(chunks, tokens), plan.bytes["many"], longest + 1, broadcast_bytes)
    sieve = Sieve.of(chunk_hashes(chunks), 3 * plan.bytes["many"] // ROW_BYTES, broadcast_bytes)
    found = chunks.drop("first", "second")
    occ = match_chunks(token_windows(toks, plan.many, tokens, sieve), F.broadcast(found) if bcast else found, plan.chunks > 1, tokens)
    return occ.groupBy("qid", *keys).agg(F.count(F.lit(1)).alias("n"))


def count_matches(texts: DataFrame, q: DataFrame, tokens: bool, per_doc: bool,
                  broadcast_bytes: int) -> DataFrame:
    """Counts of prepared queries (query, pieces, k) in documents (doc_id, text)
    without null texts, with ``tokens`` of tokens joined by one space; see :func:`occurrence_counts`."""
    q = _numbered(q)
    tables = {"many": chunk_queries(q, tokens)}
    if not tokens:
        tables |= {"one": single_queries(q), "two": pair_queries(q)}
    plan = _plan(tables)
    keys = ["doc_id"] if per_doc else []
    fits = {name: plan.bytes.get(name, 0) <= broadcast_bytes for name in tables}
    if fits.get("two"):
        tables["two"] = pair_queries(q, EDGE_CHARS)
        plan.two = sorted({(min(a, EDGE_CHARS), min(b, EDGE_CHARS)) for a, b in plan.two})
    parts = []
    if plan.one:
        parts.append(_branch_one(tables["one"], texts, plan.one, plan.longest, keys, fits["one"], broadcast_bytes))
    if plan.two:
        parts.append(_branch_two(tables["two"], texts, plan, keys, fits["two"], broadcast_bytes))
    if plan.many:
        parts.append(_branch_many(tables["many"], texts, plan, keys, fits["many"], broadcast_bytes, tokens))
    if parts:
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
    else:
        found = (texts.where(F.lit(False))
                 .select(F.lit(0).cast("bigint").alias("qid"), *keys, F.lit(0).cast("bigint").alias("n")))
    found = q.select("qid", "query").join(found, "qid", "inner" if per_doc else "left")
    return found.select("query", *keys, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def occurrence_counts(corpus: DataFrame, queries: DataFrame, *, query_col: str = "query",
                      doc_col: str = "doc_id", text_col: str = "text", per_doc: bool = False,
                      tokens: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Overlapping occurrence counts of every distinct query in the corpus.

    ``per_doc=False``: ``(query, n)`` for every distinct non-empty query, zeros
    included. ``per_doc=True``: ``(query, doc_id, n)`` for documents with n > 0.
    ``tokens=True``: the query's whitespace tokens as whole tokens of the text,
    whatever whitespace stands between them.

    Runs small actions: the distinct queries are checkpointed, sized, and their sieves built.
    """
    return count_matches(_texts(corpus, doc_col, text_col, tokens),
                         distinct_queries(queries, query_col, tokens), tokens, per_doc, broadcast_bytes)
