"""Registered queries over the stand-in tables: name -> fn(spark, sf_dir).

Each one runs the library operator over whole tables (no id subsets, no caps)
and projects a report with scalar columns whose names match the oracle SQL in
:mod:`corpusprobe.plans.oracle`. Arrays are reported as joined strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprobe.functions.text import let, power_log, ws_tokens
from corpusprobe.operators import contamination as con
from corpusprobe.functions.wordforms import TRANSFORMS
from corpusprobe.operators import embed as em
from corpusprobe.operators import lsa
from corpusprobe.operators import lsh_ensemble as lsh
from corpusprobe.operators import minhash as mh
from corpusprobe.operators import natural as nat
from corpusprobe.operators import ngrams as ng
from corpusprobe.operators import probing as pr
from corpusprobe.operators import sketches as sk
from corpusprobe.operators import subwords as sw
from corpusprobe.operators.occurrences import occurrence_counts
from corpusprobe.sources import tasks as tk
from corpusprobe.sources.prompts import benchmark_prompts, corpus, table

# Parameters that suit the short test prompts.
TILE_WORDS = 8
WORD_LOWER_BOUND = 4
CHAR_LOWER_BOUND = 32

TRANSFORM_NAMES = list(TRANSFORMS)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


# ------------------------------------------------------------ occurrences

@register("count_occurrences")
def q_count_occurrences(spark, d):
    tiles = con.word_tiles(benchmark_prompts(spark, d), TILE_WORDS)
    return occurrence_counts(corpus(spark, d), tiles.select(F.col("tile").alias("query")))


@register("prompt_is_contaminated")
def q_prompt_is_contaminated(spark, d):
    flags = con.fixed_length_search(benchmark_prompts(spark, d), corpus(spark, d), TILE_WORDS)
    return flags.select("task", "prompt_id", "flagged")


# ------------------------------------------------------------ fixed length

@register("word_tiles")
def q_word_tiles(spark, d):
    return con.word_tiles(benchmark_prompts(spark, d), TILE_WORDS).select(
        "task", "prompt_id", F.col("tile_idx").cast("bigint").alias("tile_idx"), "tile")


@register("fixed_length_matches")
def q_fixed_length_matches(spark, d):
    flags = con.fixed_length_search(benchmark_prompts(spark, d), corpus(spark, d), TILE_WORDS)
    return (flags.where("flagged")
            .select("task", "prompt_id", F.size("tiles").cast("bigint").alias("n_tiles"),
                    F.array_join("tiles", " | ").alias("tiles")))


@register("flagged_per_task_fixed")
def q_flagged_per_task_fixed(spark, d):
    flags = con.fixed_length_search(benchmark_prompts(spark, d), corpus(spark, d), TILE_WORDS)
    return con.flagged_per_task(flags)


# ------------------------------------------------------------ halving

@register("char_tiles")
def q_char_tiles(spark, d):
    return con.char_tiles(benchmark_prompts(spark, d), CHAR_LOWER_BOUND).select(
        "task", "prompt_id", "scale", F.col("k").cast("bigint").alias("k"), "tile")


@register("halving_chars")
def q_halving_chars(spark, d):
    r = con.halving_chars(benchmark_prompts(spark, d), corpus(spark, d), CHAR_LOWER_BOUND)
    return r.select("task", "prompt_id", "n_chars", "longest", "flagged")


@register("halving_chars_flagged")
def q_halving_chars_flagged(spark, d):
    r = con.halving_chars(benchmark_prompts(spark, d), corpus(spark, d), CHAR_LOWER_BOUND)
    return r.where("flagged").select("task", "prompt_id", "longest")


@register("halving_word_tiles")
def q_halving_word_tiles(spark, d):
    return con.halving_word_tiles(benchmark_prompts(spark, d), WORD_LOWER_BOUND).select(
        "task", "prompt_id", "scale", F.col("k").cast("bigint").alias("k"), "tile", "score1", "score2")


@register("halving_words")
def q_halving_words(spark, d):
    r = con.halving_words(benchmark_prompts(spark, d), corpus(spark, d), WORD_LOWER_BOUND)
    return r.select("task", "prompt_id", "n_words", "longest", "rump", "flagged")


@register("halving_words_rump")
def q_halving_words_rump(spark, d):
    r = con.halving_words(benchmark_prompts(spark, d), corpus(spark, d), WORD_LOWER_BOUND)
    return r.where("rump").select("task", "prompt_id", "n_words", "longest")


@register("halving_words_flagged")
def q_halving_words_flagged(spark, d):
    r = con.halving_words(benchmark_prompts(spark, d), corpus(spark, d), WORD_LOWER_BOUND)
    return r.where("flagged").select("task", "text", "longest", "n_words")


@register("flagged_per_task_halving")
def q_flagged_per_task_halving(spark, d):
    r = con.halving_words(benchmark_prompts(spark, d), corpus(spark, d), WORD_LOWER_BOUND)
    return con.flagged_texts_per_task(r)


@register("flagged_per_task_halving_chars")
def q_flagged_per_task_halving_chars(spark, d):
    r = con.halving_chars(benchmark_prompts(spark, d), corpus(spark, d), CHAR_LOWER_BOUND)
    return con.flagged_texts_per_task(r)


# ------------------------------------------------------------ corpus, lines, n-grams

NGRAM_N = 5


def _lines(spark, d):
    return ng.corpus_lines(corpus(spark, d))


@register("corpus_scan")
def q_corpus_scan(spark, d):
    return corpus(spark, d).select("doc_id", F.length("text").cast("bigint").alias("n_chars"))


@register("corpus_lines")
def q_corpus_lines(spark, d):
    return _lines(spark, d)


@register("lines_scanned")
def q_lines_scanned(spark, d):
    return ng.lines_scanned(_lines(spark, d))


@register("newline_count")
def q_newline_count(spark, d):
    return ng.newline_count(corpus(spark, d))


@register("ws_tokens")
def q_ws_tokens(spark, d):
    w = ws_tokens("text")
    return corpus(spark, d).select("doc_id", F.size(w).cast("bigint").alias("n_tokens"),
                                   F.array_join(w, " ").alias("tokens"))


@register("power_log")
def q_power_log(spark, d):
    b = benchmark_prompts(spark, d)
    nw = F.size(ws_tokens("text"))
    nc = F.length("text")
    return b.select("prompt_id", nw.cast("bigint").alias("n_words"), power_log(nw).alias("pl_words"),
                    nc.cast("bigint").alias("n_chars"), power_log(nc).alias("pl_chars"))


@register("ngram_multiset")
def q_ngram_multiset(spark, d):
    return ng.line_ngrams(_lines(spark, d), NGRAM_N)


@register("ngram_set")
def q_ngram_set(spark, d):
    return ng.line_ngrams(_lines(spark, d), NGRAM_N, distinct=True)


@register("distinct_ngrams")
def q_distinct_ngrams(spark, d):
    return ng.distinct_ngrams(_lines(spark, d), NGRAM_N)


@register("ngram_cardinality")
def q_ngram_cardinality(spark, d):
    return ng.ngram_cardinality(ng.distinct_ngrams(_lines(spark, d), NGRAM_N))


@register("ngram_cardinality_sketches")
def q_ngram_cardinality_sketches(spark, d):
    # A sketch of each source, as parts of a corpus arrive, then their union.
    parts = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    grams = ng.line_ngrams(_lines(spark, d), NGRAM_N).join(parts, "doc_id").select("source", "ngram")
    stored = sk.sketch_values(grams, "ngram", "source")
    every = sk.merge_sketches(stored).select(F.lit("*").alias("source"), "sketch")
    return sk.sketched_cardinality(stored.unionByName(every), "n_ngrams")


@register("ngram_index_extended")
def q_ngram_index_extended(spark, d):
    # The index of the English part of the corpus, kept up when all of it is there.
    english = table(spark, d, "documents").where(F.col("lang") == "en").select("doc_id", "text")
    first = ng.ngram_index(ng.corpus_lines(english), NGRAM_N)
    return ng.extend_index(first, ng.distinct_ngrams(_lines(spark, d), NGRAM_N), "ngram", "ngram_id")


@register("ngram_index")
def q_ngram_index(spark, d):
    return ng.ngram_index(_lines(spark, d), NGRAM_N)


FIELD_BYTES = 60   # of a prompt field that cuts its text at bytes, now and then inside a character


def _cut_prompts(spark, d):
    texts = benchmark_prompts(spark, d).unionByName(table(spark, d, "conversations").select(
        F.col("role").alias("task"), F.col("conv_id").alias("prompt_id"), "text"))
    return texts.select("task", "prompt_id", F.substring(F.encode("text", "UTF-8"), 1, FIELD_BYTES).alias("raw"))


@register("prompt_counts_checked")
def q_prompt_counts_checked(spark, d):
    return con.prompt_counts_checked(_cut_prompts(spark, d), corpus(spark, d), "raw")


@register("lookup_report")
def q_lookup_report(spark, d):
    return con.lookup_report(con.prompt_counts_checked(_cut_prompts(spark, d), corpus(spark, d), "raw"))


@register("token_ids")
def q_token_ids(spark, d):
    return ng.vocabulary(corpus(spark, d))


@register("token_lines")
def q_token_lines(spark, d):
    c = corpus(spark, d)
    return ng.token_lines(ng.token_ids(c, ng.vocabulary(c)))


@register("count_occurrences_tokens")
def q_count_occurrences_tokens(spark, d):
    return occurrence_counts(corpus(spark, d), con.word_tiles(benchmark_prompts(spark, d), TILE_WORDS),
                             query_col="tile", tokens=True)


@register("count_occurrences_vocabulary")
def q_count_occurrences_vocabulary(spark, d):
    # Ids of a vocabulary that lacks the words seen once.
    c = corpus(spark, d)
    known = pr.word_counts(c).where(F.col("n") >= 2)
    vocab = ng.vocabulary(known, "word")
    tiles = con.word_tiles(benchmark_prompts(spark, d), TILE_WORDS)
    return ng.token_occurrence_counts(ng.token_ids(c, vocab), ng.encode_queries(tiles, vocab, "tile"))


#: Published subword vocabulary of the subword queries, unless the session names another one.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _vocabulary(spark):
    return sw.read_vocabulary(spark, spark.conf.get("spark.corpusprobe.vocabulary", VOCABULARY))


@register("subword_token_ids")
def q_subword_token_ids(spark, d):
    return sw.subword_ids(corpus(spark, d), _vocabulary(spark))


@register("subword_token_lines")
def q_subword_token_lines(spark, d):
    return ng.token_lines(sw.subword_ids(corpus(spark, d), _vocabulary(spark)))


@register("subword_queries")
def q_subword_queries(spark, d):
    tiles = con.word_tiles(benchmark_prompts(spark, d), TILE_WORDS)
    ids = sw.subword_queries(tiles, _vocabulary(spark), "tile")
    return ids.select("query", "ids", F.hex(sw.packed_ids("ids")).alias("packed"))


@register("count_occurrences_subwords")
def q_count_occurrences_subwords(spark, d):
    # As an index of token ids counts: a tile is found where its own ids stand, so after a space only if it has one.
    vocabulary = _vocabulary(spark)
    tiles = con.word_tiles(benchmark_prompts(spark, d), TILE_WORDS).select("tile")
    spaced = tiles.unionByName(tiles.select(F.concat(F.lit(" "), "tile").alias("tile")))
    return ng.token_occurrence_counts(sw.subword_ids(corpus(spark, d), vocabulary),
                                      sw.subword_queries(spaced, vocabulary, "tile"))


@register("prompt_is_contaminated_tokens")
def q_prompt_is_contaminated_tokens(spark, d):
    flags = con.fixed_length_search(benchmark_prompts(spark, d), corpus(spark, d), TILE_WORDS, tokens=True)
    return flags.select("task", "prompt_id", "flagged")


@register("halving_words_tokens")
def q_halving_words_tokens(spark, d):
    r = con.halving_words(benchmark_prompts(spark, d), corpus(spark, d), WORD_LOWER_BOUND, tokens=True)
    return r.select("task", "prompt_id", "n_words", "longest", "rump", "flagged")


# ------------------------------------------------------------ word lists and transforms

N_OUTPUTS = 5
N_TEST_WORDS = 10000   # the reference's default list length (a top-k feature)


def _test_words(spark, d):
    return pr.test_words(pr.word_counts(corpus(spark, d)), N_TEST_WORDS)


@register("word_frequencies")
def q_word_frequencies(spark, d):
    return pr.word_frequencies(corpus(spark, d))


@register("test_words")
def q_test_words(spark, d):
    return _test_words(spark, d)


@register("word_slice")
def q_word_slice(spark, d):
    # The regex scan of the reference searches words[:10].
    return pr.word_slice(_test_words(spark, d), 0, 10)


def _transform_query(name):
    def fn(spark, d):
        q = pr.transform_queries(_test_words(spark, d), [name], N_OUTPUTS)
        return q.select("word", "query")
    return fn


for _name in TRANSFORM_NAMES:
    register(f"transform_{_name}")(_transform_query(_name))


@register("transform_combined")
def q_transform_combined(spark, d):
    return pr.transform_queries(_test_words(spark, d), ["reverse"], N_OUTPUTS, combine_with_word=True)


@register("transform_counts")
def q_transform_counts(spark, d):
    return pr.transform_counts(corpus(spark, d), _test_words(spark, d), None, N_OUTPUTS)


@register("transform_avg_count")
def q_transform_avg_count(spark, d):
    return pr.transform_avg_count(
        pr.transform_counts(corpus(spark, d), _test_words(spark, d), None, N_OUTPUTS))


@register("transform_counts_combined")
def q_transform_counts_combined(spark, d):
    return pr.transform_counts(corpus(spark, d), _test_words(spark, d), None, N_OUTPUTS, combine_with_word=True)


@register("transform_avg_count_combined")
def q_transform_avg_count_combined(spark, d):
    return pr.transform_avg_count(q_transform_counts_combined(spark, d))


@register("transform_counts_tokens")
def q_transform_counts_tokens(spark, d):
    return pr.transform_counts(corpus(spark, d), _test_words(spark, d), None, N_OUTPUTS, tokens=True)


# ------------------------------------------------------------ natural-prompt regex scan

N_REGEX_WORDS = 10   # the reference scans with words[:10]


def _reverse_pairs(spark, d):
    words = pr.word_slice(_test_words(spark, d), 0, N_REGEX_WORDS)
    return nat.word_pairs(words.select("idx", "word"), TRANSFORMS["reverse"]).join(
        words.select("idx", "word"), "word")


def _scan_pairs(spark, d):
    return _reverse_pairs(spark, d).select(F.lit("reverse").alias("transform"), "idx", "word", "transformed")


N_COMMON_PAIRS = 300   # a top-k list, longer than the reversed words


def _common_pairs(spark, d):
    """The commonest neighbours in lines: pairs that do occur."""
    runs = F.filter(F.split("line", nat.NON_WORD + "+"), lambda x: x != F.lit(""))
    near = let(runs, lambda r: F.transform(
        F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0))),
        lambda x, i: F.struct(x.alias("word"), F.element_at(r, i + 2).alias("transformed"))))
    top = (_lines(spark, d).select(F.explode(near).alias("p")).groupBy("p.word", "p.transformed")
           .agg(F.count(F.lit(1)).alias("c"))
           .orderBy(F.desc("c"), "word", "transformed").limit(N_COMMON_PAIRS))
    return top.select(F.lit("common").alias("transform"), (-F.col("c")).alias("idx"), "word", "transformed")


@register("word_pairs")
def q_word_pairs(spark, d):
    return _reverse_pairs(spark, d).select("word", "transformed")


@register("natural_prompt_counts")
def q_natural_prompt_counts(spark, d):
    return nat.natural_prompt_counts(_lines(spark, d), _scan_pairs(spark, d))


@register("natural_prompt_docs")
def q_natural_prompt_docs(spark, d):
    return nat.natural_prompt_docs(_lines(spark, d), _scan_pairs(spark, d))


@register("natural_pairs_found")
def q_natural_pairs_found(spark, d):
    both = _scan_pairs(spark, d).unionByName(_common_pairs(spark, d))
    return nat.natural_prompt_counts(_lines(spark, d), both)


@register("natural_pairs_report")
def q_natural_pairs_report(spark, d):
    both = _scan_pairs(spark, d).unionByName(_common_pairs(spark, d))
    return nat.natural_prompt_docs(_lines(spark, d), both)


# ------------------------------------------------------------ MinHash and containment

SHINGLE_N = 5
CONTAINMENT = 0.8


def _doc_sets(spark, d):
    return mh.shingle_sets(corpus(spark, d), "doc_id", "text", SHINGLE_N)


def _prompt_sets(spark, d):
    return mh.shingle_sets(table(spark, d, "benchmark"), "item_id", "text", SHINGLE_N)


def _doc_ngrams(spark, d):
    return lsh.text_sets(corpus(spark, d), "doc_id", "text", SHINGLE_N)


@register("minhash_signatures")
def q_minhash_signatures(spark, d):
    sig = lsh.set_signatures(_doc_ngrams(spark, d))
    return sig.select("key", "size", F.array_join(F.transform("sig", lambda x: x.cast("string")), ",")
                      .alias("sig"))


@register("containment_exact")
def q_containment_exact(spark, d):
    return mh.containment_exact(_prompt_sets(spark, d), _doc_sets(spark, d), CONTAINMENT)


@register("containment_lsh")
def q_containment_lsh(spark, d):
    prompts = lsh.text_sets(table(spark, d, "benchmark"), "item_id", "text", SHINGLE_N)
    return lsh.containment_lsh(prompts, lsh.text_sets(corpus(spark, d), "doc_id", "text", SHINGLE_N), CONTAINMENT)


@register("lsh_ensemble_bands")
def q_lsh_ensemble_bands(spark, d):
    return lsh.build_lsh_index(_doc_ngrams(spark, d))[1]


@register("index_membership")
def q_index_membership(spark, d):
    keys = table(spark, d, "labels").select(F.col("doc_id").alias("key"))
    return mh.index_membership(keys, lsh.indexed_keys(corpus(spark, d), "doc_id", "text", SHINGLE_N))


@register("minhash_estimate")
def q_minhash_estimate(spark, d):
    qsets, dsets = _prompt_sets(spark, d), _doc_sets(spark, d)
    pairs = mh.containment_exact(qsets, dsets, CONTAINMENT).select("qkey", "key")
    qs = mh.minhash_signatures(qsets).select(F.col("key").alias("qkey"), F.col("sig").alias("qsig"))
    ds = mh.minhash_signatures(dsets).select("key", F.col("sig").alias("dsig"))
    return (pairs.join(qs, "qkey").join(ds, "key")
            .select("qkey", "key", mh.minhash_estimate("qsig", "dsig").alias("jaccard_est")))


# ------------------------------------------------------------ prompt sets and cached tasks

N_TASKS_LISTED = 12   # task list of the split/pending queries: task_<item_id % 12>
N_TASKS_CACHED = 10   # tasks with cached splits: task_<doc_id % 10> from labels


def _listed_tasks(spark, d):
    b = table(spark, d, "benchmark")
    return b.select(F.concat(F.lit("task_"), (F.col("item_id") % N_TASKS_LISTED).cast("string"))
                    .alias("task")).distinct()


def _available_splits(spark, d):
    lab = table(spark, d, "labels")
    split = (F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "test")
             .when(F.col("quality") == 0, "validation").otherwise("train"))
    return lab.select(F.concat(F.lit("task_"), (F.col("doc_id") % N_TASKS_CACHED).cast("string"))
                      .alias("task"), split.alias("split")).distinct()


@register("prompts_by_task")
def q_prompts_by_task(spark, d):
    return benchmark_prompts(spark, d)


@register("task_list")
def q_task_list(spark, d):
    return benchmark_prompts(spark, d).select("task").distinct()


@register("typed_projection")
def q_typed_projection(spark, d):
    info = {"features": {"doc_id": {"shape": [], "dtype": "int64"},
                         "quality": {"shape": [], "dtype": "int32"},
                         "toxic": {"shape": [], "dtype": "bool"}}, "num_shards": 1}
    stored = table(spark, d, "labels").select(*[F.col(c).cast("bigint").alias(c)
                                                for c in ("doc_id", "quality", "toxic")])
    return tk.cast_to_declared(stored, info)


@register("decoded_prompts")
def q_decoded_prompts(spark, d):
    b = table(spark, d, "benchmark").select(
        F.col("item_id").alias("prompt_id"), F.encode("text", "UTF-8").alias("inputs_pretokenized"))
    return tk.decode_inputs(b, keep=["prompt_id"])


@register("split_fallback")
def q_split_fallback(spark, d):
    return tk.split_fallback(_listed_tasks(spark, d), _available_splits(spark, d))


@register("pending_tasks")
def q_pending_tasks(spark, d):
    # Done = tasks whose test split was already written.
    done = _available_splits(spark, d).where(F.col("split") == "test").select("task")
    return tk.pending_tasks(_listed_tasks(spark, d), done)


@register("prompt_counts_by_task")
def q_prompt_counts_by_task(spark, d):
    return con.prompt_counts(benchmark_prompts(spark, d), corpus(spark, d))


# ------------------------------------------------------------ embedding

SUBSET = 100


@register("seeded_subset")
def q_seeded_subset(spark, d):
    return em.seeded_subset(corpus(spark, d), SUBSET).select("doc_id")


@register("embed_documents")
def q_embed_documents(spark, d):
    return em.embed_text(corpus(spark, d)).select("doc_id", "embedding")


@register("embed_documents_lsa")
def q_embed_documents_lsa(spark, d):
    c = corpus(spark, d)
    return em.embed_text(c, encoder=lsa.lsa_encoder(lsa.fit_lsa(c))).select("doc_id", "embedding")


@register("embed_subset")
def q_embed_subset(spark, d):
    return em.embed_text(em.seeded_subset(corpus(spark, d), SUBSET)).select("doc_id", "embedding")


# ------------------------------------------------------------ search options

@register("prompt_is_contaminated_normalized")
def q_prompt_is_contaminated_normalized(spark, d):
    flags = con.fixed_length_search(benchmark_prompts(spark, d), corpus(spark, d), TILE_WORDS,
                                    normalize_ws=True)
    return flags.select("task", "prompt_id", "flagged")


@register("halving_words_ignore_rump")
def q_halving_words_ignore_rump(spark, d):
    r = con.halving_words(benchmark_prompts(spark, d), corpus(spark, d), WORD_LOWER_BOUND, rump="ignore")
    return r.select("task", "prompt_id", "longest", "flagged")
