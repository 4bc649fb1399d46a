"""Driver contract: entry smoke check and every registered query against its
DuckDB oracle on the smallest table set."""

import pytest

import __spark_entry__ as entry_mod

import check_oracle_lib as lib
from check_oracle_lib import SF001
from corpusprobe.plans.queries import REGISTRY


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert df.columns == ["task", "flagged"] and len(rows) == 4


def test_every_query_has_oracle_or_is_listed():
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(o) <= set(q)
    # Subword encoders, register sketches and a factorisation: no SQL, unit tests hold them to brute force.
    assert set(REGISTRY) - set(o) == {"subword_token_ids", "subword_token_lines", "subword_queries",
                                      "count_occurrences_subwords", "ngram_cardinality_sketches", "embed_documents_lsa"}


@pytest.fixture(scope="module")
def duck():
    return lib.duck(SF001)


@pytest.mark.parametrize("name", sorted(set(entry_mod.oracle_sql()) & set(REGISTRY)))
def test_query_matches_oracle(spark, duck, name):
    ok, detail = lib.compare(spark, duck, SF001, name)
    assert ok, detail


JOIN_HEAVY = ["count_occurrences", "fixed_length_matches", "halving_words", "halving_chars",
              "transform_counts", "prompt_counts_by_task", "count_occurrences_tokens",
              "containment_exact", "natural_prompt_docs", "minhash_estimate"]


def test_no_query_plans_a_nested_loop_or_cartesian_product(spark):
    bad = {}
    for name in JOIN_HEAVY:
        plan = entry_mod.queries()[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
        if "CartesianProduct" in plan or "NestedLoopJoin" in plan:
            bad[name] = plan[:300]
    assert not bad, bad
