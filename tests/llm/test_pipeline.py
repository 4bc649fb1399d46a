"""Registered queries against their SQL, and the pipeline against brute force."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import check_oracle_lib as lib  # noqa: E402
import corpus_pipeline  # noqa: E402
from corpusprobe.llm.queries import REGISTRY, SQL  # noqa: E402

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return lib.duck(SF001)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    ok, detail = lib.compare(spark, duck, SF001, name)
    assert ok, detail


def test_a_query_of_each_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in REGISTRY) == list(range(1, len(REGISTRY) + 1))


def test_pipeline_stage_by_stage(spark, duck):
    """Each stage's documents by SQL over the rows of the stage before."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        docs = corpus_pipeline.scratch_table(stage(spark, docs, SF001), f"test-{name}")
        after = docs.toPandas()
        duck.execute("DROP VIEW IF EXISTS documents")
        duck.register("before_rows", before[columns])
        duck.execute("CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM before_rows")
        got = set(after["doc_id"])
        if name == "quality_rules":
            want = {r[0] for r in duck.execute(f"select doc_id from ({SQL['op10_quality_rules']}) where kept").fetchall()}
        elif name == "line_dedup":
            rows = duck.execute(f"select doc_id, clean_text, n_lines, n_removed from ({SQL['op2_line_dedup']})").fetchall()
            texts = {r[0]: r[1] for r in rows if r[3] == 0 or r[3] < r[2]}
            want = set(texts)
            assert dict(zip(after["doc_id"], after["text"], strict=True)) == texts
        elif name == "minhash_near_dedup":
            want = {r[0] for r in duck.execute(f"select doc_id from ({SQL['op8_minhash_near_dedup']}) where kept").fetchall()}
        elif name == "benchmark_decontamination":
            want = {r[0] for r in duck.execute(f"select doc_id from ({SQL['op1_benchmark_decontamination']}) where not contaminated").fetchall()}
        else:
            want = set(before["doc_id"])
            assert after["position"].is_unique
        assert got == want and len(after) == len(want), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
