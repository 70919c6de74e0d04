"""The corpus pipeline and the queries on the smallest driver table, where it is there."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from tracewell.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n, names = docs.columns, docs.count(), [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dup", "decontam", "mixing", "sharding"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, SF).persist()
        assert docs.columns[: len(columns)] == columns and docs.count() <= n
        n = docs.count()
        if k < 4:
            assert docs.columns == columns and docs.join(before, "doc_id", "left_anti").count() == 0
        again = stage(spark, docs, SF) if k < 3 else None
        if again is not None:
            assert again.count() == n
    assert {r["shard"] for r in docs.select("shard").collect()} <= set(range(8))


def test_queries_are_registered():
    assert [q for q in QUERIES if q.startswith("op")] == [q for n in range(1, 14) for q in QUERIES if q.startswith(f"op{n}_")]
    assert set(ORACLES) <= set(QUERIES)
