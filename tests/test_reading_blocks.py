"""Reading a tree block by block: deep trees over many blocks, against brute force, in few tables."""

from __future__ import annotations

import random

import pytest

from test_sinks import read_aloud
from tracewell.sources import sinks

KIND = "key string, place long, parent string"


@pytest.mark.parametrize("back", [1, 3, 40])
def test_deep_trees_over_many_blocks(spark, monkeypatch, back):
    monkeypatch.setattr(sinks, "BLOCK", 16)
    rng = random.Random(back)
    tree = [(f"k{i}", i // 2, f"k{rng.randrange(max(0, i - back), i)}" if i > 1 and rng.random() < 0.99 else None) for i in range(300)]
    out = sinks.reading_order(spark.createDataFrame(tree, KIND)).collect()
    assert sorted((r["key"], r["depth"], r["nth"]) for r in out) == sorted(read_aloud(tree))


def test_a_chain_in_one_block_takes_no_rounds(spark, monkeypatch):
    tables = []
    keep = sinks.stored
    monkeypatch.setattr(sinks, "stored", lambda df: tables.append(1) or keep(df))
    tree = [(f"k{i}", i, f"k{i - 1}" if i else None) for i in range(1000)]
    out = sinks.reading_order(spark.createDataFrame(tree, KIND)).collect()
    assert {(r["key"], r["depth"], r["nth"]) for r in out} == {(f"k{i}", i, i) for i in range(1000)}
    assert len(tables) <= 7
