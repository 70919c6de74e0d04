"""The Merkle manifest against a tree built in one go."""

from __future__ import annotations

import hashlib
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tracewell.llm import merkle
from tracewell.llm.queries import op13_merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def climbed(nodes):
    """Per node its steps to the top, and the top."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for own, i in zip(steps, at, strict=True):
            run = nodes[i // 3 * 3 : i // 3 * 3 + 3]
            own.append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        nodes, at = [h("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)], [i // 3 for i in at]
    return steps, nodes[0]


def brute(rows):
    """rows: (doc_id, source, leaf) -> {(doc_id, source, leaf): (subroot, root, steps)}"""
    trees = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, r[2])):
        trees.setdefault(r[1], []).append(r)
    low = {s: climbed([r[2] for r in own]) for s, own in trees.items()}
    high, root = climbed([top for _, top in low.values()])
    return [(r, low[s][1], root, low[s][0][i] + high[k]) for k, (s, own) in enumerate(trees.items()) for i, r in enumerate(own)]


def held(spark, rows, **options):
    df = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, source string, leaf string, root string").withColumn("n", F.lit("extra")).repartition(3)
    out = merkle.proofs(df, **options).withColumns({"folded": merkle.folded(F.col("leaf"), F.col("path")), "proof": merkle.path_digest(F.col("path"))}).collect()
    told = sorted(repr((r["doc_id"], r["source"], r["leaf"], r["subroot"], r["root"], [(s["left"], s["right"]) for s in r["path"]], r["n"], r["pos"] >= 0)) for r in out)
    assert told == sorted(repr((*r, sub, root, steps, "extra", True)) for r, sub, root, steps in brute(rows))
    assert all(r["folded"] == r["root"] and r["proof"] == h("".join(s["left"] + s["right"] for s in r["path"])) for r in out)


def drawn(n, sources, seed=2):
    rng = random.Random(seed)
    return [(i, rng.choice(sources), h(str(i))) for i in rng.sample(range(10 * n), n)]


#: Few and many nodes for the driver, one and several reductions, more sources than the driver takes.
@pytest.mark.parametrize(("n", "sources", "levels", "top"), [(130, ["a", "b", None, "ü", "Z", ""], 9, 4096), (130, ["a", "a", "a", "b", None], 2, 20), (90, ["a"], 1, 4), (60, [f"s{k}" for k in range(25)], 1, 5)])
def test_proofs_are_brute_force(spark, n, sources, levels, top):
    held(spark, drawn(n, sources), levels=levels, top=top)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 28])
def test_single_runs_and_lone_leaves(spark, n):
    held(spark, drawn(n, ["a"]), levels=2, top=3)


def test_null_and_repeated_ids_and_equal_rows(spark):
    rows = [(None, "a", h("1")), (None, "a", h("2")), (1, "a", h("3")), (1, "a", h("3")), (1, "a", h("0")), (2, None, h("4")), (2, None, h("4"))] + [(7, "a", h("same"))] * 20
    held(spark, rows, levels=1, top=3)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, leaf string")
    assert merkle.proofs(empty).collect() == []


def test_record_digest(spark):
    df = spark.createDataFrame([(1, None, "ü", "a:b"), (None, "", None, "")], "i long, a string, b string, c string")
    out = [r[0] for r in df.select(merkle.record_digest([F.col(c) for c in df.columns])).collect()]
    assert out == [h("1:1-2:ü3:a:b"), h("-0:-0:")]


def test_query_tampering(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no driver tables")
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = {r["doc_id"]: r for r in op13_merkle(spark, sf).collect()}
    assert set(out) == set(docs)
    bent = {i for i, t in docs.items() if t and "\n" in t and zlib.crc32(str(i).encode()) % 2 == 0}
    assert bent and {i for i, r in out.items() if not r["verified"]} == bent
