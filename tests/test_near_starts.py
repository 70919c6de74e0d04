"""Starts near each other, with and without images and GUIDs, against all pairs; many on one PID make no pairs."""

from __future__ import annotations

import random

from tracewell.operators.identity import TWIN, start_keys

REFS = "seq long, role int, guid string, base string, t long, space string, kind string, host string, pid long, image string"


def brute(rows):
    fits = lambda a, b: a[3] is None or b[3] is None or a[3] == b[3]
    at = lambda r: (r[4], r[0])
    starts = [r for r in rows if r[2]]
    own = {r[2]: r for r in starts}
    to = {}
    for x in starts:
        before = [y for y in starts if x[8] == y[8] and x[4] is not None and y[4] is not None and y[5] != x[5] and at(y) < at(x) and x[4] - y[4] <= TWIN and fits(x, y)]
        if before:
            to[x[2]] = min(before, key=at)[2]
    twins = {g: to.get(m, m) for g, m in to.items() if own[to.get(m, m)][5] != own[g][5]}
    out = {r[0]: f"g:h:{twins.get(r[2], r[2])}" for r in starts}
    lives = [r for r in starts if r[2] not in twins and r[4] is not None]
    for x in rows:
        if not x[2]:
            near = [y for y in lives if x[8] == y[8] and x[4] is not None and abs(x[4] - y[4]) <= TWIN and fits(x, y)]
            out[x[0]] = f"g:h:{min(near, key=at)[2]}" if near else f"p:h:{x[8]}:{x[0] if x[4] is None else x[4]}"
    return out


def test_near_starts_are_all_pairs(spark):
    rng = random.Random(3)
    rows = [(i, 0, f"G{i}" if rng.random() < 0.5 else None, rng.choice(["a", "b", None]), None if rng.random() < 0.05 else rng.randrange(400) * 500_000, rng.choice(["0|a", "1|b", "2|c"]), "process_start", "h", rng.choice([1, 1, 2]), None) for i in range(300)]
    assert {r["seq"]: r["key"] for r in start_keys(spark.createDataFrame(rows, REFS)).collect()} == brute(rows)


def test_no_pairs_are_made(spark):
    refs = spark.createDataFrame([(1, 0, "G", None, 1, "0|a", "process_start", "h", 1, None)], REFS)
    plan = start_keys(refs)._jdf.queryExecution().optimizedPlan().toString()
    assert "abs(" not in plan
