"""Rows without a GUID are read from their source once; lives meet ends only on the PIDs that have some; names stand for rows without a PID."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tracewell.operators.identity import TWIN, _ended, resolve_references, start_keys
from tracewell.operators.tables import stored

S = 1_000_000
REFS = "seq long, role int, host string, guid string, pid long, base string, image string, t long, space string, kind string"


def ref(seq, pid, t, kind, image=None):
    return (seq, 0, "h", None, pid, None, image, t, "0|a", kind)


def test_a_row_without_a_guid_is_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def told(pid):
        read.add(1)
        return pid

    rows = [ref(i, i % 3, i * S, "network") for i in range(40)]
    starts = stored(start_keys(spark.createDataFrame([ref(100, 1, 10 * S, "process_start")], REFS)))
    refs = spark.createDataFrame(rows, REFS).withColumn("pid", F.udf(told, "long")("pid"))
    assert resolve_references(refs, starts).count() == 41
    assert read.value == 40


def test_lives_without_ends_go_through_no_window(spark):
    lives = spark.createDataFrame([("h", 1, "p:h:1:0", 0)], "host string, pid long, key string, start long")
    ends = spark.createDataFrame([("h", 1, None, 5)], "host string, pid long, guid string, t long")
    alias = spark.createDataFrame([], "own string, to string")
    plan = lambda of: _ended(lives, of, alias)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan(ends)
    assert "Window" not in plan(ends.where(F.lit(False)))


def test_ends_on_some_pids_only(spark):
    rng = random.Random(7)
    rows = [ref(i, rng.choice([1, 1, 2, 3, 4]), rng.randrange(400) * S + i, "network") for i in range(150)]
    rows += [ref(200 + i, 1 + i % 3, rng.randrange(400) * S + i, "process_start") for i in range(12)]
    rows += [ref(300 + i, i % 2 or 4, rng.randrange(400) * S + i, "process_end") for i in range(10)]
    rows += [ref(400 + i, None, i * S, "network", image) for i, image in enumerate(["a.exe", "b.exe", None])]
    rng.shuffle(rows)
    refs = spark.createDataFrame(rows, REFS)
    starts = {p: sorted(t for _, _, _, _, q, _, _, t, _, kind in rows if q == p and kind == "process_start") for p in range(1, 5)}
    since = lambda p, t: max((s for s in starts[p] if s <= t + TWIN), default=None)
    end, want, unseen = {}, {}, []
    for _, _, _, _, p, _, _, t, _, kind in rows:
        if kind == "process_end":
            end[p, since(p, t)] = max(t, end.get((p, since(p, t)), t))
    for seq, _, _, _, p, _, image, t, _, kind in rows:
        if p is None:
            want[seq] = f"u:h:{image or '?'}"
        elif kind == "process_start":
            want[seq] = f"p:h:{p}:{t}"
        elif (s := since(p, t)) is not None and end.get((p, s), t) >= t - TWIN:
            want[seq] = f"p:h:{p}:{s}"
        else:
            unseen.append((seq, p, s, t, kind == "process_end"))
    gap = {u[0]: (*u[1:3], sum(e and q == u[1] and s == u[2] and t + TWIN < u[3] for _, q, s, t, e in unseen)) for u in unseen}
    first = {g: min(u[3] for u in unseen if gap[u[0]] == g) for g in gap.values()}
    want |= {u[0]: f"p:h:{u[1]}:{first[gap[u[0]]]}" for u in unseen}
    assert {r["seq"]: r["key"] for r in resolve_references(refs, stored(start_keys(refs))).collect()} == want
    assert len({g[2] for g in gap.values()}) > 1
